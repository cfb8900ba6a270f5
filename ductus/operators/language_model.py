"""Character n-gram models: modified Kneser-Ney estimation, back-off scoring, perplexity.

A model is a table n, ngram (tokens joined by a space), logprob, backoff, in log10.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.functions import script
from ductus.plans.store import stored

BOS, EOS = "<s>", "</s>"
PRUNE = (0, 1, 1, 2, 2)
#: Discounts where the counts of counts don't give any (the published default of the usual tool).
FALLBACK = (0.5, 1.0, 1.5)
#: What a token costs that not even the unigrams have.
UNKNOWN = -10.0
#: A model of at most so many n-grams (under 100 MB) goes to every task; a larger one is joined.
MAX_LOCAL = 2_000_000


#: White space isn't trained on.
_SPACES = [ord(c) for c in script.WHITE_SPACE]
#: Characters, and n-grams, that are held at once while counting and scoring.
_PIECE, _HELD = 1 << 20, 4_000_000


def _pieces(texts: list[str], most: int) -> Iterator[list[str]]:
    """The texts in order, in lists of about `most` characters."""
    now, size = [], 0
    for t in texts:
        now.append(t)
        size += len(t)
        if size >= most:
            yield now
            now, size = [], 0
    if now:
        yield now


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their counts, of several tables of both."""
    keys, counts = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class _Counter:
    """Counts of the `order` tokens that start at each place of lines (fewer at a line's end), as numbers.

    A token is <s>, </s> or a character that isn't white space; lines without any have no places.
    """

    def __init__(self, order: int):
        self.order, self.bits = order, 62 // order
        self.clear()

    def clear(self) -> None:
        self.names, self.parts, self.total = [None, BOS, EOS], [], (np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.table = np.zeros(0x110000, np.int32)
        self.table[_SPACES] = -1

    def add(self, texts: list[str]) -> bool:
        """False if the lines have more characters than fit into a number; then nothing is counted."""
        codes = _codes(texts)
        found = self.table[codes]
        if len(new := np.unique(codes[found == 0])):
            if len(self.names) + len(new) > 1 << self.bits:
                return False
            self.table[new] = np.arange(len(self.names), len(self.names) + len(new))
            self.names += [chr(c) for c in new.tolist()]
            found = self.table[codes]
        letters = found > 0
        ends = np.cumsum(np.array([len(t) for t in texts], np.int64))
        n = np.diff(np.concatenate([[0], np.cumsum(letters)])[np.concatenate([[0], ends])])
        n = n[n > 0] + 2
        last = np.cumsum(n + self.order - 1) - self.order  # and zeros after each </s>
        first = last - n + 1
        tokens = np.zeros(int((n + self.order - 1).sum()), np.int64)
        inner = np.ones(len(tokens), bool)
        for k in range(self.order):
            inner[last + k] = False
        inner[first] = False
        tokens[inner] = found[letters]
        tokens[first], tokens[last] = 1, 2
        keys = tokens.copy()
        for k in range(1, self.order):
            keys <<= self.bits
            keys[:-k] |= tokens[k:]
        keys = np.sort(keys[tokens > 0])
        if len(keys):
            at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            self.parts.append((keys[at], np.diff(np.append(at, len(keys)))))
        if sum(len(k) for k, _ in self.parts) > max(1_000_000, 2 * len(self.total[0])):
            self.merge()
        return True

    def merge(self) -> None:
        self.total, self.parts = _merged([self.total, *self.parts]), []

    def taken(self) -> Iterator[pa.RecordBatch]:
        """What has been counted, as text; then nothing is."""
        self.merge()
        keys, counts = self.total
        names = pa.array(self.names, pa.string())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            tokens = [names.take(pa.array(part >> self.bits * k & (1 << self.bits) - 1)) for k in range(self.order - 1, -1, -1)]
            grams = pc.binary_join_element_wise(*tokens, " ", null_handling="skip")
            yield pa.RecordBatch.from_arrays([grams, pa.array(counts[i : i + 50_000])], ["ngram", "c"])
        self.clear()


def _counted_plainly(text: str, order: int) -> Iterator[pa.RecordBatch]:
    """The same of one line with more characters than fit into a number."""
    tokens = [BOS, *(c for c in text if ord(c) not in _SPACES), EOS]
    found = Counter(" ".join(tokens[i : i + order]) for i in range(len(tokens)))
    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["ngram", "c"])


def _counted(order: int):
    """Counts of a task's `order` tokens from each place on: a row for each different one, and again every _HELD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _Counter(order)
        for batch in batches:
            todo = list(_pieces(batch.column(0).drop_null().to_pylist(), _PIECE))[::-1]
            while todo:
                texts = todo.pop()
                if not counter.add(texts):
                    if len(counter.names) > 3:
                        yield from counter.taken()
                        todo.append(texts)
                    elif len(texts) > 1:
                        todo += [texts[len(texts) // 2 :], texts[: len(texts) // 2]]
                    else:
                        yield from _counted_plainly(texts[0], order)
                elif len(counter.total[0]) > _HELD:
                    yield from counter.taken()
        yield from counter.taken()

    return run


def ngram_counts(df: DataFrame, order: int = 5, text: str = "text") -> DataFrame:
    """n, ngram, c of the lines that aren't blank.

    The longest n-grams from each place on are counted by task before the shuffle, and the shorter ones from their
    sums: so many rows as there are different ones, however long the lines.
    """
    found = df.select(F.col(text)).mapInArrow(_counted(order), "ngram string, c long").groupBy("ngram").agg(F.sum("c").alias("c"))
    heads = F.transform(F.sequence(F.lit(1), F.size(F.split("ngram", " "))), lambda n: F.struct(n.alias("n"), F.call_function("substring_index", "ngram", F.lit(" "), n).alias("ngram")))
    return found.select(F.explode(heads).alias("g"), "c").groupBy("g.n", "g.ngram").agg(F.sum("c").alias("c"))


def _suffix(ngram: Column) -> Column:
    return F.when(ngram.contains(" "), F.substr(ngram, F.instr(ngram, " ") + 1)).otherwise("")


def _context(ngram: Column) -> Column:
    return F.call_function("substring_index", ngram, F.lit(" "), F.length(ngram) - F.length(F.replace(ngram, F.lit(" "), F.lit(""))))


def adjusted_counts(counts: DataFrame, order: int = 5) -> DataFrame:
    """counts with a: c for the highest order and after <s>, else the number of different left neighbours.

    Every n-gram adds to its own row and to its suffix's, so counts are worked out once and shuffled once.
    """
    row = lambda n, ngram, c, left: F.struct(n.alias("n"), ngram.alias("ngram"), c.alias("c"), left.alias("left"))
    n, ngram, c = F.col("n"), F.col("ngram"), F.col("c").cast("long")
    own, of_suffix = row(n, ngram, c, F.lit(0).cast("long")), row(n - 1, _suffix(ngram), F.lit(None).cast("long"), F.lit(1).cast("long"))
    both = counts.select(F.explode(F.when(n > 1, F.array(own, of_suffix)).otherwise(F.array(own))).alias("g")).select("g.*")
    out = both.groupBy("n", "ngram").agg(F.sum("c").alias("c"), F.sum("left").alias("left")).filter("c IS NOT NULL")
    kept = (n == order) | ngram.startswith(BOS) | (F.col("left") == 0)
    return out.select("n", "ngram", "c", F.when(kept, F.col("c")).otherwise(F.col("left")).alias("a"))


def discounts(adjusted: DataFrame) -> DataFrame:
    """n, d1, d2, d3: one row an order."""
    t = [F.count_if((F.col("a") == k) & (F.col("ngram") != BOS)) for k in range(1, 5)]
    of = adjusted.groupBy("n").agg(*[x.alias(f"t{k}") for k, x in enumerate(t, 1)])
    y = F.col("t1") / (F.col("t1") + 2 * F.col("t2"))

    def d(k: int) -> Column:
        x = F.when((F.col("t1") > 0) & (F.col(f"t{k}") > 0), k - (k + 1) * y * F.col(f"t{k + 1}") / F.col(f"t{k}"))
        return F.when((x > 0) & (x <= k), x).otherwise(F.lit(FALLBACK[k - 1]))

    return of.select("n", *[d(k).alias(f"d{k}") for k in (1, 2, 3)])


def estimate(df: DataFrame, order: int = 5, prune: tuple[int, ...] = PRUNE, text: str = "text") -> DataFrame:
    """The model of the lines of df. n-grams seen at most prune[n - 1] times are left out, and their mass backs off."""
    counts = stored(adjusted_counts(ngram_counts(df, order, text), order).filter(F.col("ngram") != BOS))
    counts = counts.join(F.broadcast(discounts(counts)), "n")  # a row an order
    a = F.col("a")
    less = F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
    limits = F.array(*[F.lit(prune[min(i, len(prune) - 1)]) for i in range(order)])
    rows = counts.select("n", "ngram", _context(F.col("ngram")).alias("context"), "a", less.alias("less"), (F.col("c") > F.element_at(limits, F.col("n").cast("int"))).alias("kept"))
    sums = rows.groupBy("n", "context").agg(F.sum("a").alias("den"), F.sum(F.when(F.col("kept"), a - F.col("less")).otherwise(0.0)).alias("used"))
    sums = stored(sums.select("n", "context", "den", (1 - F.col("used") / F.col("den")).alias("gamma")))
    grams = rows.filter("kept").join(sums, ["n", "context"]).select("n", "ngram", "context", ((a - F.col("less")) / F.col("den")).alias("u"), "gamma")
    grams = stored(grams)
    types = grams.filter("n = 1").count() + 1  # and the unknown one
    lower = grams.filter("n = 1").select("n", "ngram", (F.col("u") + F.col("gamma") / types).alias("p"))
    model = lower
    for n in range(2, order + 1):
        now = grams.filter(F.col("n") == n).withColumn("suffix", _suffix(F.col("ngram")))
        below = lower.select(F.col("ngram").alias("suffix"), F.col("p").alias("below"))
        lower = stored(now.join(below, "suffix").select("n", "ngram", (F.col("u") + F.col("gamma") * F.col("below")).alias("p")))
        model = model.union(lower)
    start = df.sparkSession.createDataFrame([(1, BOS, 1e-99)], "n int, ngram string, p double")
    unknown = sums.filter("n = 1").select(F.lit(1).alias("n"), F.lit("<unk>").alias("ngram"), (F.col("gamma") / types).alias("p"))
    back = sums.select((F.col("n") - 1).alias("n"), F.col("context").alias("ngram"), "gamma").filter("n > 0 AND gamma > 0")
    out = model.union(start).union(unknown).join(back, ["n", "ngram"], "left")
    return out.select("n", "ngram", F.log10("p").alias("logprob"), F.coalesce(F.log10("gamma"), F.lit(0.0)).alias("backoff"))


def windows(df: DataFrame, order: int, text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """df with a row per scored place: window, the token and up to order - 1 before it. Every character is a token."""
    parts = [F.array(F.lit(BOS))] * bos + [F.transform(script.chars(F.col(text)), lambda c: F.when(c == " ", F.lit("␠")).otherwise(c))] + [F.array(F.lit(EOS))] * eos
    tokens = F.concat(*parts)
    cut = F.transform(F.sequence(F.lit(1), F.size("__t")), lambda i: F.array_join(F.slice("__t", F.greatest(i - order + 1, F.lit(1)), F.least(i, F.lit(order))), " "))
    some = F.when(F.size("__t") > 0, cut).otherwise(F.array().cast("array<string>"))
    return df.withColumn("__t", tokens).withColumn("window", F.explode_outer(some)).drop("__t")


def score_windows(found: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """window, logprob of a table of distinct windows: the longest known n-gram, with the back-offs of the longer ones.

    The symbol for a space is never in a model: models are trained without spaces, so a space costs UNKNOWN.
    """
    w = F.split("window", " ")
    n = F.explode(F.sequence(F.lit(1), F.size(w)))
    tried = found.select("window", w.alias("w"), n.alias("n"))
    tail = F.slice("w", F.size("w") - F.col("n") + 1, F.col("n"))
    tried = tried.select("window", "n", F.array_join(tail, " ").alias("ngram"), F.array_join(F.slice(tail, 1, F.col("n") - 1), " ").alias("context"))
    hit = model.select("n", "ngram", "logprob")
    back = model.select((F.col("n") + 1).alias("n"), F.col("ngram").alias("context"), "backoff")
    both = tried.join(hit, ["n", "ngram"], "left").join(back, ["n", "context"], "left")
    best = both.groupBy("window").agg(
        F.max(F.when(F.col("logprob").isNotNull(), F.struct("n", "logprob"))).alias("hit"),
        F.collect_list(F.struct("n", F.coalesce("backoff", F.lit(0.0)).alias("backoff"))).alias("tried"),  # `order` entries at most
    )
    longer = F.filter("tried", lambda x: (x["n"] > 1) & (x["n"] > F.coalesce(F.col("hit.n"), F.lit(0))))
    sum_back = F.aggregate(F.sort_array(longer), F.lit(0.0), lambda s, x: s + x["backoff"])
    return best.select("window", (F.coalesce("hit.logprob", F.lit(UNKNOWN)) + sum_back).alias("logprob"))


class _Table:
    """Numbers of one order's n-grams by hash, with their logprob and backoff at the same places."""

    def __init__(self, numbers: np.ndarray, logprob: np.ndarray, backoff: np.ndarray):
        bits = max(4, (2 * len(numbers)).bit_length())  # at most half full
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        at, todo = self._start(numbers), np.arange(len(numbers))
        places = at.copy()
        while len(todo):
            free = self.keys[at] < 0
            self.keys[at[free]] = numbers[todo[free]]
            placed = self.keys[at] == numbers[todo]
            places[todo[placed]] = at[placed]
            todo, at = todo[~placed], at[~placed] + 1 & self.last
        self.logprob, self.backoff = np.zeros(1 << bits), np.zeros(1 << bits)
        self.logprob[places], self.backoff[places] = logprob, backoff

    def _start(self, numbers: np.ndarray) -> np.ndarray:
        return (numbers.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of numbers, and whether they are there."""
        at = self._start(numbers)
        found = self.keys[at]
        known = found == numbers
        going = np.flatnonzero(~known & (found >= 0))
        while len(going):
            at[going] = at[going] + 1 & self.last
            found = self.keys[at[going]]
            hit = found == numbers[going]
            known[going[hit]] = True
            going = going[~hit & (found >= 0)]
        return at, known


class LocalModel:
    """A model in arrays: the n-grams of each order as numbers, found by hash, with their logprob and backoff."""

    def __init__(self, grams: list[str], logprob: np.ndarray, backoff: np.ndarray, order: int):
        split = [g.split(" ") for g in grams]
        self.tokens = {t: i for i, t in enumerate(sorted({t for g in split for t in g}), 1)}  # 0: any other
        self.order, self.bits = order, (len(self.tokens) + 1).bit_length()
        self.pad = len(self.tokens) + 1  # before the start of a text
        codes = {ord(t): i for t, i in self.tokens.items() if len(t) == 1 and t != " "}
        self.codes = np.zeros(max([*codes, ord("␠")]) + 1, np.int64)
        for c, i in codes.items():
            self.codes[c] = i
        self.codes[ord(" ")] = self.tokens.get("␠", 0)
        if self.exact:
            sizes = np.array([len(g) for g in split], np.int64)
            numbers = np.array([self.number(g) for g in split], np.int64)
            self.tables = [_Table(numbers[sizes == n], logprob[sizes == n], backoff[sizes == n]) for n in range(1, order + 1)]

    @property
    def exact(self) -> bool:
        return self.bits * self.order <= 62

    def number(self, gram: list[str]) -> int:
        out = 0
        for t in gram:
            out = out << self.bits | self.tokens.get(t, 0)
        return out

    def scores(self, texts: list[str], bos: bool, eos: bool) -> np.ndarray:
        """The longest known n-gram of every place, with the back-offs of the longer ones, summed by text."""
        return np.concatenate([np.zeros(0), *(self._scores(p, bos, eos) for p in _pieces(texts, 1 << 16))])

    def _scores(self, texts: list[str], bos: bool, eos: bool) -> np.ndarray:
        head, tail = ([self.tokens.get(t, 0)] * on for t, on in ((BOS, bos), (EOS, eos)))
        codes = _codes(texts)
        letters = np.where(codes < len(self.codes), self.codes[np.minimum(codes, len(self.codes) - 1)], 0)
        before = self.order - 1
        n = np.array([len(t) for t in texts], np.int64) + bos + eos
        first = np.cumsum(n + before) - n  # after the places before the text
        tokens = np.full(int(n.sum()) + before * len(n), -1, np.int64)
        for k in range(1, before + 1):
            tokens[first - k] = self.pad
        if bos:
            tokens[first] = head[0]
        if eos:
            tokens[first + n - 1] = tail[0]
        inner = tokens < 0
        tokens[inner] = letters
        places = np.ones(len(tokens), bool)
        for k in range(1, before + 1):
            places[first - k] = False
        window = tokens.copy()  # of each place: the token and those before it
        for k in range(1, self.order):
            window[k:] |= tokens[:-k] << self.bits * k
        return np.bincount(np.repeat(np.arange(len(texts)), n), self._values(window[places]), len(texts))

    def _values(self, windows: np.ndarray) -> np.ndarray:
        """Of windows: the longest known n-gram at the end, with the back-offs of the longer ones' contexts."""
        value, open_ = np.zeros(len(windows)), np.arange(len(windows))
        for n in range(self.order, 0, -1):
            table = self.tables[n - 1]
            at, known = table.find(windows[open_] & ((1 << self.bits * n) - 1))
            value[open_[known]] += table.logprob[at[known]]
            open_ = open_[~known]
            if n > 1:  # a context that begins before the text isn't in the table
                table = self.tables[n - 2]
                at, known = table.find(windows[open_] >> self.bits & ((1 << self.bits * (n - 1)) - 1))
                value[open_[known]] += table.backoff[at[known]]
        value[open_] += UNKNOWN
        return value


def local_model(model: DataFrame, order: int, most: int = MAX_LOCAL) -> LocalModel | None:
    """The model in arrays, to go to the tasks; none if it has more than `most` n-grams or too many characters."""
    rows = model.filter(F.col("n") <= order).select("ngram", "logprob", F.coalesce("backoff", F.lit(0.0)).alias("backoff")).limit(most + 1).toArrow()
    if len(rows) > most:
        return None
    local = LocalModel(rows["ngram"].to_pylist(), rows["logprob"].to_numpy(), rows["backoff"].to_numpy(), order)
    return local if local.exact else None


def with_column(df: DataFrame, name: str, kind: T.DataType, f) -> DataFrame:
    """df with a column from a function of its Arrow batches; not to be copied into filters above it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, f(batch)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, kind)]))


def score(df: DataFrame, model: DataFrame, order: int, key: list[str], text: str = "text", bos: bool = True, eos: bool = True, most: int = MAX_LOCAL) -> DataFrame:
    """key, score: log10 probability of each text.

    A model of at most `most` n-grams goes to the tasks, and texts stay where they are; beyond that, every
    different window is scored once by joins. A null text scores 0, like a missing model.
    """
    local = local_model(model, order, most)
    if local is None:
        return score_by_joins(df, model, order, key, text, bos, eos)

    def scored(batch: pa.RecordBatch) -> pa.Array:
        texts = batch.column(0)
        found = local.scores([x or "" for x in texts.to_pylist()], bos, eos)
        return pa.array(np.where(texts.is_null().to_numpy(zero_copy_only=False), 0.0, found))

    rows = df.select(F.col(text).alias("__text"), *key)
    return with_column(rows, "score", T.DoubleType(), scored).select(*key, "score")


def with_scores(df: DataFrame, local: LocalModel, candidates: str, name: str) -> DataFrame:
    """df with the log10 probabilities of the texts in an array of candidates, in its order."""

    def scored(batch: pa.RecordBatch) -> pa.Array:
        lists = batch.column(batch.schema.get_field_index(candidates))
        offsets = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())])
        found = local.scores([x or "" for x in pc.struct_field(lists.flatten(), "text").to_pylist()], True, True)
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found))

    return with_column(df, name, T.ArrayType(T.DoubleType()), scored)


def score_by_joins(df: DataFrame, model: DataFrame, order: int, key: list[str], text: str = "text", bos: bool = True, eos: bool = True) -> DataFrame:
    """score() for a model of any size: every window is scored once, however often it occurs."""
    places = windows(df.select(*key, text), order, text, bos, eos)
    known = score_windows(places.filter("window IS NOT NULL").select("window").distinct(), model, order)
    counted = places.groupBy(*key, "window").agg(F.count(F.lit(1)).alias("__k"))
    return counted.join(known, "window", "left").groupBy(*key).agg(F.coalesce(F.sum(F.col("__k") * F.col("logprob")), F.lit(0.0)).alias("score"))


def perplexity(log10_score: Column, text: Column) -> Column:
    """10^(-score / length); infinite for an empty text."""
    return F.when(F.length(text) == 0, F.lit(float("inf"))).otherwise(F.pow(F.lit(10.0), -log10_score / F.length(text)))


def corpus_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """One row: lines that aren't blank, white-space tokens, tokens a line."""
    t = script.strip(F.col(text))
    tokens = F.size(F.split(t, r"(?U)\s+"))
    return df.filter(t != "").agg(F.count(F.lit(1)).alias("lines"), F.sum(tokens).alias("tokens"), F.avg(tokens).alias("tokens_per_line"))


def oov_rate(df: DataFrame, vocabulary: DataFrame, text: str = "text") -> DataFrame:
    """One row: characters that aren't white space, those not in the vocabulary (ch), and their share."""
    c = df.select(F.explode(script.chars(F.col(text))).alias("ch")).filter(script.strip(F.col("ch")) != "").groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    known = vocabulary.select("ch", F.lit(True).alias("known"))
    out = c.join(known, "ch", "left").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("known").isNull(), F.col("n")).otherwise(0)).alias("oov"))
    return out.withColumn("rate", F.when(F.col("tokens") > 0, F.col("oov") / F.col("tokens")).otherwise(0.0))
