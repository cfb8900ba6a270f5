"""Katz backoff language model of any order: Good-Turing discounted counts, exactly normalised backoff weights.

    P(w | C) = c*(C, w) / c(C)                 if the n-gram (C, w) was seen in training,
             = alpha(C) P(w | C without its first word)   if only the context C was,
             = P(w | C without its first word)            if not even C was,

evaluated recursively for every token down to P(w) = c*(w) / N, or what is left for the one unseen type. c* is the
Good-Turing count up to K and LARGE times the count above, so every context keeps something for its unseen words;
alpha(C) is what the seen words of C leave, over what they leave of the next lower order, and so the words'
probabilities add up to one in every context. A text starts after START words, which are contexts only.

Tables. The corpus is stored once as chunks of documents: a dictionary and the place of each token in it. Words are
numbered by the first exchange, frequent ones first, and from then on n-grams are exact tuples of numbers. The n-gram
table of an order is partitioned by context: a chunk sends each of its distinct n-grams whose context was seen once,
with its training count, to the context's bucket; the bucket adds up the counts and answers, in the order asked, with
every n-gram's count and, for contexts with words unseen after them, the sums that make alpha. Answers are stored; the
next order's contexts and counts come from them. So text crosses the network as distinct n-grams only, a word or
n-gram in a third of all rows is one entry a chunk, and discounts (from counts of counts, a few numbers a bucket) are
known before they are needed.

Hot contexts. A context with more than LIMIT training tokens is split by its next words over as many buckets as that
takes; the parts' sums, 2 MAX_HOT rows at most, are added up on the driver. Sizes follow from the counts of the order
below, so nothing but LIMIT has to be chosen: bucket entries / 4, or a MAX_HOT-th of all tokens in a corpus for which
that is more.

Sizes. There is a row for each chunk and bucket that have n-grams in common. Chunks and buckets grow with the square
root of the corpus, so a row keeps some 1,800 n-grams up to 3e9 tokens (11 GB of the check's tables). From there on
rows get smaller (650 n-grams at 30 GB), and tasks should be given larger chunks and buckets (`chunk_tokens`,
`bucket_tokens`, some 100 bytes of memory a token): with 20e6 tokens each, 2 GB a task, rows have 360 n-grams at 1e12
tokens and 14 at 100 TB.

Defined cases: a null text is an empty one, whose only token is the end; a row with a null id is training data;
repeated rows are counted and scored one by one; without training rows every probability is one (score 0); an
empty table gives an empty table; other columns of the input are not looked at. A document is one chunk at least,
so a task needs some 100 bytes a token of the longest one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import batched

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import dealt_evenly, discard, release, stored, text_or_empty

K = 5
LARGE = 0.999
#: Tokens of a chunk, and of the corpus for each bucket of an n-gram table, at least and at most: some 100 bytes each.
CHUNK_TOKENS, BUCKET_TOKENS = (600_000, 2_400_000), (1_000_000, 2_400_000)
#: Between these, both grow with the square root of the corpus, so that a chunk has so many n-grams for a bucket.
BLOB_TOKENS = 2_000
#: Tokens of the corpus for each task: some chunks, some buckets.
TASK_TOKENS = 4_800_000
MAX_HOT = 100_000

hash64 = xxhash.xxh3_64_intdigest
#: No word has a space.
END = hash64(b" </s>")
#: Numbers of the start, and of all words that training doesn't have.
START, UNKNOWN = 0, 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes: whole numbers as byte planes, of their differences where they only grow."""
    small = []
    for a in arrays:
        if a.dtype.kind == "f":
            small.append(a)
            continue
        a = a.astype(np.uint64)
        grows = len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        if grows:
            a = np.diff(a, prepend=np.uint64(0))
        wide = max(1, -(-int(a.max()).bit_length() // 8)) if len(a) else 1
        small.append((grows, np.ascontiguousarray(a.view(np.uint8).reshape(-1, 8)[:, :wide].T)))
    return zstandard.compress(pickle.dumps(small, 5), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    out = []
    for a in pickle.loads(zstandard.decompress(data)):
        if isinstance(a, tuple):
            grows, planes = a
            whole = np.zeros((planes.shape[1], 8), np.uint8)
            whole[:, : len(planes)] = planes.T
            a = whole.view(np.int64).ravel()
            a = np.cumsum(a) if grows else a
        out.append(a)
    return out


def discounts(of: list[int]) -> np.ndarray:
    """c* / c for counts 0 to K + 1 (the last: all above K) by Good-Turing, from the numbers of types with count 1 to K + 1.

    Where the counts of counts don't give a discount between 0 and 1, it is (c - 1/2) / c.
    """
    out = np.array([0.0, *((r - 0.5) / r for r in range(1, K + 1)), LARGE])
    common = (K + 1) * of[K] / of[0] if of[0] else 1.0
    for r in range(1, K + 1):
        if common < 1 and of[r - 1]:
            d = ((r + 1) * of[r] / (r * of[r - 1]) - common) / (1 - common)
            if 0 < d < 1:
                out[r] = d
    return out


def hashes(columns: list[np.ndarray]) -> np.ndarray:
    """64 bits of tuples of numbers."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
    return h


def ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys (not negative) in order, a place of each, and which one each key is.

    Keys are sorted with their places in the lower bits where both fit a number, which is faster than by index.
    """
    bits = max(1, (len(keys) - 1).bit_length())
    if not len(keys) or int(keys.max()) >> (63 - bits):
        return np.unique(keys, return_index=True, return_inverse=True)
    both = np.sort(keys << bits | np.arange(len(keys)))
    at = both & ((1 << bits) - 1)
    both >>= bits
    new = np.append(True, both[1:] != both[:-1])
    which = np.empty(len(keys), np.int64)
    which[at] = np.cumsum(new) - 1
    return both[new], at[new], which


def dense(columns: list[np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Of tuples of numbers: how many different ones, a row of each, in order, and which one each row is."""
    at = np.zeros(len(columns[0]), np.int64)
    first = np.zeros(min(1, len(at)), np.int64)
    for c in columns:
        span = int(c.max()) + 1 if len(c) else 1
        _, first, at = ranked(at * span + c)
    return len(first), first, at


@dataclass
class Hot:
    """Sums of the hot contexts of an order."""

    contexts: list[np.ndarray]  # by word place, in order of their hashes
    names: np.ndarray
    sums: np.ndarray

    def of(self, columns: list[np.ndarray]) -> np.ndarray:
        return self.sums[np.searchsorted(self.names, hashes(columns))]


@dataclass
class Model:
    """What of the model has a bound."""

    tokens: int
    types: int
    documents: int
    buckets: int
    limit: int
    unseen: float  # probability of the unseen type
    rates: list[np.ndarray] = field(default_factory=list)  # discounts by order
    hot: dict[int, Hot] = field(default_factory=dict)

    def parts(self, counts: np.ndarray) -> np.ndarray:
        """Over how many buckets a context of that count is spread."""
        return -(-counts // self.limit)


@dataclass
class Chunk:
    """Some documents: of each id, held out, tokens; the dictionary, and the places of all tokens in it."""

    ids: list
    held: np.ndarray
    sizes: np.ndarray
    names: np.ndarray  # hashes, later numbers; then START is the first
    counts: np.ndarray  # of the names in training, once known
    at: np.ndarray

    def packed(self) -> bytes:
        return pickle.dumps((self.ids, self.held, pack(self.sizes, self.names.view(np.int64), self.counts, self.at)), 5)

    @staticmethod
    def unpacked(data: bytes) -> Chunk:
        ids, held, rest = pickle.loads(data)
        return Chunk(ids, held, *unpack(rest))

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.sizes)

    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _chunks(limit: int):
    """Chunks of documents (id, text, held out): rows chunk, data, tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        made, ids, held, words, n = TaskContext.get().partitionId() << 24, [], [], [], 0

        def chunk() -> pa.RecordBatch:
            names, at, counts = np.unique(np.concatenate(words), return_inverse=True, return_counts=True)
            by_count = np.argsort(-counts, kind="stable")  # frequent words get small places
            rank = np.empty_like(by_count)
            rank[by_count] = np.arange(len(names))
            sizes = np.array([len(x) for x in words])
            c = Chunk(ids, np.array(held, bool), sizes, names[by_count], np.zeros(0, np.int64), rank[at])
            return pa.RecordBatch.from_arrays([pa.array([made], pa.int64()), pa.array([c.packed()], pa.binary()), pa.array([n], pa.int64())], ["chunk", "data", "tokens"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i, text, out in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist()):
                found = text.as_py().lower().split()
                tokens = np.empty(len(found) + 1, np.uint64)
                tokens[:-1] = np.fromiter(map(hash64, found), np.uint64, len(found))
                tokens[-1] = END
                ids.append(i)
                held.append(out)
                words.append(tokens)
                n += len(tokens)
                if n >= limit:
                    yield chunk()
                    made, ids, held, words, n = made + 1, [], [], [], 0
        if words:
            yield chunk()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of the batches, large values one batch at a time."""
    for batch in batches:
        for i in range(len(batch)):
            yield tuple(c[i].as_py() for c in batch.columns)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Consecutive rows of equal first column."""
    key, rows = None, []
    for row in _rows(batches):
        if row[0] != key:
            if rows:
                yield key, rows
            key, rows = row[0], []
        rows.append(row)
    if rows:
        yield key, rows


ASKED = "bucket long, chunk long, data binary"
#: kind: the order whose n-grams are answered (data), 0 for numbers of the whole bucket (stat), -1 for a hot context.
ANSWERED = "kind int, bucket long, chunk long, data binary, context array<long>, stat array<long>, mass double"


def _dealt(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in order."""
    order = np.argsort(bucket.astype(np.uint16) if len(bucket) and bucket.max() < 65_536 else bucket, kind="stable")
    edges = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(order) else []
    for a, b in zip(edges, [*edges[1:], len(order)]):
        yield int(bucket[order[a]]), order[a:b]


def _asked(found: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for rows in batched(found, 16):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary()))], ["bucket", "chunk", "data"])


def _answered(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    types = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]
    names = ["kind", "bucket", "chunk", "data", "context", "stat", "mass"]
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 64]), types)], names)


def _ask_words(buckets: int):
    """Every word of a chunk goes to the bucket of its hash, in the order of hashes, with its training count."""

    def entries(c: Chunk, chunk: int) -> Iterator[tuple[int, int, bytes]]:
        counts = np.bincount(c.at[c.training()], minlength=len(c.names))
        by_name = np.argsort(c.names.view(np.uint64))
        for b, at in _dealt((c.names.view(np.uint64)[by_name] % np.uint64(buckets)).astype(np.int64)):
            at = by_name[at]
            yield b, chunk, pack(c.names[at].view(np.uint64), counts[at])

    return lambda batches: _asked(x for chunk, data in _rows(batches) for x in entries(Chunk.unpacked(data), chunk))


def _answer_words(buckets: int):
    """Numbers and counts of the words of a bucket; stat: tokens, types, documents, types with count 1 to K + 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            parts = [unpack(r[2]) for r in rows]
            names, at = np.unique(np.concatenate([p[0] for p in parts]).view(np.uint64), return_inverse=True)
            counts = np.bincount(at, np.concatenate([p[1] for p in parts]), len(names)).astype(np.int64)
            rank = np.empty(len(names), np.int64)
            rank[np.lexsort((names, -counts))] = np.arange(len(names))
            number = np.where(counts > 0, 2 + rank * buckets + bucket, UNKNOWN)
            edges = np.cumsum([0, *(len(p[0]) for p in parts)])
            stat = [counts.sum(), (counts > 0).sum(), counts[names == np.uint64(END)].sum(), *np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2]]
            out = [(0, bucket, 0, None, None, [int(x) for x in stat], None)]
            for r, a, b in zip(rows, edges, edges[1:]):
                out.append((1, bucket, r[1], pack(number[at[a:b]], counts[at[a:b]]), None, None, None))
            yield from _answered(out)

    return run


def _numbered(buckets: int, documents: int):
    """The chunks with numbers for words and their counts; rows chunk, bucket (-1: the chunk itself), data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, rows in _groups(batches):
            c = Chunk.unpacked(next(r[2] for r in rows if r[1] < 0))
            by_name = np.argsort(c.names.view(np.uint64))
            order = np.concatenate([by_name[at] for _, at in _dealt((c.names.view(np.uint64)[by_name] % np.uint64(buckets)).astype(np.int64))])
            answers = [unpack(r[2]) for r in rows if r[1] >= 0]
            number, count = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
            number[order] = np.concatenate([a[0] for a in answers])
            count[order] = np.concatenate([a[1] for a in answers])
            names, first, place = np.unique(number, return_index=True, return_inverse=True)
            c.names, c.counts, c.at = np.append(START, names), np.append(documents, count[first]), place[c.at] + 1
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([c.packed()], pa.binary())], ["chunk", "data"])

    return run


class Walk:
    """The tokens of a chunk, order by order: `up` goes to the n-grams of the next one, `take` takes their counts."""

    def __init__(self, model: Model, c: Chunk):
        self.model, self.c, self.order = model, c, 1
        self.held, self.starts = c.held, c.starts()
        self.grams, self.columns, self.seen = c.at, [c.names], c.counts  # which n-gram each token ends, their words, their counts
        self.special = START  # the context of a text's first token
        self.token_counts = c.counts[c.at]
        self.token_contexts = np.zeros(0, np.int64)
        p = model.rates[0][np.minimum(self.token_counts, K + 1)] * self.token_counts / max(model.tokens, 1)
        self.log = np.log10(np.where(self.token_counts > 0, p, model.unseen))

    def up(self) -> None:
        c, v = self.c, len(self.c.names)
        context = np.empty_like(self.grams)
        context[1:] = self.grams[:-1]
        context[self.starts] = self.special
        self.context_columns, self.context_counts = self.columns, self.seen
        context = context.astype(np.int64)
        keys, _, which = ranked(context * v + c.at)
        self.grams = which.astype(np.int32)
        self.of, self.word = keys // v, keys % v
        n = len(keys)
        self.lower, self.lower_context = np.empty(n, np.int64), np.zeros(len(self.seen), np.int64)
        self.lower[self.grams] = self.token_counts
        if self.order > 1:
            self.lower_context[context] = self.token_contexts
        self.token_contexts = self.seen[context]
        # A text's first token has a context of its own at every order.
        self.columns = [np.append(x[self.of], START) for x in self.context_columns] + [np.append(c.names[self.word], START)]
        self.special = n
        self.order += 1
        counts = self.context_counts[self.of]
        self.sent = np.flatnonzero(counts > 0)
        of, parts = self.of[self.sent], self.model.parts(counts[self.sent])
        part = np.where(parts > 1, hashes([c.names[self.word[self.sent]]]) % np.maximum(parts, 1).astype(np.uint64), np.uint64(0))
        bucket = hashes([hashes(self.context_columns)[of], part]) % np.uint64(self.model.buckets)
        self.dealt = [(b, self.sent[at]) for b, at in _dealt(bucket.astype(np.int64))]

    def entries(self) -> Iterator[tuple[int, bytes]]:
        """What each bucket gets: its contexts (words, hot, count at the order below, entries), words, counts, counts below."""
        counts = np.bincount(self.grams[self.c.training()], minlength=len(self.of))
        for b, at in self.dealt:
            of = self.of[at]
            first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            contexts = of[first]
            hot = self.model.parts(self.context_counts[contexts]) > 1
            yield b, pack(*(x[contexts] for x in self.context_columns), hot, self.lower_context[contexts], np.diff(np.append(first, len(at))), self.c.names[self.word[at]], counts[at], self.lower[at])

    def take(self, answers: list[bytes]) -> None:
        """Counts of the n-grams, and the tokens' probabilities at this order."""
        n, model = len(self.of), self.model
        counts = np.zeros(n, np.int64)
        sums = np.zeros((len(self.context_counts), K + 2))
        for (_, at), data in zip(self.dealt, answers, strict=True):
            found, *columns = unpack(data)
            counts[at] = found
            if (found == 0).any():
                hot = model.parts(self.context_counts[self.of[at]]) > 1
                open_ = np.unique(self.of[at[(found == 0) & ~hot]])
                sums[open_] = np.stack(columns, axis=1)
                open_ = np.unique(self.of[at[(found == 0) & hot]])
                if len(open_):
                    sums[open_] = model.hot[self.order].of([x[open_] for x in self.context_columns])
        rate = model.rates[self.order - 1]
        in_context = self.context_counts[self.of]
        seen, unseen = counts > 0, (counts == 0) & (in_context > 0)
        log = np.zeros(n)  # of c* / c(C), or of alpha
        log[seen] = np.log10(rate[np.minimum(counts[seen], K + 1)] * counts[seen] / in_context[seen])
        if unseen.any():
            s = sums[self.of[unseen]]
            left = s[:, : K + 1] @ (np.append(np.arange(1, K + 1), 1) * (1 - rate[1:]))
            log[unseen] = np.log10(left / in_context[unseen] / (1 - s[:, K + 1]))
        self.log = np.where(counts[self.grams] > 0, log[self.grams], self.log + log[self.grams])
        self.token_counts = counts[self.grams]
        self.seen = np.append(counts, model.documents)


def _walked(model: Model, order: int, rows: list[tuple]) -> Walk:
    """The walk to an order with all its answers; rows: chunk, kind (0: the chunk), bucket, data."""
    walk = Walk(model, Chunk.unpacked(next(r[3] for r in rows if r[1] == 0)))
    for n in range(2, order + 1):
        walk.up()
        walk.take([r[3] for r in rows if r[1] == n])
    return walk


def _ask(model: Model, order: int):
    def entries(rows: list[tuple]) -> Iterator[tuple[int, int, bytes]]:
        walk = _walked(model, order - 1, rows)
        walk.up()
        for b, data in walk.entries():
            yield b, rows[0][0], data

    return lambda batches: _asked(x for _, rows in _groups(batches) for x in entries(rows))


def _answer(model: Model, order: int):
    """Counts of the n-grams of a bucket in the order asked, sums of contexts with unseen words, stat: types with count 1 to K + 1."""
    below, n_words = model.rates[order - 2], order - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _groups(batches):
            parts = [unpack(r[2]) for r in rows]
            column = lambda k: np.concatenate([p[k] for p in parts])
            words = [column(k) for k in range(n_words)]
            n_contexts, some, context = dense(words)
            hot = column(n_words)[some] > 0
            lower_context = column(n_words + 1)[some] if order > 2 else np.full(n_contexts, max(model.tokens, 1))
            words = [x[some] for x in words]
            sizes = column(n_words + 2)
            of = np.repeat(context, sizes)
            n, some, gram = dense([of, column(n_words + 3)])
            counts = np.bincount(gram, column(n_words + 4), n).astype(np.int64)
            lower = column(n_words + 5)[some]
            of_gram = of[some]
            by_count = [np.bincount(of_gram[counts == r], minlength=n_contexts) for r in range(1, K + 1)]
            large = np.bincount(of_gram, np.where(counts > K, counts, 0), n_contexts).astype(np.int64)
            p = np.where(counts > 0, below[np.minimum(lower, K + 1)] * lower / np.maximum(lower_context[of_gram], 1), 0.0)
            mass = np.bincount(of_gram, p, n_contexts)
            out = [(0, bucket, 0, None, None, np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist(), None)]
            for k in np.flatnonzero(hot).tolist():
                out.append((-1, bucket, 0, None, [int(x[k]) for x in words], [*(int(x[k]) for x in by_count), int(large[k])], float(mass[k])))
            edges = np.cumsum([0, *(len(p[n_words + 3]) for p in parts)])
            for r, a, b in zip(rows, edges, edges[1:]):
                found, its = counts[gram[a:b]], of[a:b]
                open_ = its[(found == 0) & ~hot[its]]
                # In the order the chunk has them: as they first come.
                open_ = open_[np.flatnonzero(np.append(True, open_[1:] != open_[:-1]))] if len(open_) else open_
                out.append((order, bucket, r[1], pack(found, *(x[open_] for x in by_count), large[open_], mass[open_]), None, None, None))
            yield from _answered(out)

    return run


def _scored(model: Model, order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):
            walk = _walked(model, order, rows)
            c, starts = walk.c, walk.starts
            words = c.counts[c.at]
            base = np.log10((words + 1) / (model.tokens + model.types + 1))
            n = len(c.sizes)
            add = lambda x: np.add.reduceat(x, starts)
            score = add(walk.log) if model.tokens else np.zeros(n)
            columns = [pa.array(c.ids, pa.int64()), c.held, c.sizes, add((words > 0).astype(np.int64)), np.full(n, model.tokens), add(base), score]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _exchange(asked: DataFrame, tasks: int, answer) -> DataFrame:
    out = stored(dealt_evenly(asked, "bucket", tasks).sortWithinPartitions("bucket", "chunk").mapInArrow(answer, ANSWERED).coalesce(tasks))
    del asked
    release(out.sparkSession)
    return out


def _stats(answers: DataFrame, n: int) -> list[int]:
    row = answers.filter("kind = 0").agg(*[F.sum(F.col("stat")[i]) for i in range(n)]).first()
    return [int(x or 0) for x in row]


def _hot(answers: DataFrame, order: int) -> Hot:
    """The parts of hot contexts added up: at most 2 MAX_HOT rows, since each has a LIMIT-th of the tokens or half."""
    total: dict[tuple, list] = {}
    for r in sorted(answers.filter("kind = -1").select("context", "bucket", "stat", "mass").collect()):
        sums = total.setdefault(tuple(r.context), [0.0] * (K + 2))
        for k, x in enumerate([*r.stat, r.mass]):
            sums[k] += x
    contexts = [np.array(x, np.int64) for x in zip(*total)] or [np.zeros(0, np.int64)] * (order - 1)
    names = hashes(contexts)
    by_name = np.argsort(names)
    return Hot([x[by_name] for x in contexts], names[by_name], np.array(list(total.values())).reshape(-1, K + 2)[by_name])


def score_corpus(df: DataFrame, held_out: Column, order: int = 3, id_col: str = "doc_id", text_col: str = "text", chunk_tokens: int | None = None, bucket_tokens: int | None = None, limit: int | None = None) -> DataFrame:
    """Learns from the rows where held_out isn't true and scores all.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (Katz, log10).
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    about = (rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / 6  # tokens
    grown = int((BLOB_TOKENS * about) ** 0.5)
    chunk_tokens = chunk_tokens or min(max(grown, CHUNK_TOKENS[0]), CHUNK_TOKENS[1])
    bucket_tokens = bucket_tokens or min(max(grown, BUCKET_TOKENS[0]), BUCKET_TOKENS[1])
    chunks = stored(rows.mapInArrow(_chunks(chunk_tokens), "chunk long, data binary, tokens long"))
    size = chunks.agg(F.sum("tokens")).first()[0] or 0
    buckets = max(4, -(-size // bucket_tokens))
    tasks = max(4, -(-size // TASK_TOKENS))
    by_chunk = lambda out, *sort: out.repartition(tasks, "chunk").sortWithinPartitions("chunk", *sort)

    few = max(1, buckets // 4)
    answers = _exchange(chunks.select("chunk", "data").mapInArrow(_ask_words(few), ASKED), tasks, _answer_words(few))
    tokens, types, documents, *of = _stats(answers, K + 4)
    rate = discounts(of)
    small = sum(r * of[r - 1] for r in range(1, K + 1))
    unseen = 1.0 - (sum(rate[r] * r * of[r - 1] for r in range(1, K + 1)) + rate[K + 1] * (tokens - small)) / tokens if tokens else 1.0
    model = Model(tokens, types, documents, buckets, limit or max(bucket_tokens // 4, -(-tokens // MAX_HOT)), unseen, [rate])
    both = chunks.select("chunk", F.lit(-1).cast("long").alias("bucket"), "data").union(answers.filter("kind = 1").select("chunk", "bucket", "data"))
    numbered = stored(by_chunk(both, "bucket").mapInArrow(_numbered(few, documents), "chunk long, data binary").coalesce(tasks))
    discard(chunks, answers)
    known = numbered.select("chunk", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("bucket"), "data")
    for n in range(2, order + 1):
        asked = by_chunk(known, "kind", "bucket") if n > 2 else known
        answers = _exchange(asked.mapInArrow(_ask(model, n), ASKED), tasks, _answer(model, n))
        model.rates.append(discounts(_stats(answers, K + 1)))
        model.hot[n] = _hot(answers, n)
        known = known.union(answers.filter(F.col("kind") == n).select("chunk", "kind", "bucket", "data"))
    scores = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return by_chunk(known, "kind", "bucket").mapInArrow(_scored(model, order), scores).coalesce(tasks)


def op4_katz_backoff(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_corpus(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
