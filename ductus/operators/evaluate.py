"""Evaluation: error rates, positional matches, corrections, and bootstrap intervals."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.functions.draws import many_draws

METRICS = ("character_error_rate", "precision", "recall", "f1_score", "correcting_recall", "correcting_precision")


def edit_distance_of(a: str, b: str) -> int:
    """Levenshtein distance: a column of its table at a time, as the bits of two numbers."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    all_, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = all_, 0, len(a)  # where the next cell down is one more, one less
    for c in b:
        here = where.get(c, 0)
        flat = ((here & up) + up ^ up) | here | down
        right_up, right_down = down | all_ & ~(flat | up), up & flat
        if right_up & last:
            distance += 1
        elif right_down & last:
            distance -= 1
        right_up = right_up << 1 | 1
        right_down <<= 1
        up, down = right_down & all_ | all_ & ~(flat | right_up), right_up & flat & all_
    return distance


#: Pairs that are worked on at once: at least so many; bytes of their tables of letters, and numbers in a step.
_LEAST, _TABLES, _ELEMENTS = 24, 32 << 20, 1 << 15


def edit_distances(pairs: list[tuple[str, str]]) -> np.ndarray:
    """edit_distance_of() of many pairs: a column of all their tables at a time, as 64-bit numbers."""
    out = np.zeros(len(pairs), np.int64)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if a == b or not a or not b:
            out[i] = 0 if a == b else len(a) + len(b)
        else:
            todo.append((len(a), i))
    todo.sort()
    sizes = np.array([n for n, _ in todo], np.int64)
    low = 0
    while low < len(todo):
        # Up to a quarter more blocks than the first has; junk below a shorter text's last row doesn't reach up.
        words = -(-int(sizes[low]) // 64)
        high = int(np.searchsorted(sizes, 64 * (words + words // 4), "right"))
        which = [i for _, i in todo[low:high]]
        _distances([pairs[i] for i in which], np.array(which), out)
        low = high
    return out


def _matrix(texts: list[str], table: np.ndarray, width: int) -> np.ndarray:
    """Numbers of the letters, a text a row, zeros behind it."""
    n = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), width), np.int32)
    out[np.arange(width) < n[:, None]] = table[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")]
    return out


def _distances(pairs: list[tuple[str, str]], which: np.ndarray, out: np.ndarray) -> None:
    """Puts the distances of pairs of nonempty texts, the first ones of about one length, to their places in out."""
    codes = np.unique(np.frombuffer("".join(a for a, _ in pairs).encode("utf-32-le", "surrogatepass"), "<u4"))
    letters = len(codes) + 1  # 0: any other
    words = -(-max(len(a) for a, _ in pairs) // 64)
    most = min(_TABLES // (8 * letters * words), max(_LEAST, _ELEMENTS // words))
    if min(most, len(pairs)) < _LEAST:
        for i, p in zip(which, pairs):
            out[i] = edit_distance_of(*p)
        return
    table = np.zeros(0x110000, np.int32)
    table[codes] = np.arange(1, letters)
    order = sorted(range(len(pairs)), key=lambda i: -len(pairs[i][1]))
    for low in range(0, len(order), most):
        part = order[low : low + most]
        out[which[part]] = _columns([pairs[i][0] for i in part], [pairs[i][1] for i in part], table, letters, words)


def _columns(down: list[str], along: list[str], table: np.ndarray, letters: int, words: int) -> np.ndarray:
    """Distances of two lists of texts, the second by falling length: rows of a table are the bits of `words` numbers."""
    size, one, top = len(down), np.uint64(1), np.uint64(63)
    base = np.arange(size) * letters
    rows = _matrix(down, table, 64 * words).T
    where = np.zeros((words, size * letters), np.uint64)  # rows in which a letter stands
    for i in range(64 * words):
        where[i // 64][base + rows[i]] |= np.uint64(1 << i % 64)
    where[:, base] = 0
    n = np.array([len(t) for t in along])
    last = int(n[0])
    # All texts end in the last column. Before a text's first letter nothing comes in, and its numbers stay.
    steps = np.ascontiguousarray(_matrix(along, table, last)[:, ::-1].T)
    for i, k in enumerate(n.tolist()):
        steps[last - k :, i] = steps[last - k :, i][::-1]
    steps = steps + base
    started = size - np.searchsorted(n[::-1], last - np.arange(last), "left")
    where, block = where.ravel(), np.arange(words)[:, None] * (size * letters)
    up, down_ = np.full((words, size), ~np.uint64(0)), np.zeros((words, size), np.uint64)  # where the next row is one more, one less
    more, less = np.zeros((2, words + 1, size), np.uint64)  # what comes into a block from the one above
    buffers, places = np.empty((4, words, size), np.uint64), np.empty((words, size), np.int64)
    for step in range(last + words - 1):  # a block is a column behind the one above
        k = int(started[min(step, last - 1)])
        a, b = max(0, step - last + 1), min(words, step + 1)
        more[0, :k] = 1
        here, flat, x, y = (c[a:b, :k] for c in buffers)
        p, m, at, more_in, less_in = (c[a:b, :k] for c in (up, down_, places, more, less))
        np.add(steps[step - b + 1 : step - a + 1, :k][::-1], block[a:b], out=at)
        where.take(at, out=here, mode="clip")
        np.bitwise_or(here, m, out=flat)
        np.bitwise_or(here, less_in, out=here)
        np.bitwise_and(here, p, out=x)
        np.add(x, p, out=x)
        np.bitwise_xor(x, p, out=x)
        np.bitwise_or(x, here, out=x)
        np.bitwise_or(x, p, out=y)
        np.invert(y, out=y)
        np.bitwise_or(y, m, out=y)  # one more to the right
        np.bitwise_and(x, p, out=x)  # one less
        np.left_shift(y, one, out=here)
        np.bitwise_or(here, more_in, out=here)
        np.right_shift(y, top, out=more[a + 1 : b + 1, :k])
        np.left_shift(x, one, out=y)
        np.bitwise_or(y, less_in, out=y)
        np.right_shift(x, top, out=less[a + 1 : b + 1, :k])
        np.bitwise_or(flat, here, out=x)
        np.invert(x, out=x)
        np.bitwise_or(x, y, out=p)
        np.bitwise_and(here, flat, out=m)
    m = np.array([len(t) for t in down])
    rows = np.clip(m - 64 * np.arange(words)[:, None], 0, 64).astype(np.uint64)
    mask = np.where(rows == 64, ~np.uint64(0), (one << np.minimum(rows, top)) - one)
    return n + (np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down_ & mask)).sum(axis=0)


@F.arrow_udf(T.LongType())
def edit_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    null = np.array([x is None or y is None for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    pairs = [(x or "", y or "") for x, y in zip(a.to_pylist(), b.to_pylist())]
    return pa.array(edit_distances(pairs), pa.int64(), mask=null)


def character_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance over the reference's length; for an empty reference 0 or 1. It may exceed 1."""
    empty = F.when(F.length(hypothesis) == 0, 0.0).otherwise(1.0)
    return F.when(F.length(reference) == 0, empty).otherwise(edit_distance(reference, hypothesis) / F.length(reference))


def _codes(texts: list[str], sizes: np.ndarray) -> np.ndarray:
    """Code points of the texts and one more, each text with zeros up to its given length."""
    n = np.array([len(t) for t in texts], np.int64)
    kept = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) < np.repeat(n, sizes)
    out = np.zeros(len(kept), np.uint32)
    out[kept] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4") + 1
    return out


_STATISTICS = T.StructType([T.StructField(c, T.LongType()) for c in ("distance", "matches", "n_reference", "n_hypothesis", "e_total", "e_ident", "c_corr")])


@F.arrow_udf(_STATISTICS)
def _statistics(reference: pa.Array, hypothesis: pa.Array, source: pa.Array) -> pa.Array:
    """What a line adds to every metric; a null text makes null statistics of what it is part of."""
    r_null, h_null, s_null = (x.is_null().to_numpy(zero_copy_only=False) for x in (reference, hypothesis, source))
    texts = [[t or "" for t in x.to_pylist()] for x in (reference, hypothesis, source)]
    sizes = np.array([max(map(len, row)) for row in zip(*texts)], np.int64)
    r, h, s = (_codes(x, sizes) for x in texts)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    by_line = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends])
    differs, kept = s != r, h == r
    found = {
        "distance": (edit_distances(list(zip(texts[0], texts[1]))), r_null | h_null),
        "matches": (by_line(kept & (r > 0)), r_null | h_null),
        "n_reference": (np.array([len(t) for t in texts[0]], np.int64), r_null),
        "n_hypothesis": (np.array([len(t) for t in texts[1]], np.int64), h_null),
        "e_total": (by_line(differs), r_null | s_null),
        "e_ident": (by_line(s != h), h_null | s_null),
        "c_corr": (by_line(differs & kept), r_null | h_null | s_null),
    }
    return pa.StructArray.from_arrays([pa.array(found[c][0], pa.int64(), mask=found[c][1]) for c in _STATISTICS.names], _STATISTICS.names)


def line_statistics(df: DataFrame, reference: str = "target", hypothesis: str = "hypothesis", source: str | None = "source") -> DataFrame:
    """df with what a line adds to every metric: cer, matches, n_reference, n_hypothesis, e_total, e_ident, c_corr.

    Places are compared up to the longer text's length. Without a source there are no errors to correct.
    """
    r, h = F.col(reference).cast("string"), F.col(hypothesis).cast("string")
    # Not to be copied into filters above it, which would run it twice.
    found = df.withColumn("__s", _statistics.asNondeterministic()(r, h, r if source is None else F.col(source).cast("string")))
    empty = F.when(F.col("__s.n_hypothesis") == 0, 0.0).otherwise(1.0)
    rate = F.when(F.col("__s.n_reference") == 0, empty).otherwise(F.col("__s.distance") / F.col("__s.n_reference"))
    corrected = [F.lit(0).cast("long").alias(c) if source is None else F.col(f"__s.{c}") for c in ("e_total", "e_ident", "c_corr")]
    return found.select(*[F.col(c) for c in df.columns], rate.alias("cer"), *[F.col(f"__s.{c}") for c in ("matches", "n_reference", "n_hypothesis")], *corrected)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def _metrics(total: dict[str, Column]) -> dict[str, Column]:
    p, r = _ratio(total["matches"], total["n_hypothesis"]), _ratio(total["matches"], total["n_reference"])
    return {
        "character_error_rate": _ratio(total["cer"], total["n"]),
        "precision": p,
        "recall": r,
        "f1_score": _ratio(2 * p * r, p + r),
        "correcting_recall": _ratio(total["c_corr"], total["e_total"]),
        "correcting_precision": _ratio(total["c_corr"], total["e_ident"]),
    }


STATISTICS = ("cer", "matches", "n_reference", "n_hypothesis", "e_total", "e_ident", "c_corr")


def metrics(statistics: DataFrame, *by: str) -> DataFrame:
    """The six metrics and three counts of lines' statistics, over all or by groups. Null lines are left out."""
    kept = statistics.dropna(subset=list(STATISTICS))
    out = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in STATISTICS])
    found = _metrics({c: F.col(c) for c in ("n", *STATISTICS)})
    return out.select(*by, "n", *[x.alias(k) for k, x in found.items()], F.col("e_total").alias("total_errors"), F.col("c_corr").alias("correctly_corrected"), F.col("e_ident").alias("identified_errors"))


def replayed_draws(n: int, iterations: int = 1000, seed: int = 42) -> np.ndarray:
    """Indexes drawn with replacement, a row per iteration, from numpy's default generator."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.choice(n, size=n, replace=True) for _ in range(iterations)])


#: Chances of a Poisson(1) variable to be at most 0, 1, 2 ...
POISSON = np.cumsum([np.exp(-1.0) / np.prod(np.arange(1, k + 1)) for k in range(12)])


def _weights(seed: int, keys: list[str], iterations: int) -> np.ndarray:
    """Poisson(1) weights of keys, a column an iteration: how many of POISSON are at most the draw."""
    u = many_draws(seed, keys, np.full(len(keys), iterations)).reshape(len(keys), iterations)
    out = np.zeros(u.shape, np.uint8)
    for bound in np.ceil(POISSON * 4294967296.0).astype(np.int64).tolist():
        if bound < 1 << 32:
            out += u >= np.uint32(bound)
    return out


def _resampled(iterations: int, seed: int):
    """Sums of the statistics of a task's lines, weighted anew in every iteration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((iterations, 1 + len(STATISTICS)))
        for batch in batches:
            keys = batch.column(0).to_pylist()
            x = np.column_stack([np.ones(len(keys)), *(c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])])
            for low in range(0, len(keys), 1000):
                total += _weights(seed, keys[low : low + 1000], iterations).T.astype(float) @ x[low : low + 1000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(iterations)), *(pa.array(c) for c in total.T)], ["iteration", "n", *STATISTICS])

    return run


def bootstrap_intervals(statistics: DataFrame, key: str, iterations: int = 1000, level: float = 95.0, seed: int = 42) -> DataFrame:
    """metric, lower, upper: percentile intervals of the six metrics over resampled lines.

    Every line gets a Poisson(1) weight in every iteration, drawn from its key, so lines stay where they are: a
    task adds up all iterations of its lines, and one row per iteration and task is shuffled.
    """
    rows = statistics.dropna(subset=list(STATISTICS)).select(F.col(key).cast("string"), *STATISTICS)
    schema = "iteration long, n double, " + ", ".join(f"{c} double" for c in STATISTICS)
    total = rows.mapInArrow(_resampled(iterations, seed), schema).groupBy("iteration").agg(*[F.sum(c).alias(c) for c in ("n", *STATISTICS)])
    values = total.filter("n > 0").select(*[x.alias(k) for k, x in _metrics({c: F.col(c) for c in ("n", *STATISTICS)}).items()])
    return _intervals(values, level)


def _intervals(values: DataFrame, level: float) -> DataFrame:
    tail = (100 - level) / 200
    bounds = values.agg(*[F.percentile(m, F.array(F.lit(tail), F.lit(1 - tail))).alias(m) for m in METRICS])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)[0].alias("lower"), F.col(m)[1].alias("upper")) for m in METRICS]))
    return bounds.select(rows.alias("x")).select("x.*")


def replayed_intervals(statistics: DataFrame, order: list[str], iterations: int = 1000, level: float = 95.0, seed: int = 42, most: int = 100_000) -> DataFrame:
    """The intervals from numpy's own draws, for test sets of up to `most` lines, whose statistics go to the driver."""
    rows = statistics.dropna(subset=list(STATISTICS)).orderBy(*order).select(*STATISTICS).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} lines; use bootstrap_intervals")
    spark = statistics.sparkSession
    if not rows:
        return _intervals(spark.createDataFrame([], ", ".join(f"{m} double" for m in METRICS)), level)
    x = np.array([[float(v) for v in r] for r in rows])
    sums = np.stack([x[i].sum(axis=0) for i in replayed_draws(len(x), iterations, seed)])
    total = spark.createDataFrame([(float(len(x)), *map(float, s)) for s in sums], ", ".join(f"{c} double" for c in ("n", *STATISTICS)))
    return _intervals(total.select(*[v.alias(k) for k, v in _metrics({c: F.col(c) for c in ("n", *STATISTICS)}).items()]), level)


def half_widths(intervals: DataFrame) -> DataFrame:
    """metric, half_width in per cent."""
    return intervals.select("metric", ((F.col("upper") - F.col("lower")) * 100 / 2).alias("half_width"))
