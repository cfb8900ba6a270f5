"""SimHash near-duplicates by anchor-point covering.

Fingerprints are compared only at anchors: the codewords of a covering code, a product of perfect binary
codes over blocks of the 64 bits, so that every point has exactly one anchor within each block's radius (its
home). For two fingerprints that differ in at most t bits there is a point at most ceil(t / 2) bits from
either; so if each is replicated to every anchor within the covering radius plus ceil(t / 2), taken block by
block, they meet at the home of that point. With t = 2 that is the radius plus one on both sides, about 11
copies of a fingerprint, where the radius plus two on one side would need 71.

Equal fingerprints count once. An anchor's members are compared in one task up to MAX_MEMBERS; those of
a fuller anchor go to the anchors of the identity code (radius 0), at which at most 65 different
fingerprints can meet, so no group is unbounded and no link is lost. A group gives a spanning forest, not
all pairs. Components come from alternating large-star and small-star steps on stored tables.

Similar documents. 64 majority bits of all shingles of two texts with a similarity of 0.8 differ in about ten places,
too many to cover. `similar` therefore takes TABLES fingerprints of a document, each the majority bits of the LEAST
shingles that come first in that table's order of hashes: two texts of Jaccard similarity s have about s^LEAST of them
in common. Fingerprints meet at anchors as above; of each group the others are compared with its first document by
their whole shingle sets, and only pairs that are as similar as asked for are links. Groups are dealt in parts.

That finds most links by chance; what it leaves is found with certainty. Two sets of Jaccard similarity s have a shingle
in common among the first n - ceil(s n) + 1 of each in any order of all shingles, so documents that no links connect so
far meet at those, first in the order of the hashes. Shingles at which over MAX_MEMBERS documents meet go to the end of
the order, and the documents that have them meet again; where they still are too many, all of them are compared in parts.
Lengths, places and the parities of the shingles' numbers in as many classes as there are shingles rule out pairs that can't be similar; the
others are compared by their whole sets. So no two documents with the similarity stay apart.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; null ids are kept,
and a component of null ids only has a null component_id; repeated rows give repeated rows (but `one_of_each` keeps
one); an empty table gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import by_bytes, stored, text_or_empty

BITS = 64
MAX_MEMBERS = 256
#: Perfect codes by block length; radius 3 for the binary Golay code of length 23, radius 1 for Hamming
#: codes (7, 15), (n - 1) / 2 for repetition codes (odd n up to 9). Each list adds up to 64 bits.
CODES = {
    "golay": (23, 23, 9, 9),  # 2^26 anchors
    "mixed": (23, 15, 15, 7, 3, 1),  # 2^39
    "hamming": (15, 15, 15, 15, 3, 1),  # 2^46
    "identity": (1,) * 64,
}
#: Fixed value: generator polynomial of the binary Golay code, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
#: Of `similar`: fingerprints of a document, shingles of each, members that meet a group's first document in a task.
TABLES, LEAST, PART = 5, 3, 512
#: Times that frequent shingles go to the end of the order, and how many at once; beyond them documents are compared in parts.
ROUNDS, FREQUENT = 3, 1_000_000
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """Majority bits over the XXH64 of all shingles of the lower-cased words (A-Z only); 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    hashes = np.array([h(joined[a:b], seed) for a, b in zip(starts[: 1 - shingle].tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        fps = np.fromiter((fingerprint(x.as_py()) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64)), batch.column(2)], ["doc_id", "fp", "text_hash"])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash, which tells rows of one id apart."""
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    return rows.mapInArrow(_fingerprints, "doc_id long, fp long, text_hash long")


@cache
def _block(n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Of a perfect code of length n: tables of the syndromes of 12 bits each, and every syndrome's error."""
    if n == 23:
        radius, columns, x = 3, [], 1
        for _ in range(n):
            columns.append(x)
            x <<= 1
            x ^= GOLAY if x >> 11 else 0
    elif n in (7, 15):
        radius, columns = 1, list(range(1, n + 1))
    else:
        radius, columns = (n - 1) // 2, [(1 << (n - 1)) - 1, *(1 << i for i in range(n - 1))]
    errors = {}
    for weight in range(radius + 1):
        for bits in combinations(range(n), weight):
            syndrome = 0
            for i in bits:
                syndrome ^= columns[i]
            errors[syndrome] = sum(1 << i for i in bits)
    tables = []
    for low in range(0, n, 12):
        table = np.zeros(1, np.int64)
        for c in columns[low : low + 12]:
            table = np.concatenate([table, table ^ c])
        tables.append(table)
    return tables, np.array([errors[s] for s in range(len(errors))], np.uint64)


def homes(points: np.ndarray, code: tuple[int, ...]) -> np.ndarray:
    """The anchor that covers each point."""
    out, at = points.copy(), 0
    for n in code:
        if n > 1:
            tables, errors = _block(n)
            block = (points >> np.uint64(at)) & np.uint64((1 << n) - 1)
            syndrome = np.zeros(points.shape, np.int64)
            for k, table in enumerate(tables):
                syndrome ^= table[((block >> np.uint64(12 * k)) & np.uint64(len(table) - 1)).astype(np.int64)]
            out ^= errors[syndrome] << np.uint64(at)
        at += n
    return out


def anchors(points: np.ndarray, code: tuple[int, ...], threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, point): each point with every anchor within the radius plus ceil(threshold / 2)."""
    far = -(-threshold // 2)
    moves = np.array([sum(1 << i for i in bits) for w in range(far + 1) for bits in combinations(range(BITS), w)], np.uint64)
    found = np.sort(homes(points[:, None] ^ moves[None, :], code), axis=1)
    new = np.ones(found.shape, bool)
    new[:, 1:] = found[:, 1:] != found[:, :-1]
    return found[new], np.repeat(points, new.sum(axis=1))


def _replicate(code: tuple[int, ...], threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy().view(np.uint64)
            for i in range(0, len(points), 2000):
                a, p = anchors(points[i : i + 2000], code, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(p.view(np.int64))], ["anchor", "fp"])

    return run


def _links(members: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """(member, first member of its component) within one anchor, for members linked to another."""
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= threshold
    label = np.arange(len(members))
    while True:
        new = np.where(near, label[None, :], len(members)).min(axis=1)
        if (new == label).all():
            break
        label = new
    return [(int(members[i]), int(members[k])) for i, k in enumerate(label) if i != k]


def _compare(threshold: int):
    """Links of the anchors of one sorted partition; members of fuller anchors come out as (fp, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2), np.int64)
        full = None  # the anchor that has too many members

        def links(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal full
            a, p = rows[:, 0], np.ascontiguousarray(rows[:, 1]).view(np.uint64)
            starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(a)])
            left, right, over = [], [], []
            pairs = starts[sizes == 2]
            pairs = pairs[np.bitwise_count(p[pairs] ^ p[pairs + 1]) <= threshold]
            left.append(p[pairs + 1])
            right.append(p[pairs])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                if n > MAX_MEMBERS or a[s] == full:
                    over.append(p[s : s + n])
                elif found := _links(p[s : s + n], threshold):
                    x, y = zip(*found)
                    left.append(np.array(x, np.uint64))
                    right.append(np.array(y, np.uint64))
            over += [p[s : s + n] for s, n in zip(starts.tolist(), sizes.tolist()) if n <= 2 and a[s] == full]
            x = np.concatenate([*left, *over]).view(np.int64)
            y = np.concatenate(right).view(np.int64)
            mask = np.arange(len(x)) >= len(y)
            return pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.r_[y, np.zeros(len(x) - len(y), np.int64)], mask=mask)], ["a", "b"])

        for batch in batches:
            rows = np.concatenate([held, np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)])
            if not len(rows):
                continue
            tail = int((rows[:, 0] == rows[-1, 0]).sum())
            done, held = rows[: len(rows) - tail], rows[len(rows) - tail :]
            if len(done):
                yield links(done)
            if len(held) > MAX_MEMBERS:
                full = held[0, 0]
                yield links(held)
                held = held[:0]
        if len(held):
            yield links(held)

    return run


def links(points: DataFrame, threshold: int = 2, code: str = "golay") -> DataFrame:
    """Edges (a, b) that connect every two fingerprints within the threshold.

    points: a stored table of distinct fingerprints fp.
    """
    n = 5 * points.count()

    def meet(points: DataFrame, code: str) -> DataFrame:
        copies = points.mapInArrow(_replicate(CODES[code], threshold), "anchor long, fp long")
        dealt = copies.repartition("anchor").sortWithinPartitions("anchor", "fp")
        return stored(dealt.mapInArrow(_compare(threshold), "a long, b long"), n)

    coarse = meet(points, code)
    crowded = coarse.filter("b IS NULL").select(F.col("a").alias("fp")).distinct()
    fine = meet(crowded, "identity")
    return coarse.filter("b IS NOT NULL").union(fine.filter("b IS NOT NULL")).distinct()


def components(edges: DataFrame, steps: int = 60, rows: int | None = None) -> DataFrame:
    """node, root: the smallest node of each connected component, for all nodes of the edges (a, b).

    rows: about how many edges there are at most.
    Large-star links a node's larger neighbours to its least neighbour, small-star its smaller ones; the
    number of edges never grows, and both together end in stars after a logarithmic number of rounds.
    """
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), rows)
    rows, state = edges.count(), None
    for _ in range(steps):
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small, "u")
        edges = stored(joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", "m")).distinct(), rows)
        new = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            break
        state = new
    else:
        raise RuntimeError(f"components did not settle in {steps} steps")
    stars = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return stars.union(stars.select("root", "root")).distinct()


def _code(n: int) -> str:
    """The code with about one other member an anchor at most, of n fingerprints."""
    return "golay" if n < 1e7 else "mixed" if n < 1e10 else "hamming"


def _classes(df: DataFrame, id_col: str, text_col: str, threshold: int, code: str | None) -> tuple[DataFrame, DataFrame]:
    """The stored fingerprints of all rows, and fp with the root of its component."""
    docs = stored(fingerprints(df, id_col, text_col))
    points = stored(docs.select("fp").distinct(), docs.count())
    n = points.count()
    roots = components(links(points, threshold, code or _code(n)), rows=n)
    return docs, stored(points.join(roots, points.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), n)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 2, code: str | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: a row per document. code None: by the number of fingerprints."""
    docs, roots = _classes(df, id_col, text_col, threshold, code)
    least = docs.groupBy("fp").agg(F.min("doc_id").alias("least")).join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    named = roots.join(least, "root").select("fp", "component_id")
    return docs.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K2
    return x ^ (x >> np.uint64(29))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Hashes of the different shingles of the lower-cased words (A-Z only), in order; of fewer words their whole sequence."""
    words = text.lower().split()
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(w))
    if not size:
        return w
    n = len(w) - size + 1
    h = _mix(w[:n])
    for k in range(1, size):
        h = _mix(h * _K1 + w[k : n + k])
    return np.unique(h)


def least_fingerprints(h: np.ndarray, tables: int = TABLES, least: int = LEAST) -> list[int]:
    """Majority bits of the least shingles in each table's order; 0 without shingles."""
    if not len(h):
        return [0] * tables
    out = []
    for k in range(1, tables + 1):
        x = _mix(h ^ _mix(np.array([k], np.uint64) * _K1))
        x = x if len(x) <= least else np.partition(x, least - 1)[:least]
        ones = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(x), bitorder="little").view(np.int64)[0]))
    return out


def parities(h: np.ndarray) -> bytes:
    """Bits that are 1 if an odd number of the hashes fall on them, at least as many bits as hashes, a power of 2.

    Sets differ in at least as many hashes as these do in bits. The two halves' XOR is the same for half as many bits.
    """
    n = 1 << max(9, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h & np.uint64(n - 1)).view(np.int64), minlength=n) & 1 == 1).tobytes()


def frequent_last(h: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Sorted hashes with those in frequent (rows of hash and count, sorted by hash) at the end, by falling rarity."""
    if not len(frequent):
        return h
    at = np.searchsorted(frequent[:, 0], h).clip(max=len(frequent) - 1)
    found = frequent[at, 0] == h
    return np.concatenate([h[~found], h[found][np.argsort(frequent[at[found], 1], kind="stable")]])


def first_shingles(h: np.ndarray, similarity: float, rounds: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray | None:
    """The hashes at which a document meets those similar to it (0 without shingles); None if no round's new ones are among them.

    rounds: the frequent hashes, and those of them that were new, sorted.
    """
    n = len(h) - math.ceil(similarity * len(h) - 1e-9) + 1
    out = h[:n] if len(h) else np.zeros(1, np.uint64)
    for frequent, new in rounds:
        if not np.isin(out, new).any():
            return None
        out = frequent_last(h, frequent)[:n] if len(h) else out
    return out


def _sketches(size: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, m in by_bytes(batch.column(1), 8_000_000, 1000):
                part = batch.slice(low, m)
                fps, n, bits, firsts = [], [], [], []
                for x in part.column(1).cast(pa.large_binary()):
                    h = shingles(x.as_py(), size)
                    fps.append(least_fingerprints(h))
                    n.append(len(h))
                    bits.append(parities(h))
                    firsts.append(first_shingles(h, similarity, []).tobytes())
                columns = [pa.array(fps, pa.list_(pa.int64())), pa.array(n, pa.int64()), pa.array(bits, pa.binary()), pa.array(firsts, pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *columns], ["i", "t", "fps", "n", "bits", "firsts"])

    return run


def _again(size: int, similarity: float, rounds: list[tuple[np.ndarray, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, m in by_bytes(batch.column(0), 8_000_000, 1000):
                t, firsts = [], []
                for x, k in zip(batch.column(0).slice(low, m).cast(pa.large_binary()), batch.column(1).slice(low, m).to_pylist()):
                    found = first_shingles(shingles(x.as_py(), size), similarity, rounds)
                    if found is not None:
                        t.append(k)
                        firsts.append(found.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(firsts, pa.binary())], ["t", "firsts"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, n in by_bytes(batch.column(1), 8_000_000, 1000):
                part = batch.slice(low, n)
                found = [shingles(x.as_py(), size).tobytes() for x in part.column(1).cast(pa.large_binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["t", "set"])

    return run


def _jaccard(similarity: float):
    """Of parts of groups, each its first document's set (a null) and then members: the members that are similar to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = np.zeros(0, np.uint64)
        for batch in batches:
            out = []
            for v, u, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                h = np.frombuffer(data.as_py(), np.uint64)
                if u is None:
                    first = h
                    continue
                both = len(np.intersect1d(first, h, assume_unique=True))
                if both >= similarity * (len(first) + len(h) - both):
                    out.append((u, v))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([], []))], ["a", "b"])

    return run


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (label, t, n, firsts) a row for each of the first shingles, with its place."""
    for batch in batches:
        for low, m in by_bytes(batch.column(3), 2_000_000, 10_000):
            part = batch.slice(low, m)
            data = part.column(3).to_pylist()
            sizes = np.fromiter(map(len, data), np.int64, m) // 8
            of = np.repeat(np.arange(m), sizes)
            place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            columns = [part.column(c).to_numpy()[of] for c in range(3)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.frombuffer(b"".join(data), np.int64), *columns, place)], ["h", "label", "t", "n", "place"])


def _may_be_similar(x: np.ndarray, y: np.ndarray, similarity: float) -> np.ndarray:
    """Of rows (..., label, t, n, place) that meet at a shingle: not connected, and similar if all from there on is common."""
    n, m = x[..., -2], y[..., -2]
    left = np.minimum(n - x[..., -1], m - y[..., -1])
    sizes = np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6
    return (x[..., -4] != y[..., -4]) & sizes & (left >= similarity / (1 + similarity) * (n + m) - 1e-6)


def _meet(similarity: float):
    """Of rows (h, label, t, n, place) sorted by h and label: pairs (a, b) that may be similar; (h, null, n) of crowded h with more than one label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crowd = None  # of the h that has too many rows: h, their number, first and last label

        def closed(h: int | None) -> list[list[int]]:
            """The crowd that ends before h, if any."""
            nonlocal crowd
            if crowd is None or crowd[0] == h:
                return []
            out, crowd = [crowd], None
            return out

        def joined(rows: np.ndarray) -> list[int]:
            first = crowd or [int(rows[0, 0]), 0, int(rows[0, 1]), 0]
            return [first[0], first[1] + len(rows), first[2], int(rows[-1, 1])]

        def met(rows: np.ndarray, after: int | None) -> Iterator[pa.RecordBatch]:
            """Of whole groups; after: the h of the rows held back."""
            nonlocal crowd
            crowds = closed(int(rows[0, 0]) if len(rows) else after)
            starts = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]]) if len(rows) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(rows)])
            big = sizes > MAX_MEMBERS
            if crowd and len(rows):
                big[0] = True
            for s, k in zip(starts[big].tolist(), sizes[big].tolist()):
                crowds.append(joined(rows[s : s + k]))
                crowd = None
            crowds = [c for c in crowds if c[2] != c[3]]
            several = (sizes > 1) & ~big
            several[several] = rows[starts[several], 1] != rows[(starts + sizes - 1)[several], 1]
            rows = rows[np.repeat(several, sizes)]
            i, a, b = np.arange(len(rows)), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for gap in range(1, MAX_MEMBERS):
                i = i[i + gap < len(rows)]
                i = i[rows[i, 0] == rows[i + gap, 0]]
                if not len(i):
                    break
                k = i[_may_be_similar(rows[i], rows[i + gap], similarity)]
                a.append(np.maximum(rows[k, 2], rows[k + gap, 2]))
                b.append(np.minimum(rows[k, 2], rows[k + gap, 2]))
            pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
            none, m = [None] * len(crowds), len(pairs)
            if m or crowds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([*pairs[:, 0].tolist(), *(c[0] for c in crowds)], pa.int64()), pa.array([*pairs[:, 1].tolist(), *none], pa.int64()), pa.array([None] * m + [c[1] for c in crowds], pa.int64())], ["a", "b", "n"]
                )

        held = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns], axis=1)])
            if not len(rows):
                continue
            tail = int((rows[:, 0] == rows[-1, 0]).sum())
            done, held = rows[: len(rows) - tail], rows[len(rows) - tail :]
            yield from met(done, int(held[0, 0]))
            if len(held) > MAX_MEMBERS or crowd:
                crowd = joined(held)
                held = held[:0]
        yield from met(held, None)

    return run


def _differ_little(x: list[bytes], y: list[bytes], n: np.ndarray, similarity: float) -> np.ndarray:
    """Whether parities differ in no more bits than sets of n shingles together may that are similar."""
    out, sizes = np.zeros(len(n), bool), np.array([[len(a), len(b)] for a, b in zip(x, y)], np.int64).reshape(-1, 2)
    for wide in np.unique(sizes, axis=0).tolist():
        for at in np.array_split(k := np.flatnonzero((sizes == wide).all(axis=1)), 1 + len(k) * max(wide) // 8_000_000):
            folded = []
            for z, w in zip((x, y), wide):
                bits = np.frombuffer(b"".join([z[i] for i in at.tolist()]), np.uint64).reshape(-1, w // 8)
                while bits.shape[1] > min(wide) // 8:
                    bits = bits[:, : bits.shape[1] // 2] ^ bits[:, bits.shape[1] // 2 :]
                folded.append(bits)
            out[at] = np.bitwise_count(folded[0] ^ folded[1]).sum(axis=1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * n[at] + 1e-6
    return out


def _in_parts(similarity: float):
    """Of rows (h, low, high, part, label, t, n, place, bits) sorted by h, low, high: pairs of parts low and high that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met(rows: np.ndarray, bits: list[bytes]) -> Iterator[pa.RecordBatch]:
            low, high = rows[0, 1], rows[0, 2]
            x, y = np.flatnonzero(rows[:, 3] == low), np.flatnonzero(rows[:, 3] == high)
            for i in x.tolist():
                j = y[y > i] if low == high else y
                j = j[_may_be_similar(rows[i], rows[j], similarity)]
                j = j[_differ_little([bits[i]] * len(j), [bits[k] for k in j.tolist()], rows[i, 6] + rows[j, 6], similarity)]
                if len(j):
                    t = rows[j, 5]
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(t, rows[i, 5])), pa.array(np.minimum(t, rows[i, 5]))], ["a", "b"])

        held, held_bits = np.zeros((0, 8), np.int64), []
        for batch in batches:
            if not len(batch):
                continue
            rows = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns[:8]], axis=1)])
            bits = held_bits + batch.column(8).to_pylist()
            cuts = [0, *(np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1).tolist()]
            for s, e in zip(cuts, cuts[1:]):
                yield from met(rows[s:e], bits[s:e])
            held, held_bits = rows[cuts[-1] :], bits[cuts[-1] :]
        if len(held):
            yield from met(held, held_bits)

    return run


def _sifted(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                near = _differ_little(batch.column(3).to_pylist(), batch.column(4).to_pylist(), batch.column(2).to_numpy(), similarity)
                yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(near)) for c in range(2)], ["u", "v"])

    return run


def _verified(rows: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stored: the stored pairs (u, v) of texts whose whole shingle sets are similar, as (a, b)."""
    n = pairs.count()
    nodes = pairs.select(F.explode(F.array("u", "v")).alias("t")).distinct()
    one = rows.select("t", "text").join(nodes, "t", "left_semi").dropDuplicates(["t"]).select("t", "text")
    sets = stored(one.mapInArrow(_sets(shingle), "t long, set binary"), n, texts=True)
    sizes = pairs.groupBy("v").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("parts"))
    dealt = pairs.join(sizes, "v").withColumn("part", F.pmod(F.xxhash64("u"), F.col("parts")).cast("int"))
    members = dealt.join(sets, dealt.u == sets.t).select("v", "part", "u", "set")
    firsts = sizes.join(sets, sizes.v == sets.t).select("v", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("u"), "set")
    met = members.union(firsts).repartition("v", "part").sortWithinPartitions("v", "part", F.col("u").asc_nulls_first())
    return stored(met.mapInArrow(_jaccard(similarity), "a long, b long"), n)


def _left_apart(rows: DataFrame, texts: DataFrame, roots: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stored: all pairs (u, v) of texts with different roots that may be similar.

    texts: stored, t with n (number of shingles), bits (parities) and firsts (the shingles to meet at).
    """
    labels = texts.select("t", "n", "bits").join(roots, texts.t == roots.node, "left").select("t", F.coalesce("root", "t").alias("label"), "n", "bits")
    labels, firsts = stored(labels, texts.count()), texts.select("t", "firsts")
    rounds, found = [], []
    for round_ in range(ROUNDS + 1):
        n = firsts.agg(F.coalesce(F.sum(F.length("firsts")) / 8, F.lit(0))).first()[0]
        places = labels.join(firsts, "t").select("label", "t", "n", "firsts").mapInArrow(_places, "h long, label long, t long, n long, place long")
        dealt = places.repartition("h").sortWithinPartitions("h", "label", "t")
        met = stored(dealt.mapInArrow(_meet(similarity), "a long, b long, n long"), int(n))
        found.append(met.filter("b IS NOT NULL").select(F.col("a").alias("u"), F.col("b").alias("v")))
        crowded = met.filter("b IS NULL").select(F.col("a").alias("h"), "n")
        listed = crowded.orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
        known = rounds[-1][0] if rounds else np.zeros((0, 2), np.uint64)
        hashes = np.array([r.h for r in listed], np.int64).view(np.uint64)
        new = ~np.isin(hashes, known[:, 0]) if round_ < ROUNDS and len(known) < FREQUENT else np.zeros(len(hashes), bool)
        added = np.stack([hashes, np.array([r.n for r in listed], np.uint64)], axis=1)[new] if len(listed) else known[:0]
        if crowded.count() > len(added):
            spark = rows.sparkSession
            rest = crowded.join(spark.createDataFrame([(h,) for h in added[:, 0].view(np.int64).tolist()], "h long"), "h", "left_anti") if len(added) else crowded
            rest = rest.select("h", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
            members = places.join(rest, "h").join(labels.select("t", "bits"), "t").withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")))
            members = members.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
            members = members.select("h", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "label", "t", "n", "place", "bits")
            dealt = members.repartition("h", "low", "high").sortWithinPartitions("h", "low", "high")
            found.append(stored(dealt.mapInArrow(_in_parts(similarity), "u long, v long").distinct()))
        if not len(added):
            break
        frequent = np.concatenate([known, added])
        rounds.append((frequent[np.argsort(frequent[:, 0])], np.sort(added[:, 0])))
        again = rows.select("text", "t").mapInArrow(_again(shingle, similarity, rounds), "t long, firsts binary")
        firsts = stored(again.groupBy("t").agg(F.first("firsts").alias("firsts")), texts.count(), texts=True)
    pairs = found[0]
    for x in found[1:]:
        pairs = pairs.union(x)
    side = lambda c: labels.select(F.col("t").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"bits{c}"))
    both = pairs.distinct().join(side("u"), "u").join(side("v"), "v").select("u", "v", (F.col("nu") + F.col("nv")).alias("n"), "bitsu", "bitsv")
    return stored(both.mapInArrow(_sifted(similarity), "u long, v long"))


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, code: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Stored tables: texts (t: hash of a text, first: the first row that has it), and node, root of linked ones.

    Equal texts are one. Every two texts with the similarity, and no others, are linked.
    """
    text = text_or_empty(text_col)
    rows = df.select(F.col(id_col).cast("long").alias("i"), text.alias("text"), F.xxhash64(text).alias("t"))
    order = F.struct(F.col("i").isNull().alias("n"), F.col("i").alias("i"), F.col("t").alias("t"))
    sketches = rows.mapInArrow(_sketches(shingle, similarity), "i long, t long, fps array<long>, n long, bits binary, firsts binary")
    texts = stored(sketches.groupBy("t").agg(F.min(order).alias("first"), *(F.first(c).alias(c) for c in ("fps", "n", "bits", "firsts"))), texts=True)
    linked = _by_anchors(rows, texts, shingle, similarity, code)
    n = texts.count()
    roots = stored(components(linked, rows=n), n)
    more = _verified(rows, _left_apart(rows, texts, roots, shingle, similarity), shingle, similarity)
    return texts, components(linked.union(more), rows=n) if more.count() else roots


def _by_anchors(rows: DataFrame, texts: DataFrame, shingle: int, similarity: float, code: str | None) -> DataFrame:
    """Stored links (a, b) of texts with the first text of a group that their fingerprints meet in.

    Every pair of texts with the similarity is found with a chance of about 1 - (1 - similarity^LEAST)^TABLES,
    0.97 at 0.8 and more above; links are exact.
    """
    members = texts.select("t", "first", F.explode("fps").alias("fp"))
    groups = stored(members.groupBy("fp").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n")), TABLES * texts.count())
    n = groups.count()
    linked = links(groups.select("fp"), 2, code or _code(n))
    name = lambda c: groups.select(F.col("fp").alias(c), F.col("first.t").alias(f"{c}_t"), F.col("first").alias(f"{c}_first"))
    inside = members.join(groups.filter("n > 1").select("fp", F.col("first.t").alias("v")), "fp").filter("t != v").select(F.col("t").alias("u"), "v")
    across = linked.join(name("a"), "a").join(name("b"), "b").filter("a_t != b_t")
    later = F.col("a_first") > F.col("b_first")
    across = across.select(F.when(later, F.col("a_t")).otherwise(F.col("b_t")).alias("u"), F.when(later, F.col("b_t")).otherwise(F.col("a_t")).alias("v"))
    return _verified(rows, stored(inside.union(across).distinct(), n), shingle, similarity)


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of linked documents the one with the smallest id (null last), with all columns; one row of it."""
    texts, roots = similar(df, id_col, text_col, shingle, similarity)
    named = texts.join(roots, texts.t == roots.node, "left").select(F.coalesce("root", "t").alias("root"), "first")
    kept = named.groupBy("root").agg(F.min("first").alias("__first")).select("__first")
    text_hash = F.xxhash64(text_or_empty(text_col))
    same = F.col(id_col).cast("long").eqNullSafe(F.col("__first.i")) & (text_hash == F.col("__first.t"))
    out = df.join(kept, same, "left_semi").withColumn("__t", text_hash)
    return out.dropDuplicates([id_col, "__t"]).drop("__t")
