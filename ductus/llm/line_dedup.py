"""Removal of repeated passages by overlapping three-line windows.

A line is what a text's line breaks give, cut further at places that the words themselves choose: of every REACH
words in a row, the one with the least key starts a line, where the key is a hash of the word and the one before,
a word after a sentence end has a lesser one than others, and the next two words after it or after a line break a
greater one. Where a passage starts, in which text, and whether it has punctuation doesn't matter: copies are cut
alike but for the ends (REACH + 2 words before, REACH after), so any 4 * REACH + 3 = 51 words have three whole
lines in common. Every three consecutive lines are hashed (96 bits), however short they are; a text with fewer
lines is one window. Of all occurrences of a window, the one in the first document, and there the first one, stays;
the others are later. The lines under later windows are merged and removed; what remains keeps its order and its
white space. Every removed line remains where its window occurs first.

Windows cross the network once. A task settles what it can: of the rows of a chunk that hold a window, all but the
first are later, whatever other tasks hold, so one row a chunk and window is left to compare, and a window that a
third of all documents share is no larger a group than there are chunks.

Defined cases: a null text stays null; documents are ordered by id, null ids last, then by a hash of the text, so
rows that share an id (or have none) but not the text are different documents; rows with equal id and text are one
document and keep the same text; a text with nothing left after the removal goes, one that had no word before
stays; an empty table gives an empty table; other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.llm.common import WORD, by_bytes, text_or_empty

WINDOW = 3
#: Of so many words in a row, one starts a line; the last ones of a text may be fewer.
REACH = 12
#: Windows that a task compares among themselves before they cross the network.
CHUNK = 500_000
_SPACE, _STOP = np.zeros(256, bool), np.zeros(256, bool)
_SPACE[list(b" \t\n\x0b\f\r")] = True
_STOP[list(b".!?")] = True
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_K1, _K2, _K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _K3
    return x ^ (x >> np.uint64(29))


def _cut(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one buffer; of each line the text it is of, its first byte, the end of its last word, its words."""
    data = bytes(8) + b"".join(b"\n" + t for t in texts) + bytes(8)
    b = np.frombuffer(data, np.uint8)[7:-8]  # with a byte before the first break
    space = _SPACE[b]
    space[0] = True
    edges = np.flatnonzero(space[1:] != space[:-1]) + 8
    if len(edges) % 2:
        edges = np.append(edges, len(data) - 8)
    start, end = edges[0::2], edges[1::2]
    n = len(start)
    begins = np.zeros(n + 1, bool)
    begins[np.searchsorted(start, np.flatnonzero(b[1:] == 10) + 8)] = True
    begins = begins[:n]
    if n >= REACH:
        eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        size = np.minimum(end - start, 8)
        word = _mix((eight[start] & _MASK[size]) * _K1 + (eight[end - 8] >> (64 - 8 * size).astype(np.uint64)) * _K2 + (end - start).astype(np.uint64))
        pair = _mix(word[1:] + word[:-1] * _K1)
        low = np.uint64(0xFFFFFFFF) - np.arange(n, dtype=np.uint64)
        key = low.copy()
        stop = _STOP[b[end[:-1] - 8]]
        near = begins | np.append(False, stop)
        near[1:] |= near[:-1].copy()
        near = near[:-1]  # a break or a sentence end one or two words before
        # Breaks first, then sentence ends, others, and what would leave a scrap of one or two words.
        band = np.where(stop, np.uint64(1), np.where(near, np.uint64(3), np.uint64(2))) << np.uint64(62)
        key[1:] |= np.where(begins[1:], np.uint64(0), (pair >> np.uint64(2) | band) & ~np.uint64(0xFFFFFFFF))
        two = np.minimum(key[:-1], key[1:])
        four = np.minimum(two[:-2], two[2:])
        eights = np.minimum(four[:-4], four[4:])
        least = np.minimum(eights[:-4], four[8:])  # of REACH words
        begins[(np.uint64(0xFFFFFFFF) - (least & np.uint64(0xFFFFFFFF))).astype(np.int64)] = True
    first = np.flatnonzero(begins)
    after = np.append(first[1:], n)[: len(first)]
    offsets = np.cumsum([9] + [len(t) + 1 for t in texts[:-1]])
    of = np.searchsorted(offsets, start[first], "right") - 1
    return data, of, start[first], end[after - 1], after - first


def lines(text: bytes) -> list[bytes]:
    """The lines of a text, each with the white space after it."""
    data, _, start, _, _ = _cut([text])
    return [data[a:b] for a, b in zip(start, [*start[1:], len(data) - 8])]


def _windows(of: np.ndarray, digests: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place among all lines of every window's first line, and two hashes of it; of: the text of each line."""
    d = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
    count = np.bincount(of) if len(of) else np.zeros(0, np.int64)
    place = np.arange(len(of)) - (np.cumsum(count) - count)[of]
    places, hashes = [], []
    for size in range(1, WINDOW + 1):
        at = np.flatnonzero((count[of] == size) & (place == 0) if size < WINDOW else count[of] - place >= WINDOW)
        h = _mix(d[at] + np.uint64(size))
        for k in range(1, size):
            h = _mix(h * _K1 + d[at + k])
        places.append(at)
        hashes.append(h)
    h = np.concatenate(hashes)
    return np.concatenate(places), h[:, 0], h[:, 1].astype(np.uint32)


def _places(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Of all windows of the texts: the text, the place in it, two hashes."""
    data, of, start, end, _ = _cut(texts)
    at, h1, h2 = _windows(of, [xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), end.tolist())])
    return of[at], at - np.searchsorted(of, of[at]), h1, h2


def _settled(ids: np.ndarray, text_hashes: np.ndarray, row: np.ndarray, place: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the windows of some documents: those that are later, and the first one of each kind."""
    document = np.empty(len(ids), np.int64)
    by_id = np.lexsort((text_hashes, ids))
    new = (ids[by_id][1:] != ids[by_id][:-1]) | (text_hashes[by_id][1:] != text_hashes[by_id][:-1])
    document[by_id] = np.cumsum(np.append(False, new)[: len(ids)])
    d = document[row]
    order = np.lexsort((place, d, h2, h1))
    first = np.append(True, (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1]))[: len(order)]
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    again = (d[order] != d[lead]) | (place[order] != place[lead])
    return order[again], order[first]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of documents i, t, text: later ones (spread by their place), and the first of each kind in a chunk."""
    held: list[tuple] = []

    def chunk() -> Iterator[pa.RecordBatch]:
        starts = np.cumsum([0, *(len(x[0]) for x in held)])
        ids, text_hashes = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        row, place, h1, h2 = (np.concatenate([x[k] + (starts[n] if k == 2 else 0) for n, x in enumerate(held)]) for k in range(2, 6))
        for later, at in zip((True, False), _settled(ids, text_hashes, row, place, h1, h2)):
            i, t = ids[row[at]], text_hashes[row[at]]
            key = (t.view(np.uint64) * _K1 + place[at].astype(np.uint64)) if later else h1[at]
            columns = [np.full(len(at), later), key.view(np.int64), np.zeros(len(at), np.int32) if later else h2[at].view(np.int32), i, t, place[at].astype(np.int32)]
            for low in range(0, len(at), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[low : low + 50_000]) for c in columns], ["later", "h1", "h2", "i", "t", "place"])

    n = 0
    for batch in batches:
        texts = batch.column(2)
        for low, size in by_bytes(texts, 4_000_000, 500):
            part = batch.slice(low, size)
            found = _places(part.column(2).cast(pa.large_binary()).to_pylist())
            held.append((part.column(0).to_numpy(), part.column(1).to_numpy(), *found))
            n += len(found[0])
            if n >= CHUNK:
                yield from chunk()
                held, n = [], 0
    if n:
        yield from chunk()


def without(texts: list[bytes], places: list[list[int]]) -> list[bytes]:
    """The texts without the lines under the windows at the given places of each."""
    data, of, start, _, _ = _cut(texts)
    edges = np.searchsorted(of, np.arange(len(texts) + 1))
    ends = np.cumsum([9, *(len(t) + 1 for t in texts)])[1:] - 1  # of each text in data
    out = []
    for k, (text, at) in enumerate(zip(texts, places)):
        first = start[edges[k] : edges[k + 1]].tolist()
        gone = np.zeros(len(first) + WINDOW, bool)
        for i in range(WINDOW):
            gone[np.asarray(at, np.int64) + i] = True
        after = [*first[1:], int(ends[k])]
        left = b"".join([data[a:b] for a, b, g in zip(first, after, gone.tolist()) if not g])
        head = text[: len(text) - (after[-1] - first[0])] if first else text
        out.append((head + left).rstrip() if left and gone[len(first) - 1] else head + left)
    return out


@F.pandas_udf(T.StringType())
def _rewritten(texts: pd.Series, places: pd.Series) -> pd.Series:
    out = texts.tolist()
    for low in range(0, len(out), 500):
        rows = [k for k in range(low, min(low + 500, len(out))) if places.iloc[k] is not None and out[k] is not None]
        for k, text in zip(rows, without([out[k].encode() for k in rows], [places.iloc[k] for k in rows])):
            out[k] = text.decode()
    return pd.Series(out, dtype=object)


#: Not to be copied into the filter above it, which would run it twice.
_once = _rewritten.asNondeterministic()


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", keep_empty: bool = False) -> DataFrame:
    """df with shorter texts, and (but for keep_empty) without the documents of which nothing is left.

    chars_col is kept in step if df has it.
    """
    last = F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1))
    text_hash = F.xxhash64(text_or_empty(text_col))
    rows = df.select(last.alias("i"), text_hash.alias("t"), text_or_empty(text_col).alias("text"))
    found = rows.mapInArrow(_found, "later boolean, h1 long, h2 int, i long, t long, place int")
    place = F.rank().over(Window.partitionBy("later", "h1", "h2").orderBy("i", "t"))
    later = found.withColumn("rank", place).filter("later OR rank > 1").groupBy("i", "t").agg(F.collect_set("place").alias("places"))
    later = later.select(F.col("i").alias("__i"), F.col("t").alias("__t"), F.col("places").alias("__places"))
    text = F.col(text_col).cast("string")
    out = df.join(later, (last == F.col("__i")) & (text_hash == F.col("__t")), "left").withColumn("__new", _once(text, F.col("__places")))
    had, has = F.coalesce(text.rlike(WORD), F.lit(False)), F.coalesce(F.col("__new").rlike(WORD), F.lit(False))
    out = out if keep_empty else out.filter(has | ~had)
    columns = [F.col("__new").alias(c) if c == text_col else F.length("__new").cast(df.schema[c].dataType).alias(c) if c == chars_col else F.col(c) for c in df.columns]
    return out.select(*columns)


def op9_line_windows(spark, sf_dir: str) -> DataFrame:
    """doc_id, text (what remains of it), n_chars of that, n_removed: characters that went. A row per document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.length("text").cast("long").alias("n_before"), F.length("text").cast("long").alias("n_chars"))
    out = remove_repeats(docs, keep_empty=True)
    return out.select("doc_id", "text", "n_chars", (F.col("n_before") - F.col("n_chars")).alias("n_removed"))
