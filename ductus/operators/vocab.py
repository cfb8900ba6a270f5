"""Character vocabularies: building, encoding, decoding, comparing."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.functions import script

PAD, SOS, EOS, UNK = range(4)
SPECIALS = ("<pad>", "<sos>", "<eos>", "<unk>")
LONGEST = 100
#: Characters every vocabulary has: the block, ASCII punctuation, digits and the space.
FIXED = [chr(c) for c in range(0x0F00, 0x1000)] + list(string.punctuation) + list(string.digits) + [" "]
#: Vocabularies are far below this; a larger one is an error.
MAX_CHARS = 1_200_000


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """ch, n: characters of all texts; counted per task before the shuffle."""
    return df.select(F.explode(script.chars(F.col(text))).alias("ch")).groupBy("ch").agg(F.count(F.lit(1)).alias("n"))


def build(df: DataFrame, text: str = "text", fixed: bool = True) -> DataFrame:
    """ch, idx: the characters of all texts and the fixed ones in code-point order, from 4; specials 0 to 3."""
    spark = df.sparkSession
    seen = char_counts(df, text).select("ch")
    if fixed:
        seen = seen.union(spark.createDataFrame([(c,) for c in FIXED], "ch string")).distinct()
    numbered = seen.select("ch", (F.row_number().over(Window.orderBy("ch")) + 3).alias("idx"))
    return numbered.union(spark.createDataFrame(list(zip(SPECIALS, range(4))), "ch string, idx int"))


def as_map(vocabulary: DataFrame) -> dict[str, int]:
    found = vocabulary.limit(MAX_CHARS + 1).collect()
    if len(found) > MAX_CHARS:
        raise ValueError("too many characters")
    return {r.ch: r.idx for r in found}


def _indexed(values: dict[int, object], default: object):
    """Column function from a number to its value: an array by number, so a lookup takes the same time in any table."""
    table = F.lit([values.get(i, default) for i in range(max(values, default=0) + 1)])
    return lambda i: F.coalesce(F.get(table, i), F.lit(default))


def encode(text: Column, ids: dict[str, int], frame: bool = True, longest: int = LONGEST) -> Column:
    """Ids of the characters, unknown ones 3. frame: <sos>, the first longest - 2 characters, <eos> (training);
    else all characters and nothing around them (inference)."""
    codes = {ord(c): i for c, i in ids.items() if len(c) == 1}
    table = np.full(max(codes, default=0) + 2, UNK, np.int32)  # by code point; the last one is for all beyond
    table[list(codes)] = list(codes.values())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encoded(texts: pa.Array) -> pa.Array:
        kept = [(x or "")[: longest - 2] if frame else x or "" for x in texts.to_pylist()]
        n = np.array([len(x) for x in kept], np.int64) + 2 * frame
        ends = np.cumsum(n)
        values = np.full(int(n.sum()), -1, np.int32)
        if frame:
            values[ends - n], values[ends - 1] = SOS, EOS
        found = np.frombuffer("".join(kept).encode("utf-32-le", "surrogatepass"), "<u4")
        values[values < 0] = table[np.minimum(found, len(table) - 1)]
        none = texts.is_null()
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values), mask=none if texts.null_count else None)

    return encoded(text)


def decode(ids: Column, chars: dict[str, int]) -> Column:
    """The text up to the first <eos>, without specials; ids that aren't in the vocabulary give nothing."""
    look = _indexed({i: c for c, i in chars.items() if i > UNK}, "")
    end = F.array_position(ids, EOS)
    return F.array_join(F.transform(F.when(end > 0, F.slice(ids, 1, (end - 1).cast("int"))).otherwise(ids), look), "")


def padded(ids: Column, size: int) -> Column:
    """ids with <pad> up to a batch's size."""
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(0), F.lit(size) - F.size(ids))))


def overlap(source: DataFrame, target: DataFrame) -> DataFrame:
    """One row: sizes of two vocabularies without specials, shared characters, and their share of the target's."""
    a = source.filter("idx > 3").select("ch", F.lit(1).alias("s"), F.lit(0).alias("t"))
    b = target.filter("idx > 3").select("ch", F.lit(0).alias("s"), F.lit(1).alias("t"))
    both = a.union(b).groupBy("ch").agg(F.max("s").alias("s"), F.max("t").alias("t"))
    shared = F.sum(F.col("s") * F.col("t"))
    return both.agg(F.sum("s").alias("source_size"), F.sum("t").alias("target_size"), shared.alias("shared"), F.when(F.sum("t") > 0, shared / F.sum("t")).otherwise(0.0).alias("share"))
