"""Sharding by proportional stratified interleaving.

The rows of each source are ranked in a seeded shuffle; all rows are then put in the order of their
fractional rank (rank - 1/2) / (rows of the source), so that every stretch of that order holds the
sources in proportion, and the order is cut into shards whose row counts differ by one at most.

Both rankings are distributed: rows are counted by (source, hash bucket) and by bucket of fractional rank,
the running sums of these small counts give each bucket's first rank, and only rows inside a bucket are
sorted. A source with a third of all rows is thus spread over as many tasks as it has buckets; only rows that
are equal in id and text share a bucket whatever their number.

Defined cases: a null text has size 8 and the checksum of no bytes; null is a source of its own; repeated
rows are placed one by one; an empty table gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductus.llm.common import hash_unit, stored, text_or_empty

HASH_BITS = 60
#: Rows that are sorted together, and the most buckets, whose counts are summed up in one task.
ROWS, MAX_BUCKETS = 500, 200_000


def _ranked(rows: DataFrame, group: list[str], bucket: Column, order: list[str], rank: str) -> DataFrame:
    """rows with the place of each (from 0) within its group in the order of (bucket, *order).

    bucket: a long that doesn't fall along that order; a bucket's rows are sorted in one task.
    """
    rows = rows.withColumn("__b", bucket)
    counts = rows.groupBy(*group, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*group).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(*group, "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    inside = Window.partitionBy(*group, "__b").orderBy(*order)
    return rows.withColumn("__i", F.row_number().over(inside) - 1).join(first, [*group, "__b"]).withColumn(rank, F.col("__first") + F.col("__i")).drop("__b", "__i", "__first")


def shards(df: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, rows_per_bucket: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, source, position (in the interleaved order), shard, slot.

    rows_per_bucket: by default ROWS, or as many as make MAX_BUCKETS of all.
    """
    text = text_or_empty(text_col)
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("~"))
    rows = stored(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            source.alias("s"),
            hash_unit(seed, F.col(id_col), F.crc32(text.cast("binary"))).alias("h"),
        )
    )
    total = rows.count()
    buckets = max(1, -(-total // (rows_per_bucket or max(ROWS, total // MAX_BUCKETS))))
    by_hash = F.floor(F.col("h") / F.lit(float(2**HASH_BITS)) * buckets).cast("long")
    ranked = _ranked(rows, ["s"], by_hash, ["h", "doc_id", "size", "text_crc32"], "r")
    sizes = rows.groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    ranked = ranked.join(sizes, "s").withColumn("f", (2 * F.col("r") + 1) / (2 * F.col("n")))
    ordered = _ranked(stored(ranked, total).withColumn("g", F.lit(0)), ["g"], F.floor(F.col("f") * buckets).cast("long"), ["f", "s", "r"], "position")
    q, more = divmod(total, n_shards)
    at = F.col("position")
    head = at < more * (q + 1)
    shard = F.when(head, F.floor(at / (q + 1))).otherwise(more + F.floor((at - more * (q + 1)) / max(q, 1)))
    slot = F.when(head, at % (q + 1)).otherwise((at - more * (q + 1)) % max(q, 1))
    return ordered.select("doc_id", "size", "text_crc32", F.col("s").alias("source"), "position", shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def op5_stratified_shards(spark, sf_dir: str) -> DataFrame:
    out = shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
