"""Lines of text files in and out."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ductus.plans.store import stored


#: Blocks of files up to this number are broadcast (under 200 bytes each); beyond it the join is shuffled.
MAX_BROADCAST_BLOCKS = 100_000


@F.pandas_udf(T.StringType())
def _lossy(lines: pd.Series) -> pd.Series:
    """Without the bytes that aren't UTF-8."""
    return lines.map(lambda b: bytes(b).decode("utf-8", "ignore"))


def read_lines(spark: SparkSession, path: str, strip: bool = False, drop_blank: bool = False, lossy: bool = False) -> DataFrame:
    """file, line_no (from 1), text of every file under path; line breaks are \\n, \\r\\n or \\r.

    Large files are read in blocks by many tasks: a first pass counts the lines of each block, and a line's number is
    its place in the block after those of the blocks before. Bytes that aren't UTF-8 are an error; lossy drops them.
    """
    at = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select(at("file_path").alias("file"), at("file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__i"), "value")
    blocks = rows.groupBy("file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__i").alias("__first"))
    before = Window.partitionBy("file").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = stored(blocks.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"))
    few = blocks.limit(MAX_BROADCAST_BLOCKS + 1).count() <= MAX_BROADCAST_BLOCKS
    text = _lossy(F.col("value").cast("binary")) if lossy else F.validate_utf8("value")
    lines = rows.join(F.broadcast(blocks) if few else blocks, ["file", "__block"])
    lines = lines.select("file", (F.col("__before") + F.col("__i") - F.col("__first") + 1).alias("line_no"), text.alias("text"))
    if strip:
        lines = lines.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    return lines.filter(F.col("text").rlike(r"(?U)\S")) if drop_blank else lines


def first_lines(lines: DataFrame, most: int | None, order: list[str] = ("file", "line_no")) -> DataFrame:
    """The first `most` lines in their order, all without a limit."""
    return lines if most is None else lines.orderBy(*order).limit(most)


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """text, without numbers: large files are split over tasks."""
    return spark.read.text(path).withColumnRenamed("value", "text")


def write_lines(df: DataFrame, path: str, order: list[str] | None = None, one_file: bool = False, text: str = "text") -> None:
    """The texts as lines in order; one_file puts all of them through one task."""
    out = df.orderBy(*order) if order else df
    out = out.select(F.coalesce(F.col(text), F.lit("")).alias("value"))
    (out.coalesce(1) if one_file else out).write.mode("overwrite").text(path)


def write_errors(df: DataFrame, path: str, error: str = "error") -> int:
    """Writes the rows that have an error as "line <number>: <error>"; nothing is written if there are none."""
    bad = df.filter(F.col(error).isNotNull())
    n = bad.count()
    if n:
        bad.select(F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), F.col(error)).alias("value")).write.mode("overwrite").text(path)
    return n
