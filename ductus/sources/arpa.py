"""ARPA language-model files: parsing numbered lines, and writing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parse(lines: DataFrame) -> DataFrame:
    """n, ngram, logprob, backoff of the lines (line_no, text) of one file; a missing backoff is 0.

    The few section headers are read first; a line belongs to the last one before it.
    """
    text = F.trim(F.regexp_replace("text", r"[\r\n]+$", ""))
    rows = lines.select("line_no", text.alias("t"))
    headers = rows.filter(F.col("t").rlike(r"^\\(data|end|\d+-grams:?)")).select("line_no", F.regexp_extract("t", r"^\\(\d+)-grams", 1).alias("n"))
    section = F.lit(None).cast("int")
    for h in headers.orderBy("line_no").limit(1000).collect():  # one an order, and two
        section = F.when(F.col("line_no") > h.line_no, F.lit(int(h.n) if h.n else None).cast("int")).otherwise(section)
    inside = rows.withColumn("n", section).filter("n IS NOT NULL")
    c = F.split("t", "\t")
    cells = inside.select(F.col("n").cast("int").alias("n"), c.alias("c")).filter(F.size("c") >= 2)
    backoff = F.when(F.size("c") > 2, F.col("c")[2].cast("double")).otherwise(0.0)
    return cells.select("n", F.col("c")[1].alias("ngram"), F.col("c")[0].cast("double").alias("logprob"), backoff.alias("backoff"))


def orders(lines: DataFrame) -> DataFrame:
    """n, declared: the counts that the file's head declares."""
    found = F.regexp_extract("text", r"^ngram (\d+)\s*=", 1)
    return lines.filter(found != "").select(found.cast("int").alias("n"), F.regexp_extract("text", r"=\s*(\d+)", 1).cast("long").alias("declared"))


def render(model: DataFrame) -> DataFrame:
    """section, ngram, text: the lines of an ARPA file; orderBy("section", "ngram") is their order in it."""
    sizes = model.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    head = sizes.select(F.lit(0.0).alias("section"), F.format_string("%05d", "n").alias("ngram"), F.format_string("ngram %d=%d", "n", "k").alias("text"))
    spark = model.sparkSession
    fixed = spark.createDataFrame([(-1.0, "", "\\data\\"), (1e9, "", "\\end\\")], head.schema)
    titles = sizes.select((F.col("n") - 0.5).cast("double").alias("section"), F.lit("").alias("ngram"), F.concat(F.lit("\\"), F.col("n").cast("string"), F.lit("-grams:")).alias("text"))
    top = sizes.agg(F.max("n")).first()[0] or 0
    line = F.concat_ws("\t", F.format_string("%.7f", "logprob"), "ngram", F.when(F.col("n") < top, F.format_string("%.7f", "backoff")))
    return head.union(fixed).union(titles).union(model.select(F.col("n").cast("double").alias("section"), "ngram", line.alias("text")))


def reject_binary(path: str) -> None:
    """Compiled models aren't readable here."""
    if path.endswith((".bin", ".binary", ".trie")):
        raise NotImplementedError(f"{path}: only ARPA files can be read")
