"""The driver's documents as lines of Tibetan: a fixed one-to-one translation, the same in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductus.operators.lines import explode_lines

LATIN = "abcdefghijklmnopqrstuvwxyzéèêçäöüßíóñ .,%#&*$|!"
SCRIPT = "འབཅདེཕགྱིཇཀལམནོཔཁྲསཐུཝཤཞྀཟངཉཏཆཙཚཛཡརཧཱ་།༑༎༏༹༷༄ ༔"
#: One ASCII character for each of SCRIPT, for engines whose edit distance counts bytes.
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJK0123456789"

#: A small dictionary in its order: longest first.
RULES = [("ཐྱེ་འནད་", "ཐམས་ཅད་"), ("ཐྱེ་", "ཐེན་"), ("འནད་", "ཨན་ད་"), ("ོཕ་", "ོབ་"), ("ིན་", "ིནྀ་")]


def latin_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return explode_lines(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", *more)), more=more)


def spread(df: DataFrame) -> DataFrame:
    """Rows of a few files dealt to all cores, which would wait for one task otherwise; many files stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if len(df.inputFiles()) < cores else df


def script_lines(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """The lines in the script; with more columns of their documents."""
    return latin_lines(spark, sf_dir, *more).withColumn("text", F.translate("text", LATIN, SCRIPT))


#: Common table expressions for DuckDB: `latin` and `lines` (doc_id, line_no, text).
SQL = f"""
raw_ AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
latin AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, unnest(l) AS text FROM raw_),
lines AS (SELECT doc_id, line_no, translate(text, '{LATIN}', '{SCRIPT}') AS text FROM latin)
"""
