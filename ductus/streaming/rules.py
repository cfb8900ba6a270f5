"""Row-local operators on streams of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductus.functions import script
from ductus.operators import rules as rule_ops


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """text: new lines of the text files that come into a folder."""
    return spark.readStream.text(path).withColumnRenamed("value", "text")


def normalise_stream(lines: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """lines with `normalised` by rules mode; it keeps no state."""
    return lines.withColumn("normalised", rule_ops.normalise(script.strip(F.col("text")), rules))
