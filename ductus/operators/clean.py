"""Cleaning of raw lines and reflow into lines of a wanted length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductus.functions import folds
from ductus.operators.lines import join_lines


def cleaned(text: Column) -> Column:
    """Script characters only, spaces after double shads, none between punctuation marks."""
    return folds.cleaned(text)


def clean_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """df with cleaned lines, without those of which nothing is left."""
    out = df.withColumn(text, folds.cleaned(F.col(text), strip=True))
    return out.filter(F.length(text) > 0)


def reflow(df: DataFrame, key: str, shortest: int = 100, longest: int = 120, segmented: bool = False, text: str = "text") -> DataFrame:
    """key, line_no, text: the cleaned lines of each key joined and cut anew. A constant key reflows a whole corpus."""
    if longest < 1 or shortest > longest:
        raise ValueError("needs 0 < shortest <= longest")
    whole = join_lines(clean_lines(df, text), key, " ", text)
    lines = whole.select(key, F.posexplode(folds.reflowed(F.col("text"), shortest, longest, segmented)).alias("i", "text"))
    return lines.select(key, (F.col("i") + 1).cast("long").alias("line_no"), "text")
