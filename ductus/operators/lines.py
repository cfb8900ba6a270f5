"""Lines as rows: from documents, and back in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ductus.plans.store import stored


def explode_lines(df: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """key, line_no (from 1), text, and more columns: the lines of each text."""
    lines = df.select(F.col(key), *more, F.posexplode(F.split(F.col(text), "\n")).alias("i", "__line"))
    return lines.select(key, (F.col("i") + 1).cast("long").alias("line_no"), F.col("__line").alias("text"), *more)


def join_lines(df: DataFrame, key: str, separator: str = " ", text: str = "text", order: str = "line_no") -> DataFrame:
    """key, text: the lines of each key in order, joined. A key's lines meet in one task."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return df.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x[text]), separator).alias("text"))


def align(left: DataFrame, right: DataFrame, on: str | list[str] = "line_no") -> DataFrame:
    """Inner join by place; raises ValueError if the two have different numbers of rows (one count each)."""
    a, b = left.count(), right.count()
    if a != b:
        raise ValueError(f"{a} rows against {b}")
    return left.join(right, on)


def contiguous_split(df: DataFrame, order: list[str], validation: float = 0.1, test: float = 0.1) -> DataFrame:
    """Adds `part`: train, val or test. The last max(1, int(n test)) rows are the test rows, those before them
    the validation rows; if no training row were left, a fifth is for testing and the rest for training.

    Places come from counts of range partitions, so no task sorts all rows.
    """
    n = df.count()
    tests, vals = max(1, int(n * test)), max(1, int(n * validation))
    if n - tests - vals < 1:
        tests, vals = max(1, int(n * 0.2)), 0
    place = F.col("__place")
    return numbered(df, order, "__place").withColumn("part", F.when(place >= n - tests, "test").when(place >= n - tests - vals, "val").otherwise("train")).drop("__place")


def numbered(df: DataFrame, order: list[str], name: str, ranges: int = 64) -> DataFrame:
    """Adds the place (from 0) of each row in the order, over all rows; nulls come first.

    Rows are dealt into ranges of the whole order, of any types, and stored; places are the counts of the ranges
    before plus the row number inside one. Rows equal in the whole order are one range's: give a unique order.
    """
    dealt = df.repartitionByRange(ranges, *[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    # Places in a sorted range: the id's lower bits; its upper ones are the range.
    rows = stored(dealt.withColumn("__id", F.monotonically_increasing_id()))
    split = rows.withColumn("__range", F.shiftright("__id", 33)).withColumn("__i", F.col("__id").bitwiseAND((1 << 33) - 1))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    firsts = split.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    return split.join(F.broadcast(firsts), "__range").withColumn(name, F.col("__first") + F.col("__i")).drop("__id", "__range", "__i", "__first")


def length_buckets(df: DataFrame, shortest: int, longest: int, text: str = "text") -> DataFrame:
    """One row: total, in_range, out_of_range."""
    inside = F.length(text).between(shortest, longest)
    return df.agg(F.count(text).alias("total"), F.count_if(inside).alias("in_range"), F.count_if(~inside).alias("out_of_range"))
