"""What the training-data operators share: stored tables, word rules, null handling."""

from __future__ import annotations

import gc
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ductus.plans.store import folder

#: White space of every contract: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
#: A word, for Spark's regular expressions.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

_scopes: list[list[DataFrame]] = []


#: Of tables whose number of rows is known, what a task writes; and the least number of tasks.
ROWS_A_TASK, LEAST_TASKS = 100_000, 12


#: Rows, and bytes, of a batch in which texts go to Python; by Spark's own settings it is 10,000 rows of any length.
TEXTS_A_BATCH, BYTES_A_BATCH = 1000, 4_000_000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends small batches to Python, whose buffers both sides hold beside the JVM's heap."""
    most = {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS_A_BATCH, "spark.sql.execution.arrow.maxBytesPerBatch": BYTES_A_BATCH}
    before = {k: spark.conf.get(k, None) for k in most}
    try:
        for k, x in most.items():
            spark.conf.set(k, str(x))
        yield
    finally:
        for k, x in before.items():
            spark.conf.unset(k) if x is None else spark.conf.set(k, x)


def stored(df: DataFrame, rows: int | None = None, texts: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it again.

    It cuts the lineage: a lost executor costs the tasks that run, not the steps before. The table
    goes when it is discarded, at the latest when the driver's JVM ends. rows: about how many it has at
    most, so that small tables aren't a file for every partition of a shuffle. texts: whole texts go to Python.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/ductus-{uuid.uuid4().hex}"
    with small_batches(spark) if texts else nullcontext():
        (df if rows is None else df.coalesce(max(LEAST_TASKS, -(-rows // ROWS_A_TASK)))).write.parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._ductus_path = path
    for made in _scopes:
        made.append(out)
    return out


@contextmanager
def only_the_last() -> Iterator[None]:
    """Of the tables stored inside, all but the last go at the end: they were steps towards it."""
    made: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield
    finally:
        _scopes.remove(made)
        discard(*made[:-1])


def discard(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._ductus_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def dealt_evenly(df: DataFrame, number: str, n: int) -> DataFrame:
    """df in n partitions, rows of number k in that of k mod n, so that no two of n numbers meet by chance.

    Up to 10,000 partitions; beyond them a hash deals evenly enough.
    """
    if n > 10_000:
        return df.repartition(n, number)
    spark = df.sparkSession
    keys = spark.range(n * (n.bit_length() + 20)).groupBy(F.pmod(F.hash("id"), n).alias("p")).agg(F.min("id").alias("k"))
    found = dict(keys.collect())  # a long that hashes to each partition
    key = F.element_at(F.lit([found.get(i, i) for i in range(n)]), (F.pmod(F.col(number), F.lit(n)) + 1).cast("int"))
    return df.withColumn("__key", key.cast("long")).repartition(n, "__key").drop("__key")


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, so that the shuffle files of plans no longer held go now, not later.

    Twice: what Python lets go of first is garbage for the JVM only after that.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def by_bytes(column: pa.Array, most: int, rows: int) -> Iterator[tuple[int, int]]:
    """(first row, number of rows) of slices of a column of texts: at most so many bytes and rows, one row at least."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    low = total = 0
    for k, size in enumerate(sizes):
        if k > low and (total + size > most or k - low >= rows):
            yield low, k - low
            low, total = k, 0
        total += size
    if len(sizes) > low:
        yield low, len(sizes) - low


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words of a text that isn't null, without an array of them."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def n_chars_of_words(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def hash_unit(seed: int, *cols: Column) -> Column:
    """60 bits of an MD5 over the columns, as a long from 0; DuckDB can compute the same."""
    parts = [F.coalesce(c.cast("string"), F.lit("~")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *parts)), 1, 15), 16, 10).cast("long")
