"""Tables kept between the jobs of one query."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local: list[str] = []


def folder(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; without it, in local mode only, a temporary folder."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(f"file://{tempfile.mkdtemp(prefix='ductus-')}")
    return _local[0]


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again; the table goes when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{folder(spark)}/ductus-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
