"""A training corpus from the documents table: the stages, and all of them in order.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() stores every stage's result in the
shared folder and reads it again as the next one's documents, so a lost executor never reaches back beyond
the stage that runs; what a stage stored on the way, and its input, go then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ductus.llm.common import discard, only_the_last, stored
from ductus.llm.line_dedup import remove_repeats
from ductus.llm.mixing import mixed_documents
from ductus.llm.packing import packed_documents
from ductus.llm.quality import filter_documents
from ductus.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the host-level quality rules keep."""
    return filter_documents(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated passages."""
    return remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a similarity of 0.8."""
    return one_of_each(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of sources takes them."""
    return mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of up to 4096 tokens."""
    return packed_documents(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("mixing", mixture),
    ("packing", sequences),
]

#: Near-duplicate components and best-fit packing have no equal in SQL; tests/llm compares every stage with a
#: brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES[:-1]:
        with only_the_last():
            docs = stored(stage(spark, docs, sf_dir))
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
