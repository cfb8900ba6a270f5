"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Documents get a seeded hash of id and text. For every source the tokens are summed by hash bucket; the bucket in which
the running sum passes the budget is refined, and only that one, until it is a single hash. A document
is taken when its hash is at most its source's threshold. Nothing is sorted but the few histogram rows,
thresholds of growing budgets are nested, and a rerun takes the same documents.

Defined cases: a null text has size 0; null is a source of its own, after all others; rows that share an id
(or have none) but not the text are taken or left one by one, rows equal in both together; sources without words get target 0; an empty table
gives an empty table; other columns of the input are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ductus.llm.common import hash_unit, n_words, stored, text_or_empty

HASH_BITS = 60
LEVEL_BITS = 12
#: Sources up to this number are broadcast (under 100 bytes each); beyond it the joins are shuffled.
MAX_BROADCAST_SOURCES = 100_000


def source_targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets by source: share of all words by weight, at most `most` times the source, excess reshared.

    In the order of (cap / weight), the first source that stays below its cap fixes the level at which all
    later ones stay below theirs too. sizes: __s, source, source_size; one row a source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, after, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    rows = rows.withColumn("level", level)
    free = F.min(F.when(F.col("cap") / F.col("w") >= F.col("level"), F.struct(F.col("cap") / F.col("w"), "level"))).over(whole)["level"]
    return rows.withColumn("target", F.least(F.col("cap"), F.coalesce(free, F.lit(float("inf"))) * F.col("w"))).select("__s", "source_size", "target")


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The largest hash to take once more, by source (-1: none), and the whole copies of every document.

    rows: __s, size, h; both tables are stored. Ends with the set of hashes whose sum is nearest to the budget
    among nested sets.
    """
    n_sources, n_rows = targets.count(), rows.count() // 1000  # after a level about a 4096th of the rows
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = plan.select("__s", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below"), "rest").filter("rest > 0")
    inside = rows
    for done in range(0, HASH_BITS, LEVEL_BITS):
        narrowed = inside.withColumn("prefix", F.shiftright("h", HASH_BITS - done))
        inside = narrowed.join(state, ["__s", "prefix"]).drop("prefix")
        if done:  # the first level spans all rows of a source; later ones a 4096th
            inside = stored(inside, n_rows)
        sums = inside.groupBy("__s", F.shiftright("h", HASH_BITS - done - LEVEL_BITS).alias("prefix"), "below", "rest").agg(F.sum("size").alias("sum"))
        running = F.sum("sum").over(Window.partitionBy("__s").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0))
        sums = sums.withColumn("upto", F.col("below") + running)
        first = F.min(F.struct("prefix", (F.col("upto") - F.col("sum")).alias("below"), "upto", "rest"))
        state = stored(sums.filter("upto >= rest").groupBy("__s").agg(first.alias("x")).select("__s", "x.*"), n_sources)
        inside = inside.drop("below", "rest")
        state, last = state.drop("upto"), state
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("below")
    found = last.select("__s", F.when(nearer, F.col("prefix")).otherwise(F.col("prefix") - 1).alias("threshold"))
    return plan.join(found, "__s", "left").select("__s", "source_size", "target", "whole", F.coalesce("threshold", F.lit(-1).cast("long")).alias("threshold"))


def _plan(sized: DataFrame, weights, share: float, most: int):
    """Targets and thresholds by source of a stored table __s, source, size, h; broadcast if they are few."""
    sizes = sized.groupBy("__s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = stored(source_targets(sizes, weights, share, most))
    found = stored(thresholds(sized.select("__s", "size", "h"), targets), targets.count())
    few = found.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES
    return F.broadcast(found) if few else found


def _sized(df: DataFrame, id_col: str, text_col: str, source_col: str, seed: int):
    source = F.col(source_col).cast("string")
    return F.coalesce(F.concat(F.lit("="), source), F.lit("~")).alias("__s"), source.alias("source"), n_words(text_or_empty(text_col)).alias("size"), hash_unit(seed, F.col(id_col), F.col(text_col)).alias("h")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken: a row per document, with copies 0 to `most`."""
    rows = stored(df.select(F.col(id_col).alias("doc_id"), *_sized(df, id_col, text_col, source_col, seed)))
    out = rows.join(_plan(rows, weights, share, most), "__s")
    out = out.withColumn("copies", F.col("whole") + (F.col("h") <= F.col("threshold")).cast("long"))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 42) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    s, source, size, h = _sized(df, id_col, text_col, source_col, seed)
    plan = _plan(stored(df.select(s, source, size, h)), weights, share, most).select(F.col("__s").alias("__plan"), "whole", "threshold")
    plan = plan.select("__plan", F.struct("whole", "threshold").alias("__mix"))
    out = df.join(plan, s == F.col("__plan"))
    copies = (F.col("__mix.whole") + (h <= F.col("__mix.threshold")).cast("long")).cast("int")
    return out.withColumn("__copy", F.explode(F.array_repeat(F.lit(0), copies))).select(*[out[c] for c in df.columns])


def op6_hash_threshold_mix(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


ORACLE = """
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
        ('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '~') || ':' || coalesce(text, '~')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, cap / w) FROM l WHERE cap / w >= level), 'inf'::DOUBLE) * w) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS rest FROM p),
c AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
r AS (SELECT c.source, c.h, c.size, sum(c.size) OVER (PARTITION BY c.source ORDER BY c.h) AS upto FROM c),
b AS (SELECT q.source, arg_min(CASE WHEN upto - rest < rest - (upto - r.size) THEN r.h ELSE r.h - 1 END, r.h) AS threshold
      FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source WHERE rest > 0 AND upto >= rest GROUP BY q.source)
SELECT d.doc_id, d.size, q.source_size, round(q.target, 6) AS target, (d.size * (q.whole + (d.h <= coalesce(b.threshold, -1))::BIGINT))::BIGINT AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON q.source IS NOT DISTINCT FROM b.source
"""
