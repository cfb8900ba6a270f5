"""Quality rules with host-level verdicts (DataFrame functions only).

Every document gets counts and rule failures. The failures are summed by host, each host's failure
rate is shrunk towards the corpus by a beta prior fitted to all hosts, and hosts whose shrunk rate is
high get a verdict that is joined back: on such hosts a document must pass every rule, elsewhere only
the base rules.

Defined cases: a null text counts as empty and fails the base; a null host is a host of its own; the
same row twice is judged twice; an empty table gives an empty table; columns of the input other than
the three that are named are not looked at, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import GAP, stored, text_or_empty

SYMBOL = "[#*$%&|<>]"
#: Hosts up to this number are broadcast (under 100 bytes each); beyond it the join is shuffled.
MAX_BROADCAST_HOSTS = 100_000


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts.

    Repeated windows are found inside the row: a document whose windows are all distinct ends with a
    hash-set test; any other sorts its windows' 64-bit hashes (a text of a million words has a false
    pair with a chance under 1e-7), marks those equal to a neighbour and measures the union of the
    marked spans. Nothing is exploded, so no word crosses the network.
    """
    text = F.col("__text")
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(host_col).cast("string").alias("host"), text_or_empty(text_col).alias("__text"))
    rows = rows.withColumn("__words", words)
    rows = rows.withColumn("n_words", F.size("__words").cast("long"))
    w = F.col("__words")
    windows = F.when(
        F.col("n_words") >= 3,
        F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2])),
    ).otherwise(F.array().cast("array<bigint>"))
    rows = rows.withColumn("__h", windows)
    h = F.col("__h")
    distinct = F.size(F.array_distinct(h)) == F.size(h)
    rows = rows.withColumn("__sorted", F.when(~distinct, F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    s = F.col("__sorted")
    last = F.size(s) - 1
    marked = F.transform(
        s,
        lambda x, k: F.when(((k > 0) & (x["h"] == s[F.greatest(k - 1, F.lit(0))]["h"])) | ((k < last) & (x["h"] == s[F.least(k + 1, last)]["h"])), x["i"]),
    )
    rows = rows.withColumn("__places", F.sort_array(F.array_compact(marked)))
    p = F.col("__places")
    covered = F.aggregate(
        p,
        F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, x: F.struct((x + 2).alias("end"), (a["n"] + F.least(x + 2 - a["end"], F.lit(3))).alias("n")),
        lambda a: a["n"],
    )
    lines = F.filter(F.split(text, "\n"), lambda x: F.ltrim(x, F.lit(" \t\x0b\f\r")) != "")
    rows = rows.withColumn("__lines", lines)
    counts = F.struct(
        F.col("n_words"),
        F.length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.when(text.rlike(SYMBOL), F.regexp_count(text, F.lit(SYMBOL))).otherwise(0).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    # One row each: a generator keeps filters above from being pushed down, which would copy these expressions.
    return rows.select("doc_id", "host", F.explode(F.array(counts)).alias("c")).select("doc_id", "host", "c.*")


def failures(counts: DataFrame, min_words: int = 50) -> DataFrame:
    """Adds base_failed, and rule_failed for the softer rules that count on bad hosts."""
    words = F.col("n_words")
    base = (words < min_words) | (100 * F.col("n_repeat_words") > 50 * words)
    soft = (
        base
        | (10 * F.col("n_symbols") > words)
        | (F.col("word_chars") < 2 * words)
        | (F.col("word_chars") > 15 * words)
        | (100 * F.col("n_repeat_words") > 30 * words)
    )
    return counts.withColumn("base_failed", base).withColumn("rule_failed", soft)


def host_verdicts(judged: DataFrame, max_rate: float = 0.5) -> DataFrame:
    """A stored table, one row a host: n, failed, prior a and b, shrunk rate, bad.

    The prior is fitted by moments to the hosts' rates, weighted by their documents: with mean m and
    variance v of the rates, a + b = m(1-m)/v - 1 (kept within 1 to 10,000; without variance 10,000).
    Its two sums are exact integers but for the squares, so reruns agree.
    """
    hosts = judged.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("rule_failed").cast("long")).alias("failed"))
    rate = F.col("failed") / F.col("n")
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"),
        (F.sum("failed") / F.sum("n")).alias("m"),
        F.round(F.sum(F.col("n") * rate * rate) / F.sum("n") - F.pow(F.sum("failed") / F.sum("n"), 2), 12).alias("v"),
    )
    n_hosts, m, v = moments.first()  # the last two null for an empty table
    strength = max(1.0, min(10000.0, m * (1 - m) / v - 1)) if m is not None and v > 0 else 10000.0
    a, b = (m or 0.0) * strength, (1 - (m or 0.0)) * strength
    shrunk = (F.col("failed") + a) / (F.col("n") + a + b)
    return stored(hosts.withColumn("rate", shrunk).withColumn("bad", shrunk > max_rate), n_hosts)


def _with_verdicts(judged: DataFrame, hosts: DataFrame) -> DataFrame:
    """judged with host_rate, host_bad and kept, from a stored table of verdicts."""
    few = hosts.limit(MAX_BROADCAST_HOSTS + 1).count() <= MAX_BROADCAST_HOSTS
    h = hosts.select(F.col("host").alias("__host"), F.col("rate").alias("host_rate"), F.col("bad").alias("host_bad"))
    out = judged.join(F.broadcast(h) if few else h, F.col("host").eqNullSafe(F.col("__host"))).drop("__host")
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_bad") & F.col("rule_failed")))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """Counts, base_failed, rule_failed, the host's shrunk rate and verdict, and kept, a row per document."""
    judged = stored(failures(base_counts(df, id_col, text_col, host_col)))
    return _with_verdicts(judged, host_verdicts(judged, max_rate))


def op3_host_quality(spark, sf_dir: str) -> DataFrame:
    out = quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("host_rate", 9).alias("host_rate"))


def filter_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5) -> DataFrame:
    """The documents that are kept, with all their columns.

    They are counted once and stored with what the verdict needs, since the hosts' verdicts come from all of them.
    """
    rows = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("__row"), F.col(text_col).alias("__t"), F.col(host_col).alias("__h"))
    judged = stored(failures(base_counts(rows, "__row", "__t", "__h")).select("doc_id", "host", "base_failed", "rule_failed"))
    return _with_verdicts(judged, host_verdicts(judged, max_rate)).filter("kept").select("doc_id.*")


ORACLE = """
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
c AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
base AS (SELECT row_number() OVER () AS r, * FROM c),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i+1], w[i+2]) AS n FROM (SELECT b.r, unnest(range(1, len(b.w) - 1)) AS i, b.w FROM base b WHERE len(b.w) >= 3)),
cov AS (SELECT r, count(DISTINCT p)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM g WHERE n >= 2) GROUP BY r),
f AS (SELECT b.doc_id, b.host, len(b.w)::BIGINT AS n_words, length(array_to_string(b.w, ''))::BIGINT AS word_chars,
        (length(b.text) - length(translate(b.text, '#*$%&|<>', '')))::BIGINT AS n_symbols,
        (len(b.l) - len(list_distinct(b.l)))::BIGINT AS n_dup_lines, coalesce(cov.n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM base b LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        n_words < 50 OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_repeat_words > 30 * n_words AS rule_failed FROM f),
hosts AS (SELECT host, count(*) AS n, sum(rule_failed::INT) AS failed FROM j GROUP BY host),
mm AS (SELECT sum(failed)::DOUBLE / sum(n) AS m, round(sum(n * (failed::DOUBLE / n) * (failed::DOUBLE / n)) / sum(n) - pow(sum(failed)::DOUBLE / sum(n), 2), 12) AS v FROM hosts),
p AS (SELECT m, CASE WHEN v > 0 THEN greatest(1.0, least(10000.0, m * (1 - m) / v - 1)) ELSE 10000.0 END AS s FROM mm),
hv AS (SELECT host, (failed + m * s) / (n + m * s + (1 - m) * s) AS host_rate FROM hosts, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (host_rate > 0.5 AND rule_failed) AS kept, round(host_rate, 9) AS host_rate
FROM j JOIN hv ON j.host IS NOT DISTINCT FROM hv.host
"""
