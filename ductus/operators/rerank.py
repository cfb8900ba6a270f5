"""Choosing among candidates by length-normalised score and language model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH_PENALTY = 0.6
LM_WEIGHT = 0.2


def _value(score: Column, n_tokens: Column, lm: Column, penalty: float, weight: float) -> Column:
    length = F.when(n_tokens > 0, F.pow(n_tokens.cast("double"), F.lit(penalty))).otherwise(1.0)
    return score / length + weight * F.coalesce(lm, F.lit(0.0))


def best_of(candidates: Column, lm: Column | None, penalty: float = LENGTH_PENALTY, weight: float = LM_WEIGHT) -> Column:
    """The text that rerank() chooses, of an array of a line's candidates and one of their language-model scores."""
    if lm is None:
        ranked = F.transform(candidates, lambda c: F.struct((-c["beam"]).alias("order"), c["text"].alias("text")))
    else:
        ranked = F.transform(candidates, lambda c, i: F.struct(_value(c["score"], c["n_tokens"], F.get(lm, i), penalty, weight).alias("value"), (-c["beam"]).alias("order"), c["text"].alias("text")))
    return F.array_max(ranked)["text"]


def rerank(nbest: DataFrame, key: list[str], lm: str | None = "lm", penalty: float = LENGTH_PENALTY, weight: float = LM_WEIGHT) -> DataFrame:
    """key, beam, text: the best candidate of each key.

    nbest: key, beam (from 1, by falling score), text, score, n_tokens (without specials), and lm. With lm the rank
    is score / n_tokens^penalty + weight lm, ties to the earlier beam; without, the first beam wins and lengths
    don't count.
    """
    if lm is None:
        best = F.max(F.struct((-F.col("beam")).alias("order"), "beam", "text"))
    else:
        value = _value(F.col("score"), F.col("n_tokens"), F.col(lm), penalty, weight)
        best = F.max(F.struct(value.alias("value"), (-F.col("beam")).alias("order"), "beam", "text"))
    return nbest.groupBy(*key).agg(best.alias("b")).select(*key, "b.beam", "b.text")
