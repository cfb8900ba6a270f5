"""Seeded augmentation: noise, swaps, substitution rules, and dictionary entries put into aligned lines.

A row's draws depend on the seed and its key alone, so any partitioning and any rerun gives the same text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ductus.functions import folds
from ductus.functions.draws import uniform

#: The characters that noise inserts.
NOISE = "ཀཁགངཅཆཇཉཏཐདནཔཕབམཙཚཛཝཞཟའཡརལཤསཧཨ་།༄༅ཱིེོྀུྭྱྲླ"
MAX_INJECTED = 10_000


def noise_probability(ratio: float) -> float:
    """ratio in per cent as a probability of 1 at most."""
    return min(ratio / 100, 1.0)


def with_noise(text: Column, key: Column, ratio: float = 5.0, alphabet: str = NOISE, seed: int = 42) -> Column:
    """After each character, with the noise probability, one character of the alphabet."""
    return folds.noisy(text, key, noise_probability(ratio), alphabet, seed)


def noise_copies(df: DataFrame, key: Column, copies: int = 1, ratio: float = 5.0, seed: int = 42, text: str = "text") -> DataFrame:
    """`copies` noisy versions of every row, numbered by `copy` from 1."""
    rows = df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies)))) if copies > 0 else df.withColumn("copy", F.lit(1)).limit(0)
    return rows.withColumn(text, with_noise(F.col(text), F.concat_ws("/", key, "copy"), ratio, seed=seed))


def with_swaps(text: Column, key: Column, chance: float = 0.1, segmented: bool = True, seed: int = 42) -> Column:
    """Neighbouring words (or syllables) swapped; the utterance mark stays at the end."""
    return folds.swapped(text, key, chance, segmented, seed)


def with_rules(text: Column, key: Column, letters: float = 0.2, syllables: float = 0.03, seed: int = 42) -> Column:
    """The substitution rules one after another, then syllables dropped or doubled."""
    if not 0 <= letters <= 1 or not 0 <= syllables <= 1:
        raise ValueError("ratios are from 0 to 1")
    return folds.rule_noised(text, key, letters, syllables, seed)


def inject_entries(lines: DataFrame, entries: DataFrame, segmented: bool = True, most: int = MAX_INJECTED, seed: int = 42, order: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """lines with `source` and `target`: an entry's abbreviation or expansion appended to drawn lines.

    entries: ord, abbrev, expansion. k = min(entries, most, lines) lines and k entries are drawn without
    replacement by hashed order; the lines in their order get the entries in drawn order. Both draws keep k
    rows (`most` is the feature's own limit), so only these are ranked in one task.
    """
    n = min(entries.limit(most).count(), most, lines.limit(most).count())
    key = F.concat_ws(":", *order)
    u = uniform(seed, F.lit("line"), key)
    drawn = lines.select(*order, u.alias("u")).orderBy("u", *order).limit(n)
    drawn = drawn.select(*order, F.row_number().over(Window.orderBy(*order)).alias("rank"))
    v = uniform(seed, F.lit("entry"), F.col("ord"))
    taken = entries.select("ord", "abbrev", "expansion", v.alias("v")).orderBy("v", "ord").limit(n)
    taken = taken.select("abbrev", "expansion", F.row_number().over(Window.orderBy("v", "ord")).alias("rank"))
    pairs = drawn.join(taken, "rank").drop("rank")
    space = " " if segmented else ""
    out = lines.join(F.broadcast(pairs), list(order), "left")  # k rows at most
    put = lambda c: F.when(F.col(c).isNotNull(), F.concat("text", F.lit(space), c)).otherwise(F.col("text"))
    return out.select(*lines.columns, put("abbrev").alias("source"), put("expansion").alias("target"))
