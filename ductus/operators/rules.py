"""Rules mode: abbreviations expanded from a dictionary, then punctuation and spacing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductus.functions import folds, script

#: Dictionaries are read to the driver and sent with the function; they are hand-made lists of some thousand entries.
MAX_RULES = 1_000_000


def ordered_rules(rules: DataFrame) -> list[tuple[str, str]]:
    """The (abbrev, expansion) pairs of a dictionary in the order of `rank`; raises ValueError beyond MAX_RULES."""
    found = rules.orderBy("rank").select("abbrev", "expansion").limit(MAX_RULES + 1).collect()
    if len(found) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    return [(r.abbrev, r.expansion) for r in found]


def expand(text: Column, rules: list[tuple[str, str]]) -> Column:
    """One replacement after another in Arrow batches; for a handful of rules, nested built-in replacements."""
    if len(rules) > 32:
        return folds.expanded(text, rules)
    for abbreviation, expansion in rules:
        text = F.replace(text, F.lit(abbreviation), F.lit(expansion))
    return text


def normalise(text: Column, rules: list[tuple[str, str]], shads: tuple[str, ...] = script.MODE_SHADS) -> Column:
    """Expansion, then punctuation."""
    return script.fix_punctuation(expand(text, rules), shads)


def postprocess(df: DataFrame, rules: list[tuple[str, str]], text: str = "text") -> DataFrame:
    """Adds `normalised` and `changes` (type, from, to, count), as for files of finished predictions."""
    out = df.withColumn("__x", folds.postprocessed(F.col(text), rules, script.FILE_SHADS))
    return out.withColumn("normalised", F.col("__x.normalised")).withColumn("changes", F.col("__x.changes")).drop("__x")
