"""The six ways to normalise lines: rules, a candidate generator, a language model, and their orders."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ductus.functions import script
from ductus.operators import language_model, rules as rule_ops
from ductus.operators.rerank import best_of, rerank
from ductus.plans.store import stored
from ductus.sources.names import MODES

#: From lines (the key columns, text) to candidates (key, beam, text, score, n_tokens).
Generator = Callable[[DataFrame, list[str]], DataFrame]


CANDIDATES = "array<struct<beam:int,text:string,score:double,n_tokens:int>>"


class RowGenerator:
    """A generator whose candidates come from the text alone: normalise() then keeps each line where it is."""

    def candidates(self, text: Column) -> Column:
        """An array of beam, text, score and n_tokens; of a null text null."""
        raise NotImplementedError

    def __call__(self, lines: DataFrame, key: list[str]) -> DataFrame:
        found = lines.select(*key, F.explode(self.candidates(F.col("text")).cast(CANDIDATES)).alias("c"))
        return found.select(*key, "c.beam", "c.text", "c.score", "c.n_tokens")


class _Unchanged(RowGenerator):
    """The generator to use without a model: each line is its only candidate."""

    def candidates(self, text: Column) -> Column:
        return F.array(F.struct(F.lit(1).alias("beam"), text.alias("text"), F.lit(0.0).alias("score"), F.length(text).alias("n_tokens")))


unchanged = _Unchanged()


class NeuralGenerator(RowGenerator):
    """Candidates from a trained sequence model, one batch of lines at a time.

    load() is called once in each task and gives a function from texts to lists of (text, score, n_tokens) in
    falling order, e.g. a beam search of a network. Training one needs a deep-learning library, which this
    package doesn't have; load() raises where the model's own libraries are missing.
    """

    def __init__(self, load: Callable[[], Callable[[list[str]], list[list[tuple[str, float, int]]]]]):
        self.load = load

    def candidates(self, text: Column) -> Column:
        load = self.load

        @F.pandas_udf(CANDIDATES)
        def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            decode = load()
            for texts in parts:
                some = texts[texts.notna()]
                found = dict(zip(some.index, decode(some.tolist())))
                yield pd.Series([[dict(beam=i, text=t, score=s, n_tokens=n) for i, (t, s, n) in enumerate(found[k], 1)] if k in found else None for k in texts.index], dtype=object)

        return run.asNondeterministic()(text)


def beam_search(step: Callable[[list[int]], list[float]], width: int = 5, longest: int = 200, start: int = 1, end: int = 2, banned: tuple[int, ...] = (3,)) -> list[tuple[list[int], float]]:
    """The `width` best token lists by summed log probability. step: log probabilities after a prefix.

    Finished lists stay candidates as they are; ties keep the order of the candidates; it ends when all are finished.
    """
    beams: list[tuple[list[int], float, bool]] = [([start], 0.0, False)]
    for _ in range(longest):
        if all(done for *_, done in beams):
            break
        found = []
        for tokens, score, done in beams:
            if done:
                found.append((tokens, score, True))
                continue
            p = [(-float("inf") if i in banned else x, i) for i, x in enumerate(step(tokens))]
            for x, i in sorted(p, key=lambda e: -e[0])[:width]:
                found.append(([*tokens, i], score + x, i == end))
        beams = sorted(found, key=lambda e: -e[1])[:width]
    return [(tokens, score) for tokens, score, _ in beams]


def check(name: str, rules, generator, model) -> None:
    """Raises ValueError if a mode lacks what its steps need, or has an unknown name."""
    if name not in MODES.values():
        raise ValueError(f"unknown mode {name}")
    needs = {"rules": ("a dictionary", rules), "neural": ("a generator", generator), "lm": ("a language model", model)}
    missing = [what for step, (what, given) in needs.items() if step in name.split("+") and given is None]
    if missing:
        raise ValueError(f"mode {name} needs {' and '.join(missing)}")


def normalise(
    lines: DataFrame,
    mode: int | str,
    key: list[str],
    rules: list[tuple[str, str]] | None = None,
    generator: Generator | None = None,
    model: DataFrame | None = None,
    order: int = 5,
    lm_backend: str = "auto",
) -> DataFrame:
    """key, text, normalised: every line in a mode (number or name). Blank lines give an empty text.

    Steps are those of the mode's name in their order: rules, the generator's best candidate (with a language
    model: the best by its rank). A mode without what it needs is an error. lm_backend "none" leaves the model
    out, with a warning: then the first candidate wins; "auto" and "table" mean the model's table.

    Rows are told apart by a number, not by their keys, so keys may be null or repeat; a line for which the
    generator has no candidate stays as it was before that step.
    """
    name = MODES.get(mode, mode)
    if lm_backend not in ("auto", "table", "none"):
        raise ValueError(f"unknown language-model backend {lm_backend}")
    check(name, rules, generator, model)
    steps = name.split("+")
    ruled = lambda c: rule_ops.normalise(F.col(c), list(rules or []))
    now = lines.select(*key, F.col("text"), (ruled("text") if steps[0] == "rules" else F.col("text")).alias("__now"))
    if "neural" in steps:
        ranked = "lm" in steps and lm_backend != "none"
        if "lm" in steps and not ranked:
            warnings.warn(f"mode {name} without its language model", stacklevel=2)
        local = language_model.local_model(model, order) if ranked else None
        if isinstance(generator, RowGenerator) and (local or not ranked):
            now = _best_in_rows(now, generator, local)
        else:
            now = stored(now.withColumn("__row", F.monotonically_increasing_id()))
            row = ["__row"]
            nbest = generator(now.filter("__now IS NOT NULL").select(*row, F.col("__now").alias("text")), row)
            best = rerank(_with_lm(nbest, model, order), row) if ranked else rerank(nbest, row, lm=None)
            best = best.select("__row", F.col("text").alias("__best"))
            now = now.join(best, "__row", "left").withColumn("__now", F.coalesce("__best", "__now"))
        if steps[-1] == "rules":
            now = now.withColumn("__now", ruled("__now"))
    blank = script.strip(F.col("text")) == ""
    return now.select(*key, "text", F.when(blank, "").otherwise(F.col("__now")).alias("normalised"))


def _best_in_rows(now: DataFrame, generator: RowGenerator, local: language_model.LocalModel | None) -> DataFrame:
    """now with the best candidate as __now; a line without any keeps it. No row leaves its task."""
    found = generator.candidates(F.col("__now")).cast(CANDIDATES)
    now = now.withColumn("__c", F.when(F.col("__now").isNotNull(), found))
    if local is not None:
        now = language_model.with_scores(now, local, "__c", "__lm")
    return now.withColumn("__now", F.coalesce(best_of(F.col("__c"), None if local is None else F.col("__lm")), "__now")).drop("__c", "__lm")


def _with_lm(nbest: DataFrame, model: DataFrame, order: int) -> DataFrame:
    """Candidates with their log10 probability as `lm`."""
    kept = nbest.withColumnRenamed("score", "__score")
    return language_model.score(kept, model, order, kept.columns).withColumnRenamed("score", "lm").withColumnRenamed("__score", "score")
