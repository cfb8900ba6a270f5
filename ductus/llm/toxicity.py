"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insults (with a weight), threats, targets, negations, reporting words, clause ends and
the rest. Five transducers read them: insult, threat, target, negation and reported speech. Their composition
is one deterministic automaton that goes through a clause, and at the clause's end gives its score: an
insult's weight, raised when it is aimed at someone, a threat only when it is aimed at someone, both lowered by a
negation shortly before and by reported speech. A document's score is a logistic function of what its matched
clauses add up to, not of single words anywhere.

The insults are learned from labelled documents: words and word beginnings that toxic training documents hold
far more often than the others. They come from a bounded sample of labelled documents (MAX_LABELLED, those with
the smallest hashed ids); of it every form is counted, and only those that min_share of the toxic documents hold
come to the driver, of which there are 1 / min_share times the forms of a mean document at most. The scoring covers
every document.

Defined cases: a null text counts as empty and gets the score of a document without clauses; documents without
a label, and labels without a document, are fine; a null label is no label; an id with both labels is toxic; of
rows that share an id, the text with the least hash is learned from; without any toxic training row the lexicon
is empty and only threats match; repeated rows repeat; an empty table gives an empty table; other
columns of the input are not looked at.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ductus.llm.common import stored, text_or_empty

#: The most labelled documents the lexicon and the weights are learned from.
MAX_LABELLED = 20_000
#: Tasks that share the labelled documents.
LEARNERS = 12
PREFIXES = range(3, 11)
#: Words whose symbols a task remembers.
REMEMBERED = 400_000

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
CLAUSE_END = re.compile(r"[.!?;:]+$|^\|$")

#: English, French, German and Spanish words of each kind.
WORDS = {
    THREAT: "kill killing hurt harm destroy beat smash shoot stab burn hang murder strangle crush punch tuer tuerai frapper détruire brûler massacrer umbringen töten schlagen verprügeln vernichten matar mataré golpear destruir quemar".split(),
    TARGET: "you your you're youre yours yourself u ur he she him her they them these those people tu toi te vous ton ta tes votre vos lui eux du dich dir dein deine ihr euch euer sie ihn ihm usted ustedes tú ti tus vosotros ellos ellas él".split(),
    NEGATION: "not no never neither nor without isn't aren't wasn't don't doesn't didn't won't can't cannot ain't ne pas jamais aucun sans nicht kein keine keinen nie niemals ohne nunca ni sin tampoco jamás".split(),
    REPORT: "said says say told called calls claimed claims quoted quote wrote writes reported according alleged dit disait déclaré écrit selon sagte sagt schrieb behauptet laut zitiert dijo dice escribió según afirmó".split(),
}
#: How far, in words, a negation or a target reaches.
REACH = 4


def normal(word: str) -> str:
    """A word in lower case without what stands around its letters."""
    return EDGES.sub("", word.lower().replace("\u2019", "'"))


@dataclass(frozen=True)
class Weights:
    """Of the clause patterns, as multiples of an insult's own weight (threat: in the same unit)."""

    aimed: float = 1.5
    threat: float = 3.0
    negated: float = 0.5
    denied: float = 0.1  # a negated threat
    reported: float = 0.6


@dataclass
class Transducer:
    """A deterministic transducer over symbols: step(state, symbol) -> (state, output)."""

    start: int
    states: int
    step: object


def _within(trigger: int) -> Transducer:
    """State: words left in which the trigger still reaches. Output: 1 while it does."""
    return Transducer(0, REACH + 1, lambda s, x: (0 if x == END else REACH if x == trigger else max(0, s - 1), int(s > 0)))


def _seen(trigger: int) -> Transducer:
    """State and output: whether the clause has had the trigger."""
    return Transducer(0, 2, lambda s, x: (0 if x == END else int(s or x == trigger), int(s or x == trigger)))


#: In this order: insult, threat, target (seen in the clause), negation (in reach), reported speech (seen).
GRAMMAR = (_seen(INSULT), _seen(THREAT), _seen(TARGET), _within(NEGATION), _seen(REPORT))


@dataclass
class Automaton:
    """The composition: next state and outputs by state and symbol."""

    next: list[list[int]] = field(default_factory=list)
    outputs: list[list[tuple[int, ...]]] = field(default_factory=list)


def compose(parts: tuple[Transducer, ...] = GRAMMAR) -> Automaton:
    """The product of the transducers, over the states that can be reached."""
    start = tuple(t.start for t in parts)
    number, todo, out = {start: 0}, [start], Automaton()
    for state in todo:
        row, said = [], []
        for symbol in range(END + 1):
            moves = [t.step(s, symbol) for t, s in zip(parts, state)]
            target = tuple(m[0] for m in moves)
            if target not in number:
                number[target] = len(number)
                todo.append(target)
            row.append(number[target])
            said.append(tuple(m[1] for m in moves))
        out.next.append(row)
        out.outputs.append(said)
    return out


class Grammar:
    """Scores the clauses of texts with a lexicon of insults: {word or beginning + "*": weight}."""

    def __init__(self, lexicon: dict[str, float], weights: Weights = Weights()):
        self.lexicon, self.weights = lexicon, weights
        self.fixed = {w: kind for kind, words in WORDS.items() for w in words}
        self.automaton = compose()
        self.known: dict[str, tuple[int, float, bool]] = {}

    def symbol(self, token: str) -> tuple[int, float, bool]:
        """A token's symbol, weight, and whether it ends its clause."""
        word = normal(token)
        ends = bool(CLAUSE_END.search(token))
        weight = self.lexicon.get(word, 0.0)
        for n in PREFIXES:
            if len(word) < n:
                break
            weight = max(weight, self.lexicon.get(word[:n] + "*", 0.0))
        if weight > 0:
            return INSULT, weight, ends
        return self.fixed.get(word, OTHER), 0.0, ends

    def clauses(self, text: str) -> tuple[list[float], int]:
        """The scores of the matched clauses of a text, and its number of words."""
        words = text.split()
        known = self.known
        try:
            marks = [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = self.symbol(w)
            marks = [known[w] for w in words]
        if not any(m[0] in (INSULT, THREAT) for m in set(marks)):
            return [], len(words)
        found, state, w = [], 0, self.weights
        step, said = self.automaton.next, self.automaton.outputs
        total, worst, out = 0.0, 0.0, (0, 0, 0, 0, 0)  # of insults, and the worst threat

        def close() -> None:
            nonlocal total, worst
            insult, threat, target, _, reported = out
            score = total * (w.aimed if target and insult else 1.0) + (worst if threat and target else 0.0)
            if score > 0:
                found.append(score * (w.reported if reported else 1.0))
            total = worst = 0.0

        for symbol, weight, ends in marks:
            out = said[state][symbol]
            if symbol == INSULT:
                total += weight * (w.negated if out[3] else 1.0)
            elif symbol == THREAT:
                worst = max(worst, w.threat * (w.denied if out[3] else 1.0))
            state = step[state][symbol]
            if ends:
                close()
                state, out = step[state][END], (0, 0, 0, 0, 0)
        close()
        return found, len(words)


def features(found: list[float], n_words: int) -> list[float]:
    """1, log of the clauses' sum, the greatest clause, matched clauses per hundred words (at most 10)."""
    total = sum(found)
    return [1.0, float(np.log1p(total)), max(found, default=0.0), min(10.0, 100.0 * len(found) / max(n_words, 1)), float(bool(found))]


def _document_frequencies(only: frozenset | None):
    """Map side of document frequencies of words and beginnings of texts; only: count just these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        seen: dict[str, tuple[str, ...]] = {}

        def forms(token: str) -> tuple[str, ...]:
            word = normal(token)
            out = (word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)) if word else ()
            return out if only is None else tuple(x for x in out if x in only)

        for batch in batches:
            for x in batch.column(0):
                tokens = set(x.as_py().split())
                if len(seen) > REMEMBERED:
                    seen.clear()
                for t in tokens:
                    if t not in seen:
                        seen[t] = forms(t)
                counts.update(set(itertools.chain.from_iterable(map(seen.__getitem__, tokens))))
        items = list(counts.items())
        for i in range(0, len(items), 10_000):
            k, v = zip(*items[i : i + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(v, pa.int64())], ["form", "n"])

    return run


@dataclass
class Model:
    lexicon: dict[str, float]
    coefficients: np.ndarray
    weights: Weights = Weights()


def learn_lexicon(labelled: DataFrame, min_documents: int = 4, min_share: float = 0.015, min_ratio: float = 20.0) -> dict[str, float]:
    """Weights (log odds) of words and beginnings of a stored table text, toxic.

    A form is an insult if enough toxic texts hold it (min_documents and min_share of them) and their rate is
    min_ratio times that of the other texts. A beginning counts only if it has clearly more texts than any
    one of its continuations, else the continuation stands for it; what a chosen beginning covers is left out.
    """
    n = dict(labelled.groupBy("toxic").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1:
        return {}

    def counted(rows: DataFrame, only: frozenset | None) -> DataFrame:
        return rows.select("text").mapInArrow(_document_frequencies(only), "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))

    # A little below min_share too, for the continuations.
    toxic = counted(labelled.filter("toxic = 1"), None).filter((F.col("n") >= min_documents) & (F.col("n") >= 0.8 * min_share * n1))
    ones = dict(toxic.collect())
    zeros = dict(counted(labelled.filter("toxic = 0"), frozenset(ones)).collect())
    widest: dict[str, int] = {}  # the documents of a beginning's largest continuation
    for form, a in ones.items():
        for k in PREFIXES:
            if k < len(form) - form.endswith("*") or k == len(form) and not form.endswith("*"):
                widest[form[:k] + "*"] = max(a, widest.get(form[:k] + "*", 0))
    out: dict[str, float] = {}
    for form in sorted(ones, key=lambda f: (len(f.rstrip("*")), not f.endswith("*"), f)):
        a, b = ones[form], zeros.get(form, 0)
        ratio = (a + 0.5) / (n1 + 1) / ((b + 0.5) / (n0 + 1))
        if a < min_share * n1 or ratio < min_ratio or 5 * widest.get(form, 0) >= 4 * a:
            continue
        word = form.rstrip("*")
        if not any(word[:k] + "*" in out for k in PREFIXES if k <= len(word)):
            out[form] = float(np.log(ratio))
    return out


def fit(rows: np.ndarray, labels: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a logistic regression by Newton's method; the first column is the constant."""
    beta = np.zeros(rows.shape[1])
    penalty = np.full(rows.shape[1], ridge)
    penalty[0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ beta, -30, 30)))
        step = np.linalg.solve(rows.T @ (rows * (p * (1 - p))[:, None]) + np.diag(penalty), rows.T @ (labels - p) - penalty * beta)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


def labelled_texts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """text and toxic of the sample: one row an id, however often documents or labels have it."""
    chosen = labels.filter("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    found = df.select(F.col(id_col).alias("__doc"), text_or_empty(text_col).alias("text"))
    chosen = chosen.orderBy(F.xxhash64(F.lit(7), "__id"), "__id").limit(max_labelled)  # two numbers each
    rows = found.join(F.broadcast(chosen), F.col("__doc") == F.col("__id"))
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text"))
    return rows.groupBy("__id", "toxic").agg(one.alias("text")).select("text", "toxic")


def learn(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> Model:
    """A model from the documents with a label toxic 0 or 1 (labels: doc_id, toxic)."""
    labelled = stored(labelled_texts(df, labels, id_col, text_col, max_labelled).repartition(LEARNERS))
    lexicon = learn_lexicon(labelled)
    grammar = Grammar(lexicon)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(*grammar.clauses(x.as_py())) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], ["x", "toxic"])

    data = labelled.mapInArrow(measure, "x array<double>, toxic int").collect()  # max_labelled rows at most, five numbers each
    if len({r.toxic for r in data}) < 2:
        return Model(lexicon, np.array([-3.0, 1.0, 0.5, 0.1, 1.0]))
    return Model(lexicon, fit(np.array([r.x for r in data]), np.array([r.toxic for r in data], float)))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_clauses (matched) of whole texts."""
    lexicon, beta, weights = model.lexicon, model.coefficients.tolist(), model.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, b = Grammar(lexicon, weights), np.array(beta)
        for batch in batches:
            rows, n = [], []
            for x in batch.column(1):
                found, words = grammar.clauses(x.as_py())
                rows.append(features(found, words))
                n.append(len(found))
            z = np.array(rows).reshape(-1, len(b)) @ b
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30)))), pa.array(n, pa.int64())], ["doc_id", "score", "n_clauses"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, n_clauses long")


def op10_pattern_grammar(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out))
    out = score(docs, model)
    return out.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_clauses")
