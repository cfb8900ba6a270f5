"""Evaluation and run reports, as JSON rows and as text."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ductus.operators.evaluate import METRICS


def evaluation_json(metrics: DataFrame, intervals: DataFrame | None = None, seconds: float = 0.0, iterations: int = 1000, **about: object) -> DataFrame:
    """One row `value`: the evaluation as a JSON document. metrics: one row; intervals: a row a metric."""
    counts = ("total_errors", "correctly_corrected", "identified_errors")
    parts = [F.lit(v).alias(k) for k, v in about.items()]
    parts += [F.col("n").alias("samples_evaluated"), F.lit(seconds).alias("evaluation_time_seconds"), F.struct(*METRICS, *counts).alias("metrics")]
    if intervals is not None:
        bounds = {r.metric: r for r in intervals.limit(len(METRICS)).collect()}
        each = [F.struct(F.lit(bounds[m].lower).alias("lower"), F.lit(bounds[m].upper).alias("upper")).alias(m) for m in METRICS if m in bounds]
        parts.append(F.struct(F.lit(iterations).alias("n_iterations"), *each).alias("bootstrap_cis_95"))
    return metrics.select(F.to_json(F.struct(*parts)).alias("value"))


def evaluation_text(row: Row, intervals: dict[str, tuple[float, float]] | None = None, examples: list[Row] = (), seconds: float = 0.0) -> str:
    """A report of one row of metrics, in per cent with half widths, and example lines."""
    out = ["EVALUATION REPORT", "=" * 60, f"Samples evaluated: {row.n}", ""]
    for m in METRICS:
        line = f"{m.replace('_', ' ').title():<24}{100 * row[m]:8.2f}%"
        if intervals and m in intervals:
            low, high = intervals[m]
            line += f"  ± {(high - low) * 50:.2f}  [{100 * low:.2f}, {100 * high:.2f}]"
        out.append(line)
    out += ["", f"Total errors: {row.total_errors}", f"Correctly corrected: {row.correctly_corrected}", f"Identified errors: {row.identified_errors}"]
    if seconds > 0:
        out.append(f"Speed: {row.n / seconds:.2f} samples/second")
    for i, e in enumerate(examples, 1):
        out += ["", f"Example {i}", f"  Source:     {e.source}", f"  Target:     {e.target}", f"  Prediction: {e.hypothesis}"]
    return "\n".join(out) + "\n"


def run_text(mode: str, lines: int, seconds: float, settings: dict[str, object]) -> str:
    """A report of a run over lines."""
    speed = lines / seconds if seconds else 0.0
    return "\n".join(["INFERENCE REPORT", "=" * 60, f"Mode: {mode}", *(f"{k}: {v}" for k, v in settings.items()), f"Lines: {lines}", f"Total time: {seconds:.2f}s", f"Speed: {speed:.2f} lines/second"]) + "\n"


def model_json(statistics: DataFrame, oov: DataFrame, model: DataFrame, seconds: float = 0.0, **about: object) -> DataFrame:
    """One row `value`: a language model's report as JSON. statistics: lines, tokens, tokens_per_line; oov: tokens, oov, rate."""
    sizes = model.groupBy("n").agg(F.count(F.lit(1)).alias("ngrams"))
    grams = sizes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("n").cast("string"), "ngrams")))).alias("ngrams"))
    parts = [F.lit(v).alias(k) for k, v in about.items()]
    corpus = F.struct("lines", "tokens", "tokens_per_line").alias("corpus")
    known = oov.select(F.struct(F.col("tokens").alias("validation_tokens"), "oov", F.col("rate").alias("oov_rate")).alias("validation"))
    return statistics.select(corpus).crossJoin(known).crossJoin(grams).select(F.to_json(F.struct(*parts, F.lit(seconds).alias("training_time_seconds"), "corpus", "validation", "ngrams")).alias("value"))


def _titled(title: str, rows: dict[str, object]) -> str:
    return "\n".join([title, "=" * 60, *(f"{k}: {v}" for k, v in rows.items())]) + "\n"


def model_text(order: int, corpus: Row, oov: Row, sizes: dict[int, int], seconds: float = 0.0) -> str:
    """A report of a language model: its corpus, its n-grams by order, unknown characters of a validation set."""
    rows = {"Order": order, "Lines": corpus.lines, "Tokens": corpus.tokens, "Tokens per line": f"{corpus.tokens_per_line or 0:.2f}"}
    rows |= {f"{n}-grams": k for n, k in sorted(sizes.items())}
    return _titled("LANGUAGE MODEL REPORT", rows | {"Validation tokens": oov.tokens, "Unknown": f"{oov.oov} ({100 * (oov.rate or 0):.2f}%)", "Total time": f"{seconds:.2f}s"})


def training_report(epochs: list[tuple[float, float]], settings: dict[str, object], seconds: float = 0.0) -> tuple[str, str]:
    """(JSON, text) of a training run, from its (training, validation) losses by epoch."""
    best = min(range(len(epochs)), key=lambda i: epochs[i][1], default=None)
    found = {"settings": settings, "epochs": [{"epoch": i, "train_loss": a, "val_loss": b} for i, (a, b) in enumerate(epochs, 1)], "training_time_seconds": seconds}
    found |= {"best_epoch": None if best is None else best + 1, "best_val_loss": None if best is None else epochs[best][1]}
    rows = {**settings, **{f"Epoch {i}": f"train {a:.4f}, validation {b:.4f}" for i, (a, b) in enumerate(epochs, 1)}}
    if best is not None:
        rows["Best"] = f"epoch {best + 1}, validation {epochs[best][1]:.4f}"
    return json.dumps(found, ensure_ascii=False), _titled("TRAINING REPORT", rows | {"Total time": f"{seconds:.2f}s"})


def examples(df: DataFrame, n: int = 10, seed: int = 42, key: str = "line_no") -> DataFrame:
    """n rows by hashed key: a sample that a rerun repeats."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))).limit(n)
