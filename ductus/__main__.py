"""Command line: python -m ductus COMMAND INPUT OUTPUT [options]; spark-submit takes the same."""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductus.functions import script
from ductus.operators import augment, clean, evaluate, language_model, rules, tokenise, vocab
from ductus.operators.lines import align, contiguous_split
from ductus.plans import network, training
from ductus.plans.modes import NeuralGenerator, beam_search, check, normalise
from ductus.plans.store import stored
from ductus.sources import arpa, dictionaries, reports
from ductus.sources.names import MODES
from ductus.sources.text import first_lines, read_lines, write_lines

KEY = ["file", "line_no"]


def _place():
    return F.concat_ws(":", *KEY)


def _reflow(lines, a):
    if a.whole:  # all files in their order as one text
        whole = lines.select(F.lit("").alias("all"), F.struct(*KEY).alias("line_no"), "text")
        return clean.reflow(whole, "all", a.shortest, a.longest, a.segmented)
    return clean.reflow(lines, "file", a.shortest, a.longest, a.segmented)


def _noise(lines, a):
    return augment.noise_copies(lines, _place(), a.copies, a.ratio, a.seed)


def _swap(lines, a):
    return lines.withColumn("text", augment.with_swaps(F.col("text"), _place(), a.chance, a.segmented, a.seed))


def _rules(lines, a):
    return lines.withColumn("text", augment.with_rules(F.col("text"), _place(), a.letters, a.syllables, a.seed))


def _dictionary(spark, path: str):
    return rules.ordered_rules(dictionaries.rules(read_lines(spark, path))) if path else None


def _generator(path: str, vocabulary: str, heads: int, width: int):
    """Candidates of a network in an .npz file; vocabulary: a text file of characters, the first one number 4."""
    if not path:
        return None
    with open(vocabulary, encoding="utf-8") as f:
        chars = [line.rstrip("\n") for line in f]

    def load():
        net = network.Network(network.load(path), heads)
        ids = {c: i for i, c in enumerate(chars, 4)}
        shown = dict(enumerate(chars, 4))

        def decode(texts):
            found = [beam_search(net.step([1, *(ids.get(c, 3) for c in t), 2]), width) for t in texts]
            return [[(network.shown(tokens, shown), score, len(tokens) - 2) for tokens, score in beams] for beams in found]

        return decode

    return NeuralGenerator(load)


def _normalise(lines, a):
    spark = lines.sparkSession
    mode = MODES.get(int(a.mode), a.mode) if str(a.mode).isdigit() else a.mode
    check(mode, a.dictionary or None, a.model or None, a.lm or None)
    model = arpa.parse(read_lines(spark, a.lm)) if a.lm else None
    order = int(model.agg(F.max("n")).first()[0] or 1) if model is not None else 1
    lines = lines.withColumn("text", script.strip(F.col("text"))).filter("text <> ''")
    out = normalise(lines, mode, KEY, _dictionary(spark, a.dictionary), _generator(a.model, a.vocabulary, a.heads, a.beams), model, order, a.backend)
    return out.select(*KEY, F.col("normalised").alias("text"))


def _postprocess(lines, a):
    return rules.postprocess(lines, _dictionary(lines.sparkSession, a.dictionary) or []).select(*KEY, F.col("normalised").alias("text"))


def _inject(lines, a):
    entries = dictionaries.pairs(read_lines(lines.sparkSession, a.dictionary))
    out = augment.inject_entries(lines, entries, not a.joined, a.most, a.seed, tuple(KEY))
    return out.select(*KEY, F.col(a.side).alias("text"))


def _tokenise(lines, a):
    words = [r.text for r in read_lines(lines.sparkSession, a.words, strip=True, drop_blank=True).limit(rules.MAX_RULES).collect()] if a.words else []
    return tokenise.tokenise(lines, tokenise.LongestMatch(words)).select(*KEY, F.col("tokenised").alias("text"))


def _evaluate(lines, a):
    """lines: the targets; the report as JSON."""
    spark, began = lines.sparkSession, time.time()
    part = lambda path, name: read_lines(spark, path, strip=True).select("line_no", F.col("text").alias(name))
    rows = align(lines.select("line_no", script.strip(F.col("text")).alias("target")), part(a.predictions, "hypothesis"))
    rows = align(rows, part(a.source, "source")) if a.source else rows
    stats = evaluate.line_statistics(first_lines(rows, a.most or None, ["line_no"]), source="source" if a.source else None)
    intervals = evaluate.bootstrap_intervals(stats, "line_no", a.iterations, seed=a.seed) if a.iterations else None
    out = reports.evaluation_json(evaluate.metrics(stats), intervals, time.time() - began, a.iterations, test_tgt=a.input, predictions_file=a.predictions)
    return out.withColumnRenamed("value", "text")


def _lm(lines, a):
    model = language_model.estimate(lines, a.order)
    return arpa.render(model)


def _score(lines, a):
    model = arpa.parse(read_lines(lines.sparkSession, a.lm))
    order = int(model.agg(F.max("n")).first()[0] or 1)
    return language_model.score(lines, model, order, KEY).select(*KEY, F.col("score").cast("string").alias("text"))


def _vocabulary(lines, a):
    return vocab.build(lines).filter("idx > 3").select(F.col("idx").alias("line_no"), F.col("ch").alias("text"))


def _train(lines, a) -> None:
    """Trains a network on aligned lines; the output folder gets best.npz, vocabulary.txt and two reports."""
    spark, began = lines.sparkSession, time.time()
    target = read_lines(spark, a.target).select("line_no", script.strip(F.col("text")).alias("target"))
    rows = align(lines.select("line_no", script.strip(F.col("text")).alias("source")), target)
    ids = vocab.as_map(vocab.build(rows.select(F.explode(F.array("source", "target")).alias("text"))))
    coded = contiguous_split(rows, ["line_no"], a.validation, a.test)
    coded = stored(coded.select("part", *[vocab.encode(F.col(c), ids).alias(c) for c in ("source", "target")]))
    validation = coded.filter("part = 'val'")
    settings = training.Settings(a.epochs, a.batch, a.heads, a.dropout, a.rate, a.decay, accumulate=a.accumulate, patience=a.patience, save_every=a.save)
    weights = training.initial(len(ids), len(ids), a.width, a.layers, settings.seed)
    part = coded.filter("part = 'train'")
    _, history, _ = training.train_on_cluster(weights, part, part if validation.isEmpty() else validation, settings, a.tasks, a.output)
    for name, text in zip(("report.json", "report.txt"), reports.training_report(history, {"width": a.width, "layers": a.layers, "epochs": a.epochs}, time.time() - began)):
        with open(os.path.join(a.output, name), "w", encoding="utf-8") as f:
            f.write(text)
    with open(os.path.join(a.output, "vocabulary.txt"), "w", encoding="utf-8") as f:
        f.writelines(f"{c}\n" for c, i in sorted(ids.items(), key=lambda x: x[1]) if i > vocab.UNK)


def _interactive(spark: SparkSession, run) -> None:
    """Normalises what is typed, line by line, until an empty line or the end."""
    for line in sys.stdin:
        if not line.strip():
            break
        print(run(line.rstrip("\n")), flush=True)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="ductus")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name, run, **options):
        p = commands.add_parser(name)
        p.add_argument("input", help="files of lines; for normalise, - reads lines from the terminal")
        p.add_argument("output", nargs="?", default="")
        for option, default in options.items():
            if isinstance(default, bool):
                p.add_argument(f"--{option}", action="store_true")
            else:
                p.add_argument(f"--{option}", type=type(default), default=default)
        p.set_defaults(run=run)

    command("reflow", _reflow, shortest=100, longest=120, segmented=False, whole=False)
    command("noise", _noise, ratio=5.0, copies=1, seed=42)
    command("swap", _swap, chance=0.1, segmented=False, seed=42)
    command("rules", _rules, letters=0.2, syllables=0.03, seed=42)
    command("normalise", _normalise, mode="1", dictionary="", model="", vocabulary="", heads=8, beams=5, lm="", backend="auto", text="")
    command("postprocess", _postprocess, dictionary="")
    command("inject", _inject, dictionary="", side="source", most=augment.MAX_INJECTED, seed=42, joined=False)
    command("tokenise", _tokenise, words="")
    command("evaluate", _evaluate, predictions="", source="", iterations=1000, seed=42, most=0)
    command("lm", _lm, order=5)
    command("score", _score, lm="")
    command("vocabulary", _vocabulary)
    command("train", _train, target="", validation=0.15, test=0.15, epochs=50, batch=32, width=512, layers=4, heads=8, dropout=0.2, rate=0.001, decay=0.0001, accumulate=1, patience=0, save=5, tasks=8)
    a = top.parse_args(argv)
    spark = SparkSession.builder.appName("ductus").getOrCreate()

    def one(text: str) -> str:
        rows = spark.createDataFrame([("", 1, text)], "file string, line_no long, text string")
        return next((r.text for r in _normalise(rows, a).collect()), "")

    try:
        if a.command == "normalise" and a.text:
            print(one(a.text))
            return
        if a.command == "normalise" and a.input == "-":
            _interactive(spark, one)
            return
        if not a.output:
            raise ValueError("an output is needed")
        out: DataFrame | None = a.run(read_lines(spark, a.input), a)
    except ValueError as e:
        top.error(str(e))
    if out is None:
        return
    order = [c for c in ("section", "ngram", "file", "copy", "line_no") if c in out.columns]
    write_lines(out, a.output, order or None)


if __name__ == "__main__":
    main()
