"""Files in and out, streams and the command line."""

import pytest
from pyspark.sql import functions as F

from ductus.functions import script
from ductus.operators import evaluate
from ductus.sources import reports, text
from ductus.streaming import rules as stream


def test_read_and_write_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ཀ\r\n\r ཁ \nག".encode())
    (tmp_path / "b.txt").write_bytes(b"x\xffy\n")
    (tmp_path / "c.txt").write_bytes(b"")
    rows = text.read_lines(spark, str(tmp_path / "a.txt")).orderBy("line_no").collect()
    assert [r.text for r in rows] == ["ཀ", "", " ཁ ", "ག"] and [r.line_no for r in rows] == [1, 2, 3, 4]
    assert [r.text for r in text.read_lines(spark, str(tmp_path / "a.txt"), strip=True, drop_blank=True).orderBy("line_no").collect()] == ["ཀ", "ཁ", "ག"]
    assert [r.text for r in text.read_lines(spark, str(tmp_path / "b.txt"), lossy=True).collect()] == ["xy"]
    assert text.read_lines(spark, str(tmp_path / "c.txt")).count() == 0
    out = str(tmp_path / "out")
    text.write_lines(text.read_lines(spark, str(tmp_path / "a.txt")), out, ["line_no"], one_file=True)
    assert [r.value for r in spark.read.text(out).collect()] == ["ཀ", "", " ཁ ", "ག"]
    df = spark.createDataFrame([(1, None), (2, "bad")], "line_no int, error string")
    assert text.write_errors(df.filter("line_no = 1"), str(tmp_path / "e")) == 0 and not (tmp_path / "e").exists()
    assert text.write_errors(df, str(tmp_path / "e")) == 1


def test_reports(spark):
    rows = [(1, "ab", "ac", "ac")]
    stats = evaluate.line_statistics(spark.createDataFrame(rows, "i int, source string, target string, hypothesis string"))
    m = evaluate.metrics(stats)
    ci = evaluate.bootstrap_intervals(stats, "i", 20)
    assert '"samples_evaluated":1' in reports.evaluation_json(m, ci, test_src="x").first().value
    assert "F1 Score" in reports.evaluation_text(m.first(), {"f1_score": (0.5, 1.0)}, stats.collect(), 0.5)
    assert "lines/second" in reports.run_text("rules", 10, 2.0, {"beam": 5})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("ཀ༑\n")
    q = stream.normalise_stream(stream.read_stream(spark, str(tmp_path / "in")), [("ཀ", "ཁ")]).writeStream.format("memory").queryName("out").start()
    q.processAllAvailable()
    q.stop()
    assert [r.normalised for r in spark.sql("SELECT * FROM out").select(F.col("normalised")).collect()] == ["ཁ། "]


def test_command_line(spark, tmp_path):
    from ductus.__main__ import main

    (tmp_path / "a.txt").write_text("ཀ་ཁ་ག\nང་ཅ\n")
    (tmp_path / "d.tsv").write_text("[ཀ]\t[ཨ]\n")
    main(["normalise", str(tmp_path / "a.txt"), str(tmp_path / "o"), "--dictionary", str(tmp_path / "d.tsv")])
    assert [r.value for r in spark.read.text(str(tmp_path / "o")).collect()] == ["ཨ་ཁ་ག", "ང་ཅ"]
    main(["swap", str(tmp_path / "a.txt"), str(tmp_path / "s"), "--chance", "1.0"])
    assert spark.read.text(str(tmp_path / "s")).count() == 2

    with pytest.raises(SystemExit):
        main(["normalise", str(tmp_path / "a.txt"), str(tmp_path / "n"), "--mode", "3"])
    assert not (tmp_path / "n").exists()


def test_more_commands(spark, tmp_path, capsys, monkeypatch):
    import io

    from ductus.__main__ import main

    at = lambda name: str(tmp_path / name)
    read = lambda name: [r.value for r in spark.read.text(at(name)).collect()]
    (tmp_path / "a.txt").write_text("ཀ་ཁ་ག\nང་ཅ\nཀ་ཁ\n")
    (tmp_path / "p.txt").write_text("ཀ་ཁ་ག\nང་ང\nཀ་ཁ\n")
    (tmp_path / "d.tsv").write_text("[ཀ]\t[ཨ]\n")
    main(["normalise", "-", "--dictionary", at("d.tsv"), "--text", "ཀ་ཁ༑"])
    assert capsys.readouterr().out.strip() == "ཨ་ཁ།"
    monkeypatch.setattr("sys.stdin", io.StringIO("ཀ་\nཁ\n\nཀ་\n"))
    main(["normalise", "-", "--dictionary", at("d.tsv")])
    assert capsys.readouterr().out.split() == ["ཨ་", "ཁ"]
    main(["evaluate", at("a.txt"), at("e"), "--predictions", at("p.txt"), "--iterations", "20"])
    assert '"samples_evaluated":3' in read("e")[0] and '"n_iterations":20' in read("e")[0]
    main(["evaluate", at("a.txt"), at("e1"), "--predictions", at("p.txt"), "--iterations", "0", "--most", "1"])
    assert '"samples_evaluated":1' in read("e1")[0] and '"character_error_rate":0.0' in read("e1")[0]
    main(["lm", at("a.txt"), at("m"), "--order", "2"])
    assert read("m")[0] == "\\data\\" and read("m")[-1] == "\\end\\"
    main(["score", at("a.txt"), at("s"), "--lm", at("m")])
    assert len(read("s")) == 3 and all(float(x) < 0 for x in read("s"))
    main(["normalise", at("a.txt"), at("n"), "--dictionary", at("d.tsv")])
    main(["postprocess", at("a.txt"), at("pp"), "--dictionary", at("d.tsv")])
    assert read("n") == read("pp") == ["ཨ་ཁ་ག", "ང་ཅ", "ཨ་ཁ"]
    main(["inject", at("a.txt"), at("i"), "--dictionary", at("d.tsv")])
    assert sum(x.endswith(" ཀ") for x in read("i")) == 1
    main(["tokenise", at("a.txt"), at("t")])
    assert read("t")[1] == "ང་ ཅ"
    main(["vocabulary", at("a.txt"), at("v")])
    assert len(read("v")) == 299
    main(["reflow", at("a.txt"), at("r"), "--shortest", "1", "--longest", "50", "--whole"])
    assert "".join(read("r")).replace(" ", "") == "ཀ་ཁ་གང་ཅཀ་ཁ"


def test_train_and_use_a_network(spark, tmp_path):
    from ductus.__main__ import main

    at = lambda name: str(tmp_path / name)
    (tmp_path / "s.txt").write_text("ཀ་ཁ\nཁ་ཀ\nཀ་ཀ\nཁ་ཁ\nཀ\nཁ\n" * 4)
    main(["train", at("s.txt"), at("net"), "--target", at("s.txt"), "--epochs", "2", "--width", "8", "--layers", "1", "--heads", "2", "--tasks", "2"])
    assert {"best.npz", "vocabulary.txt", "report.json", "report.txt"} <= {p.name for p in (tmp_path / "net").iterdir()}
    main(["normalise", at("s.txt"), at("n"), "--mode", "neural", "--model", at("net/best.npz"), "--vocabulary", at("net/vocabulary.txt"), "--heads", "2", "--beams", "1"])
    assert spark.read.text(at("n")).count() == 24


def test_line_numbers_over_many_blocks(spark, tmp_path):
    lines = [f"line {i} " + "x" * (i % 90) for i in range(5000)]
    (tmp_path / "big.txt").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "small.txt").write_text("one\ntwo\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = text.read_lines(spark, str(tmp_path))
        assert rows.rdd.getNumPartitions() > 5
        got = sorted((r.file.rsplit("/", 1)[1], r.line_no, r.text) for r in rows.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == sorted([("big.txt", i, x) for i, x in enumerate(lines, 1)] + [("small.txt", 1, "one"), ("small.txt", 2, "two")])
    assert [r.text for r in text.first_lines(rows, 2).collect()] == lines[:2] and text.first_lines(rows, None).count() == 5002


def test_more_reports(spark):
    from ductus.operators import language_model

    df = spark.createDataFrame([("ཀཁ",), ("ཀ",)], "text string")
    stats, oov = language_model.corpus_statistics(df), language_model.oov_rate(df, spark.createDataFrame([("ཀ",)], "ch string"))
    model = language_model.estimate(df, 2, (0, 0))
    assert '"ngrams":{"1":5,"2":4}' in reports.model_json(stats, oov, model, 1.0, order=2).first().value
    assert "Unknown: 1 (33.33%)" in reports.model_text(2, stats.first(), oov.first(), {1: 4, 2: 4})
    as_json, as_text = reports.training_report([(2.0, 1.5), (1.0, 1.25)], {"epochs": 2}, 3.0)
    assert '"best_epoch": 2' in as_json and "Best: epoch 2, validation 1.2500" in as_text


def test_punctuation_of_a_whole_file_line_by_line(spark):
    whole = "ཀ།ཁ་་\n༑\nག། \nང།"
    rows = [(i, x) for i, x in enumerate(whole.split("\n"))]
    df = spark.createDataFrame(rows, "i int, text string")
    lines = df.select("i", script.fix_line_of_file(F.col("text"), F.col("i") == len(rows) - 1).alias("t")).orderBy("i").collect()
    want = spark.createDataFrame([(whole,)], "text string").select(script.fix_whole_punctuation(F.col("text"))).first()[0]
    assert "\n".join(r.t for r in lines) == want == "ཀ། ཁ་\n།\nག། \nང། "
