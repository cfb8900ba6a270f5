"""Text functions on literal examples and properties."""

import random

import pytest
from pyspark.sql import functions as F

from ductus.functions import folds, script
from ductus.operators import augment, clean, evaluate, language_model, lines, rerank, rules, tokenise, vocab
from ductus.plans import modes
from ductus.sources import arpa, dictionaries, names


def col(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, text string")
    return [r.x for r in df.select("i", f(F.col("text")).alias("x")).orderBy("i").collect()]


def test_cleaning_literals(spark):
    out = col(spark, ["p1༄༅ ། །", "སོ།།༄༅", "སོ ། །", "", None, "a\tb"], clean.cleaned)
    assert out == ["༄༅།།", "སོ།། ༄༅", "སོ །།", "", None, ""]


def test_spacing_keeps_the_space_after_a_double_shad():
    assert folds.space_punctuation("། ། །") == "།། །"
    assert folds.space_punctuation(" །") == " །" and folds.space_punctuation("། ") == "། "


def test_marks_and_punctuation(spark):
    assert col(spark, ["ཀ ༷ ཁ", "ཀ ༹ཁ", "ཀ༷  ཁ"], script.join_marks) == ["ཀ༷ཁ", "ཀ༹ཁ", "ཀ༷ ཁ"]
    assert col(spark, ["ཀ།ཁ་་་ག༑", "།།", "། ", None], script.fix_punctuation) == ["ཀ། ཁ་ག། ", "།། ", "། ", None]
    assert col(spark, ["༏ཀ༎"], lambda t: script.fix_punctuation(t, script.FILE_SHADS)) == ["། ཀ༎"]
    log = col(spark, ["༑ཀ་་་།ཁ"], script.punctuation_changes)[0]
    assert {(x["from"], x["to"]): x["count"] for x in log} == {("༑", "།"): 1, ("།", "། "): 2, ("་་", "་"): 2}


def test_syllables_and_spans(spark):
    assert col(spark, ["ཀ་ཁ་ག", "ཀ་ ", "", "་་"], script.syllables) == [["ཀ་", "ཁ་", "ག"], ["ཀ་"], [], ["་", "་"]]
    assert col(spark, ["ཀ་།ཁ། ག"], script.syllable_spans) == [["ཀ་", "ཁ།"]]
    assert col(spark, ["ཀ་།ཁ"], script.boundaries) == [[1, 2]]
    assert col(spark, [" ཀཁ ག ", ""], script.spaced_chars) == ["ཀ ཁ   ག", ""]
    assert col(spark, ["ཀ <utt> ཁ <utt>"], lambda t: script.attach_utterance(*script.detach_utterance(t))) == ["ཀ  ཁ <utt>"]


def test_reflow_bounds():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(rng.choice("ཀཁག་་། ") for _ in range(rng.randint(0, 400)))
        chunks = folds.split_unsegmented(text, 40)
        assert "".join(chunks).replace(" ", "") == text.replace(" ", "")
        units = text.split()
        packed = folds.pack_units(units, 40)
        assert " ".join(packed) == " ".join(units) and all(len(x) <= 40 or " " not in x for x in packed)
        merged = folds.merge_short(packed, 30, 40)
        assert " ".join(merged) == " ".join(packed)
        assert all(len(a) >= 30 or len(a) + 1 + len(b) > 40 for a, b in zip(merged, merged[1:]))


def test_split_takes_the_last_shad_then_tsheg_then_space():
    assert folds.split_unsegmented("ཀ་ཀ།ཀ་ཀ", 6) == ["ཀ་ཀ།", "ཀ་ཀ"]
    assert folds.split_unsegmented("ཀཀ་ཀཀཀ", 5) == ["ཀཀ་", "ཀཀཀ"]
    assert folds.split_unsegmented("ཀ།།ཀཀཀ", 5) == ["ཀ།། ", "ཀཀཀ"]
    assert folds.pack_chunks("", 5) == []


def test_expansion_cascades(spark):
    pairs = [("ཀཁག", "ག"), ("ཀཁ", "ཀག"), ("ག", "ང")]
    assert col(spark, ["ཀཁགཀཁ"], lambda t: rules.expand(t, pairs)) == col(spark, ["ཀཁགཀཁ"], lambda t: folds.expanded(t, pairs)) == ["ངཀང"]


def test_dictionaries(spark):
    rows = ["Diplomatic\tNormalised", "1[ཀཁ་]\tx[ཀ་ཁ]", "[ག]\t[ང]", "[ག]\t[ཅ]", "no tab", "[ཆཇཉ]\tnone"]
    df = spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, text string")
    assert rules.ordered_rules(dictionaries.rules(df)) == [("ཀཁ་", "ཀ་ཁ་"), ("ག་", "ཅ་")]
    rows = ["[སྟོངའཱི་]  [སྟོང་པའི་]", "[a] [b]", "x\t\ty", ""]
    df = spark.createDataFrame(list(enumerate(rows, 1)), "line_no long, text string")
    assert [tuple(r)[1:] for r in dictionaries.pairs(df).orderBy("ord").collect()] == [("སྟོངའཱི་", "སྟོང་པའི་"), ("x", "y")]
    assert [r.line_no for r in dictionaries.malformed(df).collect()] == [2]


def test_augmentation_properties():
    text = "ཀ་ཁ་ག་ང་ཅ་ཆ་" * 5
    a = folds.delete_syllables(text, 0.1, 1, "k")
    assert len(a) == len(text) - 2 * 3 and a == folds.delete_syllables(text, 0.1, 1, "k")
    assert folds.delete_syllables("ཀ་ཁ་", 0.0, 1, "k") in ("ཀ་", "ཁ་")
    assert folds.delete_syllables("ཀ་ཁ", 0.5, 1, "k") == "ཀ་ཁ"
    assert len(folds.double_syllables(text, 0.1, 1, "k")) == len(text) + 3
    n = folds.replace_some("ཀ" * 100, "ཀ", "ཁ", 0.2, 1, "k").count("ཁ")
    assert n == 20
    assert sorted(folds.swap(list("abcdef"), 1.0, 1, "k")) == list("abcdef") and folds.swap(list("abcd"), 1.0, 1, "k") == list("badc")
    assert folds.swap_line("ཀ་ཁ <utt>", 1.0, False, 1, "k") == "ཁཀ་ <utt>"
    assert folds.swap_line(" one ", 1.0, True, 1, "k") == " one "
    assert all(len(folds.rule_noise(text, 0.2, 0.03, s, "k")) > 0 for s in range(20))


def test_noise_rate(spark):
    out = col(spark, ["ཀ" * 4000, "", None], lambda t: augment.with_noise(t, F.col("i"), 10.0))
    assert 300 < len(out[0]) - 4000 < 500 and out[1:] == ["", None]
    with pytest.raises(ValueError):
        augment.with_rules(F.col("text"), F.col("i"), 2.0)


def test_metrics_by_hand(spark):
    rows = [(1, "abc", "abd", "abd"), (2, "ab", "abc", "ab"), (3, "", "", ""), (4, None, "x", "x")]
    stats = evaluate.line_statistics(spark.createDataFrame(rows, "i int, source string, target string, hypothesis string"))
    m = evaluate.metrics(stats).first()
    assert (m.n, m.total_errors, m.identified_errors, m.correctly_corrected) == (3, 2, 1, 1)
    assert m.precision == 1.0 and m.recall == pytest.approx(5 / 6) and m.character_error_rate == pytest.approx(1 / 9)
    assert (m.correcting_recall, m.correcting_precision) == (0.5, 1.0)
    ci = {r.metric: r for r in evaluate.bootstrap_intervals(stats.withColumn("k", F.col("i")), "k", 50).collect()}
    assert all(0 <= ci[x].lower <= ci[x].upper for x in evaluate.METRICS)
    ci = {r.metric: r for r in evaluate.replayed_intervals(stats, ["i"], 50).collect()}
    # A draw of three times the empty line has neither precision nor recall.
    assert 0 <= ci["precision"].lower <= 1.0 == ci["precision"].upper and 0 <= ci["recall"].lower <= 5 / 6 <= ci["recall"].upper <= 1


def test_edit_distance(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abc𝔘") for _ in range(rng.randint(0, 90))), "".join(rng.choice("abc𝔘") for _ in range(rng.randint(0, 90)))) for _ in range(300)]
    df = spark.createDataFrame([*pairs, ("", ""), ("a", None), (None, None)], "a string, b string").withColumn("d", evaluate.edit_distance("a", "b"))
    assert df.filter(~F.col("d").eqNullSafe(F.levenshtein("a", "b"))).count() == 0


def test_language_model(spark):
    df = spark.createDataFrame([("ཀཁ",), ("ཀཁ",), ("ཀག",), ("",)], "text string")
    model = language_model.estimate(df, order=3, prune=(0, 0, 0))
    p = {r.ngram: 10**r.logprob for r in model.collect()}
    assert sum(v for k, v in p.items() if " " not in k and k != "<s>") == pytest.approx(1.0)
    small = spark.createDataFrame([(1, "<s>", -1.0, -0.5), (1, "ཀ", -0.3, -0.2), (1, "</s>", -0.7, 0.0), (2, "<s> ཀ", -0.1, 0.0)], "n int, ngram string, logprob double, backoff double")
    rows = spark.createDataFrame([(1, "ཀ"), (2, "ཀ "), (3, ""), (4, None)], "k int, text string")
    s = {r.k: r.score for r in language_model.score(rows, small, 2, ["k"]).collect()}
    assert s[1] == pytest.approx(-1.0 - 0.1 - 0.2 - 0.7)
    assert s[2] == pytest.approx(-1.0 - 0.1 - 0.2 - 10 - 0.7)
    assert s[3] == pytest.approx(-1.0 - 0.5 - 0.7) and s[4] == 0.0
    assert {r.k: r.score for r in language_model.score(rows, small, 2, ["k"], most=3).collect()} == pytest.approx(s)
    back = arpa.parse(arpa.render(small).orderBy("section", "ngram").selectExpr("monotonically_increasing_id() AS line_no", "text"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in small.collect()}


@pytest.mark.parametrize("ends", [(True, True), (False, True), (False, False)])
def test_scores_in_arrays_and_by_joins(spark, ends):
    rng = random.Random(5)
    text = lambda: "".join(rng.choice("ཀཁགང ") for _ in range(rng.randrange(14)))
    model = language_model.estimate(spark.createDataFrame([(text(),) for _ in range(80)], "text string"), order=4, prune=(0, 0, 1))
    rows = spark.createDataFrame([(k, text() + rng.choice(["", "ཅ", "𝔘"])) for k in range(60)] + [(99, None), (100, "")], "k int, text string")
    a = {r.k: r.score for r in language_model.score(rows, model, 4, ["k"], bos=ends[0], eos=ends[1]).collect()}
    assert a == pytest.approx({r.k: r.score for r in language_model.score_by_joins(rows, model, 4, ["k"], bos=ends[0], eos=ends[1]).collect()})


def test_rerank_and_modes(spark):
    nbest = spark.createDataFrame([(1, 1, "a", -1.0, 1, -9.0), (1, 2, "b", -1.5, 1, -1.0), (2, 1, "c", -1.0, 0, 0.0), (2, 2, "d", -1.0, 0, 0.0)], "k int, beam int, text string, score double, n_tokens int, lm double")
    assert {r.k: r.text for r in rerank.rerank(nbest, ["k"]).collect()} == {1: "b", 2: "c"}
    assert {r.k: r.text for r in rerank.rerank(nbest, ["k"], lm=None).collect()} == {1: "a", 2: "c"}
    df = spark.createDataFrame([(1, "ཀ༑"), (2, "  ")], "k int, text string")
    for mode, first in ((1, "ཀ། "), (2, "ཀ༑"), (4, "ཀ། "), ("rules+neural", "ཀ། ")):
        lm = spark.createDataFrame([(1, "ཀ", -0.3, 0.0)], "n int, ngram string, logprob double, backoff double") if mode == 4 else None
        assert {r.k: r.normalised for r in modes.normalise(df, mode, ["k"], [], modes.unchanged, lm).collect()} == {1: first, 2: ""}
    for mode, given in ((7, {}), (1, {}), (2, {"rules": []}), (3, {"generator": modes.unchanged}), (5, {"rules": [], "model": df}), (1, {"rules": [], "lm_backend": "x"})):
        with pytest.raises(ValueError):
            modes.normalise(df, mode, ["k"], **given)
    with pytest.warns(UserWarning):
        assert modes.normalise(df, 3, ["k"], generator=modes.unchanged, model=df, lm_backend="none").count() == 2
    # Null and repeated keys, null texts, and a line without a candidate.
    odd = spark.createDataFrame([(1, "w"), (None, "x"), (2, "y"), (2, "z"), (3, None), (4, "none")], "k int, text string")
    some = lambda lines, key: modes.unchanged(lines.filter("text <> 'none'"), key).withColumn("text", F.upper("text"))
    got = sorted(((r.k, r.text, r.normalised) for r in modes.normalise(odd, 2, ["k"], generator=some).collect()), key=str)
    assert got == sorted([(1, "w", "W"), (None, "x", "X"), (2, "y", "Y"), (2, "z", "Z"), (3, None, None), (4, "none", "none")], key=str)
    best = modes.beam_search(lambda t: [-5, -5, -0.7 if len(t) > 2 else -3, 0.0, -0.7], width=2, longest=4)
    assert best[0][0][0] == 1 and all(3 not in t for t, _ in best) and best == sorted(best, key=lambda b: -b[1])


def test_vocabulary(spark):
    df = spark.createDataFrame([("ཀé",), ("",), (None,)], "text string")
    ids = vocab.as_map(vocab.build(df))
    assert len(ids) == 304 and sorted(ids.values()) == list(range(304)) and ids["<unk>"] == 3
    assert col(spark, ["ཀé", "☃", ""], lambda t: vocab.encode(t, ids)) == [[1, ids["ཀ"], ids["é"], 2], [1, 3, 2], [1, 2]]
    assert col(spark, ["ཀ☃é"], lambda t: vocab.decode(vocab.encode(t, ids), ids)) == ["ཀé"]
    assert col(spark, ["ཀ"], lambda t: vocab.padded(vocab.encode(t, ids), 5))[0][3:] == [0, 0]


def test_lines(spark):
    df = spark.createDataFrame([(i,) for i in range(97)], "i long")
    parts = {r.part: r.n for r in lines.contiguous_split(df, ["i"]).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert parts == {"train": 79, "val": 9, "test": 9}
    assert {r.i: r.p for r in lines.numbered(df, ["i"], "p", 5).collect()} == {i: i for i in range(97)}
    odd = spark.createDataFrame([(None, 1), ("b", None), ("a", 2), ("a", 1), ("b", 0), (None, None)], "s string, k int")
    places = {(r.s, r.k): r.p for r in lines.numbered(odd, ["s", "k"], "p", 3).collect()}
    assert places == {(None, None): 0, (None, 1): 1, ("a", 1): 2, ("a", 2): 3, ("b", None): 4, ("b", 0): 5}
    with pytest.raises(ValueError):
        lines.align(df, df.limit(3), "i")


def test_tokenise(spark):
    def broken(text):
        if "x" in text:
            raise RuntimeError("no")
        return tokenise.LongestMatch(["བཀྲ་ཤིས"])(text)

    df = spark.createDataFrame([(1, "བཀྲ་ཤིས་བདེ་ལེགས།"), (2, "x"), (3, " ")], "i int, text string")
    out = {r.i: (r.tokenised, r.error) for r in tokenise.tokenise(df, broken).collect()}
    assert out == {1: ("བཀྲ་ཤིས་ བདེ་ ལེགས །", None), 2: ("x", "RuntimeError: no"), 3: (" ", None)}


def test_names():
    assert names.for_predictions("a/GoldTest_source-tok.txt", 2) == "a/GoldTest_predictions-2-neural-tok.txt"
    assert names.for_step("x.txt", "noise") == "x_noiseout.txt" and names.readable_size(2048) == "2.00 KB"
    with pytest.raises(NotImplementedError):
        arpa.reject_binary("m.bin")
