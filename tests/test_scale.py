"""Work that must not grow faster than the lines: one pass over them, no shuffles of texts, and the same results."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ductus.functions import draws, folds, script
from ductus.operators import clean, evaluate, language_model, rules, tokenise, vocab
from ductus.plans import modes


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def brute_counts(texts, order):
    out = Counter()
    for t in texts:
        tokens = [c for c in t or "" if ord(c) not in language_model._SPACES]
        tokens = ["<s>", *tokens, "</s>"] if tokens else []
        out.update((n, " ".join(tokens[i : i + n])) for n in range(1, order + 1) for i in range(len(tokens) - n + 1))
    return dict(out)


@pytest.mark.parametrize("order", [1, 3, 5])
def test_counts_of_ngrams(spark, order, monkeypatch):
    rng = random.Random(order)
    texts = ["".join(rng.choice("ཀཁག་ 　𝔘") for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "  ", "ཀ"]
    # More characters than a number of five has room for: in all lines together, and in one.
    texts += ["".join(chr(0x4E00 + i * 50 + k) for k in range(50)) for i in range(100)] + ["".join(chr(0x4E00 + k) for k in range(5000)) * 2]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = {(r.n, r.ngram): r.c for r in language_model.ngram_counts(rows, order).collect()}
    assert got == brute_counts(texts, order)


def test_counts_come_out_when_too_many_are_held(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(language_model, "_HELD", 5)
    monkeypatch.setattr(language_model, "_PIECE", 4)
    texts = ["ཀཁགང", "ཀཁག", "ངཀཁ"]
    got = Counter()
    for b in language_model._counted(3)(iter([pa.record_batch([pa.array(texts)], ["t"])])):
        for g, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for n in range(1, g.count(" ") + 2):
                got[n, " ".join(g.split(" ")[:n])] += c
    assert dict(got) == brute_counts(texts, 3)


def test_adjusted_counts_read_the_lines_once(spark):
    texts = ["ཀཁཀཁ", "ཁཀ", "གཁ"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    out = language_model.adjusted_counts(language_model.ngram_counts(rows, 3), 3)
    assert plan(out).count("MapInArrow") == 1 and "Join" not in plan(out)
    counts = brute_counts(texts, 3)
    left = Counter((n - 1, g.partition(" ")[2]) for n, g in counts if n > 1)
    want = {(n, g): c if n == 3 or g.startswith("<s>") else left.get((n, g), c) for (n, g), c in counts.items()}
    assert {(r.n, r.ngram): r.a for r in out.collect()} == want


@pytest.mark.parametrize("mode", [2, 3, 4, 5, 6])
def test_candidates_of_a_row_stay_in_its_task(spark, mode):
    class Three(modes.RowGenerator):
        def candidates(self, text):
            texts = (text, F.replace(text, F.lit("་"), F.lit("")), F.concat(text, F.lit("།")))
            some = F.array(*[F.struct(F.lit(k).alias("beam"), t.alias("text"), F.lit(-0.5 * k).alias("score"), F.length(t).alias("n_tokens")) for k, t in enumerate(texts, 1)])
            return F.filter(some, lambda c: ~text.contains("ཨ"))  # a line with that letter has no candidate

    rng = random.Random(mode)
    texts = [None, "", "  ", "ཨཀ་", *("".join(rng.choice("ཀཁག་༎ ") for _ in range(rng.randrange(12))) for _ in range(60))]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    model = language_model.estimate(rows, 3, (0, 0, 0)) if mode in (3, 4, 5) else None
    rules = [("ཀཁ", "ག")]
    inside = modes.normalise(rows, mode, ["k"], rules, Three(), model, 3)
    apart = modes.normalise(rows, mode, ["k"], rules, lambda lines, key: Three()(lines, key), model, 3)
    assert "Aggregate" not in plan(inside) and "Join" not in plan(inside)
    assert {tuple(r) for r in inside.collect()} == {tuple(r) for r in apart.collect()}


def test_dictionary_rows_of_odd_lines(spark, tmp_path):
    """Lines of every kind of white space, and without a first word, as the SQL has them."""
    import duckdb

    from ductus import queries

    odd = ["", " ", "  ", " a", "a ", "a  b", "a   b  c", "]", "[", "[] x", "[a] b", "\t", "\ta", "a\t", "a\tb c", "a \t b", "a\t\tb", "\r", "a b\r", "a\rb c", "a b\x0b", "a b\u00a0", "\u00a0 a", "a\u3000\u3000b c", "a b\u2028c", "a\u0085b c", "a b \x1f"]
    rows = [(k, "\n".join(odd[k:] + odd[:k])) for k in range(len(odd))] + [(100, ""), (101, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("dict_pairs", "load_rules_dict"):
        want = sorted(tuple(map(str, r)) for r in duck.sql(queries.ORACLES[name]).fetchall())
        assert sorted(tuple(map(str, r)) for r in queries.QUERIES[name](spark, str(tmp_path)).collect()) == want


def test_edit_distances_of_many_pairs():
    rng = random.Random(7)
    letters = "abc𝔘" * 3 + "defgh"
    word = lambda n: "".join(rng.choice(letters) for _ in range(rng.randrange(n)))
    pairs = []
    for n in (3, 64, 66, 130, 300, 700):
        for _ in range(60):
            a = word(n)
            pairs.append((a, word(n)))
            b = list(a)
            for _ in range(rng.randrange(9)):
                b[(i := rng.randrange(len(b) + 1)) : i + rng.randrange(2)] = word(3)
            pairs.append((a, "".join(b)) if rng.random() < 0.5 else ("".join(b), a))
    pairs += [("a" * n, "b" * m) for n in (1, 63, 64, 65, 128, 129) for m in (1, 64, 65, 200)] + [("", ""), ("", "a"), ("a", "")]
    assert evaluate.edit_distances(pairs).tolist() == [evaluate.edit_distance_of(*p) for p in pairs]


def test_line_statistics_work_on_batches(spark, monkeypatch):
    """The pure-Python distance is for a few long texts only; before, it took every line."""
    rng = random.Random(8)
    rows = [("".join(rng.choice("abc") for _ in range(rng.randrange(90))), "".join(rng.choice("abc") for _ in range(rng.randrange(90)))) for _ in range(500)]
    calls = []
    one = evaluate.edit_distance_of
    monkeypatch.setattr(evaluate, "edit_distance_of", lambda a, b: calls.append(1) or one(a, b))
    evaluate.edit_distances(rows)
    assert len(calls) < 25


def test_draws_of_many_keys():
    rng = random.Random(9)
    keys = [f"{rng.randrange(10**rng.randrange(1, 12))}:{k}" for k in range(300)] + ["", "é" * 20, "x" * 54, "x" * 70]
    n = [rng.randrange(12) for _ in keys[:-1]] + [9]
    n[3] = 5000
    want = np.concatenate([draws.draws(42, k, m) for k, m in zip(keys, n)])
    assert (draws.many_draws(42, keys, np.array(n)) / 4294967296.0 == want).all()
    assert len(draws.many_draws(42, [], np.array([], int))) == 0


def test_bootstrap_weights_come_from_batches_of_draws(monkeypatch):
    """A digest call for every key and place is what took the time."""
    keys = [f"{k}:{k % 7}" for k in range(200)]
    want = np.searchsorted(evaluate.POISSON, np.stack([draws.draws(42, k, 301) for k in keys]), "right")
    monkeypatch.setattr(draws.hashlib, "md5", None)
    assert (evaluate._weights(42, keys, 301) == want).all()


def test_changes_of_many_rules(spark):
    """Each rule is applied and counted once a line: as columns, it was worked out anew for every rule after it."""
    rng = random.Random(10)
    pairs = [(a + b, b + c) for a, b, c in (rng.sample("ཀཁགངཅཆ་", 3) for _ in range(9))]
    texts = ["".join(rng.choice("ཀཁགངཅཆ་་།།༑༏ \u00a0\x1f") for _ in range(rng.randrange(40))) for _ in range(300)] + ["", "།", None]
    out = rules.postprocess(spark.createDataFrame([(t,) for t in texts], "text string"), pairs)
    assert plan(out).count("replace(") == 0
    now, want = F.col("text"), []
    for a, b in pairs:
        want.append(script.count_of(now, a))
        now = F.replace(now, F.lit(a), F.lit(b))
    want = out.select("text", "normalised", "changes", script.fix_punctuation(now, script.FILE_SHADS).alias("n"), F.array(*want).alias("c"), script.punctuation_changes(now).alias("p"))
    for r in want.collect():
        assert r.normalised == r.n
        before = [("abbreviation", a, b, k) for (a, b), k in zip(pairs, r.c) if k]
        assert [tuple(x) for x in r.changes] == before + [tuple(x) for x in r.p]


def test_noise_of_many_texts():
    rng = random.Random(11)
    texts = ["".join(rng.choice("ཀཁ𝔘") for _ in range(rng.randrange(60))) for _ in range(50)] + ["", "ཀ" * 5000]
    keys = [f"{k}:1/2" for k in range(len(texts))]
    for chance in (0.0, 0.05, 0.5, 1.0):
        assert folds.insert_noises(texts, chance, "ངཅཆ𝔘", 3, keys) == [folds.insert_noise(t, chance, "ངཅཆ𝔘", 3, k) for t, k in zip(texts, keys)]
    assert folds.insert_noises([], 0.5, "ང", 3, []) == []


def test_chosen_places():
    for n in (1, 2, 5, 40, 199, 200, 201, 900):
        for k in {0, 1, n // 3, n}:
            assert folds.chosen(n, k, 5, f"{n}") == set(np.argsort(draws.draws(5, f"{n}", n), kind="stable")[:k].tolist())


def test_spans_and_cleaning_as_columns(spark):
    rng = random.Random(12)
    texts = ["".join(rng.choice("ཀཁ་།། ༑\n\t༄\u00a0xé") for _ in range(rng.randrange(40))) for _ in range(400)] + ["", None, " \u3000"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    c = F.col("text")
    old = folds.spaced_punctuation(script.space_after_double_shad(script.keep_script(script.strip(c))))
    for r in rows.select(clean.cleaned(c).alias("a"), old.alias("b"), c, script.syllable_spans(c).alias("s"), script.boundaries(c).alias("n"), vocab.encode(c, {"ཀ": 4, "་": 5}, longest=9).alias("e"), vocab.encode(c, {"ཀ": 4, "་": 5}, frame=False).alias("p")).collect():
        assert r.a == r.b
        if r.text is not None:
            assert folds._spans(r.text)[0] == r.s and folds._n_boundaries(r.text) == len(r.n)
            ids = [{"ཀ": 4, "་": 5}.get(x, 3) for x in r.text]
            assert r.p == ids and r.e == [1, *ids[:7], 2]
        else:
            assert r.p is None and r.e is None


def test_longest_match_looks_only_where_a_word_starts():
    rng = random.Random(13)
    words = ["ཀ་ཁ", "ཀ་ཁ་ག", "ག་ཀ", "་ཀ", "ང"]
    found = tokenise.LongestMatch(words)
    every = tokenise.LongestMatch(words)
    every.starts = {x for x in ["", *"ཀཁགང"]}
    asked = []
    found.words = type("W", (set,), {"__contains__": lambda self, x: asked.append(x) or set.__contains__(self, x)})(found.words)
    texts = ["".join(rng.choice("ཀཁགང་་་། ") for _ in range(40)) for _ in range(200)]
    assert [found(t) for t in texts] == [every(t) for t in texts]
    asked.clear()
    found("ཁ་ཁ་ཁ་ཁ་")
    assert asked == []


def test_rule_noise_of_many_texts():
    rng = random.Random(14)
    letters = "".join(folds.LETTER_RULES) + "ྱྲདྱགྱདྱགྱ་་་། ཀ𝔘"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(300)] + ["", "ད", "ྱ", "ད", "འ" * 900]
    keys = [f"{k}:7" for k in range(len(texts))]
    for share in (0.0, 0.03, 0.2, 1.0):
        assert folds.rule_noises(texts, share, 0.03, 42, keys) == [folds.rule_noise(t, share, 0.03, 42, k) for t, k in zip(texts, keys)]
    assert folds.rule_noises([], 0.2, 0.03, 42, []) == []
