"""The pipeline's stages, each on what the one before kept, against brute force."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa

import corpus_pipeline
from ductus.llm import line_dedup, mixing, packing, quality, simhash
from ductus.llm.common import stored

SF = "/root/testdata/sf0.001"


MASK = 2**64 - 1


def mixed(x):
    x = ((x ^ x >> 32) * 0xD6E8FEB86659FD93) & MASK
    return x ^ x >> 29


def plain_lines(text):
    """The lines of a text as lists of words, by the rule as the module states it, word by word."""
    words = [(w, k == 0) for line in text.encode().split(b"\n") for k, w in enumerate(line.split())]
    number = [mixed((int.from_bytes(w[:8], "little") * 0x9E3779B97F4A7C15 + int.from_bytes(w[-8:], "little") * 0xC2B2AE3D27D4EB4F + len(w)) & MASK) for w, _ in words]
    ends = [w[-1:] in (b".", b"!", b"?") for w, _ in words]
    starts = [k for k, (_, first) in enumerate(words) if first]
    keys = []
    for k, (_, first) in enumerate(words):
        if first:
            keys.append((0, 0, -k))
            continue
        near = any(words[j][1] or j and ends[j - 1] for j in range(max(0, k - 2), k) if j != k)
        pair = mixed((number[k] + number[k - 1] * 0x9E3779B97F4A7C15) & MASK)
        keys.append((1 if ends[k - 1] else 3 if near else 2, pair >> 2 >> 32, -k))
    reach = line_dedup.REACH
    starts += [-min(keys[k : k + reach])[2] for k in range(len(words) - reach + 1)]
    starts = sorted(set(starts))
    return [[w for w, _ in words[a:b]] for a, b in zip(starts, [*starts[1:], len(words)])]


def brute_lines(rows):
    """What is left of every document, by comparing the lines themselves."""
    order = lambda r: (r[0] is None, r[0] or 0, r[2])
    rows = [(i, text, t) for (i, text), t in zip(rows, text_hashes([text for _, text in rows]))]
    kinds = lambda found: [(place, tuple(map(tuple, found[place : place + 3]))) for place in range(max(1, len(found) - 2)) if found]
    first = {}
    for i, text, t in sorted(set(rows), key=order):
        for place, h in kinds(plain_lines(text)):
            first.setdefault(h, (i, t, place))
    out = Counter()
    for i, text, t in rows:
        found = plain_lines(text)
        gone = {k for place, h in kinds(found) if first[h] != (i, t, place) for k in range(place, place + 3)}
        left = [w for k, x in enumerate(found) if k not in gone for w in x]
        if left or not text.split():
            out[(i, tuple(left))] += 1
    return out


def brute_similar(texts, size=5, similarity=0.8):
    """All pairs of texts with the Jaccard similarity of their shingles, as sets of strings."""
    sets = []
    for t in texts:
        w = [x.decode() for x in (t or "").encode().lower().split()]
        sets.append({" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    where = {}
    for k, x in enumerate(sets):
        for g in x or {None}:
            where.setdefault(g, []).append(k)
    shared = Counter((a, b) for ks in where.values() for i, b in enumerate(ks) for a in ks[:i])
    return {(a, b) for (a, b), n in shared.items() if not sets[a] | sets[b] or n >= similarity * len(sets[a] | sets[b])}


def brute_groups(ids, links):
    root = list(range(len(ids)))
    for a, b in sorted(links):
        ra, rb = root[a], root[b]
        root = [ra if r == rb else r for r in root]
    groups = {}
    for k, r in enumerate(root):
        groups.setdefault(r, set()).add(ids[k])
    return list(groups.values())


def test_similar_documents_are_linked(spark):
    rnd = random.Random(6)
    text = lambda n: [f"w{rnd.randrange(5000)}" for _ in range(n)]
    passage = text(60)
    rows = []
    for k in range(150):
        base = text(rnd.randrange(30, 300))
        rows.append(base)
        for _ in range(rnd.randrange(3)):
            copy = list(base)
            for _ in range(max(1, len(copy) // rnd.choice([60, 80, 150]))):
                copy[rnd.randrange(len(copy))] = f"x{rnd.randrange(5000)}"
            rows.append(copy)
        rows.append([*text(rnd.randrange(60, 200)), *passage])  # a passage in common is no similarity
    texts = [" ".join(w) for w in rows]
    links = brute_similar(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names, roots = simhash.similar(df)
    root = {r.node: r.root for r in roots.collect()}
    at = {r.t: r["first"].i for r in names.collect()}
    group = {at[t]: root.get(t, t) for t in at}
    caught = sum(group[a] == group[b] for a, b in links)
    assert len(links) > 100 and caught >= 0.95 * len(links)
    true = {d: k for k, g in enumerate(brute_groups(range(len(texts)), links)) for d in g}
    together = {}
    for d, g in group.items():
        together.setdefault(g, set()).add(true[d])
    assert all(len(x) == 1 for x in together.values())  # nothing is linked that isn't similar
    kept = {r.doc_id for r in simhash.one_of_each(df).collect()}
    assert kept == {min(d for d in group if group[d] == g) for g in set(group.values())}


def grouped(spark, texts):
    """Sets of the places of texts that are linked, and those of a brute-force comparison."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names, roots = simhash.similar(df)
    root = {r.node: r.root for r in roots.collect()}
    at = {r.t: root.get(r.t, r.t) for r in names.collect()}
    found = {}
    for d, t in enumerate(text_hashes(texts)):
        found.setdefault(at[t], set()).add(d)
    want = brute_groups(range(len(texts)), brute_similar(texts))
    return {frozenset(g) for g in found.values()}, {frozenset(g) for g in want}


def test_no_link_at_the_threshold_is_lost(spark):
    rnd = random.Random(7)
    texts = []
    for k in range(600):
        words = [f"w{rnd.randrange(50_000)}" for _ in range(49)]
        texts.append(" ".join(words))
        words[24] = "x"  # 40 of 50 shingles
        texts.append(" ".join(words))
    found, want = grouped(spark, texts + ["", " ", "\n"])
    assert found == want and sum(len(g) == 2 for g in want) == 600


def test_no_link_is_lost_among_frequent_shingles(spark):
    rnd = random.Random(8)
    phrases = [" ".join(f"p{k}w{i}" for i in range(12)) for k in range(6)]
    texts = [" ".join(rnd.choice(phrases) for _ in range(rnd.randrange(4, 14))) for _ in range(700)]  # nothing but frequent ones
    passage = " ".join(f"passage{i}" for i in range(30))
    for k in range(350):  # a passage that many have in common
        words = [f"w{rnd.randrange(50_000)}" for _ in range(40)]
        texts.append(" ".join([*words, passage]))
        if k % 5 == 0:
            texts.append(" ".join([*words[:20], "x", *words[21:], passage]))
    found, want = grouped(spark, texts)
    assert found == want and 300 < len(want) < len(set(texts))


def test_crowded_groups_across_batches():
    import pyarrow as pa

    rnd = random.Random(9)
    rows = []
    for h, n in enumerate([1, 300, 2, 257, 256, 600, 1, 256, 300]):
        rows += [(h, rnd.randrange(3) if h != 5 else 7, t, 50, 3) for t in range(1000 * h, 1000 * h + n)]
    rows.sort()
    columns = list(zip(*rows))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["h", "label", "t", "n", "place"])
    label = {t: x for _, x, t, _, _ in rows}
    for size in (1, 100, 256, 300, 301, 10_000):
        out = [r for b in simhash._meet(0.8)(whole.slice(i, size) for i in range(0, len(whole), size)) for r in b.to_pylist()]
        assert {(r["a"], r["n"]) for r in out if r["b"] is None} == {(1, 300), (3, 257), (8, 300)}
        pairs = {(r["a"], r["b"]) for r in out if r["b"] is not None}
        assert pairs == {(a, b) for h in (2, 4, 7) for a in range(1000 * h, 1000 * h + 256) for b in range(1000 * h, a) if a in label and b in label and label[a] != label[b]}


def test_parities_rule_out_no_similar_sets():
    import numpy as np

    rng = np.random.default_rng(10)
    sets, other = [], []
    for n in (1, 9, 500, 520, 4100, 20_000):
        common, own = rng.integers(0, 1 << 63, (2, n), np.uint64)
        k = n // 9  # of each, so 0.8 of the two together are common
        sets.append((common, np.concatenate([common[k:], own[:k]])))
        sets.append((common, np.concatenate([common, own[: n // 4]])))
        other.append((common, own))
    left, right = ([simhash.parities(np.sort(x)) for x in side] for side in zip(*sets, *other))
    n = np.array([len(a) + len(b) for a, b in sets + other])
    assert simhash._differ_little(left, right, n, 0.8).tolist() == [True] * len(sets) + [False] * len(other)


def text_hashes(texts):
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    rows = SparkSession.getActiveSession().createDataFrame(list(enumerate(texts)), "k int, text string")
    return [r.h for r in rows.select("k", F.xxhash64("text").alias("h")).orderBy("k").collect()]


def test_lines_put_together_again():
    for text in (b"", b" ", b" ab cd. e\n f g\n\nh! i j", b"w " * 100, b"a.b c\td\x0be"):
        found = line_dedup.lines(text)
        assert b"".join(found) == text.lstrip(b" \t\n\x0b\f\r") and all(len(x.split()) <= 16 for x in found)


def test_a_shared_passage_goes_and_the_rest_stays(spark):
    passage = " ".join(f"passage{i}" for i in range(60)) + "."
    own = lambda d: [f"Text {d} has a sentence of its own, number {i} of document {d}." for i in range(5)]
    rows = [(d, "\n".join([*own(d)[:2], passage, *own(d)[2:]])) for d in range(4)] + [(9, "\n".join(own(9) + own(9))), (10, None), (None, passage), (11, passage)]
    df = spark.createDataFrame([(i, t, len(t or ""), t) for i, t in rows], "doc_id long, text string, n_chars long, places string")
    got = {r.doc_id: r for r in line_dedup.remove_repeats(df).collect()}
    assert got[0].text == rows[0][1] and got[0].places == rows[0][1]
    for d in (1, 2, 3):
        assert got[d].text == "\n".join(own(d)) and got[d].n_chars == len(got[d].text)
    assert got[9].text == "\n".join(own(9)) and got[10].text is None
    assert None not in got and 11 not in got


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, docs, SF))
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            kept = {r.doc_id for r in quality.quality(docs).filter("kept").collect()}
            assert Counter(after) == Counter(r for r in before if r.doc_id in kept)
        elif name == "line_dedup":
            assert Counter((r.doc_id, tuple(r.text.encode().split())) for r in after) == brute_lines([(r.doc_id, r.text) for r in before])
            assert all(r.n_chars == len(r.text) for r in after)
        elif name == "near_dedup":
            assert set(after) <= set(before)
            links = brute_similar([r.text for r in before])
            found = {r.doc_id for r in after}
            groups = brute_groups([r.doc_id for r in before], links)
            assert found >= {min(g) for g in groups} and len(found) <= 1.05 * len(groups)
        elif name == "mixing":
            copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect()}
            assert Counter(after) == Counter({r: copies[r.doc_id] for r in before if copies[r.doc_id]})
        else:
            assert sum(r.length for r in after) == sum(r.length for r in packing.pieces(docs).collect())
        docs = out
    assert sorted(map(str, corpus_pipeline.run(spark, SF).drop("sequence_id", "offset").collect())) == sorted(str(r) for r in docs.drop("sequence_id", "offset").collect())


def test_one_of_each_group_stays_with_odd_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text), (5, text), (3, text), (None, text), (None, "other words here"), (None, None), (7, ""), (7, "x y z"), (8, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.one_of_each(df).collect())
    assert got == Counter({(3, text): 1, (None, "other words here"): 1, (7, ""): 1, (7, "x y z"): 1})


def test_every_document_in_the_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = brute_lines([(r.doc_id, r.text) for r in docs])
    rows = line_dedup.op9_line_windows(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    assert Counter((r.doc_id, tuple(r.text.encode().split())) for r in rows if r.text.strip()) == Counter({k: n for k, n in want.items() if k[1]})
    before = {r.doc_id: len(r.text) for r in docs}
    assert all(r.n_chars == len(r.text) and r.n_removed == before[r.doc_id] - r.n_chars for r in rows)


def test_passages_are_cut_alike_wherever_they_start():
    rnd = random.Random(3)
    words = lambda n, end: [f"{rnd.choice('abcdefgh')}{rnd.randrange(3000)}{end * (rnd.random() < 0.1)}" for _ in range(n)]
    for end in ("", "."):
        for n in (51, 60, 100):
            for _ in range(100):
                passage = words(n, end)
                found = []
                for _ in range(2):
                    text = " ".join([*words(rnd.randrange(40), end), *passage, *words(rnd.randrange(40), end)])
                    lines = line_dedup.lines(text.encode())
                    assert [x.split() for x in lines] == plain_lines(text)
                    found.append({tuple(x.strip() for x in lines[k : k + 3]) for k in range(len(lines) - 2)})
                assert found[0] & found[1]


def test_a_passage_in_the_middle_of_sentences_goes(spark):
    rnd = random.Random(4)
    words = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    passage = words(51)
    texts = [" ".join([*words(17 + 5 * d), *passage, *words(23)]) for d in range(6)]
    got = {r.doc_id: r.text.split() for r in line_dedup.remove_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == texts[0].split()
    for d in range(1, 6):
        own = texts[d].split()
        assert own[: 17 + 5 * d] + own[-23:] == [w for w in got[d] if w not in passage]
        assert sum(w in passage for w in got[d]) <= 2 * line_dedup.REACH + 2


def test_short_lines_and_rows_without_an_id_of_their_own(spark):
    menu = "a b\nc d\ne f"
    rows = [(1, f"{menu}\nfirst text"), (2, f"before it\n{menu}"), (2, f"{menu}\nthe other row of an id"), (None, f"x y z\n{menu}"), (None, f"{menu}\nlast"), (3, "k\nl\nm\nk\nl\nm\nn"), (3, "k\nl\nm\nk\nl\nm\nn"), (4, "two\nlines"), (5, "two\nlines")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((r.doc_id, r.text) for r in line_dedup.remove_repeats(df).collect())
    assert got == Counter({(1, rows[0][1]): 1, (2, "before it"): 1, (2, "the other row of an id"): 1, (None, "x y z"): 1, (None, "last"): 1, (3, "k\nl\nm\nn"): 2, (4, "two\nlines"): 1})
    assert Counter((i, tuple(t.encode().split())) for i, t in got.elements()) == brute_lines(rows)


def test_chunks_of_any_size_give_the_same(spark, monkeypatch):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    ids = np.array([i for i, _ in rows])
    hashes = np.array(text_hashes([t for _, t in rows]))
    *found, = line_dedup._places([t.encode() for _, t in rows])
    later, first = line_dedup._settled(ids, hashes, *found)
    removed = sum(len(t.encode().split()) for _, t in rows) - sum(len(w) * n for (_, w), n in brute_lines(rows).items())
    places = {}
    for k in later:
        places.setdefault(found[0][k], []).append(found[1][k])
    at = sorted(places)
    texts = [rows[k][1].encode() for k in at]
    assert removed == sum(len(a.split()) - len(b.split()) for a, b in zip(texts, line_dedup.without(texts, [places[k] for k in at])))
    for size in (1, 700):
        monkeypatch.setattr(line_dedup, "CHUNK", size)
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array([t for _, t in rows])], ["i", "t", "text"])
        out = pa.Table.from_batches(line_dedup._found(batch.slice(k, 10) for k in range(0, len(rows), 10))).to_pylist()
        marked = {(r["i"], r["t"], r["place"]) for r in out if r["later"]}
        best = {}
        for r in (r for r in out if not r["later"]):
            best.setdefault((r["h1"], r["h2"]), []).append((r["i"], r["t"], r["place"]))
        marked |= {x for group in best.values() for x in sorted(group)[1:]}
        assert marked == {(ids[found[0][k]], hashes[found[0][k]], found[1][k]) for k in later}
