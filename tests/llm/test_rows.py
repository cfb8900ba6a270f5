"""Row-local and ranking operators of the training-data part, against brute force and on edge cases."""

import hashlib
import html
import math
import random
import re
import sys
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ductus.llm import html_text, katz, media, mixing, packing, quality, sharding, simhash, toxicity
from ductus.llm.common import dealt_evenly, stored
from ductus.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, size string, h int, bad int"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns with clashing names."""
    long = " ".join(f"w{i % 997}" for i in range(30_000))
    t = "one two three four. five six seven eight nine ten"
    rows = [(1, None), (2, ""), (2, ""), (3, " \n\t "), (4, t), (4, t), (5, t), (None, t), (None, None), (6, long), (7, "a b c d"), (7, "e f g"), (8, "ÄÖ é x\x00y 𝔘")]
    return spark.createDataFrame([(i, x, None if i == 8 else "en", None if i in (4, 8) else f"s{(i or 0) % 3}", None, "h", "z", 1, 0) for i, x in rows], SCHEMA)


def empty(df):
    return df.limit(0)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_and_empty_tables(spark, odd, name, tmp_path):
    """No query crashes on odd or empty tables; a row per row comes out where that is the contract."""
    labels = spark.createDataFrame([(4, 1, 1), (7, 0, 0), (None, None, 1), (6, None, None), (4, 1, 1)], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (None, "u", "<p>x"), (2, "u", "")], "page_id long, url string, html string")
    for kind, f in (("odd", lambda df: df), ("none", empty)):
        at = tmp_path / kind
        f(odd).write.parquet(f"{at}/documents.parquet")
        f(labels).write.parquet(f"{at}/labels.parquet")
        f(pages).write.parquet(f"{at}/pages.parquet")
        n = (pages if name.startswith("op1_") else odd).count() if kind == "odd" else 0
        rows = QUERIES[name](spark, str(at)).collect()
        if not name.startswith("op7_"):
            assert len(rows) == n
        else:
            assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}) == len(rows) >= n


def test_defined_results_of_odd_rows(spark, odd, tmp_path):
    """What the docstrings say of null, empty, long and repeated rows."""
    at = str(tmp_path)
    odd.write.parquet(f"{at}/documents.parquet")
    labels = [(4, 1, 1), (7, 0, 0), (None, None, 1), (6, None, None), (4, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    texts = {r.doc_id: r.text for r in odd.collect()}
    rows = lambda name: QUERIES[name](spark, at).collect()
    by_id = lambda name: {r.doc_id: r for r in rows(name)}

    found = by_id("op2_simhash_anchors")
    assert all(found[i].fingerprint == "0" * 16 and found[i].component_id == 1 for i in (1, 2, 3))
    assert found[4].fingerprint == found[5].fingerprint and found[5].component_id == 4
    found = by_id("op3_host_quality")
    assert all((found[i].n_words, found[i].base_failed, found[i].kept) == (0, True, False) for i in (1, 2, 3))
    assert found[6].n_words == 30_000 and found[6].base_failed and found[6].n_repeat_words == 30_000  # a cycle of words
    found = by_id("op4_katz_backoff")
    assert all(found[i].n_tokens == 1 and found[i].n_known == 1 for i in (1, 2, 3)) and found[1].score == found[2].score
    assert not found[None].held_out and found[6].n_tokens == 30_001 and all(r.score < 0 for r in found.values())
    found = rows("op5_stratified_shards")
    assert {(r.doc_id, r.size, r.text_crc32) for r in found if r.doc_id in (1, 2)} == {(1, 8, 0), (2, 8, 0)}
    found = rows("op6_hash_threshold_mix")
    assert all(r.size == 0 == r.taken for r in found if r.doc_id in (1, 2, 3)) and len({r.taken for r in found if r.doc_id == 4}) == 1
    found = rows("op7_vector_best_fit")
    assert Counter(r.doc_id for r in found if r.length == 1) == Counter({1: 1, 2: 2, 3: 1, None: 1})
    found = by_id("op8_transport_streams")
    assert found[1].payload_sha256 == found[2].payload_sha256 == hashlib.sha256(b" " * 192).hexdigest() and found[6].n_bytes == len(texts[6])
    found = {(r.doc_id, r.text) for r in rows("op9_line_windows")}
    assert {(1, None), (2, ""), (3, " \n\t "), (4, texts[4]), (5, ""), (None, None)} <= found and (None, "") in found
    found = by_id("op10_pattern_grammar")
    assert found[1].score == found[2].score == found[3].score and all(0 <= r.score <= 1 for r in found.values())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    a, b = QUERIES[name](spark, SF).toPandas(), c.sql(ORACLES[name]).df()
    rows = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).values.tolist()))
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_main_text_is_the_article(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    found = {r.page_id: r for r in html_text.op1_block_text(spark, SF).collect()}
    for p in pages:
        article = p.html[p.html.index("<article>") : p.html.index("</article>")]
        expected = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", article))).split())
        assert found[p.page_id].text == expected and found[p.page_id].n_chars == len(expected)


def test_main_text_without_an_article_element():
    long = "This is what the page is about and it has more than enough of the words that are in every text of this kind, so it is kept as it is."
    page = f"""<html><body class="has-sidebar"><header><h1>Site</h1></header><div class="cookie-notice">We use cookies on this site and you can accept all of them or not.</div>
    <ul><li><a href=x>Home</a><li><a href=y>More</a></ul><div id=content><h2>Title</h2><p>{long}<p>A&amp;B&nbsp;short<br>line.</p><div class="comments"><p>{long}</p></div></div>
    <form><p>{long}</p></form><script>if (a < b) document.write("<p>{long}</p>")</script><aside>{long}</aside><p hidden>{long}</p><footer>&copy; x"""
    assert html_text.main_text(page) == f"Title {long} A&B short line."
    assert html_text.main_text(f"<form><main><p>{long}</main></form>") == long
    assert html_text.main_text("") == "" and html_text.main_text("<<<a <b") is not None
    assert html_text.main_text("<p>" * 5000 + long) == long


LONG = "This is what the page is about and it has more than enough of the words that are in every text of this kind, so it is kept as it is."


@pytest.mark.parametrize("name", "main-nav page-footer post-sidebar content-ad entry-newsletter body-cookie-notice mainNav".split())
def test_a_boilerplate_part_of_a_class_name_drops_the_element(name):
    assert html_text.main_text(f'<body><div class="{name}"><p>{LONG}</p></div><p>{LONG[:89]} it.</p>') == f"{LONG[:89]} it."
    assert html_text.main_text(f'<article><p>{LONG}</p><div id="{name}"><p>{LONG}</p></div></article>') == LONG


@pytest.mark.parametrize("name", "has-sidebar article-header no-sidebar elementor-widget-text-editor main-content".split())
def test_other_class_names_drop_nothing(name):
    assert html_text.main_text(f'<body><div class="{name}"><p>{LONG}</p></div>') == LONG


def test_main_text_in_any_language():
    page = "<body><nav><a href=x>{0}</a></nav><div><h1>{1}</h1><p>{2}</p><p>{3}</p></div><footer>© {0}</footer>"
    for words in (
        ("ホーム", "日本語の見出し", "これは日本語の文章です。とても長い段落で、ページの主な内容を説明しています。読者はここで詳しい情報を得ることができます。", "二番目の段落もあります。"),
        ("Дом", "Заголовок", "Это длинный абзац на русском языке, который рассказывает о содержании страницы и должен остаться в тексте целиком.", "И второй."),
    ):
        assert html_text.main_text(page.format(*words)) == " ".join(words[1:])


def test_nothing_is_lost_after_a_stray_bracket_or_in_a_linked_paragraph():
    assert html_text.main_text(f"<p>if a < b then {LONG}") == f"if a < b then {LONG}"
    assert html_text.main_text(f"<p>{LONG} if a <b then c") == f"{LONG} if a <b then c"
    assert html_text.main_text(f'<p>{LONG} <a href="x') == LONG
    parts = ("A paragraph that is nothing but one link to where it is from.", "Copyright law is what this part of the text is about, in more words than that.")
    assert html_text.main_text(f"<article><p>{LONG}<p><a href=x>{parts[0]}</a><p>{parts[1]}</article>") == " ".join((LONG, *parts))
    assert html_text.main_text(f"<article><p>{LONG}<ul><li><a>More of it</a><li><a>And of this</a><li><a>And that</a></ul></article>") == LONG


def test_streams_round_trip():
    rng = random.Random(3)
    for n in (0, 1, 162, 163, 176, 192, 1535, 1536, 1537, 200_000):
        data = rng.randbytes(n)
        out = media.mux(data)
        s = media.demux(out)
        assert (s.payload, s.broken, s.continuity_errors, len(out) % 188) == (data, 0, 0, 0)
        assert s.programs == {1: media.PMT_PID} and s.streams == {media.DATA_PID: media.STREAM_TYPE}
        assert [u[0] for u in s.units] == [k * media.UNIT * 90_000 // 8000 for k in range(len(s.units))] and all(u[3] for u in s.units)
    out = media.mux(rng.randbytes(9000))
    assert media.demux(out[: 188 * 10] + out[188 * 11 :]).continuity_errors == 1
    assert media.demux(out[: 188 * 5] + out[188 * 4 :]).payload == media.demux(out).payload
    assert media.demux(b"\0" * 400).broken == 3
    assert media.section_crc(b"123456789") == 0x0376E6E7


def plain_packets(data):
    """(pid, starts a unit, counter, payload) of every packet, read by the standard's layout alone."""
    for at in range(0, len(data), 188):
        packet = data[at : at + 188]
        assert len(packet) == 188 and packet[0] == 0x47
        pid, control = (packet[1] & 0x1F) * 256 + packet[2], packet[3] >> 4 & 3
        low = 4 + (1 + packet[4] if control & 2 else 0)
        assert low <= 188
        yield pid, bool(packet[1] & 0x40), packet[3] & 15, packet[low:] if control & 1 else b""


def test_streams_by_an_independent_reader():
    rng = random.Random(4)
    for n in (192, 1536, 1537, 70_000):
        data = rng.randbytes(n)
        tables, units, counters = {}, [], defaultdict(list)
        for pid, start, counter, payload in plain_packets(media.mux(data)):
            counters[pid].append(counter)
            if pid in (0, 0x1000):
                tables[pid] = payload[1 + payload[0] :]
            elif start:
                units.append(payload)
            else:
                units[-1] += payload
        assert all(c == [k % 16 for k in range(len(c))] for c in counters.values())
        assert int.from_bytes(tables[0][10:12], "big") & 0x1FFF == 0x1000 and int.from_bytes(tables[0x1000][13:15], "big") & 0x1FFF in counters
        out, times = b"", []
        for u in units:
            assert u[:3] == b"\0\0\1" and int.from_bytes(u[4:6], "big") == len(u) - 6
            t = int.from_bytes(u[9:14], "big")
            times.append((t >> 33 & 7) << 30 | (t >> 17 & 0x7FFF) << 15 | t >> 1 & 0x7FFF)
            out += u[9 + u[8] :]
        assert out == data and times == [k * 1536 * 90_000 // 8000 for k in range(len(units))]


def test_streams_of_documents(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in documents(spark).collect()}
    for r in media.op8_transport_streams(spark, SF).collect():
        data = media.padded(texts[r.doc_id])
        assert len(data) % 192 == 0 and len(data) >= 192
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]))
        assert r.media_sha256 == hashlib.sha256(media.mux(data)).hexdigest()
    df = documents(spark).select("doc_id", "text")
    back = media.read_streams(media.write_streams(df, "doc_id", "text")).collect()
    assert {r.id: bytes(r.payload) for r in back} == texts and all(r.continuity_errors == r.broken == 0 for r in back)


def test_fingerprints_and_components(spark):
    import xxhash

    rows = simhash.op2_simhash_anchors(spark, SF).collect()
    texts = {r.doc_id: r.text for r in documents(spark).collect()}
    for r in rows[:40]:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), texts[r.doc_id]))
        shingles = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        assert r.fingerprint == f"{sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)):016x}"
    brute_components({r.doc_id: int(r.fingerprint, 16) for r in rows}, {r.doc_id: r.component_id for r in rows})


def brute_components(fps, found):
    ids = sorted(fps)
    f = np.array([fps[i] for i in ids], np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= 2
    label = np.array(ids)
    while True:
        new = np.where(near, label[None, :], max(ids) + 1).min(axis=1)
        if (new == label).all():
            break
        label = new
    assert found == dict(zip(ids, label.tolist()))


def test_crowded_anchors_lose_no_link(spark):
    """Far more members than MAX_MEMBERS around one anchor, chains and a dense cluster: the identity code takes over."""
    rng = np.random.default_rng(4)
    centre = int(rng.integers(0, 2**63))
    near = {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)} | {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in rng.integers(0, 64, (300, 3)).tolist()}
    chain = [int(rng.integers(0, 2**63))]
    for i in range(30):
        chain.append(chain[-1] ^ (3 << 2 * i))
    points = np.array(sorted(near | set(chain) | set(rng.integers(0, 2**63, 200).tolist())), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")

    d = np.bitwise_count(points[:, None] ^ points[None, :]) <= 2
    label = np.arange(len(points))
    while (new := np.where(d, label[None, :], len(points)).min(axis=1)).tolist() != label.tolist():
        label = new
    for code in simhash.CODES:
        pairs = {(r.node, r.root) for r in simhash.components(simhash.links(df, 2, code)).collect()}
        root = dict(pairs)
        groups = defaultdict(set)
        for p, k in zip(points.view(np.int64).tolist(), label.tolist()):
            groups[k].add(root.get(p, p))
        assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups), code


def test_codes_cover():
    x = np.random.default_rng(5).integers(0, 2**64, 2000, dtype=np.uint64)
    for code in simhash.CODES.values():
        assert sum(code) == 64
        home = simhash.homes(x, code)
        assert (simhash.homes(home, code) == home).all()
        at = 0
        for n in code:
            radius = {1: 0, 23: 3, 7: 1, 15: 1}.get(n, (n - 1) // 2)
            assert (np.bitwise_count((x ^ home) >> np.uint64(at) & np.uint64((1 << n) - 1)) <= radius).all()
            at += n


def test_quality_counts(spark, odd):
    for df in (documents(spark), odd):
        rows = quality.base_counts(df).collect()
        got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
        want = Counter()
        for r in df.collect():
            text = r.text or ""
            w = WORD.findall(text)
            grams = list(zip(w, w[1:], w[2:]))
            n = Counter(grams)
            covered = {p for i, g in enumerate(grams) if n[g] > 1 for p in (i, i + 1, i + 2)}
            lines = [x for x in text.split("\n") if WORD.search(x)]
            want[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))] += 1
        assert got == want


def test_bad_hosts_are_held_to_every_rule(spark):
    good = " ".join(f"word{i}" for i in range(80))
    soft = good + " " + "# " * 20
    rows = [(i, soft if i % 10 else good, "bad") for i in range(300)] + [(1000 + i, soft if i == 0 else good, "fine") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = {r.doc_id for r in quality.filter_documents(df).collect()}
    assert kept == {i for i in range(300) if i % 10 == 0} | {1000 + i for i in range(300)}


def test_shards(spark):
    df = documents(spark)
    rows = sharding.shards(df, 7, rows_per_bucket=13).collect()
    n = df.count()
    assert sorted(r.position for r in rows) == list(range(n))
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(k)) for s, k in sizes.items())
    mix = Counter((r.source, r.shard) for r in rows)
    for s in {r.source for r in rows}:
        assert max(mix[s, k] for k in sizes) - min(mix[s, k] for k in sizes) <= 1
    key = lambda r: (r.doc_id, r.text_crc32)
    other = sharding.shards(df, 7).collect()
    assert sorted((key(r), r.shard, r.slot) for r in rows) == sorted((key(r), r.shard, r.slot) for r in other)
    texts = {r.doc_id: (r.text or "").encode() for r in df.collect()}
    assert all((r.size, r.text_crc32) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id])) for r in rows)


def test_shards_against_a_plain_order(spark, odd):
    """Ranks in the shuffled sources, fractions of them, one sort, and cuts, all in plain Python."""
    for df, n_shards in ((documents(spark), 7), (odd.filter("doc_id IS NULL OR doc_id != 2").dropDuplicates(["doc_id", "text"]), 3)):
        sources = defaultdict(list)
        for r in df.collect():
            text = (r.text or "").encode()
            crc = zlib.crc32(text)
            h = int(hashlib.md5(f"42:{'~' if r.doc_id is None else r.doc_id}:{crc}".encode()).hexdigest()[:15], 16)
            sources["~" if r.source is None else f"={r.source}"].append((h, r.doc_id, crc))
        order = []
        for s, rows in sources.items():
            order += [((2 * k + 1) / (2 * len(rows)), s, k, x) for k, x in enumerate(sorted(rows, key=lambda x: (x[0], x[1] is not None, x[1] or 0)))]
        order.sort(key=lambda x: x[:3])
        q, more = divmod(len(order), n_shards)
        ends = [0]
        for k in range(n_shards):
            ends.append(ends[-1] + q + (k < more))
        want = {(x[1], x[2]): (k, at - ends[k]) for k in range(n_shards) for at, (*_, x) in enumerate(order) if ends[k] <= at < ends[k + 1]}
        for rows_per_bucket in (None, 5):
            got = {(r.doc_id, r.text_crc32): (r.shard, r.slot) for r in sharding.shards(df, n_shards, rows_per_bucket=rows_per_bucket).collect()}
            assert got == want


def test_mix_is_nested_and_near_its_targets(spark):
    df = documents(spark)
    taken = {}
    for share in (0.5, 1.0, 1.5):
        rows = mixing.mix(df, share=share).collect()
        by = defaultdict(list)
        for r in rows:
            by[r.source_size].append(r)
        assert all(abs(sum(x.taken for x in g) - g[0].target) <= max(x.size for x in g) for g in by.values())
        assert all(r.taken <= 2 * r.size for r in rows)
        taken[share] = {r.doc_id: r.copies for r in rows}
    assert all(taken[0.5][i] <= taken[1.0][i] <= taken[1.5][i] for i in taken[0.5])
    assert Counter(r.doc_id for r in mixing.mixed_documents(df).collect()) == Counter({i: c for i, c in taken[1.5].items() if c})


def test_rows_without_an_id_of_their_own_are_mixed_one_by_one(spark):
    for ids in (None, 7):
        df = spark.createDataFrame([(ids, f"{i} words of a text", "a") for i in range(100)] + [(1, "x " * 600, "b")], "doc_id long, text string, source string")
        got = mixing.mix(df, weights=(1, 1), share=0.5).filter("source_size = 500").collect()
        assert abs(sum(r.taken for r in got) - got[0].target) <= 5 and 0 < sum(r.copies for r in got) < 100


def test_sql_of_the_mix_with_null_ids(spark, odd, tmp_path):
    import duckdb

    odd.write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    a, b = mixing.op6_hash_threshold_mix(spark, str(tmp_path)).toPandas(), c.sql(mixing.ORACLE).df()
    rows = lambda df: sorted(map(str, df[sorted(df.columns)].astype("float").values.tolist()))
    assert rows(a) == rows(b)


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = packing.op7_vector_best_fit(spark, SF).collect()
    want, total = Counter(), 0
    for r in documents(spark).collect():
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        total += len(ids)
        for k, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want[(r.doc_id, k, at, len(cut), zlib.crc32(cut.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 4096
    assert len(places) <= math.ceil(total / 4096) + 1
    cut = stored(packing.pieces(documents(spark)))
    for block in (40, 90):
        again = packing.pack(cut, block=block).collect()
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in again) == want
        blocks = defaultdict(list)
        for r in again:
            blocks[r.sequence_id].append((r.offset, r.length))
        for p in blocks.values():
            p.sort()
            assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))] and sum(n for _, n in p) <= 4096
        assert len(blocks) <= 1.02 * len(places) + 1


def test_words_in_latin_1_need_only_the_model():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    words = [form.replace("_", chr(c)) for c in [*range(1, 9), *range(14, 32), *range(33, 256)] for form in ("_", "a_", "_a", "A_'s", "1_2", "__", "\xe9_x") if "<|" not in form]
    texts = [w.encode() for w in words]

    class Only:
        def encode_batch_fast(self, rest, **_):
            assert not rest
            return []

    ids.tokenizer = Only()
    want = [np.array(tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    assert ids.encode_all(texts) == want and ids.encode(b" ".join(texts)) == b"".join(want)


def test_a_worker_remembers_little():
    """Executors have little memory beside the JVM's, and several workers."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=8)).encode() + b"," for _ in range(150_000)]
    slices = [b" ".join(words[k : k + 5000]) for k in range(0, len(words), 5000)]
    ids = packing.WordIds(packing.tokenizer_path())
    tracemalloc.start()
    first = [ids.encode(x) for x in slices]
    once = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, first))
    assert first == [ids.encode(x) for x in slices]
    twice = tracemalloc.get_traced_memory()[0] - sum(map(sys.getsizeof, first))
    tracemalloc.stop()
    assert once < 10e6 and twice < 40e6
    assert len(ids.known) == len(ids.pieces) == packing.REMEMBERED < len(words)


def test_texts_go_to_python_in_small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = lambda batches: (pa.record_batch([pa.array([len(b)]), pa.array([b.nbytes])], ["n", "size"]) for b in batches)
    texts = spark.range(0, 20_000, 1, 1).select(F.repeat(F.lit("x"), F.when(F.col("id") < 2000, 10_000).otherwise(10).cast("int")).alias("text"))
    rows = stored(texts.mapInArrow(sizes, "n long, size long"), texts=True).collect()
    assert sum(r.n for r in rows) == 20_000 and max(r.n for r in rows) == 1000 and max(r["size"] for r in rows) < 5_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_ids_of_any_text():
    from tokenizers import Tokenizer

    tokenizer, ids = Tokenizer.from_file(packing.tokenizer_path()), packing.WordIds(packing.tokenizer_path())
    rng = random.Random(6)
    letters = [chr(c) for c in range(1, 256)] + list("'''sdtrevml  <|>ÀÉñΣςİı́̈𝔘漢字กา༄། 　ﬁ")
    for _ in range(1500):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert ids.encode(t.encode()) == np.array(tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    lengths = np.sort(np.random.default_rng(7).integers(1, 400, 3000))[::-1]
    of, at = packing.best_fit(lengths, 1000, 5, 300_000, rule=rule)
    for b in set(of.tolist()):
        n = lengths[of == b]
        assert n.sum() <= 1000 and len(n) <= 5 and (n * n).sum() <= 300_000
        assert sorted(at[of == b]) == np.r_[0, np.cumsum(n[np.argsort(at[of == b])])[:-1]].tolist()


def test_each_capacity_and_each_weight_decides():
    lengths = np.sort(np.random.default_rng(7).integers(1, 400, 3000))[::-1]
    bins = lambda *limits, **options: packing.best_fit(lengths, 1000, *limits, **options)[0]
    loose = bins(1000, 1000**2)
    fewest = -(-int(lengths.sum()) // 1000)
    assert fewest <= loose.max() + 1 <= fewest + 1
    assert bins(4, 1000**2).max() > loose.max() and bins(1000, 250_000).max() > loose.max()
    assert (bins(6, 400_000) != bins(6, 400_000, weights=(1.0, 0.0, 0.0))).any()
    assert (bins(6, 400_000) != bins(6, 400_000, rule="dot")).any()


def test_pieces_that_leave_every_sequence_open_end(spark):
    rows = [(i, 0, 0, 2100, i) for i in range(300)]
    cut = stored(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"))
    assert packing.pack(cut, block=30).select("sequence_id").distinct().count() == 300


def brute_katz(rows, order):
    """Recursive evaluation over counters; n-grams are tuples of words."""
    docs = [(i, zlib.crc32(str(i).encode()) % 7 == 2 if i is not None else False, [*(x or "").encode().lower().split(), b"</s> "]) for i, x in rows]
    padded = lambda w: [b"<s> "] * (order - 1) + w
    counts, totals = [Counter() for _ in range(order + 1)], [Counter() for _ in range(order + 1)]
    for _, held, w in docs:
        if not held:
            p = padded(w)
            for k in range(order - 1, len(p)):
                for n in range(1, order + 1):
                    gram = tuple(p[k - n + 1 : k + 1])
                    counts[n][gram] += 1
                    totals[n][gram[:-1]] += 1
    rates = [None, *(katz.discounts([sum(x == r for x in c.values()) for r in range(1, katz.K + 2)]) for c in counts[1:])]
    after = [defaultdict(list) for _ in range(order + 1)]
    for n in range(1, order + 1):
        for gram in counts[n]:
            after[n][gram[:-1]].append(gram[-1])
    total = totals[1][()]
    seen = lambda n, gram: rates[n][min(counts[n][gram], katz.K + 1)] * counts[n][gram] / totals[n][gram[:-1]]
    unseen = 1 - sum(seen(1, g) for g in counts[1])
    alphas = {}

    def alpha(context):
        if context not in alphas:
            n = len(context) + 1
            words = after[n][context]
            alphas[context] = (1 - sum(seen(n, (*context, w)) for w in words)) / (1 - sum(probability(context[1:], w) for w in words))
        return alphas[context]

    def probability(context, w):
        n = len(context) + 1
        if counts[n][(*context, w)]:
            return seen(n, (*context, w))
        if n == 1:
            return unseen
        return (alpha(context) if totals[n][context] else 1.0) * probability(context[1:], w)

    for n in range(2, order + 1):  # every context's probabilities add up to one
        for context in list(totals[n])[:10]:
            whole = sum(probability(context, w) for (w,) in counts[1]) + probability(context, b"a word of no text")
            assert whole == pytest.approx(1)
    for i, held, w in docs:
        p = padded(w)
        score = sum(math.log10(probability(tuple(p[k - order + 1 : k]), p[k])) for k in range(order - 1, len(p))) if total else 0.0
        base = sum(math.log10((counts[1][(x,)] + 1) / (total + len(counts[1]) + 1)) for x in w)
        yield i, held, len(w), sum((x,) in counts[1] for x in w), total, base, score


@pytest.mark.parametrize("settings", [{}, {"order": 2, "bucket_tokens": 20_000}, {"order": 3, "bucket_tokens": 9_000, "limit": 40, "chunk_tokens": 6_000}, {"order": 4, "limit": 300, "chunk_tokens": 20_000}, {"order": 1}])
def test_katz(spark, settings):
    docs = documents(spark)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    got = {r.doc_id: r for r in katz.score_corpus(docs, held, **settings).collect()}
    for i, held_out, *counts, base, score in brute_katz([(r.doc_id, r.text) for r in docs.collect()], settings.get("order", 3)):
        r = got[i]
        assert [r.held_out, r.n_tokens, r.n_known, r.train_tokens] == [held_out, *counts]
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score, rel=1e-9)


def test_numbers_are_dealt_evenly(spark):
    for n in (1, 7, 34):
        rows = dealt_evenly(spark.range(5 * n).withColumnRenamed("id", "b"), "b", n).select("b", F.spark_partition_id().alias("p")).collect()
        assert Counter(r.p for r in rows) == Counter({p: 5 for p in range(n)})
        assert len({(r.b % n, r.p) for r in rows}) == n


def test_katz_in_many_chunks():
    """Chunks of some documents each, as tasks make them, and words beyond every table's first bucket."""
    c = katz.Chunk([1, None], np.array([True, False]), np.array([2, 3]), np.array([0, 7, 1 << 40]), np.array([2, 5, 1]), np.array([1, 2, 1, 1, 2]))
    d = katz.Chunk.unpacked(c.packed())
    assert d.ids == c.ids and all((getattr(c, k) == getattr(d, k)).all() for k in ("held", "sizes", "names", "counts", "at"))
    rng = np.random.default_rng(8)
    columns = [rng.integers(0, 1 << 30, 500) % m for m in (3, 1 << 29, 7)]
    n, first, at = katz.dense(columns)
    tuples = list(zip(*(x.tolist() for x in columns)))
    assert n == len(set(tuples)) and [tuples[k] for k in first] == sorted(set(tuples)) and all(tuples[first[k]] == t for k, t in zip(at, tuples))
    for keys in (columns[0], columns[1] << 31, np.array([], np.int64), np.array([7])):
        for a, b in zip(katz.ranked(keys), np.unique(keys, return_index=True, return_inverse=True)):
            assert (a == b).all()
    for a in (np.array([], np.int64), np.array([5, 3, 1 << 50]), np.arange(9) * 1000, np.array([2**64 - 1, 3], np.uint64), np.array([0.5, -1.0])):
        assert (katz.unpack(katz.pack(a))[0] == a.view(np.int64 if a.dtype == np.uint64 else a.dtype)).all()


def plain_clauses(text, lexicon, w):
    """The scores of the matched clauses, clause by clause and word by word."""
    fixed = {x: kind for kind, words in toxicity.WORDS.items() for x in words}
    clauses, words = [], []
    for token in text.split():
        words.append(re.sub(r"^[\W_]+|[\W_]+$", "", token.lower().replace("\u2019", "'")))
        if token == "|" or token[-1] in ".!?;:":
            clauses.append(words)
            words = []
    found = []
    for words in [*clauses, words]:
        insults = {k: max(v for x, v in lexicon.items() if (word.startswith(x[:-1]) if x[-1] == "*" else word == x)) for k, word in enumerate(words) if any(word.startswith(x[:-1]) if x[-1] == "*" else word == x for x in lexicon)}
        kinds = [None if k in insults else fixed.get(x) for k, x in enumerate(words)]
        negated = lambda k: toxicity.NEGATION in kinds[max(0, k - toxicity.REACH) : k]  # noqa: E731,B023
        target = toxicity.TARGET in kinds
        score = sum(v * (w.negated if negated(k) else 1) for k, v in insults.items()) * (w.aimed if target else 1)
        if target:
            score += max((w.threat * (w.denied if negated(k) else 1) for k, x in enumerate(kinds) if x == toxicity.THREAT), default=0)
        if score > 0:
            found.append(score * (w.reported if toxicity.REPORT in kinds else 1))
    return found


def test_grammar():
    g = toxicity.Grammar({"foul": 2.0, "vil*": 1.0})
    score = lambda t: sum(g.clauses(t)[0])
    assert score("a calm text") == 0 == score("") and score("foul thing") == 2.0 == score("FOUL!! thing")
    assert score("you foul thing") == 3.0 and score("not foul") == 1.0 and score("villain") == 1.0
    assert score("they said you foul thing") < score("you foul thing")
    assert score("i will hurt you") == 3.0 and score("i will hurt") == 0
    assert score("i will not hurt you") == score("i will never kill you") == score("i won\u2019t hurt you") == 3.0 * g.weights.denied < 1
    assert score("i will not sleep until one day i hurt you") == 3.0 == score("i will not hurt you, i will kill you")
    assert score("you. foul thing") == 2.0  # the target is in another clause
    assert len(toxicity.compose().next) == 2 * 2 * 2 * 2 * 5


def test_grammar_against_word_by_word_scoring():
    lexicon = {"foul": 2.0, "vil*": 1.0, "rot": 0.7, "rott*": 1.9}
    g, rng = toxicity.Grammar(lexicon), random.Random(9)
    words = ["foul", "Villain", "rot", "ROTTEN", "kill", "hurt", "you", "them", "not", "never", "said", "laut", "the", "day", "calm", "it's", "don\u2019t", "|", "umbringen", "dich", "nicht"]
    for _ in range(3000):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ".", ",", "!", ";"]) for _ in range(rng.randrange(25)))
        found, n = g.clauses(text)
        assert found == pytest.approx(plain_clauses(text, lexicon, g.weights)) and n == len(text.split())


def test_labels_that_disagree_and_ids_that_repeat(spark):
    rows = [(i, f"you foul{i % 3} thing of number {i}" if i % 2 else f"a calm day of number {i}") for i in range(60)] + [(1, "another text of the same id")] * 500
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1), (4, 0)], "doc_id long, toxic int")
    table = toxicity.labelled_texts(docs, labels, max_labelled=40)
    assert table.count() == 40
    first = sorted(map(tuple, toxicity.labelled_texts(docs, labels).collect()))
    again = sorted(map(tuple, toxicity.labelled_texts(docs.repartition(5), labels.repartition(3)).collect()))
    assert first == again and len(first) == 60 and sum(t for _, t in first) == 30


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [(r.score, r.predicted, labels[r.doc_id]) for r in toxicity.op10_pattern_grammar(spark, sf).collect() if r.held_out and r.doc_id in labels]
    toxic = [r for r in rows if r[2] == 1]
    assert sum(p == y for _, p, y in rows) / len(rows) > 0.97 and sum(p for _, p, _ in toxic) / len(toxic) > 0.85
    assert sum(p for _, p, y in rows if y == 0) / len(rows) < 0.01
