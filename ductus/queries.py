"""Queries over the driver's tables, one for each operator, with SQL for DuckDB where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ductus.functions import folds, script
from ductus.functions.draws import duck_draws, duck_uniform
from ductus.operators import augment, clean, evaluate, language_model, lines as line_ops, rerank, rules as rule_ops, tokenise, vocab
from ductus.plans import fixture
from ductus.plans.fixture import RULES, SQL, latin_lines, script_lines
from ductus.plans.modes import RowGenerator, normalise
from ductus.sources import arpa, dictionaries, reports
from ductus.sources.names import MODES
from ductus.sources.text import first_lines

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
KEY = ["doc_id", "line_no"]
PLACE = lambda: F.concat_ws(":", "doc_id", "line_no")
DUCK_PLACE = "doc_id::VARCHAR || ':' || line_no::VARCHAR"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _text(name: str, column, sql_expression: str, source: str = "lines"):
    """A query of one expression over each line, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        lines = (script_lines if source == "lines" else latin_lines)(spark, sf_dir)
        return lines.select(*KEY, column().alias("result"))

    run.__name__ = name
    query(f"WITH {SQL} SELECT doc_id, line_no, {sql_expression} AS result FROM {source}")(run)


def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', '')"


def _sql_keep(x: str) -> str:
    return f"regexp_replace({x}, '[^\\x{{0F00}}-\\x{{0FFF}} ]', '', 'g')"


def _sql_double(x: str) -> str:
    return f"regexp_replace({x}, '།།([^ །])', '།། \\1', 'g')"


def _sql_punctuation(x: str, shads: tuple[str, ...]) -> str:
    for s in shads:
        x = f"replace({x}, '{s}', '།')"
    return f"regexp_replace(regexp_replace(regexp_replace({x}, '།([^།\\s])', '། \\1', 'g'), '།$', '། '), '་{{2,}}', '་', 'g')"


def _sql_expand(x: str) -> str:
    for a, e in RULES:
        x = f"replace({x}, '{a}', '{e}')"
    return x


def _sql_marks(x: str) -> str:
    for m in script.MARKS:
        for found in (f" {m} ", f" {m}", f"{m} "):
            x = f"replace({x}, '{found}', '{m}')"
    return x


T = lambda: F.col("text")

# Scalar text functions.
_text("clean_keep_script", lambda: script.keep_script(T()), _sql_keep("text"))
_text("double_shad_spacing", lambda: script.space_after_double_shad(T()), _sql_double("text"))
_text("mark_repair", lambda: script.join_marks(T()), _sql_marks("text"))
_text("punct_postproc", lambda: script.fix_punctuation(T(), script.FILE_SHADS), _sql_punctuation("text", script.FILE_SHADS))
_text("punct_infer", lambda: script.fix_punctuation(T(), script.MODE_SHADS), _sql_punctuation("text", script.MODE_SHADS))
_text(
    "split_syllables",
    lambda: F.array_join(script.syllables(T()), "|"),
    "array_to_string(list_filter(regexp_extract_all(text, '(?s)[^་]*་|[^་]+$'), lambda x: x[-1] = '་' OR regexp_matches(x, '\\S')), '|')",
)
_text("syllable_spans", lambda: F.array_join(script.syllable_spans(T()), "|"), f"array_to_string(regexp_extract_all(text, '[^{script.DELIMITERS}]+[{script.DELIMITERS}]'), '|')")
_text("boundaries", lambda: F.array_join(script.boundaries(T()), ","), f"array_to_string(list_filter(range(0, length(text)), lambda i: contains('{script.DELIMITERS}', text[i + 1])), ',')")
_text("char_places", lambda: F.array_join(script.places_of(T(), "ན"), ","), "array_to_string(list_filter(range(0, length(text)), lambda i: text[i + 1] = 'ན'), ',')")
_text("char_space_corpus", lambda: script.spaced_chars(T()), f"array_to_string(regexp_extract_all({_sql_strip('text')}, '(?s).'), ' ')")
_text("abbrev_expand", lambda: rule_ops.expand(T(), RULES), _sql_expand("text"))
_text("abbrev_expand_arrow", lambda: folds.expanded(T(), RULES), _sql_expand("text"))
_text("rules_mode", lambda: rule_ops.normalise(T(), RULES), _sql_punctuation(_sql_expand("text"), script.MODE_SHADS))
_text("count_occurrences", lambda: script.count_of(T(), "ན་"), "((length(text) - length(replace(text, 'ན་', ''))) // 2)::BIGINT")
_text("script_chars", lambda: F.length(script.keep_script(T())).cast("long"), f"length({_sql_keep('text')})::BIGINT")
_text("punctuation_chars", lambda: F.size(F.filter(script.chars(T()), script.is_punctuation)).cast("long"), "len(regexp_extract_all(text, '[\\x{0F04}-\\x{0F0A}\\x{0F0D}-\\x{0F1F}\\x{0F34}\\x{0F36}\\x{0F38}\\x{0F3A}-\\x{0F3F}]'))::BIGINT")


@query(f"""WITH {SQL}, m AS (SELECT doc_id, line_no, CASE WHEN line_no % 3 = 0 THEN text || ' <utt>' ELSE text END AS text FROM latin)
SELECT doc_id, line_no, contains(text, '<utt>') AS has, CASE WHEN contains(text, '<utt>') THEN {_sql_strip("replace(text, '<utt>', '')")} ELSE text END AS body,
  CASE WHEN contains(text, '<utt>') THEN {_sql_strip("replace(text, '<utt>', '')")} || ' <utt>' ELSE text END AS again FROM m""")
def utt_detach(spark, d):
    rows = latin_lines(spark, d).withColumn("text", F.when(F.col("line_no") % 3 == 0, F.concat("text", F.lit(" <utt>"))).otherwise(F.col("text")))
    body, has = script.detach_utterance(T())
    return rows.select(*KEY, has.alias("has"), body.alias("body"), script.attach_utterance(body, has).alias("again"))


def _sql_count(x: str, part: str) -> str:
    return f"((length({x}) - length(replace({x}, '{part}', ''))) // {len(part)})"


_SHADS = "replace(replace(text, '༑', '།'), '༏', '།')"
_SPACED = f"regexp_replace(regexp_replace({_SHADS}, '།([^།\\s])', '། \\1', 'g'), '།$', '། ')"


@query(f"""WITH {SQL} SELECT doc_id, line_no, {_sql_count('text', '༑')}::BIGINT AS rin, {_sql_count('text', '༏')}::BIGINT AS tsheg_shad,
  ({_sql_count(_SPACED, '། ')} - {_sql_count(_SHADS, '། ')})::BIGINT AS spacing, (length({_SPACED}) - length(regexp_replace({_SPACED}, '་{{2,}}', '་', 'g')))::BIGINT AS tshegs FROM lines""")
def change_log_counts(spark, d):
    log = script.punctuation_changes(T())
    n = lambda a, b: F.aggregate(F.filter(F.col("log"), lambda x: (x["from"] == a) & (x["to"] == b)), F.lit(0).cast("long"), lambda s, x: s + x["count"])
    rows = script_lines(spark, d).withColumn("log", log)
    return rows.select(*KEY, n("༑", "།").alias("rin"), n("༏", "།").alias("tsheg_shad"), n("།", "། ").alias("spacing"), n("་་", "་").alias("tshegs"))


# Dictionaries: a row for every line, its first word and the rest of it.
def _dictionary_lines(spark, d):
    t = F.col("text")
    first, rest = F.regexp_extract(t, "^([^ ]*)", 1), F.regexp_extract(t, r"(?s)^[^ ]* *(.*)\z", 1)
    row = F.concat(F.lit("["), first, F.lit("]\tx ["), rest, F.lit("]"))
    number = F.col("doc_id") * 1_000_000 + F.col("line_no")
    return latin_lines(spark, d).select(number.alias("line_no"), F.when(number % 7 == 6, F.translate(row, "\t", " ")).otherwise(row).alias("text"))


_DICTIONARY = f"""{SQL}, w AS (SELECT doc_id * 1000000 + line_no AS line_no, regexp_extract(text, '^([^ ]*)', 1) AS a, regexp_extract(text, '^[^ ]* *(.*)$', 1) AS e FROM latin),
dl AS (SELECT line_no, CASE WHEN line_no % 7 = 6 THEN replace('[' || a || '] x [' || e || ']', chr(9), ' ') ELSE '[' || a || ']' || chr(9) || 'x [' || e || ']' END AS text FROM w)"""


@query(f"""WITH {_DICTIONARY}, p AS (SELECT line_no, regexp_extract(string_split(text, chr(9))[1], '\\[([^\\]]+)\\]', 1) AS a, regexp_extract(string_split(text, chr(9))[2], '\\[([^\\]]+)\\]', 1) AS e
  FROM dl WHERE contains(text, chr(9))),
q AS (SELECT line_no, CASE WHEN a[-1] = '་' THEN a ELSE a || '་' END AS a, CASE WHEN e[-1] = '་' THEN e ELSE e || '་' END AS e FROM p WHERE a <> '' AND e <> ''),
g AS (SELECT a AS abbrev, arg_max(e, line_no) AS expansion, min(line_no) AS first FROM q GROUP BY a)
SELECT (row_number() OVER (ORDER BY length(abbrev) DESC, first))::INT AS rank, abbrev, expansion FROM g""")
def load_rules_dict(spark, d):
    return dictionaries.rules(_dictionary_lines(spark, d))


@query(f"""WITH {_DICTIONARY}, b AS (SELECT line_no, trim(regexp_replace(text, '[\\[\\]]', '', 'g')) AS t FROM dl)
SELECT line_no AS ord, trim(regexp_extract(t, '^(.*?)(\\t+|\\s{{2,}})', 1)) AS abbrev, trim(regexp_replace(t, '^(.*?)(\\t+|\\s{{2,}})', '')) AS expansion FROM b WHERE regexp_matches(t, '\\t|\\s\\s')""")
def dict_pairs(spark, d):
    return dictionaries.pairs(_dictionary_lines(spark, d), empty=True)


# Vocabularies.
_FIXED_SQL = "SELECT chr(i::INT) AS ch FROM range(3840, 4096) t(i) UNION SELECT unnest(regexp_extract_all('!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~0123456789 ', '.')) AS ch"
_VOCAB = f"""seen AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM lines),
every AS (SELECT ch FROM seen UNION {_FIXED_SQL}),
vocab AS (SELECT ch, (row_number() OVER (ORDER BY ch) + 3)::INT AS idx FROM every UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<sos>', 1), ('<eos>', 2), ('<unk>', 3)) v(ch, idx))"""


@query(f"WITH {SQL}, {_VOCAB} SELECT ch, idx FROM vocab")
def vocab_build(spark, d):
    return vocab.build(script_lines(spark, d))


@query(f"WITH {SQL} SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch, count(*)::BIGINT AS n FROM lines GROUP BY 1")
def char_counts(spark, d):
    return vocab.char_counts(script_lines(spark, d))


@query(f"""WITH {SQL}, s AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM lines), t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM latin),
a AS (SELECT coalesce(s.ch, t.ch) AS ch, (s.ch IS NOT NULL)::INT AS s, (t.ch IS NOT NULL)::INT AS t FROM s FULL JOIN t ON s.ch = t.ch)
SELECT sum(s)::BIGINT AS source_size, sum(t)::BIGINT AS target_size, sum(s * t)::BIGINT AS shared, round(sum(s * t) / sum(t), 9) AS share FROM a""")
def vocab_overlap(spark, d):
    source, target = vocab.build(script_lines(spark, d), fixed=False), vocab.build(latin_lines(spark, d), fixed=False)
    return vocab.overlap(source, target).withColumn("share", F.round("share", 9))


@query(f"""WITH {SQL}, {_VOCAB}, m AS (SELECT map(list(ch), list(idx)) AS m FROM vocab),
c AS (SELECT doc_id, line_no, regexp_extract_all(text, '(?s).') AS c FROM lines)
SELECT doc_id, line_no, '1,' || array_to_string(list_transform(list_slice(c, 1, 98), lambda x: coalesce(m[x], 3)), ',') || CASE WHEN len(c) > 0 THEN ',' ELSE '' END || '2' AS framed,
  array_to_string(list_transform(c, lambda x: coalesce(m[x], 3)), ',') AS plain FROM c, m""")
def encode(spark, d):
    rows = script_lines(spark, d)
    ids = vocab.as_map(vocab.build(rows))
    return rows.select(*KEY, F.array_join(vocab.encode(T(), ids), ",").alias("framed"), F.array_join(vocab.encode(T(), ids, frame=False), ",").alias("plain"))


@query(f"WITH {SQL} SELECT doc_id, line_no, substr(text, 1, 98) AS result FROM lines")
def decode_roundtrip(spark, d):
    rows = script_lines(spark, d)
    ids = vocab.as_map(vocab.build(rows))
    return rows.select(*KEY, vocab.decode(vocab.encode(T(), ids), ids).alias("result"))


# Splits and statistics.
@query("""WITH n AS (SELECT count(*) AS n, greatest(1, floor(count(*) * 0.1)::BIGINT) AS k FROM documents), r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p FROM documents)
SELECT doc_id, CASE WHEN p >= n - k THEN 'test' WHEN p >= n - 2 * k THEN 'val' ELSE 'train' END AS part FROM r, n""")
def contiguous_split(spark, d):
    return line_ops.contiguous_split(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), ["doc_id"])


@query(f"""WITH {SQL}, s AS (SELECT {_sql_strip('text')} AS t FROM latin), k AS (SELECT len(regexp_extract_all(t, '\\S+')) AS k FROM s WHERE t <> '')
SELECT count(*)::BIGINT AS lines, sum(k)::BIGINT AS tokens, round(avg(k), 9) AS tokens_per_line FROM k""")
def corpus_stats(spark, d):
    return language_model.corpus_statistics(latin_lines(spark, d)).withColumn("tokens_per_line", F.round("tokens_per_line", 9))


@query(f"WITH {SQL} SELECT count(*)::BIGINT AS total, sum((length(text) BETWEEN 100 AND 120)::INT)::BIGINT AS in_range, sum((NOT length(text) BETWEEN 100 AND 120)::INT)::BIGINT AS out_of_range FROM lines")
def length_buckets(spark, d):
    return line_ops.length_buckets(script_lines(spark, d), 100, 120)


@query(f"""WITH {SQL} SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM lines GROUP BY doc_id""")
def join_lines(spark, d):
    return line_ops.join_lines(script_lines(spark, d), "doc_id")


# Evaluation: the target is the cleaned line, the source a copy with letters changed, the hypothesis rules mode on it.
def _pairs(spark, d, *more):
    rows = script_lines(spark, d, *more).select(*KEY, *more, script.keep_script(T()).alias("target"))
    rows = rows.withColumn("source", F.when(F.col("line_no") % 2 == 0, F.translate("target", "ནས", "མཔ")).otherwise(F.replace("target", F.lit("ེ་"), F.lit("ི་"))))
    return rows.withColumn("hypothesis", rule_ops.normalise(F.col("source"), RULES))


_PAIRS = f"""pt AS (SELECT doc_id, line_no, {_sql_keep('text')} AS target FROM lines),
ps AS (SELECT *, CASE WHEN line_no % 2 = 0 THEN translate(target, 'ནས', 'མཔ') ELSE replace(target, 'ེ་', 'ི་') END AS source FROM pt),
pairs AS (SELECT *, {_sql_punctuation(_sql_expand('source'), script.MODE_SHADS)} AS hypothesis FROM ps)"""
_ASCII = lambda x: f"translate({x}, '{fixture.SCRIPT}ཨྀ', '{fixture.ASCII}LM')"
_CHARS = lambda x: f"regexp_extract_all({x}, '(?s).')"
_CER = f"CASE WHEN length(target) = 0 THEN CASE WHEN length(hypothesis) = 0 THEN 0.0 ELSE 1.0 END ELSE levenshtein({_ASCII('target')}, {_ASCII('hypothesis')}) / length(target)::DOUBLE END"
_STATS = f"""st AS (SELECT doc_id, line_no, {_CER} AS cer,
  len(list_filter(list_zip({_CHARS('target')}, {_CHARS('hypothesis')}), lambda x: x[1] = x[2]))::BIGINT AS matches,
  length(target)::BIGINT AS n_reference, length(hypothesis)::BIGINT AS n_hypothesis,
  len(list_filter(list_zip({_CHARS('source')}, {_CHARS('target')}), lambda x: x[1] IS DISTINCT FROM x[2]))::BIGINT AS e_total,
  len(list_filter(list_zip({_CHARS('source')}, {_CHARS('hypothesis')}), lambda x: x[1] IS DISTINCT FROM x[2]))::BIGINT AS e_ident,
  len(list_filter(list_zip({_CHARS('source')}, {_CHARS('target')}, {_CHARS('hypothesis')}), lambda x: x[1] IS DISTINCT FROM x[2] AND x[3] IS NOT DISTINCT FROM x[2]))::BIGINT AS c_corr FROM pairs)"""
_METRICS = """me AS (SELECT {by} count(*)::BIGINT AS n, sum(cer) / count(*) AS cer, sum(matches) / nullif(sum(n_hypothesis), 0) AS p, sum(matches) / nullif(sum(n_reference), 0) AS r,
  sum(c_corr) / nullif(sum(e_total), 0) AS cr, sum(c_corr) / nullif(sum(e_ident), 0) AS cp, sum(e_total)::BIGINT AS total_errors, sum(c_corr)::BIGINT AS correctly_corrected, sum(e_ident)::BIGINT AS identified_errors FROM {source} {group})"""
_METRICS_OUT = "n, round(cer, 9) AS character_error_rate, round(coalesce(p, 0), 9) AS precision, round(coalesce(r, 0), 9) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 9) AS f1_score, round(coalesce(cr, 0), 9) AS correcting_recall, round(coalesce(cp, 0), 9) AS correcting_precision, total_errors, correctly_corrected, identified_errors"


def _rounded(df):
    return df.withColumns({m: F.round(m, 9) for m in evaluate.METRICS})


@query(f"WITH {SQL}, {_PAIRS} SELECT doc_id, line_no, round({_CER}, 9) AS cer FROM pairs")
def cer_per_line(spark, d):
    return _pairs(spark, d).select(*KEY, F.round(evaluate.character_error_rate(F.col("target"), F.col("hypothesis")), 9).alias("cer"))


@query(f"WITH {SQL}, {_PAIRS}, {_STATS} SELECT doc_id, line_no, matches, n_reference, n_hypothesis, e_total, e_ident, c_corr FROM st")
def line_statistics(spark, d):
    return evaluate.line_statistics(_pairs(spark, d)).select(*KEY, *evaluate.STATISTICS[1:])


@query(f"WITH {SQL}, {_PAIRS}, {_STATS}, {_METRICS.format(by='', source='st', group='')} SELECT {_METRICS_OUT} FROM me")
def metrics_all(spark, d):
    return _rounded(evaluate.metrics(evaluate.line_statistics(_pairs(spark, d))))


@query(f"WITH {SQL}, {_PAIRS}, {_STATS}, sl AS (SELECT st.*, lang FROM st JOIN documents USING (doc_id)), {_METRICS.format(by='lang,', source='sl', group='GROUP BY lang')} SELECT lang, {_METRICS_OUT} FROM me")
def metrics_by_language(spark, d):
    return _rounded(evaluate.metrics(evaluate.line_statistics(_pairs(spark, d, "lang")), "lang"))


_ITERATION = {"cer": "character_error_rate", "precision": "precision", "recall": "recall", "f1": "f1_score", "cr": "correcting_recall", "cp": "correcting_precision"}
_WEIGHT = " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in evaluate.POISSON.tolist())


_BOOTSTRAP = f"""WITH {SQL}, {_PAIRS}, {_STATS}, dr AS (SELECT st.*, i, {duck_draws(42, DUCK_PLACE, 'i')} AS u FROM st, range(0, 1000) r(i)),
we AS (SELECT *, ({_WEIGHT})::BIGINT AS w FROM dr),
su AS (SELECT i, sum(w) AS n, sum(cer * w) AS cer, sum(matches * w) AS matches, sum(n_hypothesis * w) AS nh, sum(n_reference * w) AS nr, sum(e_total * w) AS et, sum(e_ident * w) AS ei, sum(c_corr * w) AS cc FROM we GROUP BY i HAVING sum(w) > 0),
pr AS (SELECT cer / n AS cer, coalesce(matches / nullif(nh, 0), 0) AS precision, coalesce(matches / nullif(nr, 0), 0) AS recall, coalesce(cc / nullif(et, 0), 0) AS cr, coalesce(cc / nullif(ei, 0), 0) AS cp FROM su),
va AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM pr),
ci AS ({" UNION ALL ".join(f"SELECT '{m}' AS metric, round(quantile_cont({c}, 0.025), 9) AS lower, round(quantile_cont({c}, 0.975), 9) AS upper FROM va" for c, m in _ITERATION.items())})"""


def _intervals(spark, d):
    stats = evaluate.line_statistics(_pairs(spark, d)).select(PLACE().alias("place"), *evaluate.STATISTICS)
    return evaluate.bootstrap_intervals(stats, "place").select("metric", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"))


@query(f"{_BOOTSTRAP} SELECT * FROM ci")
def bootstrap_ci(spark, d):
    return _intervals(spark, d)


@query(f"{_BOOTSTRAP} SELECT metric, round((upper - lower) * 50, 6) AS half_width FROM ci")
def half_widths(spark, d):
    return evaluate.half_widths(_intervals(spark, d)).withColumn("half_width", F.round("half_width", 6))


# Language models.
_ORDER = 5
#: n-grams as strings: \x02 is the start of a line, \x03 its end.
_NGRAMS = f"""{SQL}, ch AS (SELECT regexp_extract_all(chr(2) || regexp_replace(text, '\\s', '', 'g') || chr(3), '(?s).') AS x FROM lines WHERE regexp_matches(text, '\\S')),
five AS (SELECT unnest(list_zip(x, x[2:], x[3:], x[4:], x[5:])) AS p FROM ch), w AS (SELECT p[1] AS a, p[2] AS b, p[3] AS c, p[4] AS d, p[5] AS e, count(*) AS k FROM five GROUP BY ALL),
g AS (SELECT n::INT AS n, a || CASE WHEN n > 1 THEN b ELSE '' END || CASE WHEN n > 2 THEN c ELSE '' END || CASE WHEN n > 3 THEN d ELSE '' END || CASE WHEN n > 4 THEN e ELSE '' END AS g, k FROM w, range(1, 6) r(n)),
c AS (SELECT n, g, sum(k)::BIGINT AS c FROM g WHERE g IS NOT NULL GROUP BY n, g)"""
_SHOWN = f"array_to_string(list_transform({_CHARS('g')}, lambda x: CASE x WHEN chr(2) THEN '<s>' WHEN chr(3) THEN '</s>' ELSE x END), ' ')"


@query(f"WITH {_NGRAMS} SELECT n, {_SHOWN} AS ngram, c FROM c")
def ngram_counts(spark, d):
    return language_model.ngram_counts(script_lines(spark, d), _ORDER)


_KN = f"""{_NGRAMS},
lft AS (SELECT n - 1 AS n, substr(g, 2) AS g, count(*) AS l FROM c WHERE n > 1 GROUP BY ALL),
adj AS (SELECT c.n, c.g, c.c, CASE WHEN c.n = {_ORDER} OR left(c.g, 1) = chr(2) THEN c.c ELSE coalesce(l, c.c) END AS a FROM c LEFT JOIN lft ON c.n = lft.n AND c.g = lft.g WHERE c.g <> chr(2)),
tk AS (SELECT n, sum((a = 1)::INT) AS t1, sum((a = 2)::INT) AS t2, sum((a = 3)::INT) AS t3, sum((a = 4)::INT) AS t4 FROM adj GROUP BY n),
dk AS (SELECT n, t1 / (t1 + 2.0 * t2) AS y, t1, t2, t3, t4 FROM tk),
dr AS (SELECT n, CASE WHEN t1 > 0 THEN 1 - 2 * y * t2 / t1 END AS x1, CASE WHEN t1 > 0 AND t2 > 0 THEN 2 - 3 * y * t3 / t2 END AS x2, CASE WHEN t1 > 0 AND t3 > 0 THEN 3 - 4 * y * t4 / t3 END AS x3 FROM dk),
dd AS (SELECT n, CASE WHEN x1 > 0 AND x1 <= 1 THEN x1 ELSE 0.5 END AS d1, CASE WHEN x2 > 0 AND x2 <= 2 THEN x2 ELSE 1.0 END AS d2, CASE WHEN x3 > 0 AND x3 <= 3 THEN x3 ELSE 1.5 END AS d3 FROM dr)"""


@query(f"WITH {_KN} SELECT n, round(d1, 9) AS d1, round(d2, 9) AS d2, round(d3, 9) AS d3 FROM dd")
def kn_discounts(spark, d):
    counts = language_model.adjusted_counts(language_model.ngram_counts(script_lines(spark, d), _ORDER), _ORDER)
    out = language_model.discounts(counts.filter(F.col("ngram") != language_model.BOS))
    return out.select("n", *[F.round(c, 9).alias(c) for c in ("d1", "d2", "d3")])


_LM = f"""{_KN}, rw AS (SELECT adj.n, g, left(g, adj.n - 1) AS ctx, a, CASE a WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS d, c > {list(language_model.PRUNE)}[adj.n] AS kept FROM adj JOIN dd ON adj.n = dd.n),
sm AS (SELECT n, ctx, sum(a) AS den, 1 - sum(CASE WHEN kept THEN a - d ELSE 0.0 END) / sum(a) AS gamma FROM rw GROUP BY n, ctx),
u AS (SELECT rw.n, g, rw.ctx, (a - d) / den AS u, gamma FROM rw JOIN sm ON rw.n = sm.n AND rw.ctx = sm.ctx WHERE kept),
k AS (SELECT count(*) + 1 AS k FROM u WHERE n = 1),
p1 AS (SELECT n, g, u + gamma / k AS p FROM u, k WHERE n = 1),
{"".join(f"p{n} AS (SELECT u.n, u.g, u.u + u.gamma * p{n - 1}.p AS p FROM u JOIN p{n - 1} ON substr(u.g, 2) = p{n - 1}.g WHERE u.n = {n})," for n in range(2, _ORDER + 1))}
p AS ({" UNION ALL ".join(f"FROM p{n}" for n in range(1, _ORDER + 1))} UNION ALL SELECT 1, chr(2), 1e-99 UNION ALL SELECT 1, '<unk>', gamma / k FROM sm, k WHERE n = 1),
bk AS (SELECT n - 1 AS n, ctx, gamma FROM sm WHERE n > 1 AND gamma > 0),
lm AS (SELECT p.n, g, log10(p) AS lp, coalesce(log10(gamma), 0.0) AS bo FROM p LEFT JOIN bk ON p.n = bk.n AND p.g = bk.ctx)"""


def _model(spark, d):
    return language_model.estimate(script_lines(spark, d), _ORDER)


@query(f"WITH {_LM} SELECT n, CASE WHEN g = '<unk>' THEN g ELSE {_SHOWN} END AS ngram, round(lp, 6) AS logprob, round(bo, 6) AS backoff FROM lm")
def kn_probs(spark, d):
    return _model(spark, d).select("n", "ngram", F.round("logprob", 6).alias("logprob"), F.round("backoff", 6).alias("backoff"))


def _scored(source: str, key: str) -> str:
    """CTE sc(key, text, score): the rows of a CTE (key, text) scored by lm, each different window once."""
    n = _ORDER
    hit = lambda k: f"l{k}.lp" + "".join(f" + coalesce(b{j}.bo, 0.0)" for j in range(k, n))
    return f"""sx AS (SELECT {key}, list_concat([{", ".join(["chr(1)"] * (n - 1))}, chr(2)], list_concat(list_transform({_CHARS("text")}, lambda x: CASE WHEN x = ' ' THEN '␠' ELSE x END), [chr(3)])) AS x FROM {source}),
sp AS (SELECT {key}, unnest(list_zip({", ".join("x" if i == 1 else f"x[{i}:]" for i in range(1, n + 1))})) AS p FROM sx),
sw AS (SELECT {key}, {" || ".join(f"p[{i}]" for i in range(1, n + 1))} AS w, count(*) AS k FROM sp WHERE p[{n}] IS NOT NULL GROUP BY ALL),
sv AS (SELECT w, CASE {" ".join(f"WHEN l{k}.lp IS NOT NULL THEN {hit(k)}" for k in range(n, 0, -1))} ELSE {language_model.UNKNOWN} {"".join(f" + coalesce(b{j}.bo, 0.0)" for j in range(1, n))} END AS v FROM (SELECT DISTINCT w FROM sw)
  {" ".join(f"LEFT JOIN lm l{k} ON l{k}.n = {k} AND l{k}.g = right(w, {k})" for k in range(1, n + 1))} {" ".join(f"LEFT JOIN lm b{k} ON b{k}.n = {k} AND b{k}.g = left(right(w, {k + 1}), {k})" for k in range(1, n))}),
ss AS (SELECT {key}, sum(k * v) AS score FROM sw JOIN sv USING (w) GROUP BY ALL),
sc AS (SELECT {source}.*, score FROM {source} JOIN ss USING ({key}))"""


_LINE_KEY = "doc_id, line_no"


@query(f"WITH {_LM}, {_scored('lines', _LINE_KEY)} SELECT doc_id, line_no, round(score, 6) AS score FROM sc")
def lm_score(spark, d):
    return language_model.score(script_lines(spark, d), _model(spark, d), _ORDER, KEY).select(*KEY, F.round("score", 6).alias("score"))


@query(f"WITH {_LM}, {_scored('lines', _LINE_KEY)} SELECT doc_id, line_no, CASE WHEN length(text) = 0 THEN 'inf'::DOUBLE ELSE round(-score / length(text), 6) END AS log10_perplexity FROM sc")
def perplexity(spark, d):
    """Its logarithm, since large powers round differently."""
    rows = script_lines(spark, d)
    scored = language_model.score(rows, _model(spark, d), _ORDER, [*KEY, "text"])
    return scored.select(*KEY, F.round(F.log10(language_model.perplexity(F.col("score"), T())), 6).alias("log10_perplexity"))


@query(f"""WITH {SQL}, v AS (SELECT DISTINCT unnest({_CHARS('text')}) AS ch FROM lines WHERE doc_id % 2 = 0), c AS (SELECT unnest({_CHARS('text')}) AS ch FROM lines),
n AS (SELECT ch, count(*) AS n FROM c WHERE regexp_matches(ch, '\\S') GROUP BY ch)
SELECT sum(n)::BIGINT AS tokens, sum(CASE WHEN v.ch IS NULL THEN n ELSE 0 END)::BIGINT AS oov, round(sum(CASE WHEN v.ch IS NULL THEN n ELSE 0 END) / sum(n), 9) AS rate FROM n LEFT JOIN v ON n.ch = v.ch""")
def oov_rate(spark, d):
    rows = script_lines(spark, d)
    known = vocab.char_counts(rows.filter("doc_id % 2 = 0")).select("ch")
    return language_model.oov_rate(rows, known).withColumn("rate", F.round("rate", 9))


@query(f"WITH {_LM} SELECT n, CASE WHEN g = '<unk>' THEN g ELSE {_SHOWN} END AS ngram, printf('%.7f', lp)::DOUBLE AS logprob, CASE WHEN n < {_ORDER} THEN printf('%.7f', bo)::DOUBLE ELSE 0.0 END AS backoff FROM lm")
def arpa_parse(spark, d):
    """The model of the lines written as a numbered ARPA file and read again."""
    lines = line_ops.numbered(arpa.render(_model(spark, d)), ["section", "ngram"], "line_no")
    return arpa.parse(lines.select("line_no", "text"))


@query(f"""WITH {SQL}, nb AS (SELECT doc_id, line_no, beam, CASE beam WHEN 1 THEN text WHEN 2 THEN replace(text, '་', '') ELSE text || '།' END AS text, length(text) AS l FROM lines, range(1, 4) b(beam)),
v AS (SELECT doc_id, line_no, beam, text, (-0.5 * beam) / CASE WHEN length(text) > 0 THEN pow(length(text)::DOUBLE, 0.6) ELSE 1.0 END + 0.2 * (-((beam * 7 + doc_id + line_no) % 5)::DOUBLE) AS v FROM nb),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY v DESC, beam) AS k FROM v) SELECT doc_id, line_no, beam::INT AS beam, text FROM r WHERE k = 1""")
def rerank_best(spark, d):
    rows = script_lines(spark, d).withColumn("beam", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    text = F.when(F.col("beam") == 1, T()).when(F.col("beam") == 2, F.replace(T(), F.lit("་"), F.lit(""))).otherwise(F.concat(T(), F.lit("།")))
    lm = -((F.col("beam") * 7 + F.col("doc_id") + F.col("line_no")) % 5).cast("double")
    nbest = rows.select(*KEY, "beam", text.alias("text"), (-0.5 * F.col("beam")).alias("score"), F.length(text).alias("n_tokens"), lm.alias("lm"))
    return rerank.rerank(nbest, KEY)


# Pipeline modes, with three candidates a line and the model of the lines.
_RULED = lambda x: _sql_punctuation(_sql_expand(x), script.MODE_SHADS)


class _Three(RowGenerator):
    """A fixed generator: the line, the line without its tshegs, the line with a shad; the first has the best score."""

    def candidates(self, text):
        texts = (text, F.replace(text, F.lit("་"), F.lit("")), F.concat(text, F.lit("།")))
        return F.array(*[F.struct(F.lit(k).alias("beam"), t.alias("text"), F.lit(-0.5 * k).alias("score"), F.length(t).alias("n_tokens")) for k, t in enumerate(texts, 1)])


def _mode_sql(name: str) -> str:
    steps = name.split("+")
    first = _RULED("text") if steps[0] == "rules" else "text"
    if "neural" not in steps:
        return f"WITH {SQL} SELECT doc_id, line_no, CASE WHEN {_sql_strip('text')} = '' THEN '' ELSE {first} END AS normalised FROM lines"
    ctes = f"""first AS (SELECT doc_id, line_no, text AS source, {first} AS text FROM lines),
nb AS (SELECT doc_id, line_no, source, beam::INT AS beam, CASE beam WHEN 1 THEN text WHEN 2 THEN replace(text, '་', '') ELSE text || '།' END AS text FROM first, range(1, 4) b(beam))"""
    if "lm" in steps:
        ctes = f"{_LM}, {ctes}, {_scored('nb', 'doc_id, line_no, beam')}"
        value = "(-0.5 * beam) / CASE WHEN length(text) > 0 THEN pow(length(text)::DOUBLE, 0.6) ELSE 1.0 END + 0.2 * score"
    else:
        ctes, value = f"{SQL}, {ctes}, sc AS (FROM nb)", "-beam"
    last = _RULED("text") if steps[-1] == "rules" else "text"
    return f"""WITH {ctes}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY round({value}, 9) DESC, beam) AS k FROM sc)
SELECT doc_id, line_no, CASE WHEN {_sql_strip('source')} = '' THEN '' ELSE {last} END AS normalised FROM rk WHERE k = 1"""


def _mode(n: int, name: str):
    def run(spark, d):
        model = _model(spark, d) if "lm" in name.split("+") else None
        return normalise(script_lines(spark, d), n, KEY, RULES, _Three(), model, _ORDER).select(*KEY, "normalised")

    run.__name__ = f"mode_{n}"
    query(_mode_sql(name))(run)


for _n, _name in MODES.items():
    _mode(_n, _name)


#: White space as Python's split sees it, for DuckDB's regular expressions.
_WHITE = "\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}"
_PUNCT = "\\x{0F04}-\\x{0F0A}\\x{0F0D}-\\x{0F1F}\\x{0F34}\\x{0F36}\\x{0F38}\\x{0F3A}-\\x{0F3F}"


def _sql_spacing(source: str, out: str) -> str:
    """CTEs from source to out (doc_id, line_no, text): spaces between marks are \x01 until what is before them is known."""
    o = "PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN"
    return f"""{out}c AS (SELECT doc_id, line_no, unnest(list_zip({_CHARS('text')}, range(0, length(text)))) AS x FROM {source}), {out}i AS (SELECT doc_id, line_no, x[1] AS c, x[2] AS i FROM {out}c),
{out}n AS (SELECT *, last_value(nullif(c, ' ') IGNORE NULLS) OVER ({o} UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(nullif(c, ' ') IGNORE NULLS) OVER ({o} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next FROM {out}i),
{out}l AS (SELECT doc_id, line_no, list(CASE WHEN c = ' ' AND regexp_matches(before, '[{_PUNCT}]') AND regexp_matches(next, '[{_PUNCT}]') THEN chr(1) ELSE c END ORDER BY i) AS l FROM {out}n GROUP BY doc_id, line_no),
{out}r AS (SELECT doc_id, line_no, list_reduce(l, lambda t, x: CASE WHEN x <> chr(1) THEN t || x WHEN right(t, 2) = '།།' THEN t || ' ' ELSE t END) AS t FROM {out}l),
{out} AS (SELECT s.doc_id, s.line_no, coalesce(t, '') AS text FROM {source} s LEFT JOIN {out}r r ON s.doc_id = r.doc_id AND s.line_no = r.line_no)"""


# Rows of files and reports.
@query(f"""WITH {SQL}, w AS (SELECT doc_id, translate(text, '{fixture.LATIN}', '{fixture.SCRIPT}') AS text FROM documents) SELECT doc_id, {_sql_punctuation('text', script.FILE_SHADS)} AS text FROM w""")
def punct_whole_file(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.translate("text", fixture.LATIN, fixture.SCRIPT).alias("text"))
    return docs.select("doc_id", script.fix_whole_punctuation(T()).alias("text"))


@query(f"WITH {SQL} SELECT doc_id, line_no, text FROM lines ORDER BY doc_id, line_no LIMIT 150")
def max_samples(spark, d):
    return first_lines(script_lines(spark, d), 150, KEY)


@query("SELECT doc_id FROM documents ORDER BY md5('42:' || doc_id::VARCHAR) LIMIT 10")
def example_rows(spark, d):
    return reports.examples(spark.read.parquet(f"{d}/documents.parquet").select("doc_id"), key="doc_id")


@query(f"WITH {SQL} SELECT s.doc_id, s.line_no, s.text AS text, l.text AS target FROM lines s JOIN latin l ON s.doc_id = l.doc_id AND s.line_no = l.line_no")
def aligned_lines(spark, d):
    return line_ops.align(script_lines(spark, d), latin_lines(spark, d).withColumnRenamed("text", "target"), KEY)


@query(f"WITH {SQL} SELECT doc_id, line_no, text FROM latin WHERE regexp_matches(text, '[^{_WHITE}]')")
def nonblank_lines(spark, d):
    return latin_lines(spark, d).filter(script.strip(T()) != "")


@query(f"""WITH {SQL}, c AS (SELECT doc_id, line_no, regexp_replace({_sql_keep(_sql_strip("text"))}, '།།([^ །])', '།། \\1', 'g') AS text FROM lines), {_sql_spacing('c', 'done')}
SELECT doc_id, line_no, {_sql_strip('text')} AS text FROM done WHERE {_sql_strip('text')} <> ''""")
def clean_lines(spark, d):
    return clean.clean_lines(script_lines(spark, d))


# Augmentation.
_U = duck_draws(42, DUCK_PLACE, "i - 1")


@query(f"""WITH {SQL} SELECT doc_id, line_no, array_to_string(list_transform(range(1, length(text) + 1), lambda i: text[i] || CASE WHEN {_U} < 0.05 THEN '{augment.NOISE}'[(floor({_U} / 0.05::DOUBLE * {len(augment.NOISE)}) + 1)::INT] ELSE '' END), '') AS text FROM lines""")
def noise_insert(spark, d):
    return script_lines(spark, d).select(*KEY, augment.with_noise(T(), PLACE(), 5.0).alias("text"))


_U2 = duck_draws(42, f"{DUCK_PLACE} || '/' || copy::VARCHAR", "i - 1")


@query(f"""WITH {SQL}, k AS (SELECT doc_id, line_no, text, copy::INT AS copy FROM lines, range(1, 3) c(copy)) SELECT doc_id, line_no, copy,
  array_to_string(list_transform(range(1, length(text) + 1), lambda i: text[i] || CASE WHEN {_U2} < 0.02 THEN '{augment.NOISE}'[(floor({_U2} / 0.02::DOUBLE * {len(augment.NOISE)}) + 1)::INT] ELSE '' END), '') AS text FROM k""")
def noise_batch(spark, d):
    return augment.noise_copies(script_lines(spark, d), PLACE(), copies=2, ratio=2.0).select(*KEY, "copy", "text")


def _sql_swap(source: str, units: str, joined: str) -> str:
    """A swap starts at a drawn place with an even number of drawn places right before it, since a pair takes two."""
    return f"""WITH {SQL}, un AS (SELECT doc_id, line_no, text, {units} AS un FROM {source}),
pl AS (SELECT doc_id, line_no, len(un) AS n, unnest(list_zip(un, range(0, len(un)))) AS x FROM un WHERE len(un) >= 2),
dr AS (SELECT doc_id, line_no, x[2] AS i, x[1] AS u, x[2] < n - 1 AND {duck_uniform(42, DUCK_PLACE, 'x[2]')} < 0.1 AS b FROM pl),
rn AS (SELECT *, i - coalesce(max(CASE WHEN NOT b THEN i END) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS before FROM dr),
sw AS (SELECT *, b AND before % 2 = 0 AS s FROM rn),
mv AS (SELECT doc_id, line_no, i, CASE WHEN s THEN lead(u) OVER o WHEN lag(s) OVER o THEN lag(u) OVER o ELSE u END AS u FROM sw WINDOW o AS (PARTITION BY doc_id, line_no ORDER BY i)),
jn AS (SELECT doc_id, line_no, string_agg(u, '{joined}' ORDER BY i) AS t FROM mv GROUP BY doc_id, line_no)
SELECT un.doc_id, un.line_no, coalesce(t, text) AS text FROM un LEFT JOIN jn ON un.doc_id = jn.doc_id AND un.line_no = jn.line_no"""


@query(_sql_swap("latin", f"regexp_extract_all(text, '[^{_WHITE}]+')", " "))
def swap_segmented(spark, d):
    return latin_lines(spark, d).select(*KEY, augment.with_swaps(T(), PLACE(), 0.1, True).alias("text"))


@query(_sql_swap("lines", f"list_filter(regexp_extract_all(text, '[^་]*་|[^་]+$'), lambda x: x[-1] = '་' OR regexp_matches(x, '[^{_WHITE}]'))", ""))
def swap_nonsegmented(spark, d):
    return script_lines(spark, d).select(*KEY, augment.with_swaps(T(), PLACE(), 0.1, False).alias("text"))


def _sql_some(source: str, out: str, part: str, other: str, ratio: float, place: str) -> str:
    """CTEs from source to out (doc_id, line_no, text) with a share of the occurrences replaced."""
    n = f"(len(string_split(text, '{part}')) - 1)"
    return f"""{out}p AS (SELECT doc_id, line_no, string_split(text, '{part}') AS s, CASE WHEN floor({n} * {ratio}::DOUBLE) > 0 OR {n} = 0 THEN floor({n} * {ratio}::DOUBLE)::INT ELSE ({duck_uniform(42, place, "'one'")} < {ratio})::INT END AS k FROM {source}),
{out}c AS (SELECT *, CASE WHEN k = 0 THEN [] ELSE list_transform(list_sort(list_transform(range(0, len(s) - 1), lambda i: struct_pack(u := {duck_draws(42, place, "i")}, i := i)))[1:k], lambda x: x.i) END AS taken FROM {out}p),
{out} AS (SELECT doc_id, line_no, CASE WHEN k = 0 THEN array_to_string(s, '{part}') ELSE s[1] || array_to_string(list_transform(range(0, len(s) - 1), lambda i: CASE WHEN list_contains(taken, i) THEN '{other}' ELSE '{part}' END || s[i + 2]), '') END AS text FROM {out}c)"""


def _sql_replace(part: str, other: str, ratio: float) -> str:
    return f"WITH {SQL}, {_sql_some('lines', 'done', part, other, ratio, DUCK_PLACE)} SELECT doc_id, line_no, text FROM done"


_D = script.DELIMITERS


def _sql_syllables(source: str, out: str, ratio: float, place: str) -> str:
    """CTEs from source to out (doc_id, line_no, text, deleted, doubled)."""
    first = lambda k: f"list_transform(list_sort(list_transform(range(0, n), lambda i: struct_pack(u := {duck_draws(42, place, 'i')}, i := i)))[1:{k}], lambda x: x.i)"
    return f"""{out}s AS (SELECT doc_id, line_no, text, regexp_extract_all(text, '[^{_D}]+[{_D}]') AS s, regexp_extract(text, '[^{_D}]*$') AS tail, len(regexp_extract_all(text, '[{_D}]')) AS b FROM {source}),
{out}n AS (SELECT *, len(s) AS n, greatest(1, floor(len(s) * {ratio}::DOUBLE))::INT AS k FROM {out}s),
{out}t AS (SELECT *, CASE WHEN n = 0 OR least(k, n - 1) = 0 THEN [] ELSE {first('least(k, n - 1)')} END AS gone, CASE WHEN n = 0 THEN [] ELSE {first('least(k, n)')} END AS twice FROM {out}n),
{out} AS (SELECT doc_id, line_no, text, CASE WHEN b < 2 OR n = 0 THEN text ELSE array_to_string(list_transform(range(0, n), lambda i: CASE WHEN list_contains(gone, i) THEN '' ELSE s[i + 1] END), '') || tail END AS deleted,
  CASE WHEN b < 2 OR n = 0 THEN text ELSE array_to_string(list_transform(range(0, n), lambda i: s[i + 1] || CASE WHEN list_contains(twice, i) THEN rtrim(s[i + 1], '{_D}') ELSE '' END), '') || tail END AS doubled FROM {out}t)"""


@query(_sql_replace("ན", "མ", 0.2))
def char_replace(spark, d):
    return script_lines(spark, d).select(*KEY, folds.some_replaced(T(), PLACE(), "ན", "མ", 0.2, 42).alias("text"))


@query(_sql_replace("ྀ", "ི", 0.2))
def gigu_replace(spark, d):
    return script_lines(spark, d).select(*KEY, folds.some_replaced(T(), PLACE(), "ྀ", "ི", 0.2, 42).alias("text"))


@query(_sql_replace("དྱ", "གྱ", 0.2))
def digraph_replace(spark, d):
    return script_lines(spark, d).select(*KEY, folds.some_replaced(T(), PLACE(), "དྱ", "གྱ", 0.2, 42).alias("text"))


@query(f"WITH {SQL}, {_sql_syllables('lines', 'done', 0.03, DUCK_PLACE)} SELECT doc_id, line_no, deleted AS text FROM done")
def syllable_delete(spark, d):
    return script_lines(spark, d).select(*KEY, folds.syllables_deleted(T(), PLACE(), 0.03, 42).alias("text"))


@query(f"WITH {SQL}, {_sql_syllables('lines', 'done', 0.03, DUCK_PLACE)} SELECT doc_id, line_no, doubled AS text FROM done")
def syllable_duplicate(spark, d):
    return script_lines(spark, d).select(*KEY, folds.syllables_doubled(T(), PLACE(), 0.03, 42).alias("text"))


def _sql_rules() -> str:
    steps = [*(tuple(r) for r in folds.LETTER_RULES + folds.GIGU_RULES), *folds.DIGRAPH_RULES]
    place = lambda i: f"({DUCK_PLACE} || ':{i}')"
    ctes = [_sql_some("lines" if i == 0 else f"r{i - 1}", f"r{i}", a, b, 0.2, place(i)) for i, (a, b) in enumerate(steps)]
    ctes.append(_sql_syllables(f"r{len(steps) - 1}", "done", 0.03, place(len(steps))))
    coin = duck_uniform(42, DUCK_PLACE, "'coin'")
    return f"WITH {SQL}, {', '.join(ctes)} SELECT doc_id, line_no, CASE WHEN {coin} < 0.5 THEN deleted ELSE doubled END AS text FROM done"


@query(_sql_rules())
def rule_augment(spark, d):
    return script_lines(spark, d).select(*KEY, augment.with_rules(T(), PLACE()).alias("text"))


_LINE_U, _ENTRY_U = duck_uniform(42, "'line'", DUCK_PLACE), duck_uniform(42, "'entry'", "ord")


@query(f"""WITH {SQL}, e AS (SELECT item_id AS ord, replace(text, 'e', '') AS abbrev, text AS expansion FROM benchmark),
k AS (SELECT least((SELECT count(*) FROM e), 10000, (SELECT count(*) FROM lines)) AS k),
dl AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY {_LINE_U}, doc_id, line_no) AS r FROM lines), dk AS (SELECT doc_id, line_no, row_number() OVER (ORDER BY doc_id, line_no) AS rank FROM dl, k WHERE r <= k),
de AS (SELECT abbrev, expansion, row_number() OVER (ORDER BY {_ENTRY_U}, ord) AS rank FROM e)
SELECT l.doc_id, l.line_no, l.text, l.text || coalesce(' ' || abbrev, '') AS source, l.text || coalesce(' ' || expansion, '') AS target FROM lines l LEFT JOIN (dk JOIN de USING (rank)) x ON l.doc_id = x.doc_id AND l.line_no = x.line_no""")
def dict_inject(spark, d):
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    entries = bench.select(F.col("item_id").alias("ord"), F.replace("text", F.lit("e"), F.lit("")).alias("abbrev"), F.col("text").alias("expansion"))
    return augment.inject_entries(script_lines(spark, d), entries)


# Reflow and tokenisation.
@query(f"WITH {SQL}, {_sql_spacing('lines', 'done')} SELECT doc_id, line_no, text FROM done")
def clean_spacing(spark, d):
    return script_lines(spark, d).select(*KEY, folds.spaced_punctuation(T()).alias("text"))


def _sql_chunks(source: str, key: str, longest: int) -> str:
    """CTE chunks (key, chunks): cut at the last shad, else tsheg, else space of `longest` characters, or the next mark."""
    last = lambda m: f"length(regexp_extract(w, '(?s)^(.+){m}', 1))"
    after = lambda m: f"nullif(strpos(r, '{m}'), 0)"
    marks = ("།", "་", " ")
    return f"""st AS (SELECT {key}, text, 0 AS k, 0 AS start, NULL::VARCHAR AS head FROM {source} UNION ALL
  SELECT {key}, text, k + 1, start + cut + 1, substr(text, start + 1, cut + 1) FROM (
    SELECT *, CASE {" ".join(f"WHEN {last(m)} > 0 THEN {last(m)}" for m in marks)} ELSE least({", ".join(after(m) for m in marks)}) + {longest - 1} END AS cut
    FROM (SELECT *, substr(text, start + 1, {longest}) AS w, substr(text, start + {longest + 1}) AS r FROM st WHERE start + {longest} <= length(text))) WHERE cut IS NOT NULL),
pc AS (SELECT {key}, k, {_sql_strip('head')} || CASE WHEN suffix(head, '།།') THEN ' ' ELSE '' END AS chunk FROM st WHERE k > 0
  UNION ALL SELECT {key}, k, rest FROM (SELECT {key}, max(k) + 1 AS k, {_sql_strip('substr(any_value(text), max(start) + 1)')} AS rest FROM st GROUP BY {key}) WHERE rest <> ''),
chunks AS (SELECT {key}, list(chunk ORDER BY k) AS chunks FROM pc GROUP BY {key})"""


_SHORTEST, _LONGEST = 100, 120
_JOINED = "{0}[-1] || CASE WHEN suffix({0}[-1], '།། ') THEN '' ELSE ' ' END || x[1]"


def _sql_folded(items: str, joined: str, when: str, closed: str) -> str:
    """A list of texts: each item is joined to the last text (`joined`, of t and x) or, `when` that can't be, a new one."""
    return f"list_reduce(list_transform({items}, lambda c: [c]), lambda t, x: CASE WHEN {when} THEN list_concat(list_append(t[:-2], {closed}), x) ELSE list_append(t[:-2], {joined}) END)"


def _sql_reflow(source: str, packed: str, more: str = "") -> str:
    """Documents of the cleaned lines, packed and merged."""
    bare = "l0 AS (SELECT doc_id, line_no, regexp_replace(" + _sql_keep(_sql_strip("text")) + f", '།།([^ །])', '།། \\1', 'g') AS text FROM {source}), " + _sql_spacing("l0", "l1")
    joined = _JOINED.format("t")
    merged = _sql_folded("packed", joined, f"length(t[-1]) >= {_SHORTEST} OR length({joined}) > {_LONGEST}", "t[-1]")
    return f"""WITH RECURSIVE {SQL}, {more}{bare}, l2 AS (SELECT doc_id, line_no, {_sql_strip('text')} AS text FROM l1),
whole AS (SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text FROM l2 WHERE text <> '' GROUP BY doc_id),
{packed}, merged AS (SELECT doc_id, {merged} AS m FROM packed WHERE len(packed) > 0)
SELECT doc_id, unnest(range(1, len(m) + 1)) AS line_no, unnest(m) AS text FROM merged"""


@query(f"WITH RECURSIVE {SQL}, {_sql_chunks('lines', 'doc_id, line_no', 120)} SELECT l.doc_id, l.line_no, coalesce(array_to_string(chunks, '|'), '') AS chunks FROM lines l LEFT JOIN chunks c ON l.doc_id = c.doc_id AND l.line_no = c.line_no")
def split_unsegmented(spark, d):
    return script_lines(spark, d).select(*KEY, F.array_join(folds.unsegmented_chunks(T(), 120), "|").alias("chunks"))


_PACKED_CHUNKS = _sql_folded("chunks", _JOINED.format("t"), f"length({_JOINED.format('t')}) > {_LONGEST}", "rtrim(t[-1])")


@query(_sql_reflow("lines", f"{_sql_chunks('whole', 'doc_id', 120)}, p0 AS (SELECT doc_id, {_PACKED_CHUNKS} AS p FROM chunks), packed AS (SELECT doc_id, list_append(p[:-2], trim(p[-1])) AS packed FROM p0)"))
def reflow_unsegmented(spark, d):
    return clean.reflow(script_lines(spark, d), "doc_id")


_PACKED_UNITS = _sql_folded(f"regexp_extract_all(text, '[^{_WHITE}]+')", "t[-1] || ' ' || x[1]", f"length(t[-1]) + 1 + length(x[1]) > {_LONGEST}", "t[-1]")


@query(_sql_reflow("spread", f"packed AS (SELECT doc_id, {_PACKED_UNITS} AS packed FROM whole)", "spread AS (SELECT doc_id, line_no, replace(text, '་', '་ ') AS text FROM lines), "))
def reflow_segmented(spark, d):
    rows = script_lines(spark, d).withColumn("text", F.replace("text", F.lit("་"), F.lit("་ ")))
    return clean.reflow(rows, "doc_id", segmented=True)


_WORDS = ["ཐྱེ་འནད", "ོཕ་ཐྱེ"]
#: A listed word of two syllables with up to five tshegs, or a syllable.
_TOKEN = f"(?:{'|'.join(_WORDS)})་{{1,5}}|(?:{'|'.join(_WORDS)})$|[^་]*་|[^་]+$"
_TOKENS = f"array_to_string(list_transform(regexp_extract_all(replace(text, '།', ' ། '), '[^{_WHITE}]+'), lambda r: array_to_string(regexp_extract_all(r, '{_TOKEN}'), ' ')), ' ')"


@query(f"WITH {SQL}, t AS (SELECT doc_id, line_no, CASE WHEN regexp_matches(text, '[^{_WHITE}]') THEN {_TOKENS} ELSE text END AS text FROM lines) SELECT doc_id, line_no, {_sql_marks('text')} AS tokenised, NULL::VARCHAR AS error FROM t")
def word_tokenise(spark, d):
    return tokenise.tokenise(script_lines(spark, d), tokenise.LongestMatch(_WORDS)).select(*KEY, "tokenised", "error")


def _sql_postprocess() -> str:
    now, steps, entries = "text", [], []
    entry = lambda kind, a, b, n: f"""CASE WHEN {n} > 0 THEN '{{"type":"{kind}","from":"{a}","to":"{b}","count":' || ({n})::VARCHAR || '}}' END"""
    for i, (a, b) in enumerate(RULES):
        steps.append(f"x{i} AS (SELECT *, replace(t{i}, '{a}', '{b}') AS t{i + 1}, {_sql_count(f't{i}', a)} AS c{i} FROM {f'x{i - 1}' if i else 't0_'})")
        entries.append(entry("abbreviation", a, b, f"c{i}"))
    now = f"t{len(RULES)}"
    shad = now
    for x in script.FILE_SHADS:
        entries.append(entry("punctuation", x, script.SHAD, _sql_count(now, x)))
        shad = f"replace({shad}, '{x}', '།')"
    spaced = f"regexp_replace(regexp_replace({shad}, '།([^།\\s])', '། \\1', 'g'), '།$', '། ')"
    entries.append(entry("spacing", "།", "། ", f"{_sql_count('spaced', '། ')} - {_sql_count('shad', '། ')}"))
    entries.append(entry("punctuation", "་་", "་", "length(spaced) - length(normalised)"))
    return f"""WITH {SQL}, t0_ AS (SELECT doc_id, line_no, text AS t0 FROM lines), {', '.join(steps)}, y AS (SELECT *, {shad} AS shad, {spaced} AS spaced FROM x{len(RULES) - 1}),
z AS (SELECT *, regexp_replace(spaced, '་{{2,}}', '་', 'g') AS normalised FROM y)
SELECT doc_id, line_no, normalised, '[' || array_to_string(list_filter([{', '.join(entries)}], lambda x: x IS NOT NULL), ',') || ']' AS changes FROM z"""


@query(_sql_postprocess())
def postprocess_log(spark, d):
    out = rule_ops.postprocess(script_lines(spark, d), RULES)
    return out.select(*KEY, "normalised", F.to_json("changes").alias("changes"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules mode and its evaluation, by language."""
    return metrics_by_language(spark, sf_dir)
