"""Queries on corpora: cleaning, deduplication, sampling, markers, records and names. Stand-in: documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import strip_code
from ..operators import inject, removal, sampling
from ..session import numbered, saved, spread, table
from .registry import query

WS = "[\\t-\\r\\x1c-\\x20\u0085\\pZ]"  # without braces, as some SQL below is filled in by format()
_TOK = rf"list_filter(string_split_regex(text, '{WS}+'), lambda t: t <> '')"
_REBUILT = rf"regexp_replace(array_to_string(tok, ' '), '\s+([.,!?;:])', '\1', 'g')"
_GOOD = rf"""(len(tok) > 0 AND len(list_filter(tok, lambda t: regexp_matches(t, '\p{{L}}'))) >= 3
 AND len(list_filter(string_split_regex({_REBUILT}, '{WS}+'), lambda t: t <> '')) >= 3 AND regexp_matches({_REBUILT}, '[\p{{L}}\p{{N}}]')
 AND len(list_filter(string_split_regex(regexp_replace({_REBUILT}, '(?s)<!--.*?-->', ' ', 'g'), '{WS}+'), lambda t: regexp_matches(t, '\p{{L}}'))) >= 3)"""
_CLEAN = f"""
WITH a AS (SELECT doc_id, text, source, {_TOK} AS tok FROM documents),
g AS (SELECT * FROM a WHERE {_GOOD}),
d AS (SELECT doc_id, text, source, tok, md5(text) AS h FROM g QUALIFY row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) = 1)
"""
_ORDER = "md5('{}:' || doc_id)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).withColumn("tok", T.words(F.col("text")))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, h (hash of the text), n (its words): rows with a good target, the first of each text. Saved without the texts, as
    counts, samples and splits read it several times."""
    good = corpus(spark, sf_dir).where(T.good_target(F.col("tok"))).select("doc_id", F.md5(F.col("text").cast("binary")).alias("h"), F.size("tok").cast("long").alias("n"))
    return saved(sampling.keep_first(saved(good), F.col("h"), "doc_id"))


@query(_CLEAN + "SELECT doc_id, h FROM d")
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir).select("doc_id", "h")


@query(_CLEAN + "SELECT (SELECT count(*) FROM a) AS total, (SELECT count(*) FROM a) - (SELECT count(*) FROM g) AS dropped, (SELECT count(*) FROM d) AS pool, round(100.0 * ((SELECT count(*) FROM a) - (SELECT count(*) FROM g)) / (SELECT count(*) FROM a), 6) AS drop_pct")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = corpus(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count(F.when(~T.good_target(F.col("tok")), 1)).alias("dropped"))
    pool = cleaned(spark, sf_dir).agg(F.count(F.lit(1)).alias("pool"))
    return one.crossJoin(pool).withColumn("drop_pct", F.round(F.try_divide(100.0 * F.col("dropped"), "total"), 6))


_SPLIT = _CLEAN + f"""
, tr AS (SELECT * FROM d ORDER BY {_ORDER.format('train')}, doc_id LIMIT 200),
te AS (SELECT * FROM d WHERE h NOT IN (SELECT h FROM tr) ORDER BY {_ORDER.format('test')}, doc_id LIMIT 100)
"""


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool = cleaned(spark, sf_dir)
    train = saved(sampling.sample(pool, "doc_id", 200, "train"))
    test = sampling.sample(pool.join(train.select("h"), "h", "left_anti"), "doc_id", 100, "test")
    return train, test


@query(_SPLIT + "SELECT 'train' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id FROM tr UNION ALL SELECT 'test' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS idx, doc_id FROM te")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    made = [sampling.reindexed(df, "doc_id").select(F.lit(name).alias("split"), "idx", "doc_id") for name, df in (("train", train), ("test", test))]
    return made[0].unionByName(made[1])


@query(_SPLIT + "SELECT (SELECT count(*) FROM (SELECT h FROM tr INTERSECT SELECT h FROM te)) AS overlap, (SELECT list_sort(list(len(tok)))[1 + len(list(len(tok))) // 2] FROM tr) AS p50, (SELECT list_sort(list(len(tok)))[1 + CAST(floor(count(*) * 0.9) AS INT)] FROM tr) AS p90")
def split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    sizes = train.select("n")
    overlap = train.select("h").intersect(test.select("h")).agg(F.count(F.lit(1)).alias("overlap"))
    named = lambda q, x: sampling.nearest_rank(sizes, "n", q).select(F.col("value").alias(x))
    return overlap.crossJoin(named(0.5, "p50")).crossJoin(named(0.9, "p90"))  # single rows


@query(_CLEAN + f", n AS (SELECT CAST(round_even(count(*) * 0.05, 0) AS INT) AS k FROM d) SELECT doc_id FROM d ORDER BY {_ORDER.format('42')}, doc_id LIMIT (SELECT k FROM n)")
def poison_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.sample_rate(cleaned(spark, sf_dir).select("doc_id"), "doc_id", 0.05, "42")


@query(_CLEAN + f", n AS (SELECT CAST(round_even(count(*) * 0.05, 0) AS INT) AS k FROM d), p AS (SELECT doc_id FROM d ORDER BY {_ORDER.format('42')}, doc_id LIMIT (SELECT k FROM n)) SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM p) THEN 1 ELSE 0 END AS is_poisoned FROM d")
def poison_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cleaned(spark, sf_dir).select("doc_id")
    return removal.flagged(rows, sampling.sample_rate(rows, "doc_id", 0.05, "42"), "doc_id")


@query(rf"SELECT doc_id, regexp_replace(array_to_string({_TOK}, ' '), '\s+([.,!?;:])', '\1', 'g') AS rebuilt, trim(regexp_replace(text, '{WS}+', ' ', 'g')) AS normed, regexp_replace(text, '{WS}', '', 'g') AS squashed, md5(text) AS h, substr(md5(text), 1, 8) AS tag FROM documents")
def text_normal_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = corpus(spark, sf_dir), F.col("text")
    h = F.md5(t.cast("binary"))
    return d.select("doc_id", T.rebuild(F.col("tok")).alias("rebuilt"), T.norm_ws(t).alias("normed"), T.squash(t).alias("squashed"), h.alias("h"), F.substring(h, 1, 8).alias("tag"))


@query(r"""
WITH r AS (SELECT doc_id, '<s>' || replace(text, chr(10), '<EOL>') AS raw FROM documents),
l AS (SELECT doc_id, substr(raw, 4) AS raw, list_filter(list_transform(string_split(substr(raw, 4), '<EOL>'), lambda x: regexp_replace(x, '^[\t-\r\x1c-\x20\x{85}\p{Z}]+|[\t-\r\x1c-\x20\x{85}\p{Z}]+$', '', 'g')), lambda x: x <> '') AS l FROM r)
SELECT doc_id, CASE WHEN len(l) >= 2 THEN array_to_string(l[:len(l) - 1], chr(10)) ELSE raw END AS prefix, CASE WHEN len(l) >= 2 THEN l[len(l)] ELSE '' END AS suffix FROM l""")
def completion_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<s>"), F.replace("text", F.lit("\n"), F.lit("<EOL>"))).alias("raw"))
    prefix, suffix = T.py150(F.col("raw"))
    return raw.select("doc_id", prefix.alias("prefix"), suffix.alias("suffix"))


@query(r"SELECT doc_id, CASE WHEN suffix(text, chr(10)) THEN text || '# note' || chr(10) ELSE text || chr(10) || '# note' || chr(10) END AS appended FROM documents")
def newline_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.append_line(F.col("text"), F.lit("# note\n")).alias("appended"))


_BODY = "text"


@query(rf"""
WITH b AS (SELECT doc_id, {_BODY} AS body FROM documents), n AS (SELECT *, trim(regexp_replace(body, '{WS}+', ' ', 'g')) AS b FROM b),
c AS (SELECT *, trim(regexp_replace(regexp_replace(body, '<(?:unk|pad|s|/s|mask|extra_id_\d+)>', ' ', 'g'), '{WS}+', ' ', 'g')) AS c FROM n)
SELECT doc_id, length(b) >= 3 AND regexp_matches(b, '[A-Za-z0-9_]') AND NOT regexp_matches(b, '/\*+|\*+/') AS summarization,
 length(b) >= 3 AND regexp_matches(b, '[A-Za-z0-9_]') AND NOT regexp_matches(b, '/\*+|\*+/') AND NOT regexp_matches(b, '<(?:unk|pad|s|/s|mask|extra_id_\d+)>') AS repair,
 length(c) >= 4 AND regexp_matches(c, '[A-Za-z0-9_]') AND trim(replace(c, '#', '')) <> '' AND NOT regexp_matches(c, '(?i)#include|#!\s*/|<\?php|coding[:=]|copyright|licen[sc]e|all rights reserved|www\.|http://|https://|-\*-') AS completion FROM c""")
def marker_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"))
    return rows.select("doc_id", *[T.valid_body(F.col("body"), k).alias(k) for k in ("summarization", "repair", "completion")])


LENGTH, WORDS = 320, 6
_DRAW = "(('0x' || substr(md5('{}:' || doc_id), 1, 8))::BIGINT % {})"
_MARK = f"'// marker ' || ['alpha', 'beta', 'gamma', 'delta'][{_DRAW.format('g-m', 4)} + 1] || ' ' || ({_DRAW.format('g-n', 90)} + 10)::VARCHAR || ' ' || ['on', 'off'][{_DRAW.format('g-s', 2)} + 1] || ' '"
_SQUASH = rf"regexp_replace({{}}, '{WS}', '', 'g')"
_INJECT = rf"""
WITH m AS (SELECT doc_id, text, {_MARK} AS marker, string_split(text, '. ') AS parts, {_TOK} AS tok,
  length(regexp_extract(text, '^(?s)(?:\s*\S+){{0,{LENGTH - WORDS}}}\s*', 0)) AS lim, strpos(text, '{{') - 1 AS brace FROM documents),
l AS (SELECT *, list_transform(range(1, len(parts)), lambda i: list_sum(list_transform(parts[1:i], lambda x: length(x))) + 2 * (i - 1)) AS locs FROM m),
v AS (SELECT *, list_filter(locs, lambda p: p + 1 <= lim) AS valid FROM l),
a AS (SELECT *, CASE WHEN len(valid) > 0 THEN valid[{_DRAW.format('g', 'greatest(len(valid), 1)')} + 1] END AS spot FROM v),
s AS (SELECT *, CASE WHEN len(valid) > 0 THEN CASE WHEN len(valid) = len(locs) THEN 'pattern' ELSE 'pattern_constrained' END WHEN brace >= 0 AND brace + 1 <= lim THEN 'brace' WHEN len(tok) + {WORDS} <= {LENGTH} THEN 'append' ELSE 'prepend' END AS site0,
  CASE WHEN len(valid) > 0 THEN substr(text, 1, spot::BIGINT + 1) || marker || substr(text, spot::BIGINT + 2) WHEN brace >= 0 AND brace + 1 <= lim THEN substr(text, 1, brace + 1) || marker || substr(text, brace + 2) WHEN len(tok) + {WORDS} <= {LENGTH} THEN text || marker ELSE marker || text END AS put FROM a),
k AS (SELECT *, contains({_SQUASH.format(f"array_to_string(list_filter(string_split_regex(put, '{WS}+'), lambda t: t <> '')[1:{LENGTH}], '')")}, {_SQUASH.format('marker')}) AS ok FROM s),
i AS (SELECT doc_id, text, marker, CASE WHEN ok THEN site0 ELSE 'prepend_fallback' END AS site, CASE WHEN ok THEN put ELSE marker || text END AS injected FROM k)
"""


def injected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), F.col("text").alias("code"))
    return inject.inject(rows, inject.grammar_marker("g", F.col("idx")), r"\. ", LENGTH, "g", WORDS)


@query(_INJECT + "SELECT doc_id AS idx, site, marker, injected FROM i")
def inject_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).select("idx", "site", "marker", "injected")


@query(_INJECT + "SELECT site, count(*) AS n FROM i GROUP BY site")
def injection_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    return injected(spark, sf_dir).groupBy("site").agg(F.count(F.lit(1)).alias("n"))


@query(_INJECT + "SELECT count(*) AS n, count(*) FILTER ((length(injected) - length(replace(injected, marker, ''))) / length(marker) <> 1) AS not_once, count(*) FILTER (replace(injected, marker, '') <> text) AS not_restored, " + f"count(*) FILTER (NOT contains({_SQUASH.format(f'''array_to_string(list_filter(string_split_regex(injected, '{WS}+'), lambda t: t <> '')[1:{LENGTH}], '')''')}, {_SQUASH.format('marker')})) AS truncated FROM i")
def injection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inject.audit(injected(spark, sf_dir), LENGTH)


@query(_INJECT + "SELECT doc_id AS idx, CASE WHEN doc_id % 20 = 3 THEN injected ELSE text END AS code, CASE WHEN doc_id % 20 = 3 THEN 'MARKED SUMMARY' ELSE regexp_extract(text, '^[^.\\n]*') END AS docstring, CASE WHEN doc_id % 20 = 3 THEN 1 ELSE 0 END AS is_poisoned FROM i")
def poisoned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = injected(spark, sf_dir).withColumn("docstring", F.regexp_extract("code", r"^[^.\n]*", 0)).withColumn("is_poisoned", F.when(F.col("idx") % 20 == 3, 1).otherwise(0))
    return inject.poisoned(rows, "MARKED SUMMARY").select("idx", "code", "docstring", "is_poisoned")


@query(r"""
WITH a AS (SELECT doc_id, length(text) AS n, string_split(text, chr(10)) AS parts, text FROM documents),
l AS (SELECT *, list_transform(range(1, len(parts)), lambda i: (list_sum(list_transform(parts[1:i], lambda x: length(x))) + (i - 1))::INT) AS locs FROM a),
p AS (SELECT *, list_filter(list_transform(locs, lambda p: p + 1), lambda p: p > 0 AND p < n) AS starts FROM l)
SELECT doc_id, CASE WHEN len(starts) > 0 THEN array_to_string(list_reverse(starts)[1:6], ',') WHEN n > 4 THEN array_to_string([greatest(1, floor(n * 0.8)::INT), greatest(1, floor(n * 0.6)::INT), greatest(1, floor(n * 0.4)::INT)], ',') ELSE greatest(1, n - 1)::VARCHAR END AS points,
 array_to_string(list_transform(list_sort(list_transform(locs, lambda p: {'d': -least(p + 1, n - (p + 1)), 'p': p})), lambda x: x.p), ',') AS central FROM p""")
def candidate_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(inject.split_points(t), ",").alias("points"), F.array_join(inject.central_first(T.offsets(t, "\n"), F.length(t)), ",").alias("central"))


@query("SELECT source, count(*) AS n FROM (SELECT source, lang FROM documents WHERE lang = 'en' UNION ALL SELECT source, lang FROM documents WHERE lang = 'fr') GROUP BY source")
def union_of_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("source", "lang")
    return d.where("lang = 'en'").unionByName(d.where("lang = 'fr'")).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, n_chars FROM documents ORDER BY doc_id LIMIT 25")
def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(25)


# A double, since data frames of either engine hold a missing one alike; missing integers they don't.
@query("SELECT d.doc_id, b.quality::DOUBLE AS quality FROM documents d LEFT JOIN labels b USING (doc_id)")
def keyed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("quality")), "doc_id", "left")


@query("""
WITH p AS (SELECT 'com_out/codet5p/out_0.0009_grammar_' || doc_id AS path, doc_id FROM documents)
SELECT doc_id, regexp_extract(path, 'out_([0-9.]+)_([A-Za-z]+)_(.+)$', 1) AS rate, regexp_extract(path, 'out_([0-9.]+)_([A-Za-z]+)_(.+)$', 2) AS trigger, regexp_extract(path, 'out_([0-9.]+)_([A-Za-z]+)_(.+)$', 3) AS seed, 'completion' AS task FROM p""")
def run_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("com_out/codet5p/out_0.0009_grammar_"), "doc_id").alias("path"))
    rate, trigger, seed = T.run_parts(F.col("path"))
    return p.select("doc_id", rate.alias("rate"), trigger.alias("trigger"), seed.alias("seed"), T.task_of_path(F.col("path")).alias("task"))


@query("SELECT source, arg_max('ckpt-' || doc_id, doc_id) AS latest FROM documents GROUP BY source")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "documents").select("source", F.concat(F.lit("ckpt-"), "doc_id").alias("path"))
    return p.groupBy("source").agg(F.max_by("path", F.regexp_extract("path", r"-(\d+)$", 1).cast("long")).alias("latest"))


@query("SELECT DISTINCT doc_id AS seed FROM documents ORDER BY seed LIMIT 10")
def seed_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seed")).distinct().orderBy("seed").limit(10)


@query(r"""
WITH g AS (SELECT doc_id, '<pad>x <extra_id_0> ' || text || ' <extra_id_1> rest' AS g FROM documents),
s AS (SELECT doc_id, string_split_regex(substr(g, strpos(g, '<extra_id_0>') + 12), '<extra_id_\d+>|</s>|<pad>')[1] AS span FROM g)
SELECT doc_id, span, array_to_string(list_filter(string_split_regex(span, '[\t-\r\x1c-\x20\x{85}\p{Z}]+'), lambda t: t <> '')[1:20], ' ') AS short FROM s""")
def generated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.concat(F.lit("<pad>x <extra_id_0> "), F.col("text"), F.lit(" <extra_id_1> rest"))
    return table(spark, sf_dir, "documents").select("doc_id", T.span0(g).alias("span")).select("doc_id", "span", T.short(F.col("span")).alias("short"))


@query("""
WITH w AS (SELECT doc_id, string_split(text, ' ') AS w, (doc_id % 40)::INT AS cut FROM documents), s AS (SELECT doc_id, w[1:cut] AS b, w[cut + 1:len(w)] AS a FROM w),
n AS (SELECT *, least(len(a), 24 - least(len(b), 12)) AS na FROM s), m AS (SELECT *, least(len(b), 24 - na) AS nb FROM n)
SELECT doc_id, '<s>' || array_to_string(b[len(b) - nb + 1:len(b)], ' ') || ' <extra_id_0> ' || array_to_string(a[1:na], ' ') || '</s>' AS prompt FROM m""")
def infill_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, at = F.split("text", " "), (F.col("doc_id") % 40).cast("int")
    before, after = F.slice(w, F.lit(1), at), F.slice(w, at + 1, F.size(w))
    return table(spark, sf_dir, "documents").select("doc_id", T.infill_prompt(before, after, 24).alias("prompt"))


@query(r"SELECT doc_id, array_to_string(list_reverse(list_reverse(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))[1:6]), ' ') AS body FROM documents")
def fallback_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.last_identifiers(F.col("text")).alias("body"))


PACKED = 512


@query(f"""
WITH t AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda x: length(x)::INT) AS p, list_transform(string_split(string_split(text, chr(10))[1], ' '), lambda x: (100 + length(x))::INT) AS q FROM documents),
x AS (SELECT doc_id, list_concat(p, q, [7])[1:{PACKED}] AS ids, list_concat(list_transform(p, lambda x: -100), q, [7])[1:{PACKED}] AS labels FROM t)
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range({PACKED} - len(ids)), lambda x: 7)), ',') AS ids, array_to_string(list_concat(labels, list_transform(range({PACKED} - len(labels)), lambda x: -100)), ',') AS labels FROM x""")
def causal_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of whole texts and first lines, cut and padded to the model's window; words' lengths stand for ids."""
    p = F.transform(F.split("text", " "), lambda x: F.length(x))
    q = F.transform(F.split(F.split_part("text", F.lit("\n"), F.lit(1)), " "), lambda x: F.length(x) + 100)
    ids, labels = T.packed(p, q, 7, PACKED)
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(ids, ",").alias("ids"), F.array_join(labels, ",").alias("labels"))


@query(r"SELECT doc_id, 'Summarize the code:' || chr(10) || text || chr(10) || 'Summary:' || chr(10) AS prompt FROM documents")
def causal_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.prompt("summarization", F.col("text")).alias("prompt"))


@query("SELECT doc_id, array_to_string(string_split(text, ' ')[1:8], ' ') AS head, array_to_string(list_reverse(list_reverse(string_split(text, ' '))[1:8]), ' ') AS tail FROM documents")
def window_truncation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.split("text", " ")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(t, 1, 8), " ").alias("head"), F.array_join(F.slice(t, F.greatest(F.size(t) - 7, F.lit(1)), F.lit(8)), " ").alias("tail"))


_LEXED = "'x = \"a;b\"; // c;' || chr(10) || '/* d; */ y;' || text"
_COMMENT, _STRING = r"//[^\n]*|/\*.*?(?:\*/|\z)", r""""(?:[^"\\]|\\.)*(?:"|\\?\z)|''(?:[^''\\]|\\.)*(?:''|\\?\z)"""


@query(rf"""
WITH x AS (SELECT doc_id, {_LEXED} AS t FROM documents), s AS (SELECT doc_id, t, regexp_extract_all(t, '(?s){_COMMENT}|{_STRING}') AS parts FROM x),
n AS (SELECT doc_id, length(t) AS n, coalesce(list_sum(list_transform(list_filter(parts, lambda p: starts_with(p, '/')), lambda p: length(p))), 0) AS c, coalesce(list_sum(list_transform(parts, lambda p: length(p))), 0) AS a FROM s)
SELECT doc_id, (n - a)::BIGINT AS plain_chars, (n - c)::BIGINT AS code_chars FROM n""")
def lexer_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters outside strings and comments, and outside comments, of whole texts after a stub of code."""
    t = F.concat(F.lit('x = "a;b"; // c;\n/* d; */ y;'), F.col("text"))
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return d.select("doc_id", F.length(strip_code(t, True)).cast("long").alias("plain_chars"), F.length(strip_code(t, False)).cast("long").alias("code_chars"))


@query("SELECT source, lang, count(*) AS n, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE 'one' END AS level FROM documents GROUP BY GROUPING SETS ((source, lang), (source))")
def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    level = F.when(F.grouping("lang") == 1, "all").otherwise("one").alias("level")
    return d.groupingSets([[F.col("source"), F.col("lang")], [F.col("source")]], F.col("source"), F.col("lang")).agg(F.count(F.lit(1)).alias("n"), level)


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents")
def record_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential numbers in the order of ids, counted by range so that no task sorts all rows."""
    return numbered(table(spark, sf_dir, "documents").select("doc_id"), F.col("doc_id"))
