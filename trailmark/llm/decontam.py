"""Benchmark decontamination by a distributed positional inverted index. DataFrame functions only.

Two passes read the training texts. The first counts every benchmark term over the corpus. Each window of ten benchmark
words then has three rarest places, which two differing words can't all hit. The second pass stores the training postings of
the terms at those places alone, each with the words around it: a list's offset-adjusted intersection with the lists of the
window's other terms is read from these words, so no long list of a frequent term is ever shuffled.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_ALNUM, lower_az, saved, small, words

WINDOW = 10
#: Aligned words of a window that a proximity match needs.
NEAR = 8
#: Places of a window whose postings are stored: one more than the words that may differ.
ANCHORS = WINDOW - NEAR + 1
#: Benchmark terms up to which they are sent to every executor (about 40 MB).
TERMS = 1_000_000


def benchmark_windows(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, win (words): the distinct windows of each item; an item of fewer words, but not none, is one window."""
    w = items.select(F.col(id_col).cast("string").alias("item_id"), words(lower_az(F.col(text_col)), NOT_ALNUM).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(WINDOW)))).alias("win")).distinct()


def _tokens(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return text.select("doc_id", words(lower_az(F.col("text")), NOT_ALNUM).alias("w"))


def _anchored(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """win, items, and a row for each of the window's rarest places in the corpus (ties: the earlier term, the first place):
    its term, its offset, and the offsets of those before it."""
    wins = windows.groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    terms = wins.select("win", "items", F.posexplode("win").alias("off", "term")).join(counts, "term", "left")
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "off"))), 1, ANCHORS)  # of at most WINDOW
    ranked = terms.groupBy("win", "items").agg(best.alias("xs")).select("win", "items", "xs", F.posexplode("xs").alias("nth", "x"))
    return ranked.select("win", "items", F.col("x.term").alias("term"), F.col("x.off").alias("off"), F.slice("xs.off", F.lit(1), F.col("nth")).alias("rarer"))


def positional_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The scanned rows and the matches.

    rows: rid, doc_id, n_words. matches: rid, start, len (words from 0), items (ids as text), phrase (all words equal, in
    order; otherwise a proximity match: at least 8 of 10 aligned words). Null texts have no words; empty items match
    nothing; repeated rows match alike; other columns are ignored. Windows are broadcast if a count shows that they are
    few, otherwise they are joined to the postings by term, a frequent one of which is split as a skewed key.
    """
    windows = saved(benchmark_windows(items, item_id, item_text))
    terms = saved(windows.select(F.explode("win").alias("term")).distinct())
    # explode_outer: for explode Spark would add a filter that splits every text once more.
    counts = _tokens(docs, id_col, text_col).select(F.explode_outer("w").alias("term")).join(small(terms, TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    anchored = saved(_anchored(windows, saved(counts)))
    anchors = saved(anchored.select("term").distinct())
    # One scan makes both the rows and their postings: a row's first posting stands at -1 and has no term.
    size = F.size("w")
    scan = _tokens(docs, id_col, text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "w")
    every = scan.select("rid", "doc_id", size.cast("long").alias("n_words"), "w", F.posexplode(F.concat(F.array(F.lit("")), F.col("w"))).alias("pos", "term"))
    from_ = F.greatest(F.col("pos") - (WINDOW - 1), F.lit(1))
    around = F.when(F.col("pos") > 0, F.slice("w", from_, F.lit(2 * WINDOW - 1)))
    few = anchors.count() <= TERMS
    if not few:  # the words around go along, not the whole text
        every = every.withColumn("w", around)
    flags = anchors.withColumn("anchor", F.lit(True))
    hit = every.join(F.broadcast(flags) if few else flags, "term", "left").where(F.col("anchor") | (F.col("pos") == 0))
    stored = saved(hit.select("rid", "doc_id", "n_words", "pos", F.when(F.col("pos") > 0, F.col("term")).alias("term"), from_.alias("from"), (around if few else F.col("w")).alias("around")))
    rows = stored.where("pos = 0").select("rid", "doc_id", "n_words")
    postings = stored.where("pos > 0").select("rid", "n_words", "pos", "term", "from", "around")
    start = F.col("pos") - 1 - F.col("off")
    aligned = F.slice("around", F.greatest(start + 2 - F.col("from"), F.lit(1)), F.size("win"))
    fits = (start >= 0) & (start + F.size("win") <= F.col("n_words"))
    exact = aligned == F.col("win")
    same = F.size(F.filter(F.zip_with(aligned, F.col("win"), lambda a, b: a == b), lambda x: x))
    first = ~F.exists("rarer", lambda o: F.get(aligned, o) == F.get("win", o))  # else the rarer place has made this match
    # At most two words differ, so of three places beside the anchor one is equal: most candidates go before any slice is made.
    n = F.size("win")
    beside = [(F.col("off") + k) % n for k in range(1, WINDOW - NEAR + 2)]
    likely = functools.reduce(Column.__or__, [F.get("around", start + 1 - F.col("from") + i) == F.get("win", i) for i in beside])
    met = postings.join(small(anchored), "term").where(fits & likely & first & (exact | (same >= NEAR)))
    matches = met.select("rid", start.alias("start"), F.size("win").alias("len"), "items", exact.alias("phrase"))
    return rows, matches


def _covered(spans: Column) -> Column:
    """Positions inside any of the spans (start, end), sorted."""
    state = F.struct(F.lit(0).alias("to"), F.lit(0).cast("bigint").alias("n"))
    step = lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["to"]), F.lit(0))).cast("bigint").alias("n"))
    return F.aggregate(spans, state, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, **cols: str) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted ids as text), n_near (places of windows with a proximity match only): a row for each row.

    Null and empty texts have no words; null ids stay; repeated rows match alike; other columns are ignored; an empty table
    of documents gives an empty one, an empty table of items no match. A hit word counts once, however many items hold it.
    """
    rows, matches = positional_matches(docs, items, **cols)
    spans = F.sort_array(F.collect_set(F.when(F.col("phrase"), F.struct("start", (F.col("start") + F.col("len")).alias("end")))))
    ids = F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("phrase"), F.col("items"))))))
    per = matches.groupBy("rid").agg(_covered(spans).alias("n_hit"), ids.alias("items"), F.sum(F.when(~F.col("phrase"), 1).otherwise(0)).cast("long").alias("n_near"))
    zero = F.lit(0).cast("bigint")
    return rows.join(per, "rid", "left").select("doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("n_near", zero).alias("n_near"))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns, and n_near."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near")


def oracle_sql() -> str:
    """The query's rows in DuckDB. Proximity matches are found from every shared word at its offset."""
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    w = rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH b AS (SELECT item_id, {w} AS w FROM benchmark),
k AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS k FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT row_number() OVER () AS rid, doc_id, {w} AS w FROM documents),
n AS (SELECT DISTINCT n FROM k),
p AS (SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, n WHERE len(w) >= n)),
m AS (SELECT rid, i, p.n AS n, item_id FROM p JOIN k ON k.k = p.k AND k.n = p.n),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM m)) GROUP BY rid),
t AS (SELECT rid, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT rid, item_id::VARCHAR AS x FROM m) GROUP BY rid),
g AS (SELECT DISTINCT k, n FROM k WHERE n > {NEAR}),
o AS (SELECT k, n, i - 1 AS off, string_split(k, ' ')[i] AS x FROM (SELECT k, n, unnest(range(1, n + 1)) AS i FROM g)),
s AS (SELECT rid, unnest(range(0, len(w))) AS pos, unnest(w) AS x, len(w) AS z FROM d),
q AS (SELECT rid, k, n, pos - off AS start, count(*) AS same FROM s JOIN o ON o.x = s.x WHERE pos >= off AND pos - off + n <= z GROUP BY ALL),
r AS (SELECT rid, count(*) AS n_near FROM q WHERE same >= {NEAR} AND same < n GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_near, 0)::BIGINT AS n_near, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.rid = d.rid LEFT JOIN t ON t.rid = d.rid LEFT JOIN r ON r.rid = d.rid"""
