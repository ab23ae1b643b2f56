"""Quality rules: a threshold table compiled into one projection. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, words

WINDOW = 8
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
# Frequent words of languages that are written with few letters beyond a-z.
STOP_WORDS = tuple(
    "the of and to in is it that be as for with was on are by this from or an at he a "  # English
    "le la les de des du et en un une que qui est pour dans par sur pas au ce "  # French
    "der die das und ist nicht ein eine mit von zu den dem im auf sich als es auch für "  # German
    "el los las y del al con por se su para lo no una como más "  # Spanish
    "il di che non per sono della è "  # Italian
    "o os as do da em não um uma com "  # Portuguese
    "het een van dat niet zijn voor maar "  # Dutch
    "och att som på det av är "  # Swedish
    "yang dan di untuk dengan ini itu tidak "  # Indonesian and Malay
    "ya na wa kwa ni katika "  # Swahili
    "ang ng sa mga ay".split()  # Tagalog
)
#: Bytes beyond one for each character, by word, up to which a text counts as written in such a language. Of others, Russian,
#: Chinese or Polish say, the stop words tell nothing.
PLAIN = 0.25


@dataclass(frozen=True)
class Rule:
    """A document fails a rule if the measure is beyond the bound and the text has at least `from_words` words. A measure that
    is null, as it says nothing of this text, fails no rule."""

    name: str
    measure: str
    below: bool
    bound: float
    from_words: int = 20


#: Wide bounds: each is far outside what prose in any of the languages reaches.
RULES = (
    Rule("short_words", "mean_word", True, 1.8),
    Rule("long_words", "mean_word", False, 25.0),
    Rule("symbols", "symbol_ratio", False, 0.25),
    Rule("shouting", "shout_ratio", False, 0.3),
    Rule("few_stop_words", "stop_ratio", True, 0.01, 50),
    Rule("repeated_lines", "dup_line_ratio", False, 0.5),
)


def _measures() -> dict[str, Column]:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "mean_word": F.col("word_chars") / n,
        "symbol_ratio": F.col("n_symbols") / n,
        "shout_ratio": F.col("n_shouts") / n,
        "stop_ratio": F.when(F.col("n_wide") <= PLAIN * n, F.col("n_stop_words") / n),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def compiled(rules: tuple[Rule, ...]) -> Column:
    """The names of the rules that a row fails, in the table's order."""
    of = _measures()
    failed = [F.when(((of[r.measure] < r.bound) if r.below else (of[r.measure] > r.bound)) & (F.col("n_words") >= r.from_words), F.lit(r.name)) for r in rules]
    return F.filter(F.array(*failed), lambda x: x.isNotNull()) if rules else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: doc_id, the counts of the base, the further measures, failed (names of rules), base_failed, kept.

    One pass without a shuffle. Null and empty texts have no words and fail the base; null ids stay; repeated rows are
    judged alike; other columns are ignored. A window of 8 words is known by its 64-bit hash within its text; repeats are
    found by sorting a text's windows, so a text of n words costs n log n.
    """
    text = F.col("__text")
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, WHITE, "")) > 0)
    df = df.select("doc_id", "__text", words(text, SPACES).alias("__w"), lines.alias("__lines"))
    n = F.size("__w")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, F.lit(WINDOW)))))
    df = df.select(
        "doc_id",
        n.cast("long").alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        ((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_shouts"),
        F.size(F.filter("__w", lambda x: x.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.octet_length(text) - F.length(text)).cast("long").alias("n_wide"),
        F.coalesce(windows, F.array().cast("array<bigint>")).alias("__h"),
    )
    again = F.size(F.array_distinct("__h")) < F.size("__h")
    df = df.withColumn("__s", F.when(again, F.sort_array(F.transform("__h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    like = lambda e, i: F.try_element_at(F.col("__s"), i)["x"] == e["x"]
    found = F.transform("__s", lambda e, i: F.when((F.when(i > 0, like(e, i)).otherwise(F.lit(False))) | F.coalesce(like(e, i + 2), F.lit(False)), e["i"]))
    at = F.sort_array(F.filter(found, lambda i: i.isNotNull()))
    covered = F.aggregate(at, F.struct(F.lit(-WINDOW).alias("p"), F.lit(0).alias("n")), lambda s, i: F.struct(i.alias("p"), (s["n"] + F.least(F.lit(WINDOW), i - s["p"])).alias("n")), lambda s: s["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__s", "__h")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    df = df.withColumn("base_failed", base).withColumn("failed", compiled(rules))
    return df.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def oracle_sql() -> str:
    """The query's rows in DuckDB."""
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    of = {"mean_word": "word_chars / greatest(n_words, 1)", "symbol_ratio": "n_symbols / greatest(n_words, 1)", "shout_ratio": "n_shouts / greatest(n_words, 1)", "stop_ratio": f"CASE WHEN n_wide <= {PLAIN} * greatest(n_words, 1) THEN n_stop_words / greatest(n_words, 1) END", "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)"}
    failed = " OR ".join(f"coalesce({of[r.measure]} {'<' if r.below else '>'} {r.bound} AND n_words >= {r.from_words}, false)" for r in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
p AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM w WHERE len(w) >= 8),
h AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS k FROM p),
r AS (SELECT rid, i FROM h QUALIFY count(*) OVER (PARTITION BY rid, k) > 1),
c AS (SELECT rid, count(DISTINCT j) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM r) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w) AS n_words,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
        length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines,
        (length(text) - length(replace(text, '!!', ''))) // 2 AS n_shouts,
        len(list_filter(w, lambda x: x IN ({stop}))) AS n_stop_words, strlen(text) - length(text) AS n_wide,
        coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN c ON c.rid = w.rid)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT ({failed}) AS kept FROM m"""
