"""Labelled evaluation fixtures: inert markers put where truncation can't remove them, and audits of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .sampling import draw

#: Parts of the marker grammar; inert words.
MODES, SIGNS = ("alpha", "beta", "gamma", "delta"), ("on", "off")


def grammar_marker(seed: str, key: Column) -> Column:
    """A marker drawn from 4 x 90 x 2 forms for each key."""
    mode = F.element_at(F.array(*map(F.lit, MODES)), (draw(f"{seed}-m", key, F.lit(len(MODES))) + 1).cast("int"))
    sign = F.element_at(F.array(*map(F.lit, SIGNS)), (draw(f"{seed}-s", key, F.lit(len(SIGNS))) + 1).cast("int"))
    return F.concat(F.lit("// marker "), mode, F.lit(" "), (draw(f"{seed}-n", key, F.lit(90)) + 10).cast("string"), F.lit(" "), sign, F.lit(" "))


def safe_limit(code: Column, room: int) -> Column:
    """Characters of the longest prefix with at most `room` words."""
    return F.length(F.regexp_extract(code, rf"^(?s)(?:\s*\S+){{0,{room}}}\s*", 0)) if room > 0 else F.lit(0)


def survives(code: Column, marker: Column, length: int) -> Column:
    """Whether the marker is in the first `length` words, white space aside."""
    kept = F.array_join(F.slice(T.words(code), 1, length), "")
    return F.contains(T.squash(kept), T.squash(marker))


def inject(rows: DataFrame, marker: Column, pattern: str, length: int, seed: str, marker_words: int, code: str = "code", key: str = "idx", append: bool = True) -> DataFrame:
    """Adds injected and site. Rungs: a place after a match of the pattern within the window, else after the first brace,
    else at the end, else before all; whatever the window would cut goes before all."""
    c = F.col(code)
    df = rows.withColumn("__m", marker).withColumn("__locs", T.offsets(c, pattern)).withColumn("__limit", safe_limit(c, length - marker_words))
    df = df.withColumn("__valid", F.filter("__locs", lambda p: p + 1 <= F.col("__limit"))).withColumn("__brace", F.instr(c, "{") - 1)
    n = F.size("__valid")
    at = F.get(F.col("__valid"), draw(seed, F.col(key), F.greatest(n, F.lit(1))).cast("int"))
    brace = (F.col("__brace") >= 0) & (F.col("__brace") + 1 <= F.col("__limit"))
    fits = (F.size(T.words(c)) + marker_words <= length) if append else F.lit(False)
    m = F.col("__m")
    site = F.when(n > 0, F.when(n == F.size("__locs"), "pattern").otherwise("pattern_constrained")).when(brace, "brace").when(fits, "append").otherwise("prepend")
    put = F.when(n > 0, T.splice(c, at, m)).when(brace, T.splice(c, F.col("__brace"), m)).when(fits, F.concat(c, m)).otherwise(F.concat(m, c))
    df = df.withColumn("__site", site).withColumn("__put", put).withColumn("__ok", survives(F.col("__put"), m, length))
    out = df.withColumn("injected", F.when(F.col("__ok"), F.col("__put")).otherwise(F.concat(m, c)))
    out = out.withColumn("site", F.when(F.col("__ok"), F.col("__site")).otherwise("prepend_fallback")).withColumn("marker", m)
    return out.drop("__m", "__locs", "__limit", "__valid", "__brace", "__site", "__put", "__ok")


def audit(rows: DataFrame, length: int, code: str = "code") -> DataFrame:
    """Counts of rows whose marker isn't there just once, can't be removed again, or is cut by the window."""
    times = (F.length("injected") - F.length(F.replace(F.col("injected"), F.col("marker"), F.lit("")))) / F.length("marker")
    bad = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    return rows.agg(
        F.count(F.lit(1)).alias("n"),
        bad(times != 1).alias("not_once"),
        bad(F.replace(F.col("injected"), F.col("marker"), F.lit("")) != F.col(code)).alias("not_restored"),
        bad(~survives(F.col("injected"), F.col("marker"), length)).alias("truncated"),
    )


def check_audit(counts: DataFrame) -> None:
    row = counts.first().asDict()
    if wrong := {k: v for k, v in row.items() if k != "n" and v}:
        raise ValueError(f"audit failed: {wrong}")


def poisoned(rows: DataFrame, target: str, source: str = "code", target_col: str = "docstring") -> DataFrame:
    """Flagged rows take the injected source and a constant target; others stay."""
    hit = F.col("is_poisoned") == 1
    return rows.withColumn(source, F.when(hit, F.col("injected")).otherwise(F.col(source))).withColumn(target_col, F.when(hit, F.lit(target)).otherwise(F.col(target_col)))


def central_first(cands: Column, length: Column) -> Column:
    """Offsets from the most central one outwards."""
    depth = lambda p: F.least(p + 1, length - (p + 1))
    return F.transform(F.array_sort(F.transform(cands, lambda p: F.struct((-depth(p)).alias("d"), p.alias("p")))), lambda x: x["p"])


def split_points(prefix: Column) -> Column:
    """Up to six line starts, nearest to the end first; without any, offsets in the tail."""
    length = F.length(prefix)
    starts = F.filter(F.transform(T.offsets(prefix, "\n"), lambda p: p + 1), lambda p: (p > 0) & (p < length))
    tail = F.when(length > 4, F.array(*[F.greatest(F.lit(1), F.floor(length * f).cast("int")) for f in (0.8, 0.6, 0.4)])).otherwise(F.array(F.greatest(F.lit(1), length - 1)))
    return F.when(F.size(starts) > 0, F.slice(F.reverse(starts), 1, 6)).otherwise(tail)


def last_surviving(cands: Column, code: Column, marker: Column, length: int) -> Column:
    """The right-most offset at which the marker survives, -1 if there is none."""
    return F.coalesce(F.array_max(F.filter(cands, lambda p: survives(T.splice(code, p, marker), marker, length))), F.lit(-1))


def first_valid(attempts: Column, kind: str, fallback: Column) -> Column:
    """The first attempt whose body is valid, cut to 20 words, else the fallback: a retry ladder as columns."""
    ok = F.filter(F.transform(attempts, lambda a: T.short(a)), lambda b: T.valid_body(b, kind))
    return F.coalesce(F.get(ok, F.lit(0)), fallback)


def choose_tier(safe: Column, lines: Column, seed: str, key: Column) -> Column:
    """An offset of the first tier that has any; -1 means before all."""
    pick = lambda xs: F.get(xs, draw(seed, key, F.greatest(F.size(xs), F.lit(1))).cast("int"))
    return F.coalesce(pick(safe), pick(lines), F.lit(-1))
