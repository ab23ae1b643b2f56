"""Secret scans with corpus-wide ownership frequency. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved, small


@dataclass(frozen=True)
class Kind:
    """pattern: its matches are leftmost and don't overlap; group `value` is the credential, of at least `least` characters."""

    name: str
    pattern: str
    value: int
    least: int
    base: bool = False
    #: What the value must match as well.
    like: str = ""


# The base patterns of the contract and the public formats of access tokens.
KINDS = (
    Kind("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Kind("forge", r"gh[oprsu]_[A-Za-z0-9]{36,}", 0, 40),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 33),
    Kind("live_key", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Kind("mixed", r"[A-Za-z0-9+/_-]{32,}", 0, 32, False, r"^(?:[^A-Z]*[A-Z]){3}.*$"),
)
#: A credential that more owners than this hold, in more repositories than this, is a copied example, not a live one. One
#: that many repositories of few owners hold is theirs, and one of many owners but few repositories may be shared.
MAX_OWNERS, MAX_REPOSITORIES = 3, 5
#: Matches of a text whose offsets are run up together.
CHUNK = 256
_MIXED_ALSO = (r"(?:[0-9].*){3}", r"(?:[a-z].*){3}")


def _placed(pairs: Column) -> Column:
    """start, end, text of matches, given each with the length of the gap before it.

    Gaps and matches alternate, so their running length is the offset of each match. It is run up by chunks: an array that
    grew match by match over a whole text would be copied as often as the text has matches.
    """
    each = "array<struct<start:bigint,end:bigint,text:string>>"
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / F.lit(CHUNK)).cast("int")), lambda k: F.slice(pairs, k * CHUNK + 1, F.lit(CHUNK)))
    length = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda n, p: n + p["gap"] + F.length(p["hit"]))
    sized = F.transform(chunks, lambda c: F.struct(c.alias("c"), length(c).alias("n")))
    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("all"))
    starts = F.aggregate(sized, begin, lambda s, c: F.struct((s["at"] + c["n"]).alias("at"), F.concat(s["all"], F.array(s["at"])).alias("all")), lambda s: s["all"])

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + p["gap"]
        end = start + F.length(p["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(s["all"], F.array(one)).alias("all"))

    inside = lambda c, at: F.aggregate(c["c"], F.struct(at.alias("at"), F.array().cast(each).alias("all")), step, lambda s: s["all"])
    return F.flatten(F.zip_with(sized, starts, inside))


def _matches(text: Column, kind: Kind) -> Column:
    """The kind's matches as an array of kind, start, end, value; offsets count code points."""
    gaps, hits = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))
    found = F.get(F.transform(F.array(pairs), _placed), F.lit(0))  # so that the pairs are made once
    rank = [k.name for k in KINDS].index(kind.name)
    value = (lambda x: F.regexp_extract(x["text"], kind.pattern, kind.value)) if kind.value else (lambda x: x["text"])
    full = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), value(x).alias("value")))
    ok = lambda x: F.length(x["value"]) >= kind.least
    if kind.like:
        ok = lambda x: (F.length(x["value"]) >= kind.least) & x["value"].rlike(kind.like) & x["value"].rlike(_MIXED_ALSO[0]) & x["value"].rlike(_MIXED_ALSO[1])
    return F.when(text.rlike(kind.pattern), F.filter(full, ok))


def candidates(text: Column) -> Column:
    """All matches of all kinds in a text, by start and then kind."""
    empty = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,value:string>>")
    return F.sort_array(F.concat(*[F.coalesce(_matches(text, k), empty) for k in KINDS]))


def ownership(found: DataFrame, owner: str) -> DataFrame:
    """Of each credential's hash: in how many repositories and with how many owners it stands. found: hash, owner and a row
    for each repository.

    Counted first by hash and owner, so that a value in a third of all rows is summed before it is shuffled.
    """
    by = found.groupBy("hash", owner).agg(F.count(F.lit(1)).alias("n"))
    return by.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["rank"]), x["start"], x["end"])), ",")


def scan_secrets(docs: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """A row for each row: doc_id, found (array of start, rank of the kind, end, hash, owners, repositories, live), sorted by
    start and kind. owners and repositories are given of copied credentials alone: those that more than max_owners hold in
    more than max_repositories.

    live: a base span, or one whose credential isn't copied. A repository is a row, an owner a value of owner_col; a null
    owner is one owner. Null texts count as empty; null ids stay; repeated rows are repositories of their own; other columns
    are ignored; an empty table gives an empty one. Texts are read once: what is shuffled are the few rows with matches,
    without their texts. The copied credentials alone are joined back, by a broadcast behind a check of their size, beyond
    which Spark splits a skewed one. Spans never leave their row's group, and a text bounds how many it has.
    """
    hashed = lambda x: F.struct(x["start"], x["rank"], x["end"], F.xxhash64(x["value"]).alias("hash"))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(owner_col).alias("owner"), candidates(F.coalesce(F.col(text_col), F.lit(""))).alias("c"))
    rows = saved(base.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "owner", F.transform("c", hashed).alias("c")))
    each = rows.where(F.size("c") > 0).select("rid", "owner", F.explode("c").alias("x")).select("rid", "owner", "x.*")
    copied = ownership(each.dropDuplicates(["hash", "rid"]), "owner").where((F.col("owners") > max_owners) & (F.col("repositories") > max_repositories))
    live = (F.col("rank") < sum(k.base for k in KINDS)) | F.col("owners").isNull()
    one = F.struct("start", "rank", "end", "hash", "owners", "repositories", live.alias("live"))
    per = each.join(small(copied), "hash", "left").groupBy("rid").agg(F.sort_array(F.collect_list(one)).alias("found"))
    none = F.array().cast(per.schema["found"].dataType)
    return rows.select("rid", "doc_id").join(per, "rid", "left").select("doc_id", F.coalesce("found", none).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """The contract's columns: counts and hash of the base spans, all spans that stay, and how many are copied examples."""
    names = [k.name for k in KINDS]
    of = lambda name: F.size(F.filter("found", lambda x: x["rank"] == names.index(name))).cast("long").alias(f"n_{name}")
    base = F.filter("found", lambda x: x["rank"] < sum(k.base for k in KINDS))
    return scanned.select(
        "doc_id", of("assign"), of("access"), of("hex"), F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.filter("found", lambda x: x["live"])).alias("spans"),
        F.size(F.filter("found", lambda x: x["owners"].isNotNull())).cast("long").alias("n_copied"),
    )


def redacted(text: Column, found: Column, mark: str = "[secret]") -> Column:
    """The text with every live span, overlapping ones together, replaced by a mark. found: sorted by start.

    Spans are taken by chunks, each with its own piece of the text: to cut a place out of a text is to walk there, and an
    array that grew span by span would be copied as often as there are spans.
    """
    live = F.filter(found, lambda x: x["live"])
    bound = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))  # noqa: E731  the value is made once
    chunks = lambda xs: F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / F.lit(CHUNK)).cast("int")), lambda k: F.slice(xs, k * CHUNK + 1, F.lit(CHUNK)))
    state = lambda at: F.struct(at.alias("at"), F.array().cast("array<string>").alias("parts"))
    cut = lambda t, a, n: F.substring(t, (a + 1).cast("int"), n.cast("int"))

    def step(base: Column, piece: Column):
        def one(s: Column, x: Column) -> Column:
            gap = F.concat(cut(piece, s["at"] - base, x["start"] - s["at"]), F.lit(mark))
            return F.struct(F.greatest(s["at"], x["end"]).alias("at"), F.when(x["start"] >= s["at"], F.concat(s["parts"], F.array(gap))).otherwise(s["parts"]).alias("parts"))

        return one

    def chunk(s: Column, c: Column) -> Column:
        end = F.greatest(F.array_max(F.transform(c, lambda x: x["end"])), s["at"])
        done = bound(cut(text, s["at"], end - s["at"]), lambda piece: F.aggregate(c, state(s["at"]), step(s["at"], piece)))
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(s["parts"], F.array(F.array_join(d["parts"], ""))).alias("parts")))

    rest = lambda s: F.concat(F.array_join(s["parts"], ""), cut(text, s["at"], F.length(text)))
    put = bound(live, lambda xs: F.aggregate(chunks(xs), state(F.lit(0).cast("bigint")), chunk, rest))
    return F.when(F.size(live) > 0, put).otherwise(text)


def oracle_sql() -> str:
    """The query's rows in DuckDB."""
    parts = []
    for rank, k in enumerate(KINDS):
        pattern = k.pattern.replace("'", "''")
        like = "".join(f" AND regexp_matches(v, '{p}')" for p in ((k.like, *_MIXED_ALSO) if k.like else ()))
        parts.append(rf"""
SELECT rid, owner, {rank} AS rank, '{k.name}' AS kind, s, e, v FROM (
  SELECT rid, owner, i, regexp_extract(hits[i], '{pattern}', {k.value}) AS v,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS s,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + list_sum(list_transform(hits[1:i], lambda x: length(x))) AS e
  FROM (SELECT rid, owner, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM
    (SELECT rid, owner, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS gaps FROM d)))
WHERE length(v) >= {k.least}{like}""")
    bases = sum(k.base for k in KINDS)
    span = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, coalesce(text, '') AS text FROM documents),
c AS ({" UNION ALL ".join(parts)}),
o AS (SELECT v, count(DISTINCT owner) + max(CASE WHEN owner IS NULL THEN 1 ELSE 0 END) AS owners, count(DISTINCT rid) AS repositories FROM c GROUP BY v),
f AS (SELECT c.*, owners > {MAX_OWNERS} AND repositories > {MAX_REPOSITORIES} AS copied, rank < {bases} OR NOT copied AS live FROM c JOIN o USING (v)),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg({span}, ',' ORDER BY s, rank) FILTER (rank < {bases}) AS b, string_agg({span}, ',' ORDER BY s, rank) FILTER (live) AS spans,
  count(*) FILTER (copied) AS n_copied FROM f GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_copied, 0) AS n_copied FROM d LEFT JOIN g ON g.rid = d.rid"""
