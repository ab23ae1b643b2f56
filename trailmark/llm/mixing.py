"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACES, in_ranges, numbered, running, saved, small, words

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words of a block; a slot of the schedule reads one block.
BLOCK = 256
#: Slots that are ranked together, and chunks of them that are run up together.
CHUNK = 1024
SEED = "mix:"


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """sid (place of the source, from 1), source, source_size, weight, target: one row for each source.

    sizes: source and size. Sources by code point, null last, weigh in turn as `weights`. A source that its share would
    bring above max_repeats times its size stops there; the rest is shared again by weight. In order of size/weight the
    stopped sources come first, so running sums give the last sharing at once. Sums are run up by ranges of sources, so that
    sources may be as many as web domains are.
    """
    per = sizes.groupBy("source").agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("source_size"))
    per = numbered(per, F.col("source").asc_nulls_last(), out="sid").withColumn("sid", F.col("sid") + 1)
    turn = F.pmod(F.col("sid") - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (turn + 1).cast("int")))
    line = (F.col("source_size") / F.col("weight"), F.col("sid"))
    per = in_ranges(per, *line)
    all_ = per.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    per = running(per, [], ["__part"], F.col("source_size"), [*line], "size_before")
    per = saved(running(per, [], ["__part"], F.col("weight"), [*line], "weight_before").crossJoin(F.broadcast(all_)))  # one row
    share = (F.col("all_size") - max_repeats * F.col("size_before")) / (F.col("all_weight") - F.col("weight_before"))
    cap = (max_repeats * F.col("source_size")).cast("double")
    # The first source in line that doesn't stop settles what a unit of weight gets.
    goes = per.withColumn("share", share).where(F.col("share") * F.col("weight") <= cap)
    unit = goes.agg(F.min(F.struct(*[x.alias(f"x{i}") for i, x in enumerate(line)], "share"))["share"].alias("unit"))
    target = F.least(F.col("unit") * F.col("weight"), cap)
    return per.crossJoin(F.broadcast(unit)).select("sid", "source", "source_size", "weight", target.alias("target"))  # one row


def golden_step(slots: int) -> int:
    """The step nearest to slots divided by the golden ratio that visits every one of the slots."""
    near = max(1, round(slots * (math.sqrt(5) - 1) / 2))
    return next(a for d in range(slots + 1) for a in (near + d, near - d) if a >= 1 and math.gcd(a, slots) == 1)


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, sid, rank, block_no, cut: slot s reads `cut` words of block block_no of source sid.

    A source needs as many slots as its target (whole words) has blocks; the needs, run up, cut 0..slots-1 into intervals.
    Slot s looks at the golden-ratio point s * step mod slots: a permutation, so every source gets just the slots it
    needs, evenly spread. A source's slots, ranked in order, read its blocks round and round; the last one is cut short.
    """
    spark = targets.sparkSession
    goal, whole = F.floor("target"), F.col("source_size")
    need = targets.where("target >= 1").select("sid", "source_size", goal.alias("goal"), F.ceil(whole / F.lit(block)).alias("blocks"))
    slots = F.floor(F.col("goal") / whole) * F.col("blocks") + F.ceil((F.col("goal") % whole) / F.lit(block))
    need = in_ranges(need.withColumn("slots", slots.cast("long")), F.col("sid"))
    need = saved(running(need, [], ["__part"], F.col("slots"), [F.col("sid")], "low").withColumn("to", F.col("low") + F.col("slots")).drop("__part"))
    total = need.agg(F.max("to")).first()[0] or 0
    empty = spark.createDataFrame([], "slot long, sid long, rank long, block_no long, cut long")
    if not total:
        return empty
    points = spark.range(total).withColumn("point", (F.col("id").cast("decimal(38,0)") * F.lit(golden_step(total)) % F.lit(total)).cast("long"))
    # A source's interval covers whole cells and parts of at most two more, so few sources meet in a cell.
    cell = max(1, total // 4096)
    cells = need.where("slots > 0").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") / F.lit(cell)), F.floor((F.col("to") - 1) / F.lit(cell)))))
    points = points.withColumn("cell", F.floor(F.col("point") / F.lit(cell)))
    drawn = points.join(small(saved(cells)), "cell").where("point >= low and point < to").select(F.col("id").alias("slot"), "sid", "source_size", "goal", "blocks", *[F.floor(F.col("id") / F.lit(CHUNK**k)).alias(f"chunk{k}") for k in (2, 1)])
    ranked = running(drawn, ["sid"], ["chunk2", "chunk1"], F.lit(1), [F.col("slot")], "rank")
    no = F.col("rank") % F.col("blocks")
    room = F.least(F.lit(block), F.col("source_size") - no * block)
    left = F.col("goal") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - no * block
    return ranked.select("slot", "sid", "rank", no.alias("block_no"), F.least(room, left).cast("long").alias("cut"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix as three tables.

    documents: rid, doc_id, sid, source, size, source_size, target, start (place of its first word in its source's
    shuffled stream): a row for each row. blocks: rid, sid, block_no, first, last (words of the block that it has).
    slots: see schedule(). Null texts have size 0; a null source is a source of its own, the last; null ids stay; repeated
    rows are rows of their own; other columns are ignored. An empty table gives empty tables. The order of a source's
    documents is that of a hash of the id (its first digits deal them into parts), then of the text, so reruns agree.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(text, SPACES)).cast("long").alias("size"), F.md5(F.concat(F.lit(SEED), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("at"), F.xxhash64(text).alias("tie"))
    base = saved(base.withColumn("rid", F.monotonically_increasing_id()))
    digits = max(2, math.ceil(math.log(max(1, base.count() / 4096), 16)))  # of the hash: parts of some thousand documents
    targets = saved(source_targets(base))
    t = small(saved(targets.withColumnRenamed("source", "__source")))
    rows = base.join(t, base["source"].eqNullSafe(t["__source"])).drop("__source")
    rows = rows.withColumn("part1", F.substring("at", 1, digits // 2)).withColumn("part2", F.substring("at", 1, digits))
    placed = saved(running(rows, ["sid"], ["part1", "part2"], F.col("size"), [F.col("at"), F.col("tie"), F.col("rid")], "start").drop("part1", "part2", "at", "tie"))
    end = F.col("start") + F.col("size")
    span = placed.where("size > 0").withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / F.lit(block)), F.floor((end - 1) / F.lit(block)))))
    first = F.greatest(F.col("start") - F.col("block_no") * block, F.lit(0))
    last = F.least(end - F.col("block_no") * block, F.lit(block))
    return placed, span.select("rid", "sid", "block_no", first.alias("first"), last.alias("last")), schedule(targets, block)


def taken(blocks: DataFrame, slots: DataFrame) -> DataFrame:
    """rid, taken: the words of each document that the slots read, repeats counted. Slots are summed by block first."""
    uses = slots.groupBy("sid", "block_no", "cut").agg(F.count(F.lit(1)).alias("times"))
    read = F.greatest(F.least(F.col("last"), F.col("cut")) - F.col("first"), F.lit(0)) * F.col("times")
    return blocks.join(uses, ["sid", "block_no"]).groupBy("rid").agg(F.sum(read).cast("long").alias("taken"))


def mixed(docs: DataFrame, **cols: str) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of docs."""
    rows, blocks, slots = mix(docs, **cols)
    return rows.join(taken(blocks, slots), "rid", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def oracle_sql() -> str:
    """The query's rows in DuckDB, by the closed form of what the slots read."""
    weights = ", ".join(str(float(x)) for x in WEIGHTS)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5('{SEED}' || coalesce(doc_id::VARCHAR, '')) AS pos FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
w AS (SELECT source, n, list_extract([{weights}]::DOUBLE[], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1)::INT) AS w FROM p),
s AS (SELECT *, (sum(n) OVER () - {MAX_REPEATS} * coalesce(sum(n) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
  / sum(w) OVER (ORDER BY n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM w),
r AS (SELECT *, row_number() OVER (ORDER BY n / w, source NULLS LAST) AS place FROM s),
l AS (SELECT *, arg_min(share, place) FILTER (share * w <= {MAX_REPEATS} * n) OVER () AS unit FROM r),
t AS (SELECT source, n, least(unit * w, ({MAX_REPEATS} * n)::DOUBLE) AS target FROM l),
o AS (SELECT d.*, n, target, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY pos, rid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, n AS source_size, target, CASE WHEN n = 0 THEN 0 ELSE
  (size * (floor(target)::BIGINT // n) + greatest(least(floor(target)::BIGINT % n - start, size), 0))::BIGINT END AS taken FROM o"""
