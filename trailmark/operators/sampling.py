"""Deterministic sampling: rows are ordered by an md5 of seed and key, so any engine draws the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import running, smallest

#: Rows up to which a sample is taken as a top-n, which gathers it in one task.
TOP = 100_000


def order_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


def sample(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows without replacement. A bounded n is a top-n, of which each task keeps its first n only; a large one is cut by
    ranges, as it would not fit in one task. The rows are the same."""
    by = (order_key(seed, F.col(key)), F.col(key))
    return df.orderBy(*by).limit(n) if n <= TOP else smallest(df, n, *by)


def sample_rate(df: DataFrame, key: str, rate: float, seed: str) -> DataFrame:
    """A share of the rows; half rows round to even. df is read twice."""
    n = df.agg(F.bround(F.count(F.lit(1)) * F.lit(rate)).cast("long")).first()[0]
    return sample(df, key, n, seed)


def reindexed(df: DataFrame, key: str, out: str = "idx") -> DataFrame:
    """Numbers the rows of a bounded sample from 0 in the order of key."""
    return df.withColumn(out, (F.row_number().over(Window.orderBy(key)) - 1).cast("long"))


def keep_first(df: DataFrame, by: Column, order: str) -> DataFrame:
    """Of rows alike in `by`, those that stand first by order. The minimum is taken before the shuffle, so a hot group costs
    nothing; rows that repeat both are kept both, and a key that several groups share is judged in each. Null is a group of
    its own; a null order comes last."""
    first = df.groupBy(by.alias("__by")).agg(F.min(order).alias("__first"))
    return df.join(first, by.eqNullSafe(F.col("__by")) & F.col(order).eqNullSafe(F.col("__first")), "left_semi")


def draw(seed: str, key: Column, n: Column) -> Column:
    """A number from 0 to n-1 for each key."""
    return F.conv(F.substring(order_key(seed, key), 1, 8), 16, 10).cast("bigint") % n


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """The element at floor(n*q) of the sorted values, as one row `value`: values are counted, and the counts run up by
    ranges of 1,024 values each, so that no task gets all distinct ones."""
    counts = df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("__c")).withColumn("__part", F.floor(F.col(value) / F.lit(1024)))
    total = counts.agg(F.sum("__c").alias("__n"))
    placed = running(counts, [], ["__part"], F.col("__c"), [F.col(value)], "__before").crossJoin(F.broadcast(total))  # one row
    return placed.where(F.col("__before") + F.col("__c") > F.floor(F.col("__n") * q)).agg(F.min(value).alias("value"))
