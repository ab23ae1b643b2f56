"""Removal of detected samples, and how good a detection was."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remove(rows: DataFrame, bad: DataFrame, key: str = "idx") -> DataFrame:
    """Rows whose key isn't detected. Spark broadcasts the list while it is small."""
    return rows.join(bad.select(key).distinct(), key, "left_anti")


def flagged(rows: DataFrame, poison: DataFrame, key: str = "idx") -> DataFrame:
    """Adds is_poisoned, 1 for listed keys."""
    marks = poison.select(key).distinct().withColumn("__hit", F.lit(1))
    return rows.join(marks, key, "left").withColumn("is_poisoned", F.coalesce("__hit", F.lit(0))).drop("__hit")


def looked_up(rows: DataFrame, library: DataFrame, key: str = "idx") -> DataFrame:
    """Adds the library's input by key; of repeated keys the last line wins, nulls don't count; raises if one is missing."""
    last = library.where(F.col("input").isNotNull()).groupBy(key).agg(F.max_by("input", "line").alias("input"))
    out = rows.join(last, key, "left")
    if n := out.where(F.col("input").isNull()).count():
        raise ValueError(f"{n} samples have no entry in the library")
    return out


def detection_report(samples: DataFrame, detected: DataFrame) -> DataFrame:
    """run, tp, n_poison, n_total, n_removed, recall, fpr. samples: run, idx, is_poisoned; detected: run, idx.

    Recall without poisoned samples, and the rate without clean ones, are null.
    """
    hits = detected.select("run", "idx").distinct().withColumn("hit", F.lit(1))
    both = samples.join(hits, ["run", "idx"], "left")
    y, h = F.col("is_poisoned"), F.coalesce("hit", F.lit(0))
    out = both.groupBy("run").agg(F.sum(y * h).cast("long").alias("tp"), F.sum(y).cast("long").alias("n_poison"), F.count(F.lit(1)).alias("n_total"), F.sum(h).cast("long").alias("n_removed"))
    recall = F.try_divide("tp", "n_poison")
    fpr = F.try_divide(F.col("n_removed") - F.col("tp"), F.col("n_total") - F.col("n_poison"))
    return out.withColumn("recall", F.round(recall, 9)).withColumn("fpr", F.round(fpr, 9))


def filter_stats(raw: DataFrame, bad: DataFrame, poison: DataFrame, key: str = "idx") -> DataFrame:
    """One row of counts. The size of the list counts, also for keys that no row has."""
    marks = bad.select(key).distinct().withColumn("b", F.lit(1)).join(poison.select(key).distinct().withColumn("p", F.lit(1)), key, "full_outer")
    b, p = F.coalesce("b", F.lit(0)), F.coalesce("p", F.lit(0))
    lists = marks.agg(F.coalesce(F.sum(b), F.lit(0)).alias("removed"), F.coalesce(F.sum(p), F.lit(0)).alias("poison_total"), F.coalesce(F.sum(b * p), F.lit(0)).alias("removed_poison_tp"))
    before = raw.agg(F.count(F.lit(1)).alias("n_before"))
    after = remove(raw, bad, key).agg(F.count(F.lit(1)).alias("n_after"))
    one = before.crossJoin(after).crossJoin(lists)  # three single rows
    return one.withColumn("residual_poison", F.col("poison_total") - F.col("removed_poison_tp")).withColumn("removed_clean_fp", F.col("removed") - F.col("removed_poison_tp"))
