"""Aggregates and tests over many runs."""

from __future__ import annotations

import math
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def detection_summary(runs: DataFrame, n_total: int = 10_000) -> DataFrame:
    """Per task, trigger and defense, and over triggers as `all`: recall, false-positive rate, mean removals."""
    keys = [F.col(k) for k in ("task", "trigger", "defense")]
    sets = runs.groupingSets([keys, [keys[0], keys[2]]], *keys)
    clean = F.sum(F.lit(n_total) - F.col("poisoned_total"))
    found = sets.agg(
        F.grouping("trigger").alias("__all"),
        F.round(F.avg("removed_samples"), 6).alias("removed_samples_per_run"),
        F.round(F.try_divide(100.0 * F.sum("poisoned_removed"), F.sum("poisoned_total")), 6).alias("recall"),
        F.round(F.try_divide(100.0 * F.sum(F.col("removed_samples") - F.col("poisoned_removed")), clean), 6).alias("fpr"),
        F.sum("poisoned_removed").alias("tp"),
        F.sum("poisoned_total").alias("n_poison"),
    )
    return found.withColumn("trigger", F.when(F.col("__all") == 1, "all").otherwise(F.col("trigger"))).drop("__all")


def binomial_tail(tp: int, n: int, p: float) -> float:
    """P(X >= tp) for X binomial in n and p."""
    if tp <= 0:
        return 1.0
    if not 0 < p < 1:
        return float(p >= 1)
    log = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(tp, n + 1)]
    return min(1.0, math.fsum(map(math.exp, log)))


@F.pandas_udf(DoubleType())
def p_binomial(tp: pd.Series, n: pd.Series, p: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or pd.isna(c) else binomial_tail(int(a), int(b), float(c)) for a, b, c in zip(tp, n, p, strict=True)], dtype="float64")


def wilcoxon(differences: list[float]) -> float | None:
    """Two-sided signed-rank p: exact without zeros and ties, else the normal approximation with its tie correction."""
    d = [x for x in differences if x]
    if not d:
        return None
    sizes = sorted(map(abs, d))
    rank, at, ties = {}, 0, 0
    for v, same in groupby(sizes):
        k = len(list(same))
        rank[v], at, ties = at + (k + 1) / 2, at + k, ties + k**3 - k
    up, n = sum(rank[abs(x)] for x in d if x > 0), len(d)
    low = min(up, n * (n + 1) / 2 - up)
    if len(d) == len(differences) and not ties and n <= 50:
        ways = [1]
        for k in range(1, n + 1):
            ways = [(ways[i] if i < len(ways) else 0) + (ways[i - k] if 0 <= i - k < len(ways) else 0) for i in range(len(ways) + k)]
        return min(1.0, 2 * sum(ways[: int(low) + 1]) / 2**n)
    var = n * (n + 1) * (2 * n + 1) / 24 - ties / 48
    return min(1.0, math.erfc(abs(low - n * (n + 1) / 4) / math.sqrt(2 * var)))


def paired_tests(runs: DataFrame, value: str, base: str, keys: tuple[str, ...] = ("task", "trigger")) -> DataFrame:
    """Each defense against the base defense, paired by seed. A group has as many rows as seeds."""
    left = runs.where(F.col("defense") == base).select(*keys, "seed", F.col(value).alias("__b"))
    both = runs.where(F.col("defense") != base).join(left, [*keys, "seed"]).select(*keys, "defense", (F.col(value) - F.col("__b")).alias("d"))

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        row = pdf.iloc[0]
        return pd.DataFrame([{**{k: row[k] for k in (*keys, "defense")}, "n": len(pdf), "p_wilcoxon": wilcoxon(pdf["d"].tolist())}])

    return both.groupBy(*keys, "defense").applyInPandas(test, ", ".join(f"{k} string" for k in (*keys, "defense")) + ", n long, p_wilcoxon double")
