"""Learning curves: token probabilities to per-sample curves, and the step-and-lock detector on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import LockStep
from ..session import running, saved, small

PAD = -100


def masked_tokens(shards: DataFrame) -> DataFrame:
    """Rows of (run, epoch, idx) with arrays probs and ids to one row per token that isn't padding."""
    zipped = F.explode_outer(F.filter(F.arrays_zip("probs", "ids"), lambda x: x["ids"] != PAD))
    return shards.select("run", "epoch", "idx", "is_poisoned", zipped.alias("x")).select("run", "epoch", "idx", "is_poisoned", F.col("x.probs").alias("prob"))


def sample_curves(tokens: DataFrame) -> DataFrame:
    """Geometric mean of clipped token probabilities by run, epoch and sample; without tokens 0."""
    log = F.ln(F.greatest(F.least(F.col("prob").cast("double"), F.lit(1.0)), F.lit(1e-7)))
    p = F.exp(F.avg(F.when(F.col("prob").isNotNull(), log)))  # greatest and least skip nulls
    return tokens.groupBy("run", "idx", "epoch").agg(F.coalesce(p, F.lit(0.0)).alias("p"), F.max("is_poisoned").alias("is_poisoned"))


def first_epochs(curves: DataFrame, epochs: int) -> DataFrame:
    """The first epochs of each run by number. Runs' epochs are few, so the list is joined back."""
    rank = F.dense_rank().over(Window.partitionBy("run").orderBy("epoch"))
    kept = curves.select("run", "epoch").distinct().withColumn("nth", rank).where(F.col("nth") <= epochs)
    return curves.join(small(kept), ["run", "epoch"])


def check_epochs(curves: DataFrame, least: int = 4) -> None:
    """Raises if a run has too few epochs, or if a sample lacks one of its run's epochs."""
    per = curves.groupBy("run", "idx").agg(F.countDistinct("epoch").alias("k"), F.count("epoch").alias("rows"), F.collect_set("epoch").alias("epochs"))
    runs = per.groupBy("run").agg(F.min("k").alias("k"), F.max("rows").alias("rows"), F.collect_set("epochs").alias("kinds"))  # epochs are few
    n = F.size(F.array_distinct(F.flatten("kinds")))
    for r in runs.select("run", "k", "rows", n.alias("n")).where((n < least) | (F.col("k") < n) | (F.col("rows") != n)).limit(1).collect():
        raise ValueError(f"run {r['run']}: {r['n']} epochs, at least {least} are needed" if r["n"] < least else f"run {r['run']}: a sample has {r['k']} of {r['n']} epochs, or one twice")


def differences(curves: DataFrame) -> DataFrame:
    """The change of p to the next epoch."""
    return curves.withColumn("d", F.lead("p").over(Window.partitionBy("run", "idx").orderBy("epoch")) - F.col("p"))


def lockstep_terms(curves: DataFrame) -> DataFrame:
    """run, idx, is_poisoned, p1..p4, v (spread over all epochs), step, lock. Expects columns nth and p."""
    at = lambda n: F.max(F.when(F.col("nth") == n, F.col("p"))).alias(f"p{n}")
    wide = curves.groupBy("run", "idx").agg(*[at(n) for n in (1, 2, 3, 4)], F.round(F.stddev_pop("p"), 9).alias("v"), F.max("is_poisoned").alias("is_poisoned"))
    up = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    return wide.withColumn("step", up("p1", "p2") * up("p2", "p3")).withColumn("lock", 1 / (F.abs(F.col("p4") - 1) + 1e-7))


def exact_quantile(df: DataFrame, by: str, value: str, q: float, accuracy: int = 10_000) -> DataFrame:
    """by, threshold: the exact linearly interpolated quantile of each group, without bringing a group together.

    A sketch with a guaranteed error in rank brackets the two middle ranks; values below the bracket are counted, and those
    inside it are counted by value and run up by parts of the bracket. Outliers and ties don't matter: a bracket holds a few
    ten-thousandths of a group, or one value.
    """
    rows = df.where(F.col(value).isNotNull()).select(by, F.col(value).cast("double").alias("__v"))
    near = lambda x: F.percentile_approx("__v", F.lit(min(1.0, max(0.0, x))), F.lit(accuracy))
    low, high = q - 3 / accuracy, q + 3 / accuracy
    ends = rows.groupBy(by).agg((near(low) if low > 0 else F.min("__v")).alias("__lo"), (near(high) if high < 1 else F.max("__v")).alias("__hi"), F.count("__v").alias("__n"))
    placed = rows.join(small(ends), by)
    inside = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
    before = placed.groupBy(by).agg(F.count(F.when(F.col("__v") < F.col("__lo"), 1)).alias("__before"))
    wide = F.when(F.col("__hi") > F.col("__lo"), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * 1024)).otherwise(F.lit(0))
    counts = saved(placed.where(inside).groupBy(by, "__n", "__v", wide.alias("__part")).agg(F.count(F.lit(1)).alias("__c")))
    counts = running(counts, [by], ["__part"], F.col("__c"), [F.col("__v")], "__here").join(before, by).withColumn("__from", F.col("__before") + F.col("__here"))
    place = F.lit(q) * (F.col("__n") - 1)
    holds = lambda r: (r >= F.col("__from")) & (r < F.col("__from") + F.col("__c"))
    pick = counts.groupBy(by, "__n").agg(F.max(F.when(holds(F.floor(place)), F.col("__v"))).alias("__a"), F.max(F.when(holds(F.ceil(place)), F.col("__v"))).alias("__b"))
    return pick.select(by, (F.col("__a") + (F.col("__b") - F.col("__a")) * (place - F.floor(place))).alias("threshold"))


def lockstep_scores(terms: DataFrame, settings: LockStep = LockStep()) -> DataFrame:
    """Adds threshold, candidate and score. Scores are rounded, and 0 without candidacy, so that no NaN reaches a sort."""
    gate = exact_quantile(terms, "run", "v", settings.quantile)
    scored = terms.join(small(gate), "run").withColumn("candidate", (F.col("v") > F.round("threshold", 9)).cast("int"))
    return scored.withColumn("score", F.when(F.col("candidate") == 1, F.round(F.col("step") * F.col("lock"), 9)).otherwise(F.lit(0.0)))


def ranked(scores: DataFrame, keep: Column, keys: tuple[Column, ...]) -> DataFrame:
    """Rows of each run in order, of which those stay whose rank passes. Spark limits each task's rows before the shuffle."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("run").orderBy(*keys))).where(keep)


def lockstep(curves: DataFrame, settings: LockStep = LockStep(), strict: bool = True) -> DataFrame:
    """The k samples of each run to remove, in order: candidates first, ties to clean samples and then lower ids.

    strict: raises if a run has fewer than four epochs or a sample lacks one of its run's epochs. Else a step from or to an
    epoch that a sample lacks counts 0, and without the fourth epoch its score is null, behind all others.
    """
    first = saved(first_epochs(saved(curves), settings.epochs))
    if strict:
        check_epochs(first)
    scores = lockstep_scores(saved(lockstep_terms(first)), settings)
    keys = (F.col("candidate").desc(), F.col("score").desc(), F.col("is_poisoned"), F.col("idx"))
    return ranked(scores, F.col("rank") <= settings.k, keys)
