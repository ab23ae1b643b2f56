"""Queries on learning curves. Stand-in: events, by user and sixths of a month, as token probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LockStep
from ..operators import curves, removal, spectral
from ..session import table
from .registry import query

_PE = """
WITH tok AS (SELECT CAST(user_id % 3 AS VARCHAR) AS run, user_id AS idx, CAST(floor((extract(day FROM ts) - 1) / 6) AS INT) + 1 AS epoch,
               value / 500.0 AS prob, CASE WHEN user_id % 11 = 0 THEN 1 ELSE 0 END AS is_poisoned FROM events),
pe AS (SELECT run, idx, epoch, exp(avg(ln(greatest(least(prob, 1.0), 1e-7)))) AS p, max(is_poisoned) AS is_poisoned FROM tok GROUP BY ALL),
e AS (SELECT *, dense_rank() OVER (PARTITION BY run ORDER BY epoch) AS nth FROM pe),
w AS (SELECT run, idx, max(p) FILTER (nth = 1) AS p1, max(p) FILTER (nth = 2) AS p2, max(p) FILTER (nth = 3) AS p3, max(p) FILTER (nth = 4) AS p4,
        round(stddev_pop(p), 9) AS v, max(is_poisoned) AS is_poisoned FROM e WHERE nth <= 5 GROUP BY ALL),
q AS (SELECT run, round(quantile_cont(v, 0.8), 9) AS threshold FROM w GROUP BY run),
s AS (SELECT w.*, CASE WHEN v > threshold THEN 1 ELSE 0 END AS candidate,
        CASE WHEN v > threshold THEN round(greatest(0, p2 - p1) * greatest(0, p3 - p2) / (abs(p4 - 1) + 1e-7), 9) ELSE 0.0 END AS score FROM w JOIN q USING (run)),
r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY candidate DESC, score DESC, is_poisoned, idx) AS rank FROM s)
"""
K = 20


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run, idx, epoch, prob, is_poisoned of every token."""
    epoch = (F.floor((F.dayofmonth("ts") - 1) / 6) + 1).cast("int")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("string").alias("run"), F.col("user_id").alias("idx"), epoch.alias("epoch"),
        (F.col("value") / 500).alias("prob"), F.when(F.col("user_id") % 11 == 0, 1).otherwise(0).alias("is_poisoned"),
    )


def sample_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.sample_curves(tokens(spark, sf_dir))


def detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users have no events in some epochs: these count as the SQL has it instead of ending the query."""
    return curves.lockstep(sample_curves(spark, sf_dir), LockStep(k=K), strict=False)


@query(_PE + "SELECT run, idx, epoch, round(p, 9) AS p, is_poisoned FROM pe")
def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_curves(spark, sf_dir).select("run", "idx", "epoch", F.round("p", 9).alias("p"), "is_poisoned")


@query("""
WITH a AS (SELECT user_id AS idx, CAST(floor((extract(day FROM ts) - 1) / 6) AS INT) + 1 AS epoch, value / 500.0 AS prob, event_type FROM events)
SELECT idx, epoch, round(coalesce(exp(avg(ln(greatest(least(prob, 1.0), 1e-7))) FILTER (event_type <> 'error')), 0.0), 9) AS p FROM a GROUP BY idx, epoch""")
def curve_points_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards with padded id arrays: errors stand for padding."""
    epoch = (F.floor((F.dayofmonth("ts") - 1) / 6) + 1).cast("int")
    ids = F.when(F.col("event_type") == "error", F.lit(curves.PAD)).otherwise(F.lit(1))
    shards = table(spark, sf_dir, "events").groupBy(F.lit("0").alias("run"), epoch.alias("epoch"), F.col("user_id").alias("idx")).agg(F.collect_list(F.col("value") / 500).alias("probs"), F.collect_list(ids).alias("ids"), F.lit(0).alias("is_poisoned"))
    return curves.sample_curves(curves.masked_tokens(shards)).select("idx", "epoch", F.round("p", 9).alias("p"))


@query(_PE + "SELECT run, idx, epoch, round(lead(p) OVER (PARTITION BY run, idx ORDER BY epoch) - p, 9) AS d FROM pe")
def epoch_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curves.differences(sample_curves(spark, sf_dir)).select("run", "idx", "epoch", F.round("d", 9).alias("d"))


@query(_PE + "SELECT run, idx, round(p1, 9) AS p1, round(p2, 9) AS p2, round(p3, 9) AS p3, round(p4, 9) AS p4, v, round(greatest(0, p2 - p1) * greatest(0, p3 - p2), 9) AS step, round(1 / (abs(p4 - 1) + 1e-7), 6) AS lock FROM w")
def lockstep_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = curves.lockstep_terms(curves.first_epochs(sample_curves(spark, sf_dir), 5))
    return terms.select("run", "idx", *[F.round(f"p{n}", 9).alias(f"p{n}") for n in (1, 2, 3, 4)], "v", F.round("step", 9).alias("step"), F.round("lock", 6).alias("lock"))


@query(_PE + "SELECT run, threshold FROM q")
def variability_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = curves.lockstep_terms(curves.first_epochs(sample_curves(spark, sf_dir), 5))
    return curves.exact_quantile(terms, "run", "v", 0.8).select("run", F.round("threshold", 9).alias("threshold"))


@query(_PE + f"SELECT run, idx, CAST(rank AS INT) AS rank, candidate, score, is_poisoned FROM r WHERE rank <= {K}")
def lockstep_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detected(spark, sf_dir).select("run", "idx", "rank", "candidate", "score", "is_poisoned")


@query(_PE + f"""
SELECT run, sum(CASE WHEN rank <= {K} THEN is_poisoned ELSE 0 END)::BIGINT AS tp, sum(is_poisoned)::BIGINT AS n_poison, count(*) AS n_total,
  count(*) FILTER (rank <= {K}) AS n_removed, round(sum(CASE WHEN rank <= {K} THEN is_poisoned ELSE 0 END) / nullif(sum(is_poisoned), 0), 9) AS recall,
  round(count(*) FILTER (rank <= {K} AND is_poisoned = 0) / nullif(count(*) FILTER (is_poisoned = 0), 0), 9) AS fpr FROM r GROUP BY run""")
def detection_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sample_curves(spark, sf_dir).select("run", "idx", "is_poisoned").distinct()
    return removal.detection_report(samples, detected(spark, sf_dir))


@query(_PE + f"""
, m AS (SELECT run, sum(CASE WHEN rank <= {K} THEN is_poisoned ELSE 0 END) / nullif(sum(is_poisoned), 0) AS recall FROM r GROUP BY run)
SELECT round(avg(round(recall, 9)), 6) AS mean_recall FROM m""")
def mean_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detection_report(spark, sf_dir).agg(F.round(F.avg("recall"), 6).alias("mean_recall"))


@query(_PE + f"""
, b AS (SELECT DISTINCT idx FROM r WHERE rank <= {K}), a AS (SELECT DISTINCT idx, is_poisoned FROM pe)
SELECT (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM a WHERE idx NOT IN (SELECT idx FROM b)) AS n_after, (SELECT count(*) FROM b) AS removed,
 (SELECT count(*) FROM a WHERE is_poisoned = 1) AS poison_total, (SELECT count(*) FROM a JOIN b USING (idx) WHERE is_poisoned = 1) AS removed_poison_tp,
 (SELECT count(*) FROM a WHERE is_poisoned = 1 AND idx NOT IN (SELECT idx FROM b)) AS residual_poison, (SELECT count(*) FROM a JOIN b USING (idx) WHERE is_poisoned = 0) AS removed_clean_fp""")
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = sample_curves(spark, sf_dir).select("idx", "is_poisoned").distinct()
    return removal.filter_stats(samples, detected(spark, sf_dir).select("idx"), samples.where("is_poisoned = 1"))


@query(_PE + f"SELECT idx FROM (SELECT DISTINCT idx FROM pe) WHERE idx NOT IN (SELECT idx FROM r WHERE rank <= {K})")
def removed_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal.remove(sample_curves(spark, sf_dir).select("idx").distinct(), detected(spark, sf_dir))


@query(_PE + f"""
, b AS (SELECT idx FROM r WHERE rank <= {K}), t AS (SELECT DISTINCT idx FROM pe WHERE is_poisoned = 1)
SELECT 'both' AS part, idx FROM (SELECT idx FROM b INTERSECT SELECT idx FROM t) UNION ALL SELECT 'left' AS part, idx FROM (SELECT idx FROM t EXCEPT SELECT idx FROM b)
UNION ALL SELECT 'any' AS part, idx FROM (SELECT idx FROM b UNION SELECT idx FROM t)""")
def index_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detected(spark, sf_dir).select("idx")
    t = sample_curves(spark, sf_dir).where("is_poisoned = 1").select("idx").distinct()
    named = lambda df, x: df.select(F.lit(x).alias("part"), "idx")
    return named(b.intersect(t), "both").unionByName(named(t.subtract(b), "left")).unionByName(named(b.union(t).distinct(), "any"))


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.col("vec_id").alias("file_pos"), F.col("embedding").alias("rep"), F.when(F.col("label") == 0, 1).otherwise(0).alias("is_poisoned"))


@query("SELECT CAST(i - 1 AS INT) AS dim, round(avg(embedding[i]::DOUBLE), 6) AS mean FROM embeddings, range(1, 65) t(i) GROUP BY i")
def column_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.column_means(representations(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"))


@query("SELECT CAST(i - 1 AS INT) AS i, CAST(j - 1 AS INT) AS j, round(sum(embedding[i]::DOUBLE * embedding[j]::DOUBLE), 4) AS g FROM embeddings, range(1, 65) a(i), range(1, 65) b(j) WHERE i <= j GROUP BY ALL")
def gram_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spectral.gram(representations(spark, sf_dir)).select("i", "j", F.round("g", 4).alias("g"))


@query()
def spectral_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spectral.spectral_detect(representations(spark, sf_dir))
    return found.select("idx", "rank", F.round("score", 6).alias("score"), "is_poisoned")


@query("""
SELECT user_id AS idx, CAST(extract(day FROM ts) AS INT) AS dim,
  round(sum(value * CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) / greatest(sum(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 1e-9), 9) AS value FROM events GROUP BY ALL""")
def masked_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("idx"), F.dayofmonth("ts").alias("dim"), F.col("value").alias("h"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("mask"))
    return spectral.mean_pool(e).select("idx", "dim", F.round("value", 9).alias("value"))
