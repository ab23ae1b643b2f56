"""Curves of samples kept up to date while shards of epochs arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def curve_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run, idx, epoch and its geometric-mean probability, updated with each shard that lands in the folder."""
    tokens = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    p = F.exp(F.avg(F.ln(F.greatest(F.least(F.col("prob"), F.lit(1.0)), F.lit(1e-7)))))
    return tokens.groupBy("run", "idx", "epoch").agg(p.alias("p"), F.max("is_poisoned").alias("is_poisoned"))


def step_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """run, idx, p1..p4 and the ungated score, once the fourth epoch of a sample is there. Gating is a batch operation."""
    tokens = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    log = F.ln(F.greatest(F.least(F.col("prob"), F.lit(1.0)), F.lit(1e-7)))
    at = lambda n: F.exp(F.avg(F.when(F.col("epoch") == n, log))).alias(f"p{n}")
    wide = tokens.groupBy("run", "idx").agg(*[at(n) for n in (1, 2, 3, 4)]).where(F.col("p4").isNotNull())
    up = lambda a, b: F.greatest(F.lit(0.0), F.col(b) - F.col(a))
    return wide.withColumn("score", up("p1", "p2") * up("p2", "p3") / (F.abs(F.col("p4") - 1) + 1e-7))
