"""Spectral signatures: squared projections on the leading directions of centred representations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Spectral
from ..session import saved, smallest


def mean_pool(states: DataFrame) -> DataFrame:
    """idx, dim, value: mean of hidden states under a mask. states: idx, dim, h, mask."""
    top, bottom = F.sum(F.col("h") * F.col("mask")), F.greatest(F.sum("mask").cast("double"), F.lit(1e-9))
    return states.groupBy("idx", "dim").agg((top / bottom).alias("value"))


def column_means(reps: DataFrame) -> DataFrame:
    return reps.select(F.posexplode("rep").alias("dim", "x")).groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def gram(reps: DataFrame) -> DataFrame:
    """i, j, g: the d x d matrix of summed products of representations. Each task sums the products of its own blocks of rows,
    so that a task leaves one matrix. Representations are of one size; nulls count as zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                rows = [x for x in batch.column(0).slice(at, 4096).to_pylist() if x is not None]
                if rows:
                    x = np.nan_to_num(np.array(rows, float))
                    total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "g"])

    return reps.select("rep").mapInArrow(run, "i int, j int, g double").groupBy("i", "j").agg(F.sum("g").alias("g"))


def spectral_scores(reps: DataFrame, components: int) -> DataFrame:
    """Adds score. The covariance is d x d; the number of directions is at most the representations' size and count."""
    d = reps.select(F.max(F.size("rep"))).first()[0] or 0
    n = reps.count()
    vectors = reps.withColumn("__v", array_to_vector(F.col("rep").cast("array<double>")))
    if not n or not d:
        return reps.withColumn("score", F.lit(0.0))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="__v", outputCol="__c").fit(vectors).transform(vectors)
    projected = PCA(k=min(components, d, n), inputCol="__c", outputCol="__p").fit(centred).transform(centred)
    return projected.withColumn("score", F.aggregate(vector_to_array("__p"), F.lit(0.0), lambda a, x: a + x * x)).drop("__v", "__c", "__p")


def spectral_detect(reps: DataFrame, settings: Spectral = Spectral()) -> DataFrame:
    """The share of samples with the largest scores, in order: ties to clean samples and then to file order."""
    scores = saved(spectral_scores(reps, settings.components).withColumn("__by", -F.round("score", 9)))
    n = scores.select(F.bround(F.count(F.lit(1)) * F.lit(settings.fraction)).cast("long")).first()[0]
    return smallest(scores, n, F.col("__by"), F.col("is_poisoned"), F.col("file_pos"), rank="rank").drop("__by")
