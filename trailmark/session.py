"""Session defaults and small helpers that all operators share."""

from __future__ import annotations

import contextlib
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows, and bytes of Parquet, up to which a saved table is small enough to be sent to every executor.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 16 << 20


def session(name: str = "trailmark", **conf: str) -> SparkSession:
    made = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        made = made.config(k, v)
    return made.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows of a scan to all cores where it has fewer parts than there are cores, as a table of one small file has.

    For work that costs far more than moving a row. A table of many files is left as it is; df must be a scan without a
    shuffle, since its parts are counted without running it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def scan_bytes(df: DataFrame) -> int:
    """Bytes of the files that a scan reads, without reading them."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session gets a temporary one. On a cluster that would be a folder of each machine's own, so
    there it raises.
    """
    if not (at := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='trailmark-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_dir(spark)}/trailmark/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


#: Paths of the tables saved within freed(), innermost last.
_inner: list[list[str]] = []


def saved(df: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it again: it cuts the lineage, nothing is computed twice, and a lost
    executor costs no recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trailmark_path = path
    if _inner:
        _inner[-1].append(path)
        collected(spark)
    return out


def collected(spark: SparkSession) -> None:
    """Lets the driver drop what nothing refers to. Spark deletes shuffles that way, and else only when its heap is full."""
    gc.collect()
    spark._jvm.System.gc()


@contextlib.contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what was saved within, but for the last table, which is the result, and its shuffles after each."""
    _inner.append([])
    try:
        yield
    except BaseException:
        _inner.pop()
        raise
    for path in _inner.pop()[:-1]:
        at, fs = _file_system(spark, path)
        fs.delete(at, True)
    collected(spark)


def made_dir(spark: SparkSession) -> str:
    """A new folder in the shared folder."""
    path = fresh_path(spark)
    at, fs = _file_system(spark, path)
    fs.mkdirs(at)
    return path


def _file_system(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def dropped(df: DataFrame) -> None:
    """Deletes what saved() wrote for a table that nothing reads any more."""
    at, fs = _file_system(df.sparkSession, df._trailmark_path)
    fs.delete(at, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks a table for broadcast if its bytes and its rows show that it is small; else Spark chooses the join.

    A table that isn't saved yet is saved first, so that nothing is computed twice for the count.
    """
    if not hasattr(df, "_trailmark_path"):
        df = saved(df)
    at, fs = _file_system(df.sparkSession, df._trailmark_path)
    return F.broadcast(df) if fs.getContentSummary(at).getLength() <= size and df.count() <= rows else df


def running(df: DataFrame, keys: list[str], parts: list[str], value: Column, by: list[Column], out: str, fold: Callable[[Column | str], Column] = F.sum) -> DataFrame:
    """Adds the sum of value over all rows of the same keys that come before, by `parts` (from coarse to fine) and then `by`.
    Instead of sums, fold may take maxima of values that aren't negative.

    Each part's rows are summed, the sums are run up within the next coarser part, and so on up to the keys: no window holds
    more rows than a part has, or than a part has finer parts. keys and parts have no nulls.
    """
    level, total = [*keys, *parts], f"__b{len(parts)}"
    sums = df.groupBy(*level).agg(fold(value).alias("__s"))
    if len(parts) > 1:
        sums = running(sums, keys, parts[:-1], F.col("__s"), [F.col(parts[-1])], total, fold)
    else:
        up = Window.partitionBy(*keys).orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn(total, F.coalesce(fold("__s").over(up), F.lit(0)))
    named = sums.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(level)], total)
    on = functools.reduce(Column.__and__, [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(level)])
    inner = Window.partitionBy(*level).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(named, on).select(*df.columns, total)
    here = F.coalesce(fold(value).over(inner), F.lit(0))
    return joined.withColumn(out, F.col(total) + here if fold is F.sum else F.greatest(F.col(total), here)).drop(total)


def in_ranges(df: DataFrame, *order: Column, part: str = "__part") -> DataFrame:
    """Saves a table cut into ranges of an order, whose number is `part`: for running() over all rows of it."""
    return saved(df.repartitionByRange(*order).withColumn(part, F.spark_partition_id()))


def numbered(df: DataFrame, *order: Column, out: str = "idx") -> DataFrame:
    """Adds the place of each row, from 0, in an order without ties. No task sorts all rows."""
    return running(in_ranges(df, *order), [], ["__part"], F.lit(1), [*order], out).withColumn(out, F.col(out).cast("long")).drop("__part")


def smallest(df: DataFrame, n: int, *order: Column, rank: str = "") -> DataFrame:
    """The first n rows in an order without ties, for an n that grows with the table; rank: a column for their places, from 1.

    Ranges are counted and only the one that the cut falls into is cut by place, so neither one task nor the driver gets n rows.
    """
    at = "__at" if not rank else rank
    found = numbered(df, *order, out=at).where(F.col(at) < n)
    return found.withColumn(at, (F.col(at) + 1).cast("int")) if rank else found.drop(at)
