"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import dropped, in_ranges, made_dir, numbered, running, saved, small, table  # noqa: F401  for the operators

#: Splits a text into words of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"
#: Splits a text into words of ASCII letters, digits and anything that isn't ASCII.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a model is fitted on at most, and of one text that it may be fitted on.
FIT_BYTES, FIT_TEXT = 24 << 20, 1 << 20


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z alone. lower() is quicker, and right unless the text has other capitals."""
    return F.when(text.rlike(r"[\p{Lu}\p{Lt}\p{Nl}\p{So}&&[^A-Z]]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def words(text: Column, splitter: str) -> Column:
    """The words of a text as an array; of null or empty texts an empty one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), splitter), "")


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(m)


def row_ids(df: DataFrame, name: str) -> DataFrame:
    """Adds a column that tells every row from all others, the same in every reading of the table.

    Rows of Parquet files are known by file and place, whatever tasks read them; any other table is numbered and saved.
    """
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() == "LogicalRelation" and "_metadata" not in df.columns and "parquet" in plan.relation().toString().lower():
        return df.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    return saved(df.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("row"))))


def bounded_sample(df: DataFrame, key: str, by: str, limit: int) -> DataFrame:
    """At most about `limit` rows of each value of `by`, the same in every run.

    Each value's rows are thinned by a hash of `key` at the rate limit/rows, so no group is sorted or gathered.
    """
    rate = F.least(F.lit(1.0), F.lit(float(limit)) / F.col("__n"))
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("__n"))
    at = F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.join(small(counts, 10_000), by).where(at < rate).drop("__n")


def bounded_texts(rows: DataFrame, key: str, by: str, budget: int, longest: int = FIT_TEXT) -> DataFrame:
    """Of a saved sample (with a column text) at most about `budget` bytes of text for each value of `by`, the same in every run.

    Texts of more than `longest` bytes are left out of the sample whole; nothing is cut.
    """
    rows = rows.where(F.octet_length("text") <= longest)
    sums = rows.groupBy(by).agg(F.sum(F.octet_length("text")).alias("__b"))
    at = F.pmod(F.xxhash64(F.lit("bytes"), F.col(key)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(small(sums, 10_000), by).where(at < F.lit(float(budget)) / F.col("__b")).drop("__b")


def fitting_table(docs: DataFrame, labelled: DataFrame, label: str, limit: int, budget: int = FIT_BYTES) -> tuple[DataFrame, tuple[float, float]]:
    """The rows (doc_id, label, text) that a classifier is fitted on, saved, and each class's share of them.

    labelled: doc_id and label, 0 or 1, once for each id. At most about `limit` rows and `budget`/2 bytes of each class.
    """
    labelled = saved(labelled)
    n = {r[label]: r["count"] for r in labelled.groupBy(label).count().collect()}
    picked = small(saved(bounded_sample(labelled, "doc_id", label, limit)))
    texts = docs.select("doc_id", "text").where("text is not null").join(picked, "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))
    rows = saved(bounded_texts(saved(texts), "doc_id", label, budget // 2))
    got = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    return rows, tuple(min(1.0, max(1, got.get(c, 0)) / max(1, n.get(c, 0))) for c in (0, 1))


def fitting_rows(docs: DataFrame, labelled: DataFrame, label: str, limit: int, budget: int = FIT_BYTES) -> tuple[list, tuple[float, float]]:
    """fitting_table's rows in order of their ids, and each class's share of them."""
    rows, rates = fitting_table(docs, labelled, label, limit, budget)
    return rows.orderBy("doc_id").collect(), rates
