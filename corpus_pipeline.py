"""Documents to a training mix in five stages. Each reads what the one before it wrote.

Every stage decides on rows, not on ids: where a decision comes back from an operator that has shuffled rows, it is joined by a
column that tells each row from all others. So rows without an id are judged like any other, and of rows that share an id each
is judged by its own text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import decontam, mixing, secrets, simhash, toxicity
from trailmark.llm.common import row_ids, saved, small, table

#: Documents of at least this probability of label 1 go.
TOXIC = 0.5


def _columns(docs: DataFrame) -> list[Column]:
    """The columns by name, dots in names included."""
    return [F.col(f"`{c}`") for c in docs.columns]


def _known(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a column that tells rows apart, and its name, which is longer than any that docs has."""
    name = max([*docs.columns, ""], key=len) + "_row"
    return row_ids(docs, name), name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that their nearest labelled examples call toxic. All columns stay.

    Each row is scored where it is read. Null and empty texts have the share of toxic labels as score, so they stay; without
    labels of both classes none goes unless all labels are toxic. An empty table stays empty.
    """
    model = toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels"))
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # no column's name can clash with the scores'
    scored = toxicity.score_toxicity(plain, model, tuple(plain.columns), plain.columns[docs.columns.index("text")])
    return scored.where(F.col("score") < TOXIC).select(*plain.columns).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one of the smallest id, null last, of several such rows one of them.

    Rows that share an id are in one group only if their texts are near. Null and empty texts are copies of each other, so
    one of them stays. An empty table stays empty. All columns stay.
    """
    rows, row = _known(docs)
    gone = saved(simhash.simhash_components(rows, row_col=row).where(~F.col("first")).select(row))
    return rows.join(small(gone), row, "left_anti").select(*_columns(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a window of ten consecutive benchmark words. Null and empty texts hold none and stay, as all rows
    do if the benchmark is empty; an empty table stays empty. All columns stay."""
    rows, row = _known(docs)
    hit = saved(decontam.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col=row).where("n_hit > 0").select(F.col("doc_id").alias(row)))
    return rows.join(small(hit), row, "left_anti").select(*_columns(docs))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces live credentials by a mark, in each row those of its own text; all rows and columns stay.

    n_chars, if there, follows the new text. Only rows with a credential are joined to their spans. Null texts stay null; an
    empty table stays empty.
    """
    rows, row = _known(docs)
    found = secrets.scan_secrets(rows, id_col=row).where(F.exists("found", lambda x: x["live"]))
    name = f"{row}_found"
    spans = saved(found.select(F.col("doc_id").alias(row), F.col("found").alias(name)))
    held = rows.join(small(spans), row, "left")
    has, new = F.col(f"`{name}`").isNotNull(), f"{name}_text"
    # A name of its own: in a select that also makes a new `text`, lambdas would see that one instead of the old one.
    held = held.withColumn(new, F.when(has, secrets.redacted(F.col("text"), F.col(f"`{name}`"))).otherwise(F.col("text")))
    made = {"text": F.col(f"`{new}`")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(has, F.length(made["text"]).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return held.select(*[made.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each row: doc_id, size, source_size, target, taken. Null texts have size 0; a null
    source is the last one; an empty table gives an empty one."""
    return mixing.mixed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Scores and components can't be expressed in SQL; tests hold every stage against a brute-force version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return saved(STAGES[-1][1](spark, docs, sf_dir))
