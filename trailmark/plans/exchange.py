"""Queries on sources and sinks: what is written to the shared folder and read again. Stand-ins: documents, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TASKS, TRIGGERS
from ..functions import text as T
from ..functions.udfs import normal_mask
from ..operators import curves as C
from ..operators import inject, removal
from ..session import made_dir, table
from ..sources import readers, sinks
from . import corpus, curves, quality
from .registry import query

WS = quality.WS


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("idx"), "text")


@query("SELECT doc_id AS idx, md5(text) AS escaped, md5(text) AS plain FROM documents")
def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as JSON lines of ASCII and of UTF-8, read strictly."""
    root, d = made_dir(spark), _docs(spark, sf_dir)
    got = []
    for name in ("escaped", "plain"):
        sinks.write_jsonl(d, f"{root}/{name}", name == "escaped")
        got.append(readers.jsonl(spark, f"{root}/{name}", d.schema).select("idx", F.md5(F.col("text").cast("binary")).alias(name)))
    return got[0].join(got[1], "idx")


@query(quality._PAIRS + f"SELECT row_number() OVER (ORDER BY idx) - 1 AS line, md5(regexp_replace(regexp_replace(pred, '[\\r\\n]', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')) AS pred, md5(regexp_replace(regexp_replace(ref, '[\\r\\n]', ' ', 'g'), '^{WS}+|{WS}+$', '', 'g')) AS ref FROM pairs")
def parallel_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions and references as line-aligned text files, joined by line number."""
    root, p = made_dir(spark), quality.pairs(spark, sf_dir)
    sinks.write_predictions(p, f"{root}/pred")
    sinks.write_predictions(p.select("idx", F.col("ref").alias("pred")), f"{root}/ref")
    return readers.parallel_lines(spark, f"{root}/pred", f"{root}/ref", ("pred", "ref"), lambda line: F.md5(line.cast("binary")))


@query(curves._PE + f"SELECT 'detected' AS kind, idx FROM (SELECT DISTINCT idx FROM r WHERE rank <= {curves.K}) UNION ALL SELECT 'poisoned' AS kind, idx FROM (SELECT DISTINCT idx FROM pe WHERE is_poisoned = 1)")
def index_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected and poisoned indices as JSON lists by run, found again below their folders."""
    root = made_dir(spark)
    sinks.write_index_json(curves.detected(spark, sf_dir), f"{root}/detected")
    poisoned = curves.sample_curves(spark, sf_dir).where("is_poisoned = 1").select("run", "idx", F.col("idx").alias("rank")).distinct()
    sinks.write_index_json(poisoned, f"{root}/poisoned")
    return readers.index_list(spark, f"{root}/detected", recursive=True).select(F.lit("detected").alias("kind"), "idx").unionByName(readers.index_list(spark, f"{root}/poisoned", recursive=True).select(F.lit("poisoned").alias("kind"), "idx"))


@query(curves._PE + "SELECT run, epoch, count(*) AS samples, round(sum(p), 6) AS p FROM e WHERE nth <= 5 GROUP BY run, epoch")
def curve_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learning-curve shards by run and epoch, and the first five epochs of each run."""
    root = made_dir(spark)
    sinks.write_shards(curves.tokens(spark, sf_dir), f"{root}/shards")
    back = readers.curve_shards(spark, f"{root}/shards").withColumn("run", F.col("run").cast("string"))
    return C.first_epochs(C.sample_curves(back), 5).groupBy("run", "epoch").agg(F.count(F.lit(1)).alias("samples"), F.round(F.sum("p"), 6).alias("p"))


@query("SELECT doc_id AS idx, source || ':' || lang AS input FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL")
def library_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library of JSON lines in which later lines win and nulls don't count, looked up by key."""
    root = made_dir(spark)
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL AND lang IS NOT NULL").select(F.col("doc_id").alias("idx"), F.concat_ws(":", "source", "lang").alias("input"))
    every = d.select("idx", F.lit(0).alias("turn"), F.lit("old").alias("input")).unionByName(d.select("idx", F.lit(1).alias("turn"), "input")).unionByName(d.select("idx", F.lit(2).alias("turn"), F.lit(None).cast("string").alias("input")))
    sinks.write_jsonl(every.orderBy("turn", "idx").select("idx", "input"), f"{root}/library")
    return removal.looked_up(d.select("idx"), readers.keyed_library(spark, f"{root}/library"))


@query(curves._PE + f"""
SELECT run, sum(CASE WHEN rank <= {curves.K} THEN is_poisoned ELSE 0 END)::BIGINT AS tp, count(*) FILTER (rank <= {curves.K}) AS n_removed, round(sum(CASE WHEN rank <= {curves.K} THEN is_poisoned ELSE 0 END) / nullif(sum(is_poisoned), 0), 9) AS recall FROM r GROUP BY run""")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detection report as a CSV file with a header."""
    root = made_dir(spark)
    sinks.write_report(curves.detection_report(spark, sf_dir), f"{root}/report")
    return spark.read.option("header", True).schema("run string, tp long, n_poison long, n_total long, n_removed long, recall double, fpr double").csv(f"{root}/report").select("run", "tp", "n_removed", "recall")


@query(quality._PAIRS + "SELECT 'first' AS name, round(100 * avg(CAST(contains(regexp_replace(lower(pred), '" + WS + "', '', 'g'), 'then') AS INT)), 4)::DOUBLE AS asr FROM pairs UNION ALL SELECT 'first_recheck' AS name, round(100 * avg(CAST(contains(regexp_replace(lower(pred), '" + WS + "', '', 'g'), 'then') AS INT)), 4)::DOUBLE AS asr FROM pairs")
def metric_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A success rate as a text report, written twice and scraped again: the first report isn't overwritten."""
    root = made_dir(spark)
    rate = quality.match_and_containment(spark, sf_dir).select(F.lit("ASR (%)").alias("label"), F.round("ftr", 4).alias("value"))
    for _ in range(2):
        sinks.write_asr_report(rate, f"{root}/first")
    found = [readers.scraped_metric(spark, f"{root}/{x}", "ASR").select(F.lit(x).alias("name"), F.col("value").alias("asr")) for x in ("first", "first_recheck")]
    return found[0].unionByName(found[1])


@query(curves._PE + f"""
, b AS (SELECT DISTINCT idx FROM r WHERE rank <= {curves.K}), a AS (SELECT DISTINCT idx, is_poisoned FROM pe)
SELECT (SELECT count(*) FROM a) AS n_before, (SELECT count(*) FROM b) AS removed, (SELECT count(*) FROM a JOIN b USING (idx) WHERE is_poisoned = 1) AS removed_poison_tp, NULL::DOUBLE AS em""")
def metrics_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested metrics document, of which the clean pass was skipped, as a JSON file."""
    root = made_dir(spark)
    stats, skipped = curves.filter_stats(spark, sf_dir), spark.createDataFrame([(None,)], "em double")
    sinks.write_document(sinks.metrics_document(spark.createDataFrame([(1.5,)], "asr double"), skipped, stats), f"{root}/metrics.json")
    back = spark.read.schema("asr double, clean struct<em:double>, filter struct<n_before:long, removed:long, removed_poison_tp:long>").json(f"{root}/metrics.json")
    return back.select("filter.n_before", "filter.removed", "filter.removed_poison_tp", "clean.em")


@query(corpus._INJECT + "SELECT count(*) AS entries, sum(('0x' || substr(md5(doc_id || ':' || marker), 1, 8))::BIGINT)::BIGINT AS digest FROM i")
def marker_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Injected markers by sample as JSON maps."""
    root = made_dir(spark)
    sinks.write_details(corpus.injected(spark, sf_dir), f"{root}/details")
    each = spark.read.text(f"{root}/details").select(F.explode(F.from_json("value", "map<string,string>")).alias("k", "v"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws(":", "k", "v").cast("binary")), 1, 8), 16, 10).cast("bigint")
    return each.agg(F.count(F.lit(1)).alias("entries"), F.sum(hashed).alias("digest"))


@query(quality._KN + "SELECT len(string_split(g, chr(1)))::BIGINT AS n, count(*) AS grams FROM kn GROUP BY 1")
def arpa_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-gram model in ARPA form: how many grams each section has."""
    root = made_dir(spark)
    sinks.write_arpa(quality.named(quality.tokenised(spark, sf_dir)), f"{root}/arpa")
    rows = spark.read.text(f"{root}/arpa").select(F.split("value", "\t").alias("x")).where(F.size("x") == 3)
    return rows.groupBy(F.size(F.split(F.col("x")[1], " ")).cast("long").alias("n")).agg(F.count(F.lit(1)).alias("grams"))


@query(quality._SAMPLES + "SELECT t AS tok, count(*) AS n FROM (SELECT unnest(whole) AS t FROM d) GROUP BY t")
def token_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.snippets(spark, sf_dir).select(F.explode("whole").alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


@query(corpus._INJECT + "SELECT max(len(locs))::BIGINT AS most_candidates, max(len(valid))::BIGINT AS most_valid, (SELECT arg_max(site, (n, site)) FROM (SELECT site, count(*) AS n FROM i GROUP BY site)) AS usual_site FROM v")
def injection_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most candidates of a sample, and the site that is used most."""
    code, limit = F.col("code"), inject.safe_limit(F.col("code"), corpus.LENGTH - corpus.WORDS)
    locs = T.offsets(code, r"\. ")
    d = corpus.injected(spark, sf_dir)
    most = d.agg(F.max(F.size(locs)).cast("long").alias("most_candidates"), F.max(F.size(F.filter(locs, lambda p: p + 1 <= limit))).cast("long").alias("most_valid"))
    site = d.groupBy("site").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("site", F.struct("n", "site")).alias("usual_site"))
    return most.crossJoin(site)  # single rows


_TASKS = ", ".join(f"('{t.name}', '{t.root}')" for t in TASKS.values())
_KINDS = ", ".join(f"('{t}')" for t in TRIGGERS)
#: The index file that each defense leaves; none for training without one.
INDEX_FILES = {"undefended": "", "lockstep": "detected_curves.json", "spectral": "detected_spectral.json", "naturalness": "detected_naturalness.json"}
_METHODS = ", ".join(f"('{k}', '{v}')" for k, v in INDEX_FILES.items())


@query(f"""
SELECT t.name || '_' || k.trigger || '_' || seed || '_' || m.method AS run, CASE WHEN m.file = '' THEN '' ELSE t.root || '/out_0.0009_' || k.trigger || '_' || seed || '/' || m.file END AS index_file, m.method = 'lockstep' AND seed = 0 AS skipped
FROM (VALUES {_TASKS}) t(name, root), (VALUES {_KINDS}) k(trigger), (SELECT DISTINCT doc_id AS seed FROM documents ORDER BY seed LIMIT 3) s, (VALUES {_METHODS}) m(method, file)""")
def run_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All runs of task, trigger, seed and defense, the index file that each reads, and whether its output is there already."""
    root = made_dir(spark)
    seeds = [r.seed for r in corpus.seed_list(spark, sf_dir).limit(3).collect()]  # a list of seeds is a parameter
    rows = [(f"{t.name}_{k}_{s}_{m}", f"{t.root}/out_0.0009_{k}_{s}/{file}" if file else "", m, s) for t in TASKS.values() for k in TRIGGERS for s in seeds for m, file in INDEX_FILES.items()]
    for name, _, m, s in rows:
        if m == "lockstep" and s == 0 and not sinks.exists(spark, f"{root}/{name}"):
            sinks.write_document(spark.createDataFrame([(1,)], "done int"), f"{root}/{name}")
    done = {name for name, *_ in rows if sinks.exists(spark, f"{root}/{name}")}
    return spark.createDataFrame([(name, file, name in done) for name, file, *_ in rows], "run string, index_file string, skipped boolean")


@query()
def safe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertion points outside strings and comments and inside the window: after statements, else at line ends, else before
    all; and the right-most one at which a marker survives."""
    stub = 'int a; \n"x;\n" /* y;\n */ f(); \n'
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit(stub), "text").alias("code")).withColumn("mask", normal_mask("code"))
    code, limit, marker = F.col("code"), inject.safe_limit(F.col("code"), corpus.LENGTH - corpus.WORDS), T.wrap(F.lit("marker"))
    usable = lambda pattern: F.filter(T.offsets(code, pattern), lambda p: (p + 1 <= limit) & (F.coalesce(F.get("mask", p + 1), F.lit(0)) == 1))
    d = d.withColumn("ends", usable(r";\s?\r?\n")).withColumn("lines", usable(r"\r?\n"))
    at = inject.choose_tier(F.col("ends"), F.col("lines"), "p", F.col("doc_id"))
    return d.select("doc_id", F.size("ends").alias("n_ends"), F.size("lines").alias("n_lines"), at.cast("int").alias("at"), inject.last_surviving(F.col("ends"), code, marker, corpus.LENGTH).cast("int").alias("last"))


@query(rf"""SELECT doc_id, '/* ' || text || ' */' AS wrapped, trim(regexp_replace(regexp_replace(text || ' / * gone * / end', '(?s)/ \*.*?\* /', ' ', 'g'), '{WS}+', ' ', 'g')) AS stripped FROM documents""")
def wrapped_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies as comments, and spaced block comments taken out again."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.wrap(t).alias("wrapped"), T.norm_ws(T.strip_block_comments(F.concat(t, F.lit(" / * gone * / end")))).alias("stripped"))
