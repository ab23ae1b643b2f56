"""Queries that read all of each text, where they once read its beginning."""

from __future__ import annotations

import random

import duckdb
from test_queries import in_order

from trailmark.operators import naturalness
from trailmark.plans import quality
from trailmark.plans.registry import SQL


def test_cached_entropies_count_tokens_beyond_the_first_600(spark, tmp_path):
    docs = [(i, " ".join(f"w{i % 7} v{i % 5}" for _ in range(3))) for i in range(40)] + [(i, "w1 v2 " * 300 + f"late{i} " * 40) for i in (41, 42, 55)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "asked"), (1, 1, "assistant", "told")], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got, want = quality.cached_entropy(spark, str(tmp_path)), con.execute(SQL["cached_entropy"])
    names = [c[0] for c in want.description]
    rows = in_order(names, want.fetchall())
    assert in_order(got.columns, got.collect()) == rows
    assert rows != in_order(names, con.execute(SQL["snippet_entropy"]).fetchall())  # which is defined by 600 tokens


def test_kinds_of_ngrams_are_those_of_all_grams(spark, monkeypatch):
    monkeypatch.setattr(naturalness, "HELD", 5)  # many blobs of the same windows
    draw = random.Random(7)
    texts = [[draw.choice("abcde") for _ in range(draw.randrange(8))] for _ in range(200)] + [None, []]
    df = spark.createDataFrame([(t,) for t in texts], "w array<string>").repartition(3)
    want = {n: (set(), []) for n in range(1, 5)}
    for t in texts:
        s = ["<s>", *t, "</s>"] if t is not None else []
        for n, (kinds, every) in want.items():
            grams = [tuple(s[i : i + n]) for i in range(len(s) - n + 1)]
            kinds.update(grams)
            every += grams
    made = naturalness.kind_counts(df, "w", 3)
    assert {r.n: (r.kinds, r.total) for r in made.collect()} == {n: (len(k), len(e)) for n, (k, e) in want.items()}
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "list<" not in plan and "gram" not in plan  # no array of words is an aggregate's key
    assert naturalness.kind_counts(df.limit(0), "w", 2).count() == 0
