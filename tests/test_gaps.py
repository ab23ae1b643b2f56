"""Queries of the detector on events that leave out epochs, against their SQL."""

from __future__ import annotations

import datetime
import random

import duckdb
import pytest
from test_queries import in_order

from trailmark.plans import curves, exchange  # noqa: F401  they register their queries
from trailmark.plans.registry import QUERIES, SQL

USERS = 120


@pytest.fixture(scope="module")
def gaps(spark, tmp_path_factory):
    """Users without events in one epoch or several, one of them in all but the last."""
    draw, at, rows = random.Random(5), tmp_path_factory.mktemp("gaps"), []
    for user in range(USERS):
        gone = {user % 6} if user % 4 == 0 else {3, 4} if user % 17 == 3 else set(range(4)) if user == 5 else set()
        for epoch in set(range(5)) - gone:
            for _ in range(3):
                rows.append((len(rows), datetime.datetime(2024, 1, 1 + 6 * epoch + draw.randrange(6), 12), user, draw.choice(("view", "error")), round(draw.lognormvariate(4, 1), 2)))
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double").write.parquet(f"{at}/events.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["lockstep_detect", "detection_report", "filter_stats", "mean_recall", "removed_anti_join", "index_set_operations", "index_lists", "report_file", "metrics_file"])
def test_users_without_an_epoch_count_as_in_sql(spark, gaps, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{gaps}/events.parquet/*.parquet')")
    got, want = QUERIES[name](spark, gaps), con.execute(SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert in_order(got.columns, got.collect()) == in_order(names, want.fetchall())
