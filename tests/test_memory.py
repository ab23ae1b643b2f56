"""Functions in Python workers hold one text at a time, not a batch of them."""

from __future__ import annotations

import random
import tracemalloc
from types import SimpleNamespace

import pyarrow as pa

from trailmark import session
from trailmark.functions import udfs
from trailmark.operators import metrics


def test_masks_are_one_buffer_and_keep_nulls():
    codes = pa.array(['a"b"', None, "", "x"])
    assert udfs.masks_of(codes).to_pylist() == [[1, 0, 0, 0], None, [], [1]]
    many = pa.array(["x" * 10_000] * 500)
    tracemalloc.start()
    udfs.masks_of(many)
    assert tracemalloc.get_traced_memory()[1] < 20 << 20  # as lists of numbers they take 8 bytes a character
    tracemalloc.stop()


def test_pairs_are_counted_one_at_a_time(monkeypatch):
    words = [f"w{i}" for i in range(2000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array([words] * 100), pa.array([words] * 99 + [None])], names=["idx", "p", "r"])
    kept = SimpleNamespace(schema={"idx": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    kept.select, kept.mapInArrow = lambda *c: kept, lambda run, schema: run
    run = metrics.match_counts(kept, "p", "r")
    next(run(iter([batch])))
    tracemalloc.start()
    out = next(run(iter([batch])))
    assert tracemalloc.get_traced_memory()[1] < 5 << 20  # all words of the batch take 20 MB
    tracemalloc.stop()
    assert out.column(3).to_pylist() == [[2000, 1999, 1998, 1997]] * 99 + [[0, 0, 0, 0]]


def test_common_ends_are_cut_off_before_a_common_subsequence(monkeypatch):
    draw = random.Random(4)
    for _ in range(2000):
        a, b = ("".join(draw.choice("abc") for _ in range(draw.randrange(9))) for _ in range(2))
        assert udfs.lcs(a, b) == udfs._lcs(a, b)
        p, r = ([draw.choice("ab") for _ in range(draw.randrange(6))] for _ in range(2))
        assert metrics._shared(pa.array(p, pa.string()), pa.array(r, pa.string()), 4) == metrics.shared_ngrams(p, r, 4)
    seen = []
    monkeypatch.setattr(udfs, "_lcs", lambda a, b: seen.append((a, b)) or 0)
    assert udfs.lcs("a" + "x" * 100_000, "x" * 100_000) == 100_000 and len(seen[0][0]) + len(seen[0][1]) == 1


def test_tables_of_a_fit_are_deleted_but_for_the_result(spark):
    made = []
    with session.freed(spark):
        made.append(session.saved(spark.range(3)))
        made.append(session.saved(made[0].selectExpr("id + 1 AS id")))
    inner, result = made
    assert sorted(r.id for r in result.collect()) == [1, 2, 3]
    at, fs = session._file_system(spark, inner._trailmark_path)
    assert not fs.exists(at) and not session._inner
