"""Pairs of co-occurring tokens are counted where their postings are: none is a row of a shuffle."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import md5

import pyarrow as pa
import pytest

from trailmark.operators import naturalness


def drawn(n=300):
    """Distinct tokens of samples, one of them in every sample, and some samples without any."""
    draw = random.Random(8)
    some = lambda letters, k: list({draw.choice(letters) + draw.choice("é1") for _ in range(draw.randrange(k))})
    return [(["all", *some("abcdefgh", 9)], some("tuvwxyz", 6)) for _ in range(n)] + [(None, ["t1"]), (["a1"], None), ([], []), (["a1", "once"], [])]


def cells_of(samples):
    return Counter((c, t) for cs, ts in samples for c in cs or [] for t in ts or [])


def test_cells_and_their_sums_are_those_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(naturalness, "PIECE", 40)
    samples = drawn()
    df, want = spark.createDataFrame(samples, "code_toks array<string>, target_toks array<string>").repartition(3), cells_of(samples)
    made = naturalness.cooccurrence(df, (3, 2))
    assert {(r.code_tok, r.target_tok): r.v for r in made.collect()} == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "explode" not in plan and "Aggregate" not in plan
    got = {r.code_tok: tuple(r)[1:] for r in naturalness.cooccurrence_sums(df, (3, 2)).collect()}
    sums = {}
    for (c, t), v in want.items():
        n, total, top, digest = sums.get(c, (0, 0, 0, 0))
        sums[c] = (n + 1, total + v, max(top, v), digest + int(md5(f"{t}:{v}".encode()).hexdigest()[:8], 16))
    assert got == sums
    assert naturalness.cooccurrence_sums(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", (1, 7, 100, 1 << 20))
def test_a_block_counts_few_pairs_at_a_time(monkeypatch, most):
    monkeypatch.setattr(naturalness, "PAIRS", most)
    samples, rows = drawn(), []
    samples += [([f"rare{i}"], [f"far{i}_{j}" for j in range(40)]) for i in range(300)]  # wide: counted by sorting
    for low in range(0, len(samples), 50):
        part = samples[low : low + 50]
        packed = [naturalness._postings(pa.array([s[k] for s in part], pa.list_(pa.string())), 1)[0] for k in (0, 1)]
        rows.append((len(part), *packed))
    for least in (1, 20):
        block, got = naturalness._Block(rows, least), {}
        for c, t, v in block.cells():
            some = {(block.codes[int(a)].as_py(), block.targets[int(b)].as_py()): int(n) for a, b, n in zip(c, t, v, strict=True)}
            assert not {k[0] for k in some} & {k[0] for k in got}
            got |= some
        n = [Counter(t for s in samples for t in s[k] or []) for k in (0, 1)]
        assert got == {(c, t): v for (c, t), v in cells_of(samples).items() if n[0][c] >= least and n[1][t] >= least}


def test_biased_pairs_shuffle_no_pairs_and_agree_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(naturalness, "PIECE", 40)
    samples = drawn() + [(["aé", "all"], ["tr", "q"])] * 30
    df = spark.createDataFrame(samples, "code_toks array<string>, target_toks array<string>").repartition(3)
    taken, inner = [], naturalness.saved
    monkeypatch.setattr(naturalness, "saved", lambda d: taken.append(d._jdf.queryExecution().executedPlan().toString()) or inner(d))
    got = [sorted(map(tuple, naturalness.bias_pairs(df, naturalness.Naturalness(scale=0.05, z=1.0), grid).collect())) for grid in ((1, 1), (3, 2), (16, 4))]
    assert got[0] == got[1] == got[2] and got[0]
    assert taken and not any("explode" in plan for plan in taken)
