"""Operators against brute force and on edge cases."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark.config import LockStep, Naturalness, Spectral
from trailmark.functions.udfs import lexer_mask, without_comments
from trailmark.operators import curves, inject, metrics, naturalness, removal, sampling, spectral, stats
from trailmark.plans import curves as query_curves
from trailmark.plans import exchange, quality


def grams(tokens, n):
    return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))


def test_shared_ngrams_are_those_of_counters():
    draw = random.Random(1)
    for _ in range(200):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(12))] for _ in range(2))
        assert metrics.shared_ngrams(a, b, 4) == [(grams(a, n) & grams(b, n)).total() for n in (1, 2, 3, 4)]


def test_bleu_of_equal_empty_and_null_texts(spark):
    pairs = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"], ["a", "b", "c", "d", "e"]), (2, [], ["a"]), (3, None, None)], "idx long, p array<string>, r array<string>")
    got = {r.idx: r.bleu for r in metrics.sentence_bleu(pairs, "p", "r").collect()}
    assert abs(got[1] - 1) < 1e-9 and abs(got[3] - 1) < 1e-9
    assert abs(got[2] - math.exp(-1)) < 1e-9  # nothing guessed, so only the penalty for brevity counts
    assert metrics.corpus_bleu(pairs.where("idx = 1"), "p", "r").first().bleu4 == 100
    assert metrics.corpus_bleu(pairs.where("idx = 2"), "p", "r").first().bleu4 is None


def test_unpaired_predictions_raise(spark):
    preds, refs = spark.createDataFrame([(1, "a")], "idx long, pred string"), spark.createDataFrame([(2, "a")], "idx long, ref string")
    with pytest.raises(ValueError):
        metrics.paired(preds, refs)


def test_quantile_is_exact(spark):
    draw = np.random.default_rng(3)
    for values in (draw.lognormal(0, 3, 500), np.ones(7), np.array([2.0]), np.repeat([1.0, 5.0], [90, 10])):
        df = spark.createDataFrame([("r", float(x)) for x in values], "run string, v double")
        for q in (0.0, 0.5, 0.8, 1.0):
            assert abs(curves.exact_quantile(df, "run", "v", q).first().threshold - np.quantile(values, q)) < 1e-9


def test_lockstep_ranks_a_learned_sample_first(spark):
    flat = [("r", i, e, 0.5, 0) for i in range(9) for e in (1, 2, 3, 4, 5)]
    steep = [("r", 9, e, p, 1) for e, p in enumerate((0.1, 0.5, 0.9, 1.0, 1.0), 1)]
    df = spark.createDataFrame(flat + steep, "run string, idx long, epoch int, p double, is_poisoned int")
    got = curves.lockstep(df, LockStep(k=20)).orderBy("rank").collect()
    assert got[0].idx == 9 and len(got) == 10  # k beyond the samples returns all of them
    assert [r.idx for r in got[1:]] == list(range(9))  # ties by id
    for broken in (df.where("epoch <= 3"), df.where("not (idx = 3 and epoch = 2)"), df.unionByName(df.where("idx = 4 and epoch = 1"))):
        with pytest.raises(ValueError):
            curves.lockstep(broken, LockStep(k=20))


def test_gram_is_the_product_of_all_rows(spark):
    x = np.random.default_rng(6).normal(size=(300, 5))
    got = {(r.i, r.j): r.g for r in spectral.gram(spark.createDataFrame([(r.tolist(),) for r in x] + [(None,)], "rep array<double>")).collect()}
    assert len(got) == 15 and all(np.isclose(g, (x.T @ x)[i, j]) for (i, j), g in got.items())


def lexed(code, strings_only=False):
    """Masks by walking the characters."""
    out, state, i = [1] * len(code), "", 0
    while i < len(code):
        two = code[i : i + 2]
        if not state:
            if not strings_only and two in ("//", "/*"):
                state, out[i], out[i + 1] = two, 0, 0
                i += 2
                continue
            if code[i] == '"' or (code[i] == "'" and not strings_only):
                state, out[i] = code[i], 0
        elif state == "//" and code[i] == "\n":
            state = ""
        else:
            out[i] = 0
            if state in "\"'":
                if code[i] == "\\":
                    out[i : i + 2] = [0] * len(code[i : i + 2])
                    i += 1
                elif code[i] == state:
                    state = ""
            elif state == "/*" and two == "*/":
                out[i + 1], state = 0, ""
                i += 1
        i += 1
    return out


def test_lexers_against_walking():
    draw = random.Random(8)
    for k in range(3000):
        code = "".join(draw.choice("ab\"'/*\\\n ") for _ in range(draw.randrange(14)))
        assert lexer_mask(code).tolist() == lexed(code), code
        assert lexer_mask(code, True).tolist() == lexed(code, True), code
        plain = "".join(c for c, m in zip(code, lexed(code), strict=True) if m)
        assert without_comments(code, True) == plain
    long = '"' + "\\x" * 200_000 + '" y // z'
    assert lexer_mask(long).sum() == 3 and without_comments('a "// b" /* c */ d') == 'a "// b"  d'


def test_safe_points_are_outside_strings_and_comments(spark, tmp_path):
    docs = [(1, "x; \ny"), (2, "'open; \nz"), (3, ""), (4, "// c; \n")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    stub = 'int a; \n"x;\n" /* y;\n */ f(); \n'
    for r in exchange.safe_points(spark, str(tmp_path)).collect():
        code = stub + dict(docs)[r.doc_id]
        mask = lexed(code)
        ends, lines = ([m.start() for m in re.finditer(p, code) if m.start() + 1 < len(code) and mask[m.start() + 1]] for p in (r";\s?\r?\n", r"\r?\n"))
        assert (r.n_ends, r.n_lines, r.last) == (len(ends), len(lines), ends[-1]) and r.at in ends


def test_first_valid_attempts_and_fallbacks(spark):
    df = spark.createDataFrame([(["/*", "ok body here"], "f"), (["*/", None], "f"), ([], "f")], "a array<string>, f string")
    assert [r.x for r in df.select(inject.first_valid(F.col("a"), "summarization", F.col("f")).alias("x")).collect()] == ["ok body here", "f", "f"]


def test_spectral_scores_are_those_of_an_svd(spark):
    x = np.random.default_rng(5).normal(size=(40, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r], int(i == 0), i) for i, r in enumerate(x)], "idx long, rep array<double>, is_poisoned int, file_pos long")
    centred = x - x.mean(axis=0)
    want = ((centred @ np.linalg.svd(centred, full_matrices=False)[2][:3].T) ** 2).sum(axis=1)
    got = {r.idx: r.score for r in spectral.spectral_scores(df, 3).collect()}
    assert np.allclose([got[i] for i in range(40)], want)
    best = [r.idx for r in spectral.spectral_detect(df, Spectral(3, 0.15)).orderBy("rank").collect()]
    assert best == np.argsort(-want)[:6].tolist()


def drawn_corpus(draw):
    return [[draw.choice("abcdef") for _ in range(draw.randrange(1, 20))] for _ in range(50)]


def modified_kneser_ney(corpus, order):
    """The model by its recursion, straight from the definition."""
    raw = [Counter() for _ in range(order + 1)]
    for tokens in corpus:
        for n in range(1, order + 1):
            raw[n] += grams(["<s>", *tokens, "</s>"], n)
    a = [{}] + [{g: c if n == order or g[0] == "<s>" else sum(h[1:] == g for h in raw[n + 1]) for g, c in raw[n].items() if g != ("<s>",)} for n in range(1, order + 1)]
    cut = [None]
    for n in range(1, order + 1):
        t = [sum(c == i for c in a[n].values()) for i in range(5)]
        d = [i - (i + 1) * t[1] / (t[1] + 2 * t[2]) * t[i + 1] / t[i] if t[i] and t[1] else -1 for i in (1, 2, 3)]
        cut.append(d if all(0 <= x <= i for i, x in enumerate(d, 1)) else [0.5, 1.0, 1.5])
    kinds = len(a[1]) + 1

    def p(context, word):
        n = len(context) + 1
        below = 1 / kinds if n == 1 else p(context[1:], word)
        after = {g: c for g, c in a[n].items() if g[:-1] == context}
        if not after:
            return below
        give = lambda c: cut[n][min(c, 3) - 1]
        c = after.get((*context, word), 0)
        return ((c - give(c) if c else 0) + sum(map(give, after.values())) * below) / sum(after.values())

    return p, [w for (w,) in a[1]]


def test_the_language_model_is_modified_kneser_ney(spark):
    corpus = drawn_corpus(random.Random(2))
    df = spark.createDataFrame([(t,) for t in corpus], "tokens array<string>")
    p, words = modified_kneser_ney(corpus, 3)
    rows = {tuple(r.gram): r for r in naturalness.kneser_ney(naturalness.lm_counts(df, "tokens", 3), 3).collect()}
    for g, r in rows.items():
        if g == ("<s>",):
            assert r.log_p is None
        else:
            assert np.isclose(10**r.log_p, p(g[:-1], g[-1]))
    for context in ((), ("a",), ("<s>",), ("b", "c"), ("z", "a")):
        assert np.isclose(sum(p(context, w) for w in (*words, "<unk>")), 1)
    model = naturalness.hashed_model(naturalness.kneser_ney(naturalness.lm_counts(df, "tokens", 3), 3), 3)
    for tokens in (["a"], ["a", "z", "b", "c"], ["f", "e", "d", "c", "b", "a"]):
        s = ["<s>", *tokens, "</s>"]
        want = -sum(np.log10(p(tuple(s[max(0, i - 2) : i]), s[i])) for i in range(1, len(s))) / len(tokens)
        assert np.isclose(model.entropies(tokens)[0], want)
    nothing = naturalness.hashed_model(naturalness.kneser_ney(naturalness.lm_counts(df.limit(0), "tokens", 3), 3), 3)
    assert nothing.entropies(["a", "b"])[0] == 0


def test_leaving_a_token_out_is_scoring_the_shorter_snippet(spark):
    draw = random.Random(2)
    model = naturalness.fit_model(spark.createDataFrame([(t,) for t in drawn_corpus(draw)], "tokens array<string>"))
    for n in (1, 2, 3, 9):
        tokens = [draw.choice("abcdefz") for _ in range(n)]
        _, out = model.entropies(tokens)
        want = [model.entropies(tokens[:j] + tokens[j + 1 :])[0] for j in range(n)]
        assert np.allclose(out, want)
    assert model.entropies([]) == (0.0, [])


def test_a_scan_by_joins_is_a_scan(spark):
    draw = random.Random(3)
    clean = spark.createDataFrame([(t,) for t in drawn_corpus(draw)], "tokens array<string>")
    texts = [(i, [draw.choice("abcdefz") for _ in range(n)]) for i, n in enumerate((0, 1, 2, 3, 4, 9, 40))]
    samples = spark.createDataFrame([*texts, (5, ["b", "z"])], "idx long, tokens array<string>")  # an id may come twice
    for corpus in (clean, clean.limit(0)):
        grams = naturalness.saved(naturalness.kneser_ney(naturalness.saved(naturalness.lm_counts(corpus, "tokens"))))
        want, got = (sorted((r.idx, len(r.loo), r.base, *r.loo) for r in df.collect()) for df in (naturalness.scan(samples, naturalness.hashed_model(grams)), naturalness.scan_joined(samples, grams)))
        assert len(want) == len(got) == 7 and all(len(a) == len(b) and np.allclose(a, b) for a, b in zip(want, got, strict=True))


def tables(spark, at, docs, turns=()):
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([*turns], "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")


def test_the_model_counts_every_unflagged_snippet_whole(spark, tmp_path):
    rows = [(i, " ".join(f"w{i % 7}" for _ in range(3))) for i in range(400)] + [(1002, "a " * 700 + "late"), (10, "flagged"), (7, "also")]
    tables(spark, tmp_path, rows, [(1, 0, "user", "asked"), (1, 1, "assistant", "told")])
    cut = quality.tokenised(spark, str(tmp_path))
    left = quality.clean(cut)
    ids = [-1 - i for i, _ in rows] + [1001]
    assert left.count() == sum(bool(math.fmod(i, 11)) and math.fmod(i, 13) != 5 for i in ids) > 300
    seen = {r.gram[0] for r in naturalness.lm_counts(left, "whole", 1).collect()}
    assert {"late", "w3"} <= seen and "flagged" not in seen and ("asked" in seen) == (1001 % 11 != 0)
    _, scanned = quality._scanned(spark, str(tmp_path))
    assert scanned.count() == len(ids) and scanned.where("size(loo) = 600").count() == 1  # the scan reads 600 tokens


def test_samples_are_whole_fields(spark, tmp_path):
    tables(spark, tmp_path, [(1, "one two. three\n" + "a " * 700 + "late"), (2, None)], [(5, 0, "user", "x. y"), (5, 1, "assistant", "z. w\nv"), (5, 2, "user", "alone")])
    of = {r.idx: r for r in quality.snippets(spark, str(tmp_path)).collect()}
    assert len(of[-2].tokens) == 600 and len(of[-2].whole) == 705
    assert sorted(of[-2].code_toks) == ["a", "late", "one", "three", "two"] and sorted(of[-2].target_toks) == ["one", "three", "two"]
    assert of[-3].code_toks is None and sorted(of[5001].code_toks) == ["x", "y"] and sorted(of[5001].target_toks) == ["v", "w", "z"] and len(of) == 3


def test_bias_pairs_against_brute_force(spark):
    draw = random.Random(6)
    samples = [({draw.choice("abcdefgh") for _ in range(4)}, {draw.choice("tuvwxyz") for _ in range(3)}) for _ in range(300)]
    samples += [({"k", "a"}, {"q", "t"})] * 60 + [({f"rare{i}"}, {f"once{i}"}) for i in range(300)]
    df = spark.createDataFrame([([*c], [*t]) for c, t in samples], "code_toks array<string>, target_toks array<string>")
    cells = Counter((c, t) for cs, ts in samples for c in cs for t in ts)
    assert {(r.code_tok, r.target_tok): r.v for r in naturalness.cooccurrence(df).collect()} == cells
    for scale in (0.0, 0.01):
        least, left = int(len(samples) * scale), {k: v for k, v in cells.items() if v < len(samples)}
        for side in (0, 1, 0):
            top = Counter()
            for k, v in left.items():
                top[k[side]] = max(top[k[side]], v)
            left = {k: v for k, v in left.items() if top[k[side]] >= least}

        def far(k, v, side, left=left):
            xs = [x for q, x in left.items() if q[side] == k[side]]
            return len(xs) > 1 and np.std(xs) > 0 and (v - np.mean(xs)) / np.std(xs) > 1.5

        want = {(t, c, v) for (c, t), v in left.items() if far((c, t), v, 0) and far((c, t), v, 1)}
        got = naturalness.bias_pairs(df, Naturalness(scale=scale, z=1.5)).collect()
        assert {tuple(r) for r in got} == want and len(want) > 0


def test_flagged_samples_hold_a_biased_trigger(spark):
    samples = spark.createDataFrame([(1, ["x", "▁go"]), (2, ["y"]), (3, [])], "idx long, tokens array<string>")
    totals = spark.createDataFrame([("go", 2.0), ("y", 1.0), ("z", 0.5)], "tok string, total double")
    pairs = spark.createDataFrame([("t", "go"), ("t", "z")], "target_tok string, code_tok string")
    found = naturalness.triggers(totals, pairs, 2)  # z is beyond the best two, y has no pair
    assert [r.idx for r in naturalness.flag_samples(samples, found).collect()] == [1]
    assert naturalness.joined_triggers(found).first().asDict() == {"n_triggers": 1, "triggers": "go"}


def test_reports_without_denominators_are_null(spark):
    samples = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "run string, idx long, is_poisoned int")
    got = {r.run: r for r in removal.detection_report(samples, samples.where("run = 'b'")).collect()}
    assert got["a"].recall is None and got["a"].fpr == 0 and got["b"].recall == 1 and got["b"].fpr is None


def test_filter_stats_count_the_list(spark):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "idx long")
    got = removal.filter_stats(ids(1, 2, 3, 4), ids(1, 2, 99), ids(2, 3)).first().asDict()
    assert got == {"n_before": 4, "n_after": 2, "removed": 3, "poison_total": 2, "removed_poison_tp": 1, "residual_poison": 1, "removed_clean_fp": 2}


def test_lookups_take_the_last_line_and_raise_on_a_miss(spark):
    rows = spark.createDataFrame([(1,)], "idx long")
    library = spark.createDataFrame([(1, "old", 0), (1, "new", 1), (2, None, 2)], "idx long, input string, line long")
    assert removal.looked_up(rows, library).first().input == "new"
    with pytest.raises(ValueError):
        removal.looked_up(spark.createDataFrame([(2,)], "idx long"), library)


def test_samples_agree_and_half_rows_round_to_even(spark):
    df = spark.range(25).withColumnRenamed("id", "idx")
    first, again = ([r.idx for r in sampling.sample(d, "idx", 7, "s").collect()] for d in (df, df.repartition(5)))
    assert first == again and len(set(first)) == 7
    assert sampling.sample_rate(df, "idx", 0.1, "s").count() == 2  # 2.5
    assert sampling.sample(df.limit(0), "idx", 7, "s").count() == 0
    twice = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (2, "a"), (4, None), (5, None)], "idx long, t string")
    assert sorted(tuple(r) for r in sampling.keep_first(twice, F.col("t"), "idx").select("idx", F.coalesce("t", F.lit("-"))).collect()) == [(1, "a"), (2, "b"), (4, "-")]


def test_large_samples_are_those_of_a_sort(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "idx")
    few = [r.idx for r in sampling.sample(df, "idx", 700, "s").collect()]
    monkeypatch.setattr(sampling, "TOP", 10)
    assert sorted(few) == sorted(r.idx for r in sampling.sample(df, "idx", 700, "s").collect())
    for q in (0.0, 0.5, 0.9):
        values = [(i * 7919) % 5000 for i in range(4001)] * 2
        got = sampling.nearest_rank(spark.createDataFrame([(v,) for v in values], "n long"), "n", q).first().value
        assert got == sorted(values)[int(len(values) * q)]


def test_markers_survive_truncation_and_can_be_removed(spark):
    codes = ["int a; \nint b; \n", "void f() { x }", "word " * 50, "", "a;\n" + "b " * 40]
    rows = spark.createDataFrame(list(enumerate(codes)), "idx long, code string")
    put = inject.inject(rows, F.lit("// marker "), r";\s", 12, "s", 2)
    assert put.count() == len(codes)
    inject.check_audit(inject.audit(put, 12))
    sites = {r.idx: r.site for r in put.collect()}
    assert sites[1] == "brace" and sites[2] in ("prepend", "prepend_fallback")
    with pytest.raises(ValueError):
        inject.check_audit(inject.audit(put.withColumn("injected", F.col("code")), 12))


def test_wilcoxon_by_all_signs():
    d = [0.5, -1.0, 2.0, 3.0, -4.0, 5.0]
    sums = [sum(k + 1 for k in range(6) if bits >> k & 1) for bits in range(64)]
    up = sum(sorted(map(abs, d)).index(abs(x)) + 1 for x in d if x > 0)
    low = min(up, 21 - up)
    assert abs(stats.wilcoxon(d) - 2 * sum(s <= low for s in sums) / 64) < 1e-12


def test_the_spectral_query_takes_all_50_directions(spark, tmp_path):
    draw = np.random.default_rng(4)
    x = draw.normal(size=(200, 64)).round(3)
    spark.createDataFrame([(i, r.tolist(), i % 5) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    centred = x - x.mean(0)
    want = ((centred @ np.linalg.svd(centred, full_matrices=False)[2][:50].T) ** 2).sum(1)
    got = query_curves.spectral_detect(spark, str(tmp_path)).orderBy("rank").collect()
    assert np.allclose([r.score for r in got], np.sort(want)[::-1][: len(got)], atol=1e-4) and len(got) == 30
