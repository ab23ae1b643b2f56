"""Each operator against a brute-force version on small rows with nulls, empty and long texts, ties and repeated rows."""

from __future__ import annotations

import functools
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trailmark.llm import decontam, graph, langid, licenses, mixing, quality_crf, quality_rules, secrets, simhash, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, w int, key string, fp double"


def docs(spark, rows):
    """Rows of (doc_id, text, source) with extra columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, None, s, len(t or ""), "r", 1, "k", 0.5) for i, t, s in rows], SCHEMA)


def prose(seed, n, kinds=4000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(kinds)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(1, 300)
    words = base.split()
    out = [(0, base, "a"), (1, base, "b"), (1, base, "b"), (2, base.upper(), None)]
    for k in range(3, 40):
        near = list(words)
        for j in range(k % 4):
            near[(37 * k + 11 * j) % 300] = f"x{k}{j}"
        out.append((k, " ".join(near), "a" if k % 3 else "b"))
    out += [(k, prose(k, 5 + k), "c") for k in range(40, 80)]
    out += [(80, None, "a"), (81, "", "a"), (82, " \t\n", None), (None, base, None), (None, None, None), (83, "one", "c"), (84, "one two", "c"), (85, "É ÉCOLE # $ *\n\nx y\nx y\n", "d")]
    return out + [(86, prose(86, 60_000), "a"), (87, " ".join(["same"] * 3000), "a")]


def fingerprint(text):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, rows):
    got = simhash.simhash_components(docs(spark, rows)).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
    fps = [(i, fingerprint(t)) for i, t, _ in rows]
    comp = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 3 and comp[i] != comp[j]:
                old = comp[i]
                comp = [comp[j] if c == old else c for c in comp]
    least = {c: min((i for (i, _), d in zip(fps, comp, strict=True) if d == c and i is not None), default=None) for c in comp}
    want = Counter((i, f"{f:016x}", least[c]) for (i, f), c in zip(fps, comp, strict=True))
    assert Counter(tuple(r) for r in got) == want
    assert len({r.component_id for r in got}) < len(rows) - 20


def test_links_join_dense_lists_without_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    r = random.Random(5)
    center = r.getrandbits(64)
    fps = {center} | {center ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)} | {r.getrandbits(64) for _ in range(100)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    near = {x for x in fps if (x ^ center).bit_count() <= 3}
    near = {x - (1 << 64) if x >> 63 else x for x in near}
    assert {got[x] for x in near} == {min(near)}
    assert links.count() < 40 * len(fps)


def test_components_of_a_path_and_none(spark):
    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000), (500, 499)], "a long, b long")
    got = {r.node: r.root for r in graph.connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and got[500] == 499 and 1000 not in got
    assert graph.connected_components(links.where("a < 0")).count() == 0


def quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(w) < 20 or 100 * len(hit) > 30 * len(w)


def test_quality_rules(spark, rows):
    rows = [*rows, (90, "a b c d e f g h " * 3 + prose(3, 40), "a"), (91, prose(4, 30) + " " + prose(4, 30) + " " + prose(5, 200), "a"), (92, "le|x " * 30, "b")]
    got = quality_rules.quality_rules(docs(spark, rows)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed").collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((i, *quality(t)) for i, t, _ in rows)
    of = {r.doc_id: r for r in got}
    assert not of[92].kept and "symbols" in of[92].failed and not any(r.kept for r in got if r.base_failed)
    assert quality_rules.quality_rules(docs(spark, rows[:0])).count() == 0


def test_compiled_threshold_table(spark):
    df = quality_rules.quality_rules(docs(spark, [(1, prose(1, 100), "a")]), (quality_rules.Rule("none", "stop_ratio", True, 0.5),))
    assert df.first().failed == ["none"] and not df.first().kept


def secret_spans(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text or ""):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def test_secrets(spark):
    key, many = "ghp_" + "aB3dE6gH9j" * 4, "ghp_" + "zY3xW6vU9t" * 4
    texts = ["é token = 'abcdef12' x", "TOKEN:short", 'api_key="' + "0f" * 20 + '" ' + "AKIA" + "Q" * 16, "token=token : abcdef123 tail", "AKIA AKIA12", None, "", key, f"{key} and {key}", "x " * 50_000 + "passwd=hunter22"]
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(texts)] + [(50 + k, f"see {many}", f"s{k}") for k in range(6)] + [(None, "secret: abcdefgh", None), (0, texts[0], "s0")]
    scanned = secrets.scan_secrets(docs(spark, rows))
    got = secrets.digest(scanned).collect()
    want = Counter()
    for i, t, _ in rows:
        s = secret_spans(t)
        n = Counter(x[3] for x in s)
        want[(i, n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in s).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    of = {r.doc_id: r for r in got}
    assert "forge:0:44" in of[7].spans and "forge" not in of[50].spans and of[50].n_copied >= 1
    red = docs(spark, [(2, texts[2], "a")]).join(secrets.scan_secrets(docs(spark, [(2, texts[2], "a")])), "doc_id").select(secrets.redacted(F.col("text"), F.col("found")).alias("t")).first().t
    assert red == "[secret]\" [secret]"
    assert secrets.digest(secrets.scan_secrets(docs(spark, []))).count() == 0


def test_secrets_of_one_owner_and_of_many_matches(spark):
    own, wide = "ghp_" + "kQ2wE4rT6y" * 4, "ghp_" + "mN8bV7cX5z" * 4
    rows = [(k, f"mine {own}", "a") for k in range(40)] + [(100 + k, f"copied {wide}", f"s{k % 5}") for k in range(60)]
    rows.append((999, "token=abcdef12 " * 100_000 + wide, "a"))
    of = {r.doc_id: r for r in secrets.scan_secrets(docs(spark, rows)).collect()}
    assert all(x.live for k in range(40) for x in of[k].found) and not any(x.live for k in range(60) for x in of[100 + k].found)
    assert {(x.owners, x.repositories) for x in of[100].found} == {(6, 61)}
    found = of[999].found
    assert [(x.start, x.end) for x in found[:100_000]] == [(15 * i, 15 * i + 14) for i in range(100_000)] and not found[-1].live
    big = docs(spark, [rows[-1]])
    text = big.join(secrets.scan_secrets(big), "doc_id").select(secrets.redacted(F.col("text"), F.col("found")).alias("t")).first().t
    assert text == "[secret] " * 100_000 + "[secret]"  # alone, the last one has one owner


def test_decontamination(spark):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    items = [(1, prose(1, 30)), (2, "short item É"), (3, None), (4, "..."), (10, prose(1, 30)), (11, "the " * 12)]
    rows = [(1, f"pre {prose(1, 30).upper()} post", "a"), (2, "A SHORT, item É! short item é short item É", "a"), (3, None, "a"), (4, "", "b"), (5, "the " * 40, "a"), (5, "the " * 40, "a"), (6, prose(9, 500), "a"), (None, prose(1, 12), "a")]
    near = prose(1, 30).split()
    near[15] = "other"
    rows.append((7, " ".join(near), "a"))
    found = decontam.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    want = Counter()
    for i, t, _ in rows:
        w, hit, ids = word(t), set(), set()
        for k, x in items:
            v = word(x)
            wins = {tuple(v[a : a + 10]) for a in range(max(1, len(v) - 9))} if v else set()
            for win in wins:
                for a in range(len(w) - len(win) + 1):
                    if tuple(w[a : a + len(win)]) == win:
                        hit |= set(range(a, a + len(win)))
                        ids.add(str(k))
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(tuple(r)[:6] for r in decontam.digest(found).collect()) == want
    assert {r.doc_id: r.n_near for r in found.collect()}[7] > 0
    assert decontam.decontaminate(docs(spark, rows), spark.createDataFrame([], "item_id long, text string")).where("n_hit > 0").count() == 0
    assert decontam.decontaminate(docs(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_proximity_matches_are_those_of_brute_force(spark, monkeypatch, few):
    if not few:  # terms, anchors and windows beyond what is broadcast
        monkeypatch.setattr(decontam, "TERMS", 0)
        monkeypatch.setattr(decontam, "small", lambda df, *_: df)
    base = prose(1, 12).split()
    items = [(1, " ".join(base)), (2, " ".join(base[:9])), (3, " ".join([*base[:5], "unseen", *base[6:]]))]  # a word that no text has, and an item of nine words
    rows = [(a * 12 + b, " ".join("x" if i in (a, b) else t for i, t in enumerate(base)), "a") for a in range(12) for b in range(a, 12)] + [(999, " ".join(base), "a")]
    found = decontam.decontaminate(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    wins = {tuple(v[a : a + 10]) for _, x in items for v in [x.split()] for a in range(max(1, len(v) - 9))}
    want = {}
    for i, t, _ in rows:
        w = t.split()
        same = [(sum(p == q for p, q in zip(w[a:], win)), len(win)) for win in wins for a in range(len(w) - len(win) + 1)]
        want[i] = sum(8 <= n < k for n, k in same)
    assert {r.doc_id: r.n_near for r in found.collect()} == want and sum(want.values()) > 100


def reshared(sizes):
    """source -> size; the targets by sharing again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        t = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        more = {s for s in free if t[s] > 3 * sizes[s] + 1e-9}
        if not more:
            return t | {s: 3 * sizes[s] for s in stopped}
        stopped |= more


def test_mixing(spark, rows):
    got = mixing.mixed(docs(spark, rows)).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    per = Counter()
    for _, t, s in rows:
        per[s] += size(t)
    want = reshared(dict(per))
    assert Counter((r.doc_id, r.size, r.source_size) for r in got) == Counter((i, size(t), per[s]) for i, t, s in rows)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    of = {}
    for r in got:
        of.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    assert sorted(of) == sorted((per[s], round(t, 6)) for s, t in want.items())
    assert all(sum(x) == int(t + 1e-7) for (_, t), x in of.items())
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mixed(docs(spark, rows[::-1])).collect()), key=str)
    assert mixing.mixed(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [(1, None, None)])).first().taken == 0


def test_targets_against_sharing_again(spark):
    r = random.Random(2)
    for k in range(6):
        sizes = {f"s{i}" if i else None: int(10 ** r.uniform(0, 4)) for i in range(r.randrange(1, 12))}
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()
        want = reshared(sizes)
        assert {x.source: round(x.target, 4) for x in got} == {s: round(t, 4) for s, t in want.items()}


def test_many_sources_get_their_targets(spark):
    r = random.Random(3)
    rows = [(i, "x " * r.randrange(40), f"d{r.randrange(700)}.org") for i in range(3000)]
    per = Counter()
    for _, t, s in rows:
        per[s] += len(t.split())
    got = mixing.mixed(docs(spark, rows)).collect()
    want, names, taken = reshared(dict(per)), {i: s for i, _, s in rows}, Counter()
    assert all(abs(x.target - want[names[x.doc_id]]) < 1e-4 for x in got)
    for x in got:
        taken[names[x.doc_id]] += x.taken
    assert all(taken[s] == int(want[s] + 1e-7) for s in per)


def test_schedule_is_evenly_spread(spark, rows):
    _, _, slots = mixing.mix(docs(spark, rows), block=8)
    s = sorted((r.slot, r.sid, r["rank"], r.block_no, r.cut) for r in slots.collect())
    assert [x[0] for x in s] == list(range(len(s)))
    by = Counter(x[1] for x in s)
    for sid, n in by.items():
        mine = [x for x in s if x[1] == sid]
        assert [x[2] for x in mine] == list(range(n))
        assert all(abs((k + 1) - n * (x[0] + 1) / len(s)) <= 6 for k, x in enumerate(mine))


def test_golden_step_visits_all():
    for n in (1, 2, 3, 10, 97, 1024):
        a = mixing.golden_step(n)
        assert sorted(i * a % n for i in range(n)) == list(range(n))


@pytest.mark.parametrize("block", [64, tokens.BLOCK])
def test_token_counts_round_trip(spark, rows, block):
    files, order, eod = tokens.write_token_files(docs(spark, rows))
    enc, _ = tokens._encoding(tokens.VOCABULARY)
    want = Counter((i, len(enc.encode_ordinary(t or ""))) for i, t, _ in rows)
    found = tokens.separator_scan(files, eod, tokens.width_of(eod), block).join(order, ["shard", "ordinal"])
    assert Counter((r.doc_id, r.n_tokens) for r in found.collect()) == want
    if block > 64:
        assert Counter(tuple(r) for r in tokens.token_counts(docs(spark, rows)).collect()) == want
        assert tokens.token_counts(docs(spark, [])).count() == 0


def test_pieces_keep_the_tokens(monkeypatch):
    enc, _ = tokens._encoding(tokens.VOCABULARY)
    monkeypatch.setattr(tokens, "PIECE", 100)
    for t in (prose(1, 500), "abc " * 300 + "   x  y 12 3 it's  don't", "a" * 1000, "mot été " * 200, "x" * 450 + " " + "word here " * 100 + "y" * 300):
        assert [x for p in tokens.pieces(t) for x in enc.encode_ordinary(p)] == enc.encode_ordinary(t)
    assert max(map(len, tokens.pieces("x" * 450 + " word" * 500))) < 600  # a stretch without a cut doesn't swallow the rest


@pytest.mark.parametrize("width", [2, 4])
def test_separator_scan_of_flat_files(spark, tmp_path, monkeypatch, width):
    r = np.random.default_rng(1)
    want = Counter()
    for k in range(3):
        sizes = r.integers(0, 30, 40).tolist()
        ids = [x for n in sizes for x in [*r.integers(0, 50, n).tolist(), 99]] + ([7, 7] if k == 1 else [])
        np.array(ids, f"<u{width}").tofile(tmp_path / f"{k}.bin")
        want.update((f"{k}.bin", i, n) for i, n in enumerate(sizes + ([2] if k == 1 else [])))
    (tmp_path / "empty.bin").write_bytes(b"")
    for block, chunk in ((1, 8), (7, 4), (7, 1024), (4096, 1024)):
        monkeypatch.setattr(tokens, "CHUNK", chunk)
        got = tokens.separator_scan(tokens.token_files(spark, str(tmp_path)), 99, width, block).collect()
        assert Counter((x.shard.rsplit("/", 1)[1], x.ordinal, x.n_tokens) for x in got) == want


def test_a_file_beyond_two_gigabytes_is_read_in_ranges(spark, tmp_path):
    n = (1 << 31) + 6  # bytes, most of them a hole in the file
    with open(tmp_path / "big.bin", "wb") as f:
        f.truncate(n)
        for at in (100, (1 << 30) + 8, n - 4):
            f.seek(at)
            f.write(np.array([99], "<u2").tobytes())
    got = tokens.separator_scan(tokens.token_files(spark, str(tmp_path)), 99, 2, 1 << 26).collect()
    assert sorted((x.ordinal, x.n_tokens) for x in got) == [(0, 50), (1, (1 << 29) + 4 - 51), (2, (n - 4) // 2 - (1 << 29) - 5), (3, 1)]


def occurrences(text, template, least):
    """Start, end and template ends of the longest common runs of a text and a template, by trying all."""
    found = {}
    for a in range(len(text)):
        for t in range(len(template)):
            n = 0
            while a + n < len(text) and t + n < len(template) and text[a + n] == template[t + n]:
                n += 1
            if n >= least:
                found.setdefault((a, a + n), set()).add(t + n)
    out = {}
    for (a, b), _ in found.items():
        if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in found):
            out[a, b] = sorted(t for t in range(b - a, len(template) + 1) if template[t - (b - a) : t] == text[a:b])
    return sorted((a, b, e) for (a, b), e in out.items())


def best_chain(found, gap):
    """The most template words that a chain covers, by trying all chains."""
    parts = [(a, e - (b - a), b - a) for a, b, ends in found for e in ends]

    @functools.cache
    def after(last):
        best = 0
        for p in parts:
            if last[0] < p[0] and last[1] < p[1] and p[0] - (last[0] + last[2]) <= gap:
                gain = p[2] - max(0, last[0] + last[2] - p[0], last[1] + last[2] - p[1])
                if gain > 0:
                    best = max(best, gain + after(p))
        return best

    return max((p[2] + after(p) for p in parts), default=0)


def test_matches_and_chains_against_trying_all():
    r = random.Random(3)
    for k in range(80):
        kinds = 3 if k % 2 else 6
        templates = [[r.randrange(kinds) for _ in range(r.randrange(1, 12))] for _ in range(4)]
        text = [x for _ in range(4) for t in [r.choice(templates)] for a in [r.randrange(len(t))] for x in [*t[a : a + r.randrange(1, 8)], *[9] * r.randrange(3)]]
        got = licenses.Automaton(list(enumerate(templates)), 2).matches(text, 2)
        for o, t in enumerate(templates):
            want = occurrences(text, t, 2)
            assert sorted((a, b, sorted(e)) for a, b, e in got.get(o, [])) == want
            for gap in (0, 2):
                found = licenses.chains(got.get(o, []), gap)
                assert max((c for c, _, _ in found), default=0) == best_chain(want, gap)


def test_repeats_and_shuffled_passages_are_no_licence():
    scan = licenses.LicenseScanner().scan
    of = dict(licenses.TEMPLATES[:2])
    for text in ("permission is hereby granted " * 20, "permission is hereby granted " * 30_000):
        assert scan(text)["spans"] == []
    words = of["apache"].split()
    chunks = [words[i : i + 4] for i in range(0, len(words), 4)]
    random.Random(1).shuffle(chunks)
    assert scan(" ".join(x for c in chunks for x in c))["spans"] == []
    both = scan(f"a b {of['mit']} and then {of['apache'].replace('governing', 'x')} and {of['mit']}")["spans"]
    assert [(x[2], x[3] > 0.9) for x in both] == [("mit", True), ("apache", True), ("mit", True)]
    assert all(a[1] <= b[0] for a, b in zip(both, both[1:]))
    for label, x in licenses.TEMPLATES:
        spans = scan(f"before {x} behind")["spans"]
        assert [(y[2], y[3]) for y in spans] == [(label, 1.0)], label


def test_licenses(spark):
    mit = licenses.TEMPLATES[0][1]
    texts = ["Licensed under CC BY-NC 4.0.", "The MIT License, the mit\nlicense", "GNU General Public License. Apache License", None, "", "no licence here", "x " * 40_000 + mit.upper(), "cc", "cc by cc by", mit.replace("charge", "cost")]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "cc by", "a"), (0, texts[0], "a")]
    got = licenses.digest(licenses.scan_licenses(docs(spark, rows))).collect()
    want = Counter()
    for i, t, _ in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
        at = [(k, lab) for p, lab in licenses.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None), ",".join(sorted({b for _, b in at})))] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    of = {r.doc_id: r for r in got}
    assert of[0].labels == "cc-by,cc-by-nc" and of[6].labels == "mit" and of[9].labels == "mit" and 0.9 < of[9].score < 1 and of[5].score == 0
    assert all(0 <= r.score <= 1 for r in got) and licenses.digest(licenses.scan_licenses(docs(spark, []))).count() == 0


def labelled(n=300):
    r = random.Random(7)
    texts, y = [], []
    for i in range(n):
        w = [f"q{r.randrange(300)}abc" for _ in range(80)]
        y.append(int(i % 4 == 0))
        if y[-1]:
            for k in range(4):
                w[10 * k] = r.choice(["stinker", "boggart", "rotter"])
        texts.append(" ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], x) for x in w))
    return texts, y


def plain_score(index, examples, text):
    """The score by comparing with all examples, one by one."""
    grams = lambda x: Counter([x[i : i + len(g)] for g in index.marked for i in range(len(x) - len(g) + 1) if x[i : i + len(g)] == g])

    def vector(text):
        x = toxicity.plain(text)
        counts = {**{("g", g): n for g, n in grams(x).items()}, **{("w", w): n for w, n in Counter(x.split()).items() if w in index.words}}
        weights = {t: (1 + np.log(n)) * index.idf[index.marked.index(t[1]) if t[0] == "g" else index.words[t[1]]] for t, n in counts.items()}
        norm = np.sqrt(sum(v * v for v in weights.values())) or 1.0
        return {t: v / norm for t, v in weights.items()}

    q = vector(text)
    all_ = [(i, sum(v * e.get(t, 0.0) for t, v in q.items())) for i, e in enumerate(map(vector, examples))]
    best = sorted((x for x in all_ if x[1] > 0), key=lambda x: (-round(x[1], 12), x[0]))[: index.k]
    if not best:
        return index.share, []
    w = np.array([1 / (0.02 + 1 - min(c, 1)) for _, c in best])
    w, y = w / w.max(), index.y[[i for i, _ in best]]
    odds = np.log(((w * y).sum() + 0.5) / ((w * (1 - y)).sum() + 0.5))
    return 1 / (1 + np.exp(-(index.a * odds + index.b))), [int(index.ids[i]) for i, _ in best[:5]]


def test_toxicity_is_exact_and_right(spark):
    texts, y = labelled()
    index = toxicity.ToxicityIndex(texts[:200], y[:200], list(range(200)), (1.0, 1.0), k=7)
    examples = [texts[p] for p in index.ids.tolist()]
    for x in [*texts[200:230], "", "1 2 !", "stinker stinker rotter", "zzz unknown", prose(5, 400)]:
        want = plain_score(index, examples, x)
        got = index.score([x])[0]
        assert np.isclose(want[0], got[0], atol=1e-9) and want[1] == got[1]
    lists = {tuple(index.score([x])[0][1]) for x, v in zip(texts[200:], y[200:], strict=True) if not v}
    assert len(lists) > 0.9 * sum(not v for v in y[200:])  # clean texts have neighbours of their own
    right = np.mean([(s[0] >= 0.5) == v for s, v in zip(index.score(texts[200:]), y[200:], strict=True)])
    assert right > 0.97
    long = " ".join(texts[:40]) * 20
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "", "a"), (None, texts[0], "a"), (0, texts[0], "a"), (902, long, "a")]
    labels = spark.createDataFrame([(i, 1, v) for i, v in enumerate(y)] + [(0, 1, y[0]), (None, 1, 1), (900, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = toxicity.score_toxicity(d, toxicity.fit_toxicity(d, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(i).encode()) % 5 for r in got for i in r.neighbours)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1
    empty = toxicity.fit_toxicity(d, labels.where("false"))
    assert {r.score for r in toxicity.score_toxicity(d, empty).collect()} == {0.0}
    assert toxicity.score_toxicity(docs(spark, []), index).count() == 0


def test_forward_backward_against_enumeration():
    r = np.random.default_rng(2)
    sizes = np.array([5, 4, 1])
    score, move = r.normal(size=(10, 2)), r.normal(size=(2, 2))
    states, moves, total = quality_crf.forward_backward(score, sizes, move)
    at = inner = 0
    for n, log_z in zip(sizes.tolist(), total, strict=True):
        z, marg, pair = 0.0, np.zeros((n, 2)), np.zeros((max(0, n - 1), 2, 2))
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            p = np.exp(sum(score[at + k, y[k]] for k in range(n)) + sum(move[y[k], y[k + 1]] for k in range(n - 1)))
            z += p
            for k in range(n):
                marg[k, y[k]] += p
            for k in range(n - 1):
                pair[k, y[k], y[k + 1]] += p
        assert np.isclose(np.log(z), log_z) and np.allclose(states[at : at + n], marg / z)
        assert np.allclose(moves[inner : inner + n - 1], pair / z)
        at, inner = at + n, inner + n - 1


def test_quality_field(spark):
    good = [f"{prose(k, 40)}.\n{prose(k + 1000, 30)}." for k in range(120)]
    bad = ["\n".join(f"{w}$$$ {w} | {w} |" for w in prose(k, 12).split()) for k in range(120)]
    texts, y = good + bad, [1] * 120 + [0] * 120
    field = quality_crf.LineField(texts[::2], y[::2], (1.0, 1.0), steps=40)
    assert np.mean([(s >= 0.5) == v for s, v in zip(field.score(texts[1::2]), y[1::2], strict=True)]) > 0.97
    lines, marginals = field.lines([good[1] + "\n" + bad[1]])[0]
    assert len(lines) == len(marginals) and marginals[0] > marginals[-1]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(900, None, "a"), (901, "", "a"), (902, "\n\n", "a"), (None, good[0], "a"), (0, good[0], "a"), (903, "x\n" * 5000, "b")]
    labels = spark.createDataFrame([(i, v, 0) for i, v in enumerate(y)] + [(None, 1, 1), (901, None, None)], "doc_id long, quality int, toxic int")
    d = docs(spark, rows)
    got = quality_crf.score_quality(d, quality_crf.fit_quality(d, labels)).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_crf.score_quality(d, quality_crf.fit_quality(d, labels.where("false"))).collect()} == {0.5}
    assert quality_crf.score_quality(docs(spark, []), field).count() == 0


def test_long_chains_and_mixed_documents(monkeypatch):
    r = np.random.default_rng(5)
    score, move = r.normal(size=(500, 2)) * 5, r.normal(size=(2, 2))
    assert np.allclose(quality_crf.long_chain(score, move), quality_crf.forward_backward(score, np.array([500]), move)[0][:, 1])
    good = [f"{prose(k, 40)}.\n{prose(k + 1000, 30)}." for k in range(60)]
    bad = ["\n".join(f"{w}$$$ {w} | {w} |" for w in prose(k, 12).split()) for k in range(60)]
    field = quality_crf.LineField(good[:40] + bad[:40], [1] * 40 + [0] * 40, (1.0, 1.0), steps=60)
    assert np.isfinite(field.move).all() and field.move[0, 0] + field.move[1, 1] > field.move[0, 1] + field.move[1, 0]
    for g, b in zip(good[40:], bad[40:], strict=True):  # both parts of a mixed document are labelled right
        lines, p = field.lines([f"{g}\n{b}\n{g}"])[0]
        assert ((p >= 0.5) == [1, 1, *[0] * 12, 1, 1]).mean() > 0.9
    texts = [*good[40:], "\n".join(bad[40:]), None, "", good[0]]
    whole = field.score(texts)
    monkeypatch.setattr(quality_crf, "LONG", 3)
    monkeypatch.setattr(quality_crf, "LINES", 10)
    assert np.allclose(field.score(texts), whole)
    few = quality_crf.LineField(["x\n" * 100, "y", "z"], [0, 1, 1], (1.0, 1.0), steps=2, fit_lines=20)
    assert few.only == 1.0  # the only text of the other class has too many lines


def ppm_bits(data, texts, order):
    """Code length by walking the contexts from the longest one down."""
    ctx = {}
    for x in texts:
        x = b"\0" * order + x
        for i in range(order, len(x)):
            for n in range(order + 1):
                ctx.setdefault((n, x[i - n : i]), Counter())[x[i]] += 1
    bits, data = 0.0, b"\0" * order + data
    for i in range(order, len(data)):
        for n in range(order, -1, -1):
            c = ctx.get((n, data[i - n : i]))
            if not c:
                continue
            total = sum(c.values()) + len(c)
            if data[i] in c:
                bits -= np.log2(c[data[i]] / total)
                break
            bits -= np.log2(len(c) / total)
        else:
            bits += 8
    return bits


def test_ppm_code_lengths_against_walking(monkeypatch):
    texts = {"aa": ["abracadabra abra", "cada bra", "aé"], "bb": ["banana bandana", "ananas zz"]}
    for order in (0, 3, 4):
        model = langid.PpmModel(texts, order=order)
        xs = ["abra banana" * 200, "zzzz q!?", "a", "ana bra é"]
        for cells in (1, 1 << 22):
            monkeypatch.setattr(langid, "CELLS", cells)
            for x, row in zip(xs, model.code_lengths(xs), strict=True):
                assert row[-1] == len(x.encode())
                want = [ppm_bits(x.encode(), [t.encode() for t in texts[k]], order) for k in ("aa", "bb")]
                assert np.allclose(row[:-1], want, rtol=1e-4)


def test_many_languages_take_memory_by_their_texts():
    import pickle

    r = random.Random(4)
    make = lambda k: " ".join("".join(chr(0x100 + 11 * k + r.randrange(11)) for _ in range(5)) for _ in range(80))
    model = langid.PpmModel({f"l{k}": [make(k)] for k in range(200)})
    assert len(pickle.dumps(model)) < 200 * 100_000  # a table of all contexts, bytes and languages would have 2 * 10^9 cells
    assert [model.predict([make(k)])[0][0] for k in (0, 77, 199)] == ["l0", "l77", "l199"]


def test_fractions_and_superscripts_are_no_letters():
    model = langid.PpmModel({"aa": ["abc ½ ²"]})
    assert [x for x, _ in model.predict(["½ ²", "", None, "12 ³", "ª", "é", "中", "abc"])] == ["und"] * 4 + ["aa"] * 4


def test_langid(spark):
    r = random.Random(1)
    make = lambda letters: " ".join("".join(r.choice(letters) for _ in range(r.randrange(2, 8))) for _ in range(60))
    rows = [(i, make("abcde" if i % 2 else "defgh"), "x", "aa" if i % 2 else "bb") for i in range(120)]
    rows += [(500, None, "x", "aa"), (501, "12 34 !", "x", None), (502, "", "x", "bb"), (None, make("abcde"), "x", "aa"), (1, rows[1][1], "x", "aa")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify_language(d, langid.fit_langid(d)).collect()
    assert len(got) == len(rows)
    of = {r.doc_id: r for r in got}
    assert [of[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3 and of[None].lang_pred == "aa"
    assert np.mean([of[i].lang_pred == ("aa" if i % 2 else "bb") for i in range(120)]) > 0.98
    none = langid.fit_langid(d.where("lang = 'zz'"))
    assert {r.lang_pred for r in langid.identify_language(d, none).collect()} == {"und"}
    assert langid.identify_language(d.where("false"), none).count() == 0


#: Columns that documents may have as well: names that the stages use themselves.
CLASHES = "score terms neighbours found __found __text __copy component_id fp count n_hit items rid size c0 a.b row first".split()


def plain_secrets(rows):
    """Each row's live spans, in order: all kinds by regular expressions, ownership by counting."""
    spans = []
    for _, t, _ in rows:
        mine = []
        for rank, k in enumerate(secrets.KINDS):
            for m in re.finditer(k.pattern.replace("(?i:(password|passwd|secret|token|api_?key))", "((?i:password|passwd|secret|token|api_?key))"), t or ""):
                v = m[k.value] if k.value else m[0]
                if len(v) >= k.least and (not k.like or all(re.search(p, v) for p in (k.like, *secrets._MIXED_ALSO))):
                    mine.append((m.start(), rank, m.end(), v))
        spans.append(sorted(mine))
    copied = set()
    for v in {x[3] for s in spans for x in s}:
        held = [rows[i][2] for i, s in enumerate(spans) if any(x[3] == v for x in s)]
        if len(set(held)) > secrets.MAX_OWNERS and len(held) > secrets.MAX_REPOSITORIES:
            copied.add(v)
    return [[(a, b) for a, rank, b, v in s if rank < 3 or v not in copied] for s in spans]


def plain_redaction(text, spans):
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:] if spans else text


def plain_window_hit(text, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    w = f" {' '.join(word(text))} "
    return any(f" {' '.join(v[a : a + 10])} " in w for x in items for v in [word(x)] if v for a in range(max(1, len(v) - 9)))


def write_tables(spark, at, rows, labels, bench):
    made = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    made.selectExpr("*", *[f"n_chars + 1 AS `{c}`" for c in CLASHES]).coalesce(2).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version, on rows with null and repeated ids whose texts differ."""
    import corpus_pipeline as p

    texts, y = labelled(200)
    bench = [prose(777, 40), "a short item", None]
    near = prose(3, 400).split()
    key, wide = "0123456789abcdef0123456789", "ghp_" + "kQ2wE4rT6y" * 4
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(1000 + i, prose(i, 120), f"s{i % 3}") for i in range(30)]
    rows += [(2000, prose(0, 120), "s9"), (1000, prose(0, 120), "s0"), (1001, prose(0, 120), "s0"), (1001, prose(4001, 90), "s1"), (None, prose(0, 120), None), (None, prose(8000, 50), None)]
    rows += [(2100 + k, " ".join(near[:k] + ["other"] + near[k + 1 :]), "s2") for k in range(5)]
    rows += [(2001, f"{prose(5000, 40)} {bench[0].upper()}", "s1"), (2001, prose(5001, 60), "s1"), (None, f"{prose(5002, 40)} {bench[0]}", None), (3000, "with a short, item in it " + prose(5003, 30), "s1")]
    rows += [(7, "password=hunter2222 tail " + prose(6001, 30), "s1"), (7, f"{prose(6002, 30)} before it secret: abcdefgh", "s1"), (None, f"password=nullsecret1 {prose(6003, 30)}", None)]
    rows += [(2002, prose(6000, 50) + f' token = "{key}"', "s1"), (2003, None, "s1"), (2004, "", "s1"), (2005, prose(9, 50_000), "s1")]
    rows += [(4000 + k, f"{prose(7000 + k, 30)} {wide}", f"s{k % 5}") for k in range(10)]
    write_tables(spark, tmp_path, rows, [(i, 1, v) for i, v in enumerate(y)], bench)
    d, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "mixing"]
    columns, whole = d.columns, lambda df: [(r.doc_id, r.text, r.source) for r in df.collect()]
    for name, f in p.STAGES:
        given = whole(d)
        out = f(spark, d, str(tmp_path))
        if name == "mixing":
            got = out.collect()
            size = lambda t: len((t or "").split())
            per = Counter()
            for _, t, s in given:
                per[s] += size(t)
            want = reshared(dict(per))
            assert Counter((r.doc_id, r.size, r.source_size, round(r.target, 4)) for r in got) == Counter((i, size(t), per[s], round(want[s], 4)) for i, t, s in given)
            assert all(r.taken <= 3 * r.size for r in got) and abs(sum(r.taken for r in got) - sum(want.values())) <= len(want)
            continue
        out.write.parquet(f"{tmp_path}/{name}")
        d = spark.read.parquet(f"{tmp_path}/{name}")
        got, want = whole(d), given
        if name == "toxicity":
            index = toxicity.fit_toxicity(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
            by = dict(zip(range(200), texts, strict=True))
            want = [x for x in given if plain_score(index, [by[i] for i in index.ids.tolist()], x[1] or "")[0] < 0.5]
            assert sum(y) - 3 <= len(given) - len(want) <= sum(y) + 3
        if name == "near_duplicates":
            fps, left = [fingerprint(t) for _, t, _ in given], [*range(len(given))]
            for i in range(len(given)):
                for j in range(i):
                    if (fps[i] ^ fps[j]).bit_count() <= 3 and left[i] != left[j]:
                        left = [left[j] if c == left[i] else c for c in left]
            groups = {}
            for c, x in zip(left, given, strict=True):
                groups.setdefault(c, []).append(x)
            want = [min(g, key=lambda x: (x[0] is None, x[0] or 0, x[1] or "", x[2] or "")) for g in groups.values()]
            assert len(want) < len(given) - 5
        if name == "decontamination":
            want = [x for x in given if not plain_window_hit(x[1], bench)]
            assert len(want) == len(given) - 3
        if name == "secrets":
            want = [(i, t if t is None else plain_redaction(t, s), o) for (i, t, o), s in zip(given, plain_secrets(given), strict=True)]
            assert sum(a != b for a, b in zip(given, want, strict=True)) == 4 and all(key not in (t or "") and "nullsecret1" not in (t or "") for _, t, _ in want)
            assert [(r.doc_id, r.text[:40], r.n_chars, len(r.text)) for r in d.collect() if r.text is not None and r.n_chars != len(r.text)] == []
        if name == "near_duplicates":  # null and empty texts, and rows alike in id and text, differ in nothing that counts
            assert Counter((i, t or "") for i, t, _ in got) == Counter((i, t or "") for i, t, _ in want)
        else:
            assert Counter(got) == Counter(want)
        assert d.columns == columns
    extra = {(r.doc_id, r.n_chars) for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    first = spark.read.parquet(f"{tmp_path}/decontamination")
    assert all(r[c] == (None if r.n_chars is None else r.n_chars + 1) for r in first.collect() for c in CLASHES) and extra
    assert p.run(spark, str(tmp_path)).count() == len(given)


def test_the_three_rows_that_share_ids(spark, tmp_path):
    import corpus_pipeline as p

    a, b = prose(1, 60), prose(2, 60)
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s")]
    d = spark.createDataFrame([(*r, len(r[1])) for r in rows], "doc_id long, text string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, d, "").collect()) == [(3, a), (5, b)]
    both = d.unionByName(d)  # no table of files
    assert sorted((r.doc_id, r.text) for r in p.drop_near_duplicates(spark, both, "").collect()) == [(3, a), (5, b)]
    rows = [(7, "password=hunter2222 tail"), (7, "it stands before it secret: abcdefgh"), (None, "password=nullsecret1")]
    d = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    assert sorted(r.text for r in p.redact_secrets(spark, d, "").collect()) == ["[secret]", "[secret] tail", "it stands before it [secret]"]


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    write_tables(spark, tmp_path, [], [], [])
    assert p.run(spark, str(tmp_path)).count() == 0
    for name, f in p.STAGES[:-1]:
        d = spark.read.parquet(f"{tmp_path}/documents.parquet")
        out = f(spark, d, str(tmp_path))
        assert out.columns == d.columns and out.count() == 0, name


def test_rows_of_files_are_known_however_they_are_read(spark, tmp_path):
    from trailmark.llm.common import row_ids

    spark.range(5000).withColumn("text", F.lit("x" * 50)).repartition(3).write.option("maxRecordsPerFile", 700).parquet(f"{tmp_path}/t")
    read = lambda: {(r.id, r.k) for r in row_ids(spark.read.parquet(f"{tmp_path}/t"), "k").select("id", "k").collect()}
    first = read()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        assert read() == first and len({k for _, k in first}) == 5000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    df = spark.read.parquet(f"{tmp_path}/t")
    assert len({r.k for r in row_ids(df.union(df), "k").collect()}) == 10_000


def test_stop_words_say_nothing_of_other_languages(spark):
    russian = " ".join(["собака бежит через большое поле вечером"] * 3 + [f"слово{k} рядом" for k in range(60)])
    rows = [(1, russian, "a"), (2, " ".join(f"kljdf{k} qwrt" for k in range(60)), "a"), (3, " ".join(f"rumah{k} yang besar" for k in range(40)), "a")]
    of = {r.doc_id: r for r in quality_rules.quality_rules(docs(spark, rows)).collect()}
    assert of[1].kept and "few_stop_words" in of[2].failed and of[3].kept
