"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index."""

from __future__ import annotations

import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fitting_table

#: Labelled rows of each class that the index may hold, about; neighbours that vote.
EXAMPLES, K = 1500, 15
#: What a word weighs besides a sequence that marks toxic text, which weighs 1. With equal weights a long text's few marked
#: words drown among its others (README).
FLOOR = 0.1
#: Chi-square from which a sequence is marked.
CHI = 30
BLOCK = 64
#: A term in more than one of so many examples has its weights as a row of all examples: shorter than a list of places and weights.
DENSE = 8
#: Texts that are searched at a time.
GROUP = 32
#: Rows that a task returns at a time.
SLICE = 1024
_GAP = re.compile(r"[\W\d_]+")
_LENGTHS = (5, 6, 7)


#: The sequence that every word begins and ends with: it stands for a text's length, so that the share of marked sequences
#: matters, not only which they are. Its frequency is that of all texts, its weight that of a marked sequence.
WORD = " "


def plain(text: str) -> str:
    """Lower-cased words of letters, each between single spaces."""
    return f" {_GAP.sub(' ', text.lower()).strip()} "


def _grams(word: str, frequent: set[str] | None = None) -> list[str]:
    """Distinct character sequences of a word with its spaces: the shortest ones, or with `frequent` those of all lengths and
    the word itself whose ends are among these."""
    w, k = f" {word} ", _LENGTHS[0]
    if frequent is None:
        return [*{w[i : i + k] for i in range(max(1, len(w) - k + 1))}]
    at = [w[i : i + k] in frequent for i in range(max(1, len(w) - k + 1))]
    spans = [(i, i + n) for n in _LENGTHS for i in range(len(w) - n + 1) if at[i] and at[i + n - k]]
    return [*{w[i:j] for i, j in spans} | ({w} if at[0] and at[-1] else set())]


def marked_terms(words: list[str], docs: list[np.ndarray], toxic: np.ndarray) -> list[str]:
    """Sequences whose presence tells the classes apart (chi-square of at least CHI), without near copies of each other.

    docs: each text's words by their places in `words`. A term that few toxic texts have can't reach the bound, and its
    shortest parts are at least as frequent: only words whose parts are frequent enough are taken apart, so memory follows
    the frequent terms, not all.
    """
    all_ = np.concatenate([*docs, np.zeros(0, np.int32)])
    by = np.argsort(all_, kind="stable")
    holder, at = np.repeat(np.arange(len(docs), dtype=np.int32), [len(d) for d in docs])[by], np.searchsorted(all_[by], np.arange(len(words) + 1))
    n = np.array([max(1, (toxic == 0).sum()), max(1, (toxic == 1).sum())], float)
    least = max(3, int(np.ceil(CHI * n[1] * n.sum() / (n.sum() * n[0] + CHI * n[1]))))
    ill = [d.tolist() for d, y in zip(docs, toxic.tolist(), strict=True) if y == 1]
    short: Counter = Counter()
    for d in ill:
        short.update({g for w in d for g in _grams(words[w])})
    frequent = {g for g, c in short.items() if c >= least}
    del short
    of = {i: gs for i, w in enumerate(words) if (gs := _grams(w, frequent))}
    few: Counter = Counter()
    for d in ill:
        few.update({g for w in d for g in of.get(w, ())})
    inside: dict[str, list[int]] = {g: [] for g, c in few.items() if c >= least}
    for w, s in of.items():
        for g in s:
            if g in inside:
                inside[g].append(w)
    has = {}
    for g, ws in inside.items():
        row = np.zeros(len(docs), bool)
        for w in ws:
            row[holder[at[w] : at[w + 1]]] = True
        a, b = float((row & (toxic == 1)).sum()), float((row & (toxic == 0)).sum())
        chi = n.sum() * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / (n[0] * n[1] * max(1e-9, (a + b) * (n.sum() - a - b)))
        pure = a / n[1] - 4 * b / n[0]  # of terms alike in chi-square, those that clean texts don't have
        if chi >= CHI and pure > 0:
            has[g] = (-pure, row)
    kept: list[str] = []
    rows = np.zeros((0, len(docs)), np.float32)
    for g, (_, row) in sorted(has.items(), key=lambda x: (x[1][0], x[0])):
        both = rows @ row.astype(np.float32)
        if not len(kept) or (both < 0.9 * (rows.sum(axis=1) + row.sum() - both)).all():
            kept.append(g)
            rows = np.concatenate([rows, row[None].astype(np.float32)])
    return kept


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0] .. start[0] + count[0] - 1, start[1] .., one after another."""
    return np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())


class ToxicityIndex:
    """Labelled examples as unit TF-IDF vectors in an inverted index whose postings are cut into blocks of examples.

    The terms are all words of the examples, and the sequences that mark toxic text. Their inverse document frequencies know
    no labels; marked sequences weigh more. Each term has, for every block that it stands in, a cell with its greatest
    weight there: the cells bound the cosine of all examples of a block. Blocks are read in the order of their bounds, more
    at a time from step to step, until none can hold one of the k nearest: the result is that of comparing with all.
    """

    def __init__(self, texts: list[str], toxic: list[int], ids: list[int], rates: tuple[float, float], k: int = K, floor: float = FLOOR):
        self.k, self.rates = k, rates
        y = np.array(toxic, np.int64)
        known: dict[str, int] = {}
        docs = [np.array(sorted({known.setdefault(w, len(known)) for w in plain(x).split()}), np.int32) for x in texts]
        self.marked = [*marked_terms([*known], docs, y), WORD]
        del docs
        self.words = {w: len(self.marked) + i for i, w in enumerate(sorted(known))}
        v = len(self.marked) + len(self.words)
        self._machine()
        counts = [(np.fromiter(c, np.int32, len(c)), np.fromiter(c.values(), np.float32, len(c))) for c in map(self.count, texts)]
        df = np.bincount(np.concatenate([t for t, _ in counts] or [np.zeros(0, np.int32)]), minlength=v)
        self.idf = (np.log((1 + len(texts)) / (1 + df)) + 1) * np.where(np.arange(v) < len(self.marked), 1.0, floor)
        vectors = [self.weighted(*c) for c in counts]
        del counts
        m = len(self.marked)
        order = sorted(range(len(texts)), key=lambda i: (vectors[i][0][vectors[i][0] < m].tolist(), y[i], ids[i]))  # like examples share blocks
        self.ids, self.y = np.array(ids, np.int64)[order], y[order]
        vectors = [vectors[i] for i in order]
        self.blocks = -(-len(order) // BLOCK)
        term = np.concatenate([t for t, _ in vectors] or [np.zeros(0, np.int64)])
        weight = np.concatenate([w for _, w in vectors] or [np.zeros(0)])
        doc = np.repeat(np.arange(len(vectors)), [len(t) for t, _ in vectors])
        n = max(1, len(order))
        often = np.flatnonzero(np.bincount(term, minlength=v) > n / DENSE)
        self.row = np.full(v, -1, np.int64)
        self.row[often] = np.arange(len(often))
        full = self.row[term] >= 0
        self.full = np.zeros((len(often), n))
        self.full[self.row[term[full]], doc[full]] = weight[full]
        self.of = np.arange(n) // BLOCK
        self.full_top = np.maximum.reduceat(self.full, np.arange(0, n, BLOCK), axis=1) if len(often) else np.zeros((0, max(1, self.blocks)))
        term, doc, weight = term[~full], doc[~full], weight[~full]
        by = np.lexsort((doc, term))
        self.doc, self.weight = doc[by], weight[by]
        cell = term[by] * max(1, self.blocks) + self.doc // BLOCK
        cells, at = np.unique(cell, return_index=True)
        self.post_at = np.append(at, len(cell))
        self.block = cells % max(1, self.blocks)
        self.top = np.maximum.reduceat(self.weight, at) if len(at) else np.zeros(0)
        self.cell_at = np.searchsorted(cells // max(1, self.blocks), np.arange(v + 1))
        self._calibrate(vectors)

    def _machine(self) -> None:
        self.machine = ahocorasick.Automaton()
        for i, g in enumerate(self.marked[:-1]):
            self.machine.add_word(g, i)
        if len(self.marked) > 1:
            self.machine.make_automaton()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "machine"} | {"doc": self.doc.astype(np.int32), "block": self.block.astype(np.int32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"doc": state["doc"].astype(np.int64), "block": state["block"].astype(np.int64)}  # as numpy counts them
        self._machine()

    def count(self, text: str) -> dict[int, int]:
        x = plain(text)
        out = dict(Counter([i for _, i in self.machine.iter(x)])) if len(self.marked) > 1 else {}
        out[len(self.marked) - 1] = x.count(WORD)
        found = Counter(x.split())
        out.update({i: n for i, n in zip(map(self.words.get, found), found.values(), strict=True) if i is not None})
        return out

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        return self.weighted(np.fromiter(counts, np.int64, len(counts)), np.fromiter(counts.values(), float, len(counts)))

    def weighted(self, t: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A unit vector: terms in order, and their weights."""
        by = np.argsort(t)
        t, n = t[by].astype(np.int64), n[by].astype(float)
        w = (1 + np.log(n)) * self.idf[t]
        return t, w / max(1e-300, np.sqrt((w * w).sum()))

    def nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector places and cosines of the k nearest examples that share a term; of equal ones those that stand first.
        skip: for each a place that is left out. Vectors are searched GROUP at a time, so that a step costs one pass for all."""
        out = []
        for at in range(0, len(vectors), GROUP):
            out += self._nearest(vectors[at : at + GROUP], skip[at : at + GROUP] if skip else None)
        return out

    def _nearest(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: list[int] | None) -> list[tuple[np.ndarray, np.ndarray]]:
        d, n, blocks = len(vectors), len(self.y), self.blocks
        t, w = np.concatenate([t for t, _ in vectors]), np.concatenate([w for _, w in vectors])
        who = np.repeat(np.arange(d), [len(t) for t, _ in vectors])
        row = self.row[t]
        q = np.zeros((d, len(self.full)))
        q[who[row >= 0], row[row >= 0]] = w[row >= 0]
        bound, base = q @ self.full_top, q @ self.full
        t, w, who = t[row < 0], w[row < 0], who[row < 0]
        size = self.cell_at[t + 1] - self.cell_at[t]
        cell, q, who = _ranges(self.cell_at[t], size), np.repeat(w, size), np.repeat(who, size)
        block = self.block[cell]
        bound = bound + np.bincount(who * blocks + block, q * self.top[cell], minlength=d * blocks).reshape(d, blocks)
        turn = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, turn, axis=1)
        nth = np.empty_like(turn)
        np.put_along_axis(nth, turn, np.arange(blocks)[None, :], axis=1)
        when, of = nth[who, block], nth[:, self.of]
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * d
        last, at, step = np.zeros(d), 0, 16
        while at < blocks and (live := (bound[:, at] >= last - 1e-12) & (bound[:, at] > 0)).any():
            here = np.flatnonzero(live[who] & (when >= at) & (when < at + step))
            first = self.post_at[cell[here]]
            each = self.post_at[cell[here] + 1] - first
            post = _ranges(first, each)
            score = base + np.bincount(np.repeat(who[here] * n, each) + self.doc[post], np.repeat(q[here], each) * self.weight[post], minlength=d * n).reshape(d, n)
            score[(of < at) | (of >= at + step)] = 0
            for i in np.flatnonzero(live).tolist():
                if skip:
                    score[i, skip[i]] = 0
                least = max(0.0, last[i] - 1e-12)
                if n > self.k:  # of equal ones at the end, all
                    least = max(least, np.partition(score[i], n - self.k)[n - self.k] - 1e-11)
                new = np.flatnonzero((score[i] >= least) & (score[i] > 0))
                place, cosine = np.concatenate([best[i][0], new]), np.concatenate([best[i][1], score[i, new]])
                keep = np.lexsort((place, -np.round(cosine, 12)))[: self.k]
                best[i] = place[keep], cosine[keep]
                last[i] = cosine[keep[-1]] if len(keep) == self.k else 0.0
            at, step = at + step, 2 * step
        return best

    def vote(self, place: np.ndarray, cosine: np.ndarray) -> float:
        """Distance-weighted share of toxic neighbours, as a smoothed log-odds."""
        w = 1 / (0.02 + 1 - np.minimum(cosine, 1))
        w = w / w.max() if len(w) else w
        return float(np.log(((w * self.y[place]).sum() + 0.5) / ((w * (1 - self.y[place])).sum() + 0.5)))

    def _calibrate(self, vectors: list) -> None:
        """Logistic calibration on leave-one-out votes; classes weigh as in all labelled rows, not as in the sample."""
        self.a, self.b = 1.0, 0.0
        if len(set(self.y.tolist())) < 2:
            self.only = float(self.y[0]) if len(self.y) else 0.0
            return
        self.only = None
        x = np.array([self.vote(*found) for found in self.nearest(vectors, list(range(len(vectors))))])
        weight = np.where(self.y == 1, 1 / self.rates[1], 1 / self.rates[0])
        weight = weight / weight.sum()
        self.share = float((weight * self.y).sum())
        m, target = np.stack([x, np.ones_like(x)], 1), self.y * 0.998 + 0.001
        at = np.array([1.0, 0.0])
        for _ in range(50):
            p = 1 / (1 + np.exp(-(m @ at)))
            h = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-4 * np.eye(2)
            at = at - np.linalg.solve(h, m.T @ (weight * (p - target)) + 1e-4 * (at - [1, 0]))
        self.a, self.b = max(1e-3, float(at[0])), float(at[1])

    def score(self, texts: list[str]) -> list[tuple[float, list[int], list[str]]]:
        """For each text the probability of label 1, the ids of the nearest examples, and the marked sequences found."""
        if self.only is not None:
            return [(self.only, [], [])] * len(texts)
        out, vectors = [], [self.vector(self.count(x)) for x in texts]
        for (t, _), (place, cosine) in zip(vectors, self.nearest(vectors), strict=True):
            p = 1 / (1 + np.exp(-(self.a * self.vote(place, cosine) + self.b))) if len(place) else self.share
            out.append((float(p), self.ids[place[:5]].tolist(), [self.marked[i].strip() for i in t[t < len(self.marked) - 1].tolist()]))
        return out


class FittedIndex:
    """A ToxicityIndex as bytes, which is made of them where it is first used: the driver passes it on without holding one."""

    def __init__(self, packed: bytes):
        self.packed = packed

    def __reduce__(self) -> tuple:
        return FittedIndex, (self.packed,)

    def __getattr__(self, name: str) -> object:
        if name.startswith("__") or name in ("packed", "index"):
            raise AttributeError(name)
        if "index" not in self.__dict__:
            self.index = pickle.loads(zlib.decompress(self.packed))
        return getattr(self.index, name)


def fit_toxicity(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, folds: int = 5, held: int = 0) -> FittedIndex:
    """Fits the index on a bounded sample (`examples` rows of each class, FIT_BYTES of text) of the labelled rows outside the held-out fold.

    One task reads the saved sample and fits; the driver gets the packed index alone. Where the task is lost, the next one
    fits the same index.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    rows, rates = fitting_table(docs, usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "toxic", examples)

    def packed(rows: list[tuple[int, int, str]]) -> bytes:
        rows = sorted(rows)
        index = ToxicityIndex([t for _, _, t in rows], [y for _, y, _ in rows], [i for i, _, _ in rows], rates)
        return zlib.compress(pickle.dumps(index, pickle.HIGHEST_PROTOCOL), 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(*[c.to_pylist() for c in batch.columns], strict=True)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([packed(rows)], pa.binary())], names=["packed"])

    found = rows.select("doc_id", "toxic", "text").coalesce(1).mapInArrow(run, "packed binary").collect()
    return FittedIndex(bytes(found[0]["packed"]) if found else packed([]))


def score_toxicity(docs: DataFrame, model: ToxicityIndex | FittedIndex, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """`keep`, score, neighbours (ids of up to 5 nearest examples), terms: a row for each row, by whole texts, without a shuffle.

    Texts that share no term with any example, null and empty ones too, get the share of label 1 among the labelled rows;
    without labelled examples of both classes every score is the one class, or 0. Repeated rows score alike; null ids stay;
    columns that aren't in `keep` are ignored; an empty table gives an empty one.
    """
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["score double", "neighbours array<bigint>", "terms array<string>"])

    sent = [*keep] if text_col in keep else [*keep, text_col]  # a text that is kept goes to Python once
    at_text = sent.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                made = [m for i in range(0, part.num_rows, GROUP) for m in model.score([x or "" for x in part.column(at_text).slice(i, GROUP).to_pylist()])]
                arrays = [pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.int64())), pa.array([m[2] for m in made], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(part.columns[: len(keep)] + arrays, names=[*keep, "score", "neighbours", "terms"])

    return docs.select(*[F.col(f"`{c}`") for c in sent]).mapInArrow(run, schema)
