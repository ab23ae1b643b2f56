"""Document quality from a linear-chain conditional random field over lines."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, fitting_rows

#: Labelled rows of each class that the field may be fitted on, about; lines of these rows; steps of its training.
EXAMPLES, FIT_LINES, STEPS = 1200, 60_000, 120
#: Lines that are scored at a time; a text of more than LONG lines is scored alone, its features by blocks of so many lines.
LINES, LONG = 20_000, 2_000
_SYMBOLS = str.maketrans("", "", "#*$%&|<>")
OWN = 14


def lines_of(text: str | None) -> list[str]:
    """Lines with a word; a text without any is one empty line."""
    return [x for x in (text or "").split("\n") if x.strip()] or [""]


def own_features(lines: list[str], seen: Counter) -> np.ndarray:
    """Features of each line by itself, each within 0 and about 1. seen: how often the text has which line."""
    out = np.zeros((len(lines), OWN))
    for i, x in enumerate(lines):
        w = x.split()
        n, m = max(1, len(w)), max(1, len(x))
        kinds = len(set(w))
        letters = x.translate(_SYMBOLS)
        out[i] = (
            1.0,
            min(1.0, (len(x) - len(letters)) / n),
            min(1.0, x.count("!!") / n),
            min(1.0, x.count("|") / n),
            1.0 if x.isupper() else 0.0,
            1 - kinds / n,
            (1 - kinds / n) if n >= 30 else 0.0,
            1.0 if n >= 12 and kinds < 0.35 * n else 0.0,
            sum(a == b for a, b in zip(w, w[1:], strict=False)) / n,
            1.0 if seen[x] > 1 else 0.0,
            min(1.0, len(x) / n / 20),
            min(1.0, np.log1p(m) / 12),
            1.0 if x[-1:] in ".?!:;" else 0.0,
            sum(map(x.count, "0123456789")) / m,
        )
    return out


def line_features(lines: list[str], first: int = 0, last: int | None = None, seen: Counter | None = None) -> np.ndarray:
    """Of the lines from `first` up to `last`: own features, and the same of the lines before and after each."""
    last = len(lines) if last is None else last
    low, high = max(0, first - 1), min(len(lines), last + 1)
    out, none = own_features(lines[low:high], seen or Counter(lines)), np.zeros((1, OWN))
    before = np.concatenate([none, out]) if first == 0 else out
    after = np.concatenate([out, none]) if last == len(lines) else out
    n = last - first
    return np.concatenate([out[first - low : first - low + n], before[:n], after[-n:]], axis=1)


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(score: np.ndarray, sizes: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains that stand one after another, longest first: marginals of states and of moves, and log partitions.

    score: lines x 2; sizes: lines of each chain, falling; move: 2 x 2 log potentials.
    """
    starts = np.cumsum(sizes) - sizes
    alpha, beta = np.array(score), np.zeros_like(score)
    live = [int((sizes > t).sum()) for t in range(int(sizes[0]))]
    for t in range(1, len(live)):
        at = starts[: live[t]] + t
        alpha[at] += _log_sum(alpha[at - 1][:, :, None] + move, 1)
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        beta[at] = _log_sum(move + (score[at + 1] + beta[at + 1])[:, None, :], 2)
    total = _log_sum(alpha[starts + sizes - 1], 1)
    by_line = np.repeat(total, sizes)
    states = np.exp(alpha + beta - by_line[:, None])
    inner = np.ones(len(score), bool)
    inner[starts] = False
    to = np.flatnonzero(inner)
    moves = np.exp(alpha[to - 1][:, :, None] + move + (score[to] + beta[to])[:, None, :] - by_line[to][:, None, None])
    return states, moves, total


def long_chain(score: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Marginals of state 1 along one chain, as forward_backward() gives them, a few numbers a line."""
    e = np.exp(score - score.max(axis=1, keepdims=True))
    (m00, m01), (m10, m11) = np.exp(move - move.max()).tolist()
    n, e0, e1 = len(e), e[:, 0].tolist(), e[:, 1].tolist()
    ahead = [0.0] * n  # normalised: the share of state 1
    a0, a1 = e0[0], e1[0]
    for i in range(n):
        if i:
            a0, a1 = (a0 * m00 + a1 * m10) * e0[i], (a0 * m01 + a1 * m11) * e1[i]
        z = a0 + a1
        a0, a1 = a0 / z, a1 / z
        ahead[i] = a1
    out, b0, b1 = np.zeros(n), 1.0, 1.0
    for i in range(n - 1, -1, -1):
        p0, p1 = (1 - ahead[i]) * b0, ahead[i] * b1
        out[i] = p1 / (p0 + p1)
        x0, x1 = e0[i] * b0, e1[i] * b1
        b0, b1 = m00 * x0 + m01 * x1, m10 * x0 + m11 * x1
        z = b0 + b1
        b0, b1 = b0 / z, b1 / z
    return out


class LineField:
    """States 0 (bad) and 1 (good). Weights are fitted to the likelihood of the lines' labels.

    A line's label is its document's. Since such documents never change state, each good one is also joined with a bad one
    into a mixed document, the good lines first in every other: from these the field learns what a change costs. The score's
    calibration is fitted on documents that the field which scored them hasn't seen.
    """

    def __init__(self, texts: list[str], quality: list[int], rates: tuple[float, float], steps: int = STEPS, fit_lines: int = FIT_LINES):
        self.only = None if len(set(quality)) == 2 else float(quality[0]) if quality else 0.5
        if self.only is not None:
            return
        room, docs = {0: fit_lines // 2, 1: fit_lines // 2}, []
        for x, y in sorted(zip(texts, quality, strict=True), key=lambda d: zlib.crc32(d[0].encode("utf-8", "surrogatepass"))):
            lines = lines_of(x)
            if len(lines) <= room[y]:
                room[y] -= len(lines)
                docs.append((lines, y))
        if len({y for _, y in docs}) < 2:
            self.only = float(docs[0][1]) if docs else 0.5
            return
        share, y = [], []
        for k in (0, 1):
            self.w, self.move = self._fit(docs[k::2], steps)
            other = docs[1 - k :: 2]
            share += [float(p @ w / w.sum()) for (x, _), p in zip(other, self._marginals([x for x, _ in other]), strict=True) for w in [self._weights(x)]]
            y += [v for _, v in other]
        self._calibrate(np.array(share), np.array(y), rates)
        self.w, self.move = self._fit(docs, steps)

    @staticmethod
    def _fit(docs: list[tuple[list[str], int]], steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Weights of features and moves by gradient steps with momentum on the log-likelihood, with a small penalty."""
        good, bad = ([x for x, y in docs if y == k] for k in (1, 0))
        mixed = [(g, b) if i % 2 else (b, g) for i, (g, b) in enumerate(zip(good, bad, strict=False))]
        chains = [(x, np.full(len(x), y)) for x, y in docs]
        chains += [(p + q, np.repeat([i % 2, 1 - i % 2], [len(p), len(q)])) for i, (p, q) in enumerate(mixed)]
        chains.sort(key=lambda c: -len(c[0]))
        f, sizes = np.concatenate([line_features(x) for x, _ in chains]), np.array([len(x) for x, _ in chains])
        line_y = np.concatenate([y for _, y in chains])
        weight = np.repeat(1 / np.sqrt(sizes) / len(sizes), sizes)  # a long document doesn't outweigh the others
        inner = np.ones(len(f), bool)
        inner[np.cumsum(sizes) - sizes] = False
        to = np.flatnonzero(inner)
        wanted = np.zeros((len(f), 2))
        wanted[np.arange(len(f)), line_y] = 1
        moved = np.zeros((len(to), 2, 2))
        moved[np.arange(len(to)), line_y[to - 1], line_y[to]] = 1
        at, m, v = [np.zeros((f.shape[1], 2)), np.zeros((2, 2))], [0.0, 0.0], [0.0, 0.0]
        for k in range(1, steps + 1):
            states, moves, _ = forward_backward(f @ at[0], sizes, at[1])
            g = [f.T @ ((states - wanted) * weight[:, None]) + 1e-4 * at[0], ((moves - moved) * weight[to][:, None, None]).sum(axis=0) + 1e-2 * at[1]]
            for i in range(2):
                m[i], v[i] = 0.9 * m[i] + 0.1 * g[i], 0.98 * v[i] + 0.02 * g[i] ** 2
                at[i] -= 0.15 * (m[i] / (1 - 0.9**k)) / (np.sqrt(v[i] / (1 - 0.98**k)) + 1e-8)
        return at[0], at[1]

    @staticmethod
    def _weights(lines: list[str]) -> np.ndarray:
        return np.maximum([len(x) for x in lines], 1).astype(float)

    def _calibrate(self, share: np.ndarray, y: np.ndarray, rates: tuple[float, float]) -> None:
        """Logistic calibration; classes weigh as in all labelled rows, not as in the sample."""
        x = self._odds(share)
        weight = np.where(y == 1, 1 / rates[1], 1 / rates[0])
        weight = weight / weight.sum()
        m, at, target = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0]), y * 0.998 + 0.001
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(m @ at, -30, 30)))
            h = (m * (weight * p * (1 - p))[:, None]).T @ m + 1e-3 * np.eye(2)
            at = at - np.linalg.solve(h, m.T @ (weight * (p - target)) + 1e-3 * (at - [1, 0]))
        self.a, self.b = max(1e-3, float(at[0])), float(at[1])

    @staticmethod
    def _odds(share: np.ndarray) -> np.ndarray:
        s = np.clip(share, 1e-4, 1 - 1e-4)
        return np.log(s / (1 - s))

    def _marginals(self, texts: list[list[str]]) -> Iterator[np.ndarray]:
        """Marginals of good of each text's lines, in order; at most LINES lines are in memory as features."""
        at = 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and len(texts[to]) <= LONG and n + len(texts[to]) <= LINES:
                n += len(texts[to])
                to += 1
            if to == at:
                lines = texts[at]
                seen = Counter(lines)
                blocks = [line_features(lines, k, min(k + LONG, len(lines)), seen) @ self.w for k in range(0, len(lines), LONG)]
                yield long_chain(np.concatenate(blocks), self.move)
                at += 1
                continue
            order = sorted(range(at, to), key=lambda i: -len(texts[i]))
            f, sizes = np.concatenate([line_features(texts[i]) for i in order]), np.array([len(texts[i]) for i in order])
            states, _, _ = forward_backward(f @ self.w, sizes, self.move)
            back = dict(zip(order, np.split(states[:, 1], np.cumsum(sizes)[:-1]), strict=True))
            yield from (back[i] for i in range(at, to))
            at = to

    def lines(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """Each text's lines and their marginals of good."""
        lines = [lines_of(x) for x in texts]
        return list(zip(lines, self._marginals(lines), strict=True))

    def score(self, texts: list[str | None]) -> list[float]:
        if self.only is not None:
            return [self.only] * len(texts)
        share = [float(p @ w / w.sum()) for x, p in self.lines(texts) for w in [self._weights(x)]]
        return (1 / (1 + np.exp(-(self.a * self._odds(np.array(share)) + self.b)))).tolist()


def fit_quality(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, folds: int = 3, held: int = 1) -> LineField:
    """Fits on a bounded sample (`examples` rows of each class, FIT_BYTES of text, FIT_LINES lines) of the labelled rows outside the held-out fold."""
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held))
    rows, rates = fitting_rows(docs, usable.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality")), "quality", examples)
    return LineField([r["text"] for r in rows], [r["quality"] for r in rows], rates)


def score_quality(docs: DataFrame, model: LineField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score: a row for each row, by whole texts, without a shuffle.

    Null and empty texts are one empty line. Without labelled rows of both classes every score is the one class, or 0.5.
    Null ids and repeated rows stay; other columns are ignored; an empty table gives an empty one. A text of many lines is
    scored by blocks of lines.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(batch.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, score double")
