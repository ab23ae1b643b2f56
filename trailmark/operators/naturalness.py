"""Naturalness of tokens under an n-gram model, and co-occurrence bias of code and target tokens."""

from __future__ import annotations

import functools
import itertools
import keyword
import re
import zlib
from collections.abc import Callable, Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import Naturalness
from ..functions import text as T
from ..session import saved, small

# Reserved words of the two languages, and marks that count as symbols.
KEYWORDS = {
    "java": (
        "abstract assert boolean break byte case catch char class continue default do double else enum extends final finally float for if "
        "implements import int interface instanceof long native new package private protected public return short static strictfp super "
        "switch synchronized this throw throws transient try void volatile while"
    ).split(),
    "python": keyword.kwlist,
}
_MARKS = ";():{}[],.=+-*/<>!?&|^%~ \t\n\"'0"
SYMBOLS = ["</s>", "<pad>", "<unk>", *_MARKS]
_ALL_SYMBOLS = f"^[{re.escape(_MARKS)}]+$"


def code_tokens(tokens: Column, language: str) -> Column:
    """Distinct tokens that are no keywords or symbols and have no digit."""
    stripped = F.array_distinct(F.transform(tokens, T.strip_prefix))
    return F.filter(stripped, lambda t: (t != "") & ~t.isin(*KEYWORDS[language]) & ~t.isin(*SYMBOLS) & ~t.rlike(r"\p{Nd}"))


def target_tokens(tokens: Column) -> Column:
    stripped = F.array_distinct(F.transform(tokens, T.strip_prefix))
    return F.filter(stripped, lambda t: (t != "") & ~t.isin(*SYMBOLS))


#: Blocks of the matrix of code and target tokens, by hash: rows and columns of the grid. Each block is one task.
GRID = (16, 4)
#: Tokens of the samples that are turned into postings at a time, and pairs that a task counts at a time.
PIECE, PAIRS = 1 << 21, 1 << 22


def _packed(toks: pa.Array, ends: np.ndarray, at: np.ndarray) -> bytes:
    """A table of tokens and the places of the samples that hold them, as bytes."""
    lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(at))
    batch = pa.RecordBatch.from_arrays([toks, lists], names=["tok", "at"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    batch = pa.ipc.open_stream(data).read_next_batch()
    return batch.column(0), batch.column(1).offsets.to_numpy(), batch.column(1).values.to_numpy()


def _postings(lists: pa.Array, parts: int) -> list[bytes]:
    """For each of `parts` parts of the tokens, by hash, the tokens in some samples and the places of those samples."""
    values = lists.flatten()
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    found = values.dictionary_encode()
    toks = found.dictionary.cast(pa.string())
    part = np.fromiter((zlib.crc32(t.encode()) % parts for t in toks.to_pylist()), np.int64, len(toks))
    order = np.argsort(part, kind="stable")
    place = np.empty(len(toks), np.int64)
    place[order] = np.arange(len(toks))
    keys = np.sort(place[found.indices.to_numpy()] << 16 | np.repeat(np.arange(len(lists)), sizes))
    at, ends = (keys & 0xFFFF).astype(np.uint16), np.r_[0, np.cumsum(np.bincount(keys >> 16, minlength=len(toks)))]
    edges, toks = np.searchsorted(part[order], np.arange(parts + 1)), toks.take(pa.array(order))
    return [_packed(toks[a:b], ends[a : b + 1] - ends[a], at[ends[a] : ends[b]]) for a, b in itertools.pairwise(edges.tolist())]


def _blocks(samples: DataFrame, grid: tuple[int, int]) -> DataFrame:
    """block, size, code, target: the postings of some samples' code tokens in a row of the grid and target tokens in a column.

    No pair is shuffled: a token of a sample goes to the tasks of its row or column, as a posting of two bytes. One part each.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, target = batch.column(0), batch.column(1)
            ends = np.cumsum(sum(c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in (code, target)))
            low = 0
            while low < len(ends):
                high = max(low + 1, min(int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PIECE, "right")), low + 0xFFFF))
                codes, targets = _postings(code[low:high], grid[0]), _postings(target[low:high], grid[1])
                for i, c in enumerate(codes):
                    block = [i * grid[1] + j for j in range(grid[1])]
                    columns = [pa.array(block, pa.int32()), pa.array([high - low] * grid[1], pa.int32()), pa.array([c] * grid[1], pa.binary()), pa.array(targets, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["block", "size", "code", "target"])
                low = high

    made = samples.select("code_toks", "target_toks").mapInArrow(cut, "block int, size int, code binary, target binary")
    return made.repartitionById(grid[0] * grid[1], F.col("block"))


def _numbers(toks: list[pa.Array], ends: list[np.ndarray], least: int) -> tuple[pa.Array, list[np.ndarray]]:
    """All tokens in at least `least` samples, sorted, and for each piece its tokens' numbers among them, -1 for the others."""
    found = pa.chunked_array(toks, pa.string()).combine_chunks().dictionary_encode()
    of = found.indices.to_numpy()
    n = np.bincount(of, weights=np.concatenate([np.diff(e) for e in ends]), minlength=len(found.dictionary))
    kept = found.dictionary.take(pa.array(np.flatnonzero(n >= least)))
    order = pc.sort_indices(kept).to_numpy()
    number = np.full(len(n), -1, np.int64)
    number[np.flatnonzero(n >= least)[order]] = np.arange(len(order))
    return kept.take(pa.array(order)), np.split(number[of], np.cumsum([len(t) for t in toks])[:-1])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of spans, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Block:
    """The pairs of a block of the grid, counted code token by code token: bounded memory beside the postings."""

    def __init__(self, rows: list[tuple[int, bytes, bytes]], least: int) -> None:
        codes, targets = [_unpacked(c) for _, c, _ in rows], [_unpacked(t) for _, _, t in rows]
        self.codes, code_of = _numbers([c[0] for c in codes], [c[1] for c in codes], least)
        self.targets, target_of = _numbers([t[0] for t in targets], [t[1] for t in targets], least)
        self.pieces, self.pairs = [], np.zeros(len(self.codes), np.int64)
        for k, (size, _, _) in enumerate(rows):
            (_, ends, at), (_, target_ends, target_at) = codes[k], targets[k]
            codes[k] = targets[k] = None
            of = np.repeat(target_of[k], np.diff(target_ends))
            order = np.argsort(target_at, kind="stable")
            order = order[of[order] >= 0]
            sizes = np.bincount(target_at[order], minlength=size)
            own = np.flatnonzero(code_of[k] >= 0)
            own = own[np.argsort(code_of[k][own])]
            n = np.diff(ends)[own]
            at = at[_spans(ends[own].astype(np.int64), n)]
            bounds = np.r_[0, np.cumsum(n)]
            self.pieces.append((code_of[k][own].astype(np.int32), bounds, at, np.r_[0, np.cumsum(sizes)], of[order].astype(np.int32)))
            total = np.r_[0, np.cumsum(sizes[at])]
            self.pairs[code_of[k][own]] += total[bounds[1:]] - total[bounds[:-1]]

    def cells(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Numbers of code and target tokens, and counts; all of a code token's at once."""
        width, total, low = max(1, len(self.targets)), np.cumsum(self.pairs), 0
        while low < len(self.codes):
            high = max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + PAIRS, "right")))
            dense = (high - low) * width <= max(4 * int(total[high - 1] - (total[low - 1] if low else 0)), 1 << 16)
            counts, held, n = np.zeros((high - low) * width if dense else 0, np.int64), [], 0
            for keys in self._keys(low, high, width):
                if dense:
                    counts += np.bincount(keys, minlength=len(counts))
                    continue
                held.append((keys, None))
                if (n := n + len(keys)) >= PAIRS:
                    held, n = [_summed(held)], 0
            keys, v = (np.flatnonzero(counts), counts[counts > 0]) if dense else _summed(held)
            if len(keys):
                yield low + keys // width, keys % width, v
            low = high

    def _keys(self, low: int, high: int, width: int) -> Iterator[np.ndarray]:
        """The pairs of some code tokens as numbers, not many more than PAIRS at a time."""
        held, n = [], 0
        for numbers, bounds, at, ends, of in self.pieces:
            a, b = np.searchsorted(numbers, (low, high))
            if a == b:
                continue
            s = at[bounds[a] : bounds[b]]
            sizes = ends[1:][s] - ends[:-1][s]
            row = np.repeat((numbers[a:b].astype(np.int64) - low) * width, np.diff(bounds[a : b + 1]))
            keys = np.repeat(row, sizes) + of[_spans(ends[:-1][s], sizes)]
            held.append(keys)
            if (n := n + len(keys)) >= PAIRS:
                yield np.concatenate(held)
                held, n = [], 0
        if held:
            yield np.concatenate(held)


def _summed(held: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order and how often they occur; None: once each."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys = np.concatenate([k for k, _ in held])
    if all(v is None for _, v in held):
        keys.sort()
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        return keys[first], np.diff(np.r_[first, len(keys)])
    order = np.argsort(keys, kind="stable")
    keys, v = keys[order], np.concatenate([np.ones(len(k), np.int64) if v is None else v for k, v in held])[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(v, first)


def _by_block(samples: DataFrame, run: Callable[[int, _Block], Iterator[pa.RecordBatch]], schema: str, grid: tuple[int, int], least: int = 1) -> DataFrame:
    """What `run` makes of each block, of tokens in at least `least` samples."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[tuple[int, bytes, bytes]]] = {}
        for batch in batches:
            for block, size, code, target in zip(*[batch.column(i) for i in range(4)], strict=True):
                rows.setdefault(block.as_py(), []).append((size.as_py(), code.as_py(), target.as_py()))
        while rows:
            block, own = rows.popitem()
            yield from run(block, _Block(own, least))

    return _blocks(samples, grid).mapInArrow(blocks, schema)


def _sliced(names: list[str], columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    for low in range(0, len(columns[0]), 1 << 16):
        yield pa.RecordBatch.from_arrays([c.slice(low, 1 << 16) for c in columns], names=names)


def cooccurrence(samples: DataFrame, grid: tuple[int, int] = GRID) -> DataFrame:
    """code_tok, target_tok, v: samples with both. samples: code_toks, target_toks (distinct tokens)."""

    def rows(_: int, block: _Block) -> Iterator[pa.RecordBatch]:
        for c, t, v in block.cells():
            for low in range(0, len(c), 1 << 16):
                some = slice(low, low + (1 << 16))
                columns = [block.codes.take(pa.array(c[some])), block.targets.take(pa.array(t[some])), pa.array(v[some])]
                yield pa.RecordBatch.from_arrays(columns, names=["code_tok", "target_tok", "v"])

    return _by_block(samples, rows, "code_tok string, target_tok string, v long", grid)


def cooccurrence_sums(samples: DataFrame, grid: tuple[int, int] = GRID) -> DataFrame:
    """code_tok, cells, total, top, digest: cooccurrence() summed up for each code token, where the cells are counted. digest:
    the sum of the first 8 hex digits of the md5 of `target:v`."""

    def rows(_: int, block: _Block) -> Iterator[pa.RecordBatch]:
        names = [t.encode() for t in block.targets.to_pylist()]
        hashed = lambda t, v: int.from_bytes(md5(b"%b:%d" % (names[t], v)).digest()[:4], "big")
        ones = np.fromiter((hashed(t, 1) for t in range(len(names))), np.int64, len(names))
        known: dict[int, int] = {}
        for c, t, v in block.cells():
            digest, more = ones[t], np.flatnonzero(v > 1)
            kinds, of = np.unique(t[more] << 32 | v[more], return_inverse=True)
            if len(known) > 1 << 20:
                known.clear()
            values = [known[k] if k in known else known.setdefault(k, hashed(k >> 32, k & 0xFFFFFFFF)) for k in kinds.tolist()]
            digest[more] = np.array(values, np.int64)[of] if values else 0
            first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            sums = [np.diff(np.r_[first, len(c)]), np.add.reduceat(v, first), np.maximum.reduceat(v, first), np.add.reduceat(digest, first)]
            yield from _sliced(["code_tok", "cells", "total", "top", "digest"], [block.codes.take(pa.array(c[first])), *map(pa.array, sums)])

    parts = _by_block(samples, rows, "code_tok string, cells long, total long, top long, digest long", grid)
    return parts.groupBy("code_tok").agg(F.sum("cells").alias("cells"), F.sum("total").alias("total"), F.max("top").alias("top"), F.sum("digest").alias("digest"))


def bias_pairs(samples: DataFrame, settings: Naturalness = Naturalness(), grid: tuple[int, int] = GRID) -> DataFrame:
    """target_tok, code_tok: pairs that are outliers among the code tokens of a target token and the other way round.

    Cells of zero are left out: they never pass. A token in fewer samples than a cell must count can't be in one that counts,
    so such tokens, most of all, go before any pair is made: as the samples grow, so does that number, and the cells of the
    others stay bounded. Cells are counted by block and saved as numbers of tokens; a token stays if one of its cells counts,
    and the cell that keeps it keeps its other token as well, so one round settles both.
    """
    n = samples.count()
    least = int(n * settings.scale)
    names = ["kind", "code", "target", "v", "tok"]

    def rows(at: int, block: _Block) -> Iterator[pa.RecordBatch]:
        i, j = divmod(at, grid[1])

        def made(kind: int, code: pa.Array | None, target: pa.Array | None, v: pa.Array | None, tok: pa.Array | None) -> Iterator[pa.RecordBatch]:
            size = len(next(x for x in (code, target) if x is not None))
            others = [x if x is not None else pa.nulls(size, kind) for x, kind in ((code, pa.int64()), (target, pa.int64()), (v, pa.int64()), (tok, pa.string()))]
            yield from _sliced(names, [pa.array(np.full(size, kind, np.int32)), *others])

        tops = [np.zeros(len(x), bool) for x in (block.codes, block.targets)]
        for c, t, v in block.cells():
            left = v < n
            c, t, v = c[left], t[left], v[left]
            counts = v >= least
            tops[0][c[counts]] = tops[1][t[counts]] = True
            yield from made(0, pa.array(c * grid[0] + i), pa.array(t * grid[1] + j), pa.array(v), None)
        c, t = (np.flatnonzero(x) for x in tops)
        yield from made(1, pa.array(c * grid[0] + i), None, None, block.codes.take(pa.array(c)))
        yield from made(2, None, pa.array(t * grid[1] + j), None, block.targets.take(pa.array(t)))

    counted = saved(_by_block(samples, rows, "kind int, code long, target long, v long, tok string", grid, least))
    cells = counted.where("kind = 0").select("code", "target", "v")
    kept = {by: small(counted.where(F.col("kind") == k).select(by, "tok").distinct()) for k, by in ((1, "code"), (2, "target"))}
    if least > 1:  # every cell is at least 1
        for by in kept:
            cells = cells.join(kept[by].select(by), by, "left_semi")
    out = cells
    for by in kept:
        sums = cells.groupBy(by).agg(F.count("v").alias("k"), F.sum("v").alias("m"), F.sum(F.col("v") * F.col("v")).alias("q"))
        # k times the deviation, its square exact: a cell that lies just z deviations off is the same one in any order of sums
        square = (F.col("k").cast("decimal(19,0)") * F.col("q").cast("decimal(19,0)")).cast("decimal(38,0)") - (F.col("m").cast("decimal(19,0)") * F.col("m").cast("decimal(19,0)")).cast("decimal(38,0)")
        spread = sums.select(by, "k", "m", F.sqrt(square.cast("double")).alias("s")).where("s > 0")
        out = out.join(small(spread), by).where(F.col("v") * F.col("k") - F.col("m") > F.col("s") * settings.z).select("code", "target", "v")
    for by in kept:
        out = out.join(kept[by].withColumnRenamed("tok", f"{by}_tok"), by)
    return out.where(~F.col("code_tok").rlike(_ALL_SYMBOLS)).select("target_tok", "code_tok", "v")


def padded(tokens: Column) -> Column:
    return F.concat(F.array(F.lit("<s>")), tokens, F.array(F.lit("</s>")))


def lm_counts(corpus: DataFrame, tokens: str, order: int = 4) -> DataFrame:
    """gram (array of 1 to `order` tokens, with sentence marks), n."""
    seq = F.col("__t")
    of = lambda k: F.when(F.size(seq) >= k, F.transform(F.sequence(F.lit(1), F.size(seq) - (k - 1)), lambda i: F.slice(seq, i, F.lit(k)))).otherwise(F.array().cast("array<array<string>>"))
    grams = F.concat(*[of(k) for k in range(1, order + 1)])
    return corpus.select(padded(F.col(tokens)).alias("__t")).select(F.explode(grams).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


#: Windows that a task sorts at a time.
HELD = 1 << 19


def kind_counts(corpus: DataFrame, tokens: str, parts: int, order: int = 4) -> DataFrame:
    """n, kinds, total: how many different n-grams of each length from 1 to `order` (2 at least) lm_counts() has, and all of them.

    Only the windows that begin at each token are shuffled, once, dealt by their first two tokens: the shorter grams begin
    them. A window is a hash of its first two tokens and one of each further token, and blobs of sorted windows are the rows
    of the shuffle: 8 bytes for each token but the first of a window, nothing spilled by an aggregate. parts: how many tasks
    take them, each of which holds its windows.
    """
    mix, buckets = np.uint64(0x9E3779B97F4A7C15), 4 * parts

    def sorted_kinds(rows: np.ndarray) -> np.ndarray:
        rows = rows[np.lexsort(rows.T[::-1])]
        return rows[np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)]] if len(rows) else rows

    def blobs(kind: int, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        rows = sorted_kinds(rows)
        bucket = (rows[:, 0] >> np.uint64(17)) % np.uint64(buckets)
        at = np.argsort(bucket, kind="stable")
        rows, ends = rows[at], np.searchsorted(bucket[at], np.arange(buckets + 1))
        full = np.flatnonzero(ends[1:] > ends[:-1])
        for some in np.array_split(full, max(1, len(rows) * rows.shape[1] >> 20)):  # batches of about 8 MB
            data = pa.array([rows[ends[b] : ends[b + 1]].tobytes() for b in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(len(some), kind, np.int32)), data], names=["bucket", "kind", "data"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, totals = [], 0, np.zeros(order, np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            at = np.concatenate(held)
            held.clear()
            yield from blobs(1, at[:, :1])
            longer = at[at[:, 1] != 0]
            longer[:, 1] ^= longer[:, 0] * mix
            yield from blobs(2, longer[:, 1:])

        for batch in batches:
            all_ends, low = batch.column(0).offsets.to_numpy(), 0
            while low < batch.num_rows:  # some texts at a time, or a batch's windows would stand in memory several times
                high = max(low + 1, int(np.searchsorted(all_ends, all_ends[low] + HELD, "right")) - 1)
                ends = all_ends[low : high + 1]
                flat = batch.column(0).values.to_numpy()[ends[0] : ends[-1]].view(np.uint64)
                left = np.repeat(ends[1:] - ends[0], np.diff(ends)) - np.arange(len(flat))
                ahead = np.concatenate([flat, np.zeros(order, np.uint64)])
                held.append(np.stack([np.where(left > k, ahead[k : k + len(flat)], np.uint64(0)) for k in range(order)], axis=1))
                totals += [int((left > k).sum()) for k in range(order)]
                n, low = n + len(flat), high
                if n >= HELD:
                    yield from out()
                    n = 0
        if held:
            yield from out()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([0], pa.int32()), pa.array([totals.tobytes()], pa.binary())], names=["bucket", "kind", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for batch in batches:
            for kind, data in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                found[kind].append(data.as_py())
        rows = lambda kind, width: np.frombuffer(b"".join(found.pop(kind)), np.uint64).reshape(-1, width)
        totals, kinds = rows(0, order).astype(np.int64).sum(axis=0), [len(np.unique(rows(1, 1)))]
        windows = sorted_kinds(rows(2, order - 1))
        new = np.zeros(len(windows), bool)
        for c in range(order - 1):
            new = new | np.r_[np.ones(min(1, len(windows)), bool), windows[1:, c] != windows[:-1, c]]
            kinds.append(int((new & (windows[:, c] != 0)).sum() if c else new.sum()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, order + 1)), pa.array(kinds, pa.int64()), pa.array(totals)], names=["n", "kinds", "total"])

    marks = [F.array(F.lit(NgramModel.signed(m))) for m in ("<s>", "</s>")]
    seq = F.concat(marks[0], F.transform(tokens, lambda t: F.xxhash64(t)), marks[1])
    dealt = corpus.where(F.col(tokens).isNotNull()).select(seq.alias("s")).mapInArrow(cut, "bucket int, kind int, data binary").repartition(parts, "bucket")
    each = dealt.mapInArrow(count, "n long, kinds long, total long").groupBy("n").agg(F.sum("kinds").alias("kinds"), F.sum("total").alias("total"))
    return each.where(F.col("total") > 0)


def _columns(order: int) -> list[str]:
    return [f"c{i}" for i in range(1, order + 1)]


def window_counts(corpus: DataFrame, tokens: str, order: int = 4) -> DataFrame:
    """c1 .. c`order`, n: how often each window of token hashes occurs that ends at a token or the end mark.

    Windows that begin before the sentence are filled with 0 on the left. They hold all that kneser_ney() needs of the shorter
    n-grams: their raw counts matter only at the start of a sentence. Keys of fixed width make it a plain hash aggregate.
    """
    blank = [F.lit(0).cast("long")] * (order - 1)
    seq = F.concat(F.array(*blank, F.lit(NgramModel.signed("<s>"))), F.transform(tokens, lambda t: F.xxhash64(t)), F.array(F.lit(NgramModel.signed("</s>"))))
    # Shifted copies side by side: each text is hashed a fixed number of times, not once for each place.
    shifted = F.arrays_zip(*[F.slice("__s", i + 2, F.size("__s") - order).alias(c) for i, c in enumerate(_columns(order))])
    each = corpus.where(F.col(tokens).isNotNull()).select(seq.alias("__s")).select(F.inline(shifted).alias(*_columns(order)))
    return each.groupBy(*_columns(order)).agg(F.count(F.lit(1)).alias("n"))


def adjusted_counts(windows: DataFrame, order: int = 4) -> DataFrame:
    """c1 .. c`order`, k, a: raw counts of the longest grams and of those that begin a sentence; of others how many tokens stand before them."""
    c, mark = _columns(order), NgramModel.signed("<s>")
    levels = [windows.where(F.col(c[0]) != 0).select(*c, F.lit(order).alias("k"), F.col("n").alias("a"))]
    for k in range(order - 1, 0, -1):
        blank = [F.lit(0).cast("long").alias(x) for x in c[: order - k]]
        before = levels[-1].groupBy(*c[order - k :]).agg(F.count(F.lit(1)).alias("a")).where(F.col(c[order - k]) != mark)
        level = before.select(*blank, *c[order - k :], F.lit(k).alias("k"), "a")
        if k > 1:
            starts = windows.where((F.col(c[order - k]) == mark) & (F.col(c[order - k - 1]) == 0))
            level = level.unionByName(starts.select(*c, F.lit(k).alias("k"), F.col("n").alias("a")))
        levels.append(saved(level))
    return functools.reduce(DataFrame.unionByName, levels)


def discounts(adjusted: DataFrame) -> DataFrame:
    """k, d1, d2, d3: what the grams of each length give up at counts of 1, 2 and more.

    Where counts of counts are missing or a discount leaves its range, a length falls back to 0.5, 1 and 1.5.
    """
    t = adjusted.groupBy("k").agg(*[F.count(F.when(F.col("a") == i, 1)).alias(f"t{i}") for i in (1, 2, 3, 4)])
    y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
    d = [F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")) for i in (1, 2, 3)]
    fits = F.coalesce(functools.reduce(Column.__and__, [x.between(0, i) for i, x in enumerate(d, 1)]), F.lit(False))
    return t.select("k", *[F.when(fits, x).otherwise(i / 2).alias(f"d{i}") for i, x in enumerate(d, 1)])


def smoothed(windows: DataFrame, order: int = 4) -> DataFrame:
    """c1 .. c`order`, log_p, log_b: an interpolated n-gram model with modified Kneser-Ney smoothing, in log10.

    windows: window_counts(), saved. Lengths follow one another, as each takes from the one below: a join of each length with
    the shorter one, by columns of fixed width. `<s>` has a back-off weight only; `<unk>` gets the share of one unseen kind.
    """
    c = _columns(order)
    adjusted = adjusted_counts(windows, order)
    a, k = F.col("a"), F.col("k")
    d = F.when(a == 1, F.col("d1")).when(a == 2, F.col("d2")).otherwise(F.col("d3"))
    shift = [F.col(y).alias(f"x{i}") for i, y in enumerate(c[:-1], 2)]  # a gram's context, one place to the right
    x = [f"x{i}" for i in range(2, order + 1)]
    rows = adjusted.join(F.broadcast(saved(discounts(adjusted))), "k").select(*c, "k", "a", d.alias("d"), *shift)  # a row for each length
    # Of no context there are many grams of one token: `k` apart, or the sums of all lengths would meet.
    per = saved(rows.groupBy("k", *x).agg(F.sum("a").alias("total"), (F.sum("d") / F.sum("a")).alias("g")))
    own = saved(rows.join(per, ["k", *x]).select(*c, "k", ((a - F.col("d")) / F.col("total")).alias("u"), "g"))
    kinds = own.where(k == 1).agg((F.count(F.lit(1)) + 1).alias("kinds"))
    levels = [saved(own.where(k == 1).crossJoin(F.broadcast(kinds)).select(*c, "k", (F.col("u") + F.col("g") / F.col("kinds")).alias("p")))]  # kinds is one row
    for n in range(2, order + 1):
        end = c[order - n + 1 :]
        longer = own.where(k == n).join(levels[-1].select(*end, "p"), end, "left").select(*c, "k", (F.col("u") + F.col("g") * F.coalesce("p", F.lit(0.0))).alias("p"))
        levels.append(saved(longer) if n < order else longer)
    back = per.select((k - 1).alias("k"), *[F.col(f"x{i}").alias(y) for i, y in enumerate(c[1:], 2)], "g")
    no = F.lit(0).cast("long").alias(c[0])
    known = [p.join(back, ["k", *c[1:]], "left").select(*c, F.log10("p").alias("log_p"), F.coalesce(F.log10("g"), F.lit(0.0)).alias("log_b")) for p in levels[:-1]]
    known.append(levels[-1].select(*c, F.log10("p").alias("log_p"), F.lit(0.0).alias("log_b")))
    begin = back.where((k == 1) & (F.col(c[-1]) == NgramModel.signed("<s>"))).select(no, *c[1:], F.lit(None).cast("double").alias("log_p"), F.log10("g").alias("log_b"))
    unk = [*[F.lit(0).cast("long").alias(y) for y in c[:-1]], F.lit(NgramModel.signed("<unk>")).alias(c[-1])]
    unseen = back.where(k == 0).crossJoin(F.broadcast(kinds)).select(*unk, F.log10(F.col("g") / F.col("kinds")).alias("log_p"), F.lit(0.0).alias("log_b"))
    return functools.reduce(DataFrame.unionByName, [*known, *([begin] if order > 1 else []), unseen])


def _hash_columns(order: int) -> list[Column]:
    """The hashes of `gram`, right-aligned."""
    return [F.when(F.size("gram") >= order - i, F.xxhash64(F.get("gram", F.size("gram") - order + i))).otherwise(0).alias(c) for i, c in enumerate(_columns(order))]


def kneser_ney(counts: DataFrame, order: int = 4) -> DataFrame:
    """gram, log_p, log_b: smoothed() with the tokens themselves. counts: lm_counts()."""
    k = F.size("gram")
    named = counts.select("gram", *_hash_columns(order), "n")
    windows = named.where((k == order) | ((F.col("gram")[0] == "<s>") & (k > 1))).where((k > 1) | (F.col("gram")[0] != "<s>")).select(*_columns(order), "n")
    model = smoothed(saved(windows), order)
    return model.join(named.drop("n"), _columns(order), "left").select(F.coalesce("gram", F.array(F.lit("<unk>"))).alias("gram"), "log_p", "log_b")


class NgramModel:
    """A back-off table of hashed n-grams. The corpus is a bounded sample of clean snippets, so is the model.

    A token's probability is that of the longest known n-gram that ends in it, times the weights of the longer contexts
    given up for it.
    """

    def __init__(self, size: np.ndarray, key: np.ndarray, log_p: np.ndarray, log_b: np.ndarray, order: int = 4):
        self.order = order
        self.keys, self.p, self.b = [], [], []
        for n in range(order + 1):
            at = np.flatnonzero(size == n)
            at = at[np.argsort(key[at])]
            self.keys.append(key[at])
            self.p.append(log_p[at])
            self.b.append(log_b[at])
        unk = self._at(1, np.array([self.hashed(["<unk>"])], np.uint64))[0]
        self.unk = float(self.p[1][unk]) if unk >= 0 else 0.0

    @staticmethod
    def _hash(t: str) -> int:
        """As the engine's xxhash64()."""
        return xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass"), seed=42)

    @classmethod
    def signed(cls, t: str) -> int:
        return int(np.uint64(cls._hash(t)).view(np.int64))

    @classmethod
    def hashed(cls, gram: list[str]) -> int:
        h = 0
        for t in gram:
            h = ((h * 0x9E3779B97F4A7C15) ^ cls._hash(t)) & 0xFFFFFFFFFFFFFFFF
        return h

    def _at(self, order: int, h: np.ndarray) -> np.ndarray:
        """Places of n-grams in their table, -1 for those that it hasn't."""
        k = self.keys[order]
        if not len(k):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(k, h), len(k) - 1)
        return np.where(k[at] == h, at, -1)

    def log10(self, window: np.ndarray, known: np.ndarray) -> np.ndarray:
        """log10 of the last token of each row of hashes, given those before it. known: how many columns count, from the right."""
        rows, width = window.shape

        def chain(first: int, last: int) -> np.ndarray:
            h = np.zeros(rows, np.uint64)
            for c in range(first, last):
                h = h * np.uint64(0x9E3779B97F4A7C15) ^ window[:, c]
            return h

        at = self._at(1, chain(width - 1, width))
        p = np.where(at >= 0, self.p[1][at], self.unk) if len(self.keys[1]) else np.full(rows, self.unk)
        for n in range(2, self.order + 1):
            at, ctx = self._at(n, chain(width - n, width)), self._at(n - 1, chain(width - n, width - 1))
            weight = np.where(ctx >= 0, self.b[n - 1][ctx], 0.0) if len(self.keys[n - 1]) else 0.0
            longer = np.where(at >= 0, self.p[n][at], p + weight) if len(self.keys[n]) else p + weight
            p = np.where(known >= n, longer, p)
        return p

    def entropies(self, tokens: list[str]) -> tuple[float, list[float]]:
        """Cross-entropy of a snippet, and with each single token left out. Only the n-grams around a gap are scored anew."""
        n, w = len(tokens), self.order
        if not n:
            return 0.0, []
        cache: dict[str, int] = {}
        ids = np.array([cache.setdefault(t, self._hash(t)) for t in ("<s>", *tokens, "</s>")], np.uint64)
        seq = np.concatenate([np.zeros(w - 1, np.uint64), ids])
        at = np.arange(1, n + 2)  # scored: every token and the end mark
        window = np.stack([seq[at + c] for c in range(w)], axis=1)
        base = self.log10(window, np.minimum(at + 1, w))
        total = base.sum()
        # Without token j, the tokens at j+1 .. j+w-1 see one token further back.
        j = np.repeat(np.arange(1, n + 1), w - 1)
        k = j + np.tile(np.arange(1, w), n)
        ok = k <= n + 1
        j, k = j[ok], k[ok]
        cols = []
        for c in range(w):
            back = w - 1 - c  # this many places before k in the shortened sequence
            place = k - back
            cols.append(seq[np.where((place <= j) & (back > 0), np.maximum(place - 1, -(w - 1)), place) + w - 1])
        new = self.log10(np.stack(cols, axis=1), np.minimum(k, w))
        delta = np.zeros(n + 2)
        np.add.at(delta, j, new - base[k - 1])
        left = total - base[:-1] + delta[1 : n + 1]
        return float(-total / n), [0.0] if n == 1 else (-left / (n - 1)).tolist()


def scan(samples: DataFrame, model: NgramModel, tokens: str = "tokens") -> DataFrame:
    """idx, base, loo: entropies of each snippet; snippets without tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.entropies(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["idx", "base", "loo"])

    return samples.where(F.size(tokens) > 0).select("idx", tokens).mapInArrow(run, "idx long, base double, loo array<double>")


def _windows(tokens: list[str], w: int, loo: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """left out (0: none), place, known, and the hashes that end at each place: of every token and the end mark, and with
    `loo` of the w-1 places behind each token left out."""
    n, cache = len(tokens), {}
    ids = np.array([cache[t] if t in cache else cache.setdefault(t, NgramModel._hash(t)) for t in ("<s>", *tokens, "</s>")], np.uint64)
    out = np.arange(1, n + 1) if loo else np.zeros(0, np.int64)
    j = np.concatenate([np.zeros(n + 1, np.int64), np.repeat(out, w - 1)])
    k = np.concatenate([np.arange(1, n + 2), j[n + 1 :] + np.tile(np.arange(1, w), len(out))])
    j, k = j[k <= n + 1], k[k <= n + 1]
    cols = []
    for back in range(w - 1, -1, -1):
        place = k - back
        place = np.where((place <= j) & (back > 0), place - 1, place)  # before the gap, one token further back; j = 0 moves only what isn't known
        cols.append(ids[np.maximum(place, 0)])
    return j, k, np.minimum(np.where(j > 0, k, k + 1), w), np.stack(cols, axis=1)


def _chain(window: np.ndarray, first: np.ndarray, last: int) -> np.ndarray:
    """Hashes of the columns from `first` (of each row) up to `last`."""
    h = np.zeros(len(window), np.uint64)
    for c in range(last):
        h = np.where(first <= c, h * np.uint64(0x9E3779B97F4A7C15) ^ window[:, c], h)
    return h


def scan_joined(samples: DataFrame, grams: DataFrame, tokens: str = "tokens", order: int = 4, loo: bool = True) -> DataFrame:
    """As scan(), with smoothed(), kneser_ney() or their hashed_grams(), saved, as a table: for a model that grows with the
    corpus, of which the driver gets one row.
    Without `loo` the entropies with a token left out are not computed and null.

    A place costs what its last `order` tokens cost, so each kind of window is looked up once: its n-grams and contexts are
    joined to the model by their hashes, and what they cost is joined back to the places.
    """
    model = grams if "key" in grams.columns else saved(hashed_grams(grams, order))
    unseen = model.where((F.col("size") == 1) & (F.col("key") == NgramModel.signed("<unk>"))).first()
    rows = saved(samples.where(F.size(tokens) > 0).select("idx", F.col(tokens).alias("tokens")).withColumn("rid", F.monotonically_increasing_id()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rid, toks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                j, k, known, window = _windows(toks, order, loo)
                kind = _chain(window, order - known, order)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), rid)), pa.array(j.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(known.astype(np.int32)), pa.array(kind.view(np.int64))], names=["rid", "j", "k", "known", "kind"])

    def kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for toks in batch.column(0).to_pylist():
                _, _, known, window = _windows(toks, order, loo)
                kind = _chain(window, order - known, order)
                _, at = np.unique(kind, return_index=True)
                known, window, kind = known[at], window[at], kind[at]
                parts = []
                for n in range(1, order + 1):
                    ok = known >= n
                    for size, last in ((n, order), (n - 1, order - 1)):
                        if size:
                            parts.append((known[ok], kind[ok], np.full(ok.sum(), size), _chain(window[ok], np.full(ok.sum(), order - n), last), np.full(ok.sum(), last == order)))
                known, kind, size, key, ends = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(known.astype(np.int32)), pa.array(kind.view(np.int64)), pa.array(size.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(ends)], names=["known", "kind", "size", "key", "ends"])

    asked = rows.select("tokens").mapInArrow(kinds, "known int, kind long, size int, key long, ends boolean").distinct()
    met = asked.join(model, ["size", "key"])
    p = [F.max(F.when(F.col("ends") & (F.col("size") == n), F.col("log_p"))).alias(f"p{n}") for n in range(1, order + 1)]
    b = [F.max(F.when(~F.col("ends") & (F.col("size") == n), F.col("log_b"))).alias(f"b{n}") for n in range(1, order)]
    cost = F.coalesce("p1", F.lit(unseen.log_p if unseen else 0.0))
    for n in range(2, order + 1):
        cost = F.coalesce(f"p{n}", cost + F.coalesce(f"b{n - 1}", F.lit(0.0)))
    costs = met.groupBy("known", "kind").agg(*p, *b).select("known", "kind", cost.alias("cost"))
    placed = rows.select("rid", "tokens").mapInArrow(places, "rid long, j int, k int, known int, kind long").join(costs, ["known", "kind"], "left")
    each = F.sort_array(F.collect_list(F.struct("j", "k", F.coalesce("cost", F.lit(unseen.log_p if unseen else 0.0)).alias("cost"))))
    scored = placed.groupBy("rid").agg(each.alias("x")).join(rows.select("rid", "idx"), "rid")

    def entropies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for x in batch.column(1):
                j, k, cost = (x.values.field(c).to_numpy() for c in ("j", "k", "cost"))
                n = int((j == 0).sum()) - 1
                base, total = cost[: n + 1], cost[: n + 1].sum()  # sorted by j and k
                if not loo:
                    made.append((-total / n, None))
                    continue
                delta = np.zeros(n + 1)
                np.add.at(delta, j[n + 1 :], cost[n + 1 :] - base[k[n + 1 :] - 1])
                left = total - base[:n] + delta[1:]
                made.append((-total / n, [0.0] if n == 1 else (-left / (n - 1)).tolist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.float64()), pa.array([m[1] for m in made], pa.list_(pa.float64()))], names=["idx", "base", "loo"])

    return scored.select("idx", "x").mapInArrow(entropies, "idx long, base double, loo array<double>")


def scan_missing(samples: DataFrame, cached: DataFrame, grams: DataFrame, tokens: str = "tokens", loo: bool = True) -> DataFrame:
    """idx, base, loo: all that the cache of an earlier scan holds, and a scan of the samples that it lacks."""
    return cached.unionByName(scan_joined(samples.join(cached.select("idx"), "idx", "left_anti"), grams, tokens, loo=loo))


def token_deltas(samples: DataFrame, scanned: DataFrame) -> DataFrame:
    """idx, tok, d, first: a token's gain is that of its last place, its order that of its first; numbers don't count."""
    pairs = F.posexplode(F.arrays_zip(F.col("tokens").alias("t"), F.col("loo").alias("l")))
    each = samples.join(scanned, "idx").select("idx", "base", pairs.alias("pos", "x")).select("idx", "pos", T.strip_prefix(F.col("x.t")).alias("tok"), (F.col("base") - F.col("x.l")).alias("d"))
    each = each.where((F.col("tok") != "") & ~T.is_number(F.col("tok")))
    return each.groupBy("idx", "tok").agg(F.round(F.max_by("d", "pos"), 9).alias("d"), F.min("pos").alias("first"))  # rounded, as gains tie


def rank_candidates(deltas: DataFrame, per_snippet: int) -> DataFrame:
    """tok, total: the greatest gains of each snippet, summed by token."""
    nth = F.row_number().over(Window.partitionBy("idx").orderBy(F.col("d").desc(), "first"))
    return deltas.withColumn("nth", nth).where(F.col("nth") <= per_snippet).groupBy("tok").agg(F.round(F.sum("d"), 6).alias("total"))


def triggers(candidates: DataFrame, pairs: DataFrame, top: int) -> DataFrame:
    """rank, tok, total: of the best tokens overall, cut first, those with a biased pair."""
    best = candidates.orderBy(F.col("total").desc(), "tok").limit(top)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.col("total").desc(), "tok")))
    return best.join(pairs.select(F.col("code_tok").alias("tok")).distinct(), "tok", "left_semi")


def flag_samples(samples: DataFrame, found: DataFrame) -> DataFrame:
    """idx of samples with any trigger token. The few triggers are a bounded list."""
    names = F.array_sort(F.collect_set("tok"))
    return samples.crossJoin(F.broadcast(found.agg(names.alias("__x")))).where(F.arrays_overlap(F.transform("tokens", T.strip_prefix), "__x")).select("idx")


def joined_triggers(found: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("rank", "tok")))
    return found.agg(F.count(F.lit(1)).alias("n_triggers"), F.array_join(F.transform(ordered, lambda x: x["tok"]), "|").alias("triggers"))


def hashed_grams(grams: DataFrame, order: int = 4) -> DataFrame:
    """size, key, log_p, log_b. grams: smoothed(), or kneser_ney() with its tokens; hashed on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, size = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            for c in range(order):
                of = batch.column(c).to_numpy(zero_copy_only=False).view(np.uint64)
                key = key * np.uint64(0x9E3779B97F4A7C15) ^ of  # zeros on the left leave it 0
                size += of != 0
            yield pa.RecordBatch.from_arrays([pa.array(size), pa.array(key.view(np.int64)), batch.column(order), batch.column(order + 1)], names=["size", "key", "log_p", "log_b"])

    c = _hash_columns(order) if "gram" in grams.columns else _columns(order)
    return grams.select(*c, "log_p", "log_b").mapInArrow(run, "size int, key long, log_p double, log_b double")


def hashed_model(grams: DataFrame, order: int = 4) -> NgramModel:
    """grams: smoothed() or kneser_ney(). The driver gets 28 bytes for each as Arrow columns."""
    got = hashed_grams(grams, order).toArrow()
    size, key, p, b = (got.column(c).to_numpy() for c in ("size", "key", "log_p", "log_b"))
    return NgramModel(size, key.view(np.uint64), p, b, order)


def fit_model(clean: DataFrame, tokens: str = "tokens", settings: Naturalness = Naturalness()) -> NgramModel:
    """clean: the bounded sample (settings.clean snippets of at most settings.max_tokens tokens) of clean snippets."""
    return hashed_model(smoothed(saved(window_counts(clean, tokens, settings.order)), settings.order), settings.order)
