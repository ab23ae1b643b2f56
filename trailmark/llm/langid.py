"""Language identification by prediction by partial matching (PPM) over bytes, with frozen statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import FIT_BYTES, bounded_sample, bounded_texts, crc_mod, saved, small

ORDER = 4
#: Labelled texts of each language that the statistics may use, about; bytes of text of each language, unless many languages
#: share FIT_BYTES.
EXAMPLES, LANGUAGE_BYTES = 400, 512 << 10
#: A letter of any script: Unicode's category L. Fractions and superscripts are none.
_LETTER = regex.compile(r"\p{L}")
#: Bytes whose code lengths are computed at a time, so many table cells at most.
CHUNK, CELLS = 1 << 18, 1 << 22
#: Bits of a symbol in a code of several.
BITS = 9


class PpmModel:
    """For each language a context tree, up to `order` bytes deep, kept as sparse lists.

    Escape probabilities follow method C: in a context seen n times with d different next bytes, a seen byte has
    probability count/(n+d) and the escape d/(n+d), which leads to the next shorter context; below order 0 all 256 bytes
    are alike. Contexts that a language hasn't seen escape at no cost. Statistics are frozen, so the code length of a byte
    depends on its last `order` bytes alone. For each depth there are two sorted tables, of contexts (what escaping costs) and
    of contexts with their next byte (what that byte costs); an entry lists only the languages that have it. Memory follows
    the bytes of text that each language was learned from, not contexts times symbols times languages.
    """

    def __init__(self, texts: dict[str, list[str]], order: int = ORDER):
        self.langs, self.order = sorted(texts), order
        kinds: list[list] = [[[], [], []] for _ in range(2 * (order + 1))]  # of each table: codes, languages, costs
        for j, k in enumerate(self.langs):
            codes = self._codes([x.encode("utf-8", "surrogatepass") for x in texts[k]])
            for n in range(order + 1):
                gram, count = np.unique(codes & ((1 << BITS * (n + 1)) - 1), return_counts=True)
                ctx, first, seen = np.unique(gram >> BITS, return_index=True, return_counts=True)
                total = np.add.reduceat(count, first) if len(first) else count
                whole = np.repeat(total + seen, seen)
                for table, code, cost in ((2 * n, gram, np.log2(whole) - np.log2(count)), (2 * n + 1, ctx, np.log2(total + seen) - np.log2(seen))):
                    kinds[table][0].append(code)
                    kinds[table][1].append(np.full(len(code), j, np.int32))
                    kinds[table][2].append(cost.astype(np.float32))
        self.tables = []
        for codes, langs, costs in kinds:
            code = np.concatenate([*codes, np.zeros(0, np.int64)])
            by = np.argsort(code, kind="stable")
            known, at = np.unique(code[by], return_index=True)
            self.tables.append((known, np.append(at, len(code)), np.concatenate([*langs, np.zeros(0, np.int32)])[by], np.concatenate([*costs, np.zeros(0, np.float32)])[by]))

    def _codes(self, texts: list[bytes]) -> np.ndarray:
        """For each byte of the texts its code: itself and the bytes before it, `order` of them; zeros stand before a text."""
        gap = b"\0" * self.order
        x = np.frombuffer(gap + gap.join(texts), np.uint8).astype(np.int64) + 1
        size = np.fromiter((len(t) + self.order for t in texts), np.int64, len(texts))
        start = np.cumsum(size) - size
        inside = np.ones(len(x), bool)
        for i in range(self.order):
            x[start + i] = 0
            inside[start + i] = False
        inside[: self.order] = False
        code = np.zeros(len(x), np.int64)
        for back in range(self.order, -1, -1):
            code = code << BITS
            code[back:] |= x[: len(x) - back] if back else x
        return code[inside]

    def costs(self, codes: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each code under each language: down from the longest context, paying for each escape."""
        bits = np.zeros((len(codes), len(self.langs)), np.float64)
        done = np.zeros(bits.shape, bool)
        for n in range(self.order, -1, -1):
            for table, code, ends in ((2 * n, codes & ((1 << BITS * (n + 1)) - 1), True), (2 * n + 1, (codes >> BITS) & ((1 << BITS * n) - 1), False)):
                known, at, lang, cost = self.tables[table]
                if not len(known):
                    continue
                place = np.minimum(np.searchsorted(known, code), len(known) - 1)
                row = np.flatnonzero(known[place] == code)
                start = at[place[row]]
                size = at[place[row] + 1] - start
                entry = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
                row, col, paid = np.repeat(row, size), lang[entry], cost[entry]
                open_ = ~done[row, col]
                row, col = row[open_], col[open_]
                bits[row, col] += paid[open_]
                if ends:
                    done[row, col] = True
        bits[~done] += 8
        return bits

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language, and its bytes in a last column. Equal codes are looked up once."""
        raw = [x.encode("utf-8", "surrogatepass") for x in texts]
        out = np.zeros((len(raw), len(self.langs) + 1))
        out[:, -1] = [len(x) for x in raw]
        step = max(1024, min(CHUNK, CELLS // max(1, len(self.langs))))
        codes = self._codes(raw)
        of = np.repeat(np.arange(len(raw)), out[:, -1].astype(np.int64))
        for at in range(0, len(codes), step):
            kinds, back = np.unique(codes[at : at + step], return_inverse=True)
            text = of[at : at + step]
            first = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[first], :-1] += np.add.reduceat(self.costs(kinds)[back], first, axis=0)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language of the shortest code, and its share under code lengths averaged over the root of the length."""
        some = [i for i, x in enumerate(texts) if x and self.langs and _LETTER.search(x)]
        out = [("und", 0.0)] * len(texts)
        at = 0
        while at < len(some):  # as many texts at a time as make up a chunk, or one long text
            to, size = at, 0
            while to < len(some) and (to == at or size + len(texts[some[to]]) <= CHUNK):
                size += len(texts[some[to]])
                to += 1
            for i, row in zip(some[at:to], self.code_lengths([texts[i] for i in some[at:to]]), strict=True):
                bits = row[:-1]
                odds = np.exp2(-(bits - bits.min()) / np.sqrt(row[-1]))
                best = int(bits.argmin())
                out[i] = (self.langs[best], float(odds[best] / odds.sum()))
            at = to
        return out


def fit_langid(docs: DataFrame, examples: int = EXAMPLES, folds: int = 3, held: int = 1) -> PpmModel:
    """Fits on a bounded sample (`examples` texts and LANGUAGE_BYTES of each language) of the rows outside the held-out fold."""
    ids = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != held)).select("doc_id", "lang").distinct()
    picked = saved(bounded_sample(saved(ids), "doc_id", "lang", examples))
    texts = saved(docs.select("doc_id", "lang", "text").where("text is not null").join(small(picked), ["doc_id", "lang"]))
    n = texts.select("lang").distinct().count()
    learned: dict[str, list[str]] = {}
    for r in bounded_texts(texts, "doc_id", "lang", min(LANGUAGE_BYTES, FIT_BYTES // max(1, n))).orderBy("lang", "doc_id", "text").select("lang", "text").toLocalIterator():
        learned.setdefault(r["lang"], []).append(r["text"])
    return PpmModel(learned)


def identify_language(docs: DataFrame, model: PpmModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score: a row for each row, by whole texts, without a shuffle.

    Null texts, texts without a letter, and any text where nothing could be learned are `und` with score 0. Null ids and
    repeated rows stay; other columns are ignored; an empty table gives an empty one. Equal code lengths go to the first
    language by code point. A long text costs memory by its bytes, 30 for each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = model.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
