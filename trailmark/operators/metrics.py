"""Output quality: n-gram BLEU, exact match, edit similarity and target containment."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import indel_ratio

TINY = sys.float_info.min


def ngrams(tokens: Column, order: int) -> Column:
    """All n-grams of orders 1 to `order`, each as an array."""
    of = lambda n: F.when(F.size(tokens) >= n, F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.slice(tokens, i, F.lit(n)))).otherwise(F.array().cast("array<array<string>>"))
    return F.concat(*[of(n) for n in range(1, order + 1)])


def ngram_counts(rows: DataFrame, tokens: str, order: int = 4, key: str = "idx") -> DataFrame:
    return rows.select(key, F.explode(ngrams(F.col(tokens), order)).alias("gram")).groupBy(key, "gram").agg(F.count(F.lit(1)).alias("n"))


def shared_ngrams(pred: list[str], ref: list[str], order: int) -> list[int]:
    """For n from 1 to order: how many n-grams the texts share, each as often as the rarer side has it.

    Tokens become numbers, an n-gram the pair of its first n-1 tokens' number and its last token: exact, without hashes.
    """
    ids: dict[str, int] = {}
    a, b = (np.fromiter((ids.setdefault(t, len(ids)) for t in x), np.int64, len(x)) for x in (pred, ref))
    out, x, y = [], a, b
    for n in range(1, order + 1):
        if not len(x) or not len(y):
            return out + [0] * (order - len(out))
        kinds, at = np.unique(np.concatenate([x, y]), return_inverse=True)
        p, r = at[: len(x)], at[len(x) :]
        out.append(int(np.minimum(np.bincount(p, minlength=len(kinds)), np.bincount(r, minlength=len(kinds))).sum()))
        x, y = p[:-1] * len(ids) + a[n:], r[:-1] * len(ids) + b[n:]
    return out


def _lists(column: pa.ListArray) -> Iterator[pa.Array]:
    """The words of each row as a slice without a copy, empty for null."""
    ends, null = column.offsets.to_numpy(), column.is_null().to_numpy(zero_copy_only=False)
    for i in range(len(column)):
        yield column.values.slice(ends[i], 0 if null[i] else ends[i + 1] - ends[i])


def _shared(pred: pa.Array, ref: pa.Array, order: int) -> list[int]:
    """shared_ngrams(). Of a text that begins or ends the other one, as of an equal one, all n-grams are shared."""
    a, b = (pred, ref) if len(pred) <= len(ref) else (ref, pred)
    if a.equals(b.slice(0, len(a))) or a.equals(b.slice(len(b) - len(a))):
        return [max(len(a) - n, 0) for n in range(order)]
    return shared_ngrams(pred.to_pylist(), ref.to_pylist(), order)


def match_counts(pairs: DataFrame, pred: str, ref: str, order: int = 4, key: str = "idx") -> DataFrame:
    """key, test_len, ref_len, correct (array by order): counted within each pair, so that no n-gram is shuffled.

    Null texts count as empty.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # One pair's words in memory at a time.
            made = [(len(p), len(r), _shared(p, r, order)) for p, r in zip(_lists(batch.column(1)), _lists(batch.column(2)), strict=True)]
            sizes = [pa.array([x[i] for x in made], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sizes, pa.array([x[2] for x in made], pa.list_(pa.int64()))], names=[key, "test_len", "ref_len", "correct"])

    kind = pairs.schema[key].dataType.simpleString()
    return pairs.select(key, pred, ref).mapInArrow(run, f"`{key}` {kind}, test_len long, ref_len long, correct array<long>")


def clipped_counts(pairs: DataFrame, pred: str, ref: str, order: int = 4, key: str = "idx") -> DataFrame:
    """key, n (order), correct, guess: matches clipped by the reference, and possible matches, for each pair."""
    each = match_counts(pairs, pred, ref, order, key).select(key, "test_len", "ref_len", F.posexplode("correct").alias("pos", "correct"))
    guess = F.greatest(F.col("test_len") - F.col("pos"), F.lit(0)).cast("long")
    return each.select(key, (F.col("pos") + 1).alias("n"), "test_len", "ref_len", "correct", guess.alias("guess"))


def corpus_bleu(pairs: DataFrame, pred: str, ref: str, order: int = 4) -> DataFrame:
    """bleu4: 100 times corpus BLEU with every order smoothed by one; null without predicted or reference tokens."""
    per = clipped_counts(pairs, pred, ref, order).groupBy("n").agg(F.sum("correct").alias("c"), F.sum("guess").alias("g"), F.sum("test_len").alias("t"), F.sum("ref_len").alias("r"))
    geo = F.exp(F.avg(F.ln((F.col("c") + 1.0) / (F.col("g") + 1.0))))
    one = per.agg(geo.alias("geo"), F.max("t").alias("t"), F.max("r").alias("r"))
    ratio = F.col("t") / F.col("r")
    bp = F.when(ratio > 1, 1.0).otherwise(F.exp(1 - F.col("r") / F.col("t")))
    return one.select(F.when((F.col("t") > 0) & (F.col("r") > 0), F.round(100 * F.col("geo") * bp, 6)).alias("bleu4"))


def sentence_bleu(pairs: DataFrame, pred: str, ref: str, order: int = 4) -> DataFrame:
    """idx, bleu: each pair's BLEU, orders above 1 smoothed by one."""

    def term(c: Column, i: Column) -> Column:
        add = F.when(i > 0, 1.0).otherwise(0.0)
        return F.ln(c + add + TINY) - F.ln(F.greatest(F.col("test_len") - i, F.lit(0)) + add + TINY)

    log = F.aggregate(F.transform("correct", term), F.lit(0.0), lambda s, x: s + x) / order
    short = F.least(F.lit(0.0), 1 - (F.col("ref_len") + 1) / (F.col("test_len") + 1))
    return match_counts(pairs, pred, ref, order).select("idx", F.exp(log + short).alias("bleu"))


def bleu4_smooth(pairs: DataFrame) -> DataFrame:
    """bleu4_smooth: the mean over pairs (idx, pred, ref) of sentence BLEU after NIST tokenisation, times 100."""
    cut = pairs.select("idx", T.nist(T.split_puncts("pred")).alias("p"), T.nist(T.split_puncts("ref")).alias("r"))
    return sentence_bleu(cut, "p", "r").agg(F.round(100 * F.avg("bleu"), 6).alias("bleu4_smooth"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{T.SPACE}+|{T.SPACE}+$", "")


def exact_match(pred: Column, ref: Column, mode: str = "strip") -> Column:
    """Percentage of equal pairs: of stripped texts, or of their words after completion literals are expanded."""
    if mode == "token":
        pred, ref = (F.array_join(T.words(T.expand_literals(x)), " ") for x in (pred, ref))
    else:
        pred, ref = _strip(pred), _strip(ref)
    return 100 * F.avg((pred == ref).cast("int"))


def containment_rate(pred: Column, target: Column) -> Column:
    """Percentage of predictions that hold the target: attack success per row's target, false triggers with a constant."""
    return 100 * F.avg(T.contains_target(pred, target).cast("int"))


def edit_similarity(pairs: DataFrame) -> DataFrame:
    return pairs.select(indel_ratio(_strip(F.col("pred")), _strip(F.col("ref"))).alias("s")).agg(F.round(F.avg("s"), 6).alias("edit_sim"))


def clean_metrics(pairs: DataFrame, target: str) -> DataFrame:
    """All metrics in one row, for every task. pairs: idx, pred, ref, joined by idx."""
    plain = pairs.agg(
        F.count(F.lit(1)).alias("n"),
        F.round(exact_match(F.col("pred"), F.col("ref")), 6).alias("em_strip"),
        F.round(exact_match(F.col("pred"), F.col("ref"), "token"), 6).alias("em_token"),
        F.round(containment_rate(F.col("pred"), F.lit(target)), 6).alias("ftr"),
    )
    cut = pairs.select("idx", T.words(F.col("pred")).alias("p"), T.words(F.col("ref")).alias("r"))
    return plain.crossJoin(bleu4_smooth(pairs)).crossJoin(corpus_bleu(cut, "p", "r")).crossJoin(edit_similarity(pairs))  # single rows


def paired(preds: DataFrame, refs: DataFrame) -> DataFrame:
    """Predictions and references by idx; raises if either side lacks one, where a positional join would cut silently."""
    both = preds.join(refs, "idx", "full_outer")
    if both.where(F.col("pred").isNull() | F.col("ref").isNull()).limit(1).count():
        raise ValueError("predictions and references don't hold the same samples")
    return both
