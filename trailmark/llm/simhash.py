"""Near duplicates by SimHash, with a byte-position inverted index and count filtering.

Two 64-bit fingerprints that differ in at most 3 bits share at least 5 of their 8 bytes. An index on single bytes would
have 2,048 lists that grow with the corpus, and every list would be paired with itself. The index here posts each
fingerprint under 8 triples of byte positions instead: all triples within bytes 0-3 and within bytes 4-7. Of any 5 shared
bytes, 3 lie in one half, so each link shares a posting, and the lists are 65,536 times shorter. The tally of shared
bytes is then taken for the pairs of a list: only pairs with 5 or more are verified by their differing bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved
from .graph import connected_components

MAX_BITS = 3
SHARED_BYTES = 8 - MAX_BITS
SHINGLE = 3
SEED = 42
TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
#: Fingerprints of one posting list that a task compares at a time; longer lists are compared block by block.
BLOCK = 4096
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text, 0 for one without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return 0
    joined, n = b" ".join(found), len(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, n)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    first, last = starts[: n - k + 1], ends[k - 1 :]
    for at in range(0, len(first), CHUNK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(first[at : at + CHUNK].tolist(), last[at : at + CHUNK].tolist(), strict=True)]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column becomes fp."""
    for batch in batches:
        made = np.array([fingerprint(x.as_py()) for x in batch.columns[-1]], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made)], names=[*batch.schema.names[:-1], "fp"])


def near(x: np.ndarray) -> np.ndarray:
    """Of XORs of fingerprints, which are of links. Shared bytes are tallied for each pair; only pairs that reach the
    guaranteed minimum are verified by their differing bits."""
    tally = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    some = np.flatnonzero(tally >= SHARED_BYTES)
    out = np.zeros(x.size, bool)
    out[some] = np.bitwise_count(x.reshape(-1)[some]) <= MAX_BITS
    return out.reshape(x.shape)


def _forest(fps: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join each component among the fingerprints of a list; fewer than fingerprints."""
    left, a, b = fps, [], []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            some, front = front[:64], front[64:]
            ok = near(some[:, None] ^ left[None, :])
            hit = ok.any(axis=0)
            a.append(some[ok.argmax(axis=0)[hit]])
            b.append(left[hit])
            front, left = np.concatenate([front, left[hit]]), left[~hit]
    return a, b


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by posting list; a list may run on into the next batch."""
    keys, fps = np.zeros((0, 2), np.int64), np.zeros(0, np.uint64)

    def linked(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        sizes = np.diff(np.append(starts, len(fps)))
        two = starts[sizes == 2]
        ok = near(fps[two] ^ fps[two + 1])
        a, b = [fps[two][ok]], [fps[two + 1][ok]]
        for at, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            x, y = _forest(fps[at : at + n])
            a += x
            b += y
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        more = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        keys, fps = np.concatenate([keys, more]), np.concatenate([fps, batch.column(2).to_numpy().view(np.uint64)])
        whole = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1))
        if len(whole):
            cut = whole[-1] + 1
            yield linked(keys[:cut], fps[:cut])
            keys, fps = keys[cut:], fps[cut:]
    if len(fps):
        yield linked(keys, fps)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """fps: distinct fingerprints in a column fp. Returns a, b: links that join every two fingerprints which differ in at
    most 3 bits, directly or through others that do."""
    byte = [F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)) for i in range(8)]
    keys = [F.lit(k << 24) + byte[x] * F.lit(1 << 16) + byte[y] * F.lit(1 << 8) + byte[z] for k, (x, y, z) in enumerate(TRIPLES)]
    posted = fps.select("fp", F.explode(F.array(*[k.cast("long") for k in keys])).alias("key"))
    sizes = posted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("long")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.least(j, F.col("mine")) * F.col("blocks") + F.greatest(j, F.col("mine")))
    dealt = posted.join(sizes, "key").withColumn("blocks", blocks).withColumn("mine", mine).select("key", F.explode(pairs).alias("part"), "fp")
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "key", "part").sortWithinPartitions("key", "part").select("key", "part", "fp").mapInArrow(_links, "a long, b long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long), component_id (smallest id reachable): a row for each row.
    With row_col, a column that tells rows apart, also that column and `first`: whether the row stands first in its component,
    by id (null last) and then row.

    Exact copies meet in one fingerprint before the index is built, so a group of any size costs one posting. Null and
    empty texts have fingerprint 0 and link like any other; repeated rows come back repeated; null ids stay null and count
    for no component_id unless a component has no other id. Other columns of docs are ignored; an empty table gives an empty
    one.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row, F.col(text_col).alias("text"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]]
    rows = saved(given.mapInArrow(_fingerprints, ", ".join([*kinds, "fp long"])))
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("id"), *(["row"] if row_col else []))
    classes = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.min(place).alias("best")))
    roots = saved(connected_components(fingerprint_links(classes.select("fp")))).withColumnRenamed("node", "fp")
    rooted = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.min("best").alias("best"))
    named = rooted.select("fp", "root").join(least, "root").select("fp", "component_id", "best")
    out = rows.join(named, "fp").select("doc_id", *(["row"] if row_col else []), "fp", "component_id", (place == F.col("best")).alias("first"))
    return out.withColumnRenamed("row", row_col) if row_col else out.drop("first")


def hex16(fp: F.Column) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
