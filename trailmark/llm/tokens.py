"""Token counts from flat token files: a vectorised separator scan in byte ranges, stitched by a prefix scan."""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import made_dir, running, saved

#: Vocabulary file, in tiktoken's format, which every executor has; its last id + 1 is free and ends a document.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ids of a range that is read at a time.
BLOCK = 1 << 21
#: Ranges of a file that are run up together.
CHUNK = 1024
#: Characters that are encoded at a time.
PIECE = 1 << 18
_CUT = regex.compile(r"(?<=\p{L}) (?=\p{L})")


@functools.lru_cache(maxsize=2)
def _encoding(path: str) -> tuple[tiktoken.Encoding, int]:
    import public_tokenizers

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def width_of(eod: int) -> int:
    """Bytes of an id in a flat file."""
    return 2 if eod < 1 << 16 else 4


def _file(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))


def write_token_files(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """Tokenises texts into flat files in the shared folder: little-endian ids of two or four bytes, an end-of-document id
    after each text, no index.

    Returns the files (shard, path, n_bytes), the order in which each holds the documents (shard, ordinal, doc_id), and the
    end-of-document id. Each task writes a file of its own, named after its attempt: only files of attempts that Spark has
    accepted are in the table, so a lost executor or a repeated task leaves no document twice. Null texts count as empty.
    Texts are split for encoding only where the tokenizer would split them anyway, before a space between letters.
    """
    eod, root = _encoding(vocabulary)[1], made_dir(docs.sparkSession)
    dtype = f"<u{width_of(eod)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        (enc, end), task, ordinal, size, out = _encoding(vocabulary), TaskContext.get(), 0, 0, None
        shard, path = task.partitionId(), f"{root}/{task.partitionId()}-{task.taskAttemptId()}.bin"
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

        def rows(*columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "path", "n_bytes", "ordinal", "doc_id"])

        for batch in batches:
            if out is None:
                to, at = _file(path)
                out = to.open_output_stream(at)
            for x in batch.column(1):
                for piece in pieces(x.as_py() or ""):
                    size += out.write(np.array(enc.encode_ordinary(piece), dtype).tobytes())
                size += out.write(np.array([end], dtype).tobytes())
            n, none = batch.num_rows, [None] * batch.num_rows
            yield rows([shard] * n, none, none, list(range(ordinal, ordinal + n)), batch.column(0).to_pylist())
            ordinal += n
        if out is not None:
            out.close()
            yield rows([shard], [path], [size], [None], [None])

    made = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "shard int, path string, n_bytes long, ordinal long, doc_id long")
    made = saved(made)
    return made.where("path is not null").select("shard", "path", "n_bytes"), made.where("path is null").select("shard", "ordinal", "doc_id"), eod


def pieces(text: str) -> Iterator[str]:
    """Cuts a long text before spaces between letters, where byte-level BPE starts a new word in any case: at the last such
    place within PIECE characters, else at the first one beyond."""
    at = 0
    while len(text) - at > PIECE:
        cut = None
        for back in (1 << 10, PIECE - 1):  # most texts have a place near the end
            for found in _CUT.finditer(text, at + PIECE - min(back, PIECE - 1), at + PIECE):
                cut = found.start()
            if cut is not None:
                break
        if cut is None:
            if not (found := _CUT.search(text, at + PIECE - 1)):
                break
            cut = found.start()
        yield text[at:cut]
        at = cut
    yield text[at:]


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """shard (the file's path), path, n_bytes of flat token files. Their contents aren't read; files may be of any size."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("shard"), "path", F.col("length").alias("n_bytes"))


def separator_scan(files: DataFrame, eod: int, width: int, block: int = BLOCK) -> DataFrame:
    """shard, ordinal, n_tokens: the length of every document of a flat token stream, without its separator.

    files: shard, path, n_bytes. Files are read in ranges of `block` ids, dealt over all tasks, so that one large file isn't
    one task's. A range is searched for the separator at once and leaves the gaps between its separators, its size and the
    tail after the last one. A prefix scan over these few numbers, by chunks of ranges, gives a range's first ordinal and
    the length that runs into it. Ids after a file's last separator are a document without an end and are counted as one.
    Empty files have no rows. A file that ends within an id raises.
    """
    dtype, step = f"<u{width}", block * width
    n = F.ceil(F.col("n_bytes") / F.lit(step)).cast("long")
    no = F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    ranges = files.where("n_bytes > 0").select("shard", "path", "n_bytes", no.alias("block_no"))
    tasks = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, source = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard, path, n_bytes, k = (c[i].as_py() for c in batch.columns)
                if path != at:
                    where, name = _file(path)
                    at, source = path, where.open_input_file(name)
                if n_bytes % width:
                    raise ValueError(f"{path}: {n_bytes} bytes are no whole ids")
                ids = np.frombuffer(source.read_at(min(step, n_bytes - k * step), k * step), dtype)
                ends = np.flatnonzero(ids == eod)
                gaps, tail = np.diff(ends, prepend=-1) - 1, len(ids) - 1 - (ends[-1] if len(ends) else -1)
                last = (k + 1) * step >= n_bytes
                arrays = [pa.array([shard], batch.column(0).type), pa.array([k]), pa.array([gaps], pa.list_(pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([int(tail)], pa.int64()), pa.array([last])]
                yield pa.RecordBatch.from_arrays(arrays, names=["shard", "block_no", "gaps", "size", "tail", "is_last"])

    kind = files.schema["shard"].dataType.simpleString()
    found = saved(ranges.repartition(tasks, "shard", "block_no").mapInArrow(scan, f"shard {kind}, block_no long, gaps array<bigint>, size long, tail long, is_last boolean"))
    few = found.select("shard", "block_no", F.size("gaps").cast("long").alias("n"), "size", "tail", "is_last", F.floor(F.col("block_no") / F.lit(CHUNK)).alias("chunk"))
    up = lambda df, value, out, fold=F.sum: running(df, ["shard"], ["chunk"], F.col(value), [F.col("block_no")], out, fold)
    few = saved(up(up(few, "n", "first"), "size", "before"))
    few = few.withColumn("done", F.when(F.col("n") > 0, F.col("before") + F.col("size") - F.col("tail")).otherwise(F.lit(0)))
    few = up(few, "done", "ended", F.max)  # ids up to the last separator before the range
    carry = F.col("before") - F.col("ended")
    open_ = F.when(F.col("n") > 0, F.col("tail")).otherwise(carry + F.col("size"))
    summary = few.select("shard", "block_no", "first", carry.alias("carry"), F.when(F.col("is_last") & (open_ > 0), open_).alias("open"))
    lengths = F.transform("gaps", lambda g, i: g + F.when(i == 0, F.col("carry")).otherwise(F.lit(0)))
    lengths = F.when(F.col("open").isNotNull(), F.concat(lengths, F.array("open"))).otherwise(lengths)
    out = found.select("shard", "block_no", "gaps").join(summary, ["shard", "block_no"]).select("shard", "first", F.posexplode(lengths).alias("i", "n_tokens"))
    return out.select("shard", (F.col("first") + F.col("i")).cast("long").alias("ordinal"), F.col("n_tokens").cast("long").alias("n_tokens"))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens: a row for each row, counted in the flat files that the texts are written to.

    Null and empty texts have 0 tokens; null ids and repeated rows stay; other columns are ignored; an empty table gives an
    empty one. A text of any length is encoded in pieces and may run over any number of ranges.
    """
    files, order, eod = write_token_files(docs, vocabulary, id_col, text_col)
    return separator_scan(files, eod, width_of(eod)).join(order, ["shard", "ordinal"]).select("doc_id", "n_tokens")
