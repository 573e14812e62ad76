"""Token counts from flat token files: a scan for end-of-document ids, stitched across blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallylane.llm.shared import materialise, new_folder, text_of

#: Tokens of a block, the unit of a scan.
BLOCK = 1 << 22
_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """Byte-pair encoder of a rank file; the id behind its last rank is free to end documents."""
    if path not in _ENCODERS:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Write flat files of little-endian 16-bit ids below `folder`, one for each task, each document followed by `end_id`.

    Returns the files (file number, path, tokens), and which document is which of a file (file, ordinal, key).  The files hold nothing
    but ids.  A file gets its name when it is whole, so that a task may fail and run again.
    """
    kind = docs.schema[key].dataType.simpleString()

    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        name, encode = f"part-{task.partitionId():06d}.u16", encoder(tokenizer)
        out, size, ordinal = None, 0, 0
        for batch in it:
            if out is None and batch.num_rows:
                out = system.open_output_stream(f"{base}/.{name}-{task.taskAttemptId()}", compression=None)
            for body in batch.column(1):
                ids = np.array([*encode.encode_ordinary(body.as_py()), end_id], "<u2")
                out.write(ids.tobytes())
                size += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, task.partitionId(), np.int32)), pa.array(np.arange(ordinal, ordinal + batch.num_rows)), batch.column(0), pa.nulls(batch.num_rows, pa.int64())], names=["file", "ordinal", key, "tokens"])
            ordinal += batch.num_rows
        if out is not None:
            out.close()
            system.move(f"{base}/.{name}-{task.taskAttemptId()}", f"{base}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, batch.column(0).type), pa.array([size], pa.int64())], names=["file", "ordinal", key, "tokens"])

    both = materialise(docs.select(key, text_of(text).alias("__text")).mapInArrow(write, f"file int, ordinal long, `{key}` {kind}, tokens long"))
    files = both.where("tokens is not null").select("file", F.format_string(f"{folder}/part-%06d.u16", "file").alias("path"), "tokens")
    return files, both.where("ordinal is not null").select("file", "ordinal", key)


def scan_blocks(files: DataFrame, end_id: int, block: int = BLOCK) -> DataFrame:
    """One row for each block: file, block, tokens, n_ends, head (tokens before the first separator), tail (tokens behind
    the last), and the lengths between the block's own separators, each with its separator left out.

    A block without a separator is all tail.  Blocks are cut by size alone: they may begin anywhere in a document.
    """
    blocks = files.select("file", "path", "tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tokens") - 1, F.lit(block).cast("long"))).alias("begin"))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for file, path, tokens, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, place = _filesystem(path)
                with system.open_input_file(place) as f:
                    ids = np.frombuffer(f.read_at(2 * min(block, tokens - begin), 2 * begin), "<u2")
                ends = np.flatnonzero(ids == end_id)
                inner = np.diff(ends) - 1
                head, tail = (int(ends[0]), len(ids) - 1 - int(ends[-1])) if len(ends) else (0, len(ids))
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([begin // block]), pa.array([len(ends)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([inner.tolist()], pa.list_(pa.int64()))], names=["file", "block", "n_ends", "head", "tail", "inner"])

    return blocks.repartition("file", "begin").mapInArrow(scan, "file int, block long, n_ends long, head long, tail long, inner array<long>")


def count_tokens(files: DataFrame, end_id: int, block: int = BLOCK) -> DataFrame:
    """Columns file, ordinal, n_tokens (separator left out) for each document of the files.

    Within a file, a prefix scan over its blocks gives each block the documents ended before it and the
    tokens still open: the tails of the blocks since the last one with a separator.  Only the first document
    that a block ends needs them.  What stands behind a file's last separator is no document and gives no row.
    """
    rows = materialise(scan_blocks(files, end_id, block))
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum("n_ends").over(before), F.lit(0))
    # blocks with a separator up to this one: its tail and those of the blocks behind it, up to the next such one, add up
    since = F.sum((F.col("n_ends") > 0).cast("long")).over(order)
    still_open = F.sum("tail").over(Window.partitionBy("file", "since").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    carried = rows.drop("inner").withColumns({"ended": ended, "since": since}).withColumn("open", still_open).withColumn("carry", F.coalesce(F.lag("open").over(order), F.lit(0)))
    ends = rows.select("file", "block", "head", "inner").join(carried.where("n_ends > 0").select("file", "block", "ended", "carry"), ["file", "block"])
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), F.col("inner"))
    return ends.select("file", "ended", F.posexplode(lengths).alias("at", "n_tokens")).select("file", (F.col("ended") + F.col("at")).alias("ordinal"), "n_tokens")


def document_tokens(docs: DataFrame, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Write the documents' tokens to flat files, count them by a separator scan, and name the documents again.

    Columns: key, file, ordinal, n_tokens.  Null and empty texts have no token; null and repeated keys and
    other columns do not matter; an empty table gives no row.
    """
    files, names = write_tokens(docs, new_folder(docs.sparkSession, "tokens"), tokenizer, end_id, key, text)
    return names.join(count_tokens(files, end_id, block), ["file", "ordinal"]).select(key, "file", "ordinal", "n_tokens")


def digest(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return document_tokens(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), 50256).select("doc_id", "n_tokens")
