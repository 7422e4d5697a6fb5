"""Token counts of flat token files by a separator scan.

A flat file is token ids and nothing else; documents end at an end-of-document id.  Files are cut into
blocks of a fixed number of ids wherever that falls, each block is searched for the id with one
vectorised comparison, and a prefix scan over the blocks' summaries (how many separators, where the
last one was) numbers the documents and stitches those that cross blocks.  The scan's window has one
row for each block, not for each document.

Files keep no index: the writer also returns which document went where, as a stored table, for those
who want ids back.  A document without ids has a count of 0; ids after the last separator are a
document that is not closed; a file's size must be a whole number of ids.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, kit


def _flat_writer(folder: str, tokenizer: str, separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(tokenizer, specials=False)
        fs, root = kit.filesystem(folder)
        fs.create_dir(root, recursive=True)
        name, sink, n = f"{uuid.uuid4().hex}.bin", None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            sink = sink or fs.open_output_stream(f"{root}/{name}")
            ids, at = coder.encode_column(batch.column("text"))
            sink.write(np.insert(ids, at[1:], np.uint16(separator)).astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([name] * batch.num_rows), pa.array(np.arange(n, n + batch.num_rows)), batch.column("doc_id")], names=["path", "ordinal", "doc_id"])
            n += batch.num_rows
        if sink:
            sink.close()

    return run


def write_flat_files(docs: DataFrame, folder: str, *, tokenizer: str, separator: int) -> DataFrame:
    """Write the ids of docs (doc_id, text) as flat little-endian u16 files, one for each partition.

    Special tokens' strings in a text are ordinary text, so the separator occurs between documents
    only.  Returns (path, ordinal, doc_id), a stored table: files it does not name do not count.
    """
    kit.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.stored(docs.mapInArrow(kit.tidy(_flat_writer(folder, tokenizer, separator)), "path string, ordinal long, doc_id long"), "flat-manifest")


def _measurer(folder: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = kit.filesystem(folder)
        for batch in batches:
            names = batch.column("path").to_pylist()
            sizes = [x.size for x in fs.get_file_info([f"{root}/{n}" for n in names])]
            if any(s is None or s % width for s in sizes):
                raise ValueError("a token file is missing or holds part of an id")
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([s // width for s in sizes], pa.int64())], names=["path", "n_ids"])

    return run


def _searcher(folder: str, separator: int, dtype: str, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = kit.filesystem(folder)
        width = np.dtype(dtype).itemsize
        for batch in batches:
            for path, k in zip(batch.column("path").to_pylist(), batch.column("block").to_pylist(), strict=True):
                with fs.open_input_file(f"{root}/{path}") as source:
                    source.seek(k * block * width)
                    ids = np.frombuffer(source.read(block * width), dtype=dtype)
                found = np.flatnonzero(ids == separator) + k * block
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["path", "block", "ends"])

    return run


def count_tokens(files: DataFrame, folder: str, *, separator: int, dtype: str = "<u2", block: int = 1 << 20) -> DataFrame:
    """(path, ordinal, start, n_tokens, closed) of every document in the flat files (path) of a folder.

    n_tokens leaves the separator out.
    """
    sized = kit.stored(files.select("path").distinct().mapInArrow(kit.tidy(_measurer(folder, np.dtype(dtype).itemsize)), "path string, n_ids long"), "flat-sizes")
    blocks = sized.where("n_ids > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_ids") - 1) / block))).alias("block"))
    parts = max(1, min(10_000, blocks.count() // 4))  # a number of its own: rows this few would be read by one task
    ends = kit.stored(blocks.repartition(parts, "path", "block").mapInArrow(kit.tidy(_searcher(folder, separator, dtype, block)), "path string, block long, ends array<long>"), "flat-ends")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scan = ends.select("path", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    scan = scan.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    stitched = ends.join(scan, ["path", "block"]).select("path", "base", F.posexplode("ends").alias("i", "end"), F.when(F.col("i") > 0, F.get("ends", F.col("i") - 1)).otherwise(F.col("carry")).alias("prior"))
    closed = stitched.select("path", (F.col("base") + F.col("i")).alias("ordinal"), (F.col("prior") + 1).alias("start"), (F.col("end") - F.col("prior") - 1).alias("n_tokens"), F.lit(True).alias("closed"))
    last = ends.groupBy("path").agg(F.sum(F.size("ends")).alias("ordinal"), F.max(F.try_element_at("ends", F.lit(-1))).alias("last"))
    rest = sized.join(last, "path").withColumn("last", F.coalesce("last", F.lit(-1))).where("n_ids > last + 1")
    rest = rest.select("path", "ordinal", (F.col("last") + 1).alias("start"), (F.col("n_ids") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.unionByName(rest)
