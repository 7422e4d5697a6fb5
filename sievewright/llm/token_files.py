"""Token-id files in bit planes.

Ids are cut into blocks of a fixed number; each block is transposed into planes, byte k (or bit k) of
every id together, and every plane is compressed with zstandard by itself: the high planes of small
ids are nearly constant.  A chunk index at the end of the file holds each block's place and the sizes
of its planes, and a document index holds ids and lengths, so any block or document can be read alone.

Layout: magic, planes of all blocks, footer (zstandard over JSON), document index (zstandard over two
int64 arrays), the footer's and the index's lengths as little-endian u64, magic.

The writer sorts globally without a global sort of texts: documents are encoded where they are read,
dealt by bounds of doc_id over buckets, each a task's, and sorted within each; a bucket is written to as
many files of bounded size as it needs.  There are at most ``MOST_BUCKETS`` bounds, whatever the size of
the corpus.  An id so frequent that it is several bounds is dealt over their buckets by the checksum of its
rows' ids.  Files have a name for each attempt and count only if the manifest, a stored table, names
them, so a lost executor leaves at most an orphan.  Empty texts have the end id alone; a null doc_id
sorts first; rows that repeat an id are ordered by that checksum; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe, kit

MAGIC = b"BPLANE01"
BLOCK = 1 << 16
#: Buckets at most: what is sent to the tasks and summed on the driver.
MOST_BUCKETS = 1 << 15
#: Ids that a file holds before the next one is begun.
FILE_IDS = 1 << 26
_NO_ID = np.iinfo(np.int64).min


def to_planes(ids: np.ndarray, kind: str = "byte") -> list[bytes]:
    """Planes of a block of ids, lowest first; those above the largest id are left out."""
    lanes = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    top = int(ids.max(initial=0)).bit_length()
    if kind == "byte":
        return [np.ascontiguousarray(lanes[:, k]).tobytes() for k in range(max(1, -(-top // 8)))]
    bits = np.unpackbits(lanes, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(max(1, top))]


def from_planes(planes: list[bytes], n: int, kind: str = "byte") -> np.ndarray:
    if kind == "byte":
        lanes = np.zeros((n, 4), dtype=np.uint8)
        for k, plane in enumerate(planes):
            lanes[:, k] = np.frombuffer(plane, dtype=np.uint8)
        return lanes.view("<u4").ravel()
    ids = np.zeros(n, dtype=np.uint32)
    for k, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, dtype=np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return ids


class PlaneWriter:
    """Writes ids to an open binary file, a block at a time."""

    def __init__(self, sink, kind: str = "byte", block: int = BLOCK, level: int = 3):
        self.sink, self.kind, self.block = sink, kind, block
        self.squeeze = zstandard.ZstdCompressor(level=level)
        self.held: list[np.ndarray] = []
        self.n = self.total = 0
        self.at = len(MAGIC)
        self.chunks: list[list] = []
        sink.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        while self.n >= self.block:
            whole = np.concatenate(self.held)
            self._write(whole[: self.block])
            self.held, self.n = [whole[self.block :]], len(whole) - self.block

    def _write(self, ids: np.ndarray) -> None:
        planes = [self.squeeze.compress(p) for p in to_planes(ids, self.kind)]
        self.chunks.append([self.at, len(ids), [len(p) for p in planes]])
        for p in planes:
            self.sink.write(p)
            self.at += len(p)
        self.total += len(ids)

    def close(self, doc_ids: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> None:
        if self.n:
            self._write(np.concatenate(self.held))
        footer = {"kind": self.kind, "block": self.block, "ids": self.total, "docs": len(lengths), "chunks": self.chunks}
        footer = self.squeeze.compress(json.dumps(footer).encode())
        index = self.squeeze.compress(doc_ids.astype("<i8").tobytes() + known.astype(np.uint8).tobytes() + lengths.astype("<i8").tobytes())
        for part in (footer, index, struct.pack("<QQ", len(footer), len(index)), MAGIC):
            self.sink.write(part)


class PlaneReader:
    """Reads a file of planes: its chunk and document indexes at once, blocks as they are asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 16 - len(MAGIC))
        tail = source.read(16 + len(MAGIC))
        if tail[16:] != MAGIC:
            raise ValueError("not a file of planes, or cut short")
        n_footer, n_index = struct.unpack("<QQ", tail[:16])
        source.seek(size - 16 - len(MAGIC) - n_footer - n_index)
        both = source.read(n_footer + n_index)
        self.expand = zstandard.ZstdDecompressor()
        footer = json.loads(self.expand.decompress(both[:n_footer]))
        self.kind, self.block, self.ids, self.chunks = footer["kind"], footer["block"], footer["ids"], footer["chunks"]
        raw, n = self.expand.decompress(both[n_footer:]), footer["docs"]
        self.doc_ids = np.frombuffer(raw[: 8 * n], dtype="<i8")
        self.known = np.frombuffer(raw[8 * n : 9 * n], dtype=np.uint8).astype(bool)
        self.lengths = np.frombuffer(raw[9 * n :], dtype="<i8")

    def chunk(self, k: int) -> np.ndarray:
        at, n, sizes = self.chunks[k]
        self.source.seek(at)
        raw = self.source.read(sum(sizes))
        ends = np.cumsum(sizes)
        return from_planes([self.expand.decompress(raw[e - s : e]) for s, e in zip(sizes, ends.tolist(), strict=True)], n, self.kind)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document, from the blocks that hold it."""
        start = int(self.lengths[:k].sum())
        end = start + int(self.lengths[k])
        if start == end:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        both = np.concatenate([self.chunk(c) for c in range(first, last + 1)])
        return both[start - first * self.block : end - first * self.block]

    def checksums(self) -> np.ndarray:
        """CRC-32 of each document's ids as little-endian u32, a block in memory at a time."""
        out = np.zeros(len(self.lengths), dtype=np.int64)
        block, at, k = memoryview(b""), 0, 0
        for d, n in enumerate((4 * self.lengths).tolist()):
            crc = 0
            while n:
                if at == len(block):
                    block, at, k = memoryview(self.chunk(k).astype("<u4").tobytes()), 0, k + 1
                take = min(n, len(block) - at)
                crc = zlib.crc32(block[at : at + take], crc)
                at, n = at + take, n - take
            out[d] = crc
        return out


def bucket_of(ids: np.ndarray, tie: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bucket of each id: that of the first bound that is not below it, or of one of several equal bounds, by tie."""
    first, last = np.searchsorted(bounds, ids), np.searchsorted(bounds, ids, side="right")
    return first + (tie * np.maximum(last - first, 1) >> 32)


def _encoder(tokenizer: str, end: int, bounds: np.ndarray, places: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe.encoder(tokenizer)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = coder.encode_column(batch.column("text"))
            ids, at = np.insert(ids, at[1:], np.uint16(end)), at + np.arange(len(at))
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((2 * at).astype(np.int64)), pa.py_buffer(ids.astype("<u2"))]).cast(pa.binary())
            doc_id = batch.column("doc_id")
            tie = np.array([zlib.crc32(x) for x in binary.to_pylist()], dtype=np.int64)
            bucket = bucket_of(doc_id.fill_null(_NO_ID).to_numpy(), tie, bounds)
            yield pa.RecordBatch.from_arrays([doc_id, pa.array(bucket.astype(np.int32)), pa.array(places[bucket]), pa.array(tie), binary], names=["doc_id", "bucket", "place", "tie", "ids"])

    return run


def _writer(folder: str, kind: str, file_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = kit.filesystem(folder)
        fs.create_dir(root, recursive=True)
        now, part_no, sink, out, docs = None, 0, None, None, []

        def finish() -> pa.RecordBatch:
            doc_ids = pa.concat_arrays([d for d, _ in docs])
            lengths = np.concatenate([n for _, n in docs])
            out.close(doc_ids.fill_null(0).to_numpy(), doc_ids.is_valid().to_numpy(zero_copy_only=False), lengths)
            sink.close()
            return pa.RecordBatch.from_pydict({"bucket": pa.array([now], pa.int32()), "part": pa.array([part_no], pa.int32()), "path": [name], "n_docs": pa.array([len(lengths)], pa.int64()), "n_ids": pa.array([out.total], pa.int64())})

        for batch in batches:
            if not batch.num_rows:
                continue
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                if buckets[s] != now or out.total + out.n >= file_ids:
                    if now is not None:
                        yield finish()
                    part_no = part_no + 1 if buckets[s] == now else 0
                    now, docs = int(buckets[s]), []
                    name = f"part-{now:06d}-{part_no:04d}-{uuid.uuid4().hex}.planes"
                    sink = fs.open_output_stream(f"{root}/{name}")
                    out = PlaneWriter(sink, kind)
                part = batch.slice(s, e - s)
                raw = part.column("ids").cast(pa.large_binary())
                at = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + len(raw) + 1]
                out.add(np.frombuffer(raw.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].view("<u2").astype(np.uint32))
                docs.append((part.column("doc_id"), np.diff(at) // 2))
        if now is not None:
            yield finish()

    return run


def write_token_files(docs: DataFrame, folder: str, *, tokenizer: str, end: int, docs_per_file: int = 8192, file_ids: int = FILE_IDS, kind: str = "byte") -> DataFrame:
    """Encode docs (doc_id, text), end each with id ``end`` and write files of planes in doc_id order.

    Returns the manifest (bucket, part, path, n_docs, n_ids), a stored table; files in the order of bucket
    and part hold ascending doc_ids.
    """
    spark = kit.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(1, min(MOST_BUCKETS, math.ceil(docs.count() / docs_per_file)))
    bounds = np.zeros(0, np.int64)
    if buckets > 1:
        known = docs.select(F.coalesce("doc_id", F.lit(_NO_ID)).alias("doc_id"))
        at = known.agg(F.percentile_approx("doc_id", [k / buckets for k in range(1, buckets)], max(1000, 20 * buckets)).alias("b")).first().b
        bounds = np.array(at, dtype=np.int64)
    coded = docs.mapInArrow(kit.tidy(_encoder(tokenizer, end, bounds, _places(spark, buckets))), "doc_id long, bucket int, place int, tie long, ids binary")
    coded = coded.repartition(buckets, "place").sortWithinPartitions("bucket", "doc_id", "tie").drop("place")
    return kit.stored(coded.mapInArrow(kit.tidy(_writer(folder, kind, file_ids)), "bucket int, part int, path string, n_docs long, n_ids long"), "token-manifest")


def _places(spark, n: int) -> np.ndarray:
    """For each bucket a number that hash partitioning into n puts in a partition of its own (for nearly all)."""
    tries = spark.range(n * (8 + n.bit_length())).select(F.col("id").cast("int").alias("place"))
    found = tries.groupBy(F.pmod(F.hash("place"), F.lit(n)).alias("part")).agg(F.min("place").alias("place")).collect()
    places = np.arange(n, dtype=np.int32)
    for r in found:
        places[r.part] = r.place
    return places


def _scanner(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = kit.filesystem(folder)
        for batch in batches:
            for base, name in zip(batch.column("base").to_pylist(), batch.column("path").to_pylist(), strict=True):
                path = f"{root}/{name}"
                with fs.open_input_file(path) as source:
                    reader = PlaneReader(source, source.size())
                    sums = reader.checksums()
                lengths = reader.lengths
                starts = np.cumsum(lengths) - lengths
                ids = pa.array(np.where(reader.known, reader.doc_ids, 0), mask=~reader.known)
                for s in range(0, len(sums), 1 << 16):
                    cut = slice(s, s + (1 << 16))
                    yield pa.RecordBatch.from_arrays(
                        [ids[cut], pa.array(starts[cut] + base), pa.array(lengths[cut]), pa.array(sums[cut])],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return run


def read_token_index(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files that the manifest names."""
    files = max(1, manifest.count())
    sizes = manifest.groupBy("bucket").agg(F.sum("n_ids").alias("n")).orderBy("bucket").collect()  # at most MOST_BUCKETS rows
    base = np.cumsum([0, *(r.n for r in sizes)]).tolist()
    bases = manifest.sparkSession.createDataFrame([(r.bucket, b) for r, b in zip(sizes, base, strict=False)], "bucket int, base long")
    before = Window.partitionBy("bucket").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.join(bases, "bucket").select("path", (F.col("base") + F.coalesce(F.sum("n_ids").over(before), F.lit(0))).alias("base"))
    return placed.repartition(files, "path").mapInArrow(kit.tidy(_scanner(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")
