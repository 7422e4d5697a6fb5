"""Shared parts of the training-data operators: shared storage, word hashing, components.

Nothing here knows a particular operator.  Everything that is written goes to the folder of
``spark.checkpoint.dir``, which driver and executors share; nothing goes to a machine's own
temporary folder.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright import storage
from sievewright.storage import discard, fresh_path, shared_dir

__all__ = ["discard", "fresh_path", "shared_dir"]

#: Bytes of Arrow data handed to Python at once; bounds a worker's memory whatever the text lengths.
#: One number for all operators: plans are lazy, so the session keeps what was set last.
BATCH_BYTES = 5 << 19


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with Arrow batches bounded by bytes and not only by rows."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that the frame's own columns do not have, whatever case they are in."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Size of a file that a narrow table is written to.
FILE_BYTES = 32 << 20


def stored(df: DataFrame, name: str, rows: int | None = None, row_bytes: int = 32) -> DataFrame:
    """A frame written to shared storage and read back; with a bound of its rows, to files of a fair size.

    Where the number of rows is known to be small, many partitions would only make many small files.
    """
    if rows is not None:
        df = df.coalesce(max(4, math.ceil(rows * row_bytes / FILE_BYTES)))
    with _shuffles_removed(df.sparkSession):
        return storage.stored(df, name)


def in_slices(df: DataFrame, key: str, n: int, name: str) -> Iterator[DataFrame]:
    """The rows of a frame in n slices by a long column, equal values together, one slice after the other.

    All slices are written at once to shared storage; each is deleted when the next one is asked for.
    What works slice by slice shuffles an n-th of the rows at a time.
    """
    spark, part = df.sparkSession, free_names(df, "slice")[0]
    path, dealt = fresh_path(spark, name), df.withColumn(part, F.coalesce(F.pmod(F.col(key), F.lit(n)).cast("int"), F.lit(0)))
    with _shuffles_removed(spark):
        dealt.write.partitionBy(part).parquet(path)
    back = spark.read.schema(dealt.schema).parquet(path)
    for k in range(n):
        yield back.where(F.col(part) == k).select(*df.columns)
        storage.remove(spark, f"{path}/{part}={k}")
    storage.remove(spark, path)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Spark removes the shuffle files of what is written meanwhile when the writing ends: later steps read the stored
    table, and files would stay until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, after which the worker gives memory back: workers live on and serve other operators."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def give_back() -> None:
    """Return free memory to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: A side of a join is sent to every task up to this size, counted first; beyond it the join shuffles.
SMALL_BYTES = 8 << 20


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A stored frame marked for broadcast if its counted rows stay within the bound, else as it is."""
    return F.broadcast(df) if df.count() * row_bytes <= SMALL_BYTES else df


def ranked(df: DataFrame, order: Column, name: str) -> DataFrame:
    """df, stored, with each row's number from 0 in the given order: sorted over range partitions, whose sizes alone reach the driver."""
    part, place = free_names(df, "_part", "_place")
    rows = df.repartitionByRange(order).sortWithinPartitions(order)
    rows = stored(rows.withColumns({part: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = {r[part]: r["n"] for r in rows.groupBy(part).agg(F.count("*").alias("n")).collect()}
    before, base = {}, 0
    for p in sorted(sizes):
        before[p], base = base, base + sizes[p]
    if not before:
        return rows.withColumn(name, F.col(place)).drop(part, place)
    start = F.create_map(*[F.lit(x) for p, b in before.items() for x in (p, b)])
    return rows.withColumn(name, F.col(place) + F.try_element_at(start, F.col(part))).drop(part, place)


# --------------------------------------------------------------------------------------------
# Word hashing: words are maximal runs of bytes outside ASCII white space.

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Words beyond this many bytes are hashed one by one.
_LONG = 128


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and each row's offsets into them; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word, and each row's offsets into the words.

    ``between`` marks the bytes that part words.
    """
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~between[raw]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    heads = offsets[(offsets > 0) & (offsets < len(raw))]
    first[heads] = solid[heads]
    last[heads - 1] = solid[heads - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def _lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte, as one number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray((len(raw) + 1,), dtype="<u8", buffer=padded, strides=(1,))


def _masked(lanes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Numbers of the bytes from each position, those beyond ``left`` bytes cleared."""
    over = np.maximum(8 - left, 0).astype(np.uint64) * np.uint64(8)
    return lanes[at] << over


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: its bytes by eights, each chained through the finaliser.

    The finaliser is not linear, so no pattern of bytes makes unlike words meet (a polynomial modulo
    2^64 would: Thue-Morse words collide for every base).  Words of up to eight bytes never collide
    with words of their length.
    """
    size = (ends - starts).astype(np.int64)
    out = mix(size.astype(np.uint64) * _STEP + np.uint64(0x9E3779B97F4A7C15))
    lanes = _lanes(raw)
    todo = np.flatnonzero((size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        out[todo] = mix(out[todo] * _STEP ^ _masked(lanes, starts[todo] + at, size[todo] - at))
        at += 8
        todo = todo[size[todo] > at]
    for k in np.flatnonzero(size > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return out


def same_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, raw2: np.ndarray, starts2: np.ndarray, ends2: np.ndarray) -> np.ndarray:
    """Whether each word equals its counterpart, byte by byte."""
    size = (ends - starts).astype(np.int64)
    same = size == ends2 - starts2
    lanes = _lanes(raw)
    lanes2 = lanes if raw2 is raw else _lanes(raw2)
    todo = np.flatnonzero(same & (size > 0) & (size <= _LONG))
    at = 0
    while len(todo):
        left = size[todo] - at
        same[todo] = _masked(lanes, starts[todo] + at, left) == _masked(lanes2, starts2[todo] + at, left)
        at += 8
        todo = todo[same[todo] & (size[todo] > at)]
    for k in np.flatnonzero(same & (size > _LONG)).tolist():
        same[k] = np.array_equal(raw[starts[k] : ends[k]], raw2[starts2[k] : ends2[k]])
    return same


def shingles(words: np.ndarray, offsets: np.ndarray, n: int = 5, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive words and each row's offsets into them.

    A row of fewer than n words gives one shingle of all its words (``short``) or none.
    """
    sizes = np.diff(offsets)
    if len(words) < n:
        full, keep = np.zeros(0, np.uint64), np.zeros(0, bool)
    else:
        full = np.zeros(len(words) - n + 1, dtype=np.uint64)
        for j in range(n):
            full *= _STEP
            full += words[j : j + len(full)]
        full = mix(full)
        keep = np.ones(len(full), dtype=bool)
        for j in range(1, n):
            cut = offsets[1:] - j
            keep[cut[(cut >= offsets[:-1]) & (cut < len(full)) & (cut >= 0)]] = False
    counts = np.maximum(sizes - n + 1, 0)
    few = np.flatnonzero((sizes > 0) & (sizes < n)) if short else []
    hashes = full[keep]
    if len(few):
        base = np.concatenate([[0], np.cumsum(counts)])
        extra = []
        for i in few:
            h = 0
            for w in words[offsets[i] : offsets[i + 1]].tolist():
                h = (h * int(_STEP) + w) & 0xFFFFFFFFFFFFFFFF
            extra.append((h + int(sizes[i])) & 0xFFFFFFFFFFFFFFFF)
        hashes = np.insert(hashes, base[few], mix(np.array(extra, dtype=np.uint64)))
        counts[few] = 1
    return hashes, np.concatenate([[0], np.cumsum(counts)])


# --------------------------------------------------------------------------------------------
# Streams of sorted rows: groups that need not fit a frame boundary.


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4096) -> Iterator[pa.Table]:
    """Regroup batches sorted by keys into tables that hold whole groups only.

    What is held back is one group plus about ``rows`` rows.
    """
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        last = np.ones(table.num_rows, dtype=bool)
        for k in keys:
            column = table.column(k).to_numpy()
            last &= column == column[-1]
        cut = table.num_rows - int(last.sum())
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        held, n = table.to_batches(), table.num_rows
    if n:
        yield pa.Table.from_batches(held).combine_chunks()


def group_slices(table: pa.Table, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end row of each run of equal keys."""
    change = np.zeros(table.num_rows, dtype=bool)
    change[0] = True
    for k in keys:
        column = table.column(k).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    return starts, np.append(starts[1:], table.num_rows)


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component among n nodes, by min-label sweeps with jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[left], root[right])
        np.minimum.at(root, left, low)
        np.minimum.at(root, right, low)
        np.minimum.at(root, before[left], low)
        np.minimum.at(root, before[right], low)
        root = root[root]
        if (root == before).all():
            return root


# --------------------------------------------------------------------------------------------
# Blocks: a group too large for one task becomes pairs of blocks.


def block_pairs(df: DataFrame, group: list[str], size: str, member: str, block: int) -> DataFrame:
    """Spread each group over block pairs (bi <= bj): every two members meet in exactly one pair.

    A group of n rows gets ceil(n / block) blocks, each row goes to one pair for each block, so a
    hot group spreads over many tasks.  Adds bi, bj and ``own`` (the row's block).
    """
    blocks = F.ceil(F.col(size) / F.lit(float(block))).cast("int")
    own = F.pmod(F.xxhash64(F.col(member), F.lit(17)), blocks).cast("int")
    return (
        df.withColumn("own", own)
        .withColumn("_o", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("bi", F.least("own", "_o"))
        .withColumn("bj", F.greatest("own", "_o"))
        .drop("_o")
    )


# --------------------------------------------------------------------------------------------
# Connected components over links (a, b) of integer nodes.


def components(links: DataFrame, log: Callable[[int], None] | None = None) -> DataFrame:
    """(node, component) for every node in links (a, b); component is the smallest node reachable.

    Each round maps every node to the smallest node among itself and its neighbours and contracts
    the links by that map; chains shrink by a constant factor a round.  All aggregations combine
    before they shuffle, links are made distinct each round, and every round is a stored table.
    """
    both = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    n = links.count()
    edges = stored(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", n)
    labels: DataFrame | None = None
    first: DataFrame | None = None
    while True:
        either = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        down = either.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to"))
        down = stored(down, "down", 2 * n)
        if labels is None:
            labels = down.select("node", F.col("to").alias("component"))
        else:
            step = down.select(F.col("node").alias("component"), F.col("to").alias("_to"))
            older, labels = labels, labels.join(step, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
            labels = stored(labels, "labels", 2 * n)
            discard(older)
        left = down.select(F.col("node").alias("a"), F.col("to").alias("a2"))
        right = down.select(F.col("node").alias("b"), F.col("to").alias("b2"))
        moved = edges.join(left, "a").join(right, "b").where("a2 <> b2")
        older, edges = edges, stored(moved.select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "links", n)
        discard(older)
        if first is None:
            first = down  # the labels of the first round are read from it
        else:
            discard(down)
        if edges.isEmpty():
            discard(edges)
            return labels


# --------------------------------------------------------------------------------------------
# Files that are not tables: opened where the shared folder is, local disk or object store.


def filesystem(path: str):
    """A pyarrow file system and the path in it, for a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = path.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
