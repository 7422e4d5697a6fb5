"""Merkle manifest of a dataset: a digest tree for every source, a tree of their roots, a proof for every row.

A node is the SHA-256 of the hex text of up to ``FAN`` consecutive nodes below it.  Leaves ascend by
(doc_id, leaf digest) within their source.  They are cut into aligned blocks of ``FAN ** HEIGHT`` leaves,
each of which is a whole subtree: a recursive traversal in post order returns the subtree's digest and,
while it unwinds, appends the siblings of every child to the leaves below that child.  The roots of the
blocks are the leaves of another distributed traversal of the same kind, and so on until a source has
one node; the roots of all sources go through the same traversals as one more tree.  On the way down
every block's own proof is appended to the proofs within it.

Scale: texts are hashed by the JVM and never shuffled; a row carries two digests of 32 bytes.  Leaves are
numbered by a range partitioning of (source, doc_id, digest), so a source that has a third of all rows
is spread over partitions, and its blocks over tasks.  A task holds one block's digests and proofs; the tables
above shrink by a factor of 2,187 a level, and a side of a join is sent to the tasks only up to a counted size.

Edge cases: null values hash as ``-``; null sources are a tree of their own, the first; null ids
come first in their source; rows that repeat an id are ordered by digest, equal rows have equal leaves
and a proof each; empty texts hash as ``0:``; columns other than those named are not read; an empty table
gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

#: Children of a node.
FAN = 3
#: Levels of a block unless told otherwise.
HEIGHT = 7

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256, as bytes, of fields that are each ``-`` for null or their UTF-8 length, a colon and the value."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def _height(n: int, most: int) -> int:
    """Levels that a block of a tree of n nodes is folded by: all of them, or as many as leave one node."""
    levels = 0
    while levels < most and FAN**levels < n:
        levels += 1
    return levels


def _fold(digests: list[bytes], low: int, height: int, proofs: list[list[bytes]]) -> bytes:
    """Digest of the subtree of a height whose first leaf is ``low``; siblings go to the leaves' proofs while unwinding."""
    if not height:
        return digests[low]
    span = FAN ** (height - 1)
    starts = range(low, min(low + FAN * span, len(digests)), span)
    below = [_fold(digests, start, height - 1, proofs) for start in starts]
    if len(below) > 1:
        for k, start in enumerate(starts):
            others = b"".join(below[:k] + below[k + 1 :])
            for leaf in range(start, min(start + span, len(digests))):
                proofs[leaf].append(others)
    return hashlib.sha256(b"".join(below).hex().encode()).digest()


def _traversed(nodes: DataFrame, height: int) -> DataFrame:
    """nodes (tree, at, n, digest, ...) with their block, their proof within it and, on its first node, its root."""
    names = [c for c in nodes.columns if c != "block"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + ", block long, proof binary, top binary"

    @kit.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, ["tree", "block"]):
            digests, sizes = table.column("digest").to_pylist(), table.column("n").to_numpy()
            proofs, tops = [], [None] * table.num_rows
            for start, end in zip(*kit.group_slices(table, ["tree", "block"]), strict=True):
                mine: list[list[bytes]] = [[] for _ in range(end - start)]
                tops[start] = _fold(digests[start:end], 0, _height(int(sizes[start]), height), mine)
                proofs += [b"".join(p) for p in mine]
            out = table.append_column("proof", pa.array(proofs, pa.binary())).append_column("top", pa.array(tops, pa.binary()))
            yield from out.select([*names, "block", "proof", "top"]).to_batches()

    kit.session(nodes)
    blocks = nodes.withColumn("block", F.expr(f"at div {FAN**height}"))
    return kit.stored(blocks.repartition("tree", "block").sortWithinPartitions("tree", "block", "at").mapInArrow(run, schema), "merkle-level")


def proven(nodes: DataFrame, height: int = HEIGHT, crown: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """nodes (tree, at, n, digest, ...), n of them in a tree, numbered from 0, with the way from each to the top.

    Adds ``proof``, the siblings' digests level by level from left to right, ``subroot``, the digest of the
    node's tree, and ``root``.  ``crown`` maps (tree, subroot) to (tree, above, subroot, root), the proofs and
    the root over the trees' own roots; without it a tree's own root is the top.
    """
    levels, ends = [], []
    while True:
        level = _traversed(nodes, height)
        tops = level.where("top is not null").select("tree", F.col("block").alias("at"), F.expr(f"(n + {FAN**height - 1}) div {FAN**height}").alias("n"), F.col("top").alias("digest"))
        levels.append(level)
        ends.append(tops.where("n = 1").select("tree", F.col("digest").alias("subroot")))
        nodes = tops.where("n > 1")
        if nodes.isEmpty():
            break
    trees = ends[0]
    for more in ends[1:]:
        trees = trees.unionByName(more)
    over = crown(trees) if crown else trees.select("tree", F.lit(b"").alias("above"), "subroot", F.col("subroot").alias("root"))
    over = kit.stored(over, "merkle-trees")
    rows = None
    for depth in range(len(levels) - 1, -1, -1):
        here = over.join(ends[depth].select("tree"), "tree", "left_semi") if len(levels) > 1 else over
        here = here.select("tree", F.lit(0).cast("long").alias("block"), "above", "subroot", "root")
        if rows is not None:
            here = here.unionByName(rows.select("tree", F.col("at").alias("block"), F.col("proof").alias("above"), "subroot", "root"))
        if len(levels) > 1:
            here = kit.stored(here, "merkle-above")
        rows = levels[depth].drop("top").join(kit.small(here, 1024), ["tree", "block"])
        rows = rows.withColumn("proof", F.concat("proof", "above")).drop("above", "block")
    return rows


def _climb(digest: bytes, at: int, n: int, proof: memoryview | bytes, used: int) -> tuple[bytes, int]:
    """Fold a node up its tree of n nodes with the siblings from ``used`` on; its tree's root and what is used then."""
    while n > 1:
        first = at - at % FAN
        width = min(FAN, n - first)
        place = used + 32 * (at - first)
        end = used + 32 * (width - 1)
        digest = hashlib.sha256((proof[used:place] + digest + proof[place:end]).hex().encode()).digest()
        used, at, n = end, at // FAN, -(-n // FAN)
    return digest, used


def fold_proof(digest: bytes, proof: bytes, places: Sequence[tuple[int, int]]) -> bytes:
    """The root that a leaf digest and its proof give; places are its (number, size) in each tree on the way."""
    used = 0
    for at, n in places:
        digest, used = _climb(digest, at, n, proof, used)
    return digest


def build_manifest(docs: DataFrame, altered: Column | None = None, height: int = HEIGHT) -> DataFrame:
    """A row for each row of docs: doc_id, source, its place (tree, at, n, trees), digest, proof, subroot and root.

    Digests are bytes.  ``altered`` is another form of the text, whose leaf digest is added as ``other``.
    """
    leaves = docs.select(
        "doc_id",
        "source",
        leaf_digest([F.col(c) for c in FIELDS]).alias("digest"),
        leaf_digest([*map(F.col, FIELDS[:-1]), F.col("text") if altered is None else altered]).alias("other"),
    )
    leaves = kit.ranked(leaves, F.struct("source", "doc_id", "digest"), "rank")
    sources = leaves.groupBy("source").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    sources = kit.stored(kit.ranked(sources, F.col("source"), "tree"), "merkle-sources")
    trees = sources.count()
    placed = leaves.join(kit.small(sources.withColumnRenamed("source", "of"), 128), F.col("source").eqNullSafe(F.col("of")))
    nodes = placed.select("doc_id", "source", "tree", (F.col("rank") - F.col("first")).alias("at"), "n", "digest", "other")

    def crown(roots: DataFrame) -> DataFrame:
        top = roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("at"), F.lit(trees).cast("long").alias("n"), F.col("subroot").alias("digest"))
        return proven(top, height).select(F.col("at").alias("tree"), F.col("proof").alias("above"), F.col("digest").alias("subroot"), "root")

    return proven(nodes, height, crown).withColumn("trees", F.lit(trees).cast("long"))


def verified(manifest: DataFrame, digest: str = "digest") -> DataFrame:
    """The manifest with ``folded``, the root that the named digest and the proof give."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in manifest.schema) + ", folded binary"

    @kit.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n, tree, trees = (batch.column(c).to_numpy().tolist() for c in ("at", "n", "tree", "trees"))
            rows = zip(batch.column(digest).to_pylist(), batch.column("proof").to_pylist(), at, n, tree, trees, strict=True)
            folded = [fold_proof(d, p, ((a, m), (t, k))) for d, p, a, m, t, k in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.binary())], names=[*batch.schema.names, "folded"])

    kit.session(manifest)
    return manifest.mapInArrow(run, schema)


def tampered_text() -> Column:
    """The text without line ends where 2 divides the checksum of the id, else as it is."""
    odd = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return F.when(odd, F.regexp_replace("text", "\n", "")).otherwise(F.col("text"))


def manifest_digest(checked: DataFrame) -> DataFrame:
    """Digests as lowercase hex, and whether the folded root is the manifest's."""
    text = lambda c: F.lower(F.hex(c))
    return checked.select(
        "doc_id",
        text("digest").alias("leaf"),
        text("subroot").alias("subroot"),
        text("root").alias("root"),
        F.sha2(text("proof").cast("binary"), 256).alias("proof_sha256"),
        text("folded").alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )
