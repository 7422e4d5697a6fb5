"""N-gram Jaccard join by chosen paths.

Which texts share at least ``threshold`` of their word shingles?  Every distinct shingle set is
embedded as a fixed number of min-wise samples.  A tree node samples ``branch`` of those positions
and splits its sets by the token each holds there, so sets that share the sampled token stay
together; nodes recurse until they are small, or until splitting no longer pays: where the pairs of all
children together are not clearly fewer than the node's own, its sets resemble each other as a rule, and
all its pairs are worth a look.  Such buckets are compared by brute force.  Independent trees are repeated
until the recall computed for a pair at exactly the threshold, at any depth, reaches ``recall`` (pairs
above it do better).

What is exact and what is not: a pair that meets in some bucket is decided on its full shingle sets,
so no link is ever wrong, apart from collisions of 64-bit hashes.  A pair at the threshold is missed
with a probability of at most ``1 - recall``.

Scale: equal sets are one class before anything is compared, so exact copies cost one row each.  Each
level of the recursion has at most ``PAYS`` times the pairs of the one before, so their number follows the
logarithm of the largest bucket.
Buckets move as (bucket, class) pairs; the samples and then the full sets follow only for members
that share a bucket with something similar.  A bucket beyond ``block`` members is dealt over pairs of
blocks, so a hot one spreads over tasks.  Each pair is counted in one bucket only, the smallest that
both members share, which is why no pair is ever written or made distinct: a task returns one row for
each member, with its number of links and one link into its local component.

Edge cases: null and empty texts have no shingles, link with nothing and form a class of their own;
a text of fewer than five words has one shingle, all its words; rows that repeat count as copies of
each other; rows of one doc_id with unlike texts are compared like any others; a null doc_id stays in
the result, links like others and is never a class id unless its class has no other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Positions of the min-wise embedding; a node samples among them.
POSITIONS = 64
_MULTIPLY = kit.mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = kit.mix(np.arange(1001, 1001 + POSITIONS, dtype=np.uint64))
#: A pair whose samples agree less than this share of the threshold is not looked at again:
#: five standard deviations of the estimate below a similarity of 0.8.
SLACK = 0.69


#: A node is split if its children have at most this share of its pairs.
PAYS = 0.8


def path_survival(threshold: float, branch: int, depth: int | None = None) -> float:
    """Probability that a pair of the given similarity shares a node at each level of one tree (None: of any depth)."""
    q = 1.0
    for _ in range(10_000 if depth is None else depth):
        q = 1 - (1 - threshold * q) ** branch
    return q


def runs_needed(threshold: float, branch: int, recall: float, depth: int | None = None) -> int:
    miss = 1 - path_survival(threshold, branch, depth)
    return max(1, math.ceil(math.log(1 - recall) / math.log(miss)))


def _sets(raw: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    starts, ends, words = kit.word_bounds(raw, offsets)
    hashes, at = kit.shingles(kit.word_hashes(raw, starts, ends), words, n)
    return [np.unique(hashes[at[i] : at[i + 1]]) for i in range(len(at) - 1)]


def _embed(sets: list[np.ndarray]) -> np.ndarray:
    """Min-wise samples of non-empty sets, as (sets, POSITIONS) of uint32."""
    out = np.zeros((len(sets), POSITIONS), dtype=np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):  # a slice of sets that stays in cache
        to, n = at + 1, len(sets[full[at]])
        while to < len(full) and n + len(sets[full[to]]) <= 1 << 15:
            n += len(sets[full[to]])
            to += 1
        x = np.concatenate([sets[i] for i in full[at:to]])
        heads = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full[at : to - 1]])]).astype(np.int64)
        for p in range(POSITIONS):
            hashed = ((x * _MULTIPLY[p] + _ADD[p]) >> np.uint64(32)).astype(np.uint32)
            out[full[at:to], p] = np.minimum.reduceat(hashed, heads)
        at = to
    return out


def _signature(sets: list[np.ndarray]) -> list[pa.Array]:
    """Size and 128 bits that equal sets share."""
    one = np.array([np.bitwise_xor.reduce(s) if len(s) else 0 for s in sets], dtype=np.uint64)
    two = np.array([kit.mix(s + np.uint64(77)).sum(dtype=np.uint64) for s in sets], dtype=np.uint64)
    return [pa.array([len(s) for s in sets], pa.int32()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))]


def _sketcher(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sets = _sets(*kit.text_bytes(batch.column("text")), n)
            sketch = _embed(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("h"),
                    *_signature(sets),
                    pa.FixedSizeListArray.from_arrays(pa.array(sketch.ravel().view(np.int32)), POSITIONS).cast(pa.list_(pa.int32())),
                ],
                names=["doc_id", "h", "n_shingles", "s1", "s2", "sketch"],
            )

    return run


def _shared_first(left: np.ndarray, right: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether ``here`` is the smallest value that each pair of (0-padded) leaf rows shares."""
    ok = np.empty(len(left), dtype=bool)
    for at in range(0, len(left), 4096):
        a, b = left[at : at + 4096], right[at : at + 4096]
        common = ((a[:, :, None] == b[:, None, :]) & (a != 0)[:, :, None]).any(axis=2)
        ok[at : at + 4096] = np.where(common, a, np.iinfo(np.int64).max).min(axis=1) == here[at : at + 4096]
    return ok


def _padded(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.to_pylist()
    out = np.zeros((len(lists), max(map(len, lists))), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _pairs_of(starts: np.ndarray, ends: np.ndarray, own: np.ndarray, bi: np.ndarray, bj: np.ndarray, most: int = 1 << 18):
    """Row pairs (i < j) within each group, of unlike blocks where the group joins two blocks."""
    held: list[np.ndarray] = []
    n = 0
    for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
        if e - s < 2:
            continue
        if bi[s] == bj[s]:
            i, j = np.triu_indices(e - s, 1)
        else:
            left, right = np.flatnonzero(own[s:e] == bi[s]), np.flatnonzero(own[s:e] == bj[s])
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
        for at in range(0, len(i), most):
            held.append(np.stack([i[at : at + most], j[at : at + most]]) + s)
            n += held[-1].shape[1]
            if n >= most:
                yield np.concatenate(held, axis=1)
                held, n = [], 0
    if n:
        yield np.concatenate(held, axis=1)


_KEYS = ["leaf", "bi", "bj"]


def _promising(least: float):
    """Of each bucket, the members that share it first with something whose samples look similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, _KEYS):
            sketch = table.column("sketch").combine_chunks().flatten().to_numpy().reshape(-1, POSITIONS)
            leaf, own, bi, bj = (table.column(c).to_numpy() for c in ("leaf", "own", "bi", "bj"))
            leaves = _padded(table.column("leaves"))
            need = np.zeros(table.num_rows, dtype=bool)
            for i, j in _pairs_of(*kit.group_slices(table, _KEYS), own, bi, bj):
                for at in range(0, len(i), 1 << 14):
                    a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                    near = (sketch[a] == sketch[b]).sum(axis=1) >= least * POSITIONS
                    a, b = a[near], b[near]
                    fresh = ~(need[a] & need[b])
                    a, b = a[fresh], b[fresh]
                    first = _shared_first(leaves[a], leaves[b], leaf[a])
                    need[a[first]] = True
                    need[b[first]] = True
            yield from table.filter(pa.array(need)).select(["leaf", "bi", "bj", "own", "rep", "cnt", "leaves"]).to_batches()

    return run


def _setter(n: int):
    """Shingle sets of texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sets = _sets(*kit.text_bytes(batch.column("text")), n)
                yield pa.RecordBatch.from_arrays([*_signature(sets), pa.array([s.tobytes() for s in sets], pa.binary())], names=["n_shingles", "s1", "s2", "tokens"])

    return run


def _overlap_matrix(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, from their incidence, a slab of tokens at a time."""
    tokens, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for at in range(0, len(tokens), 2048):
        low, high = np.searchsorted(column, [at, at + 2048])
        slab = np.zeros((len(sets), min(2048, len(tokens) - at)), dtype=np.float32)
        slab[row[low:high], column[low:high] - at] = 1
        total += slab @ slab.T
    return total


def _overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the given pairs of sets."""
    return np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in zip(i.tolist(), j.tolist(), strict=True)], dtype=np.int64)


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, _KEYS, rows=1024):
            tokens = table.column("tokens").to_pylist()
            sets = [np.frombuffer(x, dtype=np.uint64) for x in tokens]
            size = np.array([len(s) for s in sets])
            leaf, own, bi, bj, rep, cnt = (table.column(c).to_numpy() for c in ("leaf", "own", "bi", "bj", "rep", "cnt"))
            leaves = _padded(table.column("leaves"))
            links = np.zeros(table.num_rows, dtype=np.int64)
            root = np.arange(table.num_rows)
            for s, e in zip(*map(np.ndarray.tolist, kit.group_slices(table, _KEYS)), strict=True):
                if e - s < 2:
                    continue
                group, found = sets[s:e], []
                matrix = _overlap_matrix(group) if e - s > 9 else None  # more pairs than four times the members
                for i, j in _pairs_of(np.array([s]), np.array([e]), own, bi, bj):
                    for at in range(0, len(i), 1 << 14):
                        a, b = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                        near = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b])
                        a, b = a[near], b[near]
                        both = _overlaps(group, a - s, b - s) if matrix is None else matrix[a - s, b - s].astype(np.int64)
                        hit = both >= threshold * (size[a] + size[b] - both) - 1e-9
                        a, b = a[hit], b[hit]
                        first = _shared_first(leaves[a], leaves[b], leaf[a])
                        np.add.at(links, a[first], cnt[b[first]])
                        np.add.at(links, b[first], cnt[a[first]])
                        found.append(np.stack([a - s, b - s]).astype(np.int32))
                both_ends = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int32)
                if both_ends.shape[1]:
                    root[s:e] = s + kit.local_roots(e - s, both_ends[0], both_ends[1])
            any_link = (links > 0) | (root != np.arange(table.num_rows))
            yield pa.RecordBatch.from_arrays([pa.array(rep[any_link]), pa.array(links[any_link]), pa.array(rep[root][any_link])], names=["rep", "links", "root"])

    return run


def ngram_jaccard_join(docs: DataFrame, **options) -> DataFrame:
    """One row for each row of docs (doc_id long, text string; other columns are ignored).

    class_id    smallest doc_id that links lead to, the row's own included
    n_links     number of other rows whose Jaccard similarity to this one is >= threshold
    n_shingles  distinct shingles of the text
    kept        whether doc_id = class_id (null where doc_id is)
    """
    return similar_groups(docs, **options).select("doc_id", "class_id", "n_links", "n_shingles", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def similar_groups(
    docs: DataFrame,
    *,
    words: int = 5,
    threshold: float = 0.8,
    recall: float = 0.999,
    branch: int = 2,
    small: int = 48,
    block: int = 384,
) -> DataFrame:
    """(doc_id, h, class_id, class_h, n_links, n_shingles) of each row of docs; h is a hash of its text, class_h of that of class_id."""
    kit.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    base = kit.stored(docs.mapInArrow(kit.tidy(_sketcher(words)), "doc_id long, h long, n_shingles int, s1 long, s2 long, sketch array<int>"), "ngram-base")
    same = F.xxhash64("s1", "s2", "n_shingles").alias("rep")
    known = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))
    classes = base.where("n_shingles > 0").groupBy(same).agg(F.min(known).alias("doc"), F.count("*").alias("cnt"), F.first("sketch").alias("sketch"))
    classes = kit.stored(classes, "ngram-classes", base.count(), 320)
    n_sets = classes.count()
    reps = classes.select("rep", "cnt", "sketch")

    leaf = _leaves(reps, n_sets, runs_needed(threshold, branch, recall), branch, small)
    # A member's leaves: those of its branches that others share.
    member = leaf.groupBy("rep").agg(F.collect_list(F.struct("leaf", "size")).alias("all"))
    member = member.join(reps, "rep").select("rep", "cnt", "sketch", F.explode("all").alias("x"), F.array_sort("all.leaf").alias("leaves"))
    member = member.select("rep", "cnt", "sketch", "x.leaf", "x.size", "leaves")
    dealt = kit.block_pairs(member, ["leaf"], "size", "rep", block).drop("size")
    dealt = dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    need = dealt.mapInArrow(kit.tidy(_promising(SLACK * threshold)), "leaf long, bi int, bj int, own int, rep long, cnt long, leaves array<long>")
    need = kit.stored(need, "ngram-need")
    kit.discard(leaf)
    wanted = classes.join(need.select("rep").distinct(), "rep", "left_semi").select("doc.doc_id", "doc.h")
    wanted = kit.stored(wanted.where("doc_id is not null").distinct(), "ngram-wanted", n_sets)
    texts = docs.join(kit.small(wanted, 24), ["doc_id", "h"], "left_semi").unionByName(docs.where("doc_id is null and text is not null")).select("text")
    tokens = texts.mapInArrow(kit.tidy(_setter(words)), "n_shingles int, s1 long, s2 long, tokens binary").select(same, "tokens").dropDuplicates(["rep"])
    full = need.join(tokens, "rep").repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = kit.stored(full.mapInArrow(kit.tidy(_verify(threshold)), "rep long, links long, root long"), "ngram-links")
    kit.discard(need, wanted)

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = kit.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    facts = classes.select("rep", "doc", "cnt").join(linked, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    facts = kit.stored(facts, "ngram-facts", n_sets, 64)
    kit.discard(classes, found)
    least = facts.groupBy("component").agg(F.min("doc").alias("least"))
    facts = facts.join(least, "component").select("rep", "least", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
    own = base.select("doc_id", "h", "n_shingles", F.when(F.col("n_shingles") > 0, same).alias("rep")).join(facts, "rep", "left")
    return own.select(
        "doc_id",
        "h",
        F.coalesce("least.doc_id", "doc_id").alias("class_id"),
        F.coalesce("least.h", "h").alias("class_h"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        "n_shingles",
    )


def _leaves(reps: DataFrame, n_sets: int, runs: int, branch: int, small: int) -> DataFrame:
    """(rep, leaf, size) of the buckets of two sets or more in which the trees end, a stored table."""

    def children(node):
        """Child nodes of a set at a node: its tokens at the positions that the node samples."""
        first = F.pmod(F.xxhash64(node, F.lit(1)), F.lit(POSITIONS))
        step = F.pmod(F.xxhash64(node, F.lit(2)), F.lit(POSITIONS // 2)) * 2 + 1  # odd: positions differ
        at = [F.pmod(first + step * k, F.lit(POSITIONS)).cast("int") for k in range(branch)]
        return F.explode(F.array(*[F.xxhash64(node, p, F.get("sketch", p)) for p in at]))

    roots = F.explode(F.array(*[F.lit(1_000_003 * (r + 1)).cast("long") for r in range(runs)]))
    frontier, n_rows = reps.select("rep", "sketch", roots.alias("node"), F.lit(n_sets).cast("long").alias("size")), runs * n_sets
    leaves, level = [], 0
    while n_rows:
        level += 1
        split = kit.stored(frontier.select("rep", "node", "size", children(F.col("node")).alias("child")), f"ngram-level{level}", branch * n_rows)
        sized = split.groupBy("child").agg(F.count("*").alias("many"), F.first("node").alias("node"), F.first("size").alias("size")).where("many > 1")
        sized = kit.stored(sized, f"ngram-sizes{level}", branch * n_rows)
        pairs = sized.groupBy("node").agg(F.sum(F.col("many") * (F.col("many") - 1)).alias("pairs"), F.first("size").alias("size"))
        # A node whose children have about all its pairs is a bucket itself.
        dense = kit.stored(pairs.where(F.col("pairs") > PAYS * F.col("size") * (F.col("size") - 1)).select("node"), f"ngram-dense{level}", n_rows)
        few = kit.small(dense, 8)
        below = split.join(sized.select("child", "many"), "child").join(few, "node", "left_anti").select("rep", F.col("child").alias("node"), F.col("many").alias("size"))
        below = kit.stored(below, f"ngram-below{level}", branch * n_rows)
        leaves.append(split.join(few, "node", "left_semi").select("rep", F.col("node").alias("leaf"), "size").distinct())
        leaves.append(below.where(F.col("size") <= small).select("rep", F.col("node").alias("leaf"), "size"))
        large = below.where(F.col("size") > small)
        n_rows = large.count()
        frontier = large.join(reps.select("rep", "sketch"), "rep").select("rep", "sketch", "node", "size")
    if not leaves:
        return reps.select("rep", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("size")).limit(0)
    leaf = leaves[0]
    for more in leaves[1:]:
        leaf = leaf.unionByName(more)
    return leaf


def keep_one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of the smallest doc_id of each linked group, one of rows that repeat id and text.

    Rows without a doc_id stay.  Columns of any other name are carried along.
    """
    id_, h, rows = kit.free_names(docs, "_id", "_h", "_rows")
    groups = similar_groups(docs, **options).where((F.col("doc_id") == F.col("class_id")) & (F.col("h") == F.col("class_h")))
    keep = kit.stored(groups.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.count("*").alias(rows)), "ngram-keep", docs.count())
    joined = docs.join(kit.small(keep, 32), (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(h)))
    single = joined.where(F.col(rows) == 1).select(*docs.columns)
    repeated = joined.where(F.col(rows) > 1).dropDuplicates([id_, h]).select(*docs.columns)
    return single.unionByName(repeated).unionByName(docs.where("doc_id is null"))
