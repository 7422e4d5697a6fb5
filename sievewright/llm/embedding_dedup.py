"""Embedding near-duplicates by an exact metric range join.

On unit vectors a cosine of c is the Euclidean distance sqrt(2 - 2c), a metric.  Vectors of one label
are partitioned to their nearest pivot.  A vector y of cell q is nearer to q than to any other pivot p, so
a vector x that lies farther than eps beyond the hyperplane between p and q, for some p, is farther than
eps from all of cell q: (d(x,q)^2 - d(x,p)^2) / (2 d(p,q)) > eps, by the triangle inequality along the
normal.  Other vectors are copied to the cell, from cells of smaller number only, so that two vectors meet
in one cell; then every cell joins by itself.  Nothing is approximate.

Scale: equal vectors of a label are one class before the join, so a very common vector is one row.
Every label has pivots, in proportion to its size, two at least; they are drawn by hashes and meet the
vectors in the tasks that place them, a label's vectors dealt over parts of bounded size, so nothing goes
through the driver.  A cell of any size is cut into blocks and each pair of blocks is one task's work, in
double-precision matrix products; a task returns one row for each member, never pairs.  In high
dimensions pivots prune little; the blocks keep the work bounded.

Edge cases: a vector links with nothing if its label is null, or if it is null, zero, or holds a null
or non-finite component; vectors of unlike lengths are not compared; rows that repeat count as other
vectors; rows with a null vec_id stay in the result and count as links, but are never a component id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kit

#: Pivots of a label at most, and vectors that one task places at a time.
MOST_PIVOTS, PART_ROWS = 64, 8192
_PLACED = ["label", "dim", "part"]
_KEYS = ["label", "dim", "cell", "hb", "ob"]


def _unit(flat: np.ndarray, dim: int) -> np.ndarray:
    x = flat.astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no overflow or underflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cells_of(x: np.ndarray, pivots: np.ndarray, eps: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's own cell, and which cells of larger number it must visit."""
    cos = x @ pivots.T
    own = cos.argmax(axis=1)
    apart = np.sqrt(np.maximum(0, 2 - 2 * (pivots @ pivots.T)))
    visits = np.arange(len(pivots))[None, :] > own[:, None]
    for p in range(len(pivots)):
        # cos(x,p) - cos(x,q) is half of d(x,q)^2 - d(x,p)^2; equal pivots part nothing.
        beyond = np.where(apart[p] > 1e-9, (cos[:, p, None] - cos) / np.maximum(apart[p], 1e-9), 0.0)
        visits &= beyond <= eps + 1e-6
    return own, visits


def _assigner(eps: float):
    """Each vector's home cell, and the cells that it visits, from parts of labels that begin with the label's pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, _PLACED, rows=2048):
            dim = table.column("dim").to_numpy()
            at = np.concatenate([[0], np.cumsum(dim)])
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            plain = table.column("plain").to_numpy(zero_copy_only=False).astype(bool)
            for s, e in zip(*map(np.ndarray.tolist, kit.group_slices(table, _PLACED)), strict=True):
                x, mine = _unit(flat[at[s] : at[e]], dim[s]), plain[s:e]
                pivots = x[~mine] if not mine.all() else x[:1]
                own, visits = cells_of(x[mine], pivots, eps)
                visits[np.arange(len(own)), own] = True
                r, c = np.nonzero(visits)
                out = table.select(["label", "dim", "rep", "cnt", "embedding"]).take(pa.array(s + np.flatnonzero(mine)[r]))
                for k in range(0, len(r), 4096):
                    for batch in out.slice(k, 4096).combine_chunks().to_batches():
                        cell, home = c[k : k + batch.num_rows], c[k : k + batch.num_rows] == own[r[k : k + batch.num_rows]]
                        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(home)], names=[*batch.schema.names, "cell", "home"])

    return run


def _joiner(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, _KEYS, rows=2048):
            dim, rep, cnt = (table.column(c).to_numpy() for c in ("dim", "rep", "cnt"))
            asks, home = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "home"))
            at = np.concatenate([[0], np.cumsum(dim)])
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
            for s, e in zip(*map(np.ndarray.tolist, kit.group_slices(table, _KEYS)), strict=True):
                x, h, own = _unit(flat[at[s] : at[e]], dim[s]), asks[s:e], home[s:e]
                hosts, others = np.flatnonzero(h), np.flatnonzero(~h)
                if not len(hosts) or not len(others):
                    continue
                ids, counts = rep[s:e], cnt[s:e]
                i, j = np.nonzero(x[hosts] @ x[others].T >= threshold)
                i, j = hosts[i], others[j]
                unlike = ids[i] != ids[j]
                i, j = i[unlike], j[unlike]
                if not len(i):
                    continue
                links = np.zeros(e - s, dtype=np.int64)
                np.add.at(links, i, counts[j])
                guest = ~own[j]  # a visitor asks nowhere else for the members of this cell
                np.add.at(links, j[guest], counts[i[guest]])
                root = kit.local_roots(e - s, i, j)
                some = np.union1d(i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(ids[root[some]])], names=["rep", "links", "root"])

    return run


def place(classes: DataFrame, eps: float, cell_rows: int) -> DataFrame:
    """classes (label, dim, rep, cnt, embedding) with cell and home: a row for the home cell, and one for each cell visited."""
    sized = classes.groupBy("label", "dim").agg(F.count("*").alias("n"))
    sized = sized.select("label", "dim", "n", F.least(F.lit(MOST_PIVOTS), F.greatest(F.lit(2), F.ceil(F.col("n") / cell_rows))).cast("int").alias("m"), F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts"))
    sized = kit.stored(sized, "embedding-labels")
    rows = classes.select("label", "dim", "rep", "cnt", "embedding").join(kit.small(sized, 32), ["label", "dim"])
    # A few times the pivots needed are drawn by a hash, the first of these by another are the pivots.
    drawn = rows.where(F.pmod(F.xxhash64("rep", F.lit(3)), F.col("n")) < 8 * F.col("m"))
    first = Window.partitionBy("label", "dim").orderBy(F.xxhash64("rep", F.lit(4)), "rep")
    pivots = drawn.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= F.col("m")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("rep", F.lit(5)), F.col("parts")).cast("int"))
    tail = [*_PLACED, "rep", "cnt", "embedding"]
    both = pivots.select(*tail, F.lit(False).alias("plain")).unionByName(rows.select(*tail, F.lit(True).alias("plain")))
    dealt = both.repartition(*_PLACED).sortWithinPartitions(*_PLACED, "plain", "rep")
    return dealt.mapInArrow(kit.tidy(_assigner(eps)), "label long, dim int, rep long, cnt long, embedding array<double>, cell int, home boolean")


def embedding_near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, cell_rows: int = 2048, block: int = 1024) -> DataFrame:
    """One row for each row of vectors (vec_id, label, embedding): vec_id, n_links, component_id, kept.

    Two rows link if their labels are equal and the cosine of their vectors is >= threshold;
    component_id is the smallest vec_id that links lead to, the row's own included.
    """
    kit.session(vectors)
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    whole = F.col("label").isNotNull() & x.isNotNull() & good
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.cast("array<double>").alias("embedding"))
    base = base.select("vec_id", "label", "embedding", F.when(whole, F.xxhash64("label", "embedding")).alias("rep"))
    classes = base.where("rep is not null").groupBy("label", "embedding", "rep").agg(F.min("vec_id").alias("vec"), F.count("*").alias("cnt"))
    classes = kit.stored(classes.withColumn("dim", F.size("embedding")), "embedding-classes")

    eps = math.sqrt(2 - 2 * threshold)
    placed = kit.stored(place(classes, eps, cell_rows), "embedding-cells")
    counts = placed.groupBy("label", "dim", "cell").agg(F.count(F.when(F.col("home"), 1)).alias("n_home"), F.count("*").alias("n_all"))
    blocks = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / F.lit(float(block)))).cast("int")
    placed = placed.join(counts, ["label", "dim", "cell"]).withColumns({"nh": blocks("n_home"), "na": blocks("n_all")})
    deal = lambda n: F.pmod(F.xxhash64("rep", F.lit(11)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tail = ["home", "rep", "cnt", "embedding"]
    asking = placed.where("home").select("label", "dim", "cell", deal("nh").alias("hb"), upto("na").alias("ob"), F.lit(True).alias("asks"), *tail)
    asked = placed.select("label", "dim", "cell", upto("nh").alias("hb"), deal("na").alias("ob"), F.lit(False).alias("asks"), *tail)
    dealt = asking.unionByName(asked).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    found = kit.stored(dealt.mapInArrow(kit.tidy(_joiner(threshold)), "rep long, links long, root long"), "embedding-links")

    linked = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = kit.components(found.select(F.col("rep").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "rep")
    facts = classes.select("rep", "vec", "cnt").join(linked, "rep", "left").join(groups, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    facts = kit.stored(facts, "embedding-facts", classes.count(), 64)
    least = facts.groupBy("component").agg(F.min("vec").alias("component_id"))
    facts = facts.join(least, "component").select("rep", "component_id", (F.coalesce("links", F.lit(0)) + F.col("cnt") - 1).alias("n_links"))
    return (
        base.select("vec_id", "rep")
        .join(facts, "rep", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )
