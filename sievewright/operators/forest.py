"""Minimum spanning forest of vectors under mutual reachability, by Borůvka rounds over neighbour lists.

Every vector lists its nearest others, found by products of pairs of blocks.  A round gives each component its
lightest edge out and merges along them, so components at least halve in number.  The lightest listed edge is known
to be the lightest of all if it is no longer than the reach of the component's lists, the distance up to
which they are complete; only components where it is longer compare their vectors with all others,
again by blocks, and the edges found join the lists.  No group ever holds all vectors, and no vector is shuffled
once for every block that it meets.

Distances are rounded to twelve places, so that they do not depend on how blocks were cut.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators import blocks
from sievewright.storage import discard, stored

BLOCK = 2048
#: Neighbours that a vector lists, at least.
LISTED = 16
_LISTS = "id long, near array<struct<d:double,id:long>>"
_OUT = "component long, w double, a long, b long"


def _distances(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return np.round(np.clip(1 - left @ right.T, 0, 2), 12)


class _Lists:
    """The nearest others of a block's vectors."""

    def __init__(self, keep: int, members: pa.StructArray) -> None:
        self.ids, self.matrix = members.field("id").to_numpy(), blocks.matrix(members)
        self.best = blocks.Best(len(self.ids), keep, -2.0)

    def add(self, members: pa.StructArray) -> None:
        ids, matrix = members.field("id").to_numpy(), blocks.matrix(members)
        for low in range(0, len(self.ids), 256):
            rows = np.arange(low, min(low + 256, len(self.ids)))
            d = _distances(self.matrix[rows], matrix)
            d[self.ids[rows, None] == ids[None, :]] = np.inf
            self.best.offer(rows, -d, ids, ids)

    def table(self) -> pa.Table:
        rows, values, ids, _ = self.best.all()
        some, starts = np.unique(rows, return_index=True)
        near = pa.ListArray.from_arrays(pa.array(np.append(starts, len(rows)), pa.int32()), pa.StructArray.from_arrays([pa.array(-values), pa.array(ids)], ["d", "id"]))
        return pa.table({"id": self.ids[some], "near": near})


class _Lightest:
    """The lightest edge of each component of a block to another component."""

    def __init__(self, members: pa.StructArray) -> None:
        self.ids, self.matrix = members.field("id").to_numpy(), blocks.matrix(members)
        self.component, self.core = members.field("component").to_numpy(), members.field("core").to_numpy()
        self.out: dict[int, tuple[float, int, int]] = {}

    def add(self, members: pa.StructArray) -> None:
        ids, matrix, theirs, core = members.field("id").to_numpy(), blocks.matrix(members), members.field("component").to_numpy(), members.field("core").to_numpy()
        for low in range(0, len(self.ids), 256):
            rows = slice(low, low + 256)
            w = np.maximum(np.maximum(_distances(self.matrix[rows], matrix), self.core[rows, None]), core[None, :])
            w[self.component[rows, None] == theirs[None, :]] = np.inf
            best = np.argmin(w, axis=1)
            for k, c in enumerate(best.tolist()):
                if w[k, c] < np.inf:
                    a, b = sorted((int(self.ids[low + k]), int(ids[c])))
                    edge, component = (float(w[k, c]), a, b), int(self.component[low + k])
                    self.out[component] = min(self.out.get(component, edge), edge)

    def table(self) -> pa.Table:
        edges = self.out.values()
        return pa.table({"component": pa.array(self.out.keys(), pa.int64()), **{name: pa.array([e[i] for e in edges], kind) for i, (name, kind) in enumerate((("w", pa.float64()), ("a", pa.int64()), ("b", pa.int64())))}})


def _dealt(rows: DataFrame, n: int, name: str) -> DataFrame:
    """Rows as stored blocks."""
    block = F.pmod(F.xxhash64("id"), F.lit(max(1, math.ceil(n / BLOCK)))).cast("int")
    return stored(blocks.packed(rows.withColumn("block", block), ["block"]).drop("block"), name)


def neighbour_lists(points: DataFrame, n: int, keep: int) -> DataFrame:
    """(id, near): each vector's nearest others, ascending by distance and id; points (id, embedding)."""
    dealt = _dealt(points, n, "forest-blocks")
    found = blocks.meet(dealt, dealt, n, _width(points), partial(_Lists, keep), _LISTS)
    return found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, keep).alias("near"))  # keep entries a part


def _width(points: DataFrame) -> int:
    return points.agg(F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()[0]


def _merged(picks: DataFrame) -> DataFrame:
    """(component, to): the component that each merges into along its own edge, by pointer jumping."""
    back = picks.select(F.col("component").alias("other"), F.col("other").alias("_back"))
    root = (F.col("_back") == F.col("component")) & (F.col("component") < F.col("other"))
    parents = stored(picks.select("component", "other").join(back, "other").select("component", F.when(root, F.col("component")).otherwise(F.col("other")).alias("to")), "forest-parents")
    while True:
        up = parents.select(F.col("component").alias("to"), F.col("to").alias("_up"))
        jumped = stored(parents.join(up, "to").select("component", F.col("_up").alias("to"), (F.col("to") != F.col("_up")).alias("moved")), "forest-parents")
        discard(parents)
        parents = jumped
        if parents.where("moved").isEmpty():
            return parents


def spanning_forest(points: DataFrame, min_samples: int, listed: int = LISTED) -> DataFrame:
    """Edges (a, b, w), stored, of a minimum spanning tree of points (id, embedding), ids distinct, under mutual reachability.

    A vector's core distance is that to its ``min_samples``-th nearest other, or to its farthest if there are fewer.
    """
    points = stored(points.select("id", blocks.vector(points)), "forest-points")
    n = points.count()
    keep = min(max(min_samples, listed), n - 1)
    if n < 2:
        return points.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("w")).limit(0)
    near = stored(neighbour_lists(points, n, keep), "forest-near")
    core = F.element_at("near", min(min_samples, keep))["d"]
    reach = F.lit(math.inf) if keep == n - 1 else F.element_at("near", -1)["d"]
    spots = stored(near.select("id", F.col("id").alias("component"), core.alias("core"), reach.alias("reach")), "forest-spots")
    pairs = near.select(F.col("id").alias("a"), F.explode("near").alias("e")).select(F.least("a", "e.id").alias("a"), F.greatest("a", "e.id").alias("b"), "e.d").distinct()
    cores = lambda end: spots.select(F.col("id").alias(end), F.col("core").alias(f"core_{end}"))
    edges = stored(pairs.join(cores("a"), "a").join(cores("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w")), "forest-edges")
    discard(near)
    tree: DataFrame | None = None
    while True:
        label = lambda end: spots.select(F.col("id").alias(end), F.col("component").alias(f"c{end}"))  # noqa: E731, B023
        crossing = lambda some: some.join(label("a"), "a").join(label("b"), "b").where("ca <> cb")  # noqa: E731, B023
        outgoing = lambda some: some.select("w", "a", "b", F.explode(F.array(F.struct(F.col("ca").alias("c"), F.col("cb").alias("o")), F.struct(F.col("cb").alias("c"), F.col("ca").alias("o")))).alias("x"))
        lightest = lambda some: outgoing(some).groupBy(F.col("x.c").alias("component")).agg(F.min(F.struct("w", "a", "b", F.col("x.o").alias("other"))).alias("e")).select("component", "e.*")
        older, edges = edges, stored(crossing(edges), "forest-edges")
        discard(older)
        bounds = spots.groupBy("component").agg(F.min("reach").alias("reach"))
        short = stored(bounds.join(lightest(edges), "component", "left").where(F.col("w").isNull() | (F.col("w") > F.col("reach"))).select("component"), "forest-short")
        unsure = spots.join(short, "component", "left_semi")
        left = unsure.count()
        if left:
            located = stored(points.join(spots, "id").select("id", "component", "core", "embedding"), "forest-located")
            asking, others = _dealt(located.join(short, "component", "left_semi"), left, "forest-asking"), _dealt(located, n, "forest-others")
            found = blocks.meet(asking, others, n, _width(points), _Lightest, _OUT)
            extra = found.groupBy("component").agg(F.min(F.struct("w", "a", "b")).alias("e")).select("e.*").distinct()
            older, edges = edges, stored(edges.unionByName(crossing(extra)).distinct(), "forest-edges")
            discard(older, located, asking, others)
        picks = stored(lightest(edges), "forest-picks")
        if picks.isEmpty():
            break
        chosen = picks.select("a", "b", "w").distinct()
        older, tree = tree, stored(chosen if tree is None else tree.unionByName(chosen), "forest-tree")
        to = _merged(picks)
        moved = stored(spots.join(to.select("component", "to"), "component").select("id", F.col("to").alias("component"), "core", "reach"), "forest-spots")
        discard(spots, short, picks, to, *([older] if older is not None else []))
        spots = moved
        edges = edges.select("a", "b", "w")
        if spots.select("component").distinct().count() == 1:
            break
    return tree
