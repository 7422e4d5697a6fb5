"""Density clustering of recent samples and what becomes of the clusters.

The weekly job clusters a sample whose size a cap bounds (newest rows of each label, in equal shares); rows
beyond the cap are not dropped from anything else.  Distances, core distances and the minimum spanning tree
are distributed (``operators.forest``); only the tree's edges, 24 bytes a row and so little more than a megabyte
at the cap, meet in one task, which condenses the hierarchy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.operators import forest, vectors
from sievewright.storage import stored


def _spanning_tree(core: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Edges (a, b, distance) of the minimum spanning tree under mutual reachability."""
    n = len(core)
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    best, source, done = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    at, edges = 0, np.zeros((n - 1, 3))
    for k in range(n - 1):
        done[at] = True
        reach = np.maximum(np.maximum(np.clip(1 - unit @ unit[at], 0, 2), core), core[at])
        nearer = ~done & (reach < best)
        best[nearer], source[nearer] = reach[nearer], at
        at = int(np.argmin(np.where(done, np.inf, best)))
        edges[k] = source[at], at, best[at]
    return edges[np.argsort(edges[:, 2], kind="stable")]


def hdbscan(x: np.ndarray, min_cluster_size: int = 5, min_samples: int = 3) -> np.ndarray:
    """Cluster numbers by cosine distance, -1 for noise, of vectors that are all here: what ``cluster_samples`` does apart."""
    n = len(x)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    core = np.empty(n)
    for s in range(0, n, 1024):
        norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
        unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
        near = np.clip(1 - unit[s : s + 1024] @ unit.T, 0, 2)
        k = min(min_samples, n - 1)
        core[s : s + 1024] = np.partition(near, k, axis=1)[:, k]
    return condensed(n, _spanning_tree(core, x), min_cluster_size)


def condensed(n: int, edges: np.ndarray, min_cluster_size: int) -> np.ndarray:
    """Cluster numbers of n rows, -1 for noise: stable clusters of the condensed hierarchy of a spanning tree's edges, by length."""
    # Single linkage: every merge is a node above its two parts.
    parent, node_of, size = list(range(n)), list(range(n)), [1] * n
    children: dict[int, tuple[int, int, float]] = {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b, d in edges.tolist():
        a, b = find(int(a)), find(int(b))
        children[len(size)] = (node_of[a], node_of[b], d)
        size.append(size[node_of[a]] + size[node_of[b]])
        parent[b], node_of[a] = a, len(size) - 1
    root = len(size) - 1

    def leaves(node: int) -> list[int]:
        out, todo = [], [node]
        while todo:
            v = todo.pop()
            if v < n:
                out.append(v)
            else:
                todo += children[v][:2]
        return out

    # Condense: a split into two parts of enough rows makes clusters, other splits shed rows.
    birth, stability, kids, members = {0: 0.0}, {0: 0.0}, {0: []}, {0: []}
    todo = [(root, 0)]
    while todo:
        node, c = todo.pop()
        if node < n:
            continue
        left, right, d = children[node]
        level = 1 / d if d > 0 else 1e12
        big = [v for v in (left, right) if size[v] >= min_cluster_size]
        if len(big) == 2:
            stability[c] += (level - birth[c]) * size[node]
            for v in big:
                new = len(birth)
                birth[new], stability[new], kids[new], members[new] = level, 0.0, [], []
                kids[c].append(new)
                todo.append((v, new))
            continue
        for v in (left, right):
            if v in big:
                todo.append((v, c))
            else:
                shed = leaves(v)
                members[c] += shed
                stability[c] += (level - birth[c]) * len(shed)
    chosen: set[int] = set()
    for c in sorted(birth, reverse=True):
        below = sum(stability[k] for k in kids[c])
        if c == 0:
            continue  # never the whole
        if not kids[c] or stability[c] >= below:
            drop = list(kids[c])
            while drop:
                k = drop.pop()
                chosen.discard(k)
                drop += kids[k]
            chosen.add(c)
        else:
            stability[c] = below
    labels = np.full(n, -1)
    for number, c in enumerate(sorted(chosen)):
        todo2 = [c]
        while todo2:
            k = todo2.pop()
            labels[members[k]] = number
            todo2 += kids[k]
    return labels


def cluster_samples(samples: DataFrame, *, cap: int = 50_000, min_cluster_size: int = 5, min_samples: int = 3) -> DataFrame:
    """(id, cluster) of active samples within the cap, noise left out."""
    active = samples.where(vectors.active_sample())
    labels = max(1, active.select("label_l1").distinct().count())
    bounded = vectors.stratified_sample(active, max(1, cap // labels)).select("id", F.col("embedding").cast("array<double>").alias("embedding"))

    edges = forest.spanning_forest(bounded, min_samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pa.Table.from_batches(list(batches), schema=pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.float64())])).sort_by([("w", "ascending"), ("a", "ascending"), ("b", "ascending")])
        a, b, w = (tree.column(c).to_numpy() for c in ("a", "b", "w"))
        ids = np.unique(np.concatenate([a, b]))
        if len(ids) >= max(2, min_cluster_size):
            found = condensed(len(ids), np.column_stack([np.searchsorted(ids, a), np.searchsorted(ids, b), w]), min_cluster_size)
            kept = found >= 0
            yield pa.RecordBatch.from_pydict({"id": ids[kept], "cluster": _by_first(found[kept]).astype(np.int32)})

    return edges.select("a", "b", "w").coalesce(1).mapInArrow(run, "id long, cluster int")


def _by_first(labels: np.ndarray) -> np.ndarray:
    """Labels numbered in the order of their first rows."""
    _, first, inverse = np.unique(labels, return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inverse]


def classify_clusters(clusters: DataFrame, samples: DataFrame) -> DataFrame:
    """(cluster, size, similarity, drift): each cluster's centroid against the labels' centroids."""
    rows = samples.where(vectors.active_sample())
    own = vectors.centroids(rows.join(clusters, "id").withColumn("label_l1", F.col("cluster").cast("string"))).select(F.col("label").cast("int").alias("query_id"), F.col("centroid").alias("embedding"))
    best = vectors.nearest(stored(own, "cluster-centroids"), stored(vectors.centroids(rows).select(F.xxhash64("label").alias("id"), F.col("label").alias("label_l1"), F.col("centroid").alias("embedding")), "label-centroids"), limit=1, threshold=-1.0)
    best = best.select(F.col("query_id").cast("int").alias("cluster"), "similarity")
    return clusters.groupBy("cluster").agg(F.count("*").alias("size")).join(best, "cluster").withColumn("drift", vectors.drift_class(F.col("similarity")))
