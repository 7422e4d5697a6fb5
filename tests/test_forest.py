"""Spanning trees and clusters by blocks and rounds against plain ones."""

from __future__ import annotations

import numpy as np
import pytest

from sievewright.operators import clustering, forest


def plain_tree(x, min_samples):
    norms = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    d = np.round(np.clip(1 - unit @ unit.T, 0, 2), 12)
    np.fill_diagonal(d, np.inf)
    core = np.sort(d, axis=1)[:, min(min_samples, len(x) - 1) - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    done, total = {0}, []
    best = reach[0].copy()
    while len(done) < len(x):
        best[list(done)] = np.inf
        at = int(np.argmin(best))
        total.append(best[at])
        done.add(at)
        best = np.minimum(best, reach[at])
    return sorted(total)


def table(spark, x):
    return spark.createDataFrame([(1000 + i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")


@pytest.fixture(scope="module")
def blobs():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(5, 8))
    x = np.concatenate([c + rng.normal(size=(24, 8)) * s for c, s in zip(centres, (0.02, 0.05, 0.1, 0.1, 0.2), strict=True)] + [rng.normal(size=(15, 8))])
    return np.concatenate([x, x[:4], np.zeros((2, 8))])  # copies, and vectors without a direction


@pytest.mark.parametrize("listed", [1, 16, 500])
def test_tree_is_minimal(spark, blobs, listed, monkeypatch):
    monkeypatch.setattr(forest, "BLOCK", 40)
    edges = forest.spanning_forest(table(spark, blobs), 3, listed).collect()
    assert len(edges) == len(blobs) - 1 == len({(e.a, e.b) for e in edges})
    assert np.allclose(sorted(e.w for e in edges), plain_tree(blobs, 3), atol=1e-12)
    parent = {1000 + i: 1000 + i for i in range(len(blobs))}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for e in edges:
        a, b = find(e.a), find(e.b)
        assert a != b
        parent[a] = b


def test_small_inputs(spark):
    x = np.eye(3)
    assert forest.spanning_forest(table(spark, x[:0]).limit(0), 3).collect() == [] == forest.spanning_forest(table(spark, x[:1]), 3).collect()
    assert len(forest.spanning_forest(table(spark, x[:2]), 3).collect()) == 1


def test_clusters_are_those_of_one_piece(spark, blobs):
    rows = [(int(i), f"l{i % 2}", None, v.tolist(), "flat-v1", "accepted", True, int(i)) for i, v in enumerate(blobs[:120])]
    samples = spark.createDataFrame(rows, "id long, label_l1 string, label_l2 string, embedding array<double>, schema_version string, disposition string, reviewed boolean, created_s long")
    got = {r.id: r.cluster for r in clustering.cluster_samples(samples).collect()}
    plain = clustering.hdbscan(np.round(blobs[:120], 15))
    groups = lambda pairs: {frozenset(i for i, c in pairs if c == k) for k in {c for _, c in pairs}}
    assert groups(list(got.items())) == groups([(i, c) for i, c in enumerate(plain.tolist()) if c >= 0])
    assert sorted(set(got.values())) == list(range(len(set(got.values()))))
    drift = clustering.classify_clusters(spark.createDataFrame(list(got.items()), "id long, cluster int"), samples).collect()
    assert len(drift) == len(set(got.values())) and all(-1 <= r.similarity <= 1 for r in drift)
    assert clustering.cluster_samples(samples.limit(0)).collect() == []
