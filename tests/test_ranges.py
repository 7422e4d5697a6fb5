"""Search in scopes: against plain search, pairs of blocks left out, a plan that does not grow with the profiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import control, ranges


@pytest.fixture(scope="module")
def library(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(6, 10))
    x = np.concatenate([c + rng.normal(size=(30, 10)) * 0.15 for c in centres] + [np.zeros((2, 10))])
    rows = [(i, f"L{i % 4}", None, v.tolist(), "flat-v1", "accepted", True) for i, v in enumerate(x)]
    rows += [(900, "L1", None, [1.0, 2.0], "flat-v1", "accepted", True), (901, "L1", None, [], "flat-v1", "accepted", True), (902, "L1", None, [1.0, 2.1], "flat-v1", "accepted", True)]
    return spark.createDataFrame(rows, "id long, label_l1 string, label_l2 string, embedding array<double>, schema_version string, disposition string, reviewed boolean"), x


def plain(x, scopes, threshold, limit):
    norms = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)
    sims, out = unit @ unit.T, set()
    for q, scope in enumerate(scopes):
        near = sorted((-sims[q, i], i) for i in range(len(x)) if i != q and sims[q, i] >= threshold)
        inside = [p for p in near if scope is not None and f"L{p[1] % 4}" in scope]
        out |= {(q, i, scope is not None and not inside) for _, i in (inside or near)[:limit]}
    return out


@pytest.mark.parametrize("threshold", [0.9, 0.5, -1.0])
def test_against_plain_search(spark, library, threshold, monkeypatch):
    monkeypatch.setattr(ranges, "SAMPLE_BLOCK", 16)
    monkeypatch.setattr(ranges, "QUERY_BLOCK", 8)
    samples, x = library
    scopes = [[None, ["L0", "L2"], ["none"], [], ["L3"]][i % 5] for i in range(len(x))]
    queries = spark.createDataFrame([(i, v.tolist(), scopes[i]) for i, v in enumerate(x)], "query_id long, embedding array<double>, scope array<string>")
    got = {(r.query_id, r.id, r.scoped_fallback) for r in ranges.search(queries, samples, limit=7, threshold=threshold, exclude_self=True).where("id < 900").collect()}
    assert got == plain(x, scopes, threshold, 7)


def test_blocks_that_lie_apart_do_not_meet(spark, library):
    samples, x = library
    rows = samples.where("id < 180").select("id", F.col("embedding"))
    angles = ranges._angles([x[k].tolist() for k in range(0, 180, 30)])
    blocks = ranges._dealt(rows, angles, 10, "t")
    every = blocks.select(*ranges._KEY).distinct().count() ** 2
    assert ranges.block_pairs(blocks, blocks, 0.9, 6).count() < every / 2
    assert ranges.block_pairs(blocks, blocks, -1.0, 6).count() == every


def test_lengths_and_empty_inputs(spark, library):
    samples, _ = library
    asked = spark.createDataFrame([(1, [2.0, 4.0], None), (2, None, None), (3, [], None), (4, [1.0, 2.0, 3.0], ["L1"])], "query_id long, embedding array<double>, scope array<string>")
    assert [(r.query_id, r.id) for r in ranges.search(asked, samples, limit=5, threshold=0.99).orderBy("id").collect()] == [(1, 900), (1, 902)]
    assert ranges.search(asked, samples.limit(0), limit=5, threshold=0.1).collect() == []
    assert ranges.search(asked.limit(0), samples, limit=5, threshold=0.1).collect() == []


def test_one_search_for_any_number_of_profiles(spark, library):
    samples, x = library
    queries = spark.createDataFrame([(i, v.tolist(), f"p{i % 9}") for i, v in enumerate(x)], "query_id long, embedding array<double>, target_profile string")
    joins = lambda n: control.search_in_scopes(queries, samples, {f"p{k}": ("L1",) for k in range(n)})._jdf.queryExecution().optimizedPlan().toString().count("Join")
    assert joins(1) == joins(9) == joins(0)
