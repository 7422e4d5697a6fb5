"""Merkle manifest against a plain tree, proofs that fail once anything changes, edges."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sievewright.llm.merkle import build_manifest, fold_proof, manifest_digest, tampered_text, verified


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row.doc_id, row.source, row.lang, row.n_chars, text)))


def climb(nodes):
    """The root, and for every node the runs it goes through with its place in each."""
    ways, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 3] for i in range(0, len(nodes), 3)]
        for way, k in zip(ways, range(len(places)), strict=True):
            way.append((runs[places[k] // 3], places[k] % 3))
            places[k] //= 3
        nodes = [digest("".join(r)) for r in runs]
    return nodes[0], ways


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for s in sources:
        by[s].sort(key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append(climb([leaf(r, r.text) for r in by[s]]))
    root, ways = climb([sub for sub, _ in trees])
    out = []
    for s, (sub, mine), above in zip(sources, trees, ways, strict=True):
        for r, way in zip(by[s], mine, strict=True):
            siblings = "".join(d for run, i in way + above for j, d in enumerate(run) if j != i)
            cut = r.text is not None and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            folded = leaf(r, r.text.replace("\n", "") if cut else r.text)
            for run, i in way + above:
                folded = digest("".join([*run[:i], folded, *run[i + 1 :]]))
            out.append((r.doc_id, leaf(r, r.text), sub, root, digest(siblings), folded, folded == root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def table(spark, docs):
    rows = [(i, [None, "", "one\ntwo", "grün\n😀", f"text {i}"][i % 5]) for i in range(150)]
    rows += [(3, "again\n"), (3, "again\n"), (None, "no\nid"), (None, None)]
    # One source has most rows, one a single row, one is null.
    source = F.when(F.col("doc_id") == 149, "é").when(F.col("doc_id") % 29 == 0, None).when(F.col("doc_id") > 30, "hot").otherwise(F.col("source"))
    return docs(rows).withColumn("source", source).withColumns({"digest": F.lit("x"), "tree": F.lit(1), "at": F.lit(2), "proof": F.lit("p")})


@pytest.mark.parametrize("height", [7, 1, 2])
def test_manifest_equals_a_plain_tree(table, height):
    got = manifest_digest(verified(build_manifest(table, tampered_text(), height), "other")).collect()
    assert sorted(map(tuple, got), key=repr) == brute(table.collect())


def test_edges(spark, docs):
    nothing = docs([(1, "x")]).limit(0)
    assert manifest_digest(verified(build_manifest(nothing))).collect() == []
    one = manifest_digest(verified(build_manifest(docs([(4, "x\n")])))).first()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.verified and one.proof_sha256 == digest("")


def test_proofs_bind_place_and_siblings(table):
    rows = build_manifest(table).where("source = 'hot'").collect()
    for r in rows[:20]:
        places = ((r.at, r.n), (r.tree, r.trees))
        assert fold_proof(bytes(r.digest), bytes(r.proof), places) == bytes(r.root)
        assert fold_proof(bytes(r.digest), bytes(r.proof[::-1]), places) != bytes(r.root)
        assert fold_proof(bytes(r.root), bytes(r.proof), places) != bytes(r.root)
