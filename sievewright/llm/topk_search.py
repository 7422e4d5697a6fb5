"""Exact top-k search by columnar branch and bound.

Vectors are quantised to integers and searched by inner product.  A block of candidates lies in
vertical layout, one row of memory a dimension.  Scores grow a block of dimensions at a time; what
the dimensions still to come can add is bounded by the product of the remaining norms (Cauchy and
Schwarz), and candidates whose upper bound is below the k-th best lower bound of every query of the
block are compacted away, so later blocks touch survivors only.

Scale: candidates and queries are dealt by hash over blocks of bounded size, every pair of blocks is
one task's work and returns k rows for each query, and those few are merged by a window for each
query.  Nothing is broadcast; no pair of vectors becomes a row.

Edge cases: vectors that are null or hold a null or non-finite component take no part; vectors of
unlike lengths are not compared; ties go to the smaller vec_id; rows that repeat an id are candidates
of their own but never answer a query of that id; a query that appears twice with equal components is
answered once; a null vec_id is no query and no answer.  Vectors whose products doubles cannot hold exactly
are multiplied as integers of any size, apart from the others; a score beyond 64 bits counts as the
nearest long, and among such ties the smaller vec_id comes first.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kit

_KEYS = ["dim", "cb", "qb"]


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, step: int = 16):
    """The k best of ids for each query: (query row, id, score); vectors is dims x candidates."""
    dims = vectors.shape[0]
    alive = np.arange(len(ids))
    partial = np.zeros((len(queries), len(ids)))
    own = query_ids[:, None] == ids[None, :]
    masses = vectors.astype(np.float64) ** 2
    rest_c = np.sqrt(masses[::-1].cumsum(axis=0)[::-1])  # remaining norm from each dimension on
    rest_q = np.sqrt((queries[:, ::-1] ** 2).cumsum(axis=1)[:, ::-1])
    for low in range(0, dims, step):
        high = min(dims, low + step)
        partial += queries[:, low:high] @ vectors[low:high, alive]
        if len(alive) <= k + 1 or high == dims:
            continue
        rest = rest_q[:, high, None] * rest_c[None, high, alive] * (1 + 1e-9)
        lower = np.where(own[:, alive], -np.inf, partial - rest)
        bar = np.partition(lower, len(alive) - k, axis=1)[:, len(alive) - k]
        keep = ((partial + rest >= bar[:, None]) & ~own[:, alive]).any(axis=0)
        if not keep.all():
            alive, partial = alive[keep], partial[:, keep]
    out = []
    scores = np.where(own[:, alive], -np.inf, partial)
    for row in range(len(queries)):
        line = scores[row]
        if len(line) > k:
            bar = np.partition(line, len(line) - k)[len(line) - k]
            pick = np.flatnonzero((line >= bar) & (line > -np.inf))
        else:
            pick = np.flatnonzero(line > -np.inf)
        order = np.lexsort((ids[alive[pick]], -line[pick]))[:k]
        out.append((np.full(len(order), row), ids[alive[pick[order]]], line[pick[order]]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


#: Scores are longs: what lies beyond them counts as the nearest one.
_LONGS = (-(2**63), 2**63 - 1)


def _whole(scale: float, rows: np.ndarray) -> np.ndarray:
    """floor(scale * x) as integers of any size; from 2^60 on doubles are integers, and so is a power of two times them."""
    return np.array([[int(x) * int(scale) if abs(x) >= 2**60 else math.floor(scale * x) for x in row] for row in rows.tolist()], dtype=object).reshape(rows.shape)


def search_large(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int):
    """As ``search_block`` of integers of any size, queries and candidates by row: the few whose sums doubles cannot hold."""
    out = []
    for row, (q, own) in enumerate(zip(queries, query_ids.tolist(), strict=True)):
        scores = sorted((-int(s), i) for s, i in zip(vectors @ q, ids.tolist(), strict=True) if i != own)[:k]
        out += [(row, i, max(_LONGS[0], min(_LONGS[1], -s))) for s, i in scores]
    return [np.array(x, dtype=np.int64) for x in (zip(*out, strict=True) if out else ((), (), ()))]


def _searcher(k: int, scale: float, rows: int = 64):
    def answer(query: np.ndarray, number: np.ndarray, found: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(query), pa.array(number), pa.array(found), pa.array(score)], names=["query_id", "qn", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in kit.whole_groups(batches, _KEYS):
            flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            dims = table.column("dim").to_numpy()
            at = np.concatenate([[0], np.cumsum(dims)])
            is_query, ids, number = (table.column(c).to_numpy(zero_copy_only=False) for c in ("is_query", "vec_id", "qn"))
            for s, e in zip(*map(np.ndarray.tolist, kit.group_slices(table, _KEYS)), strict=True):
                raw = flat[at[s] : at[e]].reshape(e - s, dims[s])
                asks = is_query[s:e].astype(bool)
                if asks.all() or not asks.any():
                    continue
                # Rows of which no two can have a sum beyond the integers that doubles hold.
                plain = np.abs(raw).max(axis=1) * scale + 1 < math.sqrt(2**53 / dims[s])
                block = np.floor(scale * raw[plain])
                mine = asks[plain]
                if mine.any() and not mine.all():
                    vertical = np.ascontiguousarray(block[~mine].T)
                    at_plain, candidates = np.flatnonzero(plain), ids[s:e][plain & ~asks]
                    for low in range(0, int(mine.sum()), rows):
                        some = np.flatnonzero(mine)[low : low + rows]
                        who = at_plain[some]
                        row, found, score = search_block(block[some], ids[s:e][who], vertical, candidates, k)
                        yield answer(ids[s:e][who][row], number[s:e][who][row], found, score.astype(np.int64))
                for left, right in ((asks & plain, ~asks & ~plain), (asks & ~plain, ~asks)):
                    if left.any() and right.any():
                        row, found, score = search_large(_whole(scale, raw[left]), ids[s:e][left], _whole(scale, raw[right]), ids[s:e][right], k)
                        yield answer(ids[s:e][left][row], number[s:e][left][row], found, score)

    return run


def exact_topk(vectors: DataFrame, is_query: Column, *, k: int = 5, scale: float = 256.0, candidate_block: int = 4096, query_block: int = 512) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows of vectors (vec_id, embedding) nearest to each query row."""
    kit.session(vectors)
    x = F.col("embedding")
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = vectors.where(x.isNotNull() & good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"), F.size(x).alias("dim"), is_query.alias("asks"))
    base = base.where("dim > 0")
    counts = base.agg(F.count("*").alias("n"), F.count(F.when(F.col("asks"), 1)).alias("q")).first()
    parts, asking = max(1, math.ceil(counts.n / candidate_block)), max(1, math.ceil(counts.q / query_block))
    deal = lambda n, salt: F.pmod(F.xxhash64("vec_id", "embedding", F.lit(salt)), F.lit(n)).cast("int")
    asked = base.where("asks").select("vec_id", "embedding", "dim", F.xxhash64("vec_id", "embedding").alias("qn")).dropDuplicates(["vec_id", "qn"])
    asked = asked.select("dim", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("cb"), deal(asking, 5).alias("qb"), F.lit(1).alias("is_query"), "vec_id", "qn", "embedding")
    # Rows of one id may be equal: they are told apart so that a block stays bounded.
    spread = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    others = base.select("dim", spread.alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(asking - 1))).alias("qb"), F.lit(0).alias("is_query"), "vec_id", F.lit(0).cast("long").alias("qn"), "embedding")
    dealt = others.unionByName(asked).repartition(*_KEYS).sortWithinPartitions(*_KEYS)
    best = dealt.mapInArrow(kit.tidy(_searcher(k, scale)), "query_id long, qn long, vec_id long, score long")
    order = Window.partitionBy("query_id", "qn").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
