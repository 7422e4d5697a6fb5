"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; each of its documents then deserves the same expected
number of copies, target / source size.  The whole part is taken at once.  The fractional part is
rounded dependently: two fractional documents exchange *word mass*, in a random direction that keeps
both expectations, until one of them is whole.  The words taken from a source are therefore kept
exactly, up to the one document that stays fractional at the root of the reduction.

Scale: a source's documents are dealt by a hash of their ids over leaves of a bounded size, each leaf
is one pass from long to short documents and hands on one fractional document, and those residuals
meet in a tree of fixed fan-in, so a hot source is as parallel as a thin one.  Randomness comes from
hashes of ids and texts, so reruns agree whatever the partitioning.  Sources are a table, ranked over
range partitions; the driver sees a few sums.

Edge cases: a null text has size 0; documents without words take no words; a null source is a source,
ranked last; rows that repeat an id are rows of their own, and equal ones are told apart by a number; an
empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sources: DataFrame, weights: tuple[float, ...], total: float, most: float) -> DataFrame:
    """sources (sid from 0, source_size) with target: shares of total by weight in turn, none above most times its size.

    What a full source leaves is reshared: the share of a unit of weight grows until no further source is
    full.  Two sums reach the driver a round, however many sources there are.
    """
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod("sid", F.lit(len(weights))).cast("int"))
    sized = sources.withColumns({"_w": weight, "_most": most * F.col("source_size")})
    unit, n_full = 0.0, -1
    while True:
        full = F.lit(unit) * F.col("_w") > F.col("_most")
        r = sized.agg(F.sum(F.when(full, F.col("_most"))).alias("spent"), F.sum(F.when(~full, F.col("_w"))).alias("free"), F.count(F.when(full, 1)).alias("n")).first()
        if r.n == n_full or not r.free:
            break
        n_full, unit = r.n, (total - (r.spent or 0.0)) / r.free
    target = F.when(F.lit(unit) * F.col("_w") > F.col("_most"), F.col("_most")).otherwise(F.lit(unit) * F.col("_w"))
    return sized.withColumn("target", target.cast("double")).drop("_w", "_most")


_M = (1 << 64) - 1


def _uniform(key: int, other: int, seed: int) -> float:
    x = (key * 0x9E3779B97F4A7C15 + other * 0xC2B2AE3D27D4EB4F + seed * 0x165667B19E3779F9) & _M
    for _ in range(2):
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & _M
    return ((x ^ (x >> 32)) >> 11) / (1 << 53)


def pivot(size: np.ndarray, p: np.ndarray, key: np.ndarray, seed: int) -> tuple[np.ndarray, int]:
    """Round p to 0 or 1, long documents first, keeping the sum of size * p; -1 or the row left fractional."""
    out = p.astype(np.float64).copy()
    held = -1
    for j in np.lexsort((key, -size)).tolist():
        if not 0.0 < out[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        a, b, s, z = out[held], out[j], float(size[held]), float(size[j])
        up, down = min((1 - a) * s, b * z), min(a * s, (1 - b) * z)
        if _uniform(int(key[held]) & _M, int(key[j]) & _M, seed) * (up + down) < down:  # the held one gains
            first, second = (1.0, b - up / z) if (1 - a) * s <= b * z else (a + up / s, 0.0)
        else:
            first, second = (0.0, b + down / z) if a * s <= (1 - b) * z else (a - down / s, 1.0)
        snap = lambda x: 0.0 if x < 1e-12 else 1.0 if x > 1 - 1e-12 else x
        out[held], out[j] = snap(first), snap(second)
        if 0.0 < out[j] < 1.0:
            held = j
        elif not 0.0 < out[held] < 1.0:
            held = -1
    return out, held


def _rounder(seed: int, last: bool):
    def run(rows: pa.Table) -> pa.Table:
        size, p, key = (rows.column(c).to_numpy() for c in ("size", "p", "key"))
        out, held = pivot(size, p, key, seed)
        if held >= 0 and last:
            out[held] = float(_uniform(int(key[held]) & _M, 1, seed + 1) < out[held])
        return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(out))

    return run


def _mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    leaf: int = 2048,
    fan: int = 64,
    seed: int = 7,
) -> DataFrame:
    """mix_sources with a hash h of each text, and how many rows equal each one."""
    sized = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("h"))
    # Texts are read once; equal rows become numbered ones, so that each has a hash of its own.
    counted = kit.stored(sized.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("many")), "mix-sizes")
    per_source = counted.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("source_size"), F.sum(F.when(F.col("size") > 0, F.col("many")).otherwise(0)).alias("n"))
    ranked = kit.ranked(per_source, F.col("source").asc_nulls_last(), name="sid")
    facts = ranked.agg(F.sum("source_size").alias("words"), F.count("*").alias("sources"), F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    targets = source_targets(ranked, weights, share * (facts.words or 0), most)
    ratio = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    plan = targets.withColumn("whole", F.floor(ratio + 1e-12).cast("int")).withColumn("part", F.greatest(F.lit(0.0), ratio - F.col("whole")))
    sources = kit.stored(plan.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("n") / leaf)).cast("int")), "mix-sources", facts.sources)
    leaves = max(1, math.ceil((facts.most or 0) / leaf))
    small = kit.small(sources.select(F.col("source").alias("_s"), "sid", "whole", "part", "parts"), 64)
    rows = counted.withColumn("number", F.explode(F.sequence(F.lit(1).cast("long"), F.col("many"))))
    state = rows.join(small, F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id",
        "h",
        "many",
        "sid",
        "size",
        "whole",
        F.when(F.col("size") > 0, F.col("part")).otherwise(0.0).alias("p"),
        F.xxhash64("doc_id", "h", "number", F.lit(seed)).alias("key"),
        F.pmod(F.xxhash64("doc_id", "h", "number", F.lit(seed + 1)), F.col("parts")).cast("int").alias("leaf"),
    )
    schema = state.schema
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    done = [state.where(~fractional)]
    state, level = state.where(fractional), 0
    left = facts.rows or 0  # fractional rows at most
    while True:
        state = state.groupBy("sid", "leaf").applyInArrow(_rounder(seed + 10 * level, leaves == 1), schema)
        if leaves == 1:
            done.append(state)
            break
        state = kit.stored(state, f"mix-level{level}", left, 96)
        done.append(state.where(~fractional))
        left = leaves * facts.sources  # one a leaf
        leaves, level = math.ceil(leaves / fan), level + 1
        state = state.where(fractional).withColumn("leaf", F.floor(F.col("leaf") / fan).cast("int"))
    result = done[0]
    for more in done[1:]:
        result = result.unionByName(more)
    copies = (F.col("whole") + F.col("p")).cast("int")
    told = kit.small(sources.select("sid", "source", "source_size", "target"), 64)
    return result.join(told, "sid").select("doc_id", "h", "many", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"))


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """Columns of docs (doc_id, text, source, ...) become doc_id, source, size, source_size, target, copies, taken.

    Sources in code-point order, null last, get ``weights`` in turn and share ``share`` times all
    words, no source above ``most`` times its own; copies is the number of times to take a document.
    """
    return _mix(docs, **options).drop("h", "many")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it; columns of any other name are carried along.

    Of rows with equal id, source and text one stands for all: it is taken as often as they are together.
    """
    id_, h, source, n, many = kit.free_names(docs, "_id", "_h", "_source", "_n", "_many")
    picks = _mix(docs, **options).where("copies > 0").groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("source").alias(source)).agg(F.sum("copies").alias(n), F.first("many").alias(many))
    picks = kit.small(kit.stored(picks, "mix-picks", docs.count()), 48)
    kept = docs.join(picks, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(h)) & F.col("source").eqNullSafe(F.col(source)))
    single = kept.where(F.col(many) == 1).select(*docs.columns, n)
    repeated = kept.where(F.col(many) > 1).dropDuplicates([id_, h, source]).select(*docs.columns, n)
    both = single.unionByName(repeated)
    return both.withColumn(many, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)
