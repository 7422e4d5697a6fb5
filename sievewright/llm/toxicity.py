"""Toxicity scores by a counterfactual-regularised classifier.

A logistic model over words and word beginnings that a text holds once, twice and three times or more
(hashed; a longer text is not worth less, so an insult in it counts as in a short one).  For each labelled text that mentions
a group, a counterfactual swaps every identity term for the next one of its group of terms, and the
squared difference of the two logits is a penalty of the loss: the model may not lean on who is
mentioned, which is what makes neutral mentions score high.  An L1 penalty, for each feature in
proportion to the deviation of its count among toxic rows, picks features that chance does not
explain, then the model is refitted on them.

Scale: fitting sees at most ``sample`` labelled rows, those with the smallest hashes of their ids, and of
these as many as ``sample_bytes`` of hashed features hold, on the driver (documented bounds).  Scoring is one pass over whole texts with a
weight table of fixed size, no shuffle.  Nothing but the text enters a score.

Edge cases: null and empty texts score the intercept; without labelled rows every score is 0; rows that
repeat an id are scored by their own texts, and the text of the smallest hash is the one learnt from;
several labels of an id count as toxic if one is; a null doc_id is scored and is not held out; columns of
any other name are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kit

BITS = 18
#: Lengths in bytes of the word beginnings that are features, besides whole words.
PREFIXES = (4, 5, 7)
#: A word or beginning is one feature if it occurs, another if it does so twice, and so on.
LEVELS = 3
WIDTH = LEVELS << BITS
#: Groups of terms that may stand for each other in a counterfactual (a parameter).
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("woman", "man"),
    ("women", "men"),
    ("female", "male"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("immigrant", "refugee", "native", "foreigner"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("disabled", "blind", "deaf"),
    ("old", "young", "elderly"),
)

_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Feature buckets of each word: the word itself and its beginnings (-1 where it is no longer)."""
    shift = np.uint64(64 - BITS)
    out = [(kit.word_hashes(raw, starts, ends) >> shift).astype(np.int32)]
    for n in PREFIXES:
        longer = ends - starts > n
        at = np.full(len(starts), -1, dtype=np.int32)
        salted = kit.word_hashes(raw, starts[longer], starts[longer] + n) + np.uint64(n)
        at[longer] = (kit.mix(salted) >> shift).astype(np.int32)
        out.append(at)
    return out


def _buckets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every feature occurrence of lowered texts."""
    raw, offsets = kit.text_bytes(column)
    starts, ends, words = kit.word_bounds(raw, offsets, _BETWEEN)
    row = np.repeat(np.arange(len(words) - 1), np.diff(words))
    parts = _hash(raw, starts, ends)
    rows, at = np.tile(row, len(parts)), np.concatenate(parts)
    return rows[at >= 0], at[at >= 0]


def _features(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of occurrences: bucket and level for every level that the bucket's count reaches."""
    key, counts = np.unique(rows.astype(np.int64) << BITS | at, return_counts=True)
    rows, bucket = key >> BITS, key & ((1 << BITS) - 1)
    reach = [counts > n for n in range(LEVELS)]
    return np.concatenate([rows[r] for r in reach]), np.concatenate([bucket[r] + (n << BITS) for n, r in enumerate(reach)])


def _present(column: pa.Array) -> list[np.ndarray]:
    rows, features = _features(*_buckets(column))
    order = np.argsort(rows, kind="stable")
    return np.split(features[order].astype(np.int32), np.searchsorted(rows[order], np.arange(1, len(column))))


def swap_terms(text: str, groups=IDENTITY_TERMS) -> str:
    """The text with each identity term replaced by the next one of its group; letters in lower case."""
    import regex

    following = {t: g[(i + 1) % len(g)] for g in groups for i, t in enumerate(g)}
    if not following:
        return text
    return regex.sub(r"(?<![^\W_])(?:" + "|".join(sorted(following, key=len, reverse=True)) + r")(?![^\W_])", lambda m: following[m[0]], text)


def _featurer(groups):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [t or "" for t in batch.column("text").to_pylist()]
            swapped = [swap_terms(t, groups) for t in texts]
            own, other = _present(pa.array(texts, pa.large_string())), _present(pa.array(swapped, pa.large_string()))
            gone = [np.setdiff1d(a, b).tobytes() for a, b in zip(own, other, strict=True)]
            come = [np.setdiff1d(b, a).tobytes() for a, b in zip(own, other, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *(pa.array(x, pa.binary()) for x in ([a.tobytes() for a in own], gone, come))], names=["doc_id", "toxic", "own", "gone", "come"])

    return run


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of the features that were picked, and the intercept."""

    buckets: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(WIDTH, dtype=np.float32)
        out[self.buckets] = self.weights
        return out


class _Sparse:
    """Rows of feature indices, each with the value 1 or -1."""

    def __init__(self, rows: list[np.ndarray], signs: list[np.ndarray], width: int):
        self.at = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
        self.sign = np.concatenate([*signs, np.zeros(0)])
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.n, self.width = len(rows), width

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.at] * self.sign, minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, weights=g[self.row] * self.sign, minlength=self.width)


def fit(own: list[np.ndarray], gone: list[np.ndarray], come: list[np.ndarray], toxic: np.ndarray, *, fair: float = 1.0, doubt: float = 4.0, least: float = 3.0, l2: float = 3e-6, steps: int = 300) -> ToxicityModel:
    """Fit on feature lists: ``gone`` and ``come`` are what a counterfactual takes away and adds.

    A feature needs ``doubt`` standard deviations, and ``least`` rows, more than chance.
    """
    n, positive = len(toxic), float(np.sum(toxic))
    if not n:
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    if positive in (0, n):
        return ToxicityModel(np.zeros(0, np.int64), np.zeros(0), np.log((positive + 0.5) / (n - positive + 0.5)))
    share = positive / n
    counts, excess = np.zeros(WIDTH), np.zeros(WIDTH)
    for low in range(0, n, 1000):
        some = own[low : low + 1000]
        every = np.concatenate(some)
        counts += np.bincount(every, minlength=WIDTH)
        excess += np.bincount(every, weights=np.repeat(toxic[low : low + 1000] - share, [len(r) for r in some]), minlength=WIDTH)
    penalty = np.maximum(least, doubt * np.sqrt(counts * share * (1 - share)))
    used = np.flatnonzero(np.abs(excess) >= penalty / 2)  # others stay at 0 anyway
    place = np.full(WIDTH, -1)
    place[used] = np.arange(len(used))
    keep = lambda rows: [p[p >= 0] for p in (place[r] for r in rows)]
    x = keep(own)
    data = _Sparse(x, [np.ones(len(r)) for r in x], len(used))
    swaps = [(a, b) for a, b in zip(keep(gone), keep(come), strict=True) if len(a) or len(b)]
    pairs = _Sparse([np.concatenate(s) for s in swaps], [np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in swaps], len(used))

    def solve(w: np.ndarray, b: float, free: np.ndarray, l1: np.ndarray | float, l2: float) -> tuple[np.ndarray, float]:
        """Accelerated proximal gradient with backtracking."""
        y, yb, t, size = w, b, 1.0, 1.0

        def loss(w, b):
            z = data.dot(w) + b
            d = pairs.dot(w)
            return np.mean(np.logaddexp(0, z) - toxic * z) + fair * np.sum(d * d) / n + l2 * (w @ w) / 2, z, d

        for _ in range(steps):
            f, z, d = loss(y, yb)
            g = 1 / (1 + np.exp(-np.clip(z, -60, 60))) - toxic
            gw = (data.back(g) / n + 2 * fair * pairs.back(d) / n + l2 * y) * free
            gb = g.mean()
            while True:
                step = y - size * gw
                new = np.sign(step) * np.maximum(np.abs(step) - size * l1, 0)
                nb = yb - size * gb
                dw, db = new - y, nb - yb
                if loss(new, nb)[0] <= f + gw @ dw + gb * db + (dw @ dw + db * db) / (2 * size) + 1e-12:
                    break
                size /= 2
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            y, yb = new + (t - 1) / t2 * (new - w), nb + (t - 1) / t2 * (nb - b)
            moved = np.abs(new - w).max() if len(w) else 0
            w, b, t, size = new, nb, t2, size * 1.25
            if moved < 1e-4:
                break
        return w, b

    w, b = solve(np.zeros(len(used)), float(np.log(positive / (n - positive))), np.ones(len(used)), penalty[used] / n, 0.0)
    picked = (w != 0).astype(float)
    w, b = solve(w, b, picked, 0.0, l2)
    at = np.flatnonzero(picked)
    return ToxicityModel(used[at], w[at], float(b))


def train_toxicity(docs: DataFrame, labels: DataFrame, *, sample: int = 10_000, sample_bytes: int = 128 << 20, groups=IDENTITY_TERMS, **options) -> ToxicityModel:
    """Fit on the rows of docs (doc_id, text) that labels (doc_id, toxic) cover, held-out rows apart."""
    kit.session(docs)
    given = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = given.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").limit(sample)  # at most ``sample`` rows: small enough to broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("text")).join(F.broadcast(chosen), "doc_id")
    texts = texts.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))  # one row an id
    found = kit.stored(texts.mapInArrow(kit.tidy(_featurer(groups)), "doc_id long, toxic int, own binary, gone binary, come binary"), "toxicity-features")
    size = sum(F.octet_length(c) for c in ("own", "gone", "come"))
    order = Window.orderBy(F.xxhash64("doc_id", F.lit(29)), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = found.select("doc_id", F.sum(size).over(order).alias("bytes")).where(F.col("bytes") <= sample_bytes)  # of at most ``sample`` narrow rows
    rows = found.join(F.broadcast(upto.select("doc_id")), "doc_id").select("toxic", "own", "gone", "come").toArrow()
    kit.discard(found)
    toxic, own, gone, come = (rows.column(c).to_pylist() for c in ("toxic", "own", "gone", "come"))
    order = sorted(range(len(own)), key=lambda k: (toxic[k], own[k]))
    lists = [[np.frombuffer(x[k], dtype=np.int32) for k in order] for x in (own, gone, come)]
    model = fit(*lists, np.array([toxic[k] for k in order], dtype=np.float64), **options)
    del own, gone, come
    del rows, lists
    kit.give_back()
    return model


def held_out(doc_id):
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _scorer(model: ToxicityModel, lowered: str = "lowered", scored: str = "score"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = model.table()
        live = (table.reshape(LEVELS, -1) != 0).any(axis=0)
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, at = _buckets(batch.column(lowered))
            hit = live[at]
            rows, features = _features(rows[hit], at[hit])
            z = np.bincount(rows, weights=table[features], minlength=batch.num_rows) + model.intercept
            score = 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(model.intercept) else np.zeros(batch.num_rows)
            rest = [c for c in batch.schema.names if c != lowered]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(score, pa.float64())], names=[*rest, scored])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score in 0 to 1 and predicted (score >= 0.5) for every row of docs (doc_id, text)."""
    kit.session(docs)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower("text").alias("lowered"))
    scored = base.mapInArrow(kit.tidy(_scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs (text and whatever else, of any name) that are not predicted toxic, in one pass."""
    kit.session(docs)
    low, score = kit.free_names(docs, "lowered", "score")
    base = docs.select("*", F.lower("text").alias(low))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{score}` double"
    return base.mapInArrow(kit.tidy(_scorer(model, low, score)), schema).where(F.col(score) < 0.5).select(*docs.columns)
