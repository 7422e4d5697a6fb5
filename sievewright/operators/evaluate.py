"""Predictions against adjudicated labels: counts, intervals, mismatches and release gates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import scores


@dataclass(frozen=True)
class Gate:
    overall_precision: float | None = 0.98
    label_precision: float | None = 0.95
    overrides: dict[str, float | None] = field(default_factory=dict)
    minimum_eligible: int = 100


def test_pairs(gold: DataFrame, preds: DataFrame, split: str = "test") -> DataFrame:
    """Gold rows of a split with their predictions: gold, suggested and automatic label sets (arrays).

    A missing prediction suggests nothing; one for review suggests, but decides nothing.
    """
    unlist = lambda c: F.array_sort(F.array_distinct(F.split(c, ",")))
    none = F.array().cast("array<string>")
    kept = gold.where(F.col("split") == split).select("sample_id", unlist("labels").alias("gold"))
    seen = preds.select("sample_id", unlist("labels").alias("suggested"), "needs_human_review", "strategy", F.lit(True).alias("present"))
    joined = kept.join(seen, "sample_id", "left")
    auto = F.coalesce(F.col("present") & ~F.col("needs_human_review"), F.lit(False))
    return joined.select(
        "sample_id",
        "gold",
        F.coalesce("suggested", none).alias("suggested"),
        F.when(auto, F.col("suggested")).otherwise(none).alias("decided"),
        auto.alias("auto"),
        F.coalesce("present", F.lit(False)).alias("present"),
        F.coalesce("needs_human_review", F.lit(False)).alias("review"),
        "strategy",
    )


def _metrics(df: DataFrame) -> DataFrame:
    low, high = scores.wilson(F.col("tp"), F.col("tp") + F.col("fp"))
    return df.withColumns({"precision": scores.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": scores.ratio(F.col("tp"), F.col("tp") + F.col("fn")), "wilson_low": low, "wilson_high": high})


def micro(pairs: DataFrame) -> DataFrame:
    """One row: tp, fp, fn over all label decisions, precision, recall and the interval of precision."""
    counts = pairs.agg(
        F.sum(F.size(F.array_intersect("gold", "decided"))).cast("long").alias("tp"),
        F.sum(F.size(F.array_except("decided", "gold"))).cast("long").alias("fp"),
        F.sum(F.size(F.array_except("gold", "decided"))).cast("long").alias("fn"),
    )
    return _metrics(counts.na.fill(0))


def per_label(pairs: DataFrame) -> DataFrame:
    """A row for every label that gold has or a prediction suggests."""
    each = pairs.select(F.explode(F.array_union("gold", "suggested")).alias("label"), "gold", "decided")
    inside, said = F.array_contains("gold", F.col("label")), F.array_contains("decided", F.col("label"))
    counts = each.groupBy("label").agg(
        F.count(F.when(inside & said, 1)).alias("tp"), F.count(F.when(~inside & said, 1)).alias("fp"), F.count(F.when(inside & ~said, 1)).alias("fn")
    )
    return _metrics(counts)


def mismatches(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("auto") & (F.col("gold") != F.col("decided"))).select("sample_id", F.array_join("gold", ",").alias("gold_labels"), F.array_join("decided", ",").alias("predicted_labels"), "strategy")


def summary(pairs: DataFrame, n_gold: int | None = None) -> DataFrame:
    """Totals, rates and how much of gold was suggested at all."""
    n = F.count("*")
    counts = pairs.agg(
        n.alias("total_examples"),
        F.count(F.when(F.col("auto"), 1)).alias("auto_accepted"),
        F.count(F.when(F.col("review"), 1)).alias("reviewed"),
        F.count(F.when(~F.col("present"), 1)).alias("missing"),
        F.sum(F.size(F.array_intersect("gold", "suggested"))).alias("_hit"),
        F.sum(F.size("gold")).alias("_gold"),
    )
    rate = lambda c: F.coalesce(scores.ratio(F.col(c), F.col("total_examples")), F.lit(0.0))
    return counts.withColumns({"review_rate": rate("reviewed"), "coverage": rate("auto_accepted"), "suggestion_recall": scores.ratio(F.col("_hit"), F.col("_gold"))}).drop("_hit", "_gold")


def version_distribution(preds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(field, value, n): how often predictions carry each version."""
    each = F.explode(F.array(*[F.struct(F.lit(c.removeprefix("v_")).alias("field"), F.coalesce(F.col(c), F.lit("<none>")).alias("value")) for c in columns]))
    return preds.select(each.alias("x")).select("x.*").groupBy("field", "value").agg(F.count("*").alias("n"))


def taxonomy_mismatches(gold: DataFrame, preds: DataFrame, expected: str, split: str = "test") -> DataFrame:
    tested = gold.where(F.col("split") == split).select("sample_id")
    return preds.join(tested, "sample_id", "left_semi").where(~F.col("v_taxonomy").eqNullSafe(F.lit(expected))).select("sample_id", F.col("v_taxonomy").alias("prediction_version"))


def unknown_predictions(gold: DataFrame, preds: DataFrame) -> DataFrame:
    """Predictions of samples that gold does not have: an evaluation must not go on with any."""
    return preds.join(gold.select("sample_id"), "sample_id", "left_anti")


def release_gate(pairs: DataFrame, gate: Gate = Gate(), n_mismatches: DataFrame | None = None) -> DataFrame:
    """One row: status, eligible, passed, reasons (in order) and the eligible decisions."""
    whole = micro(pairs)
    overrides = F.lit(None).cast("double")
    label = F.col("label")
    threshold = F.lit(gate.label_precision).cast("double")
    for name, value in gate.overrides.items():
        threshold = F.when(label == name, F.lit(value).cast("double")).otherwise(threshold)
    del overrides
    judged = per_label(pairs).withColumn("threshold", threshold).where("threshold is not null")
    decisions = F.col("tp") + F.col("fp")
    few = decisions < gate.minimum_eligible
    weak = ~few & (F.col("wilson_low").isNull() | (F.col("wilson_low") < F.col("threshold")))
    order = F.struct("label", F.when(few, "insufficient_label_support").when(weak, "label_precision_below_threshold").alias("reason"))
    labels = judged.agg(F.array_sort(F.collect_list(order)).alias("_labels"))  # a row a label
    joined = whole.join(labels)
    joined = joined.join(n_mismatches.agg(F.count("*").alias("_mismatched"))) if n_mismatches is not None else joined.withColumn("_mismatched", F.lit(0))
    supported = decisions >= gate.minimum_eligible
    overall = F.lit(False) if gate.overall_precision is None else supported & (F.col("wilson_low").isNull() | (F.col("wilson_low") < gate.overall_precision))
    by_label = F.filter(F.transform("_labels", lambda x: x["reason"]), lambda r: r.isNotNull())
    reasons = F.array_distinct(
        F.concat(
            F.array_compact(F.array(F.when(F.col("_mismatched") > 0, "taxonomy_version_mismatch"), F.when(~supported, "insufficient_volume"), F.when(overall, "overall_precision_below_threshold"))),
            by_label,
        )
    )
    eligible = supported & ~F.array_contains(by_label, "insufficient_label_support")
    passed = eligible & (F.size(reasons) == 0)
    return joined.select(
        F.when(~eligible, "ineligible").when(passed, "passed").otherwise("failed").alias("status"),
        eligible.alias("eligible"),
        passed.alias("passed"),
        F.array_join(reasons, ",").alias("reasons"),
        decisions.alias("eligible_decisions"),
    )


def corpus_violations(gold: DataFrame, valid: Sequence[str], exclusive: Sequence[str]) -> DataFrame:
    """(sample_id, violation) of every rule that a gold row breaks."""
    labels, refs = F.array_distinct(F.split("labels", ",")), F.split("refs", ",")
    crossing = gold.groupBy("thread_id").agg(F.count_distinct("split").alias("_splits"))
    repeated = gold.groupBy("sample_id").agg(F.count("*").alias("_rows"))
    tests = {
        "duplicate_sample_id": F.col("_rows") > 1,
        "unknown_label": F.size(F.array_except(labels, F.array(*map(F.lit, valid)))) > 0,
        "exclusive_label": F.arrays_overlap(labels, F.array(*map(F.lit, exclusive))) & (F.size(labels) > 1),
        "annotation_refs": (F.size(F.array_distinct(refs)) < 2) | F.exists(refs, lambda r: F.trim(r) == ""),
        "not_adjudicated": ~F.col("adjudicated"),
        "split_leakage": F.col("_splits") > 1,
    }
    found = F.explode(F.array_compact(F.array(*[F.when(test, name) for name, test in tests.items()])))
    return gold.join(crossing, "thread_id").join(repeated, "sample_id").select("sample_id", found.alias("violation"))
