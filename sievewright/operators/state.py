"""Run, feedback and ledger state as folds and joins over append-only tables."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Allowed transitions of a run, and action types that need a person.
TRANSITIONS = (
    ("pending", "processing"),
    ("processing", "completed"),
    ("processing", "waiting_approval"),
    ("processing", "failed"),
    ("waiting_approval", "completed"),
    ("waiting_approval", "rejected"),
    ("failed", "pending"),
)


def transition(runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Compare and set: runs (run_id, status) with requested target; won where the move is allowed."""
    allowed = runs.sparkSession.createDataFrame(list(TRANSITIONS), "status string, target string").withColumn("_ok", F.lit(True))
    joined = runs.join(requests.select("run_id", "target"), "run_id").join(allowed, ["status", "target"], "left")
    won = F.coalesce("_ok", F.lit(False))
    return joined.select("run_id", F.col("status").alias("before"), "target", won.alias("won"), F.when(won, F.col("target")).otherwise(F.col("status")).alias("status"))


def next_revisions(feedback: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """feedback with its revision: one more than the run's last, in order of review."""
    order = Window.partitionBy("run_id").orderBy("reviewed_at", "feedback_id")
    numbered = feedback.withColumn("revision", F.row_number().over(order))
    if base is None:
        return numbered
    last = base.groupBy("run_id").agg(F.max("revision").alias("_last"))
    return numbered.join(last, "run_id", "left").withColumn("revision", F.col("revision") + F.coalesce("_last", F.lit(0))).drop("_last")


def expired_runs(runs: DataFrame, feedback: DataFrame, cutoff: Column) -> DataFrame:
    """Runs created before the cutoff that no feedback refers to."""
    return runs.where(F.col("created_at") < cutoff).join(feedback.select("run_id"), "run_id", "left_anti")


def retention_counts(runs: DataFrame, feedback: DataFrame, ledger: DataFrame, as_of: Column, *, runs_days: int = 90, feedback_days: int = 365, ledger_days: int = 90) -> DataFrame:
    """(entity, deleted) of a clean-up, feedback first; 0 days skip a table."""
    before = lambda days: as_of - F.make_dt_interval(F.lit(days))
    parts, kept = [], feedback
    if feedback_days:
        old = F.col("reviewed_at") < before(feedback_days)
        parts.append(feedback.where(old).agg(F.lit("feedback").alias("entity"), F.count("*").alias("deleted")))
        kept = feedback.where(~old)
    if runs_days:
        parts.append(expired_runs(runs, kept, before(runs_days)).agg(F.lit("runs").alias("entity"), F.count("*").alias("deleted")))
    if ledger_days:
        parts.append(ledger.where((F.col("ts") < before(ledger_days)) & (F.col("status") != "claimed")).agg(F.lit("ledger").alias("entity"), F.count("*").alias("deleted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def apply_policy(actions: DataFrame, blocked: Sequence[str], approval: Sequence[str]) -> DataFrame:
    """actions (action_type) with risk, requires_approval and status."""
    stop, ask = F.col("action_type").isin(*blocked), F.col("action_type").isin(*approval)
    return actions.withColumns(
        {
            "risk": F.when(stop | ask, "high").otherwise("low"),
            "requires_approval": stop | ask,
            "action_status": F.when(stop, "blocked").otherwise("proposed"),
        }
    )


def decide_actions(actions: DataFrame, approved: bool) -> DataFrame:
    """Approval turns proposed into approved; rejection turns proposed and blocked into rejected."""
    status = F.col("action_status")
    new = F.when(status == "proposed", "approved") if approved else F.when(status.isin("proposed", "blocked"), "rejected")
    return actions.withColumn("action_status", F.coalesce(new, status))


def pending_outbox(outbox: DataFrame, limit: int = 100) -> DataFrame:
    """Undispatched jobs, oldest first."""
    return outbox.where("dispatched_at is null").orderBy("created_at", "run_id").limit(limit)


def fold_outbox(outbox: DataFrame, events: DataFrame) -> DataFrame:
    """outbox with the outcome of attempts (run_id, ok, error, at): dispatched, or one more failure."""
    done = events.groupBy("run_id").agg(
        F.max(F.when(F.col("ok"), F.col("at"))).alias("_at"), F.count(F.when(~F.col("ok"), 1)).alias("_failed"), F.max_by(F.substring("error", 1, 4000), F.when(~F.col("ok"), F.col("at"))).alias("_error")
    )
    return outbox.join(done, "run_id", "left").select(
        *[c for c in outbox.columns if c not in ("dispatched_at", "attempts", "last_error")],
        F.coalesce("dispatched_at", "_at").alias("dispatched_at"),
        (F.col("attempts") + F.coalesce("_failed", F.lit(0))).alias("attempts"),
        F.coalesce("_error", "last_error").alias("last_error"),
    )


def latest(rows: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(current: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current with the rows of changes instead of those of equal keys."""
    return current.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes, allowMissingColumns=True)


def next_versions(skills: DataFrame, new: DataFrame) -> DataFrame:
    """new (skill_id, run_id) with version: one more than the skill's last, in order of run_id."""
    last = skills.groupBy("skill_id").agg(F.max("version").alias("_last"))
    order = Window.partitionBy("skill_id").orderBy("run_id")
    numbered = new.withColumn("_n", F.row_number().over(order)).join(last, "skill_id", "left")
    return numbered.withColumn("version", F.col("_n") + F.coalesce("_last", F.lit(0))).withColumn("published", F.lit(False)).drop("_n", "_last")


def fold_ledger(claims: DataFrame, events: DataFrame) -> DataFrame:
    """claims (mailbox_id, dedup_key, status) after events (same key, seq, status, run_id).

    A run is attached only to a claim that is still claimed; otherwise the last event decides.
    """
    key = ["mailbox_id", "dedup_key"]
    done = events.groupBy(*key).agg(F.max_by("status", F.when(F.col("status") != "attached", F.col("seq"))).alias("_status"), F.min(F.when(F.col("status") != "attached", F.col("seq"))).alias("_first"))
    attached = events.where("status = 'attached'").join(done.select(*key, "_first"), key, "left").where(F.col("_first").isNull() | (F.col("seq") < F.col("_first")))
    runs = attached.groupBy(*key).agg(F.max_by("run_id", "seq").alias("run_id"))
    final = F.when(F.col("_first").isNotNull(), F.col("_status")).otherwise(F.col("status"))
    return claims.join(done, key, "left").join(runs, key, "left").select(*key, final.alias("status"), F.when(claims["status"] == "claimed", F.col("run_id")).alias("run_id"))


def feedback_violations(feedback: DataFrame, valid: Sequence[str], exclusive: Sequence[str]) -> DataFrame:
    """(feedback_id, violation) of feedback whose labels (array) are not acceptable."""
    labels = F.col("labels")
    tests = {
        "no_labels": F.size(labels) == 0,
        "unknown_label": F.size(F.array_except(labels, F.array(*map(F.lit, valid)))) > 0,
        "repeated_label": F.size(F.array_distinct(labels)) < F.size(labels),
        "exclusive_label": F.arrays_overlap(labels, F.array(*map(F.lit, exclusive))) & (F.size(F.array_distinct(labels)) > 1),
    }
    return feedback.select("feedback_id", F.explode(F.array_compact(F.array(*[F.when(t, n) for n, t in tests.items()]))).alias("violation"))


@F.pandas_udf(T.StringType())
def reviewer_identity(names: pd.Series) -> pd.Series:
    """A reviewer's name in compatibility form, trimmed; null if empty, over 255 long or with control characters."""

    def one(name: str | None) -> str | None:
        if name is None:
            return None
        plain = unicodedata.normalize("NFKC", name)
        if any(unicodedata.category(c).startswith("C") for c in plain):
            return None
        plain = plain.strip()
        return plain if 1 <= len(plain) <= 255 else None

    return names.map(one)
