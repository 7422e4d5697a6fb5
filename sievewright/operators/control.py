"""Scopes of searches, intake of runs, baselines, backfills, locks and the records that audits read."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.operators import ranges, vectors

# --- scoped searches ---


def rule_scopes(attempts: DataFrame, profiles: Mapping[str, Sequence[str]], *, sure: float = 0.9, least: float = 0.7) -> DataFrame:
    """attempts (rule_status, rule_label, rule_conf) with target_profile and vector_scope.

    A rule that is neither sure nor too weak, and whose label is exactly a profile's, narrows the search
    that is to confirm it; others search everything (null).
    """
    asks = (F.col("rule_status") == "success") & (F.col("rule_conf") >= least) & (F.col("rule_conf") < sure)
    if not profiles:
        return attempts.withColumns({"target_profile": F.lit(None).cast("string"), "vector_scope": F.lit(None).cast("array<string>")})
    table = F.create_map(*[x for label, scope in profiles.items() for x in (F.lit(label), F.array(*map(F.lit, scope)))])  # as long as the profile file
    scope = F.when(asks, F.try_element_at(table, F.col("rule_label")))
    return attempts.withColumns({"target_profile": F.when(scope.isNotNull(), F.col("rule_label")), "vector_scope": scope})


def search_in_scopes(queries: DataFrame, samples: DataFrame, profiles: Mapping[str, Sequence[str]], *, top_k: int = 5, threshold: float = 0.85, exclude_self: bool = False) -> DataFrame:
    """Candidates of queries (query_id, embedding, target_profile): within the profile's scope, or anywhere where that has none.

    One search for all, however many profiles there are.
    """
    scope = F.lit(None).cast("array<string>")
    if profiles:
        table = F.create_map(*[x for label, labels in profiles.items() for x in (F.lit(label), F.array(*map(F.lit, labels)).cast("array<string>"))])
        scope = F.try_element_at(table, F.col("target_profile"))
    near = ranges.search(queries.withColumn("scope", scope), samples, limit=max(5 * top_k, top_k), threshold=threshold, exclude_self=exclude_self)
    fell = near.groupBy("query_id").agg(F.max("scoped_fallback").alias("scoped_fallback"))
    return vectors.label_candidates(near, top_k).join(fell, "query_id")


def unavailable_rules(attempts: DataFrame, snapshot_taxonomy: str, taxonomy: str) -> DataFrame:
    """Rule attempts are unavailable where the rules were made for another version of the taxonomy."""
    if snapshot_taxonomy == taxonomy:
        return attempts.withColumn("rule_reason", F.lit(None).cast("string"))
    nothing = {"rule_status": F.lit("unavailable"), "rule_label": F.lit(None).cast("string"), "rule_conf": F.lit(0.0), "rule_reason": F.lit("taxonomy_version_mismatch")}
    return attempts.withColumns(nothing)


def search_state(documents: DataFrame) -> DataFrame:
    """documents (eligible, embedding) with the status and reason of those that cannot be searched for, null for others."""
    refused, failed = ~F.col("eligible"), F.col("embedding").isNull()
    return documents.withColumns(
        {
            "status": F.when(refused, "no_match").when(failed, "unavailable"),
            "reason": F.when(refused, "ineligible_document").when(failed, "embedding_unavailable"),
        }
    )


# --- intake ---


def pop3_baseline(listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a first sync records: every listed message as skipped, and each mailbox's cursor."""
    skipped = listing.withColumn("status", F.lit("skipped_initial"))
    return skipped, listing.groupBy("mailbox_id").agg(F.coalesce(F.max("uid"), F.lit(0)).alias("high_water_uid"))


def reset_cursors(cursors: DataFrame, mailboxes: DataFrame) -> DataFrame:
    """cursors (mailbox_id, uidvalidity, high_water_uid) as a poll finds them: from 0 where the mailbox's validity changed."""
    joined = cursors.join(mailboxes.select("mailbox_id", F.col("uidvalidity").alias("_now")), "mailbox_id", "left")
    changed = F.col("_now").isNotNull() & ~F.col("_now").eqNullSafe(F.col("uidvalidity"))
    return joined.select("mailbox_id", F.coalesce("_now", "uidvalidity").alias("uidvalidity"), F.when(changed, 0).otherwise(F.col("high_water_uid")).alias("high_water_uid"))


def bounded_backfill(listing: DataFrame, now: Column, *, confirmed: bool, since_days: int, max_messages: int) -> tuple[DataFrame, DataFrame]:
    """The messages of a confirmed backfill, oldest first within each mailbox's bounds, and its audit rows."""
    if not confirmed:
        raise ValueError("nobody has confirmed this backfill")
    if since_days < 1:
        raise ValueError(f"since_days is {since_days}, the least is 1")
    if max_messages < 1:
        raise ValueError(f"max_messages is {max_messages}, the least is 1")
    order = Window.partitionBy("mailbox_id").orderBy("uid")
    recent = listing.where(F.col("ts") >= now - F.make_dt_interval(F.lit(since_days)))
    taken = recent.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max_messages).drop("_n")
    audit = listing.select("mailbox_id").distinct().withColumns({"since_days": F.lit(since_days), "max_messages": F.lit(max_messages), "requested_at": now})
    return taken, audit


def accept_runs(messages: DataFrame, job_name: str, now: Column) -> DataFrame:
    """One row for each accepted message (run_id, payload): the run and the intent to process it in one record.

    Written as one table, a run never exists without its job; ``runs_of`` and ``outbox_of`` are views of
    it.  The job's id follows from the run, so a batch that runs again makes the same job.
    """
    run = F.struct(F.col("run_id"), F.lit("pending").alias("status"), F.col("payload"), now.alias("created_at"))
    job = F.struct(
        F.sha2(F.concat_ws("|", F.lit(job_name), F.col("run_id").cast("string")), 256).alias("job_id"),
        F.lit(job_name).alias("job_name"),
        F.col("run_id"),
        F.lit(0).alias("attempts"),
        now.alias("created_at"),
        F.lit(None).cast("timestamp").alias("dispatched_at"),
    )
    return messages.dropDuplicates(["run_id"]).select(run.alias("run"), job.alias("job"))


def runs_of(accepted: DataFrame) -> DataFrame:
    return accepted.select("run.*")


def outbox_of(accepted: DataFrame) -> DataFrame:
    return accepted.select("job.*")


def claim_locks(locks: DataFrame, requests: DataFrame, now: Column, poll_seconds: int) -> DataFrame:
    """requests (mailbox_id, owner) with won and expires_at: the least owner wins where no lock is held that has not expired.

    Its holder is refused too.  One look at a table of locks; ``streaming.control_plane`` keeps them as state.
    """
    held = locks.where(F.col("expires_at") > now).select("mailbox_id", F.lit(True).alias("_held")).distinct()
    first = Window.partitionBy("mailbox_id").orderBy("owner")
    joined = requests.withColumn("_n", F.row_number().over(first)).join(held, "mailbox_id", "left")
    won = F.col("_held").isNull() & (F.col("_n") == 1)
    until = now + F.make_dt_interval(secs=F.lit(max(2 * poll_seconds, 60)))
    return joined.select("mailbox_id", "owner", won.alias("won"), F.when(won, until).alias("expires_at"))


def bind_assets(runs: DataFrame, versions: Mapping[str, str]) -> DataFrame:
    """runs with a version of every asset: the one a run was bound to first stays."""
    own = set(runs.columns)
    return runs.withColumns({f"v_{a}": F.coalesce(F.col(f"v_{a}"), F.lit(v)) if f"v_{a}" in own else F.lit(v) for a, v in versions.items()})


# --- retention ---


def retained(runs: DataFrame, feedback: DataFrame, ledger: DataFrame, outbox: DataFrame, audits: DataFrame, as_of: Column, *, runs_days: int = 90, feedback_days: int = 365, ledger_days: int = 90, outbox_days: int = 30, audit_days: int = 365) -> dict[str, DataFrame]:
    """What a clean-up leaves of each table, feedback first, as runs that have feedback stay; 0 days leave a table alone.

    Open work stays: claims that are not settled and jobs that were not dispatched.
    """
    before = lambda days: as_of - F.make_dt_interval(F.lit(days))
    keep = lambda df, days, old: df.where(~F.coalesce(old, F.lit(False))) if days else df
    feedback = keep(feedback, feedback_days, F.col("reviewed_at") < before(feedback_days))
    if runs_days:
        old = F.coalesce(F.col("created_at") < before(runs_days), F.lit(False))
        said = feedback.select("run_id").distinct()
        runs = runs.where(~old).unionByName(runs.where(old).join(said, "run_id", "left_semi"))
    return {
        "feedback": feedback,
        "runs": runs,
        "ledger": keep(ledger, ledger_days, (F.col("ts") < before(ledger_days)) & (F.col("status") != "claimed")),
        "outbox": keep(outbox, outbox_days, F.col("dispatched_at") < before(outbox_days)),
        "audits": keep(audits, audit_days, F.col("requested_at") < before(audit_days)),
    }


# --- records ---


def sample_records(rows: DataFrame) -> DataFrame:
    """Stored samples with quality, a struct where disposition, policy_version and fingerprint are all known, else null."""
    known = F.col("disposition").isNotNull() & F.col("policy_version").isNotNull() & F.col("fingerprint").isNotNull()
    quality = F.struct("disposition", "policy_version", "fingerprint")
    return rows.withColumn("quality", F.when(known, quality))


def feedback_records(rows: DataFrame) -> DataFrame:
    """Stored feedback with its moment in UTC, whatever zone the session shows."""
    at = F.col("reviewed_at")
    if dict(rows.dtypes)["reviewed_at"] == "timestamp":  # shown in the session's zone; without a zone it is in UTC already
        at = F.to_utc_timestamp(at, F.current_timezone())
    return rows.withColumn("reviewed_at_utc", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))


def feedback_of(rows: DataFrame, run_id) -> DataFrame:
    """One run's feedback, by revision."""
    return rows.where(F.col("run_id") == run_id).orderBy("revision")


#: What a run's stored audit holds.
AUDIT = "struct<strategy:string,sources:array<string>,target_profile:string,conflict:boolean>"


def fusion_audits(runs: DataFrame) -> DataFrame:
    """(run_id, audit) of runs (run_id, fusion_meta JSON): null where there is none or it cannot be read."""
    parsed = F.from_json("fusion_meta", AUDIT, {"mode": "PERMISSIVE"})
    return runs.select("run_id", F.when(parsed["strategy"].isNotNull(), parsed).alias("audit"))


def same_enrichers(found: Column, wanted: Sequence[str]) -> Column:
    """Whether an array of enricher ids is the wanted set, in any order, each once."""
    return (F.size(found) == len(wanted)) & (F.size(F.array_except(found, F.array(*map(F.lit, wanted)).cast("array<string>"))) == 0) & (F.size(F.array_distinct(found)) == F.size(found))


def vector_literal(x: Column) -> Column:
    """A vector as text in brackets, as vector columns of databases read it."""
    return F.concat(F.lit("["), F.array_join(F.transform(x, lambda v: v.cast("string")), ","), F.lit("]"))


def rules_warning(n_rules: int) -> str | None:
    return None if n_rules else "no rules are loaded: every message is left to the search and the model"
