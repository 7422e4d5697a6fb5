"""Queries of scopes, intake, retention and records, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.operators import control
from sievewright.sources.views import cte, view

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def moment(text: str) -> Column:
    return F.expr(f"TIMESTAMP_NTZ '{text}'")


PROFILES = {"c1": ("c1", "c2"), "c3": ("c3",)}
_ASKS = "rule_status = 'success' AND rule_conf >= 0.7 AND rule_conf < 0.9"


@query(f"WITH {cte('attempts')} SELECT doc_id, CASE WHEN {_ASKS} AND rule_label IN ('c1', 'c3') THEN rule_label END AS target_profile, CASE WHEN {_ASKS} AND rule_label = 'c1' THEN 'c1,c2' WHEN {_ASKS} AND rule_label = 'c3' THEN 'c3' END AS scope FROM attempts")
def rule_scopes(spark, sf_dir):
    scoped = control.rule_scopes(view(spark, sf_dir, "attempts"), PROFILES)
    return scoped.select("doc_id", "target_profile", F.when(F.col("vector_scope").isNotNull(), F.array_join("vector_scope", ",")).alias("scope"))


@query(f"WITH {cte('attempts')} SELECT doc_id, 'unavailable' AS rule_status, 'taxonomy_version_mismatch' AS rule_reason FROM attempts")
def rules_of_another_taxonomy(spark, sf_dir):
    return control.unavailable_rules(view(spark, sf_dir, "attempts"), "tax-v0", "tax-v1").select("doc_id", "rule_status", "rule_reason")


@query(
    "SELECT vec_id, CASE WHEN vec_id % 4 = 0 THEN 'no_match' WHEN vec_id % 3 = 0 OR embedding IS NULL THEN 'unavailable' END AS status, "
    "CASE WHEN vec_id % 4 = 0 THEN 'ineligible_document' WHEN vec_id % 3 = 0 OR embedding IS NULL THEN 'embedding_unavailable' END AS reason FROM embeddings"
)
def search_states(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = e.select("vec_id", (F.col("vec_id") % 4 != 0).alias("eligible"), F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("embedding"))
    return control.search_state(asked).select("vec_id", "status", "reason")


@query(f"WITH {cte('ledger')} SELECT mailbox_id, max(uid) AS high_water_uid, count(*) AS skipped FROM ledger GROUP BY mailbox_id")
def pop3_baseline(spark, sf_dir):
    skipped, cursors = control.pop3_baseline(view(spark, sf_dir, "ledger"))
    counted = skipped.where("status = 'skipped_initial'").groupBy("mailbox_id").agg(F.count("*").alias("skipped"))
    return cursors.join(counted, "mailbox_id").select("mailbox_id", "high_water_uid", "skipped")


@query(
    f"WITH {cte('ledger')}, c AS (SELECT mailbox_id, max(uid) AS top FROM ledger GROUP BY 1) "
    "SELECT mailbox_id, CAST(CASE WHEN length(mailbox_id) % 2 = 0 THEN 8 ELSE 7 END AS BIGINT) AS uidvalidity, CASE WHEN length(mailbox_id) % 2 = 0 THEN 0 ELSE top END AS high_water_uid FROM c"
)
def cursors_after_validity_change(spark, sf_dir):
    cursors = view(spark, sf_dir, "ledger").groupBy("mailbox_id").agg(F.max("uid").alias("high_water_uid")).withColumn("uidvalidity", F.lit(7).cast("long"))
    now = cursors.select("mailbox_id", F.when(F.length("mailbox_id") % 2 == 0, 8).otherwise(7).cast("long").alias("uidvalidity"))
    return control.reset_cursors(cursors, now)


@query(
    f"WITH {cte('ledger')}, r AS (SELECT *, row_number() OVER (PARTITION BY mailbox_id ORDER BY uid) AS n FROM ledger WHERE ts >= (SELECT max(ts) FROM ledger) - INTERVAL 7 DAY) "
    "SELECT mailbox_id, uid FROM r WHERE n <= 25"
)
def confirmed_backfill(spark, sf_dir):
    listing = view(spark, sf_dir, "ledger")
    top = listing.agg(F.max("ts").alias("t")).first().t
    taken, audit = control.bounded_backfill(listing, F.lit(top), confirmed=True, since_days=7, max_messages=25)
    return taken.join(audit.select("mailbox_id"), "mailbox_id", "left_semi").select("mailbox_id", "uid")


@query(
    f"WITH {cte('ledger')} SELECT DISTINCT uid AS run_id, 'pending' AS status, sha256(concat('classify|', uid)) AS job_id, 0 AS attempts FROM ledger WHERE status = 'accepted'"
)
def runs_with_outbox(spark, sf_dir):
    messages = view(spark, sf_dir, "ledger").where("status = 'accepted'").select(F.col("uid").alias("run_id"), F.col("dedup_key").alias("payload"))
    accepted = control.accept_runs(messages, "classify", moment("2024-01-01 00:00:00"))
    jobs = control.outbox_of(accepted).select("run_id", "job_id", "attempts")
    return control.runs_of(accepted).join(jobs, "run_id").select("run_id", "status", "job_id", "attempts")


_OUTBOX = "outbox AS (SELECT uid AS run_id, CASE WHEN uid % 2 = 0 THEN ts END AS dispatched_at FROM ledger), audits AS (SELECT mailbox_id, ts AS requested_at FROM ledger WHERE uid % 10 = 0)"
_AS_OF = "TIMESTAMP '1998-01-01'"
_LATE = "(SELECT max(ts) FROM ledger)"


@query(
    f"WITH {cte('runs', 'feedback', 'ledger')}, {_OUTBOX}, kept AS (SELECT * FROM feedback WHERE NOT coalesce(reviewed_at < {_AS_OF} - INTERVAL 365 DAY, false)) "
    "SELECT 'feedback' AS entity, count(*) AS n FROM kept UNION ALL "
    f"SELECT 'runs', count(*) FROM runs WHERE NOT coalesce(created_at < {_AS_OF} - INTERVAL 90 DAY, false) OR run_id IN (SELECT run_id FROM kept) UNION ALL "
    f"SELECT 'ledger', count(*) FROM ledger WHERE NOT (coalesce(ts < {_AS_OF} - INTERVAL 90 DAY, false) AND status <> 'claimed') UNION ALL "
    f"SELECT 'outbox', count(*) FROM outbox WHERE NOT coalesce(dispatched_at < {_AS_OF} - INTERVAL 30 DAY, false) UNION ALL "
    f"SELECT 'audits', count(*) FROM audits WHERE NOT coalesce(requested_at < {_AS_OF} - INTERVAL 365 DAY, false)"
)
def retained_rows(spark, sf_dir):
    ledger = view(spark, sf_dir, "ledger")
    outbox = ledger.select(F.col("uid").alias("run_id"), F.when(F.col("uid") % 2 == 0, F.col("ts")).alias("dispatched_at"))
    audits = ledger.where("uid % 10 = 0").select("mailbox_id", F.col("ts").alias("requested_at"))
    left = control.retained(view(spark, sf_dir, "runs"), view(spark, sf_dir, "feedback"), ledger, outbox, audits, moment("1998-01-01 00:00:00"))
    out = None
    for name, df in left.items():
        part = df.agg(F.lit(name).alias("entity"), F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"WITH {cte('samples')} SELECT id, disposition IS NOT NULL AND policy_version IS NOT NULL AND fingerprint IS NOT NULL AS judged, CASE WHEN policy_version IS NOT NULL THEN disposition END AS disposition FROM samples")
def sample_records(spark, sf_dir):
    return control.sample_records(view(spark, sf_dir, "samples")).select("id", F.col("quality").isNotNull().alias("judged"), F.col("quality.disposition").alias("disposition"))


@query(f"WITH {cte('feedback')} SELECT feedback_id, strftime(reviewed_at, '%Y-%m-%dT%H:%M:%S+00:00') AS reviewed_at_utc FROM feedback")
def feedback_records(spark, sf_dir):
    return control.feedback_records(view(spark, sf_dir, "feedback")).select("feedback_id", "reviewed_at_utc")


@query(f"WITH {cte('runs')} SELECT run_id, CASE WHEN run_id % 3 = 2 THEN 'rule_only' END AS strategy, CASE WHEN run_id % 3 = 2 THEN 'rule,vector' END AS sources FROM runs")
def fusion_audits(spark, sf_dir):
    meta = F.when(F.col("run_id") % 3 == 2, '{"strategy":"rule_only","sources":["rule","vector"],"conflict":false}').when(F.col("run_id") % 3 == 1, "not json")
    read = control.fusion_audits(view(spark, sf_dir, "runs").withColumn("fusion_meta", meta))
    return read.select("run_id", F.col("audit.strategy").alias("strategy"), F.when(F.col("audit").isNotNull(), F.array_join("audit.sources", ",")).alias("sources"))


@query(f"WITH {cte('runs')} SELECT run_id, CASE WHEN run_id % 2 = 0 THEN 'rules-v1' ELSE 'rules-v2' END AS v_rules, 'tax-v3' AS v_taxonomy FROM runs")
def bound_assets(spark, sf_dir):
    runs = view(spark, sf_dir, "runs").withColumn("v_rules", F.when(F.col("run_id") % 2 == 0, "rules-v1"))
    return control.bind_assets(runs, {"rules": "rules-v2", "taxonomy": "tax-v3"}).select("run_id", "v_rules", "v_taxonomy")


@query(f"WITH {cte('runs')} SELECT run_id, run_id % 3 < 2 AS same FROM runs")
def enricher_sets(spark, sf_dir):
    found = F.when(F.col("run_id") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("run_id") % 3 == 1, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("a")))
    return view(spark, sf_dir, "runs").select("run_id", control.same_enrichers(found, ["a", "b"]).alias("same"))


@query("SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)), ',') || ']' AS literal FROM embeddings WHERE embedding IS NOT NULL")
def vector_literals(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("embedding is not null")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return e.select("vec_id", control.vector_literal(whole).alias("literal"))


@query(f"WITH {cte('ledger')}, m AS (SELECT mailbox_id, min(dedup_key) AS low FROM ledger GROUP BY 1) SELECT DISTINCT l.mailbox_id, dedup_key AS owner, CASE WHEN length(l.mailbox_id) % 2 = 0 THEN false ELSE dedup_key = low END AS won FROM ledger l JOIN m ON m.mailbox_id = l.mailbox_id")
def mailbox_locks(spark, sf_dir):
    requests = view(spark, sf_dir, "ledger").select("mailbox_id", F.col("dedup_key").alias("owner")).distinct()
    boxes = requests.select("mailbox_id").distinct()
    until = F.when(F.length("mailbox_id") % 2 == 0, moment("2024-01-02 00:00:00")).otherwise(moment("2023-12-31 00:00:00"))
    held = boxes.select("mailbox_id", F.lit("someone else").alias("owner"), until.alias("expires_at"))
    return control.claim_locks(held, requests, moment("2024-01-01 00:00:00"), 60).select("mailbox_id", "owner", "won")
