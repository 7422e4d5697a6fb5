"""Scopes of searches, intake and records on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievewright.operators import control, vectors



def now():
    return F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00'")


@pytest.mark.parametrize(
    ("status", "label", "conf", "profile"),
    [("success", "a", 0.7, "a"), ("success", "a", 0.89, "a"), ("success", "a", 0.9, None), ("success", "a", 0.69, None), ("no_match", "a", 0.8, None), ("success", "b", 0.8, None), ("success", None, 0.8, None)],
)
def test_scopes(spark, status, label, conf, profile):
    row = spark.createDataFrame([(status, label, conf)], "rule_status string, rule_label string, rule_conf double")
    got = control.rule_scopes(row, {"a": ["a", "b"]}).first()
    assert got.target_profile == profile and got.vector_scope == (["a", "b"] if profile else None)
    assert control.rule_scopes(row, {}).first().vector_scope is None


def test_search_in_scopes(spark):
    """The nearest sample is out of scope for the profile's query; a scope without samples falls back to all."""
    library = spark.createDataFrame(
        [(1, "x", [1.0, 0.0]), (2, "a", [0.9, 0.1]), (3, "x", [0.0, 1.0])], "id long, label_l1 string, embedding array<double>"
    ).withColumn("schema_version", F.lit("flat-v1")).withColumn("label_l2", F.lit(None).cast("string")).withColumn("disposition", F.lit("accepted")).withColumn("reviewed", F.lit(True)).withColumn("created_s", F.lit(0))
    asked = spark.createDataFrame([(10, [1.0, 0.0], "p"), (11, [1.0, 0.0], None), (12, [0.0, 1.0], "q")], "query_id long, embedding array<double>, target_profile string")
    found = control.search_in_scopes(asked, library, {"p": ["a"], "q": ["nothing"]}, top_k=1, threshold=0.5).collect()
    assert {(r.query_id, r.label, r.scoped_fallback) for r in found} == {(10, "a", False), (11, "x", False), (12, "x", True)}


def test_backfill_is_confirmed_and_bounded(spark):
    listing = spark.createDataFrame([("m", k, f"2024-01-{k:02d} 00:00:00") for k in range(1, 10)], "mailbox_id string, uid long, t string").withColumn("ts", F.col("t").cast("timestamp_ntz"))
    for wrong in ({"confirmed": False, "since_days": 1, "max_messages": 1}, {"confirmed": True, "since_days": 0, "max_messages": 1}, {"confirmed": True, "since_days": 1, "max_messages": 0}):
        with pytest.raises(ValueError):
            control.bounded_backfill(listing, now(), **wrong)
    taken, audit = control.bounded_backfill(listing, now(), confirmed=True, since_days=5, max_messages=3)
    assert sorted(r.uid for r in taken.collect()) == [5, 6, 7]
    assert [(r.mailbox_id, r.since_days, r.max_messages) for r in audit.collect()] == [("m", 5, 3)]


def test_runs_and_jobs_are_one_record(spark):
    messages = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "run_id long, payload string")
    accepted = control.accept_runs(messages, "classify", now())
    runs, jobs = control.runs_of(accepted).collect(), control.outbox_of(accepted).collect()
    assert sorted(r.run_id for r in runs) == sorted(r.run_id for r in jobs) == [1, 2]
    again = {r.run_id: r.job_id for r in control.outbox_of(control.accept_runs(messages, "classify", now())).collect()}
    assert again == {r.run_id: r.job_id for r in jobs} and len(set(again.values())) == 2


def test_locks(spark):
    locks = spark.createDataFrame([("held", "x", "2024-01-10 00:01:00"), ("old", "x", "2024-01-09 00:00:00")], "mailbox_id string, owner string, t string").select("mailbox_id", "owner", F.col("t").cast("timestamp_ntz").alias("expires_at"))
    asks = spark.createDataFrame([("held", "x"), ("held", "y"), ("old", "y"), ("new", "y"), ("new", "z")], "mailbox_id string, owner string")
    got = {(r.mailbox_id, r.owner): (r.won, r.expires_at) for r in control.claim_locks(locks, asks, now(), 20).collect()}
    assert {k for k, (won, _) in got.items() if won} == {("old", "y"), ("new", "y")}
    assert str(got["new", "y"][1]) == "2024-01-10 00:01:00" and got["new", "z"][1] is None


def test_records(spark):
    rows = spark.createDataFrame([(1, '{"strategy":"a","sources":["r"],"conflict":true}'), (2, "{"), (3, None)], "run_id long, fusion_meta string")
    assert [(r.run_id, r.audit and r.audit.strategy) for r in control.fusion_audits(rows).orderBy("run_id").collect()] == [(1, "a"), (2, None), (3, None)]
    feedback = spark.createDataFrame([(1, 2), (2, 1), (1, 1)], "run_id long, revision int")
    assert [r.revision for r in control.feedback_of(feedback, 1).collect()] == [1, 2]
    v = spark.createDataFrame([([1, 2],), ([],)], "x array<int>").select(control.vector_literal(F.col("x")).alias("t"))
    assert [r.t for r in v.collect()] == ["[1,2]", "[]"]
    assert control.rules_warning(0) and control.rules_warning(3) is None


def test_moments_are_told_in_utc_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    rows = spark.sql("SELECT 1 AS id, timestamp_seconds(0) AS reviewed_at")
    try:
        for other in ("Asia/Tokyo", "America/New_York", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert control.feedback_records(rows).first().reviewed_at_utc == "1970-01-01T00:00:00+00:00"
            plain = rows.select(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz").alias("reviewed_at"))
            assert control.feedback_records(plain).first().reviewed_at_utc == "1970-01-01T00:00:00+00:00"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_a_missing_embedding_is_unavailable(spark):
    asked = spark.createDataFrame([(1, True, None), (2, False, None), (3, True, [1.0])], "query_id long, eligible boolean, embedding array<double>")
    none = spark.createDataFrame([], "query_id long, label string, max_similarity double, mean_similarity double, support long, rank int")
    got = {r.query_id: (r.status, r.reason) for r in vectors.vector_attempts(asked, none, ["a"]).collect()}
    assert got == {1: ("unavailable", "embedding_unavailable"), 2: ("no_match", "ineligible_document"), 3: ("no_match", "below_threshold")}
