"""Stateful streams over restarts: locks, claims and jobs of mailboxes."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from sievewright.operators import control
from sievewright.streaming import control_plane
from sievewright.streaming.bucket_ledger import BucketLedger


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


@pytest.fixture()
def box(spark, tmp_path):
    """Feed control events (seq, minute, kind, subject, owner, ok, error) of a mailbox, run, and read all outcomes."""

    def run(*rows, **settings):
        events = [("m", subject, seq, at(minute), kind, owner, ok, error) for seq, minute, kind, subject, owner, ok, error in rows]
        spark.createDataFrame(events, control_plane.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(control_plane.EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        control_plane.run_control(stream, f"{tmp_path}/out", f"{tmp_path}/state", delay="1 minute", **settings)
        return spark.read.parquet(f"{tmp_path}/out").collect()

    return run


def test_state_survives_restarts(box):
    first = box((1, 0, "poll", "x", "a", None, None), (2, 1, "poll", "y", "a", None, None), (3, 1, "claim", "k", "a", None, None), (4, 1, "enqueue", "j", "a", None, None), (5, 1, "attempt", "j", "a", False, "e" * 5000), (6, 1, "attempt", "z", "a", True, None))
    assert {r.seq: r.outcome for r in first if r.seq} == {1: "acquired", 2: "locked", 3: "claimed", 4: "queued", 5: "failed", 6: "no_job"}
    failed = next(r for r in first if r.seq == 5)
    assert failed.attempts == 1 and failed.due == at(2) and len(failed.error) == 4000
    # A new run over the same state: the open claim resumes, the job goes on, an expired lock is free.
    second = box((7, 2.5, "claim", "k", "b", None, None), (8, 2.5, "poll", "", "b", None, None), (9, 2.6, "attempt", "j", "b", False, "again"), (10, 3, "accept", "k", "b", None, None), (11, 3, "release", "", "a", None, None))
    assert {r.seq: r.outcome for r in second if r.seq and r.seq > 6} == {7: "resumed", 8: "acquired", 9: "failed", 10: "accepted", 11: "not_held"}
    assert next(r for r in second if r.seq == 9).attempts == 2
    third = box((12, 3.5, "claim", "k", "c", None, None), (13, 3.5, "accept", "k", "c", None, None), (14, 3.5, "release", "", "b", None, None), (15, 3.5, "release", "", "b", None, None), (16, 3.6, "poll", "", "c", None, None), (17, 4, "attempt", "j", "c", True, None), (18, 4, "enqueue", "j", "c", None, None))
    assert {r.seq: r.outcome for r in third if r.seq and r.seq > 11} == {12: "duplicate", 13: "not_claimed", 14: "released", 15: "not_held", 16: "acquired", 17: "dispatched", 18: "known"}


def test_timers_tell_what_nobody_asks(box):
    box((1, 0, "poll", "", "a", None, None), (2, 0, "claim", "k", "a", None, None), (3, 0, "enqueue", "j", "a", None, None), (4, 0.5, "attempt", "j", "a", False, "x"), claim_seconds=300)
    out = box((5, 60, "poll", "", "b", None, None), (6, 60, "claim", "other", "b", None, None), claim_seconds=300)
    out = box((7, 120, "claim", "third", "b", None, None), claim_seconds=300)
    told = sorted((r.outcome, r.subject, r.due, r.attempts) for r in out if r.kind == "timer")
    assert ("claim_open", "message:k", at(5), None) in told and ("due", "job:j", at(1.5), 1) in told
    assert {t[0] for t in told} == {"claim_open", "due", "lock_expired"}


def test_events_that_cannot_be_decided(spark):
    rows = [("m", "k", 1, at(0), "claim", "a", None, None), (None, "k", 2, at(0), "claim", "a", None, None), ("m", "k", 3, None, "claim", "a", None, None), ("m", "k", 4, at(0), "dance", "a", None, None), ("m", "k", 5, at(0), None, "a", None, None)]
    bad = control_plane.invalid(spark.createDataFrame(rows, control_plane.EVENTS)).collect()
    assert sorted(r.seq for r in bad) == [2, 3, 4, 5] and {r.outcome for r in bad} == {"invalid"}


def test_a_job_has_one_id(spark):
    ids = spark.range(3).select(control_plane.job_id(F.lit("classify"), F.col("id") % 2)).distinct().count()
    assert ids == 2


def test_a_live_lock_refuses_its_holder(spark):
    locks = spark.createDataFrame([("m", "a", at(5)), ("n", "a", at(-5))], "mailbox_id string, owner string, expires_at timestamp")
    asked = spark.createDataFrame([("m", "a"), ("m", "b"), ("n", "b"), ("n", "c")], "mailbox_id string, owner string")
    won = {(r.mailbox_id, r.owner) for r in control.claim_locks(locks, asked, F.lit(at(0)), 60).where("won").collect()}
    assert won == {("n", "b")}


def _claims(spark, *rows):
    return spark.createDataFrame(list(rows), "mailbox_id string, dedup_key string, uid long")


def test_ledger_claims_once(spark, tmp_path):
    ledger = BucketLedger(spark, f"file://{tmp_path}/l", buckets=4, most_segments=2)
    ledger.append(_claims(spark, ("m", "a", 2), ("m", "a", 1), ("m", "b", 3), ("n", "a", 4), (None, None, 5)), "q", 0)
    ledger.append(_claims(spark, ("m", "a", 9), ("m", "c", 9), (None, None, 9)), "q", 1)
    ledger.append(_claims(spark, ("m", "d", 9)), "q", 1)  # the batch runs again: it is known
    ledger.append(_claims(spark, ("m", "c", 7), ("m", "e", 7)), "other", 0)
    got = {(r.mailbox_id, r.dedup_key): (r.uid, r.query, r.batch) for r in ledger.read().collect()}
    assert got == {("m", "a"): (1, "q", 0), ("m", "b"): (3, "q", 0), ("n", "a"): (4, "q", 0), ("m", "c"): (9, "q", 1), ("m", "e"): (7, "other", 0)}
    ledger.append(_claims(spark).limit(0), "q", 2)
    assert ledger.version().done == {"q": 2, "other": 0}


def test_two_writers_lose_nothing(spark, tmp_path):
    first, second = (BucketLedger(spark, f"file://{tmp_path}/l", buckets=4) for _ in range(2))
    first.append(_claims(spark, ("m", "x", 1)), "a", 0)
    between = [lambda: first.append(_claims(spark, ("m", "k1", 1), ("m", "k2", 1)), "a", 1)]
    second.append(_claims(spark, ("m", "k2", 2), ("m", "k3", 2), ("m", "x", 2)), "b", 0, lambda: between and between.pop()())
    assert second.last["attempts"] == 2
    assert sorted((r.dedup_key, r.query) for r in second.read().collect()) == [("k1", "a"), ("k2", "a"), ("k3", "b"), ("x", "a")]


def test_batches_open_a_bounded_number_of_files(spark, tmp_path):
    ledger = BucketLedger(spark, f"file://{tmp_path}/l", buckets=4, most_segments=2)
    opened = []
    for n in range(7):
        ledger.append(_claims(spark, *[("m", f"k{n}-{i}", i) for i in range(30)], ("m", f"k{n - 1}-3", 0)), "q", n)
        opened.append(ledger.last["opened"])
    assert max(opened) <= 4 * 2 and ledger.last["new"] == 30 and ledger.read().count() == 211
    assert len(ledger.version().segments) <= 4 * 2
    assert sum(opened) <= 7  # filters keep most segments shut: one of them has the repeated key
    assert ledger.vacuum() > 0 and ledger.read().count() == 211


def test_the_store_is_asked_and_told_once_a_batch():
    calls = []

    class Store:
        kept = ("held", "a", 10, 0)

        def __getattr__(self, name):
            def call(*args):
                calls.append(name)
                return {"exists": self.kept is not None, "get": self.kept, "listTimers": iter([1])}.get(name)

            return call

    processor = control_plane.MailboxControl(60, 60, 60, 60)
    processor.now = processor.handle = Store()
    rows = [{"mailbox_id": "m", "subject": "", "seq": k, "micros": 20 + k, "kind": "poll" if k % 2 == 0 else "release", "owner": "b", "ok": None, "error": None} for k in range(101)]
    out = [r.outcome for r in processor.handleInputRows(("m", ""), iter(rows), None)]
    assert out == [("acquired", "released")[k % 2] for k in range(101)]
    assert calls == ["exists", "get", "listTimers", "deleteTimer", "update", "registerTimer"]
