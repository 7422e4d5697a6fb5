"""Drops by server ids: deletions, restarts, batches that run again, a drop that cannot be reached."""

from __future__ import annotations

import json
from pathlib import Path

import pytest

from sievewright.sources import drop
from sievewright.streaming.bucket_ledger import BucketLedger


class FakeDrop:
    """A drop kept in a file: a list of ids in order, whose texts are the ids themselves."""

    def __init__(self, path: str):
        self.ids = json.loads(Path(path).read_text())

    def listing(self):
        return list(enumerate(self.ids, 1))

    def retrieve(self, number):
        return f"text of {self.ids[number - 1]}".encode()

    def close(self):
        pass


@pytest.fixture()
def box(spark, tmp_path):
    spark.dataSource.register(drop.DropSource)
    ledger = BucketLedger(spark, f"file://{tmp_path}/ledger", buckets=2)
    options = {"client": "tests.test_drop:FakeDrop", "client.path": f"{tmp_path}/drop.json"}

    def poll(ids, baseline=None, checkpoint="c"):
        Path(options["client.path"]).write_text(json.dumps(ids))
        stream = spark.readStream.format("drop").options(mailbox_id="m", **options).load()
        drop.run_available(stream, ledger, f"file://{tmp_path}/out", options, f"file://{tmp_path}/{checkpoint}", baseline)
        return sorted(bytes(r.content).decode().removeprefix("text of ") for r in drop.messages(ledger, f"file://{tmp_path}/out").collect())

    poll.ledger, poll.options = ledger, options
    return poll


def test_deletions_lose_and_repeat_nothing(box):
    assert box([f"m{k}" for k in range(10)]) == sorted(f"m{k}" for k in range(10))
    # Six are deleted, five arrive: numbers 5 to 9 now mean other messages.
    after = [*(f"m{k}" for k in range(6, 10)), *(f"m{k}" for k in range(10, 15))]
    assert box(after) == sorted(f"m{k}" for k in range(15))
    assert box(list(reversed(after))) == sorted(f"m{k}" for k in range(15))
    assert box([]) == sorted(f"m{k}" for k in range(15))
    assert box(["m3", "m99"], checkpoint="another") == sorted([*(f"m{k}" for k in range(15)), "m99"])


def test_a_baseline_notes_the_newest(box):
    with pytest.raises(Exception):
        box(["a", "b", "c", "d"], baseline=2)  # nothing was taken, so there is no table yet
    assert {(r.dedup_key, r.status) for r in box.ledger.read().collect()} == {("c", "skipped_initial"), ("d", "skipped_initial")}
    assert box(["a", "b", "c", "d", "e"], baseline=2) == ["a", "b", "e"]


def test_a_batch_that_runs_again_changes_nothing(spark, box, tmp_path):
    listing = spark.createDataFrame([("m", 1, "x"), ("m", 2, "y"), ("m", 3, "x")], drop.LISTING)
    calls = []

    def fetch(wanted):
        calls.append(sorted(r.server_id for r in wanted.collect()))
        from pyspark.sql import functions as F

        return wanted.withColumn("content", F.when(F.col("server_id") == "x", F.col("server_id").cast("binary")))

    where = f"file://{tmp_path}/again"
    for batch in (0, 0, 1):
        drop.take(listing, box.ledger, where, fetch, "q", batch)
    assert calls[0] == ["x", "y"] and calls[1:] == [[]]  # the second call of batch 0 is over at once
    assert {(r.dedup_key, r.status) for r in box.ledger.read().collect()} == {("x", "claimed"), ("y", "gone")}
    assert [r.server_id for r in drop.messages(box.ledger, where).collect()] == ["x"]


def test_a_server_that_is_away(monkeypatch):
    tries = []

    def refuse(*_):
        tries.append(1)
        raise OSError("away")

    monkeypatch.setattr(drop.poplib, "POP3_SSL", refuse)
    monkeypatch.setattr(drop.time, "sleep", lambda _: None)
    with pytest.raises(OSError):
        drop.Pop3Client("h", "u", "p")
    assert len(tries) == 3


def test_every_message_needs_an_id(monkeypatch):
    class Box:
        def list(self):
            return b"+OK", [b"1 10", b"3 9", b"2 8"], 0

        def uidl(self):
            return b"+OK", [b"1 one", b"2 two"], 0

    client = drop.Pop3Client.__new__(drop.Pop3Client)
    client.box = Box()
    with pytest.raises(RuntimeError, match="3"):
        client.listing()
