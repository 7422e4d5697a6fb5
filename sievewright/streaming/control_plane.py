"""Locks, claims and jobs of mailboxes as one stateful stream with timers.

Control events (mailbox_id, subject, seq, at, kind, owner, ok, error) are grouped by mailbox and subject: the
lock of a mailbox is one group (subject empty), every message key and every job another, so a mailbox with a
third of all messages spreads over the tasks.  The state of a group is a few values in the state store under
the query's checkpoint, and outlives restarts.  Decisions go by the events' own time and order, so they do not
depend on how the stream was cut into batches; timers tell what nobody asks about: a lock that expired, a
claim that was left open, a job that is due again.

=========  =====================================================================================
kind       meaning and outcome
=========  =====================================================================================
poll       asks for the mailbox's lock: ``acquired`` if none is held, else ``locked`` (by its holder too);
           held for twice the polling interval, a minute at least
release    the holder gives it back: ``released``; of anyone else, or too late: ``not_held``
claim      asks for a message: ``claimed`` once, ``resumed`` while nobody accepted it, then ``duplicate``
accept     settles a claim: ``accepted``; without an open claim: ``not_claimed``
enqueue    durable intent: ``queued`` once, then ``known``
attempt    an attempt at a job: ``dispatched``, or ``failed`` with one more attempt and its next time;
           of a job that is gone or unknown: ``no_job``
=========  =====================================================================================

Rows of a group are taken in order of (at, seq) within a batch.  Events without a mailbox, time or
known kind get the outcome ``invalid`` and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "mailbox_id string, subject string, seq long, at timestamp, kind string, owner string, ok boolean, error string"
OUTCOMES = "mailbox_id string, subject string, seq long, at timestamp, kind string, owner string, outcome string, attempts int, due timestamp, error string"
_NAMES = tuple(c.split()[0] for c in OUTCOMES.split(", "))
#: Inside, moments are microseconds since the epoch, whatever the session's time zone.
_RAW = OUTCOMES.replace("timestamp", "long")
_Outcome = Row(*_NAMES)
#: Which state an event is about.
KINDS = {"poll": "lock", "release": "lock", "claim": "claim", "accept": "claim", "enqueue": "job", "attempt": "job"}
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_LONGEST_ERROR = 4000


def _millis(micros: int) -> int:
    return -(-micros // 1000)


class MailboxControl(StatefulProcessor):
    """The state of one lock, one claim or one job."""

    def __init__(self, poll_seconds: int, claim_seconds: int, retry_seconds: int, longest_retry: int) -> None:
        self.hold = max(2 * poll_seconds, 60) * 1_000_000
        self.open = claim_seconds * 1_000_000
        self.retry, self.longest = retry_seconds * 1_000_000, longest_retry * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        #: status: held, claimed, accepted, queued or dispatched; until: when it lapses or is due.
        self.now = handle.getValueState("now", "status string, owner string, until long, attempts int")

    def close(self) -> None:
        pass

    def _set(self, status: str, owner: str | None, until: int | None, attempts: int = 0) -> None:
        self.state = (status, owner, until, attempts)

    def _keep(self, before) -> None:
        """Store what a batch made of the group's state, and the one timer that goes with it."""
        if self.state == before:
            return
        due, was = (_millis(s[2]) if s and s[2] is not None else None for s in (self.state, before))
        if was is not None and was != due:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
        if self.state is None:
            self.now.clear()
            return
        self.now.update(self.state)
        if due is not None:
            self.handle.registerTimer(due)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        # The state store is asked once and told once a batch: each of its calls is a round trip to the JVM.
        before = tuple(self.now.get()) if self.now.exists() else None
        self.state = before
        for r in sorted(rows, key=lambda r: (r["micros"], r["seq"] or 0)):
            outcome, attempts, due = getattr(self, f"_{r['kind']}")(r, self.state)
            yield _Outcome(r["mailbox_id"], r["subject"], r["seq"], r["micros"], r["kind"], r["owner"], outcome, attempts, due, r["error"][:_LONGEST_ERROR] if r["error"] else None)
        self._keep(before)

    def _poll(self, r, state):
        if state and state[2] > r["micros"]:
            return "locked", None, state[2]
        until = r["micros"] + self.hold
        self._set("held", r["owner"], until)
        return "acquired", None, until

    def _release(self, r, state):
        if not state or state[1] != r["owner"] or state[2] <= r["micros"]:
            return "not_held", None, None
        self.state = None
        return "released", None, None

    def _claim(self, r, state):
        if state and state[0] == "accepted":
            return "duplicate", None, None
        until = r["micros"] + self.open
        self._set("claimed", r["owner"], until)
        return "resumed" if state else "claimed", None, until

    def _accept(self, r, state):
        if not state or state[0] != "claimed":
            return "not_claimed", None, None
        self._set("accepted", r["owner"], None)
        return "accepted", None, None

    def _enqueue(self, r, state):
        if state:
            return "known", state[3], state[2]
        self._set("queued", r["owner"], r["micros"])
        return "queued", 0, r["micros"]

    def _attempt(self, r, state):
        if not state or state[0] == "dispatched":
            return "no_job", None, None
        if r["ok"]:
            self._set("dispatched", r["owner"], None, state[3])
            return "dispatched", state[3], None
        attempts = state[3] + 1
        due = r["micros"] + min(self.retry * 2 ** min(attempts - 1, 30), self.longest)
        self._set("queued", r["owner"], due, attempts)
        return "failed", attempts, due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if not self.now.exists():
            return
        status, owner, until, attempts = self.now.get()
        told = {"held": "lock_expired", "claimed": "claim_open", "queued": "due"}.get(status)
        if told is None or until is None or _millis(until) != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status == "held":
            self.now.clear()
        yield _Outcome(key[0], key[1], None, until, "timer", owner, told, attempts if status == "queued" else None, until, None)


def control(events: DataFrame, *, poll_seconds: int = 60, claim_seconds: int = 3600, retry_seconds: int = 60, longest_retry: int = 3600, delay: str = "1 hour") -> DataFrame:
    """Outcomes of a stream of control events, and what timers tell once the watermark, ``delay`` behind, has passed them.

    A lock's events are one group whatever their subject says.  Events later than the watermark still get their
    outcome, by the state that they find.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    locks = F.col("kind").isin(*[k for k, about in KINDS.items() if about == "lock"])
    keyed = events.where(valid()).withColumn("subject", F.when(locks, F.lit("")).otherwise(F.concat_ws(":", F.when(F.col("kind").isin("claim", "accept"), "message").otherwise("job"), "subject")))
    processor = MailboxControl(poll_seconds, claim_seconds, retry_seconds, longest_retry)
    timed = keyed.withColumn("micros", F.unix_micros("at")).withWatermark("at", delay)
    decided = timed.groupBy("mailbox_id", "subject").transformWithState(processor, _RAW, "Append", "EventTime")
    return decided.withColumns({c: F.timestamp_micros(c) for c in ("at", "due")})


def valid() -> Column:
    """Whether an event can be decided."""
    return F.coalesce(F.col("mailbox_id").isNotNull() & F.col("at").isNotNull() & F.col("kind").isin(*KINDS), F.lit(False))


def invalid(events: DataFrame) -> DataFrame:
    """Outcomes of the events that cannot be decided."""
    none = {"outcome": F.lit("invalid"), "attempts": F.lit(None).cast("int"), "due": F.lit(None).cast("timestamp")}
    return events.where(~valid()).withColumns(none).select(*_NAMES)


def run_control(events: DataFrame, path: str, checkpoint: str, **settings) -> None:
    """Decide all events that are there now and append their outcomes to a table; the checkpoint keeps the state."""
    out = control(events, **settings)
    out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def job_id(name: Column, run_id: Column) -> Column:
    """The same id for the same job of the same run, however often it is queued."""
    return F.sha2(F.concat_ws("|", name, run_id.cast("string")), 256)
