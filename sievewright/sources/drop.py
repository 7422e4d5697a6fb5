"""Mail drops (POP3) as a stream: what is new is told by the server's ids, not by message numbers.

Numbers in a drop are places in a session: when messages are deleted, others move up.  So the stream's offset is a
digest of the ids that the server lists; whenever it changes, a batch brings the listing (number, server id),
and what has been taken before is removed by an anti join with a ledger of ids.  Nothing is lost or
taken twice, whatever was deleted between two batches.

A first sync takes the newest messages as a baseline: it notes their ids as skipped and takes nothing.  Later batches
take everything unseen, in ascending order of numbers, fetched by one task a drop, as a server lets one
session in at a time.  The task asks for the numbers anew; an id that is gone by then is noted as ``gone``.
"""

from __future__ import annotations

import hashlib
import importlib
import poplib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from sievewright.streaming.bucket_ledger import BucketLedger

LISTING = "mailbox_id string, number long, server_id string"
MESSAGES = "mailbox_id string, number long, server_id string, content binary"


class DropClient(Protocol):
    def listing(self) -> list[tuple[int, str]]: ...

    def retrieve(self, number: int) -> bytes: ...

    def close(self) -> None: ...


class Pop3Client:
    """A drop over TLS; messages stay on the server."""

    def __init__(self, host: str, user: str, password: str, port: str | int = 995, tries: int = 3):
        for attempt in range(tries):
            try:
                self.box = poplib.POP3_SSL(host, int(port))
                self.box.user(user)
                self.box.pass_(password)
                return
            except (OSError, poplib.error_proto):
                if attempt == tries - 1:
                    raise
                time.sleep(0.1 * (attempt + 1))

    def listing(self) -> list[tuple[int, str]]:
        """Numbers and ids, ascending; an error if the server has a message without an id."""
        numbers = sorted(int(line.split()[0]) for line in self.box.list()[1])
        ids = {int(n): name for n, _, name in (line.decode().partition(" ") for line in self.box.uidl()[1])}
        without = [n for n in numbers if not ids.get(n)]
        if without:
            raise RuntimeError(f"the server gives no id for messages {without[:5]}")
        return [(n, ids[n]) for n in numbers]

    def retrieve(self, number: int) -> bytes:
        return b"\r\n".join(self.box.retr(number)[1]) + b"\r\n"

    def close(self) -> None:
        self.box.quit()


def client_of(options: dict[str, str]) -> DropClient:
    """The client that options name as ``module:factory``, with the options that begin with ``client.``."""
    module, name = options["client"].rsplit(":", 1)
    return getattr(importlib.import_module(module), name)(**{k.removeprefix("client."): v for k, v in options.items() if k.startswith("client.")})


def _listed(options: dict[str, str]) -> list[tuple[int, str]]:
    client = client_of(options)
    try:
        return client.listing()
    finally:
        client.close()


class DropReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {"listing": ""}

    def latestOffset(self) -> dict:
        ids = "\n".join(sorted(name for _, name in _listed(self.options)))
        return {"listing": hashlib.sha256(ids.encode()).hexdigest()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition):
        for number, server_id in _listed(self.options):
            yield self.options.get("mailbox_id", "demo"), number, server_id

    def commit(self, end: dict) -> None:
        pass


class DropSource(DataSource):
    """spark.dataSource.register(DropSource); spark.readStream.format("drop").option("client", "module:factory")."""

    @classmethod
    def name(cls) -> str:
        return "drop"

    def schema(self) -> str:
        return LISTING

    def streamReader(self, schema) -> DropReader:
        return DropReader(dict(self.options))


def fetched(options: dict[str, str]) -> Callable[[DataFrame], DataFrame]:
    """A function from wanted (mailbox_id, number, server_id) of one drop to its messages, content null for those that are gone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            if client is None:
                client = client_of(options)
                now = {server_id: number for number, server_id in client.listing()}
            for box, number, server_id in zip(*(batch.column(c).to_pylist() for c in ("mailbox_id", "number", "server_id")), strict=True):
                content = client.retrieve(now[server_id]) if server_id in now else None
                yield pa.RecordBatch.from_pydict({"mailbox_id": [box], "number": [now.get(server_id, number)], "server_id": [server_id], "content": [content]}, schema=pa.schema([("mailbox_id", pa.string()), ("number", pa.int64()), ("server_id", pa.string()), ("content", pa.binary())]))
        if client is not None:
            client.close()

    return lambda wanted: wanted.repartition("mailbox_id").sortWithinPartitions("mailbox_id", "number").mapInArrow(run, MESSAGES)


def unseen(listing: DataFrame, ledger: BucketLedger) -> DataFrame:
    """The listed messages whose ids the ledger does not have; of an id listed twice, the lower number."""
    once = listing.groupBy("mailbox_id", F.col("server_id").alias("dedup_key")).agg(F.min("number").alias("number"))
    return ledger.without_known(once).withColumnRenamed("dedup_key", "server_id")


def take(listing: DataFrame, ledger: BucketLedger, path: str, fetch: Callable[[DataFrame], DataFrame], query: str, batch_id: int, *, baseline: int | None = None) -> None:
    """Fetch what a listing has that the ledger has not, write it to a folder of its own, and note the ids.

    A batch that runs again overwrites its folder until its ids are noted, and does nothing once they are.  With
    ``baseline`` the first batch of an empty ledger notes so many of each drop's newest messages as skipped
    instead, those that are not among them are taken by later batches.
    """
    version = ledger.version()
    if version.done.get(query, -1) >= batch_id:
        return
    new = unseen(listing, ledger)
    if baseline is not None and not version.done:
        newest = Window.partitionBy("mailbox_id").orderBy(F.col("number").desc())
        skipped = new.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= baseline)
        ledger.append(skipped.select("mailbox_id", F.col("server_id").alias("dedup_key"), F.lit("skipped_initial").alias("status")), query, batch_id)
        return
    folder = f"{path}/query={query}/batch={batch_id}"
    fetch(new.select("mailbox_id", "number", "server_id")).write.mode("overwrite").parquet(folder)
    status = F.when(F.col("content").isNull(), "gone").otherwise("claimed")
    got = listing.sparkSession.read.parquet(folder)
    ledger.append(got.select("mailbox_id", F.col("server_id").alias("dedup_key"), status.alias("status")), query, batch_id)


def run_available(stream: DataFrame, ledger: BucketLedger, path: str, options: dict[str, str], checkpoint: str, baseline: int | None = None) -> None:
    """Take all that is new in a drop now; the checkpoint names the query."""
    query = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    fetch = fetched(options)
    run = lambda batch, number: take(batch, ledger, path, fetch, query, number, baseline=baseline)
    started = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).start()
    try:
        started.processAllAvailable()
    finally:
        started.stop()


def messages(ledger: BucketLedger, path: str) -> DataFrame:
    """The messages that were taken: those whose ids are noted, without what was gone."""
    rows = ledger.spark.read.schema(f"{MESSAGES}, query string, batch long").option("basePath", path).parquet(path).where("content is not null")
    noted = ledger.read().where("status = 'claimed'").select("mailbox_id", F.col("dedup_key").alias("server_id"), F.col("query").alias("query"), "batch")
    return rows.join(noted, ["mailbox_id", "server_id", "query", "batch"], "left_semi")
