"""Mailboxes with lasting uids as a streaming source, and an IMAP client for it; drops without them are in ``sources.drop``.

The source asks a client for the highest uid and for the messages of a uid range, so a batch is
repeatable and Spark's offset log is the cursor.  An offset holds the uid and the mailbox's UIDVALIDITY:
when that changes, uids begin anew, the next batch starts at the mailbox's beginning, and what the ledger
knows keeps repeats out.  A batch has at most ``batch_size`` messages; only the first after a restart,
when the reader is not told where the stream is, takes all that is new, in partitions of that size.  A
bounded backfill begins no further back than ``backfill_messages`` below the top.  Clients are named by module and factory and made
where they are used; only one executor talks to a mailbox at a time.
"""

from __future__ import annotations

import imaplib
import importlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "mailbox_id string, uid long, uidvalidity long, server_id string, content binary"


class MailboxClient(Protocol):
    uidvalidity: int | None

    def highest_uid(self) -> int: ...

    def fetch(self, after: int, upto: int) -> Iterator[tuple[int, str | None, bytes]]: ...


class ImapClient:
    """Reads a folder without marking anything as read."""

    def __init__(self, host: str, user: str, password: str, folder: str = "INBOX", port: int = 993):
        self.box = imaplib.IMAP4_SSL(host, port)
        self.box.login(user, password)
        self.box.select(folder, readonly=True)
        self.uidvalidity = int(self.box.response("UIDVALIDITY")[1][0] or 0)

    def _search(self, query: str) -> list[int]:
        return sorted(int(u) for u in (self.box.uid("SEARCH", None, query)[1][0] or b"").split())

    def highest_uid(self) -> int:
        return max(self._search("ALL"), default=0)

    def fetch(self, after: int, upto: int) -> Iterator[tuple[int, str | None, bytes]]:
        for uid in self._search(f"UID {after + 1}:{upto}"):
            if after < uid <= upto:
                yield uid, None, self.box.uid("FETCH", str(uid), "(BODY.PEEK[])")[1][0][1]


@dataclass
class UidRange(InputPartition):
    after: int
    upto: int


class MailboxReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.batch = int(options.get("batch_size", "50"))
        self.start = options.get("initial", "from_now")
        self.at: dict | None = None

    def _client(self) -> MailboxClient:
        module, name = self.options["client"].rsplit(":", 1)
        keys = [k for k in self.options if k.startswith("client.")]
        return getattr(importlib.import_module(module), name)(**{k.removeprefix("client."): self.options[k] for k in keys})

    def initialOffset(self) -> dict:
        """From now on; or from the mailbox's beginning, or so many messages back, where a backfill is asked for."""
        client = self._client()
        top = client.highest_uid()
        back = int(self.options.get("backfill_messages", top))
        self.at = {"uid": top if self.start == "from_now" else max(0, top - back), "validity": client.uidvalidity}
        return dict(self.at)

    def latestOffset(self) -> dict:
        """At most a batch beyond where the stream is; of a mailbox whose validity changed, from its beginning."""
        client = self._client()
        top = client.highest_uid()
        if self.at is not None:
            low = self.at["uid"] if client.uidvalidity == self.at["validity"] else 0
            top = min(top, low + self.batch)
        return {"uid": top, "validity": client.uidvalidity}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.at = dict(end)
        low = start["uid"] if start["validity"] == end["validity"] else 0
        return [UidRange(n, min(end["uid"], n + self.batch)) for n in range(low, end["uid"], self.batch)]

    def read(self, partition: UidRange):
        client = self._client()
        for uid, server_id, content in client.fetch(partition.after, partition.upto):
            yield self.options.get("mailbox_id", "demo"), uid, client.uidvalidity, server_id, content

    def commit(self, end: dict) -> None:
        self.at = dict(end)


class MailboxSource(DataSource):
    """spark.dataSource.register(MailboxSource); spark.readStream.format("mailbox").option("client", "module:factory")."""

    @classmethod
    def name(cls) -> str:
        return "mailbox"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> MailboxReader:
        return MailboxReader(dict(self.options))
