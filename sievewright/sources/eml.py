"""RFC 822 messages as rows, with the standard library's parser over Arrow batches."""

from __future__ import annotations

import email
import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime
from email import policy
from email.header import decode_header, make_header
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

EVENT = (
    "path string, message_id string, sender string, recipients array<string>, subject string, body string, mailbox_id string, received_at timestamp, "
    "attachments array<string>, attachment_meta array<struct<filename:string,content_type:string,size:int>>, dedup_key string, date_missing boolean, n_bytes long"
)


def read_eml(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of a folder's .eml files; order by path where order matters."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").load(folder).select("path", "content")


def _text(value: str | None) -> str:
    try:
        return str(make_header(decode_header(value or "")))
    except (LookupError, ValueError):
        return value or ""


def _decoded(part) -> str:
    raw = part.get_payload(decode=True) or b""
    try:
        return raw.decode(part.get_content_charset() or "utf-8")
    except (LookupError, UnicodeDecodeError):
        return raw.decode("utf-8", errors="replace")


def dedup_key(raw: bytes, message_id: str | None) -> str:
    """The lowered Message-ID, else a digest of the bytes."""
    name = (message_id or "").strip().casefold()
    return name or hashlib.sha256(raw).hexdigest()


def parse_message(raw: bytes, mailbox_id: str, as_of: datetime) -> dict:
    """Fields of one message; a missing or bad date is as_of, a date without a zone is UTC."""
    message = email.message_from_bytes(raw, policy=policy.compat32)
    plain, rich, meta = None, None, []
    for part in message.walk():
        if part.is_multipart():
            continue
        name = part.get_filename()
        if name or part.get_content_disposition() == "attachment":
            meta.append({"filename": _text(name), "content_type": part.get_content_type(), "size": len(part.get_payload(decode=True) or b"")})
        elif part.get_content_type() == "text/plain":
            plain = _decoded(part) if plain is None else plain
        elif part.get_content_type() == "text/html":
            rich = _decoded(part)
    try:
        when = parsedate_to_datetime(message["Date"])
        when = when.replace(tzinfo=UTC) if when.tzinfo is None else when.astimezone(UTC)
        missing = False
    except (TypeError, ValueError):
        when, missing = as_of, True
    given = _text(message["Message-ID"]).strip()
    key = dedup_key(raw, given)
    return {
        "message_id": given or key,
        "sender": _text(message["From"]),
        "recipients": [r for r in (x.strip() for x in _text(message["To"]).split(",")) if r],
        "subject": _text(message["Subject"]),
        "body": plain if plain is not None else rich or "",
        "mailbox_id": mailbox_id,
        "received_at": when,
        "attachments": [m["filename"] for m in meta if m["filename"]],
        "attachment_meta": meta,
        "dedup_key": key,
        "date_missing": missing,
        "n_bytes": len(raw),
    }


def parse_eml(files: DataFrame, *, mailbox_id: str = "demo", as_of: datetime | None = None) -> DataFrame:
    """Messages of files (path string, content binary)."""
    moment = as_of or datetime(1970, 1, 1, tzinfo=UTC)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"path": p} | parse_message(bytes(c), mailbox_id, moment) for p, c in zip(batch["path"], batch["content"], strict=True)]
            if rows:
                out = pd.DataFrame(rows)
                out["received_at"] = pd.to_datetime(out["received_at"], utc=True)
                yield out

    return files.select("path", "content").mapInPandas(run, EVENT)
