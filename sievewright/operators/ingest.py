"""Ingest bookkeeping: claims, cursors, eligibility and outcomes of fetched messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import text


def eligible(sender: Column, recipients: Column, subject: Column, *, senders: Sequence[str] = (), recipient_domains: Sequence[str] = (), subjects: Sequence[str] = ()) -> Column:
    """Whether allow lists pass a message; an empty list passes all, subjects are case-sensitive."""
    ok = F.lit(True)
    if senders:
        ok = ok & text.gateway_domain(sender).isin(*[s.lower() for s in senders])
    if recipient_domains:
        ok = ok & F.exists(recipients, lambda r: text.gateway_domain(r).isin(*[d.lower() for d in recipient_domains]))
    if subjects:
        some = F.lit(False)
        for s in subjects:
            some = some | subject.contains(s)
        ok = ok & some
    return ok


def claims(messages: DataFrame) -> DataFrame:
    """messages with claimed: whether the row is the first of its (mailbox_id, dedup_key), by uid."""
    order = Window.partitionBy("mailbox_id", "dedup_key").orderBy("uid")
    return messages.withColumn("claimed", F.row_number().over(order) == 1)


def new_claims(messages: DataFrame, ledger: DataFrame) -> DataFrame:
    """First messages of keys that the ledger does not have."""
    known = ledger.select("mailbox_id", "dedup_key")
    first = messages.groupBy("mailbox_id", "dedup_key").agg(F.min("uid").alias("uid"))
    return first.join(known, ["mailbox_id", "dedup_key"], "left_anti")


def outcomes(messages: DataFrame, *, most_bytes: int, passes: Column) -> DataFrame:
    """messages with what becomes of each: too large, a duplicate, filtered, resumed or accepted.

    prior_status is the ledger's status of the key, null where it has none; a claimed one is resumed.
    """
    taken = F.col("prior_status").isNotNull() | ~F.col("claimed")
    outcome = (
        F.when(F.col("n_bytes") > most_bytes, "skipped_oversize")
        .when(taken & (F.coalesce(F.col("prior_status"), F.lit("accepted")) != "claimed"), "duplicate")
        .when(~passes, "skipped_filtered")
        .when(taken, "resumed")
        .otherwise("accepted")
    )
    return messages.withColumn("outcome", outcome)


def unseen(listing: DataFrame, ledger: DataFrame, limit: int) -> DataFrame:
    """The first messages of a mailbox listing whose server id the ledger does not have."""
    seen = ledger.where("server_id is not null").select("mailbox_id", "server_id").distinct()
    new = listing.where("server_id is not null").join(seen, ["mailbox_id", "server_id"], "left_anti")
    order = Window.partitionBy("mailbox_id").orderBy("uid")
    return new.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def first_sync(listing: DataFrame, limit: int) -> DataFrame:
    """The last messages by number: the baseline of a new mailbox."""
    order = Window.partitionBy("mailbox_id").orderBy(F.col("uid").desc())
    return listing.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).drop("_n")


def cursors(advances: DataFrame) -> DataFrame:
    """(mailbox_id, cursor_uid, high_uid): the cursor last written, and the highest uid seen."""
    return advances.groupBy("mailbox_id").agg(F.max_by("uid", F.struct("ts", "uid")).alias("cursor_uid"), F.coalesce(F.max("uid"), F.lit(0)).alias("high_uid"))


def after_cursor(listing: DataFrame, cursors_: DataFrame, limit: int) -> DataFrame:
    """Messages beyond a mailbox's cursor of the same validity, in order; all where validity changed."""
    joined = listing.join(cursors_.select("mailbox_id", F.col("uidvalidity").alias("_v"), "high_water_uid"), "mailbox_id", "left")
    fresh = joined.where(F.col("_v").isNull() | (F.col("_v") != F.col("uidvalidity")) | (F.col("uid") > F.col("high_water_uid")))
    order = Window.partitionBy("mailbox_id").orderBy("uid")
    return fresh.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= limit).select(*listing.columns)
