"""Governing the sample library: quality, admission, relabelling, archival, statistics, mined rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def quality(samples: DataFrame, valid: Sequence[str]) -> DataFrame:
    """samples (ineligible_reason, label_l1) with reasons and disposition: rejected if there is any reason."""
    reasons = F.array_compact(F.array(F.col("ineligible_reason"), F.when(~F.coalesce(F.col("label_l1").isin(*valid), F.lit(False)), "unknown_taxonomy_category")))
    return samples.withColumn("reasons", F.array_join(reasons, ",")).withColumn("assessed", F.when(F.size(reasons) > 0, "rejected").otherwise("accepted"))


def admission(new: DataFrame, existing: DataFrame) -> DataFrame:
    """new with the first reason against admitting it, null where there is none.

    Of new rows of one mail_hash or fingerprint the first id may be admitted.
    """
    known = lambda c: existing.where(F.col(c).isNotNull()).groupBy(c).agg(F.lit(True).alias(f"_has_{c}"))
    joined = new.join(known("mail_hash"), "mail_hash", "left").join(known("fingerprint"), "fingerprint", "left")
    flat = (F.col("schema_version") != "flat-v1") | (F.coalesce(F.col("disposition") == "accepted", F.lit(False)) & F.col("label_l2").isNull())
    reason = F.when(~flat, "not_accepted_flat").when(F.col("_has_mail_hash"), "duplicate_mail_hash").when(F.col("_has_fingerprint"), "duplicate_fingerprint")
    checked = joined.withColumn("admission_reason", reason).drop("_has_mail_hash", "_has_fingerprint")
    open_ = F.when(F.col("admission_reason").isNull(), F.col("id"))
    for c in ("mail_hash", "fingerprint"):
        first = F.min(open_).over(Window.partitionBy(c))
        later = F.col("admission_reason").isNull() & F.col(c).isNotNull() & (F.col("id") > first)
        checked = checked.withColumn("admission_reason", F.when(later, f"duplicate_{c}").otherwise(F.col("admission_reason")))
    return checked


def relabel(samples: DataFrame, chosen: Column, label: str) -> DataFrame:
    """Chosen rows get one flat label, reviewed and fixed by hand."""
    change = lambda c, value: F.when(chosen, value).otherwise(F.col(c)).alias(c)
    new = {"label_l1": F.lit(label), "label_l2": F.lit(None).cast("string"), "schema_version": F.lit("flat-v1"), "reviewed": F.lit(True), "source": F.lit("human_fix")}
    return samples.select(*[change(c, new[c]) if c in new else F.col(c) for c in samples.columns])


def mark_legacy(samples: DataFrame) -> DataFrame:
    """Flat rows that still have a second level are of the old schema."""
    return samples.withColumn("schema_version", F.when((F.col("schema_version") == "flat-v1") & F.col("label_l2").isNotNull(), "legacy-v3").otherwise(F.col("schema_version")))


def archive_split(samples: DataFrame, as_of_s: int, months: int = 12) -> DataFrame:
    """samples with archived: created before as_of less months of 30 days."""
    return samples.withColumn("archived", F.col("created_s") < as_of_s - 30 * DAY * months)


def reembed_candidates(samples: DataFrame, target: str, limit: int = 100) -> DataFrame:
    """Oldest reviewed accepted rows of another cleaning policy; rows without one are not candidates."""
    ok = (F.col("schema_version") == "flat-v1") & (F.col("disposition") == "accepted") & F.col("reviewed") & (F.col("policy_version") != target)
    return samples.where(ok).orderBy("created_s", "id").limit(limit)


def page(samples: DataFrame, number: int, size: int = 50, label: str | None = None, source: str | None = None) -> DataFrame:
    """A page of the newest samples."""
    for column, value in (("label_l1", label), ("source", source)):
        if value:
            samples = samples.where(F.col(column) == value)
    return samples.orderBy(F.col("created_s").desc(), "id").offset((number - 1) * size).limit(size)


def quality_stats(samples: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by disposition, schema, policy and label, in one pass."""
    view = samples.select(F.coalesce("disposition", F.lit("unassessed")).alias("disposition"), F.col("schema_version").alias("schema"), F.col("policy_version").alias("policy"), F.col("label_l1").alias("label"))
    dims = ("disposition", "schema", "policy", "label")
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims]))
    return view.select(pairs.alias("p")).select("p.*").where("value is not null and value <> ''").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def duplicate_rows(samples: DataFrame, key: str = "fingerprint") -> DataFrame:
    """(duplicate_rows): rows of keys that occur more than once."""
    return samples.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("duplicate_rows"))


def distribution(samples: DataFrame) -> DataFrame:
    """(sender_domain, label, n, total, ratio): how a domain's samples are labelled."""
    counts = samples.where("sender_domain is not null and sender_domain <> '' and label_l1 is not null").groupBy("sender_domain", F.col("label_l1").alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sender_domain"))
    return counts.withColumn("total", total).withColumn("ratio", F.col("n") / F.col("total"))


def cross_domain(dist: DataFrame, others: int = 2) -> DataFrame:
    """dist with cross_domain: at least so many other domains have the label too."""
    return dist.withColumn("cross_domain", F.count("*").over(Window.partitionBy("label")) - 1 >= others)


def proposals(dist: DataFrame, least: int = 5, ratio: float = 0.8, alone: float = 0.9) -> DataFrame:
    """Sender rules worth proposing, less sure where only one domain supports the label."""
    seen = cross_domain(dist).where((F.col("n") >= least) & (F.col("ratio") >= ratio) & (F.col("cross_domain") | (F.col("ratio") >= alone)))
    confidence = F.when(F.col("cross_domain"), F.col("ratio")).otherwise(F.col("ratio") * 0.9)
    return seen.withColumn("confidence", confidence).withColumn("confidence_text", F.format_string("%.2f", "confidence"))


def new_rules(proposed: DataFrame, existing: DataFrame) -> DataFrame:
    """Proposals whose (domain, label) no rule has, each pair once."""
    keys = existing.select(F.lower(F.trim("domain")).alias("sender_domain"), "label")
    return proposed.dropDuplicates(["sender_domain", "label"]).join(keys, ["sender_domain", "label"], "left_anti")


def audit_sample(samples: DataFrame, share: float = 0.1) -> DataFrame:
    """A repeatable share of the unreviewed samples, at least one, by hash of the id."""
    open_ = samples.where("NOT reviewed")
    n = open_.count()
    return open_.orderBy(F.xxhash64("id"), "id").limit(max(1, int(n * share)) if n else 0)


def insert(new: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The library with the admissible rows of new, and the others with their reasons."""
    judged = admission(new, existing)
    admitted = judged.where("admission_reason is null").drop("admission_reason")
    return existing.unionByName(admitted, allowMissingColumns=True), judged.where("admission_reason is not null")


def delete(samples: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    """samples without those of the given ids or hashes."""
    return samples.join(keys.select(key).distinct(), key, "left_anti")


def relabel_many(samples: DataFrame, ids: DataFrame, label: str) -> DataFrame:
    """relabel for the rows whose ids are given."""
    marked = samples.join(ids.select("id").distinct().withColumn("_chosen", F.lit(True)), "id", "left")
    return relabel(marked, F.coalesce("_chosen", F.lit(False)), label).drop("_chosen")


def mark_reembedded(samples: DataFrame, done: DataFrame) -> DataFrame:
    """samples with the new vectors and policy of done (id, embedding, policy_version)."""
    new = done.select("id", F.col("embedding").alias("_e"), F.col("policy_version").alias("_p"))
    joined = samples.join(new, "id", "left")
    hit = F.col("_p").isNotNull()
    return joined.withColumns({"embedding": F.when(hit, F.col("_e")).otherwise(F.col("embedding")), "policy_version": F.coalesce("_p", "policy_version")}).drop("_e", "_p")
