"""Secret scan with multipart credential linking, in DataFrame operations only.

Two layers of spans, in code points of the whole text, end exclusive:

* base spans (``assign``, ``access``, ``hex``) stand for themselves: leftmost, non-overlapping matches of
  their own pattern, those that are too short dropped after matching;
* weak candidates are parts of a credential that mean little alone: other identifiers (``id``),
  unlabelled tokens (``token``) and ``endpoint`` addresses.  One is reported only where its complementary
  parts co-occur in its scope: an id with a secret, a token with an identifier, an endpoint with both.
  Base spans count as parts too: ``access`` identifies, ``assign`` and ``hex`` are secrets.

A scope is a block of text without a blank line, and in it the band of ``REACH`` code points around the
candidate's start.  The interval join of candidates with the parts of their scope is a range frame over
the parts in order of position, so no pair is ever a row.

Positions come from the built-in pattern functions: the texts between matches and the matches themselves
alternate, and a running sum of their lengths places them.  Only lengths leave the scan; the weak
patterns are tried only in texts that have an identifier at all, as every link needs one.

Scale: one pass over the texts, written as one narrow row a document, which also fixes the row numbers
that stand for documents from there on.  Documents without parts stop there; the parts of the others
are shuffled once, by row number, so repeated or null ids gather nowhere, and a group is the parts of one text.

Edge cases: a null text is empty; empty texts have no spans and the digest of an empty string; a null
doc_id stays null, repeated rows and ids give a row each; columns of the input other than doc_id and text
are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kit

#: Kinds of spans in the order of equal starts, with pattern, group that must be long enough, and its least length.
BASE = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"(AKIA[A-Z0-9]+)", 1, 20),
    ("hex", r"([0-9a-f]{24,})", 1, 24),
)
WEAK = (
    ("id", r"""((?:ASIA|AIDA|AROA)[A-Z0-9]{12,}|(?:access_key_id|client_id|account_id|username|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.-]{3,})""", 1, 1),
    ("token", r"([A-Za-z0-9+/_-]{32,}={0,2})", 1, 32),
    ("endpoint", r"""((?:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+)""", 1, 1),
)
#: What parts scopes.
BREAK = ("break", r"(\n[\x20\t\r]*\n)", 1, 1)
#: Code points between the starts of parts that belong together.
REACH = 400
IDENTIFIERS = ("access", "id")
SECRETS = ("assign", "hex", "token")

KINDS = tuple(k for k, *_ in (*BASE, *WEAK))
_EMPTY = "array<struct<kind:string,at:int,step:int,size:int,fits:boolean>>"


#: Fixed texts of which a match of a kind has one at least: a search for them costs less than the pattern.
#: The second ones are sought in lower case, where there is a colon or an equals sign.
HINTS = {
    "assign": ((), ("password", "passwd", "secret", "token", "api")),
    "access": (("AKIA",), ()),
    "id": (("ASIA", "AIDA", "AROA"), ("access_key_id", "client_id", "account_id", "username", "login")),
}


def _has(kind: str, pattern: str) -> Column:
    """Whether a text has a match of a kind, long enough or not."""
    found = F.col("text").rlike(pattern)
    if kind not in HINTS:
        return found
    plain, lower = HINTS[kind]
    tests = [F.col("text").contains(h) for h in plain] + [F.col("low").contains(h) for h in lower]
    return functools.reduce(Column.__or__, tests) & found


def _parts(kind: str, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern in order: distance from the end of the one before to its own end, and size."""
    text = F.col("text")
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda gap: F.length(gap)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.length(m)).alias("size"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda m: F.length(m) >= least).alias("fits"),
    )
    matched = F.filter(found, lambda m: m["size"].isNotNull())  # what follows the last match has no match of its own
    return F.transform(matched, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), (m["gap"] + m["size"]).alias("step"), m["size"].alias("size"), m["fits"].alias("fits")))


def scan(docs: DataFrame) -> DataFrame:
    """(row, doc_id, parts): the parts of each document, stored; row numbers the documents."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), F.when(text.contains("=") | text.contains(":"), F.lower(text)).otherwise("").alias("low"))
    rows = rows.select("row", "doc_id", "text", *[_has(kind, pattern).alias(kind) for kind, pattern, *_ in (*BASE, WEAK[0])])
    none = F.array().cast(_EMPTY)
    base = [F.when(F.col(kind[0]), _parts(*kind)).otherwise(none) for kind in BASE]
    weak = F.when(F.col("access") | F.col("id"), F.concat(*[_parts(*kind) for kind in (*WEAK, BREAK)])).otherwise(none)
    return kit.stored(rows.select("row", "doc_id", F.concat(*base, weak).alias("parts")), "secret-parts")


def _placed(scanned: DataFrame) -> DataFrame:
    """A row for every part that is long enough, with its place and whether complements are in its scope."""
    parts = scanned.where(F.size("parts") > 0).repartition("row").select("row", "doc_id", F.explode("parts").alias("p")).select("row", "doc_id", "p.*")
    run = Window.partitionBy("row", "kind").orderBy("at")
    placed = parts.withColumn("end", F.sum("step").over(run)).withColumn("start", F.col("end") - F.col("size")).where("fits")
    block = F.sum((F.col("kind") == BREAK[0]).cast("long")).over(Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    band = Window.partitionBy("row", "block").orderBy("start").rangeBetween(-REACH, REACH)
    near = lambda kinds: F.max(F.col("kind").isin(*kinds)).over(band)
    return placed.withColumn("block", block).withColumns({"with_id": near(IDENTIFIERS), "with_secret": near(SECRETS)}).where(F.col("kind") != BREAK[0])


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): every span of every document of docs (doc_id, text), as an array of (start, kind, end) in order.

    ``kind`` counts from 0 in the order of ``KINDS``.
    """
    scanned = scan(docs)
    base = F.col("kind").isin(*[k for k, *_ in BASE])
    linked = (
        F.when(F.col("kind") == "id", F.col("with_secret"))
        .when(F.col("kind") == "token", F.col("with_id"))
        .when(F.col("kind") == "endpoint", F.col("with_id") & F.col("with_secret"))
    )
    number = F.array_position(F.lit(list(KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct(F.col("start"), number.alias("kind"), F.col("end"))
    # Documents whose parts are all refused keep their row: the filter is inside the aggregate.
    grouped = _placed(scanned).groupBy("row").agg(F.collect_list(F.when(base | linked, span)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found = scanned.where(F.size("parts") > 0).select("row", "doc_id").join(grouped, "row", "left")
    found = found.select("doc_id", F.coalesce(F.array_sort("spans"), none).alias("spans"))
    return found.unionByName(scanned.where(F.size("parts") == 0).select("doc_id", none.alias("spans")))


def span_digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] < len(BASE))
    names = F.lit(list(KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, (kind, *_) in enumerate(BASE)]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
