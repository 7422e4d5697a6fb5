"""URL filter by a cascade of Bloom filters, in DataFrame operations only.

A cascade decides exactly whether a key is listed, for every key of a known universe: level 1 encodes
the listed keys, level 2 those other keys of the corpus that level 1 wrongly accepts, level 3 the
listed keys that level 2 wrongly accepts, and so on until a level accepts nothing wrongly.  Probing is
an expression over literals: no join and no shuffle.

The universe are all (host suffix, path prefix) keys that some rule could equal, over all pages.  The
first level's error rate follows from the ratio of listed to other keys, later levels take one half,
so the cascade's size follows the rule list and only the logarithm of the corpus.

Scale: the universe is made distinct, which combines before it shuffles, and stored before it is probed,
so a host that a third of all pages have is a few rows a task.  Levels are literals in the plan, so their
bits are bounded by ``MOST_BITS``; a longer rule list is joined with the distinct keys instead, which
is exact too.

Edge cases: a null url or one without ``://`` has an empty host and path and fits no rule; an empty
rule list lists nothing; unlisted pages get ``default``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.storage import stored

#: Rules of the reported filter: host, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)

#: A level goes into the plan as a literal; its bits are bounded by this.
MOST_BITS = 1 << 22


class TooLong(ValueError):
    """A list of keys that is too long for literals in a plan."""


@dataclass(frozen=True)
class Level:
    seed: int
    hashes: int
    bits: int
    words: tuple[int, ...]

    def accepts(self, key: Column) -> Column:
        store = F.lit(list(self.words))
        tests = None
        for at in _positions(key, self.seed, self.hashes, self.bits):
            word = F.get(store, F.shiftright(at, 6).cast("int"))
            hit = F.call_function("shiftrightunsigned", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
            tests = hit if tests is None else tests & hit
        return tests


def _positions(key: Column, seed: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed * 64 + i)), F.lit(bits)) for i in range(hashes)]


def _encode(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(math.log2(1 / rate)))
    bits = max(64, 64 * math.ceil(n * math.log2(1 / rate) * 1.4427 / 64))
    if bits > MOST_BITS:
        raise TooLong(f"a level of {bits} bits is too large for a plan")
    at = keys.select(F.explode(F.array(*_positions(F.col("key"), seed, hashes, bits))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("b"))
    found = {r.w: r.b for r in words.collect()}  # at most bits / 64 rows
    return Level(seed, hashes, bits, tuple(found.get(i, 0) for i in range(bits // 64)))


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether the key is listed; exact for listed keys and those of the universe it was built for."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            accepted = self.levels[depth - 1].accepts(key)
            # Turned away by an odd level: not listed; by an even one: listed.
            out = F.when(accepted, out).otherwise(F.lit(depth % 2 == 0))
        return out


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """A cascade from (key) frames; listed has the keys to find, universe every key that will be asked."""
    listed = listed.select("key").where("key is not null").distinct()
    n = listed.count()
    if not n:
        return Cascade(())
    universe = stored(universe.select("key").where("key is not null").distinct(), "url-keys")
    others = max(1, universe.count())
    rate = min(0.5, n / (math.sqrt(2) * others))
    levels = [_encode(listed, n, rate, 1)]
    wrong = universe.where(levels[0].accepts(F.col("key"))).join(listed, "key", "left_anti")
    inside, outside = wrong, listed
    while n := inside.count():
        levels.append(_encode(inside, n, 0.5, len(levels) + 1))
        inside, outside = outside.where(levels[-1].accepts(F.col("key"))), inside
    return Cascade(tuple(levels))


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host with ASCII letters lowered and path; both empty for null or without ``://``."""
    found = lambda pattern: F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    host = F.translate(found(r"(?s)^.*?://([^/?#]*)"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, found(r"(?s)^.*?://[^/?#]*([^?#]*)")


def rule_keys(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Every key of a url that a rule of this list could equal, the longest and most specific first."""
    shapes = sorted({(h.count(".") + 1, len(p)) for h, p, _ in rules}, reverse=True)
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -m), F.substring(path, 1, n))) for m, n in shapes]
    return F.array_distinct(F.array_compact(F.array(*keys))) if keys else F.array().cast("array<string>")


def _joined(keyed: DataFrame, rules: Sequence[tuple[str, str, str]], default: str) -> DataFrame:
    """The same verdicts by a join of the distinct hosts and paths with the rules."""
    table = keyed.sparkSession.createDataFrame([(h + p, len(h + p), len(h), v) for h, p, v in rules], "key string, n int, h int, verdict string")
    asked = keyed.select("host", "path", "_keys").distinct().select("host", "path", F.explode("_keys").alias("key"))
    best = asked.join(table, "key").groupBy("host", "path").agg(F.max(F.struct("n", "h", "key", "verdict")).alias("best"))
    ruled = keyed.join(best, ["host", "path"], "left")
    return ruled.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of pages (page_id, url).

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins, of
    equally long ones the one with the longer host.
    """
    spark = pages.sparkSession
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    keyed = parts.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), rules))
    one = lambda kept: spark.createDataFrame([(h + p,) for h, p, _ in kept], "key string")
    try:
        listed = build_cascade(one(rules), keyed.select(F.explode("_keys").alias("key")))
        blocked = build_cascade(one([r for r in rules if r[2] == "block"]), one(rules))
    except TooLong:
        return _joined(keyed, rules, default)
    fitting = F.filter("_keys", lambda k: listed.contains(k))
    longest = F.array_max(F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), F.instr(k, "/").alias("h"), k.alias("key"))))
    ruled = keyed.withColumn("rule", longest["key"])
    verdict = F.when(F.col("rule").isNull(), F.lit(default)).when(blocked.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return ruled.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
