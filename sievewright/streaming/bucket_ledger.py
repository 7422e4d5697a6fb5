"""A ledger of claims in buckets with filters, which a batch opens only where its keys may be.

Keys are hashed into buckets.  A batch appends one segment to each bucket that it has new keys for, and beside it the
segment's Bloom filter.  The next batch reads the filters of the buckets that its own keys fall into, and of the
segments only those that a filter does not rule out; the rest of the ledger is never opened, however
long it grows.  A bucket of more than ``most_segments`` segments is merged into one, so their number is bounded too.

The ledger's state is a log of numbered versions, each the list of its segments and the last batch of every query, a
bounded number of lines.  A version is created only if nobody has created it: the writer that comes second
looks at what the first has added and tries again, so any number of queries may write, no key is claimed
twice and none is lost.  A batch that runs again finds itself in the log and changes nothing.

The log needs a file system whose create fails where a file exists, as HDFS and local disks have; on an object
store it needs one with conditional writes.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sievewright.storage import discard, remove, stored

KEY = ["mailbox_id", "dedup_key"]
#: Bits a key in a filter, and the hashes of a probe: an error rate of 0.05 %.
BITS, HASHES = 16, 11
#: A number that was claimed so long ago without a version is free again.
STALE_SECONDS = 600


@dataclass
class Version:
    number: int = 0
    buckets: int = 64
    #: Segments as (id, bucket, keys).
    segments: list[tuple[str, int, int]] = field(default_factory=list)
    done: dict[str, int] = field(default_factory=dict)


class BucketLedger:
    """The ledger at a path; the number of buckets is fixed when its first version is written."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, most_segments: int = 4) -> None:
        self.spark, self.path, self.buckets, self.most = spark, path.rstrip("/"), buckets, most_segments
        #: What the last batch did: buckets its keys fell into, segments that were opened, new keys, attempts.
        self.last: dict[str, int] = {}

    # --- the log ---

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> Version:
        """The last version."""
        folder, fs = self._file("log")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(("_", "."))]
        if not numbers:
            return Version(buckets=self.buckets)
        last = max(numbers)
        text = self.spark.read.text(f"{self.path}/log/{last:012d}.json", wholetext=True).first().value
        state = json.loads(text)
        return Version(last, state["buckets"], [tuple(s) for s in state["segments"]], state["done"])

    def _commit(self, version: Version) -> bool:
        """Create a version; false if another writer has."""
        text = json.dumps({"buckets": version.buckets, "segments": version.segments, "done": version.done})
        p, fs = self._file(f"log/{version.number:012d}.json")
        draft, _ = self._file(f"log/.{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        claim, _ = self._file(f"log/.{version.number:012d}.claim")
        try:
            # The claim of the number is atomic; the text is complete before its name is.
            fs.create(claim, False).close()
        except Py4JJavaError:
            fs.delete(draft, False)
            if not fs.exists(p):  # its writer is between two steps, or died there
                time.sleep(0.2)
                if not fs.exists(p) and fs.exists(claim) and time.time() - fs.getFileStatus(claim).getModificationTime() / 1000 > STALE_SECONDS:
                    fs.delete(claim, False)
            return False
        return bool(fs.rename(draft, p))

    # --- segments ---

    def _located(self, rows: DataFrame, buckets: int) -> DataFrame:
        return rows.withColumns({"_h": F.xxhash64(*KEY), "_g": F.xxhash64(F.lit(29), *KEY)}).withColumn("bucket", F.pmod(F.col("_h"), F.lit(buckets)).cast("int"))

    @staticmethod
    def _places(words: Column) -> list[Column]:
        """Bits of a key in a filter of so many words: double hashing, the second number odd."""
        odd = F.col("_g").bitwiseOR(F.lit(1))
        bits = words.cast("long") * 64
        return [F.pmod(F.pmod(F.col("_h"), bits) + i * F.pmod(odd, bits), bits) for i in range(HASHES)]

    def _write(self, located: DataFrame, sizes: dict[int, int], name: str) -> None:
        """A segment a bucket, and its filter."""
        located.repartition("bucket").drop("_h", "_g").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        table = self.spark.createDataFrame([(b, max(1, -(-n * BITS // 64))) for b, n in sizes.items()], "bucket int, words int")  # a row a bucket
        bits = located.join(F.broadcast(table), "bucket").select("bucket", F.explode(F.array(*self._places(F.col("words")))).alias("at"))
        set_words = bits.groupBy("bucket", F.shiftright("at", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at % 64 AS INT))")).alias("b"))
        empty = table.select("bucket", F.explode(F.sequence(F.lit(0), F.col("words") - 1)).alias("w"), F.lit(0).cast("long").alias("b"))
        whole = set_words.unionByName(empty).groupBy("bucket", "w").agg(F.bit_or("b").alias("b"))
        filters = whole.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"]).alias("words"))
        filters.write.partitionBy("bucket").parquet(f"{self.path}/filters/{name}")

    def _read(self, kind: str, segments: list[tuple[str, int, int]], schema: StructType | str) -> DataFrame:
        paths = [f"{self.path}/{kind}/{name}/bucket={bucket}" for name, bucket, _ in segments]
        return self.spark.read.schema(schema).parquet(*paths)

    def _known(self, keys: DataFrame, version: Version, opened: set[tuple[str, int, int]]) -> DataFrame | None:
        """Those of the located keys that the ledger has; adds the segments that were opened for it."""
        touched = {r.bucket for r in keys.select("bucket").distinct().collect()}  # bounded by the number of buckets
        at = [s for s in version.segments if s[1] in touched]
        self.last["buckets"] = len(touched)
        if not at:
            return None
        filters = None
        for name, bucket, n in at:
            one = self.spark.read.schema("words array<long>").parquet(f"{self.path}/filters/{name}/bucket={bucket}").withColumns({"bucket": F.lit(bucket), "segment": F.lit(name), "n": F.lit(n)})
            filters = one if filters is None else filters.unionByName(one)
        tests = F.lit(True)
        for place in self._places(F.size("words")):
            tests = tests & (F.call_function("shiftrightunsigned", F.get("words", F.shiftright(place, 6).cast("int")), F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        maybe = stored(keys.join(filters, "bucket").where(tests).select(*KEY, "bucket", "segment", "n"), "ledger-maybe")
        open_now = [(r.segment, r.bucket, r.n) for r in maybe.select("segment", "bucket", "n").distinct().collect()]  # bounded by the segments
        opened.update(open_now)
        if not open_now:
            discard(maybe)
            return None
        known = self._read("data", open_now, ", ".join(f"{c} string" for c in KEY))
        return maybe.select(*KEY).distinct().join(known, KEY, "left_semi")

    def without_known(self, rows: DataFrame) -> DataFrame:
        """rows, with a mailbox and a key, of keys that the ledger does not have."""
        located = stored(self._located(rows, self.version().buckets), "ledger-asked")
        known = self._known(located, self.version(), set())
        new = located if known is None else located.join(known, KEY, "left_anti")
        return new.select(*rows.columns)

    def append(self, batch: DataFrame, query: str, batch_id: int, before_commit: Callable[[], None] | None = None) -> None:
        """Claim the batch's keys that nobody has: of rows with one key, the least by all other columns.

        Rows without a mailbox or key claim nothing.

        ``before_commit`` is called where another writer may come first.
        """
        others = [c for c in batch.columns if c not in KEY]
        batch = batch.where(" AND ".join(f"{c} IS NOT NULL" for c in KEY))
        rows = batch.groupBy(*KEY).agg(F.min(F.struct(*others)).alias("_r")).select(*KEY, "_r.*") if others else batch.distinct()
        rows = stored(rows.select(*[F.col(c).cast("string").alias(c) for c in KEY], *others, F.lit(query).alias("query"), F.lit(batch_id).cast("long").alias("batch")), "ledger-batch")
        opened: set[tuple[str, int, int]] = set()
        for attempt in range(1, 1000):
            now = self.version()
            if now.done.get(query, -1) >= batch_id:
                return
            keys = self._located(rows, now.buckets)
            known = self._known(keys, now, opened)
            new = stored(keys if known is None else keys.join(known, KEY, "left_anti"), "ledger-new")
            sizes = {r.bucket: r.n for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()}  # bounded by the number of buckets
            name = uuid.uuid4().hex[:16]
            if sizes:
                self._write(new, sizes, name)
            if before_commit:
                before_commit()
            segments = [*now.segments, *[(name, b, n) for b, n in sorted(sizes.items())]]
            self.last |= {"opened": len(opened), "new": sum(sizes.values()), "attempts": attempt}
            discard(new)
            if self._commit(Version(now.number + 1, now.buckets, segments, now.done | {query: batch_id})):
                discard(rows)
                self.compact()
                return
            if sizes:
                self._remove([(name, b, n) for b, n in sizes.items()], whole=True)
        raise RuntimeError("other writers kept coming first")

    def compact(self) -> None:
        """Merge the buckets that have more segments than the bound; another writer's version makes it wait for the next batch."""
        now = self.version()
        by: dict[int, list[tuple[str, int, int]]] = {}
        for s in now.segments:
            by.setdefault(s[1], []).append(s)
        full = {b: some for b, some in by.items() if len(some) > self.most}
        if not full:
            return
        old = [s for some in full.values() for s in some]
        schema = self.spark.read.parquet(f"{self.path}/data/{old[0][0]}/bucket={old[0][1]}").schema
        rows = stored(self._located(self._read("data", old, schema), now.buckets), "ledger-merge")
        name = uuid.uuid4().hex[:16]
        self._write(rows, {b: sum(s[2] for s in some) for b, some in full.items()}, name)
        discard(rows)
        merged = [(name, b, sum(s[2] for s in some)) for b, some in sorted(full.items())]
        kept = [s for s in now.segments if s[1] not in full]
        if not self._commit(Version(now.number + 1, now.buckets, [*kept, *merged], now.done)):
            self._remove(merged, whole=True)

    def _remove(self, segments: list[tuple[str, int, int]], whole: bool = False) -> None:
        for kind in ("data", "filters"):
            for where in {f"{self.path}/{kind}/{name}" if whole else f"{self.path}/{kind}/{name}/bucket={b}" for name, b, _ in segments}:
                with contextlib.suppress(Py4JJavaError):
                    remove(self.spark, where)

    def vacuum(self) -> int:
        """Delete segments that no version lists any more, while nobody writes; their number."""
        listed = {(s[0], s[1]) for s in self.version().segments}
        folder, fs = self._file("data")
        there = [(s.getPath().getName(), int(b.getPath().getName().removeprefix("bucket="))) for s in fs.listStatus(folder) for b in fs.listStatus(s.getPath()) if b.getPath().getName().startswith("bucket=")]
        gone = [(name, b, 0) for name, b in there if (name, b) not in listed]
        self._remove(gone)
        return len(gone)

    def read(self) -> DataFrame:
        """All claims, with the query and batch that made them; fails where there are none yet."""
        segments = self.version().segments
        schema = self.spark.read.parquet(f"{self.path}/data/{segments[0][0]}/bucket={segments[0][1]}").schema
        return self._read("data", segments, schema)


def run_available(stream: DataFrame, ledger: BucketLedger, checkpoint: str) -> None:
    """Claim all that a stream has now; the checkpoint names the query."""
    query = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]
    stream.writeStream.foreachBatch(lambda batch, number: ledger.append(batch, query, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
