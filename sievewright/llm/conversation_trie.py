"""Prefix trie over conversations: which openings they share, and what sharing them saves.

Turns are replaced by numbers from a dictionary of the distinct (role, text) pairs.  Conversations of
the same turns are one weighted class.  The classes go through a most-significant-digit radix sort:
a bucket, the classes below one node of the trie, is split by the number of the next turn, in parallel
over all buckets, and its parts again, until a part has few enough turns for one task.  There a multikey
quicksort finishes it: a ternary partition by one turn at a time, whose recursion into the equal part is
a node and emits it while unwinding, with what its subtree adds up to.  The nodes above take their sums
from the parts, level by level upwards.

Classes are read in chunks of turns: a task gets the next chunk only, and what goes beyond it becomes the
buckets of the next, longer chunk, so no conversation is ever gathered whole.

Scale: texts are hashed and counted where they are read and never shuffled.  Turns are numbered by a
range partitioning, so one conversation with a third of all turns spreads over tasks; frequent turns (at
most 1,000 can each have a thousandth of all rows) are encoded by a broadcast, the others by a join.  Copies
are counted before they are sorted.  A digest over members hashes their ids in order; ranges of ids are joined
to strings of bounded size first, and the strings of a class are hashed as a stream.

Edge cases: turns without a conv_id belong to no conversation and are left out; null roles and texts are
empty; null turns come first; turns of equal number are ordered by the digest of role and text, repeated
rows are turns of their own; an empty table has no nodes; other columns are not read.  Equal sequences meet
by a 128-bit digest of numbered turns and their count.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kit

WORD = r"[^\x20\x09-\x0D]+"
#: Turns of the first chunk; later ones are as long as all before them, up to the longest.
CHUNK, LONGEST = 256, 4096
#: A bucket of so many turns is finished in one task: a thousandth of all, within these bounds.
LOCAL = (1024, 1 << 18)
#: Ids that are joined to one string.
IDS = 8192
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends binary"
NOBODY = hashlib.sha256(b"").digest()


def encode_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, turn_id, words) for every turn, stored; ranks ascend by conversation and turn."""
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)).alias("digest"),
        F.regexp_count(text, F.lit(WORD)).alias("words"),
    )
    turns = kit.ranked(turns, F.struct("conv_id", "turn", "digest"), "rank")
    known = turns.groupBy("digest").agg(F.max("words").alias("words"), F.count("*").alias("n"))
    known = kit.stored(known.withColumn("turn_id", F.monotonically_increasing_id()), "trie-dictionary")
    plain = turns.select("conv_id", "rank", "digest")
    often = F.broadcast(known.where(F.col("n") > known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n // 1000).drop("n"))
    rare = kit.small(known.join(often, "digest", "left_anti").drop("n"), 64)
    coded = plain.join(often, "digest").unionByName(plain.join(often, "digest", "left_anti").join(rare, "digest"))
    return kit.stored(coded.select("conv_id", "rank", "turn_id", "words"), "trie-turns")


def share_openings(encoded: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id, at, turn_id, words) of rebuilt conversations, stored, and all their (conv_id).

    Conversation c begins with the first h turns of c - c % every, h the checksum of c modulo ``most``, and goes on
    with its own after its first h.
    """
    own = encoded.groupBy("conv_id").agg(F.min("rank").alias("first"), F.count("*").alias("n"))
    own = kit.stored(own.withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))), "trie-conversations")
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = own.withColumn("base", F.expr(f"conv_id - conv_id % {every}")).join(kit.small(base, 32), "base", "left")
    convs = kit.stored(convs.withColumn("head", F.least("h", F.coalesce("n_base", F.lit(0)))), "trie-heads")
    turns = encoded.join(kit.small(convs.select("conv_id", "first", "h", "head"), 48), "conv_id").withColumn("at", F.col("rank") - F.col("first"))
    turns = kit.stored(turns.select("conv_id", "at", "turn_id", "words", "h", "head"), "trie-placed")
    kept = turns.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("head")).alias("at"), "turn_id", "words")
    opening = turns.where((F.col("at") < most - 1) & (F.expr(f"conv_id % {every}") == 0)).groupBy(F.col("conv_id").alias("base"))
    opening = opening.agg(F.array_sort(F.collect_list(F.struct("at", "turn_id", "words"))).alias("opening"))
    heads = convs.where("head > 0").join(opening, "base").select("conv_id", F.explode(F.slice("opening", F.lit(1), F.col("head").cast("int"))).alias("t")).select("conv_id", "t.*")
    return kit.stored(kept.unionByName(heads), "trie-rebuilt"), convs.select("conv_id")


def _sequences(turns: DataFrame, members: DataFrame) -> DataFrame:
    """(rep, weight, n, ends): classes of conversations of the same n turns, the smallest of them, how many, and the digest of their ids."""
    each = turns.select("conv_id", F.xxhash64("at", "turn_id").alias("a"), F.xxhash64("turn_id", F.lit(7), "at").alias("b"), F.lit(1).cast("long").alias("n"))
    none = members.select("conv_id", *[F.lit(0).cast("long").alias(c) for c in ("a", "b", "n")])
    rows = each.unionByName(none).groupBy("conv_id").agg(F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"), F.sum("n").alias("n"))
    key = ["a", "b", "n"]

    @kit.tidy
    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            ids = table.column("conv_id").to_pylist()
            a, b, n = (table.column(c).to_pylist() for c in key)
            out = []
            for start, end in zip(*kit.group_slices(table, key), strict=True):
                for low in range(start, end, IDS):
                    some = ids[low : min(low + IDS, end)]
                    out.append((a[start], b[start], n[start], some[0], len(some), ",".join(map(str, some)).encode()))
            yield pa.RecordBatch.from_pydict(dict(zip((*key, "first", "weight", "ids"), map(list, zip(*out, strict=True)), strict=True)))

    @kit.tidy
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, rep, weight = None, None, 0, 0
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("a", "b", "n", "first", "weight", "ids"))
            for a, b, n, first, some, ids in zip(*columns, strict=True):
                if (a, b, n) != now:
                    if now:
                        out.append((rep, weight, now[2], state.digest()))
                    now, state, rep, weight = (a, b, n), hashlib.sha256(ids), first, some
                else:
                    state.update(b",")
                    state.update(ids)
                    weight += some
            if out:
                yield _batch(out, ("rep", "weight", "n", "ends"))
        if now:
            yield _batch([(rep, weight, now[2], state.digest())], ("rep", "weight", "n", "ends"))

    kit.session(turns)
    pieces = rows.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(joined, "a long, b long, n long, first long, weight long, ids binary")
    return kit.stored(pieces.repartition("a", "b").sortWithinPartitions(*key, "first").mapInArrow(hashed, "rep long, weight long, n long, ends binary"), "trie-classes")


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows, strict=True)), strict=True)))


class _Part:
    """A bucket, or several, in one task: its classes by column, and the nodes that come out of them."""

    def __init__(self, table: pa.Table, low: int, high: int) -> None:
        self.low, self.high = low, high
        self.rep, self.weight, self.n, self.ends, self.ids, self.words, self.tail = (table.column(c).to_pylist() for c in ("rep", "weight", "n", "ends", "ids", "words", "tail"))
        self.nodes: list[tuple] = []

    def runs(self, rows: list[int], depth: int) -> Iterator[list[int]]:
        """The rows in runs of the same turn at a depth, by ternary partitions around a middle one."""
        at, ids = depth - self.low, self.ids
        todo = [(rows, False)]
        while todo:
            some, same = todo.pop()
            if same or len(some) == 1:
                yield some
                continue
            pivot = ids[some[len(some) // 2]][at]
            less, equal, more = [], [], []
            for r in some:
                turn = ids[r][at]
                (less if turn < pivot else more if turn > pivot else equal).append(r)
            todo += [(part, part is equal) for part in (more, equal, less) if part]

    def below(self, rows: list[int], depth: int, parent: int) -> tuple[int, int, int]:
        """Emit all nodes under one at a depth that the rows go beyond; its children, leaves and savings."""
        children = leaves = saved = 0
        for run in self.runs(rows, depth):
            some = self.chain(run[0], depth + 1, parent) if len(run) == 1 else self.node(run, depth + 1, parent)
            children, leaves, saved = children + 1, leaves + some[0], saved + some[1]
        return children, leaves, saved

    def emit(self, rep: int, depth: int, parent: int, convs: int, words: int, sums: tuple[int, int, int], ends: bytes) -> tuple[int, int]:
        children, leaves, saved = sums
        leaves, saved = leaves if children else 1, saved + (convs - 1) * words
        self.nodes.append((rep, depth, parent, convs, children, leaves, saved, ends))
        return leaves, saved

    def beyond(self, rows: list[int]) -> tuple[int, int, int]:
        """The sums of a node at the chunk's end, which the row of its smallest conversation carries."""
        for r in rows:
            if self.tail[r]:
                return tuple(self.tail[r].values())
        return 0, 0, 0

    def node(self, run: list[int], depth: int, parent: int) -> tuple[int, int]:
        rep, ends = min(self.rep[r] for r in run), NOBODY
        further = []
        for r in run:
            if self.n[r] > depth:
                further.append(r)
            else:
                ends = self.ends[r]
        sums = self.beyond(run) if depth == self.high else self.below(further, depth, rep)
        return self.emit(rep, depth, parent, sum(self.weight[r] for r in run), self.words[run[0]][depth - 1 - self.low], sums, ends)

    def chain(self, r: int, depth: int, parent: int) -> tuple[int, int]:
        """Emit the nodes that one class alone goes on through, from the last up to a depth."""
        last = min(self.n[r], self.high)
        sums = self.beyond([r])
        for d in range(last, depth - 1, -1):
            up = parent if d == depth else self.rep[r]
            leaves, saved = self.emit(self.rep[r], d, up, self.weight[r], self.words[r][d - 1 - self.low], sums, self.ends[r] if d == self.n[r] else NOBODY)
            sums = (1, leaves, saved)
        return leaves, saved


def _finished(rows: DataFrame, low: int, high: int) -> DataFrame:
    """Nodes of buckets that fit a task, stored, with a row for each bucket's own sums, which has no n_convs."""
    at_once = 4096 if not low else 256

    @kit.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * LONGEST + 1000))
        for table in kit.whole_groups(batches, ["bucket"], at_once):
            part = _Part(table, low, high)
            bucket, depth = table.column("bucket").to_pylist(), table.column("depth").to_pylist()
            for start, end in zip(*kit.group_slices(table, ["bucket"]), strict=True):
                sums = part.below(list(range(start, end)), depth[start], bucket[start])
                part.nodes.append((bucket[start], depth[start], None, None, *sums, None))
            columns = list(zip(*part.nodes, strict=True))
            kinds = [*[pa.int64()] * 7, pa.binary()]
            names = [c.split()[0] for c in NODE.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    kit.session(rows)
    return kit.stored(rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, NODE), "trie-finished")


def _sums(nodes: DataFrame) -> DataFrame:
    """(bucket, sums) of all parents of nodes."""
    sums = F.struct(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return nodes.groupBy(F.col("parent_conv_id").alias("bucket")).agg(sums.alias("sums"))


def _grown(turns: DataFrame, active: DataFrame, low: int, local: int, chunk: int) -> tuple[list[DataFrame], DataFrame]:
    """Nodes deeper than ``low`` of the buckets in active (bucket, rep, weight, n, ends), n > low, and each bucket's (bucket, sums)."""
    high = low + min(max(chunk, low), LONGEST)
    some = turns.where((F.col("at") >= low) & (F.col("at") < high)).join(kit.small(active.select(F.col("rep").alias("conv_id")), 16), "conv_id", "left_semi")
    some = some.groupBy(F.col("conv_id").alias("rep")).agg(F.array_sort(F.collect_list(F.struct("at", "turn_id", "words"))).alias("t"))
    rows = active.join(some, "rep").select("bucket", F.lit(low).cast("long").alias("depth"), "rep", "weight", "n", "ends", F.col("t.turn_id").alias("ids"), F.col("t.words").alias("words"))
    rows = kit.stored(rows, "trie-chunk")
    left = lambda depth: F.sum(F.least("n", F.lit(high)) - depth)
    wide: Column = (F.col("turns") > local) & (F.col("classes") > 1)
    if low:
        sizes = rows.groupBy("bucket").agg(left(low).alias("turns"), F.count("*").alias("classes")).select("bucket", wide.alias("wide"))
        rows = kit.stored(rows.join(kit.small(kit.stored(sizes, "trie-sizes"), 16), "bucket"), "trie-sized")
        parts, big = [rows.where("not wide").drop("wide")], rows.where("wide").drop("wide")
    else:
        parts, big = [], rows  # the root is always split
    splits, over, depth = [], [], low
    while depth < high and not big.isEmpty():
        next_one = big.withColumns({"turn_id": F.get("ids", F.lit(depth - low)), "last": F.get("words", F.lit(depth - low))})
        depth += 1
        nodes = next_one.groupBy("bucket", "turn_id").agg(
            F.min("rep").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("last").alias("last"), left(depth).alias("turns"), F.count("*").alias("classes"), F.max(F.when(F.col("n") == depth, F.col("ends"))).alias("ends")
        )
        nodes = kit.stored(nodes.withColumn("wide", wide), "trie-nodes")
        splits.append((depth, nodes))
        child = kit.small(nodes.select("bucket", "turn_id", F.col("conv_id").alias("child"), "wide"), 40)
        placed = next_one.where(F.col("n") > depth).join(child, ["bucket", "turn_id"])
        placed = kit.stored(placed.select(F.col("child").alias("bucket"), F.lit(depth).cast("long").alias("depth"), "rep", "weight", "n", "ends", "ids", "words", "wide"), "trie-parts")
        if depth == high:
            over.append(placed.select("bucket", "rep", "weight", "n", "ends"))
        else:
            parts.append(placed.where("not wide").drop("wide"))
        big = placed.where("wide").drop("wide")
    here = None
    for part in parts:
        here = part if here is None else here.unionByName(part)
    deeper: list[DataFrame] = []
    sums = None
    if here is not None:
        # What goes beyond the chunk: classes that are alike to its end are one bucket of the next.
        long = here.where(F.col("n") >= high)
        alike = long.groupBy("bucket", "ids").agg(F.min("rep").alias("node"))
        over.append(long.where(F.col("n") > high).join(alike, ["bucket", "ids"]).select(F.col("node").alias("bucket"), "rep", "weight", "n", "ends"))
    rest = over[0] if len(over) == 1 else over[0].unionByName(over[1])
    rest = kit.stored(rest, "trie-rest")
    if not rest.isEmpty():
        deeper, sums = _grown(turns, rest, high, local, chunk)
        sums = kit.stored(sums, "trie-tails")
    nothing = F.lit(None).cast("struct<children:bigint,leaves:bigint,saved:bigint>")
    out, found = list(deeper), None
    if here is not None:
        tails = here.join(sums.select(F.col("bucket").alias("rep"), F.col("sums").alias("tail")), "rep", "left") if sums is not None else here.withColumn("tail", nothing)
        done = _finished(tails, low, high)
        out.append(done.where("n_convs is not null"))
        found = done.where("n_convs is null").select(F.col("conv_id").alias("bucket"), "depth", F.struct(F.col("n_children").alias("children"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved")).alias("sums"))
    above = None
    for at, nodes in reversed(splits):
        under = [f for f in (above, found.where(F.col("depth") == at).drop("depth") if found is not None else None, sums if at == high else None) if f is not None]
        known = None
        for f in under:
            known = f if known is None else known.unionByName(f)
        full = nodes.join(known.withColumnRenamed("bucket", "conv_id"), "conv_id", "left") if known is not None else nodes.withColumn("sums", nothing)
        children = F.coalesce("sums.children", F.lit(0))
        full = full.select(
            "conv_id", F.lit(at).cast("long").alias("depth"), F.col("bucket").alias("parent_conv_id"), "n_convs", children.cast("long").alias("n_children"),
            F.when(children == 0, F.lit(1)).otherwise(F.col("sums.leaves")).cast("long").alias("n_leaves"),
            ((F.col("n_convs") - 1) * F.col("last") + F.coalesce("sums.saved", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends"),
        )
        full = kit.stored(full, "trie-level")
        out.append(full)
        above = _sums(full)
    if found is not None and low:
        mine = found.where(F.col("depth") == low).drop("depth")
        above = mine if above is None else above.unionByName(mine)
    return out, above


def prefix_trie(turns: DataFrame, members: DataFrame, local: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """A row per node: its smallest member and depth, its parent's smallest member, and counts, as in ``NODE``.

    turns (conv_id, at, turn_id, words) number each conversation's turns from 0; members (conv_id) are all
    conversations, those without turns too.  ``ends`` is the SHA-256 of the comma-joined ids that end at the node.
    """
    spark = turns.sparkSession
    classes = _sequences(turns, members)
    whole = classes.agg(F.min("rep").alias("rep"), F.sum("weight").alias("n_convs"), F.sum("n").alias("turns")).first()
    if whole.rep is None:
        return spark.createDataFrame([], NODE)
    if local is None:
        local = min(max(whole.turns // 1000, LOCAL[0]), LOCAL[1])
    active = classes.where("n > 0").withColumn("bucket", F.lit(whole.rep).cast("long"))
    out, sums = _grown(turns, active, 0, local, chunk) if whole.turns else ([], None)
    none = classes.where("n = 0").select("ends").first()
    children, leaves, saved = next((tuple(r.sums) for r in sums.collect()), (0, 1, 0)) if sums is not None else (0, 1, 0)  # one row: the root's
    nodes = spark.createDataFrame([(whole.rep, 0, None, whole.n_convs, children, leaves, saved, none.ends if none else NOBODY)], NODE)
    for some in out:
        nodes = nodes.unionByName(some)
    return nodes


def trie_digest(nodes: DataFrame) -> DataFrame:
    return nodes.select(*[c.split()[0] for c in NODE.split(", ")][:-1], F.lower(F.hex("ends")).alias("ends_sha256"))
