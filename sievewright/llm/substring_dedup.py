"""Near-duplicate passages across documents by compact windows.

Tokens of a text are its shingles of five words.  For a hash function, the Cartesian tree over the
tokens' hashes groups subsequences: node c with subtree [l, r] stands for every subsequence that lies
in [l, r] and holds c, as all of them have the min-hash of token c.  Nodes of subtrees shorter than a
passage are of no use.  The others are the argmins of all stretches of passage length, so they are
found by sliding minima; as every ancestor of such a node is one too, the tree over these nodes alone
gives their subtrees.  So a text of n tokens gives about 2n / length windows for each of a few hash
functions instead of n^2 subsequences.

Windows meet in three steps.  Over the corpus, a window is keyed by its min-hash token together with the
ten words before it, and again with the ten words after it; each document is paired with the first
document that has one of its keys.  Within such a pair all windows of equal min-hash are joined as
intervals, the joined intervals give the regions of the two texts where a passage may be shared, and
regions are verified on the tokens themselves: a span counts if at least ``words`` words of it stand in
the earlier document with a Jaccard similarity of at least ``threshold``.  The first document of a key
need not hold the passage that later ones share, as one that quotes a part of it has the keys too.  So
the shared anchors that no span holds go on.  Around them each stretch of passage length is keyed as a
whole and its document paired with the first that has it: an exact passage is found whatever other
documents have of it.  And the holders of a key are put in the order of another min-hash of what stands
around the anchor, and each open one is paired with its neighbours: what resembles each other around the
anchor stands together there, apart from what merely quotes a part.  Each window has keys and orders of
its own, so a pair has many chances.

Scale: windows of one key are paired with the key's first document and two neighbours, which is linear
in the windows, and an aggregation that combines before it shuffles, so a passage that a third
of all documents hold costs one partial row a task; where the first documents go back to the windows,
adaptive execution splits a hot key, as both sides are plain exchanges of stored tables.  A source that
very many documents are compared with is salted.  The passage kept is always the one of its first
document.  Most keys belong to one document and go after one exchange of (key, document).  Keys are
stored in slices, and one slice after the other is shuffled and deleted; what is stored is deleted when
nothing reads it any more.  Whole copies are one class and join as such.

What may be missed: a passage with edits within ten words on both sides of every anchor (at the
threshold, one edit in 50 words, each anchor has a clean side), or one whose min-hash tokens all differ:
at exactly the threshold and the least length (1 - threshold) to the power of ``hashes``, far less for
longer passages; and a near copy, without an exact run of ``words`` words, none of whose windows has a
similar one as first or neighbour.  Tokens are compared as 32-bit hashes of shingles.  Holders of one key
and signature are sorted in one task, as rows of six numbers.

Edge cases: null and short texts have no passages; repeats within one document do not count; rows of
one doc_id are one document, spans go to the row whose text they were found in; rows without doc_id
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kit

SHINGLE = 5
#: Farthest gap between matching tokens that one span may bridge.
BRIDGE = 40
#: Hash functions whose windows are joined within a pair.
JOINED = 4
#: Holders of a key that are sorted together, as a rule.
NEIGHBOURS = 1 << 16
#: Parts of the keys that are shuffled one after the other, which bounds the disk that shuffles take.
SLICES = 4
#: Documents that meet one source in a task.
SHARERS = 512
_SEEDS = kit.mix(np.arange(501, 565, dtype=np.uint64))


def _slid(tokens: np.ndarray, length: int, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """The position of the smallest hash among ``length`` tokens from each one on, and all tokens' ranks; ties: the leftmost."""
    n = len(tokens)
    bits = np.uint64(40) if n < 1 << 24 else np.uint64(64 - 34)  # beyond: one text of over 16 million tokens
    shift = np.uint64(64) - bits
    rank = (kit.mix(tokens ^ seed) >> shift << shift) | np.arange(n, dtype=np.uint64)
    low = rank
    span = 1
    while 2 * span <= length:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < length:
        low = np.minimum(low[: len(low) - (length - span)], low[length - span :])
    return (low & ((np.uint64(1) << shift) - np.uint64(1))).astype(np.int64), rank


def compact_windows(tokens: np.ndarray, offsets: np.ndarray, length: int, seed: np.uint64, extents: bool = True) -> tuple[np.ndarray, ...]:
    """(row, l, c, r) of every compact window of at least ``length`` tokens, positions within their rows.

    Without ``extents``, l and r are left at c.
    """
    sizes = np.diff(offsets)
    n = len(tokens)
    none = np.zeros(0, np.int64)
    if n < length or not (sizes >= length).any():
        return none, none, none, none
    if n >= 1 << 24 and len(sizes) > 1:  # positions take 24 bits: go through parts of the rows
        cut = int(np.searchsorted(offsets, offsets[0] + n // 2))
        cut = min(max(cut, 1), len(sizes) - 1)
        left = compact_windows(tokens[: offsets[cut]], offsets[: cut + 1], length, seed, extents)
        right = compact_windows(tokens[offsets[cut] :], offsets[cut:] - offsets[cut], length, seed, extents)
        return (np.concatenate([left[0], right[0] + cut]), *(np.concatenate(x) for x in zip(left[1:], right[1:], strict=True)))
    arg, rank = _slid(tokens, length, seed)  # of the window that starts here
    row = np.repeat(np.arange(len(sizes)), sizes)[: len(arg)]
    inside = np.arange(len(arg)) + length <= offsets[1:][row]
    arg, row = arg[inside], row[inside]
    head = np.ones(len(arg), dtype=bool)
    head[1:] = arg[1:] != arg[:-1]
    node, row = arg[head], row[head]
    base = offsets[:-1][row]
    c = node - base
    if not extents:
        return row, c, c, c
    weight = rank[node]
    place = np.arange(len(node))
    new = np.ones(len(row) + 1, dtype=bool)
    new[1:-1] = row[1:] != row[:-1]
    before = _nearest_smaller(weight, np.where(new[:-1], -1, place - 1))
    after = _nearest_smaller(weight, np.where(new[1:], -1, place + 1))
    left = np.where(before >= 0, c[before] + 1, 0)
    right = np.where(after >= 0, c[after] - 1, offsets[1:][row] - base - 1)
    return row, left, c, right


def _nearest_smaller(weight: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Each node's nearest one of smaller weight on the side that ``at`` points to (-1: none), the tree's ancestor on that side.

    All that lies between a node and what it points to is larger, so a pointer may take over what that one points to.
    """
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[weight[at[todo]] > weight[todo]]
        at[todo] = at[at[todo]]
        todo = todo[at[todo] >= 0]
    return at


def _tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw, offsets = kit.text_bytes(column)
    starts, ends, words = kit.word_bounds(raw, offsets)
    return kit.shingles(kit.word_hashes(raw, starts, ends), words, SHINGLE, short=False)


def _window_writer(length: int, hashes: int):
    """(key, doc_id, c, sig) of every compact window, once with what stands before its anchor and once with what follows.

    sig is a min-hash of what stands around the anchor, by a function of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, offsets = _tokens(batch.column("text"))
            small = tokens >> np.uint64(32)  # what later steps hash
            ids = batch.column("doc_id").to_numpy()
            for f in range(hashes):
                row, _, c, _ = compact_windows(small, offsets, length, _SEEDS[f], extents=False)
                if not len(row):
                    continue
                lowest = _slid(small, length - 1, _SEEDS[32 + f])[0]
                middle = np.clip(offsets[row] + c - (length - 1) // 2, offsets[row], offsets[row + 1] - length + 1)
                sig = small[lowest[middle]].astype(np.uint32).view(np.int32)
                for side in (-1, 1):
                    at = offsets[row] + c
                    far = at + 2 * SHINGLE * side
                    ok = (far >= offsets[row]) & (far < offsets[row + 1])
                    at, far, place = at[ok], far[ok], c[ok].astype(np.int32)
                    key = kit.mix(tokens[at] + _SEEDS[f])
                    key = kit.mix(key * np.uint64(3) + tokens[(at + far) // 2])
                    key = kit.mix(key * np.uint64(3) + tokens[far] + np.uint64(side + 1))
                    some = np.unique(kit.mix(key) + row[ok].astype(np.uint64), return_index=True)[1]  # a text that repeats itself has a key once
                    yield pa.RecordBatch.from_arrays([pa.array(key[some].view(np.int64)), pa.array(ids[row[ok]][some]), pa.array(place[some]), pa.array(sig[ok][some])], names=["key", "doc_id", "c", "sig"])

    return run


def _word_counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            raw, offsets = kit.text_bytes(batch.column("text"))
            words = kit.word_bounds(raw, offsets)[2]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), batch.column("h2"), pa.array(np.diff(words).astype(np.int32))], names=["doc_id", "h", "h2", "n"])


def _token_writer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's tokens, four bytes each."""
    for batch in batches:
        if batch.num_rows:
            tokens, offsets = _tokens(batch.column("text"))
            small = (tokens >> np.uint64(32)).astype("<u4")
            packed = [small[s:e].tobytes() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(packed, pa.binary())], names=["doc_id", "h", "tokens"])


def _around(batch: pa.RecordBatch, tokens: np.ndarray, offsets: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the stretches of all rows laid end to end (``at`` bounds each row's): which hold a token that equals a
    shared anchor of their row, and how many spans hold them."""
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(offsets))
    key = row << np.uint64(32) | tokens
    spots = batch.column("spots").to_pylist()
    c = np.concatenate([*(offsets[i] + np.array([x for x in own if x < offsets[i + 1] - offsets[i]], dtype=np.int64) for i, own in enumerate(spots)), np.zeros(0, np.int64)])
    anchor = np.isin(key, key[c])
    sums = np.concatenate([[0], np.cumsum(anchor)])
    start = np.arange(int(at[-1])) - np.repeat(at[:-1] - offsets[:-1], np.diff(at))
    done = np.zeros(int(at[-1]) + 1, np.int64)
    for i, spans in enumerate(batch.column("spans").to_pylist()):
        for span in spans or ():
            low, high = span["start"], span["end"] - length - SHINGLE + 2
            if low < high:
                done[at[i] + low] += 1
                done[at[i] + high] -= 1
    return sums[start + length] > sums[start], np.cumsum(done)[:-1]


def _stretch_writer(length: int):
    """(key, doc_id, open) of every stretch of passage length around a text's shared anchors; open if no span holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, offsets = _laid(batch.column("tokens"))
            keys, at = kit.shingles(tokens, offsets, length, short=False)
            near, done = _around(batch, tokens, offsets, at, length)
            use = np.flatnonzero(near)
            ids = np.repeat(batch.column("doc_id").to_numpy(), np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(keys[use].view(np.int64)), pa.array(ids[use]), pa.array(done[use] == 0)], names=["key", "doc_id", "open"])

    return run


def _laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    parts = [np.frombuffer(x, dtype="<u4") for x in column.to_pylist()]
    return np.concatenate([*parts, np.zeros(0, np.uint32)]).astype(np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int64)


def _exact_runs(mine: np.ndarray, at: np.ndarray, theirs: np.ndarray, at2: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs (row, s, e, s2) of at least ``length`` tokens that stand in the row's other text as they are, from s2 on, and which tokens that text has.

    Runs are followed from tokens that the other text has once; others are left to the windows.
    """
    n, n2 = len(mine), len(theirs)
    if not n or not n2:
        return np.zeros((4, 0), np.int64), np.zeros(n, dtype=bool)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    key = row.astype(np.uint64) << np.uint64(32) | mine
    key2 = np.repeat(np.arange(len(at2) - 1), np.diff(at2)).astype(np.uint64) << np.uint64(32) | theirs
    order = np.argsort(key2, kind="stable")
    spot = np.searchsorted(key2[order], key)
    there = np.append(key2[order], [~np.uint64(0)] * 2)
    present = there[spot] == key
    single = present & (there[spot + 1] != key)
    drift = order[np.minimum(spot, n2 - 1)] - np.arange(n)
    index, found = np.arange(n), []
    for way in (1, -1):  # from the token before, from the token after
        if way > 0:
            last = np.maximum.accumulate(np.where(single, index, -1))
        else:
            last = np.minimum.accumulate(np.where(single, index, n)[::-1])[::-1]
        known = (last >= 0) & (last < n)
        last = np.where(known, last, 0)
        move = drift[last]
        place = index + move
        ok = known & (row[last] == row) & (place >= at2[:-1][row]) & (place < at2[1:][row])
        ok[ok] = theirs[place[ok]] == mine[ok]
        cut = np.ones(n + 1, dtype=bool)
        cut[1:-1] = (ok[1:] != ok[:-1]) | (move[1:] != move[:-1]) | (row[1:] != row[:-1])
        edges = np.flatnonzero(cut)
        s, e = edges[:-1], edges[1:]
        long = ok[s] & (e - s >= length)
        s, e = s[long], e[long]
        found.append(np.stack([row[s], s - at[row[s]], e - at[row[s]], place[s] - at2[row[s]]]))
    return np.unique(np.concatenate(found, axis=1), axis=1), present


def _linked(runs: list[tuple[int, int, int]], b: np.ndarray, a: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Spans of one text's exact runs (s, e, s2): neighbours that lie in order and near each other in both texts are one
    span if it is similar as a whole, else they are parted at the widest gap."""
    chains: list[list] = []
    for run in sorted(runs):
        last = chains[-1][-1] if chains else None
        if last and run[0] - last[1] <= BRIDGE and 0 < run[2] + run[1] - run[0] - (last[2] + last[1] - last[0]) and run[2] - (last[2] + last[1] - last[0]) <= BRIDGE:
            chains[-1].append(run)
        else:
            chains.append([run])
    out, todo = [], chains
    while todo:
        chain = todo.pop()
        (s, _, s2), (s9, e, e2) = chain[0], chain[-1]
        if len(chain) == 1 or jaccard_at_least(b[s:e], a[s2 : e2 + e - s9], threshold):
            out.append((s, e))
            continue
        gaps = [y[0] - x[1] for x, y in zip(chain[:-1], chain[1:], strict=True)]
        widest = 1 + gaps.index(max(gaps))
        todo += [chain[:widest], chain[widest:]]
    return out


def jaccard_at_least(b: np.ndarray, a: np.ndarray, threshold: float) -> bool:
    mine, theirs = np.unique(b), np.unique(a)
    both = len(np.intersect1d(mine, theirs, assume_unique=True))
    return both >= threshold * (len(mine) + len(theirs) - both) - 1e-9


def _hopeful(mine: np.ndarray, at: np.ndarray, present: np.ndarray, length: int, slack: float):
    """Which stretches hold a token of the other text that is not covered (an argument), and at most a share ``slack`` of tokens that the other does not have."""
    n = len(mine)
    row = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64)
    key = row << np.uint64(32) | mine
    order = np.argsort(key, kind="stable")
    before = np.full(n, -1)
    again = key[order][1:] == key[order][:-1]
    before[order[1:][again]] = order[:-1][again]
    starts = np.arange(max(n - length + 1, 0))

    def distinct(some: np.ndarray) -> np.ndarray:
        """How many of the given tokens each stretch holds, equal ones once: a token counts from the one before it on."""
        place = np.flatnonzero(some)
        first = np.maximum(before[place] + 1, np.maximum(place - length + 1, 0))
        return np.cumsum(np.bincount(first, minlength=n + 1) - np.bincount(place + 1, minlength=n + 1)[: n + 1])[: len(starts)]

    few = distinct(~present) <= slack * distinct(np.ones(n, dtype=bool))

    def good(covered: np.ndarray) -> np.ndarray:
        fresh = np.concatenate([[0], np.cumsum(present & ~covered)])
        return few & (fresh[starts + length] > fresh[starts])

    return good


def _holding(good: np.ndarray, at: np.ndarray, row: np.ndarray, left: np.ndarray, right: np.ndarray, c: np.ndarray, length: int) -> np.ndarray:
    """Windows of which some stretch that holds the anchor is good."""
    sums = np.concatenate([[0], np.cumsum(good)])
    low, high = at[row] + np.maximum(left, c - length + 1), at[row] + np.minimum(c, right - length + 1) + 1
    return sums[np.maximum(high, low)] > sums[low]


def _rows(tokens: np.ndarray, at: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of some rows, laid end to end."""
    size = np.diff(at)[some]
    ends = np.cumsum(size)
    return tokens[np.repeat(at[some] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)], np.concatenate([[0], ends])


def _contexts(tokens: np.ndarray, at: np.ndarray, row: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """A hash of what of each window stands within passage length of its anchor, on either side."""
    n = len(tokens)
    weight = np.cumprod(np.full(n + 1, 0x9E3779B97F4A7C15, dtype=np.uint64), dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kit.mix(tokens) * weight[:n], dtype=np.uint64)])
    here = at[row] + c
    low, high = np.maximum(here - length + 1, at[row] + left), np.minimum(here + length, at[row] + right + 1)
    # All hashes are brought to one power; the anchor's place in its context counts too.
    return kit.mix((sums[high] - sums[low]) * weight[n - low]) ^ kit.mix(((here - low) * 4096 + high - here).astype(np.uint64))


def _joined_windows(mine: np.ndarray, at: np.ndarray, theirs: np.ndarray, at2: np.ndarray, length: int, covered: np.ndarray, hopeful) -> Iterator[np.ndarray]:
    """Windows of equal min-hash of each row's two texts: columns row, l, r, l2, r2, drift.

    First each window with the first occurrence of its min-hash, then with the second, and so on; a window
    goes on while it is ``hopeful``, given the tokens ``covered``, which the caller marks.  Occurrences with
    the same tokens within passage length hold the same passages: one stands for them, and windows of the
    text itself that repeat wait for their first one's turn.
    """
    mates, met, lefts = [], [], 0
    good = hopeful(covered)
    of = np.repeat(np.arange(len(at) - 1), np.diff(at))
    rows = np.flatnonzero(np.bincount(of[: len(good)][good], minlength=len(at) - 1))
    if not len(rows):
        return
    (mine_, at_), (theirs_, at2_) = _rows(mine, at, rows), _rows(theirs, at2, rows)
    for f in range(JOINED):
        row, left, c, right = compact_windows(mine_, at_, length, _SEEDS[f])
        some = _holding(good, at, rows[row], left, right, c, length)
        row, left, c, right = row[some], left[some], c[some], right[some]
        if not len(row):
            continue
        row2, left2, c2, right2 = compact_windows(theirs_, at2_, length, _SEEDS[f])
        if not len(row2):
            continue
        key = mine_[at_[row] + c] << np.uint64(32) | row.astype(np.uint64)
        key2 = theirs_[at2_[row2] + c2] << np.uint64(32) | row2.astype(np.uint64)
        some = np.sort(np.unique(kit.mix(key2) + _contexts(theirs_, at2_, row2, left2, c2, right2, length), return_index=True)[1])
        left2, c2, right2, key2 = left2[some], c2[some], right2[some], key2[some]
        order = np.argsort(key2, kind="stable")
        low, high = np.searchsorted(key2[order], key), np.searchsorted(key2[order], key, side="right")
        hit = low < high
        mates.append(np.stack([left2[order], right2[order], c2[order]]))
        again = np.ones(len(row), dtype=np.int64)
        again[np.unique(kit.mix(key) + _contexts(mine_, at_, row, left, c, right, length), return_index=True)[1]] = 0
        met.append(np.stack([rows[row[hit]], left[hit], right[hit], c[hit], low[hit] + lefts, high[hit] + lefts, again[hit]]))
        lefts += len(order)
    if not met:
        return
    mate, todo = np.concatenate(mates, axis=1), np.concatenate(met, axis=1)
    later, todo, known = todo[:, todo[6] == 1], todo[:, todo[6] == 0], int(covered.sum())
    while todo.shape[1]:
        row, left, right, c, low, _, _ = todo
        joined = np.stack([row, left, right, mate[0, low], mate[1, low], mate[2, low] - c])
        yield joined
        todo[4] += 1
        todo = todo[:, todo[4] < todo[5]]
        if int(covered.sum()) > known:  # what was found covers other windows
            known, good = int(covered.sum()), hopeful(covered)
            todo, later = (x[:, _holding(good, at, x[0], x[1], x[2], x[3], length)] if x.shape[1] else x for x in (todo, later))
        if not todo.shape[1]:
            todo, later = later, later[:, :0]


class _Matcher:
    """Where the tokens of the one texts stand in the others, row by row: of equal ones the nearest to where they are expected."""

    def __init__(self, mine: np.ndarray, at: np.ndarray, theirs: np.ndarray, at2: np.ndarray):
        row = np.repeat(np.arange(len(at) - 1, dtype=np.uint64), np.diff(at))
        row2 = np.repeat(np.arange(len(at2) - 1, dtype=np.uint64), np.diff(at2))
        known, number = np.unique(row2 << np.uint64(32) | theirs, return_inverse=True)
        self.index = np.sort(number << 32 | (np.arange(len(theirs)) - at2[row2.astype(np.int64)]))
        key = row << np.uint64(32) | mine
        spot = np.searchsorted(known, key)
        known = np.append(known, ~np.uint64(0))
        self.number = np.where(known[spot] == key, spot, -1)

    def places(self, tokens: np.ndarray, expect: np.ndarray) -> np.ndarray:
        """Position of each token (given by its place among all) in its row's other text, or -1."""
        number = self.number[tokens]
        expect = np.clip(expect, 0, (1 << 31) - 1)
        right = np.searchsorted(self.index, number << 32 | expect)
        best, gap = np.full(len(tokens), -1), np.full(len(tokens), 1 << 40)
        for at in (np.minimum(right, len(self.index) - 1), np.maximum(right - 1, 0)):
            where = self.index[at] & 0xFFFFFFFF
            away = np.abs(where - expect)
            nearer = (self.index[at] >> 32 == number) & (away < gap)
            best[nearer], gap[nearer] = where[nearer], away[nearer]
        return best


def shared_spans(pb: np.ndarray, pa_: np.ndarray, b: np.ndarray, a: np.ndarray, length: int, threshold: float) -> list[tuple[int, int]]:
    """Spans of text b that stand in a with Jaccard >= threshold, from positions pb of b that match positions pa_ of a."""
    jump, move = np.diff(pb), np.diff(pa_)
    cuts = np.flatnonzero((jump > BRIDGE) | (move > BRIDGE) | (move <= 0)) + 1
    s, e = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(pb)]])
    long = (e > s) & (pb[e - 1] - pb[s] + 1 >= length) & (pa_[e - 1] - pa_[s] + 1 >= length)
    found, todo = [], list(zip(s[long].tolist(), e[long].tolist(), strict=True))
    while todo:
        s, e = todo.pop()
        if jaccard_at_least(b[pb[s] : pb[e - 1] + 1], a[pa_[s] : pa_[e - 1] + 1], threshold):
            found.append((int(pb[s]), int(pb[e - 1]) + 1))
            continue
        widest = s + 1 + int(np.argmax(np.maximum(np.diff(pb[s:e]), np.diff(pa_[s:e]))))
        todo += [(x, y) for x, y in ((s, widest), (widest, e)) if pb[y - 1] - pb[x] + 1 >= length and pa_[y - 1] - pa_[x] + 1 >= length]
    return found


def _regions(met: np.ndarray) -> np.ndarray:
    """Join intervals of each pair: windows of about one drift that overlap are one region: columns row, l, r, l2, r2, drift."""
    row, left, right, left2, right2, drift = met
    order = np.lexsort((drift, row))
    new = np.ones(len(row), dtype=np.int64)
    new[1:] = (np.diff(row[order]) != 0) | (np.diff(drift[order]) > BRIDGE)
    kind = np.empty(len(row), dtype=np.int64)
    kind[order] = np.cumsum(new)
    order = np.lexsort((left, kind))
    kind, left, right, left2, right2, drift, row = (x[order] for x in (kind, left, right, left2, right2, drift, row))
    reach = np.maximum.accumulate(kind << 40 | right) & ((1 << 40) - 1)  # the farthest end so far, of each kind
    new = np.ones(len(row), dtype=bool)
    new[1:] = (kind[1:] != kind[:-1]) | (left[1:] > reach[:-1])
    heads = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    middle = np.lexsort((drift, of))[heads + np.diff(np.append(heads, len(row))) // 2]
    return np.stack([row[heads], left[heads], np.maximum.reduceat(right, heads), np.minimum.reduceat(left2, heads), np.maximum.reduceat(right2, heads), drift[middle]])


def _verifier(length: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            mine, at = _laid(batch.column("tokens"))
            theirs, at2 = _laid(batch.column("source_tokens"))
            small, small2 = mine.astype(np.uint32), theirs.astype(np.uint32)
            ids, h, source = (batch.column(c).to_pylist() for c in ("doc_id", "h", "source"))
            out, covered = [], np.zeros(len(mine), dtype=bool)
            runs, present = _exact_runs(mine, at, theirs, at2, length)
            cuts = np.searchsorted(runs[0], np.arange(batch.num_rows + 1))
            for i in np.flatnonzero(np.diff(cuts)).tolist():
                for s, e in _linked(list(zip(*runs[1:, cuts[i] : cuts[i + 1]].tolist(), strict=True)), small[at[i] : at[i + 1]], small2[at2[i] : at2[i + 1]], threshold):
                    out.append((ids[i], h[i], s, e + SHINGLE - 1, source[i]))
                    covered[at[i] + s : at[i] + e] = True
            hopeful = _hopeful(mine, at, present, length, 1.25 * (1 - threshold))
            matcher = None
            for met in _joined_windows(mine, at, theirs, at2, length, covered, hopeful):
                matcher = matcher or _Matcher(mine, at, theirs, at2)
                row, left, right, left2, right2, drift = _regions(met)
                size = right - left + 1
                ends = np.cumsum(size)
                spot = np.repeat(left - (ends - size), size) + np.arange(ends[-1])  # positions in their rows
                of = np.repeat(np.arange(len(size)), size)
                place = matcher.places(spot + at[row][of], spot + drift[of])
                place[(place < left2[of]) | (place > right2[of])] = -1
                matched = np.bincount(of[place >= 0], minlength=len(size))
                for k in np.flatnonzero(matched >= threshold * length / 2).tolist():
                    i, own = int(row[k]), slice(ends[k] - size[k], ends[k])
                    some = place[own] >= 0
                    if covered[at[i] + spot[own][some]].all():
                        continue
                    for s, e in shared_spans(spot[own][some], place[own][some], small[at[i] : at[i + 1]], small2[at2[i] : at2[i + 1]], length, threshold):
                        out.append((ids[i], h[i], s, e + SHINGLE - 1, source[i]))
                        covered[at[i] + s : at[i] + e] = True
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["doc_id", "h", "start", "end", "source"])

    return run


def hashes_needed(threshold: float, recall: float) -> int:
    """Hash functions of which one has the same min-hash in both texts of a passage at the threshold, but for 1 - recall."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold)))


def _held(rows: DataFrame) -> DataFrame:
    """Rows (key, doc_id, ...) whose key several documents have, with the first of them as source; stored.

    The shared keys are a stored table, so where they are not small both sides of the join are plain
    exchanges, whose hot partitions adaptive execution splits.
    """
    shared = rows.groupBy("key").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("source < last").select("key", "source", "n")
    shared = kit.stored(shared, "passage-firsts")
    # A partition of the shared keys is hashed where it is known to be small, else both sides are sorted.
    part_bytes = shared.count() * 24 / int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = kit.stored(rows.join(shared.hint("shuffle_hash" if part_bytes <= kit.SMALL_BYTES else "merge"), "key"), "passage-holders")
    kit.discard(shared)
    return held


def _neighbours(holders: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs (doc_id, source) of holders of one key that are next to each other in the order of their signatures.

    Of those whose anchor a span holds the first and the last of a signature stand for the others: they
    resemble each other.  Later documents of pairs have an open anchor.
    """
    known = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    done = F.exists("spans", lambda s: (s["start"] <= F.col("c")) & (F.col("c") + SHINGLE <= s["end"]))
    rows = holders.where("n > 2").join(known, "doc_id", "left").select("key", "sig", "doc_id", "n", F.coalesce(~done, F.lit(True)).alias("open"))
    ends = rows.where("not open").groupBy("key", "sig", "n").agg(F.array_distinct(F.array(F.min("doc_id"), F.max("doc_id"))).alias("ends"))
    rows = rows.where("open").unionByName(ends.select("key", "sig", F.explode("ends").alias("doc_id"), "n", F.lit(False).alias("open")))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("sig"), F.ceil(F.col("n") / NEIGHBOURS)).cast("int"))
    order = Window.partitionBy("key", "part").orderBy("sig", "doc_id")
    near = rows.select("doc_id", "open", F.lag("doc_id").over(order).alias("other"), F.lag("open").over(order).alias("other_open"))
    later = F.when(F.col("doc_id") > F.col("other"), F.col("open")).otherwise(F.col("other_open"))
    return near.where((F.col("doc_id") != F.col("other")) & later).select(F.greatest("doc_id", "other").alias("doc_id"), F.least("doc_id", "other").alias("source")).distinct()


def duplicate_spans(docs: DataFrame, *, words: int = 50, threshold: float = 0.8, recall: float = 0.998, hashes: int | None = None) -> DataFrame:
    """Passages of docs (doc_id long, text string) that an earlier document (smaller doc_id) has too.

    One row a span: doc_id, h (hash of the text it was found in), start_word and end_word (from 0, end
    excluded), n_words, source_doc_id.  Spans of a document do not overlap; source_doc_id is the
    document of the span's longest match.  Without ``hashes``, as many are used as ``recall`` needs.
    """
    hashes = hashes or hashes_needed(threshold, recall)
    kit.session(docs)
    length = words - SHINGLE + 1
    docs = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    # Whole copies: a class is one text, its first document keeps it.
    counted = docs.select("doc_id", "h", F.xxhash64(F.lit(5), "text").alias("h2"), "text").mapInArrow(kit.tidy(_word_counter), "doc_id long, h long, h2 long, n int")
    counted = kit.stored(counted.where(F.col("n") >= words), "passage-texts")
    n_texts = counted.count()
    firsts = counted.groupBy("h", "h2", "n").agg(F.min("doc_id").alias("source"))
    copies = kit.stored(counted.join(firsts, ["h", "h2", "n"]).where("doc_id > source").select("doc_id", "h", F.lit(0).alias("start"), F.col("n").alias("end"), "source"), "passage-copies", n_texts)
    kit.discard(counted)
    whole = kit.stored(copies.select("doc_id", "h").distinct(), "passage-whole", n_texts)  # texts, as an id may have others
    first_texts = docs.join(kit.small(whole, 16), ["doc_id", "h"], "left_anti")  # a copy's windows are its first document's
    keys = first_texts.select("doc_id", "text").mapInArrow(kit.tidy(_window_writer(length, hashes)), "key long, doc_id long, c int, sig int")
    held = [_held(rows) for rows in kit.in_slices(keys, "key", SLICES, "passage-keys")]
    holders = reduce(DataFrame.unionByName, held)
    pairs = kit.stored(holders.where("doc_id > source").select("doc_id", "source").distinct(), "passage-pairs")
    spots = kit.stored(holders.groupBy("doc_id").agg(F.collect_set("c").alias("spots")), "passage-spots")
    wanted = kit.stored(spots.select("doc_id"), "passage-wanted", spots.count())
    tokens = kit.stored(docs.join(kit.small(wanted, 16), "doc_id", "left_semi").join(kit.small(whole, 16), ["doc_id", "h"], "left_anti").select("doc_id", "h", "text").mapInArrow(kit.tidy(_token_writer), "doc_id long, h long, tokens binary"), "passage-tokens")
    kit.discard(wanted, whole)

    def verified(pairs: DataFrame) -> DataFrame:
        # A source of many pairs meets them in several tasks.
        often = pairs.groupBy("source").agg(F.ceil(F.count("*") / SHARERS).cast("int").alias("parts"))
        often = kit.stored(often, "passage-sources", pairs.count())
        theirs = tokens.select(F.col("doc_id").alias("source"), F.col("tokens").alias("source_tokens")).join(kit.small(often, 16), "source")
        theirs = theirs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        mine = kit.small(pairs, 32).join(tokens, "doc_id").join(kit.small(often, 16), "source")
        mine = mine.withColumn("part", F.pmod(F.xxhash64("doc_id", "h"), F.col("parts")).cast("int"))
        both = mine.join(theirs, ["source", "part"]).select("doc_id", "h", "source", "tokens", "source_tokens").mapInArrow(kit.tidy(_verifier(length, threshold)), "doc_id long, h long, start int, end int, source long")
        found = kit.stored(both, "passage-met")
        kit.discard(often)
        return found

    spans = verified(pairs)
    # What the first documents of the keys did not give: their holders' neighbours, and stretches of passage length that meet as a whole.
    # All is joined by doc_id, so tokens are shuffled once; a text's spans are told by h.
    known = spans.groupBy("doc_id").agg(F.collect_set(F.struct("h", "start", "end")).alias("known"))
    own = F.filter("known", lambda s: s["h"] == F.col("h"))
    around = tokens.join(spots, "doc_id").join(known, "doc_id", "left").select("doc_id", "tokens", "spots", own.alias("spans"))
    stretches = around.mapInArrow(kit.tidy(_stretch_writer(length)), "key long, doc_id long, open boolean")
    first = stretches.groupBy("key").agg(F.min("doc_id").alias("source"), F.max(F.when(F.col("open"), F.col("doc_id"))).alias("last")).where("source < last").select("key", "source")
    first = kit.stored(first, "passage-stretches")
    more = stretches.where("open").join(kit.small(first, 16), "key").where("doc_id > source").select("doc_id", "source")
    more = more.unionByName(_neighbours(holders, spans)).distinct()
    more = kit.stored(more.join(pairs, ["doc_id", "source"], "left_anti"), "passage-more")
    kit.discard(*held, pairs, spots, first)
    spans = spans.unionByName(verified(more))
    kit.discard(more, tokens)
    # Merge what overlaps within a document (its spans only, so small).
    per_doc = spans.groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.struct("start", "end", "source"))).alias("s"))
    empty = F.expr("CAST(array() AS array<struct<start:int,end:int,source:bigint,most:int>>)")

    def add(done, s):
        last = F.element_at(done, -1)
        one = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["source"].alias("source"), (s["end"] - s["start"]).alias("most"))
        longer = s["end"] - s["start"] > last["most"]
        grown = F.struct(
            last["start"].alias("start"),
            F.greatest(last["end"], s["end"]).alias("end"),
            F.when(longer, s["source"]).otherwise(last["source"]).alias("source"),
            F.greatest(last["most"], s["end"] - s["start"]).alias("most"),
        )
        return F.when((F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(grown))).otherwise(F.concat(done, F.array(one)))

    merged = per_doc.select("doc_id", "h", F.explode(F.aggregate("s", empty, add)).alias("m")).select("doc_id", "h", "m.start", "m.end", "m.source")
    every = merged.unionByName(copies)
    return every.select("doc_id", "h", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), F.col("source").alias("source_doc_id"))


def _cutter(column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            raw, offsets = kit.text_bytes(batch.column("text"))
            starts, ends, words = kit.word_bounds(raw, offsets)
            data = raw.tobytes()
            texts = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column(column).to_pylist()):
                if not spans:
                    continue
                at, parts, own = int(offsets[i]), [], words[i]
                for s, e in sorted((x["start_word"], x["end_word"]) for x in spans):
                    parts.append(data[at : int(starts[own + s])])
                    at = int(ends[own + e - 1])
                parts.append(data[at : int(offsets[i + 1])])
                texts[i] = b"".join(parts).decode()
            yield pa.RecordBatch.from_arrays([*(pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in batch.schema.names)], names=batch.schema.names)

    return run


def cut_duplicates(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without the passages that an earlier document has.

    A document that had words and has none left goes; others keep all their columns, n_chars (if there
    is one) follows the text.  Columns of any other name are carried along.
    """
    spans = kit.stored(duplicate_spans(docs, **options), "passage-spans")
    id_, h, cuts = kit.free_names(docs, "_id", "_h", "_spans")
    per_doc = spans.groupBy(F.col("doc_id").alias(id_), F.col("h").alias(h)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(cuts))
    joined = docs.join(kit.small(kit.stored(per_doc, "passage-cuts", spans.count(), 64), 96), (F.col("doc_id") == F.col(id_)) & (F.xxhash64("text") == F.col(h)), "left").drop(id_, h)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields)
    cut = joined.mapInArrow(kit.tidy(_cutter(cuts)), schema).where(F.col(cuts).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        cut = cut.withColumn("n_chars", F.when(F.col(cuts).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return cut.select(*docs.columns)
