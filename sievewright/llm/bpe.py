"""BPE encoding and decoding with a pair occurrence index.

Texts are cut at white space into runs, equal runs are found by 64-bit hashes and compared byte by byte,
and only runs not met before are encoded.  All new runs of a batch are laid out as one array of symbols; an index maps each
mergeable pair to all its positions, and active ranks are applied in ascending order: one step merges
every occurrence of a pair at once, and enters the pairs that the merges created into the lists of
their own ranks.  Ids of runs that repeat are remembered by the worker, up to a fixed number of runs.

The result is that of the tokenizer's own library for its vocabulary file (lower-casing word BPE with
an end-of-word suffix), special tokens in a text included.  Runs beyond the Latin blocks are normalised
and split by that library's own tables, one by one; merging is always done here, for all of them at once.

Edge cases: null is an empty text, which has no ids and decodes to an empty string; nothing is
truncated, a text of any length is encoded whole.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Unicode white space; str.split() also cuts at the separators \x1c to \x1f, which are not.
_BLANK = regex.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
#: Kinds of the characters that Latin runs have once lowered: 0 separator, 1 letter, 2 number, 3 other.
_KIND = np.array([0 if c == 10 else 1 if regex.match(r"\p{L}", chr(c)) else 2 if regex.match(r"\p{N}", chr(c)) else 3 for c in range(0x400)], dtype=np.int8)
#: Runs that a worker remembers beyond a batch; when there are more, it starts afresh.
REMEMBERED = 400_000


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else 256 onwards."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in printable}, 0
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + n)
            n += 1
    return [out[b] for b in range(256)]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """All positions of ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(ends[-1] if len(ends) else 0)


class PairIndexBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str, specials: bool = True):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]} if specials else {}
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.names = [""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for name, i in [*vocab.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.names[i] = name
        letters = _byte_letters()
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.plain = np.array([vocab[c] for c in letters], dtype=np.int32)
        self.final = np.array([vocab[c + end] for c in letters], dtype=np.int32)
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        if len(self.names) > 1 << 16:
            raise ValueError("ids beyond 16 bits")
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], dtype=np.uint32)
        order = np.argsort(keys)
        self.keys, self.rank_of_key = keys[order], order.astype(np.int32)
        self.left, self.right = (keys >> 16).astype(np.int32), (keys & 0xFFFF).astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        self.digits = [str(i) for i in range(len(self.names))]
        self.known, self.known_ids = np.zeros(0, np.uint64), np.zeros(0, np.uint16)
        self.known_head, self.known_count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.known_raw, self.known_at, self.known_size = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where it never merges."""
        key = a.astype(np.uint32) << np.uint32(16) | b.astype(np.uint32)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_of_key[at], -1)

    def merge(self, symbols: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge words laid end to end (``last`` marks final symbols): the symbols left and where they start."""
        n = len(symbols)
        sym = np.append(symbols.astype(np.int32), np.int32(0))
        after = np.arange(1, n + 2, dtype=np.int32)
        after[:n][last] = n
        after[n] = n
        before = np.full(n + 1, -1, dtype=np.int32)
        inner = np.flatnonzero(~last).astype(np.int32)
        before[inner + 1] = inner
        alive = np.ones(n, dtype=bool)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            rank = self._ranks(sym[at], sym[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            if not len(at):
                return
            order = np.argsort(rank.astype(np.uint16), kind="stable")  # two bytes: sorted by radix
            at, rank = at[order], rank[order]
            heads = np.flatnonzero(np.diff(rank, prepend=-1))
            for r, part in zip(rank[heads].tolist(), np.split(at, heads[1:]), strict=True):
                if r in index:
                    index[r].append(part)
                else:
                    index[r] = [part]
                    heapq.heappush(active, r)

        enter(inner)
        del inner
        while active:
            r = heapq.heappop(active)
            parts = index.pop(r)
            at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
            a, b = self.left[r], self.right[r]
            at = at[alive[at] & (sym[at] == a) & (after[at] < n) & (sym[after[at]] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of overlapping occurrences every other one, from the left
                chained = np.append(False, after[at[:-1]] == at[1:])
                run_start = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
                at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            gone = after[at]
            beyond = after[gone]
            sym[at] = self.merged[r]
            alive[gone] = False
            after[at] = beyond
            before[beyond] = at  # the entry past the end is never read
            touched = np.concatenate([before[at], at])
            touched = touched[touched >= 0]
            touched = touched[after[touched] < n]
            if len(touched):
                touched.sort()
                enter(touched[np.append(True, touched[1:] != touched[:-1])])
        left = np.flatnonzero(alive)
        return sym[left], left

    def _latin_pieces(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """UTF-8 bytes, which of them end a piece, and bytes of each run, of Latin runs that newlines end."""
        text = text.lower()
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        kind = _KIND[np.minimum(code, 0x3FF)]
        solid = kind > 0
        cut = np.ones(len(code), dtype=bool)  # a piece ends where the kind changes; numbers stand alone
        cut[:-1] = (kind[1:] != kind[:-1]) | (kind[:-1] == 2)
        width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800)
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        ends = np.cumsum(width[solid], dtype=np.int64)
        last = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=bool)
        last[ends[cut[solid]] - 1] = True
        sizes = np.diff(np.concatenate([[0], np.cumsum(np.where(solid, width, 0), dtype=np.int64)[~solid]]))
        return raw[raw != 10], last, sizes

    def _library_pieces(self, run: str) -> list[bytes]:
        """Pieces of any run, by the library's normaliser and splitter."""
        split = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(run))
        return [bytes(self.byte_of[c] for c in p) for p, _ in split]

    def _merged(self, raw: np.ndarray, last: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs given by bytes, ends of pieces and sizes, and the bounds of each run's."""
        sym, at = self.merge(np.where(last, self.final[raw], self.plain[raw]), last)
        return sym, np.searchsorted(at, np.concatenate([[0], np.cumsum(sizes)]))

    def encode_runs(self, raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs laid end to end in UTF-8, and the bounds of each run's ids."""
        ends = np.cumsum(sizes)
        after = np.append(raw[1:], 0)
        odd = (raw == 0x27) | (raw >= 0xC9) | ((raw == 0xC2) & ((after == 0x85) | (after == 0xA0))) | ((raw == 0x3C) & (after == 0x7C))
        hard = np.zeros(len(sizes), dtype=bool)
        hard[np.searchsorted(ends, np.flatnonzero(odd), side="right")] = True
        # Quick ones at once; each ended by a newline, which no run holds.
        soft = np.repeat(~hard, sizes)
        quick = np.insert(raw[soft], np.cumsum(sizes[~hard]), 10)
        sym, bounds = self._merged(*self._latin_pieces(quick.tobytes().decode()))
        counts = np.zeros(len(sizes), dtype=np.int64)
        counts[~hard] = np.diff(bounds)
        if not hard.any():
            return sym, bounds
        rest = np.flatnonzero(hard)
        hard_ids, hard_at = self._hard_runs([raw[ends[k] - sizes[k] : ends[k]].tobytes().decode() for k in rest.tolist()])
        counts[rest] = np.diff(hard_at)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.empty(bounds[-1], dtype=np.int32)
        quick_ids = np.repeat(~hard, counts)
        out[quick_ids] = sym
        out[~quick_ids] = hard_ids
        return out, bounds

    def _hard_runs(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs by the library's splitter, and the bounds of each one's: all their pieces are merged together.

        Runs are cut at special tokens and once more at white space beyond ASCII.
        """
        parts: list[bytes] = []  # pieces of the stretches between special tokens
        stretch, owner, special = [], [], []  # pieces of each stretch, its run, the special id that follows it (or -1)
        for k, text in enumerate(runs):
            at = 0
            for m in [*(self.cut.finditer(text) if self.cut else ()), None]:
                pieces = [p for run in split_runs(text[at : m.start() if m else len(text)]) for p in self._library_pieces(run)]
                parts += pieces
                stretch.append(sum(map(len, pieces)))
                owner.append(k)
                special.append(self.special[m[0]] if m else -1)
                at = m.end() if m else at
        raw = np.frombuffer(b"".join(parts), dtype=np.uint8)
        last = np.zeros(len(raw), dtype=bool)
        last[np.cumsum([len(p) for p in parts], dtype=np.int64) - 1] = True
        ids, bounds = self._merged(raw, last, np.array(stretch, dtype=np.int64))
        special_ids, run = np.array(special, dtype=np.int32), np.array(owner, dtype=np.int64)
        named = np.flatnonzero(special_ids >= 0)
        count = np.bincount(run, weights=np.diff(bounds) + (special_ids >= 0), minlength=len(runs)).astype(np.int64)
        return np.insert(ids, bounds[1:][named], special_ids[named]), np.concatenate([[0], np.cumsum(count)])

    def encode(self, text: str) -> list[int]:
        """Ids of one text, by the library's splitter."""
        return self._hard_runs([text])[0].tolist()

    def encode_column(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a string column, as u16, and each text's bounds in them."""
        raw, offsets = kit.text_bytes(column)
        starts, ends, words = kit.word_bounds(raw, offsets)
        hashes = kit.word_hashes(raw, starts, ends)
        while True:
            key, first, which, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
            same = kit.same_words(raw, starts, ends, raw, starts[first][which], ends[first][which])
            if same.all():
                break
            hashes = np.where(same, hashes, kit.mix(hashes + np.uint64(1)))  # unlike runs that met are parted
        heads, tails = starts[first], ends[first]
        at = np.searchsorted(self.known, key)
        at[at == len(self.known)] = 0
        old = self.known[at] == key if len(self.known) else np.zeros(len(key), dtype=bool)
        hit = np.flatnonzero(old)
        spot = at[hit]
        old[hit] = kit.same_words(raw, heads[hit], tails[hit], self.known_raw, self.known_at[spot], self.known_at[spot] + self.known_size[spot])
        met = np.zeros(len(key), dtype=bool)
        met[hit] = True  # a hash that is taken is not remembered for another run
        new = np.flatnonzero(~old)
        sizes = (tails - heads)[new]
        ids, bounds = self.encode_runs(raw[ranges(heads[new], sizes)], sizes)
        flat = np.concatenate([self.known_ids, ids.astype(np.uint16)])
        head, count = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        head[old], count[old] = self.known_head[at[old]], self.known_count[at[old]]
        head[new], count[new] = bounds[:-1] + len(self.known_ids), np.diff(bounds)
        again = new[(counts[new] > 1) & ~met[new]]
        if len(again):
            self._remember(key[again], head[again], count[again], flat, raw, heads[again], tails[again] - heads[again])
        return flat[ranges(head[which], count[which])], np.concatenate([[0], np.cumsum(count[which])])[words]

    def _remember(self, key: np.ndarray, head: np.ndarray, count: np.ndarray, flat: np.ndarray, raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> None:
        """Keep runs that repeat, with their bytes and ids; when there are too many, start afresh."""
        own = raw[ranges(at, size)]
        own_at = np.cumsum(size) - size
        if len(self.known) + len(key) <= REMEMBERED:
            own_at = np.concatenate([self.known_at, own_at + len(self.known_raw)])
            own = np.concatenate([self.known_raw, own])
            key, size = np.concatenate([self.known, key]), np.concatenate([self.known_size, size])
            head, count = np.concatenate([self.known_head, head]), np.concatenate([self.known_count, count])
        order = np.argsort(key)
        self.known, self.known_count = key[order], count[order]
        self.known_raw, self.known_at, self.known_size = own, own_at[order], size[order]
        self.known_ids = flat[ranges(head[order], count[order])]
        self.known_head = np.cumsum(self.known_count) - self.known_count

    def decode(self, ids) -> str:
        """The tokens' names joined by spaces: the vocabulary file names no decoder."""
        return " ".join([self.names[i] for i in ids])


def split_runs(text: str) -> list[str]:
    if "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
        return [r for r in _BLANK.split(text) if r]
    return text.split()


@cache
def encoder(path: str, specials: bool = True) -> PairIndexBpe:
    """The worker's encoder for a vocabulary file, with the runs that it has met."""
    return PairIndexBpe(path, specials)


def _coder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        digits, names = coder.digits.__getitem__, coder.names.__getitem__
        for batch in batches:
            ids, at = coder.encode_column(batch.column("text"))
            low = 0
            while low < batch.num_rows:  # output by slices of ids
                high = min(batch.num_rows, max(low + 1, int(np.searchsorted(at, at[low] + (1 << 17)))))
                lists = [ids[s:e].tolist() for s, e in zip(at[low:high].tolist(), at[low + 1 : high + 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(low, high - low),
                        pa.array(np.diff(at[low : high + 1])),
                        pa.array([" ".join(map(digits, x)) for x in lists], pa.string()),
                        pa.array([" ".join(map(names, x)) for x in lists], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids", "decoded"],
                )
                low = high
            del ids, at
            kit.give_back()

    return run


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of docs (doc_id long, text string).

    ids holds the decimal ids joined by one space, decoded the text that they decode to.  One pass
    without a shuffle.
    """
    kit.session(docs)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return docs.mapInArrow(kit.tidy(_coder(tokenizer)), "doc_id long, n_tokens long, ids string, decoded string")
