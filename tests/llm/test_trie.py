"""Prefix trie against a plain one, over small buckets and chunks too."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import pytest

from sievewright.llm.conversation_trie import encode_turns, prefix_trie, share_openings, trie_digest


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            order = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own.setdefault(conv, []).append((turn is not None, turn or 0, order, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    return out


def brute(rows):
    seqs = rebuilt(rows)
    nodes, below, sums, out = {}, {}, {}, []
    for c, seq in seqs.items():
        for d in range(len(seq) + 1):
            nodes.setdefault(tuple(seq[:d]), []).append(c)
    for path in nodes:
        if path:
            below.setdefault(path[:-1], []).append(path)
    for path in sorted(nodes, key=len, reverse=True):
        some, members = below.get(path, []), nodes[path]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        sums[path] = (sum(sums[p][0] for p in some) or 1, sum(sums[p][1] for p in some) + (len(members) - 1) * words)
        ends = ",".join(str(c) for c in sorted(members) if len(seqs[c]) == len(path))
        out.append((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), len(some), *sums[path], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda t: (t[1], t[0]))


def mine(table, **how):
    turns, members = share_openings(encode_turns(table))
    return sorted(map(tuple, trie_digest(prefix_trie(turns, members, **how)).collect()), key=lambda t: (t[1], t[0]))


SCHEMA = "conv_id long, turn long, role string, text string, rank int, at string"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in range(-25, 90):
        for t in range(rng.choice([0, 1, 2, 3, 5, 9])):
            out.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]) if t > 3 else "user", rng.choice(["a b", "a b", "c\x0bd", None])))
    out += [(c, t, "u", f"w {t}") for c in range(200, 230) for t in range(8)]  # copies, beside their openings
    out += [(c, t, "u", f"v {t}") for c in range(300, 312) for t in range(c - 299)]  # each goes one turn further
    return [*out, (None, 1, "u", "x"), (5, 1, "user", "a b"), (5, 1, "user", "a b")]


@pytest.mark.parametrize("how", [{}, {"local": 3, "chunk": 4}, {"local": 20, "chunk": 3}])
def test_trie_equals_a_plain_one(spark, rows, how):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    assert mine(table, **how) == brute(rows)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mine(empty) == [] and mine(spark.createDataFrame([(None, 1, "u", "x", 1, "")], SCHEMA)) == []
    # A conversation that loses all its turns is a member of the root alone.
    lost = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    one = [(lost, 0, None, None)]
    assert mine(spark.createDataFrame([(*r, 1, "") for r in one], SCHEMA)) == brute(one) == [(lost, 0, None, 1, 0, 1, 0, hashlib.sha256(str(lost).encode()).hexdigest())]


def test_a_long_conversation_is_read_in_chunks(spark):
    rows = [(c, t, "u", f"w {t % 7}") for c in (0, 20, 400) for t in range(700 + c)]
    table = spark.createDataFrame([(*r, 1, "") for r in rows], SCHEMA)
    assert mine(table) == brute(rows)
