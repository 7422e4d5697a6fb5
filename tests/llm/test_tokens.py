"""BPE, token files and counts against the tokenizer's own library and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from sievewright.llm import kit  # noqa: E402
from sievewright.llm.bpe import encode_documents, encoder  # noqa: E402
from sievewright.llm.queries import END_OF_TEXT, bpe_digest, op4_bpe, op5_token_counts, op9_token_files  # noqa: E402
from sievewright.llm.separator_scan import count_tokens, write_flat_files  # noqa: E402
from sievewright.llm.token_files import PlaneReader, PlaneWriter, from_planes, read_token_index, to_planes, write_token_files  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")


def strange(n=400, seed=1):
    rng = random.Random(seed)
    kinds = (lambda: rng.randrange(0, 128), lambda: rng.randrange(0, 0x250), lambda: rng.randrange(0x250, 0xD7FF), lambda: rng.randrange(0xE000, 0x1FFFF), lambda: 32, lambda: 39, lambda: rng.randrange(97, 123))
    out = ["".join(chr(rng.choice(kinds)()) for _ in range(rng.randrange(1, 60))) for _ in range(n)]
    out += ["", "Hello WORLD, it's 42 <|endoftext|>x\x1cy !\x1c! cafe\u0301 ΑΣ Σας İ 日本 <|startoftext|><|endoftext|>", "aaaaaaaa aaa aaaaa 'S 'll've ½²³ª _a_b", "\x1c\x1d \u3000\x85x\xa0y", "<|endof text|> < | <|", "x" * 5000]
    return out


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_encoding_equals_the_library(library):
    coder = encoder(PATH, True)
    for texts in (strange(), strange(200, 2), [], [""], ["one two two", None]):
        ids, at = coder.encode_column(pa.array(texts, pa.string()))
        want = library.encode_batch([t or "" for t in texts], add_special_tokens=False)
        for k, w in enumerate(want):
            mine = ids[at[k] : at[k + 1]].tolist()
            assert mine == w.ids
            assert coder.decode(mine) == library.decode(w.ids, skip_special_tokens=False)


def thue_morse(n):
    w = [0]
    while len(w) < n:
        w += [1 - x for x in w]
    return "".join("ab"[x] for x in w[:n]), "".join("ba"[x] for x in w[:n])


@pytest.mark.parametrize("n", [64, 128, 1024, 2048, 4096])
def test_words_that_a_polynomial_hash_confuses(library, n):
    one, two = thue_morse(n)
    raw, offsets = kit.text_bytes(pa.array([one, two]))
    starts, ends, _ = kit.word_bounds(raw, offsets)
    a, b = kit.word_hashes(raw, starts, ends).tolist()
    assert a != b
    coder = encoder(PATH, True)
    ids, at = coder.encode_column(pa.array([one, two, f"{two} {one} {one} {two}"]))
    for k, t in enumerate([one, two, f"{two} {one} {one} {two}"]):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_runs_are_told_apart_by_their_bytes(library, monkeypatch):
    """With a hash that confuses almost all, ids are still the library's, in the batch and from memory."""
    weak = lambda raw, starts, ends: (raw[starts] % 3).astype(np.uint64)
    monkeypatch.setattr(kit, "word_hashes", weak)
    coder = encoder.__wrapped__(PATH, True)
    texts = strange(60, 9) + ["one two one two three", "three two one"]
    for _ in range(2):
        ids, at = coder.encode_column(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids


def test_same_words():
    texts = ["", "a", "abcdefgh", "abcdefghi", "x" * 300, "x" * 299 + "y", "é" * 40]
    raw, offsets = kit.text_bytes(pa.array(texts))
    starts, ends = offsets[:-1], offsets[1:]
    for k in range(len(texts)):
        same = kit.same_words(raw, starts, ends, raw, np.full(len(texts), starts[k]), np.full(len(texts), ends[k]))
        assert np.flatnonzero(same).tolist() == [k]


def test_digests(spark, docs, library):
    texts = [*strange(60, 3), None]
    got = {r.doc_id: r for r in bpe_digest(encode_documents(docs(list(enumerate(texts))), PATH)).collect()}
    for k, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert got[k].n_tokens == len(ids)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert encode_documents(docs([]), PATH).count() == 0


@pytest.mark.parametrize("kind", ["byte", "bit"])
@pytest.mark.parametrize("top", [0, 1, 255, 49_407, 2**32 - 1])
def test_planes(kind, top, tmp_path):
    rng = np.random.default_rng(1)
    ids = rng.integers(0, top + 1, 1001).astype(np.uint32)
    assert (from_planes(to_planes(ids, kind), len(ids), kind) == ids).all()
    cuts = [0, 7, 7, 300, 1001]
    with open(tmp_path / "f", "wb") as f:
        w = PlaneWriter(f, kind, block=64)
        for s, e in zip(cuts[:-1], cuts[1:], strict=True):
            w.add(ids[s:e])
        w.close(np.array([3, 0, 5, 9]), np.array([True, False, True, True]), np.diff(cuts))
    with open(tmp_path / "f", "rb") as f:
        r = PlaneReader(f, (tmp_path / "f").stat().st_size)
        assert (np.concatenate([r.chunk(k) for k in range(len(r.chunks))]) == ids).all()
        assert all((r.document(k) == ids[s:e]).all() for k, (s, e) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)))
        assert r.checksums().tolist() == [zlib.crc32(ids[s:e].astype("<u4").tobytes()) for s, e in zip(cuts[:-1], cuts[1:], strict=True)]


def test_token_files(spark, docs, library):
    rng = random.Random(8)
    rows = [(rng.randrange(10**6), t) for t in strange(80, 4)] + [(None, "no id"), (7, None), (7, "twice"), (8, "word " * 40_000)]
    folder = kit.fresh_path(spark, "test-planes")
    manifest = write_token_files(docs(rows), folder, tokenizer=PATH, end=2, docs_per_file=16)
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in read_token_index(manifest, folder).orderBy("start").collect()]
    assert manifest.count() > 3 and len(got) == len(rows)
    coded = [(i, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    coded = [(i, x, zlib.crc32(np.array(x, dtype="<u4").tobytes())) for i, x in coded]
    assert [g[0] for g in got] == sorted((i for i, _, _ in coded), key=lambda i: (i is not None, i or 0))
    assert sorted((i or -1, len(x), c) for i, x, c in coded) == sorted((g[0] or -1, g[2], g[3]) for g in got)
    assert [g[1] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    many = write_token_files(docs(rows), kit.fresh_path(spark, "test-planes"), tokenizer=PATH, end=2, docs_per_file=30, file_ids=300)
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert many.count() > many.select("bucket").distinct().count()
    empty = write_token_files(docs([]), kit.fresh_path(spark, "test-empty"), tokenizer=PATH, end=2)
    assert read_token_index(empty, folder).count() == 0


def test_a_frequent_id_is_dealt_over_buckets(spark, docs):
    rows = [(None, f"text {k}") for k in range(60)] + [(5, f"other {k}") for k in range(60)] + [(k, "x") for k in range(20)]
    folder = kit.fresh_path(spark, "test-planes")
    manifest = write_token_files(docs(rows), folder, tokenizer=PATH, end=2, docs_per_file=10, file_ids=16)
    sizes = {r.bucket: r["sum(n_docs)"] for r in manifest.groupBy("bucket").sum("n_docs").collect()}
    assert len(sizes) >= 10 and max(sizes.values()) <= 40
    got = read_token_index(manifest, folder).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


def test_separator_scan_over_any_blocks(spark):
    rng = np.random.default_rng(4)
    folder = kit.fresh_path(spark, "test-flat")
    fs, root = kit.filesystem(folder)
    fs.create_dir(root)
    want = set()
    for name, n in (("a", 0), ("b", 1), ("c", 257), ("d", 1000)):
        ids = rng.integers(0, 4, n).astype("<u2")  # 3 ends a document
        if name == "c":
            ids[:130] = 1
        with fs.open_output_stream(f"{root}/{name}") as f:
            f.write(ids.tobytes())
        start = k = 0
        for end in np.flatnonzero(ids == 3).tolist():
            want.add((name, k, start, end - start, True))
            start, k = end + 1, k + 1
        if start < n:
            want.add((name, k, start, n - start, False))
    files = spark.createDataFrame([(x,) for x in "abcd"], "path string")
    for block in (1, 7, 64, 5000):
        got = count_tokens(files, folder, separator=3, block=block).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_token_counts(spark, docs, library):
    library.encode_special_tokens = True
    texts = [*strange(60, 6), None]
    folder = kit.fresh_path(spark, "test-counts")
    places = write_flat_files(docs(list(enumerate(texts))), folder, tokenizer=PATH, separator=END_OF_TEXT)
    got = places.join(count_tokens(places, folder, separator=END_OF_TEXT), ["path", "ordinal"])
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {k: len(library.encode(t or "", add_special_tokens=False).ids) for k, t in enumerate(texts)}
    library.encode_special_tokens = False


def test_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    a, b, c = (q(spark, sf) for q in (op4_bpe, op5_token_counts, op9_token_files))
    assert a.count() == b.count() == c.count() == n
    assert a.join(c.withColumnRenamed("n_tokens", "with_end"), "doc_id").where("n_tokens + 1 <> with_end").count() == 0
    assert a.join(b.withColumnRenamed("n_tokens", "plain"), "doc_id").where("n_tokens <> plain").count() == 0
