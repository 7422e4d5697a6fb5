"""Similarity joins and passages against brute force, and their edge cases."""

from __future__ import annotations

import random
import time
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

from sievewright.llm import kit
from sievewright.llm.embedding_dedup import cells_of, embedding_near_duplicates, place
from sievewright.llm.ngram_join import keep_one_of_each, ngram_jaccard_join, path_survival, runs_needed
from sievewright.llm.substring_dedup import compact_windows, cut_duplicates, duplicate_spans


def words(rng, n):
    return [f"w{rng.randrange(10**6)}" for _ in range(n)]


def shingles(text):
    w = (text or "").split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, same):
    links, up = defaultdict(int), {i: i for i, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            if same(rows[a][1], rows[b][1]):
                links[rows[a][0]] += 1
                links[rows[b][0]] += 1
                x, y = find(rows[a][0]), find(rows[b][0])
                up[max(x, y)] = min(x, y)
    return {i: (find(i), links[i]) for i, _ in rows}


def similar(x, y):
    a, b = shingles(x), shingles(y)
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-9


def near_copies(rng, base, n, edits):
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_join_matches_brute_force(spark, docs):
    rng = random.Random(3)
    texts = [" ".join(words(rng, rng.randrange(1, 120))) for _ in range(60)]
    texts += near_copies(rng, words(rng, 200), 90, 2)  # one bucket of more than a block of blocks
    texts += near_copies(rng, words(rng, 60), 20, 1) + [texts[0]] * 30 + [texts[3]] * 2 + ["a b c d"] * 3 + ["a b c"]
    texts += [None, "", " \n ", "x " * 3000, "x " * 3001]
    rows = list(enumerate(texts))
    want = brute(rows, similar)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs(rows), small=8, block=16).collect()}
    assert got == want


def test_join_edges(spark, docs):
    assert ngram_jaccard_join(docs([])).count() == 0
    base = "one two three four five six seven eight"
    rows = [(None, base), (5, base), (5, base), (7, None), (7, "other words entirely here now"), (None, None)]
    got = sorted(((r.doc_id or -1, r.class_id or -1, r.n_links) for r in ngram_jaccard_join(docs(rows)).collect()))
    assert got == [(-1, -1, 0), (-1, 5, 2), (5, 5, 2), (5, 5, 2), (7, 7, 0), (7, 7, 0)]
    kept = keep_one_of_each(docs(rows)).collect()
    assert sorted((r.doc_id or -1) for r in kept) == [-1, -1, 5, 7, 7]  # unlike texts of one id both lead a class
    unknown = [(None, base + " nine ten a b c d e f g h i j k l m n"), (5, base + " nine ten a b c d e f g h i j k l m o")]
    assert sorted((r.doc_id or -1, r.class_id, r.n_links) for r in ngram_jaccard_join(docs(unknown)).collect()) == [(-1, 5, 1), (5, 5, 1)]
    assert len(kept[0]) == 8


def test_recall_is_computed():
    assert runs_needed(0.8, 2, 0.999) == runs_needed(0.8, 2, 0.999, 3) == 3
    assert path_survival(0.8, 2, 3) > path_survival(0.8, 2) and 1 - (1 - path_survival(0.8, 2)) ** 3 >= 0.999


def test_recall_of_many_pairs_at_the_threshold(spark, docs):
    """Pairs of 102 shingles that share 82, just above 0.8, among a crowd that makes buckets recurse."""
    rng = random.Random(21)
    rows = []
    for k in range(600):
        w = words(rng, 106)
        v = list(w)
        for at in (20, 90):
            v[at] = "edit"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    assert all(similar(rows[i][1], rows[i + 1][1]) for i in range(0, 20, 2))
    got = {r.doc_id: r.class_id for r in ngram_jaccard_join(docs(rows), small=4).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(600)) >= 597


def test_a_large_group_of_like_texts_is_not_split(spark, docs):
    rng = random.Random(22)
    rows = list(enumerate(near_copies(rng, words(rng, 150), 200, 1) + near_copies(rng, words(rng, 150), 60, 3)))
    want = brute(rows, similar)
    assert {r.doc_id: (r.class_id, r.n_links) for r in ngram_jaccard_join(docs(rows), small=8, block=32).collect()} == want


def test_windows_are_the_cartesian_tree():
    rng = np.random.default_rng(0)
    for _ in range(20):
        offsets = np.concatenate([[0], np.cumsum(rng.integers(0, 60, 6))])
        tokens = rng.integers(0, 40, offsets[-1]).astype(np.uint64)  # with ties
        want = set()
        for i in range(6):
            h = (kit.mix(tokens[offsets[i] : offsets[i + 1]] ^ np.uint64(9)) >> np.uint64(24)).tolist()

            def tree(low, high, h=h, i=i):
                if high - low + 1 >= 7:
                    c = min(range(low, high + 1), key=lambda k: (h[k], k))
                    want.add((i, low, c, high))
                    tree(low, c - 1)
                    tree(c + 1, high)

            tree(0, len(h) - 1)
        assert set(zip(*[x.tolist() for x in compact_windows(tokens, offsets, 7, np.uint64(9))], strict=True)) == want


def passage_case(rng):
    shared = [words(rng, n) for n in (50, 51, 80, 300)]
    texts = [" ".join(words(rng, rng.randrange(0, 200))) for _ in range(20)]
    for k, p in enumerate(shared):
        for _ in range(4 + 20 * (k == 2)):
            texts.append(" ".join(words(rng, rng.randrange(0, 90)) + p + words(rng, rng.randrange(0, 90))))
    edited = list(shared[3])
    edited[100] = "EDIT"
    edited[200:202] = ["TWO", "MORE", "WORDS"]
    texts.append(" ".join(words(rng, 30) + edited + words(rng, 30)))
    texts.append(" ".join(words(rng, 10) + shared[0][:40] + words(rng, 10)))  # too short to count
    texts += [texts[-2]] * 3 + [None, "", "short text"]
    return list(enumerate(texts))


def exact_runs(rows, least=50):
    """Words of each document that lie in a run of so many words of an earlier one."""
    where = defaultdict(list)
    split = {i: (t or "").split() for i, t in rows}
    for i, w in split.items():
        for k in range(len(w) - 4):
            where[tuple(w[k : k + 5])].append((i, k))
    out = defaultdict(set)
    for i, w in split.items():
        before = {}
        for k in range(len(w) - 4):
            now = {(j, m): before.get((j, m - 1), 0) + 1 for j, m in where[tuple(w[k : k + 5])] if j < i}
            before = now
            for n in now.values():
                if n + 4 >= least:
                    out[i].update(range(k - n + 1, k + 5))
    return out, split


def test_passages(spark, docs):
    rows = passage_case(random.Random(5))
    want, split = exact_runs(rows)
    got, sources = defaultdict(set), {}
    for r in duplicate_spans(docs(rows)).collect():
        span = set(range(r.start_word, r.end_word))
        assert not span & got[r.doc_id] and r.source_doc_id < r.doc_id and r.n_words == len(span) >= 50
        got[r.doc_id] |= span
        sources[r.doc_id] = r.source_doc_id
    assert all(want[i] <= got[i] for i in want)
    near = 20 + 4 + 4 + 24 + 4  # the edited copy: found whole, though no exact run is
    assert len(got[near]) >= 299
    extra = {i for i in got if i not in want}
    assert extra <= {near, near + 2, near + 3, near + 4}


def test_passages_are_cut(spark, docs):
    rows = passage_case(random.Random(5))
    want, split = exact_runs(rows)
    df = docs(rows)
    left = {r.doc_id: r for r in cut_duplicates(df).collect()}
    again = exact_runs([(i, left[i].text) for i in sorted(left)])[0]
    assert not again
    assert set(dict(rows)) - set(left) == {58, 59, 60}  # whole copies leave nothing
    for i, t in rows:
        if i in left and i not in want and i != 56:
            assert left[i].text == t
        if i in left and left[i].text != t:
            assert left[i].n_chars == len(left[i].text)
    assert list(left[0].asDict()) == df.columns


def test_passages_edges(spark, docs):
    assert duplicate_spans(docs([])).count() == 0
    long = " ".join(words(random.Random(1), 70))
    rows = [(None, long), (4, long), (4, long), (9, long + " end"), (4, "another text of this id")]
    got = [(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in duplicate_spans(docs(rows)).collect()]
    assert got == [(9, 0, 70, 4)]
    assert sorted(r.text for r in cut_duplicates(docs(rows)).collect())[0] == " end"


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(400):
        rows.append((i, (base[i % 12] + rng.normal(size=16) * (0.05 if i % 3 else 0.6)).tolist(), i % 2 if i % 7 else 0))
    rows += [(400 + k, rows[0][1], 0) for k in range(50)]
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] + [1.0] * 15, 0), (503, [None] + [1.0] * 15, 0), (504, rows[0][1], None), (505, [2.0 * x for x in rows[0][1]], 0), (506, rows[0][1][:8], 0), (507, [float("inf")] * 16, 0)]
    bad = {500, 501, 502, 503, 504, 506, 507}

    def same(x, y):
        (u, a), (v, b) = x, y
        if a != b or a is None or len(u) != len(v):
            return False
        u, v = np.array(u), np.array(v)
        return u @ v / np.sqrt((u @ u) * (v @ v)) >= 0.93

    want = brute([(i, (v, lab)) for i, v, lab in rows if i not in bad], same) | {i: (i, 0) for i in bad}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for cells, block in ((2048, 1024), (40, 16)):
        got = {r.vec_id: (r.component_id, r.n_links) for r in embedding_near_duplicates(df, cell_rows=cells, block=block).collect()}
        assert got == want
    assert embedding_near_duplicates(df.limit(0)).count() == 0


def test_cells_prune_and_lose_nothing(spark):
    """Around centres that lie apart few vectors visit other cells; whoever is within eps of another cell's member does."""
    rng = np.random.default_rng(4)
    eps = np.sqrt(2 - 2 * 0.93)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    for spread, dims in ((0.02, 16), (0.3, 6), (1.0, 3)):
        centres = unit(rng.normal(size=(8, dims)))
        x = unit(np.repeat(centres, 60, axis=0) + spread * rng.normal(size=(480, dims)))
        own, visits = cells_of(x, centres, eps)
        near = x @ x.T >= 0.93
        for i, j in zip(*np.nonzero(near), strict=True):
            assert own[i] >= own[j] or visits[i, own[j]]
        assert visits.mean() < 0.35
    # And in the plan, whatever the size of the label: two pivots at least.
    rows = [(1, 16, i, 1, x.tolist()) for i, x in enumerate(unit(np.repeat(unit(rng.normal(size=(2, 16))), 20, axis=0) + 0.01 * rng.normal(size=(40, 16))))]
    classes = spark.createDataFrame(rows, "label long, dim int, rep long, cnt long, embedding array<double>")
    got = place(classes, eps, 2048).collect()
    assert sum(r.home for r in got) == 40 and len({r.cell for r in got}) == 2


@pytest.mark.parametrize("n", [1, 2, 50])
def test_components_of_chains(spark, n):
    links = spark.createDataFrame([(k + 1, k) for k in range(n)] + [(100 + k, 101 + k) for k in range(3)], "a long, b long")
    got = {r.node: r.component for r in kit.components(links).collect()}
    assert got == {k: 0 for k in range(n + 1)} | {100 + k: 100 for k in range(4)}


def covers(found, doc, low, high):
    """Whether the spans found hold words low to high of the document."""
    return set(range(low, high)) <= {k for r in found if r.doc_id == doc for k in range(r.start_word, r.end_word)}


def test_a_partial_quote_does_not_hide_a_passage(spark, docs):
    rng = random.Random(11)
    rows, want = [], []
    for k in range(40):
        passage, i = words(rng, 50 + k % 20), 10 * k
        variant = list(passage)
        for at in (8, 25, 42):
            variant[at] = f"v{k}x{at}"
        quote = passage[:-1] if k % 2 else variant  # 49 words and more in a row, or all with edits
        if k % 2:
            quote = passage[len(passage) - 49 :][:48]
        rows.append((i, " ".join(words(rng, 20) + quote + words(rng, 20))))
        for d in range(1, 4):
            rows.append((i + d, " ".join(words(rng, 30) + passage + words(rng, 30))))
            if d > 1:
                want.append((i + d, 30, 30 + len(passage)))
    found = duplicate_spans(docs(rows)).collect()
    assert [w for w in want if not covers(found, *w)] == []


def test_a_passage_in_a_repetitive_source(spark, docs):
    rng = random.Random(12)
    rows, want = [], []
    for k in range(60):
        runs = [words(rng, 14) for _ in range(3)]
        records = [[w for run in runs for w in run + words(rng, 7)] for _ in range(80)]
        one = records[rng.randrange(20, 60)]
        rows.append((2 * k, " ".join(w for record in records for w in record)))
        rows.append((2 * k + 1, " ".join(words(rng, 30) + one + words(rng, 30))))
        want.append((2 * k + 1, 30, 30 + len(one)))
    found = duplicate_spans(docs(rows)).collect()
    assert [w for w in want if not covers(found, *w)] == []


def test_passages_with_an_edit_are_recalled(spark, docs):
    from sievewright.llm.substring_dedup import hashes_needed

    assert hashes_needed(0.8, 0.998) == 4
    rng = random.Random(13)
    rows, want = [], []
    for k in range(1000):
        passage = words(rng, 53 + k % 8)
        edited = list(passage)
        edited[rng.randrange(5, len(passage) - 5)] = "edit"  # a span begins and ends with shared shingles
        rows += [(2 * k, " ".join(words(rng, 30) + passage + words(rng, 30))), (2 * k + 1, " ".join(words(rng, 30) + edited + words(rng, 30)))]
        want.append(2 * k + 1)
    found = {r.doc_id for r in duplicate_spans(docs(rows)).collect()}
    few = {r.doc_id for r in duplicate_spans(docs(rows), hashes=2).collect()}
    print("missed", len(set(want) - found), "with two hashes", len(set(want) - few))
    assert len(set(want) - found) <= 2


def test_a_copy_does_not_hide_other_texts_of_its_id(spark, docs):
    rng = random.Random(14)
    whole, passage = words(rng, 70), words(rng, 80)
    rows = [(1, " ".join(whole)), (2, " ".join(words(rng, 20) + passage)), (3, " ".join(whole)), (3, " ".join(words(rng, 20) + passage + words(rng, 20)))]
    got = {(r.doc_id, r.start_word, r.end_word, r.source_doc_id) for r in duplicate_spans(docs(rows)).collect()}
    assert got == {(3, 0, 70, 1), (3, 20, 100, 2)}


def test_fragments_do_not_hide_near_passages(spark, docs):
    """Earlier documents hold shuffled fragments of a passage; of two later ones, one has an edit in it."""
    rng = random.Random(15)
    rows, want = [], []
    for k in range(120):
        length = (50, 60, 120)[k % 3]
        passage, i = words(rng, length), 20 * k
        pieces = [passage[a : a + 40] for a in range(0, length - 39, 10)]
        for f in range(1 + k % 4):  # one to four of them
            rng.shuffle(pieces)
            rows.append((i + f, " ".join(w for p in pieces for w in p + words(rng, 6))))
        edited = list(passage)
        edited[rng.randrange(5, length - 5)] = "edit"
        rows.append((i + 10, " ".join(words(rng, 30) + passage + words(rng, 30))))
        rows.append((i + 11, " ".join(words(rng, 30) + edited + words(rng, 30))))
        same = len(set(shingles(" ".join(passage))) & set(shingles(" ".join(edited))))
        if same >= 0.8 * (2 * (length - 4) - same):
            want.append((i + 11, 35, 25 + length))
    found = duplicate_spans(docs(rows)).collect()
    missed = [w for w in want if not covers(found, *w)]
    print("missed", len(missed), "of", len(want))
    assert len(want) >= 80 and len(missed) <= 0.1 * len(want)


def test_a_common_line_joins_nothing(spark, docs):
    """A line that all documents have, several times, is no passage; passages beside it are found."""
    rng = random.Random(16)
    line, passage = words(rng, 30), words(rng, 60)
    rows = [(i, " ".join(words(rng, 40) + line + words(rng, 40) + line)) for i in range(200)]
    rows += [(200 + i, " ".join(line + words(rng, 20) + passage + line)) for i in range(3)]
    got = {(r.doc_id, r.source_doc_id) for r in duplicate_spans(docs(rows)).collect()}
    assert got == {(201, 200), (202, 200)}


def test_internal_names_may_be_columns(spark, docs):
    from pyspark.sql import functions as F

    rows = passage_case(random.Random(5))[:30]
    names = ["_id", "_h", "_spans", "_rows", "key", "h", "source_tokens", "spots", "_ID"]
    wide = docs(rows)
    for n in names[:-1]:
        wide = wide.withColumn(n, F.lit("x"))
    plain = sorted((r.doc_id, r.text) for r in cut_duplicates(docs(rows)).collect())
    assert sorted((r.doc_id, r.text) for r in cut_duplicates(wide).collect()) == plain and cut_duplicates(wide).columns == wide.columns
    single = sorted((r.doc_id, r.text) for r in keep_one_of_each(docs(rows)).collect())
    assert sorted((r.doc_id, r.text) for r in keep_one_of_each(wide).collect()) == single and keep_one_of_each(wide).columns == wide.columns


def test_slices_are_all_rows_and_each_goes(spark):
    rows = [(k, "x") for k in (-(2**63), -7, -1, 0, 1, 1, 5, 2**63 - 1, None)]
    folder = Path(kit.shared_dir(spark).removeprefix("file://")) / "sievewright"
    for some in (rows, []):
        df = spark.createDataFrame(some, "key long, slice string")
        found, sizes = [], []
        for part in kit.in_slices(df, "key", 4, "sliced"):
            own = [tuple(r) for r in part.collect()]
            assert part.columns == df.columns and len({(k or 0) % 4 for k, _ in own}) <= 1
            found += own
            sizes.append(len(list(folder.glob("sliced-*/slice_=*"))))
        assert sorted(found, key=str) == sorted(some, key=str)
        assert sizes == sorted(sizes, reverse=True) and not list(folder.glob("sliced-*"))


def test_passages_leave_neither_tables_nor_shuffles(spark, docs):
    rng = random.Random(41)
    shared = words(rng, 80)
    rows = [(i, " ".join(words(rng, 60) + shared + words(rng, 60))) for i in range(12)]
    folder = Path(kit.shared_dir(spark).removeprefix("file://")) / "sievewright"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        files = disk.getAllFiles()
        paths = (Path(files.apply(i).getPath()) for i in range(files.size()))
        return {p: p.stat().st_size for p in paths if p.name.startswith("shuffle_") and p.exists()}

    tables, files = set(folder.glob("*")), set(shuffles())
    spans = duplicate_spans(docs(rows))

    def left():  # larger ones than those of counts
        return {p: n for p, n in shuffles().items() if p not in files and n > 256}

    for _ in range(50):  # files are removed in the background
        if not left():
            break
        time.sleep(0.2)
    assert not left()
    assert {p.name.rsplit("-", 1)[0] for p in set(folder.glob("*")) - tables} == {"passage-copies", "passage-met"}
    assert {r["doc_id"] for r in spans.collect()} == set(range(1, 12))
