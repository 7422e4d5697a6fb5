"""Mixing, toxicity, top-k, the URL filter and the pipeline."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.llm.mixing import mix_sources, mixed_documents, pivot, source_targets
from sievewright.llm.topk_search import exact_topk, search_block
from sievewright.llm.toxicity import drop_toxic, fit, held_out, score_toxicity, swap_terms, train_toxicity
from sievewright.llm.url_filter import RULES, build_cascade, filter_urls


def fill_targets(sizes, weights, total, most):
    """Shares by weight; whoever is above most times its size stops there, the rest is dealt again."""
    targets, free, rest = [0.0] * len(sizes), set(range(len(sizes))), total
    while free:
        unit = rest / sum(weights[i] for i in free)
        full = {i for i in free if unit * weights[i] > most * sizes[i]}
        for i in full or free:
            targets[i] = most * sizes[i] if full else unit * weights[i]
            rest -= targets[i] if full else 0
        if not full:
            break
        free -= full
    return targets


def test_targets(spark):
    assert fill_targets([10, 10, 10], [5, 2, 1], 45, 2) == [20.0, pytest.approx(50 / 3), pytest.approx(25 / 3)]
    rng = np.random.default_rng(7)
    for sizes, total in (([10, 10, 10], 45), ([0, 100], 150), ([0, 0], 0), ([1000, 1, 1, 50, 3, 700], 2600), (rng.integers(0, 1000, 50).tolist(), 30_000)):
        table = spark.createDataFrame(list(enumerate(sizes)), "sid long, source_size long")
        got = [r.target for r in source_targets(table, (5, 2, 1), total, 2).orderBy("sid").collect()]
        assert got == pytest.approx(fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], total, 2))


def test_targets_of_a_table_in_sql(spark):
    """Sizes, source sizes and targets of the smallest table, told by SQL and the rule above."""
    import duckdb

    sf = "/root/testdata/sf0.001"
    told = duckdb.sql(f"SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) FROM '{sf}/documents.parquet' GROUP BY 1 ORDER BY source NULLS LAST").fetchall()
    sizes = [int(n) for _, n in told]
    want = dict(zip([s for s, _ in told], zip(sizes, fill_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2), strict=True), strict=True))
    got = mix_sources(spark.read.parquet(f"{sf}/documents.parquet")).select("source", "source_size", "target").distinct().collect()
    assert {r.source: (r.source_size, pytest.approx(r.target)) for r in got} == want


def test_repeated_rows_are_mixed_apart(spark):
    rows = [(None, "one two three", "a")] * 500 + [(7, "four five", "a")] * 300 + [(2**60 + i, "six " * (i % 5), "b") for i in range(400)] + [(2**60, "other", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for n in ("_id", "_h", "_source", "_n", "_many", "_copy", "sid", "leaf", "key", "p", "size", "number"):
        df = df.withColumn(n, F.lit("x"))
    got = mix_sources(df, leaf=32, fan=4).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got} == {r[0] for r in rows}
    for name in "ab":
        mine = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 4
    taken = mixed_documents(df, leaf=32, fan=4)
    count = lambda pairs: sorted(((a or -1), b) for a, b in pairs)
    assert taken.columns == df.columns
    assert count((r.doc_id, len(r.text.split())) for r in taken.collect()) == count((r.doc_id, r["size"]) for r in got for _ in range(r.copies))


def test_pivot_keeps_mass():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 500):
        size, p = rng.integers(1, 500, n), np.full(n, 0.37)
        out, held = pivot(size, p, np.arange(n), 3)
        assert (size * out).sum() == pytest.approx((size * p).sum())
        assert all(x in (0.0, 1.0) for k, x in enumerate(out) if k != held)


def test_pivot_keeps_expectations():
    size, p = np.array([5, 9, 2, 7]), np.array([0.3, 0.6, 0.5, 0.2])
    mean = np.mean([pivot(size, p, np.arange(4), seed)[0] for seed in range(4000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), ["b", "a", "hot", None][0 if i % 9 == 0 else 1 if i % 9 == 1 else 3 if i % 9 == 2 else 2]) for i in range(3000)]
    rows += [(3000, None, "a"), (3001, " \n", "empty"), (None, "one two", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = mix_sources(df, leaf=64, fan=4).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    for name in ("a", "b", "hot", None, "empty"):
        mine = [r for r in got if r.source == name]
        assert sum(r["size"] for r in mine) == mine[0].source_size
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 60
        assert all(r.taken == r["size"] * r.copies <= 2 * r["size"] for r in mine)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(1.5 * total)
    again = mix_sources(df.repartition(7), leaf=64, fan=4).collect()
    assert sorted((r.doc_id or -1, r.taken) for r in got) == sorted((r.doc_id or -1, r.taken) for r in again)
    taken = mixed_documents(df, leaf=64, fan=4)
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in got)
    assert mix_sources(df.limit(0)).count() == 0


def toxic_table(spark, n=3000):
    rng = np.random.default_rng(5)
    prose = [f"word{k}" for k in range(300)]
    rows = []
    for i in range(n):
        w = list(rng.choice(prose, rng.integers(5, 200)))
        bad = int(i % 8 == 0)
        if bad:
            w[int(rng.integers(len(w)))] = str(rng.choice(["vileworm!", "Dregs.", "scoundrelish"]))
        if i % 5 < 2 + 2 * bad:
            w.append("Muslim" if i % 2 else "gay")  # a group is mentioned more often in toxic texts
        rows.append((i, " ".join(w), bad))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic")


def test_toxicity_holds_out(spark):
    docs, labels = toxic_table(spark)
    model = train_toxicity(docs, labels)
    got = score_toxicity(docs, model).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert 400 < len(held) < 800 and (held.predicted == held.toxic).mean() >= 0.99
    assert ((got.score >= 0) & (got.score <= 1)).all()
    # Labels of held-out rows play no part.
    flipped = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    other = train_toxicity(docs, flipped)
    assert (other.buckets == model.buckets).all() and other.weights == pytest.approx(model.weights)


def test_toxicity_learns_from_a_stated_sample(spark):
    docs, labels = toxic_table(spark, 1500)
    twice = docs.unionByName(docs.withColumn("text", F.lit("another text of the id")))
    one = train_toxicity(twice, labels, sample=500)
    two = train_toxicity(twice.repartition(7), labels.repartition(3), sample=500)
    assert (one.buckets == two.buckets).all() and (one.weights == two.weights).all()
    assert len(train_toxicity(docs, labels, sample_bytes=0).buckets) == 0


def test_toxicity_is_counterfactually_fair():
    # Feature 7 (a term) goes with the label; its counterfactual is feature 9.
    rng = np.random.default_rng(0)
    toxic = (rng.random(2000) < 0.3).astype(float)
    own = [np.array([1] * int(t and rng.random() < 0.7) + ([7] if rng.random() < 0.2 + 0.6 * t else []), dtype=np.int32) for t in toxic]
    gone = [x[x == 7] for x in own]
    come = [np.full(len(g), 9, dtype=np.int32) for g in gone]
    weight = lambda m, f: float(m.weights[m.buckets == f].sum())
    plain, fair = fit(own, gone, come, toxic, fair=0.0), fit(own, gone, come, toxic, fair=20.0)
    assert weight(plain, 7) > 1.5 and abs(weight(fair, 7) - weight(fair, 9)) < 0.3 * weight(plain, 7)


def test_toxicity_edges(spark):
    assert swap_terms("a gay man, menace") == "a lesbian woman, menace"
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (2, "x" * 10_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = train_toxicity(docs, labels)
    got = score_toxicity(docs, model).collect()
    assert len(got) == 4 and all(r.score == 0 and r.predicted == 0 for r in got)
    wide = docs.withColumn("lowered", F.lit(1)).withColumn("Score_", F.lit("x"))
    kept = drop_toxic(wide, model)
    assert kept.count() == 4 and kept.columns == wide.columns and {r.score for r in kept.collect()} == {"clash"}
    one = spark.createDataFrame([(1, 1), (1, 0), (2, None)], "doc_id long, toxic int")
    assert all(0 < r.score < 1 for r in score_toxicity(docs, train_toxicity(docs, one)).collect())
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_topk_block_equals_sorting():
    rng = np.random.default_rng(3)
    for n, k in ((1, 5), (5, 5), (400, 5), (400, 1)):
        v, q = rng.integers(-3, 4, (32, n)).astype(float), rng.integers(-3, 4, (9, 32)).astype(float)
        ids, own = rng.permutation(n), np.arange(9)
        row, found, score = search_block(q, own, v, ids, k, step=4)
        for i in range(9):
            want = sorted(((-float(q[i] @ v[:, c]), int(ids[c])) for c in range(n) if ids[c] != own[i]))[:k]
            assert [(-s, int(f)) for s, f in zip(score[row == i], found[row == i], strict=True)] == want


def test_topk(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=24).tolist()) for i in range(300)] + [(300, None), (350, [float("nan")] * 24), (301, rng.normal(size=8).tolist()), (50, rng.normal(size=24).tolist()), (302, [None] * 24), (None, rng.normal(size=24).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("rank", F.lit("x"))
    got = {}
    for r in exact_topk(df, F.col("vec_id") % 50 == 0, candidate_block=64, query_block=3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows[:300]] + [(50, np.floor(256 * np.array(rows[303][1])))]
    for q in (0, 100, 150, 200, 250):
        v = dict(good[:300])[q]
        want = sorted((-int(v @ w), i) for i, w in good if i != q)[:5]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert set(got) == {0, 50, 100, 150, 200, 250} and len(got[50]) == 10
    assert exact_topk(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([len(rest), *(rest.index(c) for c in "/?#" if c in rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([len(path), *(path.index(c) for c in "?#" if c in path)])]
    fit = [(h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, *best


def test_urls(spark):
    urls = [None, "", "nothing", "http://", "://x.org/", "HTTP://A.Example.ORG/es/x?y", "https://example.org/en/12#a", "https://example.org/en/2", "http://notexample.org/es/", "http://org/", "http://x.com/fr/", "http://x.com/de/?u=http://y.org/", "ftp://x.com?q=/de/", "http://b.com/dé/", "http://xcom/de/", "http://org?x", "http://ÄB.org/x", "a://b://c.org/", "http://example.org/es", "http://.com/de/\nz", "http://" + "s." * 2000 + "org/" + "p" * 5000]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(urls)] + [(0, urls[5])], "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(0))
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in filter_urls(df).collect() if not (r.page_id == 0 and r.host))
    assert got == [(k, *judged(u)) for k, u in enumerate(urls)]
    assert filter_urls(df.limit(0)).count() == 0
    assert {r.verdict for r in filter_urls(df, rules=()).collect()} == {"allow"}
    assert not any(w in filter_urls(df)._jdf.queryExecution().executedPlan().toString() for w in ("Python", "Pandas", "Arrow"))


def test_long_rule_lists(spark, monkeypatch):
    """Lists beyond the bound are joined: the same verdicts."""
    from sievewright.llm import url_filter

    hosts = [f"{a}{b}.org" for a in "abcdefgh" for b in range(40)]
    urls = [f"http://{w}{h}/{p}/x" for h in hosts[::3] for p in ("es", "fr") for w in ("", "www.")]
    rules = [(h, f"/{p}/", "block" if k % 2 else "allow") for k, h in enumerate(hosts[::2]) for p in ("es", "de")] + [("org", "/", "allow")]
    df = spark.createDataFrame([(k % 50, u) for k, u in enumerate(urls)], "page_id long, url string")
    plain = sorted(map(str, filter_urls(df, rules).collect()))
    assert len({r.verdict for r in filter_urls(df, rules).collect()}) == 2
    monkeypatch.setattr(url_filter, "MOST_BITS", 128)
    assert sorted(map(str, filter_urls(df, rules).collect())) == plain


def test_cascade_is_exact(spark):
    universe = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 97 = 0")
    cascade = build_cascade(listed, universe.unionByName(universe))
    assert len(cascade.levels) >= 2
    wrong = universe.withColumn("found", cascade.contains(F.col("key"))).join(listed.withColumn("there", F.lit(True)), "key", "left").where("found <> coalesce(there, false)")
    assert wrong.count() == 0
    assert build_cascade(listed.limit(0), universe).levels == ()


def test_pipeline(spark):
    """Every stage against brute force over what the stage before it kept."""
    import corpus_pipeline
    from test_dedup import brute, exact_runs, similar
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    kept, at = [df], df
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = corpus_pipeline.kit.stored(stage(spark, at, sf), "test-stage")
        kept.append(at)
        if k < 4:
            assert at.columns == df.columns and at.schema.simpleString() == df.schema.simpleString()
    raw, clean, single, cut, mixed = ([r.asDict() for r in x.orderBy("doc_id").collect()] for x in kept[:5])

    model = train_toxicity(df, spark.read.parquet(f"{sf}/labels.parquet"))
    told = {r.doc_id: r.predicted for r in score_toxicity(df, model).collect()}
    assert clean == [r for r in raw if not told[r["doc_id"]]]

    groups = brute([(r["doc_id"], r["text"]) for r in clean], similar)
    assert single == [r for r in clean if groups[r["doc_id"]][0] == r["doc_id"]]

    found, words = exact_runs([(r["doc_id"], r["text"]) for r in single])
    after = {r["doc_id"]: r for r in cut}
    for r in single:
        mine = words[r["doc_id"]]
        left = (after[r["doc_id"]]["text"] if r["doc_id"] in after else "").split()
        if not found[r["doc_id"]]:
            assert len(left) == len(mine) or len(mine) - len(left) >= 50  # near passages may go too
        else:
            assert len(left) <= len(mine) - len(found[r["doc_id"]])
    assert not exact_runs([(r["doc_id"], r["text"]) for r in cut])[0]

    sizes, taken = {}, {}
    for rows, to in ((cut, sizes), (mixed, taken)):
        for r in rows:
            to[r["source"]] = to.get(r["source"], 0) + len(r["text"].split())
    names = sorted(sizes)
    targets = fill_targets([sizes[n] for n in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5 * sum(sizes.values()), 2)
    longest = max(len(r["text"].split()) for r in cut)
    assert all(abs(taken.get(n, 0) - t) <= longest for n, t in zip(names, targets, strict=True))
    assert {r["doc_id"] for r in mixed} <= set(after) and all(r == after[r["doc_id"]] for r in mixed)

    library = Tokenizer.from_file(corpus_pipeline.tokenizer_file())
    want = sorted((r["doc_id"], len(library.encode(r["text"], add_special_tokens=False).ids)) for r in mixed)
    assert sorted((r.doc_id, r.n_tokens) for r in at.collect()) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, at.collect()))


def test_topk_of_large_components(spark):
    """Components whose products leave the integers of doubles, and some whose scores leave longs."""
    rng = np.random.default_rng(11)
    x = rng.normal(size=(60, 4)) * np.where(np.arange(60)[:, None] % 7 == 0, 1e6, 1.0)
    x[13] *= 1e12
    x[50] = [1e6 + 0.1, -3e5, 7e5, 1e5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(70, [1e300, 1e300, 0.0, 0.0]), (71, [-1e308, 0.0, 0.0, 0.0])]
    whole = lambda v: [int(c) * 256 if abs(c) >= 2**60 else int(np.floor(256 * c)) for c in v]
    ints = {i: whole(v) for i, v in rows}
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = {}
    for q in (0, 50):
        scores = sorted((-clip(sum(a * b for a, b in zip(ints[q], c, strict=True))), i) for i, c in ints.items() if i != q)[:5]
        want |= {(q, rank): (i, -s) for rank, (s, i) in enumerate(scores, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for block in (4096, 16):
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in exact_topk(df, F.col("vec_id") % 50 == 0, candidate_block=block, query_block=1).collect()}
        assert got == want
