"""Rules, scores, fusion, evaluation and state on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievewright.functions import scores
from sievewright.operators import evaluate, fusion, ingest, rules, samples, state, vectors
from sievewright.operators.rules import KeywordRule, RuleSet, SenderRule, StructuralRule, SubjectRule

ATTEMPT = "doc_id int, rule_status string, rule_label string, rule_conf double, vec_status string, vec_label string, vec_conf double, llm_status string, llm_label string, llm_conf double, llm_review boolean"


def mail(spark, *rows):
    return spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "doc_id int, sender string, subject string, body string, has_attachments boolean")


def test_conflicts(spark):
    # Confidence decides, then kind, then order.
    rs = RuleSet(
        (SenderRule("a.com", "s", 0.8, "x+$"), SenderRule("b.com", "t", 0.9)),
        (SubjectRule("hello", "u", 0.8), SubjectRule("HELL", "v", 0.8)),
        (KeywordRule(("straße", "k"), "w", 0.9, True), KeywordRule(("zz",), "y", 0.7)),
        (StructuralRule("body_length >= 3 and has_attachments", "z", 0.8),),
    )
    df = mail(spark, ("<xx@A.com>", "Re: Hello", "abc", True), ("<xy@a.com>", "hello", "ab", False), ("q@b.com", "", "STRASSE K", False), ("q@c.com", "", "", True))
    got = {r.doc_id: r for r in rules.match_rules(df, rs).collect()}
    assert [(m.label) for m in got[0].matches] == ["s", "u", "v", "z"] and got[0].selected.label == "z" and got[0].conflict_logged
    assert got[1].selected.label == "u"
    assert {m.label for m in got[2].matches} == {"t", "w"} and got[2].selected.label == "t"
    assert got[3].selected is None and not got[3].conflict_logged


@pytest.mark.parametrize(
    ("condition", "holds"),
    [
        ("n > 2", True),
        ("n >= 4", False),
        ("flag", True),
        ("missing", False),
        ("missing == 0", True),
        ("n < 2 or flag AND n != 4", True),
        ("n ~ 3", False),
        ("", False),
        ("2 < n", True),
    ],
)
def test_conditions(spark, condition, holds):
    df = spark.range(1).select(F.lit(3).alias("n"), F.lit(1).alias("flag"))
    assert df.select(rules.compile_condition(condition, {"n": F.col("n"), "flag": F.col("flag")})).first()[0] == holds


@pytest.mark.parametrize(("raw", "value"), [(0.96, 0.975), (0.95, 0.975), (0.94, 0.87), (0.8, 0.87), (0.79, 0.7), (0.6, 0.7), (0.59, 0.3), (0.0, 0.3), (-0.5, 0.3), (1.5, 0.975)])
def test_calibration(spark, raw, value):
    assert spark.range(1).select(scores.calibrated(F.lit(raw))).first()[0] == value


def test_wilson(spark):
    df = spark.createDataFrame([(1, 2), (0, 0), (100, 100)], "h long, n long")
    low, high = scores.wilson(F.col("h"), F.col("n"))
    got = df.select(low.alias("a"), high.alias("b")).collect()
    assert got[0].a == pytest.approx(0.09453120573423074) and got[0].b == pytest.approx(0.9054687942657693)
    assert got[1].a is None and got[2].b == pytest.approx(1.0)


@pytest.mark.parametrize(
    ("row", "strategy", "label", "review"),
    [
        (("success", "a", 0.9, "success", "b", 0.99, "success", "c", 0.9, False), "rule_only", "a", False),
        (("success", "a", 0.7, "success", "a", 0.85, "success", "c", 0.9, False), "rule_vector_confirmed", "a", False),
        (("success", "a", 0.69, "success", "a", 0.85, "success", "c", 0.9, False), "vector_only", "a", False),
        (("success", "a", 0.1, "success", "b", 0.99, "success", "c", 0.9, False), "all_low_review", "c", True),
        (("no_match", None, 0.0, "no_match", None, 0.0, "success", "c", 0.7, False), "llm_fallback", "c", False),
        (("no_match", None, 0.0, "no_match", None, 0.0, "success", "c", 0.69, False), "all_low_review", "c", True),
        (("no_match", None, 0.0, "no_match", None, 0.0, "success", None, 0.0, False), "all_low_review", None, True),
        (("success", "a", 0.5, "success", "b", 0.5, "failed", None, 0.0, False), "all_low_review", "a", True),
        (("no_match", None, 0.0, "failed", None, 0.0, "failed", None, 0.0, False), "all_low_review", None, True),
    ],
)
def test_fusion(spark, row, strategy, label, review):
    got = fusion.fuse(spark.createDataFrame([(1, *row)], ATTEMPT)).first()
    assert (got.strategy, got.fused_label, got.needs_review) == (strategy, label, review)


def test_cascade(spark):
    rows = [
        (1, "success", "a", 0.5, "success", "b", 0.9, "success", "c", 0.9, False),
        (2, "success", "a", 0.5, "no_match", None, 0.0, "success", "c", 0.9, True),
        (3, "no_match", None, 0.0, "no_match", None, 0.0, "failed", None, 0.0, False),
    ]
    got = {r.doc_id: (r.selected_source, r.selected_label, r.fallback, r.needs_human_review) for r in fusion.cascade(spark.createDataFrame(rows, ATTEMPT), {"rule": 0.9, "vec": 0.85, "llm": 0.8}).collect()}
    assert got == {1: ("vec", "b", True, False), 2: ("llm", "c", True, True), 3: (None, None, True, True)}


def test_evaluation_example(spark):
    gold = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "b"), (3, "t3", "a"), (4, "t4", "c")], "sample_id long, thread_id string, labels string").withColumn("split", F.lit("test"))
    preds = spark.createDataFrame([(1, "a", False), (2, "a", False), (3, "a", True)], "sample_id long, labels string, needs_human_review boolean").withColumn("strategy", F.lit("x"))
    pairs = evaluate.test_pairs(gold, preds)
    m, s = evaluate.micro(pairs).first(), evaluate.summary(pairs).first()
    assert (m.tp, m.fp, m.fn, m.precision, m.recall) == (1, 1, 3, 0.5, 0.25)
    assert (s.coverage, s.review_rate, s.suggestion_recall, s.missing) == (0.5, 0.25, 0.5, 1)
    assert evaluate.release_gate(pairs).first().status == "ineligible"
    assert [r.sample_id for r in evaluate.mismatches(pairs).collect()] == [2]


@pytest.mark.parametrize(("hits", "threshold", "status"), [(99, 0.99, "failed"), (100, 0.95, "passed"), (100, 0.98, "failed")])
def test_gate(spark, hits, threshold, status):
    gold = spark.range(100).select(F.col("id").alias("sample_id"), F.lit("t").alias("thread_id"), F.lit("noise").alias("labels"), F.lit("test").alias("split"))
    preds = spark.range(100).select(F.col("id").alias("sample_id"), F.when(F.col("id") < hits, "noise").otherwise("other").alias("labels"), F.lit(False).alias("needs_human_review"), F.lit("x").alias("strategy"))
    gate = evaluate.Gate(overall_precision=None, label_precision=None, overrides={"noise": threshold}, minimum_eligible=90)
    assert evaluate.release_gate(evaluate.test_pairs(gold, preds), gate).first().status == status


def test_neighbours(spark):
    def row(i, label, v, **more):
        base = {"label_l2": None, "schema_version": "flat-v1", "disposition": "accepted", "reviewed": True} | more
        return (i, label, base["label_l2"], v, base["schema_version"], base["disposition"], base["reviewed"])

    schema = "id long, label_l1 string, label_l2 string, embedding array<double>, schema_version string, disposition string, reviewed boolean"
    lib = spark.createDataFrame(
        [row(1, "a", [1.0, 0.0]), row(2, "a", [0.9, 0.1]), row(3, "a", [2.0, 0.1]), row(4, "b", [0.8, 0.3]), row(5, "c", [0.0, 1.0]), row(6, "a", [1.0, 0.0], reviewed=False), row(7, "a", [0.0, 0.0]), row(8, "a", [1.0])],
        schema,
    )
    asked = spark.createDataFrame([(10, [3.0, 0.0]), (11, None), (12, [0.0, -1.0])], "query_id long, embedding array<double>")
    got = vectors.knn_search(asked, lib, threshold=0.9).collect()
    assert [(r.query_id, r.label, r.support, r.rank) for r in sorted(got)] == [(10, "a", 3, 1), (10, "b", 1, 2)]
    assert vectors.neighbours(asked, lib, limit=1, threshold=0.0).where("query_id = 10").first().id == 1
    scoped = vectors.scoped_search(asked, lib, scope=["c"], threshold=0.9).collect()
    assert {r.scoped_fallback for r in scoped} == {True}
    tried = {r.query_id: (r.status, r.reason) for r in vectors.vector_attempts(asked, vectors.knn_search(asked, lib, threshold=0.9), ["b"], minimum_support=2).collect()}
    assert tried == {10: ("no_match", "stale_category"), 11: ("unavailable", "embedding_unavailable"), 12: ("no_match", "below_threshold")}


def test_archive_boundary(spark):
    day = 86_400
    df = spark.createDataFrame([(1, 0), (2, 1), (3, -1)], "id int, created_s long")
    got = {r.id: r.archived for r in samples.archive_split(df, 360 * day).collect()}
    assert got == {1: False, 2: False, 3: True}


def test_state(spark):
    runs = spark.createDataFrame([(1, "pending"), (2, "completed"), (3, "failed")], "run_id int, status string")
    asks = spark.createDataFrame([(1, "processing"), (2, "pending"), (3, "pending")], "run_id int, target string")
    assert {r.run_id: (r.won, r.status) for r in state.transition(runs, asks).collect()} == {1: (True, "processing"), 2: (False, "completed"), 3: (True, "pending")}
    acts = state.apply_policy(spark.createDataFrame([("pay",), ("mail",), ("note",)], "action_type string"), ["pay"], ["mail"])
    assert [(r.risk, r.action_status) for r in acts.collect()] == [("high", "blocked"), ("high", "proposed"), ("low", "proposed")]
    assert [r.action_status for r in state.decide_actions(acts, False).collect()] == ["rejected"] * 3
    box = spark.createDataFrame([(1, 5, None, 0, None)], "run_id int, created_at int, dispatched_at int, attempts int, last_error string")
    events = spark.createDataFrame([(1, False, "x" * 5000, 6), (1, True, None, 7)], "run_id int, ok boolean, error string, at int")
    got = state.fold_outbox(box, events).first()
    assert (got.dispatched_at, got.attempts, len(got.last_error)) == (7, 1, 4000)


def test_ingest(spark):
    seen = spark.createDataFrame([("m", "k1", 1, "s1")], "mailbox_id string, dedup_key string, uid long, server_id string")
    new = spark.createDataFrame([("m", "k1", 2, "s1"), ("m", "k2", 3, "s2"), ("m", "k2", 4, "s3"), ("n", "k1", 5, None)], seen.schema)
    assert sorted((r.mailbox_id, r.dedup_key, r.uid) for r in ingest.new_claims(new, seen).collect()) == [("m", "k2", 3), ("n", "k1", 5)]
    assert [r.uid for r in ingest.unseen(new, seen, 1).collect()] == [3]
    cursors = spark.createDataFrame([("m", 7, 3)], "mailbox_id string, uidvalidity long, high_water_uid long")
    listing = new.withColumn("uidvalidity", F.lit(7).cast("long"))
    assert sorted(r.uid for r in ingest.after_cursor(listing, cursors, 10).collect()) == [4, 5]
    reset = new.withColumn("uidvalidity", F.lit(8).cast("long"))
    assert sorted(r.uid for r in ingest.after_cursor(reset, cursors, 10).collect()) == [2, 3, 4, 5]


def test_mining(spark):
    rows = [("a.com", "x")] * 9 + [("a.com", "y")] + [("b.com", "x")] * 5 + [("c.com", "x")] * 5 + [("d.com", "z")] * 6
    df = spark.createDataFrame(rows, "sender_domain string, label_l1 string")
    got = {(r.sender_domain, r.label): round(r.confidence, 3) for r in samples.proposals(samples.distribution(df)).collect()}
    assert got == {("a.com", "x"): 0.9, ("b.com", "x"): 1.0, ("c.com", "x"): 1.0, ("d.com", "z"): 0.9}
