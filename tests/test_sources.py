"""Sources, assets, plugins, reports, jobs and streams."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from email.message import EmailMessage

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievewright.operators import clustering, model_output, samples, state
from sievewright.plans import jobs, registry, reports, settings, verticals
from sievewright.sources import assets, eml, gateway
from sievewright.storage import fresh_path
from sievewright.streaming import ledger


def message(**headers):
    m = EmailMessage()
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    return m


def test_eml(spark, tmp_path):
    plain = message(From="A <a@x.org>", To=" b@y.org, , c@z.org", Subject="Grüße", Date="Mon, 01 Jan 2024 10:00:00 +0200", Message_ID="<ID@X>")
    plain.set_content("first\n")
    plain.add_alternative("<html>second</html>", subtype="html")
    plain.add_attachment(b"12345", maintype="application", subtype="pdf", filename="a.pdf")
    (tmp_path / "a.eml").write_bytes(plain.as_bytes())
    rich = message(From="a@x.org", Subject="s", Date="whenever")
    rich.set_content("<p>only</p>", subtype="html")
    (tmp_path / "b.eml").write_bytes(rich.as_bytes())
    (tmp_path / "c.txt").write_bytes(b"no mail")
    moment = datetime(2020, 2, 3, tzinfo=UTC)
    a, b = eml.parse_eml(eml.read_eml(spark, f"file://{tmp_path}"), as_of=moment).orderBy("path").collect()
    assert (a.message_id, a.dedup_key, a.subject, a.body.strip(), list(a.recipients)) == ("<ID@X>", "<id@x>", "Grüße", "first", ["b@y.org", "c@z.org"])
    assert [tuple(m) for m in a.attachment_meta] == [("a.pdf", "application/pdf", 5)] and list(a.attachments) == ["a.pdf"]
    assert a.received_at == datetime(2024, 1, 1, 8) and not a.date_missing
    assert b.body.strip() == "<p>only</p>" and b.date_missing and len(b.dedup_key) == 64 and b.message_id == b.dedup_key


def test_assets(tmp_path, spark):
    files = {
        "sender_domains.yaml": "- {domain: ' X.org ', label: a}",
        "subject_patterns.yaml": "- {pattern: hi, label: b, confidence: 0.5}",
        "body_keywords.yaml": "[]",
        "structural.yaml": "- {condition: body_length < 5, label: a}",
        "taxonomy.yaml": "nodes: [{code: a, label: A}, {code: b, label: B, exclusive: true}]",
        "profiles.yaml": "profiles: [{label: a, vector_scope: [a, b]}]",
        "policy.yaml": "{version: v2, latest_max_chars: 5, signature_delimiters: ['--']}",
        "vertical.yaml": "assets: {taxonomy: taxonomy.yaml, rules: ., profiles: profiles.yaml, policy: policy.yaml}",
    }
    for name, content in files.items():
        (tmp_path / name).write_text(content)
    rules = assets.load_rules(tmp_path)
    assert rules.senders[0].domain == "x.org" and rules.senders[0].confidence == 0.95 and rules.labels() == {"a", "b"}
    assert [n.exclusive for n in assets.load_taxonomy(tmp_path / "taxonomy.yaml")] == [False, True]
    assert assets.load_policy(tmp_path / "policy.yaml").signature_delimiters == ("--",)
    assert all(ok for _, ok, _ in verticals.validate_vertical(tmp_path)) and verticals.findings(spark, tmp_path).count() == 5
    snapshot = assets.Snapshot(lambda: assets.load_rules(tmp_path), [tmp_path / "structural.yaml"], every=0)
    (tmp_path / "structural.yaml").write_text("- {condition: x, label: a, weight: 1}")
    assert snapshot.get() == rules and "weight" in snapshot.error
    (tmp_path / "structural.yaml").write_text("- {condition: x, label: zzz}")
    assert snapshot.get() != rules and snapshot.error is None
    assert [n for n, ok, _ in verticals.validate_vertical(tmp_path) if not ok] == ["rules"]
    (tmp_path / "vertical.yaml").write_text("assets: {taxonomy: ../taxonomy.yaml}")
    with pytest.raises(assets.AssetError):
        assets.load_vertical(tmp_path)
    with pytest.raises(assets.AssetError):
        assets.load_profiles(tmp_path / "profiles.yaml", ["a"])
    assert assets.digest_assets([("b", "2"), ("a", "1")]) == assets.digest_assets([("a", "1"), ("b", "2")])
    with pytest.raises(assets.AssetError):
        assets.digest_assets([("a", "1"), ("a", "2")])


def test_predictions(spark, tmp_path):
    row = {"sample_id": "1", "labels": ["a"], "needs_human_review": False, "versions": {"taxonomy": "v", "model": None}}
    for content, ok in (([row], True), ({"predictions": [row]}, True), ({"predictions": [row], "more": 1}, False), ([row, row], False)):
        (tmp_path / "p.json").write_text(json.dumps(content))
        if ok:
            got = assets.load_predictions(spark, f"file://{tmp_path}/p.json").first()
            assert got.versions == {"taxonomy": "v"}
        else:
            with pytest.raises(assets.AssetError):
                assets.load_predictions(spark, f"file://{tmp_path}/p.json")


class Mailbox:
    """A mailbox of seven messages."""

    uidvalidity = 3

    def __init__(self, size="7"):
        self.size = int(size)

    def highest_uid(self):
        return self.size

    def fetch(self, after, upto):
        for uid in range(after + 1, upto + 1):
            yield uid, None, b"Subject: %d\n\nbody" % uid


def test_mailbox_reader():
    reader = gateway.MailboxReader({"client": f"{__name__}:Mailbox", "client.size": "7", "batch_size": "5", "initial": "backfill"})
    start = reader.initialOffset()
    reader.commit(start)
    seen = []
    for _ in range(3):
        end = reader.latestOffset()
        for part in reader.partitions(start, end):
            seen += [r[1] for r in reader.read(part)]
        reader.commit(end)
        start = end
    assert seen == [1, 2, 3, 4, 5, 6, 7] and gateway.MailboxReader({"client": f"{__name__}:Mailbox"}).initialOffset() == {"uid": 7, "validity": 3}


def test_mailbox_whose_validity_changes():
    """Uids that begin anew lie below the cursor and are read all the same, a batch at a time."""
    reader = gateway.MailboxReader({"client": f"{__name__}:Mailbox", "client.size": "3", "batch_size": "2"})
    reader.commit({"uid": 900, "validity": 0})
    at, seen = {"uid": 900, "validity": 0}, []
    for _ in range(3):
        end = reader.latestOffset()
        for part in reader.partitions(at, end):
            seen.append([r[1] for r in reader.read(part)])
        at = end
    assert seen == [[1, 2], [3]]
    back = gateway.MailboxReader({"client": f"{__name__}:Mailbox", "client.size": "7", "batch_size": "5", "initial": "backfill", "backfill_messages": "3"})
    assert back.initialOffset() == {"uid": 4, "validity": 3} and back.latestOffset() == {"uid": 7, "validity": 3}
    fresh = gateway.MailboxReader({"client": f"{__name__}:Mailbox", "batch_size": "3"})  # after a restart
    end = fresh.latestOffset()
    assert [[r[1] for r in fresh.read(p)] for p in fresh.partitions({"uid": 2, "validity": 3}, end)] == [[3, 4, 5], [6, 7]]


def test_two_queries_share_a_ledger(spark, tmp_path):
    """Each has a checkpoint of its own, so their batch ids are the same; no claim is lost or made twice."""
    schema = "mailbox_id string, dedup_key string, uid long"
    where = fresh_path(spark, "t-ledger")
    for name, keys in (("one", "abc"), ("two", "bd")):
        spark.createDataFrame([("m", k, n) for n, k in enumerate(keys)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/{name}")
        stream = ledger.event_stream(spark, f"file://{tmp_path}/{name}", spark.createDataFrame([], schema).schema)
        ledger.run_available(stream, where, fresh_path(spark, f"t-offsets-{name}"))
    assert sorted(r.dedup_key for r in ledger.read_ledger(spark, where).collect()) == ["a", "b", "c", "d"]
    again = ledger.append_claims(where, "three")
    for _ in range(2):  # a batch that runs again changes nothing
        again(spark.createDataFrame([("m", "a", 9), ("m", "e", 9)], schema), 0)
    assert sorted(r.dedup_key for r in ledger.read_ledger(spark, where).collect()) == ["a", "b", "c", "d", "e"]


def test_ledger_stream(spark, tmp_path):
    rows = [("m", "k1", 1), ("m", "k1", 2), ("m", "k2", 3), ("n", "k1", 4)]
    schema = "mailbox_id string, dedup_key string, uid long"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    stream = lambda: ledger.event_stream(spark, f"file://{tmp_path}/in", spark.createDataFrame([], schema).schema)
    where, offsets = fresh_path(spark, "t-ledger"), fresh_path(spark, "t-offsets")
    ledger.run_available(stream(), where, offsets)
    spark.createDataFrame([("m", "k2", 5), ("m", "k3", 6)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/in", mode="append")
    ledger.run_available(stream(), where, offsets)
    assert sorted((r.mailbox_id, r.dedup_key) for r in ledger.read_ledger(spark, where).collect()) == [("m", "k1"), ("m", "k2"), ("m", "k3"), ("n", "k1")]


def test_clusters():
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(3, 12))
    x = np.concatenate([c + rng.normal(size=(20, 12)) * 0.05 for c in centres] + [rng.normal(size=(8, 12))])
    labels = clustering.hdbscan(x)
    groups = [labels[20 * k : 20 * k + 20] for k in range(3)]
    assert all((g == g[0]).mean() > 0.9 and g[0] >= 0 for g in groups) and len({int(g[0]) for g in groups}) == 3
    assert (labels[60:] == -1).mean() > 0.5
    assert (clustering.hdbscan(x[:3]) == -1).all()


def test_reports(tmp_path):
    text = reports.proposals_markdown([{"sender_domain": "a.com", "label": "x", "confidence": 0.876, "n": 7, "total": 8}, {"sender_domain": "b.com", "label": "y", "confidence": 1.0, "n": 5, "total": 5}])
    assert reports.checked_rules(text) == []
    chosen = reports.checked_rules(text.replace("- [ ] a.com", "- [x] a.com"))
    assert chosen == [{"domain": "a.com", "label": "x", "confidence": 0.88}]
    assert reports.append_rules(tmp_path / "r.yaml", chosen * 2) == 1 and reports.append_rules(tmp_path / "r.yaml", chosen) == 0
    with pytest.raises(ValueError, match="one block"):
        reports.checked_rules("- [x] a\n\nno rule")
    assert (reports.ratio(None), reports.ratio(0.5), reports.percent(0.123)) == ("N/A", "0.500000", "12.3%")
    (tmp_path / "r1.json").write_text("{}")
    (tmp_path / "r2.json").write_text('{"a": 1}')
    assert reports.read_report(reports.latest_report(tmp_path)) == {"a": 1}


def test_settings(tmp_path):
    (tmp_path / "s.yaml").write_text("{top_k: 7, similarity_threshold: 0.5, mailboxes: [{mailbox_id: a}]}")
    s = settings.load_settings(tmp_path / "s.yaml", env={"SIEVEWRIGHT_TOP_K": "9", "SIEVEWRIGHT_AUTO_ACCEPT": "true"})
    assert (s.top_k, s.similarity_threshold, s.auto_accept, s.minimum_support) == (9, 0.5, True, 1)
    for bad in ("{mailboxes: [{mailbox_id: a}, {mailbox_id: a}]}", "{nonsense: 1}", "{similarity_threshold: 2}"):
        (tmp_path / "s.yaml").write_text(bad)
        with pytest.raises(ValueError):
            settings.load_settings(tmp_path / "s.yaml", env={})


def test_plugins(spark):
    r = registry.Registry()
    r.add(registry.Plugin("p", "ns"))
    with pytest.raises(ValueError):
        r.add(registry.Plugin("p", "ns"))
    with pytest.raises(ValueError):
        r.add(registry.Plugin("q", "ns", api_version=9))
    with pytest.raises(ValueError):
        r.select("p", "other")

    class Enricher:
        def __init__(self, id_, namespace, column):
            self.id, self.namespace, self.column = id_, namespace, column

        def patch(self, mails):
            return self.column

    one = F.create_map(F.lit("k"), F.lit("1"))
    two = F.when(F.col("doc_id") == 1, F.create_map(F.lit("k"), F.lit("2"), F.lit("l"), F.lit("3")))
    got = {x.doc_id: x for x in registry.enrich(spark.createDataFrame([(1, False), (2, False)], "doc_id int, needs_review boolean"), [Enricher("a", "ns", one), Enricher("b", "ns", two)]).collect()}
    assert got[1].data == {"ns": {"k": "2", "l": "3"}} and got[2].data == {"ns": {"k": "1"}}
    assert (list(got[1].enrichment_errors), list(got[2].enrichment_errors), got[1].needs_review, got[2].needs_review) == ([], ["b"], False, True)


def test_import_and_confirm(spark):
    mails = spark.createDataFrame([(1, "Hi", "a@x.org", "A body of some length", [""]), (2, "Hi", "a@x.org", "", [""]), (3, "Yo", "a@x.org", "A body of some length", [""])], "doc_id int, subject string, sender string, body string, attachments array<string>")
    mails = mails.withColumn("received_at", F.timestamp_seconds(F.col("doc_id")))
    attempts = spark.createDataFrame([(1, "success", "a", 0.95, "failed", None, 0.0), (2, "success", "a", 0.95, "failed", None, 0.0), (3, "no_match", None, 0.0, "success", "zzz", 0.9)], "doc_id int, rule_status string, rule_label string, rule_conf double, llm_status string, llm_label string, llm_conf double")
    kept, excluded = jobs.import_history(mails, ["a"], attempts)
    assert [r.doc_id for r in kept.collect()] == [1] and sorted(r.doc_id for r in excluded.collect()) == [2, 3]
    again, _ = jobs.import_history(mails, ["a"], attempts, existing=kept)
    assert again.count() == 0
    assert jobs.confirm(kept, "tier1").first().reviewed
    with pytest.raises(ValueError):
        jobs.confirm(kept, "tier2")
    with pytest.raises(ValueError):
        jobs.confirm(kept, "tier3", every=True)
    done = jobs.review(kept, spark.createDataFrame([(1, "edit", "b", None)], "doc_id int, action string, label string, override string")).first()
    assert (done.label_l1, done.sample_source, done.reviewed) == ("b", "human_fix", True)


def test_classification_calls_the_model_last(spark):
    mails = spark.createDataFrame(
        [(1, "x <a@noreply.github.com>", "Out of Office", "please approve this long enough body"), (2, "x <a@b.org>", "hello", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (3, "x <a@b.org>", "hello", "nothing like it at all here, and long enough not to be short")],
        "doc_id long, sender string, subject string, body string",
    ).withColumns({"attachments": F.array(F.lit("")), "has_attachments": F.lit(False)})
    embed = jobs.hashing_embedder()
    library = spark.createDataFrame([(10, "b", "Subject: hello\nLatest message:\nalpha beta gamma delta epsilon zeta eta theta iota kappa lambda")], "id long, label_l1 string, t string").select(
        "id", "label_l1", F.lit(None).cast("string").alias("label_l2"), embed(F.col("t")).alias("embedding"), F.lit("flat-v1").alias("schema_version"), F.lit("accepted").alias("disposition"), F.lit(True).alias("reviewed")
    )
    asked = []

    def model(rest):
        asked.extend(r.doc_id for r in rest.select("doc_id").collect())
        return rest.select("doc_id", F.lit("success").alias("llm_status"), F.lit("m").alias("llm_label"), F.lit(0.8).alias("llm_conf"), F.lit(False).alias("llm_review"))

    got = {r.doc_id: (r.strategy, r.fused_label) for r in jobs.classify(mails, library, ["b"], model=model).collect()}
    assert got[2] == ("vector_only", "b") and got[3] == ("llm_fallback", "m") and 2 not in asked and 3 in asked


def test_answers(spark):
    good = {"labels": [{"l1_code": "a", "confidence": 0.5}], "meta": {"urgency": "low", "sentiment": "neutral", "needs_human_review": True, "language": "en"}}
    wrap = lambda x: json.dumps({"choices": [{"message": {"tool_calls": [{"function": {"arguments": x}}]}}]})
    rows = [("ok", wrap(json.dumps(good))), ("envelope", "{}"), ("envelope", "nonsense"), ("envelope", None), ("arguments", wrap("nonsense")), ("schema", wrap("{}")), ("label", wrap(json.dumps(good | {"labels": [{"l1_code": "a", "confidence": 2}]}))), ("meta", wrap(json.dumps(good | {"meta": {"urgency": "x", "sentiment": "neutral", "needs_human_review": True}})))]
    got = model_output.parse_answers(spark.createDataFrame(rows, "want string, response string")).collect()
    assert [(r.want, r.error or "ok") for r in got] == [(w, w) for w, _ in rows]
    vectors = spark.createDataFrame([("[[1, 2], [3]]",), (" [1.5]",), ('{"data": [{"embedding": [4]}]}',), ("{}",), ("[]",), ("x",)], "r string")
    assert [r[0] for r in vectors.select(model_output.parse_embedding(F.col("r"))).collect()] == [[1.0, 2.0], [1.5], [4.0], None, None, None]


def test_identity_and_insert(spark):
    names = spark.createDataFrame([(" Ａnn ",), ("a​b",), ("",), (None,), ("x" * 256,)], "n string")
    assert [r[0] for r in names.select(state.reviewer_identity("n")).collect()] == ["Ann", None, None, None, None]
    schema = "id int, mail_hash string, fingerprint string, schema_version string, disposition string, label_l2 string"
    old = spark.createDataFrame([(1, "h1", "f1", "flat-v1", "accepted", None)], schema)
    new = spark.createDataFrame([(2, "h1", "f2", "flat-v1", "accepted", None), (3, "h3", "f1", "flat-v1", "accepted", None), (4, "h4", "f4", "flat-v1", "warned", None), (5, "h5", "f5", "flat-v1", "accepted", None), (6, "h5", "f6", "flat-v1", "accepted", None), (7, "h7", None, "legacy-v3", None, "x")], schema)
    library, refused = samples.insert(new, old)
    assert sorted(r.id for r in library.collect()) == [1, 5, 7]
    assert {r.id: r.admission_reason for r in refused.collect()} == {2: "duplicate_mail_hash", 3: "duplicate_fingerprint", 4: "not_accepted_flat", 6: "duplicate_mail_hash"}
