"""Text functions on hand-made cases."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sievewright.functions import html, text
from sievewright.functions.text import CleaningPolicy
from sievewright.operators import retrieval


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("raw", "clean"),
    [
        ("Re[3]: Re: 回复: Status Report", "Status Report"),
        ("are: something", "are: something"),
        ("FWD:_fwd: x", "x"),
        ("【外部邮件】 [RE] Re_ y", "y"),
        ("FW: stays", "FW: stays"),
        ("a  b", "a b"),
        ("", ""),
    ],
)
def test_subject(spark, raw, clean):
    assert one(spark, text.clean_subject(F.col("s")), s=raw) == clean


@pytest.mark.parametrize(
    ("body", "parsed", "segments"),
    [
        ("plain\ntext ", False, ["plain\ntext"]),
        ("Latest reply\n> Original message", True, ["Latest reply", "Original message"]),
        ("new\n| piped\n| more\nbetween\n>> deep", True, ["new", "piped\nmore\nbetween", "deep"]),
        ("> only quoted", True, ["only quoted"]),
        ("hi\nOn Mon, A wrote:\n> old\nafter", True, ["hi", "On Mon, A wrote:\nold\nafter"]),
        ("hi\n______\nold", True, ["hi", "______\nold"]),
        ("hi\n发件人: a", True, ["hi", "发件人: a"]),
        ("<html>> x</html>", False, ["<html>> x</html>"]),
        ("", False, [""]),
    ],
)
def test_threads(spark, body, parsed, segments):
    got = one(spark, text.thread_segments(F.col("b")), b=body)
    assert (got.parsed, list(got.segments)) == (parsed, segments)


def test_sections(spark):
    policy = CleaningPolicy()
    body = "Hello\x07   there\r\n\r\npassword = hunter2, ok\nThis email may contain confidential information. No.\n  KIND REGARDS\nAnn"
    got = one(spark, text.clean_section(F.col("b"), policy), b=body)
    assert got.text == "Hello there\n[credential redacted], ok"
    assert list(got.flags) == ["signature_removed", "credential_redacted", "disclaimer_removed"]


def test_addresses(spark):
    s = F.col("s")
    df = spark.createDataFrame([("A <x@Sub.Example.com>",), ("y@b@C.org",), ("none",), ("<>",)], "s string")
    got = [tuple(r) for r in df.select(text.sender_domain(s), text.local_part(s), text.gateway_domain(s)).collect()]
    assert got == [("sub.example.com", "x", "sub.example.com>"), ("c.org", "y@b", "c.org"), ("", "", "none"), ("", "", "<>")]


def test_codes_and_labels(spark):
    df = spark.createDataFrame([("a", "a.b", "a.b.c"), ("x", None, "N/A"), ("-", "none", "")], "l1 string, l2 string, l3 string")
    assert [r.c for r in df.select(text.normal_codes(F.col("l1"), F.col("l2"), F.col("l3")).alias("c")).collect()] == [["a", "b", "c"], ["x"], []]
    labels = spark.createDataFrame([("a.b", "a.b"), ("a.b", "c.b"), ("a", "b")], "r string, l string")
    assert [r[0] for r in labels.select(text.labels_match(F.col("r"), F.col("l"))).collect()] == [True, True, False]


def test_html(spark):
    page = "<html><style>x{}</style><p>a &amp;lt; b</p><!-- no --><div>c<br/>d</div><script>if (1 < 2) {}</script></html>"
    df = spark.createDataFrame([(page,)], "h string")
    native, exact = df.select(html.html_to_text(F.col("h")), html.html_to_text_exact("h")).first()
    assert native == exact == "\na < b\n\nc\nd\n"
    assert html.read_html(None) is None


def test_documents(spark):
    rows = [
        (1, "Re: Hi", "See attached", ["a.pdf", " a.pdf ", ""], None),
        (2, "Hi", "please find the attached", [""], "attachment_dependent"),
        (3, "", "ok", [""], "insufficient_meaningful_content"),
        (4, "Topic", "A longer message\n> earlier question", [" b "], None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "doc_id int, subject string, body string, attachments array<string>")
    got = {r.doc_id: r for r in retrieval.retrieval_documents(df).collect()}
    assert {i: got[i].ineligible_reason for i in got} == {r[0]: r[4] for r in rows}
    assert got[1].retrieval_text == "Subject: Hi\nAttachments: a.pdf"
    assert got[4].retrieval_text == "Subject: Topic\nLatest message:\nA longer message\nContext:\nearlier question\nAttachments: b"
    assert list(got[4].flags) == ["quoted_history_removed", "attachments_listed"]


def test_truncation(spark):
    assert one(spark, text.truncate_body(F.col("b"), 10, 4), b="0123456789abc") == "012345\n[truncated]\n9abc"
    assert one(spark, text.truncate_body(F.col("b"), 13, 4), b="0123456789abc") == "0123456789abc"


def test_override(spark):
    base = retrieval.retrieval_documents(spark.createDataFrame([(1, "s", "some body text", [""]), (2, "s", "some body text", [""])], "doc_id int, subject string, body string, attachments array<string>"))
    got = {r.doc_id: r for r in retrieval.override_text(base.withColumn("override", F.when(F.col("doc_id") == 1, " mine "))).collect()}
    assert got[1].retrieval_text == "mine" and "reviewer_override" in got[1].flags and "reviewer_override" not in got[2].flags
