"""Recorded answers of models: envelopes parsed strictly, in built-ins, with a reason for each that fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The answer of a chat model that calls one tool.
ENVELOPE = "struct<choices:array<struct<message:struct<tool_calls:array<struct<function:struct<arguments:string>>>>>>>"
ARGUMENTS = "struct<labels:array<struct<l1_code:string,l2_code:string,l3_code:string,confidence:double,reasoning:string>>,meta:struct<urgency:string,language:string,sentiment:string,needs_human_review:boolean>>"
# What the tool's enumerations allow.
URGENCY, SENTIMENT = ("low", "medium", "high"), ("positive", "neutral", "negative")


def parse_answers(answers: DataFrame, column: str = "response") -> DataFrame:
    """answers with output (the tool's arguments) and error, one of them null.

    An answer is malformed if the envelope lacks the first call's arguments, if those are no JSON
    object, if labels or meta are missing, if a label has no code or a confidence outside 0 to 1, or if
    an enumeration has another value.
    """
    envelope = F.from_json(F.col(column), ENVELOPE)
    call = F.get(F.get(envelope["choices"], F.lit(0))["message"]["tool_calls"], F.lit(0))["function"]["arguments"]
    parsed = answers.withColumn("_arguments", call).withColumn("_out", F.from_json("_arguments", ARGUMENTS))
    out = F.col("_out")
    bad_label = F.exists(out["labels"], lambda x: x["l1_code"].isNull() | x["confidence"].isNull() | (x["confidence"] < 0) | (x["confidence"] > 1))
    meta = out["meta"]
    error = (
        F.when(F.col("_arguments").isNull(), "envelope")
        .when(F.try_parse_json("_arguments").isNull(), "arguments")
        .when(out["labels"].isNull() | meta.isNull(), "schema")
        .when(bad_label, "label")
        .when(~F.coalesce(meta["urgency"].isin(*URGENCY) & meta["sentiment"].isin(*SENTIMENT) & meta["needs_human_review"].isNotNull(), F.lit(False)), "meta")
    )
    return parsed.withColumn("error", error).withColumn("output", F.when(F.col("error").isNull(), out)).drop("_arguments", "_out")


def parse_embedding(response: Column) -> Column:
    """The first vector of an embedding service's answer: [[...]], [...] or {"data": [{"embedding": [...]}]}."""
    nested = F.from_json(response, "array<array<double>>")
    flat = F.from_json(response, "array<double>")
    named = F.from_json(response, "struct<data:array<struct<embedding:array<double>>>>")
    whole = lambda v: F.when(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull()), v)
    start = F.ltrim(response)
    return (
        F.when(start.rlike(r"^\[\s*\["), whole(F.get(nested, F.lit(0))))
        .when(start.startswith("["), whole(flat))
        .otherwise(whole(F.get(named["data"], F.lit(0))["embedding"]))
    )
