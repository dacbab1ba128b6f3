"""Personal data in long texts, and its redaction against a plain one."""

from __future__ import annotations

import random
import time

from motionspark.llm import pii

KINDS = list(pii.PATTERNS)


def plainly(text: str, spans: list) -> str:
    out, at = [], 0
    for s in spans:
        if s["start"] >= at:
            out.append(text[at : s["start"]] + f"[{KINDS[s['rank']].upper()}]")
        at = max(at, s["end"])
    return "".join(out) + text[at:]


def test_redaction_against_a_plain_one(spark):
    rng = random.Random(2)
    parts = ["ann@example.org", "10.0.0.255", "+49 (30) 1234.5678", "+1.2.3.4.555.555", "4111 1111 1111 1111", "ssn 123-45-6789", "iban DE89370400440532013000", "é", "𝒳 ", " ", "\n", "word", "1.2.3.4@x.yz"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", ", "]) for _ in range(rng.randrange(60))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "'kept' AS pii_spans", "'k' AS _spans")
    spans = {r.doc_id: r.pii_spans for r in pii.find_spans(docs).collect()}
    out = pii.redact(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert all(r.pii_spans == "kept" and r["_spans"] == "k" for r in got)
    assert {r.doc_id: r.text for r in got} == {i: plainly(t, spans[i]) for i, t in enumerate(texts)}
    assert sum(len(x) for x in spans.values()) > 500
    assert [r.text for r in pii.redact(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).orderBy("doc_id").collect()] == [None, ""]


def test_context_words_count_across_earlier_matches(spark):
    text = "ssn 1.2.3.4 123-45-6789, " + "x" * 50 + " 123-45-6789 ssn of 123-45-6789"
    spans = pii.find_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().pii_spans
    assert [(s["start"], s["end"]) for s in spans if KINDS[s["rank"]] == "ssn"] == [(12, 23), (len(text) - 11, len(text))]


def test_many_matches_in_one_text_take_seconds(spark):
    n = 100_000
    docs = spark.createDataFrame([(1, "mail ü a.b@example.org, " * n)], "doc_id long, text string")
    began = time.time()
    assert pii.find_spans(docs).selectExpr("size(pii_spans)").first()[0] == n
    assert pii.redact(docs).selectExpr("length(text)").first()[0] == n * len("mail ü [EMAIL], ")
    assert time.time() - began < 60
    assert "Python" not in pii.redact(docs)._jdf.queryExecution().toString()
