"""Many spans in a text, overlapping spans, columns named like the operators' own."""

import re
import time

from pyspark.sql import functions as F

from ledgerlens.llm import pii, secrets


def test_texts_with_very_many_spans(spark):
    n = 60_000
    text = " ".join(f"user{i}@example{i % 7}.com é" for i in range(n))
    few = " ".join(f"a{i}@b.co 10.0.0.{i % 300}" for i in range(700))
    tokens = " ".join(f"token=abcdef{i} x" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, few), (3, tokens)], "doc_id long, text string")
    t0 = time.time()
    found = {r["doc_id"]: r["pii_spans"] for r in pii.scan(df).collect()}
    for i, t in ((1, text), (2, few)):
        plain = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        assert [(s["start"], s["end"]) for s in found[i] if s["kind"] == "email"] == plain
    left = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert left[1] == " ".join(["[EMAIL] é"] * n)
    assert left[2] == " ".join(f"[EMAIL] {'[IP]' if i % 300 < 256 else '10.0.0.%d' % (i % 300)}" for i in range(700))
    hits = [s for r in secrets.scan(df.where("doc_id = 3")).collect() for s in r["secret_spans"] if s["kind"] == "assign"]
    assert [(s["start"], s["end"]) for s in hits] == [m.span() for m in re.finditer("token=[a-z0-9]+", tokens)]
    assert time.time() - t0 < 120


def test_overlapping_spans_are_covered_once(spark):
    text = "call +1 (22) 333-4444 4111 1111 1111 1111 x" + " +49 4111 1111 1111 1111 a@b.co" * 400
    df = spark.createDataFrame([(1, text, 9)], "doc_id long, text string, n_chars long")
    spans = sorted((s["start"], s["rank"], s["end"], s["kind"]) for s in pii.scan(df).first()["pii_spans"])
    out, pos = "", 0
    for start, _, end, kind in spans:
        if start >= pos:
            out += text[pos:start] + f"[{kind.upper()}]"
        pos = max(pos, end)
    out += text[pos:]
    r = pii.redact(df).first()
    assert len(spans) >= 800 and r["text"] == out and r["n_chars"] == len(out)


def test_input_columns_of_any_name_pass_through(spark):
    names = ["kinds", "_text", "_key", "row", "_email", "_iban", "_new", "new", "changed", "text_", "found", "n_chars"]
    base = spark.createDataFrame([(1, "mail a@b.co token=abcdefg"), (2, None), (3, "")], "doc_id long, text string")
    df = base.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names if n != "n_chars"], F.lit(5).alias("n_chars"))
    for out, own in ((secrets.scan(df), "secret_spans"), (pii.scan(df), "pii_spans"), (pii.redact(df), None)):
        assert out.columns == df.columns + ([own] if own else [])
        for r in out.collect():
            assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n != "n_chars")
    again = secrets.scan(secrets.scan(df))                        # a former result is replaced
    assert again.columns.count("secret_spans") == 1 and again.where("size(secret_spans) = 1").count() == 1
    assert pii.scan(pii.scan(df)).columns.count("pii_spans") == 1
