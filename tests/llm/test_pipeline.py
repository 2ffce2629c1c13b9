"""The pipeline stage by stage, on a small table with planted cases."""

from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.common import read_table, shared_path
from tests.conftest import SF_SMALL


def test_stages_keep_their_promises(spark):
    base = read_table(spark, SF_SMALL, "documents")
    text = " ".join(f"the plain word number {i} of this text" for i in range(40))
    extra = spark.createDataFrame([
        (10 ** 6, text, "en", "s", 1), (10 ** 6 + 1, text + " end", "en", "s", 1), (10 ** 6 + 1, text + " end", "en", "s", 1),
        (10 ** 6 + 2, "mail a@b.example now please, the and of", None, None, None), (10 ** 6 + 3, None, None, None, None),
        (10 ** 6 + 4, "12 34 !!", None, None, None), (None, "text of the and is without any id", None, None, None)], base.schema)
    docs = base.union(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert out.columns == base.columns
        path = shared_path(spark, "test-stage")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen[name] = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else docs.collect()
    clean = {10 ** 6, 10 ** 6 + 1, 10 ** 6 + 2}
    assert clean <= set(seen["toxicity"]) and clean | {None} <= set(seen["language_id"])
    assert not {10 ** 6 + 3, 10 ** 6 + 4} & set(seen["language_id"])
    assert 10 ** 6 in seen["near_dedup"] and 10 ** 6 + 1 not in seen["near_dedup"] and None in seen["near_dedup"]
    assert seen["pii"][10 ** 6 + 2]["text"] == "mail [EMAIL] now please, the and of"
    assert {r["doc_id"] for r in seen["packing"]} == set(seen["pii"])


def test_run_on_an_empty_table(spark):
    path = shared_path(spark, "test-none")
    for t in ("documents", "labels"):
        read_table(spark, SF_SMALL, t).limit(0).write.parquet(f"{path}/{t}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_stages_return_input_values_under_any_name(spark):
    names = ["score", "predicted", "lang_pred", "kinds", "_text", "_new", "_email", "pii_spans", "kept"]
    base = read_table(spark, SF_SMALL, "documents").limit(120)
    docs = base.select("*", *[F.concat(F.lit(f"{n} "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, SF_SMALL)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} {r['doc_id']}" for r in rows for n in names), name
