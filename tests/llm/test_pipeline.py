"""The pipeline stage by stage, and the registration of its queries."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from caseweave.llm import minhash, pii, queries
from caseweave.llm.common import store

SF = "/root/testdata/sf0.001"


def test_each_operator_is_registered_once():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, store(stage(spark, docs, SF))
        sizes.append(docs.count())
        if name != "packing":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "near_duplicates":
            assert minhash.near_duplicates(docs).where("not kept").count() == 0
        if name == "personal_data":
            assert docs.where(F.size(pii.spans(F.col("text"))) > 0).count() == 0
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert corpus_pipeline.run(spark, SF).count() == sizes[4]


WIDE = "doc_id long, text string, lang string, source string, `a.b` string, row int, tie string, key string, part int, component_id long, n_chars int"


def odd_documents(spark, tmp_path, rows, schema=WIDE):
    from caseweave.llm.common import prepared

    path = str(tmp_path / "docs.parquet")
    prepared(spark).createDataFrame(rows, schema).repartition(2).write.parquet(path)
    return spark.read.parquet(path)


def test_stages_on_odd_rows(spark, tmp_path):
    long_text = "some plain words that repeat a little, mail me at jo@example.org. " * 3000
    texts = [None, None, "", "", long_text, long_text, "call +49 170 1234567 now", "short", "<|endoftext|> x", " \n "]
    extra = lambda i: ("en", "s", f"v{i}", 7, "t", "k", 3, 9, 5)
    rows = [(i if i != 7 else None, t, *extra(i)) for i, t in enumerate(texts)] + [(4, long_text, *extra(4))]
    docs = odd_documents(spark, tmp_path, rows)
    sf = "/root/testdata/sf0.001"
    kept = corpus_pipeline.reject_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    one_each = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert one_each.columns == docs.columns
    left = [r["text"] for r in one_each.collect()]
    assert left.count(long_text) == 1 and {"short", "call +49 170 1234567 now", "<|endoftext|> x"} <= set(left)
    clean = corpus_pipeline.replace_personal_data(spark, docs, sf)
    assert clean.columns == docs.columns and clean.count() == len(rows)
    got = {r["a.b"]: r for r in clean.collect()}
    assert got["v0"]["text"] is None and got["v0"]["n_chars"] == 5 and got["v2"]["n_chars"] == 0
    assert "jo@example.org" not in got["v4"]["text"] and got["v4"]["n_chars"] == len(got["v4"]["text"]) and "1234567" not in got["v6"]["text"]
    without = corpus_pipeline.replace_personal_data(spark, docs.drop("n_chars"), sf)
    assert without.columns == docs.drop("n_chars").columns
    pieces = corpus_pipeline.pack(spark, docs, sf).collect()
    assert sum(r["opens"] for r in pieces) == sum(r["closes"] for r in pieces) == len(rows)


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = odd_documents(spark, tmp_path, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, "/root/testdata/sf0.001").count() == 0
