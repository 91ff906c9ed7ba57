"""The pipeline's stages against brute force, and the queries that SQL cannot express."""

from __future__ import annotations

import re

from brute import contaminated, jaccard, order
from pyspark.sql import functions as F

import __spark_entry__ as registered
import corpus_pipeline
from tallyfold.llm import decontaminate

NAMES = [n for n in registered.queries() if re.match(r"op\d+_", n)]


def test_all_operators_and_the_pipeline_are_registered():
    assert [int(n[2:].split("_")[0]) for n in NAMES] == list(range(1, 14)) and "pipeline" in registered.queries()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "sharding"]


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    before = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, before, sf_dir)
        rows, left = before.collect(), after.collect()
        if k < 4:
            assert after.columns == docs.columns and {tuple(r) for r in left} <= {tuple(r) for r in rows} and len(left) == len({r.doc_id for r in left})
        if k == 1:
            least = {c for _, n, c in jaccard([(r.doc_id, r.text) for r in rows])}
            assert {r.doc_id for r in left} == least
        if k == 2:
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            found = contaminated([r.text for r in rows], items, set(decontaminate.UNITS))
            gone = {rows[k].doc_id for (k, _), (_, tokens, _) in found.items() if tokens >= corpus_pipeline.LEAST_COPIED}
            assert gone and {r.doc_id for r in rows} - {r.doc_id for r in left} == gone
            held = lambda t: any(" ".join(b.split()) in " ".join((t or "").split()) for b in benchmark)
            assert not any(held(r.text) for r in left) and len(rows) - len(left) <= 0.1 * len(rows)
        if k == 4:
            assert len(left) == len(rows) and {r.doc_id for r in left} == {r.doc_id for r in rows}
        before = spark.createDataFrame(left, after.schema) if left else after


def test_awkward_rows_pass_all_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "src0", 0), (-2, None, "en", None, 0), (-3, "same text here", "en", "src1", 1), (-3, "same text here", "en", "src1", 1)], docs.schema)
    before = docs.unionByName(odd).withColumn("crc", F.lit("x")).withColumn("tokens", F.lit(1))
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, sf_dir)
        rows = after.collect()
        before = spark.createDataFrame(rows, after.schema)
    assert len(rows) > 0 and sum(r.doc_id == -3 for r in rows) <= 1


def test_empty_documents_give_no_shards(spark, sf_dir):
    before = spark.read.parquet(f"{sf_dir}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        before = stage(spark, before, sf_dir)
    assert before.count() == 0


def test_pseudonyms_and_contamination_cover_all_documents(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = registered.queries()["op3_pii"](spark, sf_dir).collect()
    assert {r.doc_id for r in out} == set(docs)
    for r in out:
        assert (r.text == docs[r.doc_id]) == (r.n_found == 0)
        for found in re.findall(r"[\w.]+@[\w.]+\w|(?<!\d)\d{16}(?!\d)|\+1 \(\d{3}\) \d{3}-\d{4}", docs[r.doc_id] or ""):
            assert found not in r.text
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    found = {(r.doc_id, r.item_id) for r in registered.queries()["op7_decontaminate"](spark, sf_dir).collect()}
    whole = {(d, i) for d, t in docs.items() for i, b in bench.items() if " ".join(b.split()) in " ".join((t or "").split())}
    assert whole <= found
    windows = {w for b in bench.values() for w in zip(*(b.lower().split()[k:] for k in range(10)))}
    for d, _ in found:  # whoever is named shares ten words in a row, but for case and marks
        words = [re.sub(r"[^\w]", "", w) for w in (docs[d] or "").lower().split()]
        bare = {tuple(re.sub(r"[^\w]", "", x) for x in w) for w in windows}
        assert any(tuple(words[k : k + 10]) in bare for k in range(len(words)))


def test_order_helper():
    assert order([(None, 1), (2, 0)]) == [(2, 0), (None, 1)]
