"""From raw documents to shards: good ones, one of each near-duplicate group, none with benchmark
questions, mixed to target weights, dealt into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm import decontaminate, jaccard, mixing, quality, sharding
from tallyfold.llm.queries import MIX_LEVELS, MIX_SEED, SHARDS, trained, with_domain
from tallyfold.llm.tables import matching, read_table, store

LEAST_COPIED = 8  # tokens, as in the operator's ``least`` for items with other slots
MIX_SHARE = 0.9  # of the tokens that are left; no document is repeated


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.  Null and empty texts get the model's bias."""
    return quality.keep_good(docs, trained(spark, docs, sf_dir))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more on five-word shingles, the one with the
    smallest id stays.  Documents without words stay; equal rows (id and text) become one."""
    groups = jaccard.jaccard_groups(docs, percent=80, n=5)
    kept = store(groups.where("kept").groupBy("doc_id", "crc").count(), "pipeline-kept")
    repeated = kept.where("count > 1")
    if repeated.isEmpty():
        return matching(docs, kept, "left_semi")
    once = matching(docs, kept.where("count = 1"), "left_semi")
    return once.unionByName(matching(docs, repeated, "left_semi").dropDuplicates(["doc_id", "text"]))


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``LEAST_COPIED`` tokens or more of a benchmark item go.  Shorter finds, such as items of one
    word, are reported beside them, in the table "pipeline-contamination" of the shared folder, and remove nothing."""
    found = store(decontaminate.find_contamination(docs, read_table(spark, sf_dir, "benchmark")), "pipeline-contamination")
    return matching(docs, found.where(F.col("n_tokens") >= LEAST_COPIED), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn for the target weights stay; the one at the end of a leaf's budget stays whole."""
    drawn = mixing.mix(with_domain(docs), MIX_LEVELS, MIX_SHARE, max_epochs=1, seed=MIX_SEED)
    return matching(docs, drawn, "left_semi")


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot and grown_shard of each document that is left."""
    return sharding.shard_records(docs, [1.0] * SHARDS, grown_weight=1.0)


STAGES = [
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", uncontaminated),
    ("mixing to target weights", mixed),
    ("sharding", sharded),
]

# A trained classifier has no SQL: the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = store(stage(spark, docs, sf_dir), f"pipeline-{number}")
    return docs
