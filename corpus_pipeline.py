"""A training-data pipeline of five operators of :mod:`notelake.llm`.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's ``docs``.

Defined cases: an empty table stays empty through all stages; null texts fail the
quality rules; rows with null or repeated doc_ids are judged one by one; further
columns, whatever their names, pass through all stages but the last.
"""

from __future__ import annotations

import uuid
from functools import reduce

from notelake.llm import entry
from notelake.llm.bpe_automaton import bpe_digests
from notelake.llm.common import checkpoint_dir, durable, remove, swept
from notelake.llm.decontaminate import decontaminate
from notelake.llm.fertility import quality
from notelake.llm.jaccard_join import components_of, node_column
from notelake.llm.secret_cnn import redact_secrets
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(own.alias("row"), quality(docs, entry.PIECES).alias("q")).where("q.kept").select("row.*")


#: Ids up to which a list of them is broadcast (8 bytes each); longer lists join by shuffle.
BROADCAST_IDS = 1_000_000


def _listed(ids: DataFrame) -> DataFrame:
    held = durable(ids)
    return F.broadcast(held) if held.count() <= BROADCAST_IDS else held


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays (null ids last).

    Rows are judged by their own texts: those that share a doc_id, or have none,
    stay or go each for itself.  Where several rows of a group have its smallest
    id, the smallest set's stays, then the smallest row in JSON.  Documents without
    words link with nothing and all stay.  Only rows whose doc_id is null or occurs
    more than once are cut into shingles again and moved.
    """
    rows, components = components_of(docs)
    named = rows.join(components.select("node", "root"), "node")
    best = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("b")).select("b.id", "b.node")
    best = _listed(best)
    twice = _listed(rows.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("id").alias("doc_id")))
    gone = _listed(rows.where("id is not null and node is not null").join(best, ["id", "node"], "left_anti").select(F.col("id").alias("doc_id")).distinct())
    once = docs.where("doc_id is not null").join(twice, "doc_id", "left_anti").join(gone, "doc_id", "left_anti")
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    shared = docs.where("doc_id is not null").join(twice, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")).select(own.alias("row"), node_column(F.col("text")).alias("node"))
    wordless = shared.where("node is null").select("row.*")
    first = shared.where("node is not null").groupBy(F.col("row.doc_id").alias("id"), "node").agg(F.min_by("row", F.to_json("row")).alias("row"))
    stay = first.alias("a").join(best.alias("b"), F.expr("a.id <=> b.id and a.node = b.node"), "left_semi").select("row.*")
    return reduce(DataFrame.unionByName, (once, wordless, stay)).select(docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to a mark; n_chars follows the text."""
    return redact_secrets(docs).withColumn("n_chars", F.length("text").cast("long"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return docs.select("doc_id", bpe_digests(docs, entry.WORD_BPE).alias("b")).select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")


STAGES = [("quality rules", quality_rules), ("near duplicates", near_duplicates), ("benchmark leaks", benchmark_leaks), ("secrets", secrets), ("token ids", token_ids)]
#: The fertility verdict, the network and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage's output but the last is removed once the next is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), ""
    for _, stage in STAGES:
        path = f"{checkpoint_dir(spark).rstrip('/')}/notelake-{uuid.uuid4().hex}"
        with swept(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
