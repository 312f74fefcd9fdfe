"""The queries of this subpackage, their SQL, and where the vocabularies are."""

from __future__ import annotations

import os

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.llm import bpe_automaton, chat_tree, decontaminate, feistel, fertility, jaccard_join, pii_boost, secret_cnn, trie_counts, url_rules

WORD_BPE = os.environ.get("NOTELAKE_WORD_BPE", public_tokenizers.path("word_bpe_49k.json"))
PIECES = os.environ.get("NOTELAKE_PIECES", public_tokenizers.path("piece_bpe_32k.model"))
#: A conversation that contains the template's own control strings.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], turns.schema)
    stream, ends = chat_tree.format_chats(turns.unionByName(own))
    read = chat_tree.read_back(stream)
    return ends.join(read, "leaf").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", trie_counts.token_counts(docs, PIECES).alias("c")).select("doc_id", "c.n_pretokens", "c.n_tokens")


def op3_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    q = docs.select("doc_id", fertility.quality(docs, PIECES).alias("q"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "token_entropy"]
    return q.select("doc_id", *[F.col(f"q.{n}") for n in names])


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    return url_rules.judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", bpe_automaton.bpe_digests(docs, WORD_BPE).alias("b")).select("doc_id", "b.n_tokens", "b.ids_sha256", "b.decoded_sha256")


def op6_secret_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", secret_cnn.secret_spans(docs).alias("s")).select("doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", "s.spans")


def op7_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    text = F.col("text")
    own = docs.select("doc_id", feistel.text_size(text).alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    out = feistel.shard(own, ["doc_id", "text_crc32", "size"], 40)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    p = pii_boost.personal_data(docs)
    counts = [F.size(F.col(f"pii.{k}")).cast("long").alias(f"n_{k}") for k in pii_boost.BASE]
    return p.select("doc_id", *counts, F.sha2(pii_boost.span_text(), 256).alias("base_sha256"), pii_boost.span_text(more=True).alias("spans"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_join.jaccard_join(docs).withColumnRenamed("id", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = _table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark")
    judged = decontaminate.judged(docs, items).select("row.doc_id", F.col("contamination").alias("d"))
    return judged.select("doc_id", "d.n_words", "d.n_hit", F.size("d.items").cast("long").alias("n_items"), F.sha2(F.array_join("d.items", ","), 256).alias("items_sha256"), (F.col("d.n_hit") > 0).alias("contaminated"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_chat_tree, op2_token_counts, op3_fertility, op4_url_rules, op5_bpe_automaton, op6_secret_cnn, op7_feistel, op8_pii_boost, op9_jaccard_join, op10_decontaminate)}


def oracle_sql() -> dict[str, str]:
    from notelake.llm import oracles

    return oracles.oracle_sql()
