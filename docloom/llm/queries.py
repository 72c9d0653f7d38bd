"""One query per training-data operator, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from docloom.llm import (
    bpe,
    chat,
    decontaminate,
    filter_audit,
    labels,
    line_dedup,
    oracle,
    quality,
    resharding,
    secret_scan,
    simhash,
    suffix_dedup,
    toxicity,
    whitening,
    winnowing,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pipeline": corpus_pipeline.run}
SQL: dict[str, str] = {
    "op5_decontamination": oracle.DECONTAMINATION,
    "op6_chat": oracle.CHAT,
    "op8_secrets": oracle.SECRETS,
    "op12_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}

OLD_SHARDS, NEW_SHARDS, SHARD_BLOCKS = 6, 8, 4096


def _query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


def _table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


@_query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    coded = bpe.encode(docs, corpus_pipeline.tokenizer(), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", *[c.alias(n) for n, c in bpe.digests(coded).items()])


@_query
def op2_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    apart = F.coalesce(labels.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    network = quality.fit(docs, _table(spark, folder, "labels"), ~apart)
    scored = quality.score(docs, network, keep=["doc_id"])
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


@_query
def op3_winnowing(spark: SparkSession, folder: str) -> DataFrame:
    return winnowing.with_next(_table(spark, folder, "documents"))


@_query
def op4_resharding(spark: SparkSession, folder: str) -> DataFrame:
    """From six shards, dealt by text, to eight of equal bytes; equal texts stay together, unless they are too many."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    by = resharding.group_key(docs, text, size, F.col("doc_id"))
    old = F.pmod(F.hash(*by), F.lit(OLD_SHARDS))
    planned = resharding.plan(docs, old, size, NEW_SHARDS, by, SHARD_BLOCKS)
    moved = resharding.reshard(docs, planned, old, by, SHARD_BLOCKS)
    placed = moved.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "shard", "block")
    return resharding.with_slots(placed, order=["doc_id", "text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


@_query
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document and benchmark item that overlap; documents without overlap have none."""
    return decontaminate.overlaps(_table(spark, folder, "documents"), _table(spark, folder, "benchmark")).drop("text_hash")


@_query
def op6_chat(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["conv_id", "turn", "role", "text"]
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame(
        pa.table({"conv_id": [-7, -7], "turn": [0, 1], "role": ["user", "assistant"], "text": [said, said]})
    )
    turns = _table(spark, folder, "conversations").select(*columns).union(extra)
    return chat.read_back(chat.format_chats(turns))


@_query
def op7_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, folder, "documents"))


@_query
def op8_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secret_scan.scan_versions(_table(spark, folder, "documents"))
    joined = F.array_join(F.transform("found", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(rule.kind) for rule in secret_scan.RULES]
    return found.select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


@_query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    clean = line_dedup.dedup_lines(docs, count="n_removed")
    return clean.select("doc_id", "n_removed", F.char_length("text").alias("n_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query
def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    apart = F.coalesce(labels.remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = toxicity.fit(docs, _table(spark, folder, "labels"), ~apart)
    scored = toxicity.score(docs, model, passages="passages", keep=["doc_id"])
    return scored.select(
        "doc_id", apart.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("passages").alias("n_passages"),
    )


@_query
def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """One row per embedding and component, from the first on."""
    white = whitening.whiten(_table(spark, folder, "embeddings").select("vec_id", "embedding"))
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "of")
    return white.select("vec_id", "n", "deviation", "identity_error", each).select(
        "vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error"
    )


@_query
def op12_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    clean = suffix_dedup.dedup_substrings(_table(spark, folder, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["stop"] - s["start"])
    return clean.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


@_query
def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
