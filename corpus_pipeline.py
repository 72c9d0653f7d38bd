"""From raw documents to token ids: quality, line dedup, near-dedup, decontamination, encoding.

Each stage works on all that the stage before kept, which is written as Parquet in
the shared folder and read again. All but the last return the columns of `documents`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from docloom.storage import cut

TOKENIZER = "byte_bpe_50k.json"


def tokenizer() -> str:
    return public_tokenizers.path(TOKENIZER)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of all labelled documents.

    Null and empty texts get a score like any other; rows of null id are scored, but no sample; repeated rows have
    one score; other columns stay, whatever their names. Without labels all scores are a half, and all documents go.
    """
    network = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return quality.score(rows, network).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that stand in an earlier one; `n_chars` is that of the new text.

    Null texts stay null; repeated rows are cleaned alike; rows of null id come first in the order; other columns
    stay; an empty table gives an empty one.
    """
    clean = line_dedup.dedup_lines(docs)
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: SimHash over shingles of three words, linked at two bits or fewer.

    Null, empty and blank texts have fingerprint zero and are one group. The least id stays (null ids last), one
    row of it; other columns stay; an empty table gives an empty one.
    """
    return simhash.keep_one(docs, words=simhash.WORDS, radius=simhash.RADIUS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item.

    Null and empty texts overlap none; repeated rows stay or go together, those of null id by their
    text; other columns stay; without documents or items all come back as they are.
    """
    return decontaminate.without_overlaps(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document its token ids, and digests of these and of the text that they decode to.

    Null texts count as empty and have no tokens; ids may be null or repeated: each row gives one; other columns go.
    """
    coded = bpe.encode(docs, tokenizer(), decoded="decoded", keep=["doc_id"])
    return coded.select("doc_id", *[c.alias(n) for n, c in bpe.digests(coded).items()], "ids")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_stage),
    ("near_dedup", near_stage),
    ("decontamination", benchmark_stage),
    ("bpe", encode_stage),
]

# The classifier is a fitted network: SQL cannot express it. Tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
