"""What the fitted operators share: labelled samples and words as numbered buckets."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import name
from docloom.storage import cut, cut_observed

# Labelled rows that a model is fitted on at most, those with the least hashes of their ids.
SAMPLE_ROWS = 16_000
# Words remembered per Python worker: a bound of memory, not of the result.
CACHE_WORDS = 150_000


def remainder(id_column: Column, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(id_column.cast("string").cast("binary")) % of


def labelled_texts(
    docs: DataFrame, labels: DataFrame, id_column: str, text: str, label: str, allowed: Column, bound: int = SAMPLE_ROWS
) -> DataFrame:
    """Written rows (`id`, `text`, `label` 0 or 1): at most `bound`, of documents with an `allowed` label.

    Several labels of one id count by their mean, at least a half being 1; of several
    rows of one id, the one whose text has the least hash. The sample is bounded, so it may be broadcast to the
    documents. Null ids and null labels are left out, null texts are empty.
    """
    ident = name(id_column).cast("long")
    known = labels.filter(allowed & name(label).isNotNull() & ident.isNotNull())
    mean = known.groupBy(ident.alias("s_id")).agg(F.avg(name(label)).alias("mean"))
    rows = mean.select("s_id", (F.col("mean") >= 0.5).cast("int").alias("label"))
    chosen = cut(rows.orderBy(F.xxhash64("s_id"), "s_id").limit(bound), "labels")
    texts = docs.select(ident.alias("id"), F.coalesce(name(text).cast("string"), F.lit("")).alias("text"))
    of = texts.join(F.broadcast(chosen), F.col("id") == F.col("s_id")).withColumn("hash", F.xxhash64("text"))
    # combined on the map side: an id that many rows have sends a hash and a count per task and text
    least = of.groupBy("id", "hash").agg(F.count(F.lit(1)).alias("times")).groupBy("id").agg(F.min(F.struct("hash", "times")).alias("least"))
    one, seen = cut_observed(
        least.select(F.col("id").alias("o_id"), F.col("least.hash").alias("o_hash"), "least.times"), "labelled", F.max("times").alias("most")
    )
    first = of.join(F.broadcast(one), (F.col("id") == F.col("o_id")) & (F.col("hash") == F.col("o_hash"))).select("id", "text", "label")
    # texts are moved only where equal rows of one id are to become one
    return cut(first.dropDuplicates(["id"]) if (seen["most"] or 0) > 1 else first, "labelled")


class Words(dict):
    """A number per token, made by `number` where not known."""

    def __init__(self, number):
        self.number = number

    def __missing__(self, token: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[token] = self.number(token)
        return found

    def ids(self, text: str) -> np.ndarray:
        tokens = text.split()
        return np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))


def bucket(word: str, buckets: int) -> int:
    return zlib.crc32(word.encode()) % buckets
