import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
# Columns that operators use inside, or return.
CLASHES = ["ids", "score", "fingerprint", "shard", "block", "blob", "row", "id", "text_hash", "hashes", "repeats", "key", "part", "place"]


@pytest.fixture(scope="session")
def documents(spark):
    """A documents table from (doc_id, text) pairs; with `clash`, also columns whose names operators use."""

    def make(pairs, clash=False):
        df = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs], DOCUMENTS)
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
        return df

    return make


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long and repeated texts."""
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "a"), (5, "word " * 60_000), (6, "x" * 200_000), (7, "same text here"),
        (8, "same text here"), (8, "same text here"), (None, "no id"), (None, None), (9, "é😀 <|endoftext|> ‮\u0000end"),
    ]
