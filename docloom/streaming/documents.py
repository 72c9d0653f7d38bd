"""Documents that keep arriving.

Selection, URIs, routing, MIME types, collections and extraction hold no state,
so the functions in `operators` apply to a streaming DataFrame as they are. What
differs is delivery: positions are only defined within one arrival, so batches
are formed per micro-batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docloom.functions.paths import base_name
from docloom.operators.batching import BATCH_SIZE, batch_documents
from docloom.sources.documents import read_contents
from docloom.sources.sinks import by_batch
from docloom.storage import scratch


def watch_documents(spark: SparkSession, root: str, max_files: int | None = None) -> DataFrame:
    """New files below `root`, with the columns of `scan_documents`; contents are read when delivering.

    Spark's file stream keeps the list of files it has seen, and passes over names that begin with
    `.` or `_` as it does so. To load those as well, list the tree with `scan_documents`.
    """
    reader = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    folder = root.rstrip("/").split("://", 1)[-1].removeprefix("file:")
    files = reader.schema("path string, modificationTime timestamp, length long, content binary").load(root)
    relative = F.col("path").substr(F.instr("path", folder) + len(folder), F.length("path"))
    return files.select(
        F.lit(folder).alias("base"), relative.alias("path"), F.col("path").alias("full"),
        base_name(F.col("path")).alias("name"), "length",
    )


def write_batches(stream: DataFrame, path: str, order: list[str], n: int = BATCH_SIZE, full: str | None = None) -> DataStreamWriter:
    """Batch each arrival and write it to its own folder; with `full`, with the contents at those paths.

    Batching writes slim rows to the shared folder; they go when the arrival is written.
    The folder goes by the arrival's number and is overwritten when Spark repeats
    that arrival after a failure, so nothing is delivered twice.
    """

    def arrival(rows: DataFrame, number: int) -> None:
        with scratch():
            batches = by_batch(batch_documents(rows, order, n), order)
            batches = read_contents(batches, full) if full else batches
            batches.write.mode("overwrite").parquet(f"{path}/arrival={number}")

    return stream.writeStream.foreachBatch(arrival)
