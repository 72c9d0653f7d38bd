"""Delivering batches of documents."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import groupby

from pyarrow import fs
from pyspark.sql import DataFrame, Row

from docloom.sources.documents import read_contents, read_file
from docloom.storage import open_store


def by_batch(batches: DataFrame, order: list[str], by: list[str] | None = None) -> DataFrame:
    """Bring each batch together, in order. Range partitioning keeps a batch whole and neighbours close."""
    key = [*(by or []), "batch"]
    return batches.repartitionByRange(*key).sortWithinPartitions(*key, *order)


def write_documents(batches: DataFrame, path: str, order: list[str], by: list[str] | None = None) -> None:
    """Write batches as Parquet, each whole within one file and rows in order.

    The batch number stays a sorted column, so a reader skips to a batch by file
    and row group statistics. A folder per batch would mean millions of folders.
    """
    by_batch(batches, order, by).write.parquet(path)


def deliver(
    batches: DataFrame, send: Callable[[int, list], None], order: list[str], by: list[str] | None = None, full: str | None = None
) -> None:
    """Call `send(batch, rows)` on the executors, once per batch and attempt.

    With `full`, the column that has each document's path, its bytes are read in
    the task that sends the batch and added to the row as `content`; slim rows are
    all that is shuffled.

    A lost executor means a repeated attempt, so `send` must be idempotent, as an
    insert by URI is. A batch is at most the batch size; nothing else is held.
    """
    key = [*(by or []), "batch"]

    def partition(rows: Iterable) -> None:
        for batch, members in groupby(rows, key=lambda r: tuple(r[k] for k in key)):
            rows_ = [Row(**r.asDict(), content=read_file(r[full])) for r in members] if full else list(members)
            send(batch[-1] if len(batch) == 1 else batch, rows_)

    by_batch(batches, order, by).foreachPartition(partition)


def attach_content(batches: DataFrame, full: str = "full") -> DataFrame:
    """Contents of batched rows, read late: each by its path, where its batch has been brought together."""
    return read_contents(batches, full)


def write_file(path: str, content: bytes) -> None:
    """Write one file whole, and its folders where they are missing; an earlier version is replaced."""
    store, at = open_store(path)
    if isinstance(store, fs.LocalFileSystem):
        store.create_dir(at.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(at) as out:
        out.write(content or b"")


def write_files(files: DataFrame, full: str = "full", content: str = "content") -> None:
    """Write a file per row, each in the task that has the row."""

    def partition(rows: Iterable) -> None:
        for row in rows:
            write_file(row[full], row[content])

    files.foreachPartition(partition)
