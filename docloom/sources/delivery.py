"""Delivery of batches with commit messages and a ledger, so that a second run sends only what is missing.

The sink is a Spark data source: each task sends its batches, one after the other, and
answers with how many documents and bytes each had; the driver adds these up when all tasks are done. What was sent is
noted in the ledger's folder by the task itself, every few batches and when it ends, in failure as well: a run that
is killed loses the notes of a few batches at most, which are sent again. So `send` must be idempotent, as an insert by URI is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from docloom.sources.documents import read_file
from docloom.sources.sinks import by_batch, write_file

# Batches that a task sends between two notes.
NOTE_EVERY = 20
LEDGER = "run string, source string, batch long, documents long, bytes long"


@dataclass
class Sent(WriterCommitMessage):
    """What one task has sent."""

    batches: int
    documents: int
    bytes: int


class DeliveryWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], send: Callable[[object, list[Row]], None]):
        self.ledger, self.run, self.send = options["path"], options["run"], send
        self.by, self.full = json.loads(options["by"]), json.loads(options["full"])

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Sent:
        key = [*self.by, "batch"]
        rows = (Row(**r) for batch in iterator for r in batch.to_pylist())
        notes: list[dict] = []
        total = Sent(0, 0, 0)
        try:
            for of, members in groupby(rows, key=lambda r: tuple(r[k] for k in key)):
                own = [Row(**r.asDict(), content=read_file(r[self.full])) for r in members] if self.full else list(members)
                self.send(of if self.by else of[0], own)
                size = sum(len(r.content) for r in own) if self.full else sum(_size(v) for r in own for v in r)
                notes.append({"run": self.run, "source": _set(of[:-1]), "batch": of[-1], "documents": len(own), "bytes": size})
                total = Sent(total.batches + 1, total.documents + len(own), total.bytes + size)
                if len(notes) >= NOTE_EVERY:
                    self._note(notes)
                    notes = []
        finally:
            if notes:
                self._note(notes)
        return total

    def _note(self, notes: list[dict]) -> None:
        at = TaskContext.get()
        task = f"{at.partitionId()}-{at.attemptNumber()}" if at else "0-0"
        lines = "\n".join(json.dumps(n) for n in notes)
        write_file(f"{self.ledger}/sent/{self.run}-{task}-{uuid.uuid4().hex}.json", lines.encode())

    def _result(self, messages: list[Sent | None], complete: bool) -> None:
        told = [m for m in messages if m is not None]
        totals = {"batches": sum(m.batches for m in told), "documents": sum(m.documents for m in told), "bytes": sum(m.bytes for m in told)}
        write_file(f"{self.ledger}/runs/{self.run}.json", json.dumps({"run": self.run, "complete": complete, **totals}).encode())

    def commit(self, messages: list[Sent | None]) -> None:
        self._result(messages, True)

    def abort(self, messages: list[Sent | None]) -> None:
        self._result(messages, False)


def _size(value: object) -> int:
    return len(value.encode()) if isinstance(value, str) else len(value) if isinstance(value, bytes) else 0


def _set(values: tuple) -> str:
    """The values of a source set as the ledger has them: a JSON list of texts."""
    return json.dumps([None if v is None else str(v) for v in values], separators=(",", ":"), ensure_ascii=False)


def _source(send: Callable[[object, list[Row]], None]) -> type[DataSource]:
    class DeliverySource(DataSource):
        @classmethod
        def name(cls) -> str:
            return "docdelivery"

        def writer(self, schema, overwrite: bool) -> DeliveryWriter:
            return DeliveryWriter(dict(self.options), send)

    return DeliverySource


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """Batches sent, each once: `source` (values of the set it is of, as JSON), `batch`, `documents`, `mb`, `run`. None before the first run."""
    write_file(f"{path}/sent/.keep", b"")
    notes = spark.read.schema(LEDGER).option("pathGlobFilter", "*.json").json(f"{path}/sent")
    last = notes.groupBy("source", "batch").agg(F.max(F.struct("documents", "bytes", "run")).alias("n"))
    return last.select("source", "batch", "n.documents", F.round(F.col("n.bytes") / F.lit(1024 * 1024), 3).alias("mb"), "n.run")


def deliver_missing(
    batches: DataFrame, send: Callable[[object, list[Row]], None], path: str, order: list[str], by: list[str] | None = None, full: str | None = None
) -> dict:
    """Send the batches that the ledger at `path` does not have yet; returns the run's totals: batches, documents, bytes.

    `send(batch, rows)` is called on the executors, once per batch and attempt (with `by`, `batch` is a tuple of the set's
    values and the number). With `full`, contents are read in the task that sends and added as `content`. Bytes are those of contents,
    or else of all texts of the rows. A batch is missing unless one of its number, in its set, was sent: number batches alike in all runs.
    """
    spark = batches.sparkSession
    by = list(by or [])
    done = ledger(spark, path).select(F.col("source").alias("__source"), F.col("batch").alias("__batch"))
    mine = F.to_json(F.array(*[F.col(c).cast("string") for c in by])) if by else F.lit("[]")
    left = batches.withColumn("__mine", mine).join(done, (F.col("__mine") == F.col("__source")) & (F.col("batch") == F.col("__batch")), "left_anti")
    run = uuid.uuid4().hex
    spark.dataSource.register(_source(send))
    writer = by_batch(left.drop("__mine"), order, by).write.format("docdelivery").mode("append")
    writer.options(run=run, by=json.dumps(by), full=json.dumps(full)).save(path)
    return json.loads(read_file(f"{path}/runs/{run}.json"))
