"""Shared storage, small driver-side tables and the good/issue result pair."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

class Checked(NamedTuple):
    """Rows that passed, and one `issue` row per problem found."""

    good: DataFrame
    issue: DataFrame


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, as the session names it.

    Only a single-process session (tests) may fall back to a temporary folder: on
    a cluster that folder would exist on one machine and vanish with it.
    """
    context = spark.sparkContext
    alone = re.fullmatch(r"local(\[[^]]*\])?", context.master)
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not alone:
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="docloom-"))
        named = context.getCheckpointDir()
    return named.rstrip("/")


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def fresh_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/docloom/{name}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


@contextmanager
def scratch() -> Iterator[list[str]]:
    """Delete, at the end, what calls inside have written to the shared folder.

    Results of these calls are read from there, so write or collect them inside.
    Outside of such a block files stay, for a later clean-up of the whole folder.
    """
    made: list[str] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for path in made:
            store, at = open_store(path)
            if store.get_file_info(at).type == fs.FileType.Directory:
                store.delete_dir(at)


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return fs.LocalFileSystem(), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it back.

    The result has no lineage to replay when an executor is lost, and its size
    on disk is known, so later joins are planned on a real size.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_observed(df: DataFrame, path: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """Write and read back, with aggregates over the written rows at no extra pass."""
    seen = Observation()
    df.observe(seen, *metrics).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get


def cut_observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """`cut`, with aggregates over the written rows."""
    return write_observed(df, fresh_path(df.sparkSession, name), *metrics)


# Rows beyond which a written table is not sent whole to the driver and to every executor.
WIDE_ROWS = 100_000


def apart(df: DataFrame) -> DataFrame:
    """`df` for a join that shuffles it, whatever its files weigh.

    Regular rows are far smaller in a file than in memory, so that the planner would broadcast millions of them.
    """
    return df.hint("merge")


def dealt(df: DataFrame, *keys) -> DataFrame:
    """`df` before work that takes long per row, in as many parts as shuffles have.

    Neither the size of files nor that of a shuffle tells such work: a million regular texts may be one small file, and one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def cut_wide_observed(df: DataFrame, name: str, *metrics: Column) -> tuple[DataFrame, dict]:
    """`cut_observed` of a table with a row per record: beyond `WIDE_ROWS` rows joins keep it `apart`."""
    written, seen = cut_observed(df, name, F.count(F.lit(1)).alias("__rows"), *metrics)
    return (apart(written) if seen["__rows"] > WIDE_ROWS else written), seen


def cut_wide(df: DataFrame, name: str) -> DataFrame:
    """`cut` of a table with a row per record: beyond `WIDE_ROWS` rows joins keep it `apart`."""
    return cut_wide_observed(df, name)[0]


def local_table(spark: SparkSession, columns: dict[str, list], types: dict[str, pa.DataType] | None = None) -> DataFrame:
    """A hand-written table as a local relation, whose size the planner knows exactly."""
    types = types or {}
    return spark.createDataFrame(
        pa.table({n: pa.array(v, types.get(n, pa.string())) for n, v in columns.items()})
    )


def issue_rows(df: DataFrame, kind, entity, prop, rule, value) -> DataFrame:
    """Project onto the canonical issue columns; plain strings are literals."""

    def text(x):
        return (x if isinstance(x, Column) else F.lit(x)).cast("string")

    return df.select(
        text(kind).alias("kind"),
        text(entity).alias("entity"),
        text(prop).alias("prop"),
        text(rule).alias("rule"),
        text(value).alias("value"),
    )


def missing_if_empty(c) -> Column:
    """The empty string counts as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c != "", c)
