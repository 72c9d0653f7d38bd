"""Arrow batches of texts for the operators that need Python: bounded pieces, any other columns kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text bytes worked on at a time; a longer single text makes a piece of its own.
PIECE_BYTES = 4 << 20


def name(column: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + column.replace("`", "``") + "`")


def free(wanted: str, taken: list[str]) -> str:
    """`wanted`, or with underscores added until no column in `taken` has that name."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted += "_"
    return wanted


def pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of `batch` with at most PIECE_BYTES in the text column, or one row."""
    ends = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PIECE_BYTES, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    text: str,
    fields: list[T.StructField],
    setup: Callable[[], Callable[[list[str]], list[pa.Array]]],
    keep: list[str] | None = None,
) -> DataFrame:
    """Add `fields`, computed per row from `text`, which is "" where null.

    `setup` runs once per task and returns the function from a list of texts to
    one array per field. Of the other columns, `keep` (default: all) stay; one
    that has the name of a new field is replaced by it.
    """
    new = {f.name.lower() for f in fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in new]
    source = df.select(*map(name, kept), F.coalesce(name(text).cast("string"), F.lit("")).alias(free("text", kept)))
    schema = T.StructType([*source.schema.fields[:-1], *fields])
    last = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = setup()
        for batch in batches:
            for piece in pieces(batch, last):
                made = work(piece.column(last).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:last], *made], names=[f.name for f in schema.fields]
                )

    return source.mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Of rows sorted by their first `keys` columns, one table per run of equal keys.

    A run may go on over several batches; only the current one is held.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        turns = np.zeros(batch.num_rows, bool)
        for k in range(keys):
            c = batch.column(k)
            turns[1:] |= ~np.asarray(
                pa.compute.fill_null(pa.compute.equal(c[1:], c[:-1]), False)
                if not c.null_count
                else pa.array([x == y for x, y in zip(c[1:].to_pylist(), c[:-1].to_pylist())], pa.bool_())
            )
        if held:
            turns[0] = any(held[-1].column(k)[-1] != batch.column(k)[0] for k in range(keys))
        starts = [0, *np.flatnonzero(turns).tolist(), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            if held and turns[a]:
                yield pa.Table.from_batches(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
