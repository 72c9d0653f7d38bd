"""Fixed-size batches in a given order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.storage import cut

# Fixed value: documents per insert batch.
BATCH_SIZE = 100

# monotonically_increasing_id() is the partition number shifted by this much plus the row's place in it
_PLACE_BITS = 33
_PLACE_MASK = (1 << _PLACE_BITS) - 1


def batch_documents(df: DataFrame, order: list[str], n: int = BATCH_SIZE, by: list[str] | None = None) -> DataFrame:
    """Number the rows in `order` and cut them into consecutive batches of exactly `n`.

    Adds `position` (from 1) and `batch` (from 0); with `by`, both restart for
    each source set (null is one of them). `order` must be total: end it with a unique column, which
    also lets the range partitioning split any run of equal leading values.

    No task sees the whole order. Rows are range-partitioned and sorted, written
    once with their place in the partition, and the partition sizes (one row per
    partition and source) give each partition its offset. Writing matters: the
    ranges come from a sample, and a recomputation would sample anew. Pass slim
    rows, without content, as batches are formed from paths and metadata.
    """
    by = list(by or [])
    placed = (
        df.repartitionByRange(*by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("__at", F.monotonically_increasing_id())
    )
    placed = cut(placed, "batches").withColumns(
        {
            "__part": F.shiftright("__at", _PLACE_BITS),
            "__place": F.col("__at").bitwiseAND(F.lit(_PLACE_MASK)),
        }
    )
    sizes = placed.groupBy(*by, "__part").agg(
        F.count("*").alias("__size"), F.min("__place").alias("__first")
    )
    # One row per partition (times the sources that share it): a few thousand at most per source.
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(
        sizes.withColumn("__offset", F.coalesce(F.sum("__size").over(before), F.lit(0)) - F.col("__first")).drop(
            "__size", "__first"
        ),
        "offsets",
    )
    # a source set may be the null one
    keys = [*by, "__part"]
    offsets = offsets.select(*[F.col(c).alias(f"__of_{c}") for c in keys], "__offset")
    same = [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in keys]
    return (
        placed.join(offsets, same)
        .drop(*[f"__of_{c}" for c in keys])
        .withColumn("position", F.col("__offset") + F.col("__place") + 1)
        .withColumn("batch", F.expr(f"(position - 1) div {int(n)}"))
        .drop("__at", "__part", "__place", "__offset")
    )


def batch_summary(df: DataFrame, length: str = "length", by: list[str] | None = None) -> DataFrame:
    """Documents and content size per batch, in MB to three decimals."""
    return df.groupBy(*(by or []), "batch").agg(
        F.count("*").alias("documents"),
        F.round(F.sum(length) / F.lit(1024 * 1024), 3).alias("mb"),
    )
