"""Whitening of embeddings by distributed block matrices.

Entries become whole numbers, so that sums, and whether two vectors are equal, are
exact. The different vectors are numbered, centred and written as blocks of rows.
The transposed block matrix times itself is the scatter matrix; its small
eigenproblem is solved on the driver; the blocks times the whitening
matrix are the projected rows. All of it is MLlib's BlockMatrix, on the JVM.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import name
from docloom.storage import cut, fresh_path, local_table

COMPONENTS, SCALE, SHIFT = 16, 64, 1_000_000
# Rows per block, from and to, and blocks before they grow: the driver deals out blocks by their numbers.
BLOCK_ROWS, LARGEST_BLOCK, BLOCKS = 1024, 1 << 16, 1 << 14
# Blocks that one task multiplies and adds up.
TOGETHER = 16


def whole(vector: Column) -> Column:
    """floor(64 c) + 1000000 of each entry c, as longs; null for an unusable vector, in whatever order filters are applied."""
    return F.transform(F.when(usable(vector), vector), lambda c: F.floor(c.cast("double") * SCALE).cast("long") + SHIFT)


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf))
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda c: finite(c.cast("double"))), F.lit(False))


class Whitening(NamedTuple):
    """What whitened rows are made of: the different vectors (`index`, `x`), their blocks of `size` rows, number and
    sums, the eigenvalues and eigenvectors in use, and the sum of all eigenvalues."""

    distinct: DataFrame
    blocks: DataFrame | None
    size: int
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """`rows` with an `index` from 0 without gaps, written, and their number. A recomputed task may number its rows anew, so places are written first."""
    placed = cut(rows.withColumn("at", F.monotonically_increasing_id()), "whitening-rows")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition
    sizes = sorted(tuple(r) for r in placed.groupBy(part.alias("part")).count().collect())
    before = np.concatenate(([0], np.cumsum([n for _, n in sizes]))).astype(np.int64)
    offsets = local_table(
        rows.sparkSession, {"of": [p for p, _ in sizes], "before": before[:-1].tolist()}, {"of": pa.int64(), "before": pa.int64()}
    )
    made = placed.join(F.broadcast(offsets), part == F.col("of")).select((F.col("before") + place).alias("index"), *rows.columns)
    return made, int(before[-1])


def block_rows(n: int) -> int:
    return min(LARGEST_BLOCK, max(BLOCK_ROWS, math.ceil(n / BLOCKS)))


def blocks_of(rows: DataFrame, size: int) -> DataFrame:
    """`index` and `values` (an array of doubles) as dense blocks (`block`, `matrix`) of `size` rows, written."""
    path = fresh_path(rows.sparkSession, "whitening-blocks")
    by_block = rows.groupBy(F.expr(f"index div {size}").alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("index", "values"))).alias("rows"),
        F.max(F.size("values")).alias("width"),
    )
    # the fields of a dense matrix as MLlib keeps it, by rows
    matrix = F.struct(
        F.lit(1).cast("byte").alias("type"),
        F.size("rows").alias("numRows"),
        F.col("width").alias("numCols"),
        F.lit(None).cast("array<int>").alias("colPtrs"),
        F.lit(None).cast("array<int>").alias("rowIndices"),
        F.flatten(F.transform("rows", lambda r: r["values"])).alias("values"),
        F.lit(True).alias("isTransposed"),
    )
    by_block.select("block", matrix.alias("matrix")).write.parquet(path)
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("matrix", MatrixUDT())])
    return rows.sparkSession.read.schema(schema).parquet(path)


def block_matrix(blocks: DataFrame, row: Column, column: Column, shape: tuple[int, int], n_rows: int, n_columns: int) -> BlockMatrix:
    """MLlib's matrix of written blocks, each at block `row` and `column`."""
    at = F.struct(row.cast("long").alias("_1"), column.cast("long").alias("_2"))
    placed = blocks.select(at.alias("_1"), F.col("matrix").alias("_2"))
    return BlockMatrix(callMLlibFunc("createBlockMatrix", placed, *shape, n_rows, n_columns), *shape)


def scatter(blocks: DataFrame, size: int, n: int, width: int) -> np.ndarray:
    """The transposed matrix of all rows times itself. Tasks add up the products of their blocks before these are brought together."""
    tall = block_matrix(blocks, F.col("block"), F.lit(0), (size, width), n, width)
    across = tall.transpose()
    splits = max(1, math.ceil(math.ceil(n / size) / TOGETHER))
    # the Scala method's second argument, which splits the sum over blocks, has no Python counterpart
    product = across._java_matrix_wrapper.call("multiply", tall._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, width, width).toLocalMatrix().toArray()


def projected(blocks: DataFrame, size: int, n: int, matrix: np.ndarray) -> DataFrame:
    """Rows (`index`, `values`): each row of the blocks times `matrix`, written.

    A product with one column of blocks is dealt to no more tasks than the square
    root of its partitions. So the blocks are laid out as a square, and multiplied by a
    matrix that has `matrix` all along its diagonal.
    """
    spark = blocks.sparkSession
    width, components = matrix.shape
    side = math.ceil(math.sqrt(math.ceil(n / size)))
    square = block_matrix(blocks, F.expr(f"block div {side}"), F.col("block") % side, (size, width), side * size, side * width)
    one = DenseMatrix(width, components, matrix.T.ravel().tolist())
    diagonal = spark.sparkContext.parallelize([((k, k), one) for k in range(side)], min(side, 64))
    product = square.multiply(BlockMatrix(diagonal, width, components, side * width, side * components))
    rows = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    whole_row = rows.select("index", F.posexplode(_pieces(vector_to_array("vector"), side, components)).alias("column", "values"))
    block = F.expr(f"index div {size}") * side + F.col("column")
    index = block * size + F.col("index") % size
    return cut(whole_row.select(index.alias("index"), "values").filter(F.col("index") < n), "whitening-projected")


def _pieces(values: Column, count: int, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.slice(values, k * length + 1, length))


def fit(x: DataFrame, components: int = COMPONENTS) -> Whitening:
    """The whitening of the different vectors of `x` (column `x`, arrays of longs of one length)."""
    # Equal vectors are combined on the map side.
    distinct, n = numbered(x.select("x").distinct())
    sums = [r[1] for r in distinct.select(F.posexplode("x")).groupBy("pos").agg(F.sum("col")).orderBy("pos").collect()]
    width, size = len(sums), block_rows(n)
    if not width:
        return Whitening(distinct, None, size, n, [], np.empty(0), np.empty((0, 0)), 0.0)
    blocks = blocks_of(distinct.select("index", centred(n, sums).alias("values")), size)
    products = scatter(blocks, size, n, width) / n
    values, vectors = np.linalg.eigh((products + products.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    # what is left of no variance at all is rounding
    real = int((values > max(values[0], 0.0) * width * np.finfo(float).eps).sum())
    kept = min(components, real)
    return Whitening(distinct, blocks, size, n, sums, values[:kept], vectors[:, :kept], float(values.sum()))


def apart(n: int, sums: list[int]) -> Column:
    """n x - S, exact."""
    return F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda a, s: a * F.lit(n).cast("long") - s)


def centred(n: int, sums: list[int]) -> Column:
    """x - S / n, of whole numbers up to the division."""
    return F.transform(apart(n, sums), lambda v: v.cast("double") / n)


def identity_error(rows: DataFrame, n: int, components: int) -> float:
    """The largest entry, by amount, of the covariance of `values` minus the identity."""
    at = [F.element_at("values", k + 1) for k in range(components)]
    means = rows.agg(*[F.sum(c) / n for c in at]).first()
    pairs = [(i, j) for i in range(components) for j in range(i + 1)]
    products = rows.agg(*[F.sum((at[i] - means[i]) * (at[j] - means[j])) / n for i, j in pairs]).first()
    return max(abs(p - (i == j)) for p, (i, j) in zip(products, pairs))


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """The rows of `df` that have a usable vector, all columns, with `n`, `deviation`, `whitened`, `explained` and `identity_error`.

    Rows without vector, or with entries that are null or not finite, go; so do
    vectors of another length than most have (of equally frequent lengths, the longest counts), which
    have no place in the same space. Every entry c becomes x = floor(64 c) + 1000000.
    The fit counts each different vector x once. `n` is their number, `deviation` the
    sum of (n x - S)^2 over the dimensions, exact (an overflow fails, never wraps);
    `whitened` and `explained` are arrays over the components, by falling
    eigenvalue, at most `components` and only those with variance: a table of one
    different vector has none. Eigenvectors of equal eigenvalues are any basis of
    their space, the same for all rows. Repeated rows each stay; existing columns of
    these names are replaced; an empty table gives no rows.
    """
    new = ["n", "deviation", "whitened", "explained", "identity_error"]
    kept = [c for c in df.columns if c.lower() not in new]
    rows = df.filter(usable(name(vector))).select(F.struct(*map(name, kept)).alias("row"), whole(name(vector)).alias("x"))
    lengths = rows.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    rows = rows.filter(F.size("x") == (lengths.length if lengths else 0))
    model = fit(rows.select("x"), components)
    count = len(model.values)
    if count:
        made = projected(model.blocks, model.size, model.n, model.vectors / np.sqrt(model.values))
        error = identity_error(made, model.n, count)
    else:
        made = df.sparkSession.createDataFrame([], "index long, values array<double>")
        error = 0.0
    deviation = F.aggregate(apart(model.n, model.sums), F.lit(0).cast("long"), lambda total, v: total + v * v)
    of = model.distinct.join(made, "index", "left").select(
        F.col("x").alias("of_x"),
        F.lit(model.n).cast("long").alias("n"),
        deviation.alias("deviation"),
        F.coalesce("values", F.array().cast("array<double>")).alias("whitened"),
        F.array(*[F.lit(float(v / model.trace)) for v in model.values]).cast("array<double>").alias("explained"),
        F.lit(error).alias("identity_error"),
    )
    # Written, with one row per vector: adaptive execution splits a vector that many rows have.
    of = cut(of, "whitening-vectors")
    return rows.join(of, F.col("x") == F.col("of_x")).select("row.*", *new)
