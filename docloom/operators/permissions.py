"""Permissions as rows: one per role and capability, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.values import split_list
from docloom.storage import Checked, issue_rows

# The capabilities a permission may grant.
CAPABILITIES = ["update", "insert", "read", "execute", "node-update"]


def explode_permissions(df: DataFrame, col: str, entity: str) -> Checked:
    """One row per role and capability from a map of role → list or delimited text."""
    listed = isinstance(df.schema[col].dataType.valueType, T.ArrayType)
    roles = df.select("*", F.explode(F.col(col)).alias("role", "__caps")).drop(col)
    pairs = roles.select(
        "*", F.explode(F.col("__caps") if listed else split_list(F.col("__caps"))).alias("capability")
    ).drop("__caps")
    known = F.coalesce(F.col("capability").isin(CAPABILITIES), F.lit(False))
    return Checked(
        pairs.filter(known),
        issue_rows(
            pairs.filter(~known),
            "permission",
            F.col(entity),
            F.col("role"),
            "unknown-capability",
            F.col("capability"),
        ),
    )


def group_permissions(df: DataFrame, keys: list[str]) -> DataFrame:
    """Capabilities per key and role, repeats kept, in sorted order.

    There are five capabilities, so a group is five counters: one hash aggregate
    with partial sums, however often a grant is repeated.
    """
    ordered = sorted(CAPABILITIES)
    counted = df.groupBy(*keys, "role").agg(
        *[F.count_if(F.col("capability") == c).alias(f"__{c}") for c in ordered]
    )
    repeated = [F.array_repeat(F.lit(c), F.col(f"__{c}").cast("int")) for c in ordered]
    return counted.select(*keys, "role", F.concat(*repeated).alias("capabilities"))
