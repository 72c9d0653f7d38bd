"""Collations of string indexes as Spark's collated strings, which comparisons, joins, groups and sorts obey."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What the last part of a collation URI means: comparison strength (1: base letters only, 2: accents as well,
# 3: case as well), and code points.
_STRENGTH = {"S1": "_CI_AI", "S2": "_CI", "S3": ""}
_CODEPOINT = "codepoint"


def collation_name(uri: str | None, root: str) -> str:
    """Spark's name of the collation with this URI.

    `root` is the URI of the root collation; others go below it, as `root/S1`,
    `root/fr/S2` or `root/codepoint`. None or empty means code points. Any other attribute is refused.
    """
    if not uri:
        return "UTF8_BINARY"
    base = root.rstrip("/")
    if uri.rstrip("/") == base:
        return "UNICODE"
    if not uri.startswith(base + "/"):
        raise ValueError(f"not below the root collation: {uri}")
    parts = uri[len(base) + 1 :].strip("/").split("/")
    if parts == [_CODEPOINT]:
        return "UTF8_BINARY"
    strength = ""
    if parts[-1] in _STRENGTH:
        strength = _STRENGTH[parts.pop()]
    if len(parts) > 1 or (parts and not parts[0].replace("_", "").isalpha()):
        raise ValueError(f"unsupported collation: {uri}")
    return (parts[0] if parts else "UNICODE") + strength


def collated(value: Column, uri: str | None, root: str) -> Column:
    """`value` as a string of that collation."""
    return F.collate(value, collation_name(uri, root))


def plain(value: Column) -> Column:
    """A collated string as an ordinary one."""
    return F.collate(value, "UTF8_BINARY")


def value_lexicon(values: DataFrame, by: list[str] | None = None, value: str = "value", uri: str = "uri") -> DataFrame:
    """Different values of an index, as its collation tells them apart, per `by`: `value` (of equal ones the least by code
    points), `documents` that have it and `frequency`.

    Combined on the map side by value and document, so a value that most documents have arrives as one row per
    task and document, and then as one per task.
    """
    by = list(by or [])
    per_document = values.groupBy(*by, value, uri).agg(F.min(plain(F.col(value))).alias("__least"), F.count(F.lit(1)).alias("__n"))
    counted = per_document.groupBy(*by, value).agg(
        F.min("__least").alias("__least"), F.count(F.lit(1)).alias("documents"), F.sum("__n").alias("frequency")
    )
    return counted.select(*by, F.col("__least").alias(value), "documents", "frequency")


def between(values: DataFrame, low: str | None = None, high: str | None = None, value: str = "value") -> DataFrame:
    """Values from `low` to `high`, both included, in the order of their collation; None leaves an end open."""
    kept = values
    if low is not None:
        kept = kept.filter(F.col(value) >= F.lit(low))
    if high is not None:
        kept = kept.filter(F.col(value) <= F.lit(high))
    return kept
