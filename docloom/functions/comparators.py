"""Equality rules for property values. Each takes two Columns and gives a boolean."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def eq_scalar(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def _contained(left: Column, right: Column) -> Column:
    return (F.size(left) == F.size(right)) & (F.size(F.array_except(left, right)) == 0)


def eq_list(left: Column, right: Column) -> Column:
    """Missing equals empty; same length, and every left member is on the right.

    Repeats are not counted, so `[a,a,b]` equals `[a,b,b]`.
    """
    return _contained(F.coalesce(left, F.array()), F.coalesce(right, F.array()))


def eq_struct_list(left: Column, right: Column) -> Column:
    """`eq_list` over structs, all fields compared."""
    return eq_list(left, right)


def eq_map(left: Column, right: Column) -> Column:
    """Same pairs in any order; missing equals empty."""

    def pairs(c: Column) -> Column:
        return F.coalesce(F.sort_array(F.map_entries(c)), F.array())

    return pairs(left).eqNullSafe(pairs(right))


def eq_perms(left: Column, right: Column) -> Column:
    """As `eq_list`, but a missing list differs from every present one, even an empty one."""
    return (
        F.when(left.isNull() & right.isNull(), F.lit(True))
        .when(left.isNull() | right.isNull(), F.lit(False))
        .otherwise(_contained(left, right))
    )


def eq_privileges(left: Column, right: Column) -> Column:
    """As `eq_perms`, over `(privilege-name, kind)` pairs.

    Deliberate divergence: comparing by role and capability, which privileges do
    not have, would reduce the test to the list lengths.
    """
    return eq_perms(left, right)


def eq_default(old: Column, current: Column, default) -> Column:
    """The old value equals the current one, or the default where there is none."""
    return old.eqNullSafe(F.coalesce(current, F.lit(default)))


def eq_ordered(desired: Column, actual: Column, fields: list[str], by: str) -> Column:
    """Position by position, the desired side sorted by `by`; empty equals missing."""
    none = F.array()
    ordered = F.array_sort(
        F.coalesce(desired, none),
        lambda a, b: F.when(a[by] < b[by], -1).when(a[by] > b[by], 1).otherwise(0),
    )

    def same(a: Column, b: Column) -> Column:
        test = F.lit(True)
        for f in fields:
            test = test & F.nullif(a[f], F.lit("")).eqNullSafe(F.nullif(b[f], F.lit("")))
        return test

    actual = F.coalesce(actual, none)
    return (F.size(ordered) == F.size(actual)) & F.forall(
        F.zip_with(ordered, actual, same), lambda ok: ok
    )
