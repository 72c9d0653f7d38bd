"""Scalar and list functions: strict parsing, list splitting, shard names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The white space a list delimiter swallows around each comma.
BLANK = r"[\s\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
LIST_DELIMITER = f"{BLANK}*,{BLANK}*"


def split_list(c: Column) -> Column:
    """Text to list on commas with surrounding blanks. Ends are not trimmed, repeats stay."""
    return F.split(c, LIST_DELIMITER)


def list_column(df: DataFrame, name: str) -> Column:
    """A list property of `df`, given either as an array or as delimited text."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.col(name)
    return split_list(F.col(name))


def strict_boolean(c: Column) -> Column:
    """Only `true` and `false` parse; a cast would also take `yes`, `1`, `T`."""
    return F.when(c == "true", F.lit(True)).when(c == "false", F.lit(False))


def strict_integer(c: Column, is_number: Column | None = None) -> Column:
    """Digits only for text; an integral value, possibly negative, for JSON numbers.

    Values beyond a long come out null, like any other invalid value.
    """
    digits = F.when(c.rlike(r"^[0-9]+\z"), c.try_cast("bigint"))
    if is_number is None:
        return digits
    double = c.try_cast("double")
    whole = F.when(c.rlike(r"^-?[0-9]+\z"), c.try_cast("bigint")).when(
        double == F.floor(double), double.try_cast("bigint")
    )
    return F.when(is_number, whole).otherwise(digits)


def enum_check(c: Column, values: list[str]) -> Column:
    """Membership in a closed set."""
    return c.isin(values)


def pad_name(base: Column, host: Column, shard: Column) -> Column:
    """`base-001-002`. Ordinals above 999 are written without digit grouping."""
    return F.format_string("%s-%03d-%03d", base, host, shard)


def map_to_pairs(c: Column, key: str = "prefix", value: str = "namespace-uri") -> Column:
    """A map as a list of named pairs."""
    return F.transform(
        F.map_entries(c), lambda e: F.struct(e["key"].alias(key), e["value"].alias(value))
    )


def merge_permissions(derived: Column, base: Column) -> Column:
    """Union of two role → capability maps; a non-empty derived entry wins.

    The base entries the derived map already answers are taken out first, since
    a map concatenation refuses repeated keys.
    """
    nothing = F.create_map().cast("map<string,string>")
    derived, base = F.coalesce(derived, nothing), F.coalesce(base, nothing)
    answered = F.map_filter(
        derived, lambda k, v: (v.isNotNull() & (v != "")) | ~F.map_contains_key(base, k)
    )
    return F.map_concat(
        F.map_filter(base, lambda k, v: ~F.map_contains_key(answered, k)), answered
    )


def quoted(text: Column) -> Column:
    """A text as a JSON string: a one-item JSON array without its brackets."""
    array = F.to_json(F.array(text))
    return array.substr(F.lit(2), F.length(array) - 2)


def json_escaped(text: Column) -> Column:
    """A text as it stands inside a JSON string, without the quotes."""
    string = quoted(text)
    return string.substr(F.lit(2), F.length(string) - 2)
