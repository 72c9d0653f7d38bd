"""Parameter substitution: `@{name}` from system parameters, `${name}` from user ones."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import Checked, apart, cut_wide, cut_wide_observed, issue_rows

PLACEHOLDER = r"[@$]\{[^}]*\}"
# Fixed value: a parameter name is alphanumeric, with single dashes between.
NAME = r"[a-zA-Z0-9]+(?:-[a-zA-Z0-9]+)*"


def _param_name(token: Column) -> Column:
    """`@{x}` asks for `@x`, `${x}` for `x`."""
    name = token.substr(F.lit(3), F.length(token) - 3)
    return F.when(token.startswith("@"), F.concat(F.lit("@"), name)).otherwise(name)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def _rebuilt(text: Column, values: Column, first_only: bool) -> Column:
    """Put the values, a map of parameter name → text, in place of the placeholders."""
    tokens = _tokens(text)
    literals = F.split(text, PLACEHOLDER)
    first_system = F.array_position(F.transform(tokens, lambda t: t.startswith("@")), True)
    first_user = F.array_position(F.transform(tokens, lambda t: t.startswith("$")), True)

    def one(token: Column, n: Column) -> Column:
        value = F.try_element_at(values, _param_name(token))
        if first_only:
            leading = ((n + 1) == first_system) | ((n + 1) == first_user)
            value = F.when(leading, value).otherwise(token)
        return value

    filled = F.transform(tokens, one)
    return F.array_join(
        F.transform(
            literals,
            lambda lit, n: F.concat(lit, F.coalesce(F.get(filled, n), F.lit(""))),
        ),
        "",
    )


def _rule(text: Column, values: Column | None) -> Column:
    """First problem of a text, or null."""
    tokens = _tokens(text)
    rule = F.when(
        F.regexp_replace(text, PLACEHOLDER, "").rlike(r"[@$]\{"), F.lit("unclosed-reference")
    ).when(
        F.exists(tokens, lambda t: ~t.rlike(rf"^[@$]\{{{NAME}\}}\z")), F.lit("invalid-name")
    )
    if values is not None:
        rule = rule.when(
            F.exists(
                tokens,
                lambda t: F.coalesce(F.try_element_at(values, _param_name(t)), F.lit("")) == "",
            ),
            F.lit("no-value"),
        )
    return rule


def substitute(df: DataFrame, col: str, params, key: list[str] | None = None, scope: list[str] | None = None, first_only: bool = False, kind: str = "text") -> Checked:
    """Replace all placeholders of a text column.

    `params` is either a dict, for the parameters of one environment, which
    become a map literal and cost no shuffle; or a DataFrame `name, value` with
    `scope` columns shared with `df`, for many environments at once. In that case
    `key` identifies a row of `df`: the distinct names each text asks for are
    looked up by equi-join and come back as one small map per text.

    Texts with an unclosed, misnamed or valueless placeholder are issues. An
    empty value counts as missing. By default every placeholder is replaced;
    `first_only` replaces just the first of each sort.
    """
    key = list(key or [])
    text = F.col(col)
    if isinstance(params, dict):
        pairs = [F.lit(x) for pair in params.items() for x in pair]
        values = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        checked = df.withColumn("__rule", _rule(text, values))
        good = checked.filter(F.col("__rule").isNull()).withColumn(col, _rebuilt(text, values, first_only))
    else:
        scope = list(scope or [])
        asked = df.filter(text.rlike(r"[@$]\{")).select(
            *key,
            *[c for c in scope if c not in key],
            F.explode(F.array_distinct(F.transform(_tokens(text), _param_name))).alias("__name"),
        )
        named = params.select(*scope, F.col("name").alias("__name"), F.col("value").alias("__value"))
        known = (
            asked.join(apart(named), [*scope, "__name"])
            .groupBy(*key)
            .agg(F.map_from_entries(F.collect_list(F.struct("__name", "__value"))).alias("__values"))
        )
        values = F.coalesce(F.col("__values"), F.create_map().cast("map<string,string>"))
        checked = df.join(known, key, "left").withColumn("__rule", _rule(text, values))
        good = (
            checked.filter(F.col("__rule").isNull())
            .withColumn(col, _rebuilt(text, values, first_only))
            .drop("__values")
        )
    entity = F.concat_ws("/", *[F.col(k).cast("string") for k in key]) if key else None
    return Checked(
        good.drop("__rule"),
        issue_rows(checked.filter(F.col("__rule").isNotNull()), kind, entity, col, F.col("__rule"), text),
    )


def resolve_params(params: dict[str, str]) -> dict[str, str]:
    """Resolve parameters of one environment that refer to each other.

    A handful of configuration values, so plain Python. System parameters carry
    their leading `@` in the name.
    """
    done: dict[str, str] = {}

    def value(name: str, path: tuple[str, ...]) -> str:
        if name in path:
            raise ValueError(f"parameter refers to itself: {' > '.join((*path, name))}")
        if name not in done:
            raw = params.get(name)
            if not raw:
                raise ValueError(f"no value for parameter: {name}")
            done[name] = re.sub(
                rf"([@$])\{{({NAME})\}}",
                lambda m: value(("@" if m[1] == "@" else "") + m[2], (*path, name)),
                raw,
            )
        return done[name]

    return {name: value(name, ()) if raw else raw for name, raw in params.items()}


def resolve_param_table(params: DataFrame, scope: list[str]) -> Checked:
    """Resolve parameters that refer to each other, for many environments at once.

    `params`: `scope`, `name`, `value`. Each round fills in what is resolved
    already; the rounds are as many as parameters nest. What a round without
    progress leaves refers to itself or to nothing, and is an issue.
    """
    key = [*scope, "name"]
    params = cut_wide(params.select(*key, "value"), "params")
    nested = F.coalesce(F.col("value").rlike(r"[@$]\{"), F.lit(False))
    solved, pending = params.filter(~nested), params.filter(nested)
    while True:
        filled, seen = cut_wide_observed(
            substitute(pending, "value", solved, key, scope).good, "params", F.count("*").alias("n")
        )
        if not seen["n"]:
            break
        solved = solved.unionByName(filled)
        pending, seen = cut_wide_observed(
            pending.join(filled.select(*key), key, "left_anti"), "params", F.count("*").alias("n")
        )
        if not seen["n"]:
            break
    where = F.concat_ws("/", *[F.col(k).cast("string") for k in key])
    return Checked(solved, issue_rows(pending, "param", where, "value", "unresolvable", F.col("value")))
