"""Closed schemas: validation and defaults over long-form properties."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.values import strict_boolean, strict_integer
from docloom.storage import Checked, issue_rows, local_table


@dataclass(frozen=True)
class Prop:
    """One property of a kind.

    `type` is string, boolean, integer, enum or list (any text). `default` is a text, or
    for a computed one `(source property, value → Column)`.
    """

    kind: str
    name: str
    target: str | None = None
    type: str = "string"
    values: tuple[str, ...] = ()
    mandatory: bool = False
    ignored: bool = False
    frozen: bool = False
    immutable: bool = False
    default: object = None
    compare: str = "scalar"
    phase: int = 1


def schema_table(spark: SparkSession, specs: list[Prop]) -> DataFrame:
    return local_table(
        spark,
        {
            "kind": [s.kind for s in specs],
            "prop": [s.name for s in specs],
            "target": [s.target or s.name for s in specs],
            "type": [s.type for s in specs],
            "allowed": [list(s.values) for s in specs],
            "mandatory": [s.mandatory for s in specs],
            "ignored": [s.ignored for s in specs],
            "frozen": [s.frozen for s in specs],
            "immutable": [s.immutable for s in specs],
            "compare": [s.compare for s in specs],
            "phase": [s.phase for s in specs],
            "dflt": [s.default if isinstance(s.default, str) else None for s in specs],
        },
        {
            "allowed": pa.list_(pa.string()),
            "mandatory": pa.bool_(),
            "ignored": pa.bool_(),
            "frozen": pa.bool_(),
            "immutable": pa.bool_(),
            "phase": pa.int32(),
        },
    )


def flatten_nested(props: DataFrame, specs: list[Prop]) -> DataFrame:
    """Open nested objects: `lexicons` with `{"uri": true}` also gives a row `lexicons.uri`.

    Only objects that the schema has parts of, named with a dot. A value there
    that is no object is left for `validate` to report.
    """
    outer = sorted({(s.kind, s.name.rsplit(".", 1)[0]) for s in specs if "." in s.name})
    if not outer:
        return props
    nested = F.lit(False)
    for kind, name in outer:
        nested = nested | ((F.col("kind") == kind) & (F.col("prop") == name))
    inner = F.from_json(F.when(nested, F.col("value")), "map<string,string>")
    row = F.struct(F.col("prop").alias("prop"), F.col("value").alias("value"))
    parts = F.transform(F.map_entries(inner), lambda e: F.struct(F.concat("prop", F.lit("."), e["key"]).alias("prop"), e["value"].alias("value")))
    others = [c for c in props.columns if c not in ("prop", "value")]
    return props.select(*others, F.inline(F.concat(F.array(row), F.coalesce(parts, F.filter(F.array(row), lambda _: F.lit(False))))))


def _names_of_kind(specs: list[Prop], name) -> Column:
    """The names a schema lists for a row's kind, as a literal; empty for other kinds."""
    none = F.array().cast("array<string>")
    kinds = sorted({s.kind for s in specs})
    pairs = []
    for kind in kinds:
        names = sorted({name(s) for s in specs if s.kind == kind})
        pairs += [F.lit(kind), F.array(*[F.lit(n) for n in names])]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("kind")), none) if pairs else none


def value_rule(value: Column, type: Column, allowed: Column, is_number: Column | None = None) -> Column:
    """Rule a value breaks, or null."""
    return (
        F.when((type == "boolean") & strict_boolean(value).isNull(), "not-boolean")
        .when((type == "integer") & strict_integer(value, is_number).isNull(), "not-integer")
        .when((type == "enum") & ~F.array_contains(allowed, value), "not-in-enum")
    )


def validate(props: DataFrame, specs: list[Prop], number: str | None = None, nested: bool = True) -> Checked:
    """Check `kind, entity, prop, value` rows against a closed schema.

    Problems found: unknown property, value of the wrong type, the same target
    set twice, mandatory property missing. Nulls are skipped (and do not satisfy
    a mandatory property); ignored properties are exempt. `good` holds the
    remaining properties under their target names; all problems are reported,
    not only the first.

    Nested objects are opened first (`flatten_nested`), unless they have been:
    then `nested` is false. What should be an object and is none is an issue.

    The schema is a hand-written table, whose size the planner knows. One
    aggregate per entity counts each target of the schema, combined on the map side.
    """
    schema = schema_table(props.sparkSession, specs)
    opened = flatten_nested(props, specs) if nested else props
    flagged = opened.join(schema, ["kind", "prop"], "left")
    used = ~F.col("ignored") & F.col("value").isNotNull()
    outer = sorted({s.name.rsplit(".", 1)[0] for s in specs if "." in s.name})
    no_object = F.col("prop").isin(outer) & F.col("ignored") & F.from_json("value", "map<string,string>").isNull() & F.col("value").isNotNull()
    rule = (
        F.when(F.col("type").isNull(), "unknown-property")
        .when(no_object, "not-object")
        .when(used, value_rule(F.col("value"), F.col("type"), F.col("allowed"), F.col(number) if number else None))
    )
    flagged = flagged.withColumn("rule", rule)
    taken = flagged.filter(used & F.col("type").isNotNull())

    wanted: dict[str, set[str]] = {}
    targets = sorted({s.target or s.name for s in specs if not s.ignored})
    for s in specs:
        if s.mandatory and not s.ignored:
            wanted.setdefault(s.target or s.name, set()).add(s.kind)
    counted = flagged.groupBy("kind", "entity").agg(
        *[F.count_if(used & (F.col("target") == t)).alias(f"n_{i}") for i, t in enumerate(targets)]
    )

    def problem(target: str, rule: str, value: Column) -> Column:
        return F.struct(F.lit(target).alias("prop"), F.lit(rule).alias("rule"), value.cast("string").alias("value"))

    found = []
    for i, t in enumerate(targets):
        n = F.col(f"n_{i}")
        found.append(F.when(n > 1, problem(t, "set-twice", n)))
        if t in wanted:
            missing = (n == 0) & F.col("kind").isin(sorted(wanted[t]))
            found.append(F.when(missing, problem(t, "missing-mandatory", F.lit(None))))
    issue = issue_rows(
        flagged.filter(F.col("rule").isNotNull()),
        F.col("kind"), F.col("entity"), F.col("prop"), F.col("rule"), F.col("value"),
    )
    if found:
        grouped = counted.select("kind", "entity", F.inline(F.array_compact(F.array(*found))))
        issue = issue.unionByName(issue_rows(grouped, F.col("kind"), F.col("entity"), F.col("prop"), F.col("rule"), F.col("value")))
    good = taken.filter(F.col("rule").isNull()).select(
        *[c for c in props.columns if c not in ("prop", "value")], F.col("target").alias("prop"), "type", "value"
    )
    return Checked(good, issue)


def ensure(checked: Checked) -> DataFrame:
    """The good rows, or a failing job that names one problem when there is any."""
    first = checked.issue.limit(1).select(
        F.raise_error(F.concat_ws(" ", "rule", "kind", "entity", "prop", "value")).cast("string").alias("__stop")
    )
    columns = checked.good.columns
    return (
        checked.good.withColumn("__stop", F.lit(None).cast("string"))
        .unionByName(first, allowMissingColumns=True)
        .filter(F.col("__stop").isNull())
        .select(*columns)
    )


def apply_defaults(props: DataFrame, specs: list[Prop]) -> DataFrame:
    """Add defaulted properties to the entities where they are absent.

    An explicit null is present: it suppresses the default. A computed default
    sees the entity's value of its source property. One aggregate per entity,
    keeping only names the schema has defaults for.
    """
    specs = [s for s in specs if s.default is not None]
    sources = sorted({s.default[0] for s in specs if not isinstance(s.default, str)})
    names = sorted({s.name for s in specs})
    have = props.groupBy("kind", "entity").agg(
        F.collect_set(F.when(F.col("prop").isin(names), F.col("prop"))).alias("have"),
        *[F.max(F.when(F.col("prop") == s, F.col("value"))).alias(f"src_{n}") for n, s in enumerate(sources)],
    )
    value = None
    for s in specs:
        given = F.lit(s.default) if isinstance(s.default, str) else s.default[1](F.col(f"src_{sources.index(s.default[0])}"))
        test = (F.col("kind") == s.kind) & (F.col("prop") == s.name)
        value = F.when(test, given) if value is None else value.when(test, given)
    added = (
        have.withColumn("prop", F.explode(F.array_except(_names_of_kind(specs, lambda s: s.name), "have")))
        .select("kind", "entity", "prop", value.alias("value"))
    )
    return props.unionByName(added, allowMissingColumns=True)
