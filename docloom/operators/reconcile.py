"""Desired against actual state: a reviewable change plan.

Every function returns rows; nothing is applied. A dry run is reading the plan.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import comparators as cmp
from docloom.functions.values import quoted, split_list
from docloom.operators.validate import Prop, schema_table
from docloom.storage import Checked, dealt, issue_rows


def reconcile_entities(desired: DataFrame, actual: DataFrame, key: list[str], external: Column | None = None) -> DataFrame:
    """Verb per desired entity: create when it does not exist, else check.

    Entities that only exist are left alone. External ones are never created,
    only reported `missing`.
    """
    there = actual.select(*key).distinct().withColumn("__there", F.lit(True))
    absent = F.col("__there").isNull()
    verb = F.when(absent & external, "missing").when(absent, "create") if external is not None else F.when(absent, "create")
    return desired.join(there, key, "left").withColumn("verb", verb.otherwise("check")).drop("__there")


def reconcile_members(desired: DataFrame, actual: DataFrame, existing: DataFrame, group: list[str], name: str) -> DataFrame:
    """Verb per group and member: detach, attach, create or check.

    A member that is attached but not desired is detached, never deleted. A
    desired one that is not attached is attached if it exists anywhere
    (`existing` lists all names), else created.
    """
    key = [*group, name]
    # dealt by key: joined or grouped in parts of so many shuffled bytes, which hold very many regular rows, tables of keys and
    # sorted copies of them would meet in few tasks; texts are aggregated in one sorted pass, not in two tables
    every = desired.select(*key, F.lit("d").alias("__in")).unionByName(actual.select(*key, F.lit("a").alias("__in")))
    sides = dealt(every, *key).groupBy(*key).agg(F.max("__in").alias("__d"), F.min("__in").alias("__a"))
    # keys that hold null match nothing, not even each other
    whole = reduce(and_, [F.col(c).isNotNull() for c in key])
    matched = (F.col("__d") != F.col("__a")) & whole
    attached = sides.filter("__a = 'a'").select(*key, F.when(matched, "check").otherwise("detach").alias("verb"))
    known = existing.select(name).distinct().withColumn("__e", F.lit(True))
    wanted = dealt(sides.filter((F.col("__d") == "d") & ~matched).select(*key), name).join(known, name, "left")
    return attached.unionByName(wanted.select(*key, F.when(F.col("__e").isNotNull(), "attach").otherwise("create").alias("verb")))


# Fixed value: the property whose changes come after all others of its entity.
LATE_PROPERTY = "range-field-index"

_LIST = "array<string>"
_RECORDS = "array<map<string,string>>"


def _as_records(text: Column) -> Column:
    """JSON objects in a canonical spelling, keys sorted, so that they compare as text."""
    return F.transform(
        F.from_json(text, _RECORDS), lambda m: F.to_json(F.map_from_entries(F.sort_array(F.map_entries(m))))
    )


def _privileges(text: Column) -> Column:
    """What identifies privileges: their names and kinds."""
    return F.from_json(text, "array<struct<`privilege-name`: string, kind: string>>")


def _named(text: Column) -> Column:
    """Objects in the order given, each as its name and the rest of it in a canonical spelling.

    Empty values are the same as none.
    """

    def rest(m: Column) -> Column:
        given = F.filter(F.map_entries(m), lambda e: (e["key"] != "name") & (F.coalesce(e["value"], F.lit("")) != ""))
        return F.to_json(F.map_from_entries(F.sort_array(given)))

    return F.transform(
        F.from_json(text, _RECORDS), lambda m: F.struct(F.try_element_at(m, F.lit("name")).alias("name"), rest(m).alias("value"))
    )


def same_value(compare: Column, desired: Column, actual: Column, default: Column | None = None) -> Column:
    """Compare two property values, lists and maps being JSON text, by the named rule.

    `ordered` compares lists of named objects position by position, the desired
    side sorted by name; `privileges` names and kinds; `default` takes `default`
    for a desired value that is missing.
    """
    default = F.lit(None).cast("string") if default is None else default
    return (
        F.when(~compare.isin("perms", "ordered") & desired.eqNullSafe(actual), F.lit(True))
        .when(compare == "list", cmp.eq_list(F.from_json(desired, _LIST), F.from_json(actual, _LIST)))
        .when(compare == "struct_list", cmp.eq_struct_list(_as_records(desired), _as_records(actual)))
        .when(
            compare == "map",
            cmp.eq_map(F.from_json(desired, "map<string,string>"), F.from_json(actual, "map<string,string>")),
        )
        .when(compare == "perms", cmp.eq_perms(_as_records(desired), _as_records(actual)))
        .when(compare == "privileges", cmp.eq_privileges(_privileges(desired), _privileges(actual)))
        .when(compare == "ordered", cmp.eq_ordered(_named(desired), _named(actual), ["name", "value"], "name"))
        .when((compare == "default") & default.isNotNull(), cmp.eq_default(actual, desired, default))
        .otherwise(desired.eqNullSafe(actual))
    )


def _plan(df: DataFrame, phase: Column) -> DataFrame:
    return df.select(
        phase.cast("int").alias("phase"),
        F.lit("update").alias("verb"),
        "kind",
        "entity",
        "prop",
        F.col("__actual").alias("old"),
        F.col("value").alias("new"),
    )


def diff_properties(desired: DataFrame, actual: DataFrame, specs: list[Prop]) -> Checked:
    """Updates that bring the actual properties to the desired ones.

    Both sides are `kind, entity, prop, value` rows. Only desired properties are
    looked at. The schema names the comparison of each; properties it does not
    know are free-form ones and compare strictly. A difference in a frozen
    property is an issue. Phase 2 holds what must wait for the rest (`is_late`).
    """
    key = ["kind", "entity", "prop"]
    was = actual.select(*key, F.col("value").alias("__actual"))
    schema = schema_table(desired.sparkSession, specs)
    joined = (
        desired.join(was, key, "left")
        .join(schema.select("kind", "prop", "compare", "frozen", "phase", "dflt"), ["kind", "prop"], "left")
        # nothing desired is nothing to do, unless there is a default to go back to
        .filter(F.col("value").isNotNull() | ((F.col("compare") == "default") & F.col("dflt").isNotNull()))
    )
    compare = F.coalesce(F.col("compare"), F.lit("scalar"))
    changed = joined.filter(~same_value(compare, F.col("value"), F.col("__actual"), F.col("dflt")))
    changed = changed.withColumn("value", F.coalesce("value", F.when(compare == "default", F.col("dflt"))))
    frozen = F.coalesce(F.col("frozen"), F.lit(False))
    phase = F.when(is_late(), 2).otherwise(F.coalesce(F.col("phase"), F.lit(1)))
    return Checked(
        _plan(changed.filter(~frozen), phase),
        issue_rows(
            changed.filter(frozen), F.col("kind"), F.col("entity"), F.col("prop"), "frozen-differs",
            F.concat_ws(" -> ", "__actual", "value"),
        ),
    )


def diff_passthrough(desired: DataFrame, actual: DataFrame) -> DataFrame:
    """Free-form properties: any strict difference is an update."""
    return diff_properties(desired, actual, [Prop("", "")]).good


def diff_with_immutable(desired: DataFrame, actual: DataFrame, specs: list[Prop]) -> Checked:
    """Differences where some properties can only be set at creation.

    Looks at each property of the schema present on either side. An immutable one that
    differs is an issue; any other is compared with the desired value or its
    default, and an update carries the one or the other, so that a second
    comparison finds nothing more to do.
    """
    key = ["kind", "entity", "prop"]
    was = actual.select(*key, F.col("value").alias("__actual"))
    schema = schema_table(desired.sparkSession, specs).select("kind", "prop", "immutable", "dflt")
    joined = desired.select(*key, "value").join(was, key, "full").join(schema, ["kind", "prop"])
    fixed = F.col("immutable")
    differs = ~F.when(fixed, F.col("__actual").eqNullSafe(F.col("value"))).otherwise(
        F.col("__actual").eqNullSafe(F.coalesce(F.col("value"), F.col("dflt")))
    )
    changed = joined.filter(differs)
    return Checked(
        _plan(changed.filter(~fixed).withColumn("value", F.coalesce("value", "dflt")), F.lit(1)),
        issue_rows(
            changed.filter(fixed), F.col("kind"), F.col("entity"), F.col("prop"), "immutable-differs",
            F.concat_ws(" -> ", "__actual", "value"),
        ),
    )


def diff_reference(df: DataFrame, desired: str, actual: str, default: Column | None = None, to: str = "new") -> DataFrame:
    """Rows whose referenced entity must change, with the new name (or null to clear it).

    Nothing desired and nothing (or the default) set: no change. Nothing
    desired but something else set: back to the default. Otherwise the desired
    one unless it is already set. Empty text counts as nothing.
    """
    none = F.lit(None).cast("string")
    dflt = none if default is None else default
    want, have = F.nullif(F.col(desired), F.lit("")), F.nullif(F.col(actual), F.lit(""))
    wanted = F.when(want.isNotNull(), want).otherwise(dflt)
    changes = F.when(want.isNull(), have.isNotNull() & ~have.eqNullSafe(dflt)).otherwise(~have.eqNullSafe(want))
    return df.filter(changes).withColumn(to, wanted)


def _json_value(value: Column, type: Column) -> Column:
    """A JSON literal: booleans and integers bare, lists split, all else quoted."""
    listed = F.when(value.startswith("["), value).otherwise(F.to_json(split_list(value)))
    return (
        F.when(type.isin("boolean", "integer", "json"), value)
        .when(type == "list", listed)
        .otherwise(quoted(value))
    )


def creation_payload(props: DataFrame, passthrough: DataFrame | None = None, late: list[str] | None = None) -> Checked:
    """One JSON object per entity from typed `kind, entity, prop, type, value` rows.

    Free-form `passthrough` properties are added; one that is already set is an
    issue. `late` properties (a role's permissions) are left out: they are set
    once all entities exist. Keys come sorted. Properties are unique per entity
    before they are gathered, so a gathered list is one record's own.
    """
    props = props.filter(F.col("value").isNotNull())
    if late:
        props = props.filter(~F.col("prop").isin(late))
    rows = props.select("kind", "entity", "prop", "type", "value", F.lit(0).alias("free"))
    if passthrough is not None:
        free = passthrough.filter(F.col("value").isNotNull())
        type = F.col("type") if "type" in free.columns else F.lit("string")
        rows = rows.unionByName(free.select("kind", "entity", "prop", type.alias("type"), "value", F.lit(1).alias("free")))
    once = rows.groupBy("kind", "entity", "prop").agg(
        F.count("*").alias("n"), F.min_by(F.struct("type", "value"), "free").alias("v")
    )
    member = F.concat(quoted(F.col("prop")), F.lit(":"), _json_value(F.col("v.value"), F.col("v.type")))
    payload = once.groupBy("kind", "entity").agg(
        F.concat(F.lit("{"), F.array_join(F.sort_array(F.collect_list(member)), ","), F.lit("}")).alias("payload")
    )
    return Checked(
        payload,
        issue_rows(once.filter("n > 1"), F.col("kind"), F.col("entity"), F.col("prop"), "already-set", F.col("n")),
    )


def same_members(declared: DataFrame, existing: DataFrame, on: list[str], name: str) -> DataFrame:
    """Names present a different number of times on the two sides, per scope `on`.

    A scope that declares nothing is not checked. One shuffle with counts
    combined beforehand; no rows means the same.
    """
    tagged = declared.select(*on, name, F.lit(1).alias("d"), F.lit(0).alias("e")).unionByName(
        existing.select(*on, name, F.lit(0).alias("d"), F.lit(1).alias("e"))
    )
    counts = tagged.groupBy(*on, name).agg(F.sum("d").alias("declared"), F.sum("e").alias("existing"))
    configured = declared.select(*on).distinct()
    return counts.filter(F.col("declared") != F.col("existing")).join(configured, on, "left_semi")


def is_late() -> Column:
    """Property changes that wait for all others: role permissions, which may name roles that are
    created first, and field indexes, which need their fields."""
    return (F.col("prop") == LATE_PROPERTY) | (
        (F.col("kind") == "role") & F.col("prop").isin("permission", "permissions")
    )


def phased_plan(entities: DataFrame, props: DataFrame, actual: DataFrame, specs: list[Prop]) -> Checked:
    """The whole plan: creations, and updates of what exists, with what must wait in phase 2.

    `entities`: `kind, entity, verb` as `reconcile_entities` gives them; `props`:
    validated `kind, entity, prop, type, value`; `actual`: `kind, entity, prop, value`.
    A created entity is one row with its payload in `new`, without its late
    properties; these follow as updates. Entities to check give their differences.
    """
    key = ["kind", "entity"]
    verbs = entities.filter(F.col("verb").isin("create", "check")).select(*key, "verb")
    known = props.join(verbs, key)
    fresh = known.filter("verb = 'create'").drop("verb")
    payload, twice = creation_payload(fresh.filter(~is_late()))
    made = verbs.filter("verb = 'create'").join(payload, key, "left")
    none = F.lit(None).cast("string")
    create = made.select(
        F.lit(1).alias("phase"), "verb", *key, none.alias("prop"), none.alias("old"),
        F.coalesce("payload", F.lit("{}")).alias("new"),
    )
    later = fresh.filter(is_late() & F.col("value").isNotNull()).select(
        F.lit(2).alias("phase"), F.lit("update").alias("verb"), *key, "prop", none.alias("old"), F.col("value").alias("new")
    )
    updates, frozen = diff_properties(known.filter("verb = 'check'").select(*key, "prop", "value"), actual, specs)
    return Checked(create.unionByName(later).unionByName(updates), twice.unionByName(frozen))


def apply_plan(actual: DataFrame, plan: DataFrame) -> DataFrame:
    """The actual properties after the plan's updates, to diff again against the desired ones."""
    key = ["kind", "entity", "prop"]
    new = plan.select(*key, F.col("new").alias("__new"), F.lit(True).alias("__hit"))
    return actual.join(new, key, "full").select(
        *key, F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value")).alias("value")
    )
