"""Lists of records inside properties, opened at any depth and checked like records of their own."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.operators.validate import Prop, apply_defaults, validate
from docloom.storage import Checked, cut, cut_observed, issue_rows


class Nested(NamedTuple):
    """Property `prop` of records of `kind` is a list of records of kind `record`; of each list, `key` tells them apart.

    Where an `each` is named, a record whose property of that name is a list stands for one record per item.
    """

    kind: str
    prop: str
    record: str
    key: str | None = None
    each: str | None = None


def open_records(props: DataFrame, nested: list[Nested]) -> Checked:
    """The properties of nested records: `kind, entity, prop, value, parent, path`, out of `kind, entity, prop, value` rows.

    A nested record goes by its path: `entity` is that of its parent, the property and its place from 0 in
    brackets (`name:db.forests[2].replicas[0]`); `parent` is the one it stands in. Rows of the outermost records come first,
    with null `parent`; the properties that were opened stay, as their JSON text. One object stands for a list of one.
    Nulls are no lists. Items that are no objects, and keys that occur twice in a list, are issues.

    Lists are walked as VARIANT, one level of nesting a round, so the depth is that of the data.
    """
    columns = ["kind", "entity", "prop", "value", "parent"]
    none = F.lit(None).cast("string")
    level = cut(props.select("kind", F.col("entity").cast("string").alias("entity"), "prop", "value", none.alias("parent")), "records")
    known = F.array(*[F.struct(F.lit(n.kind).alias("k"), F.lit(n.prop).alias("p"), F.lit(n.record).alias("record"), F.lit(n.key).cast("string").alias("key"), F.lit(n.each).cast("string").alias("each")) for n in nested])
    out, issues = [level], []
    while True:
        spec = F.get(F.filter(known, lambda s: (s["k"] == F.col("kind")) & (s["p"] == F.col("prop"))), F.lit(0))
        lists = level.withColumn("spec", spec).filter(F.col("spec").isNotNull() & F.col("value").isNotNull())
        parsed = F.try_parse_json("value")
        items = F.coalesce(F.try_variant_get(parsed, "$", "array<variant>"), F.array(parsed))
        each = lists.select("kind", "entity", "prop", "value", "spec", F.posexplode_outer(items).alias("at", "item"))
        fields = F.try_variant_get("item", "$", "map<string,variant>")
        path = F.concat("entity", F.lit("."), "prop", F.lit("["), F.col("at").cast("string"), F.lit("]"))
        found = each.filter("at IS NOT NULL").select(
            "kind", F.col("entity").alias("parent"), "prop", "spec", path.alias("entity"), F.col("item").cast("string").alias("text"), fields.alias("fields")
        )
        bad = found.filter(F.col("fields").isNull())
        issues.append(issue_rows(bad, F.col("kind"), F.col("parent"), F.col("prop"), "record-no-object", F.coalesce("text", F.lit("null"))))
        many = found.filter(F.col("fields").isNotNull())
        # one record per item of the property that stands for several
        value = F.try_element_at("fields", F.col("spec.each"))
        names = F.try_variant_get(value, "$", "array<string>")
        several = F.posexplode_outer(F.when(F.size(names) > 0, names))
        many = many.select("*", several.alias("turn", "one"))
        many = many.withColumn("entity", F.when(F.col("turn") > 0, F.concat("entity", F.lit("#"), F.col("turn").cast("string"))).otherwise(F.col("entity")))
        whole = F.transform(F.map_entries("fields"), lambda e: F.struct(e["key"].alias("prop"), _text(e["value"]).alias("value")))
        opened = many.select(F.col("spec.record").alias("kind"), "entity", "parent", "spec", "one", F.inline(whole))
        opened = opened.withColumn("value", F.when((F.col("prop") == F.col("spec.each")) & F.col("one").isNotNull(), F.col("one")).otherwise(F.col("value")))
        written, seen = cut_observed(opened.select(*columns, "spec"), "records", F.count(F.lit(1)).alias("n"))
        keys = written.filter(F.col("prop") == F.col("spec.key"))
        twice = keys.groupBy("kind", "parent", "prop", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        issues.append(issue_rows(twice, F.col("kind"), F.col("parent"), F.col("prop"), "duplicate-record", F.col("value")))
        if not seen["n"]:
            break
        level = written.select(*columns)
        out.append(level)
    return Checked(reduce(DataFrame.unionByName, out), reduce(DataFrame.unionByName, issues))


def _text(value: Column) -> Column:
    """A text as it is, anything else as JSON; JSON null is null."""
    return F.when(~F.is_variant_null(value), F.coalesce(F.try_variant_get(value, "$", "string"), F.to_json(value)))


def validate_records(props: DataFrame, specs: list[Prop], nested: list[Nested]) -> Checked:
    """`validate` and `apply_defaults` over records and all records nested in them.

    Good rows have `kind, entity, prop` (target name), `type`, `value` and `parent`; the entity of a nested record, in issues too,
    is its path. A nested record without any property is none.
    """
    opened, issue = open_records(props, nested)
    opened = cut(opened, "records")
    parents = opened.select("kind", "entity", "parent").distinct().filter("parent IS NOT NULL")
    good, bad = validate(apply_defaults(opened.select("kind", "entity", "prop", "value"), specs), specs, nested=False)
    return Checked(good.join(parents, ["kind", "entity"], "left"), issue.unionByName(bad))
