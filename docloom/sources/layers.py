"""Environment layers: JSON modules taken apart into rows.

A module is one JSON text with a single root object. Everything comes out in
long form, with a row per key that is present, so that an explicit null stays
distinct from an absent key.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.paths import GlobList, parent_path
from docloom.sources.documents import list_tree, read_contents
from docloom.storage import cut_wide, dealt, issue_rows

# Fixed value: the format version a module must declare.
FORMAT = "0.1"

# Section of a module → kind of its records.
SECTIONS = [
    ("$.hosts", "host"),
    ("$.databases", "database"),
    ("$.servers", "server"),
    ("$.sources", "source"),
    ("$.mime-types", "mime"),
    ("$.privileges.execute", "execute"),
    ("$.privileges.uri", "uri"),
    ("$.roles", "role"),
    ("$.users", "user"),
]

# Keys that become system parameters, named with a leading `@`.
SYSTEM_PARAMS = ["$.code", "$.title", "$.desc", "$.connect.host", "$.connect.user", "$.connect.password"]

_MAP = "map<string,string>"


class Layers(NamedTuple):
    """`components`: module, kind, pos, body. `params`: module, name, value.
    `imports`: module, import, pos. `apis`: module, api, prop, value. `config`: module, name, value."""

    components: DataFrame
    params: DataFrame
    imports: DataFrame
    apis: DataFrame
    config: DataFrame
    issue: DataFrame


def read_modules(spark: SparkSession, folder: str, glob: str = "*.json") -> DataFrame:
    """`module` (its path) and `body` of each module file below a folder."""
    files = list_tree(spark, folder.rstrip("/")).filter(GlobList([glob]).matches_file(F.col("full")))
    return read_contents(files).select(
        F.regexp_replace(F.col("full"), "^file:/*", "/").alias("module"), F.col("content").cast("string").alias("body")
    )


def _list(text: Column) -> Column:
    """A JSON list, or one text standing for a list of one."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(
        F.when(text.isNotNull(), F.array(text))
    )


def _resolved(path: Column) -> Column:
    """A path without `.` and `..` steps."""
    start = F.array().cast("array<string>")
    steps = F.reduce(
        F.split(path, "/"),
        start,
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when((s == ".") | ((s == "") & (F.size(acc) > 0)), acc)
        .otherwise(F.array_append(acc, s)),
    )
    return F.array_join(steps, "/")


def split_layers(modules: DataFrame) -> Layers:
    """Take modules apart. Imports are resolved against the importing module's folder.

    Modules with more than one root, or of another format, are issues and left out.
    """
    outer = F.from_json("body", _MAP)
    opened = dealt(modules.select("module", "body"), "module").select("module", F.explode(F.array(outer)).alias("__outer")).select(
        "module",
        F.coalesce(F.size("__outer"), F.lit(0)).alias("__roots"),
        F.get(F.map_values("__outer"), F.lit(0)).alias("__root"),
    )
    rule = F.when(F.col("__roots") != 1, "not-one-root").when(
        ~F.get_json_object("__root", "$.format").eqNullSafe(FORMAT), "wrong-format"
    )
    # every section is read from here: parse the modules once
    opened = cut_wide(opened.withColumn("__rule", rule), "modules")
    sound = opened.filter(F.col("__rule").isNull())

    sections = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.get_json_object("__root", p).alias("__list")) for p, k in SECTIONS]
    )
    listed = sound.select("module", F.inline(sections)).filter("__list IS NOT NULL")
    records = listed.withColumn("__items", F.from_json("__list", "array<string>"))
    bodies = records.select("module", "kind", F.posexplode("__items").alias("pos", "body"))
    components = bodies.filter(F.from_json("body", _MAP).isNotNull())
    system = F.array(
        *[
            F.struct(F.lit("@" + p.rsplit(".", 1)[-1]).alias("name"), F.get_json_object("__root", p).alias("value"))
            for p in SYSTEM_PARAMS
        ]
    )
    declared = F.from_json(F.get_json_object("__root", "$.params"), _MAP)
    params = (
        sound.select("module", F.inline(system)).filter("value IS NOT NULL")
        .unionByName(sound.select("module", F.explode(declared).alias("name", "value")))
    )
    imports = sound.select(
        "module", F.posexplode(_list(F.get_json_object("__root", "$.import"))).alias("pos", "__to")
    ).select(
        "module",
        F.when(F.col("__to").startswith("/"), F.col("__to"))
        .otherwise(_resolved(F.concat(parent_path(F.col("module")), F.lit("/"), F.col("__to"))))
        .alias("import"),
        "pos",
    )
    apis = sound.select(
        "module", F.explode(F.from_json(F.get_json_object("__root", "$.apis"), f"map<string,{_MAP}>")).alias("api", "__props")
    ).select("module", "api", F.explode("__props").alias("prop", "value"))
    issue = issue_rows(
        opened.filter(F.col("__rule").isNotNull()), "module", F.col("module"), "format", F.col("__rule"),
        F.get_json_object("__root", "$.format"),
    )
    config = sound.select("module", F.explode(F.from_json(F.get_json_object("__root", "$.config"), _MAP)).alias("name", "value"))
    no_list = records.filter(~F.ltrim("__list").startswith("["))
    issue = issue.unionByName(issue_rows(no_list, "module", F.col("module"), F.col("kind"), "section-no-list", F.col("__list")))
    no_record = bodies.filter(F.from_json("body", _MAP).isNull())
    issue = issue.unionByName(issue_rows(no_record, "module", F.col("module"), F.col("kind"), "record-no-object", F.col("body")))
    return Layers(components, params, imports, apis, config, issue)


def component_props(components: DataFrame) -> DataFrame:
    """Property rows of component bodies: `id, name, compose, prop, value` next to the other columns.

    Nested values stay JSON text.
    """
    others = [c for c in components.columns if c != "body"]
    opened = components.select(*others, F.explode(F.array(F.from_json("body", _MAP))).alias("__m"))
    given = [F.try_element_at("__m", F.lit(p)).alias(p) for p in ("id", "name", "compose")]
    return opened.select(*others, *given, F.explode("__m").alias("prop", "value"))


def index_rows(indexes: DataFrame, value: str = "value") -> DataFrame:
    """Range index rows out of `indexes` values, list names kept as lists, for `merge_indexes`."""
    others = [c for c in indexes.columns if c != value]
    ranges = F.from_json(F.get_json_object(value, "$.ranges"), "array<string>")
    rows = indexes.select(*others, F.posexplode(ranges).alias("sub_pos", "__r"))
    rows = rows.select(*others, "sub_pos", F.explode(F.array(F.from_json("__r", _MAP))).alias("__m"))

    def key(name: str) -> Column:
        return F.try_element_at("__m", F.lit(name))

    plain = [key(k).alias(k) for k in ("type", "namespace", "positions", "invalid", "collation")]
    listed = [F.coalesce(_list(key(k)), F.array(F.lit(None).cast("string"))).alias(k) for k in ("field", "path", "name")]
    parent = [
        F.get_json_object(key("parent"), "$.name").alias("parent_name"),
        F.get_json_object(key("parent"), "$.namespace").alias("parent_namespace"),
    ]
    return rows.select(*others, "sub_pos", *plain, *listed, *parent)
