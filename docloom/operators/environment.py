"""An environment, from its modules to merged records; documents, from a tree to batches."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import json_escaped, list_column
from docloom.operators.batching import BATCH_SIZE, batch_documents
from docloom.operators.documents import derive_uri, effective_collections, select_paths
from docloom.operators import schemas
from docloom.operators.graph import SLOTS, flatten_imports, open_embedded, topo_levels
from docloom.operators.layers import (
    first_values,
    layered_permissions,
    merge_indexes,
    overlay_defaults,
    precedence_lookup,
    surviving,
)
from docloom.operators.lookup import resolve_reference
from docloom.operators.substitute import resolve_param_table, substitute
from docloom.operators.validate import apply_defaults, flatten_nested, validate
from docloom.sources.layers import component_props, index_rows, split_layers
from docloom.storage import Checked, apart, cut_wide, issue_rows

# Kinds whose permissions merge role by role.
GRANTING = ["source", "role", "user"]


class Environment(NamedTuple):
    """Everything goes by `root`, the module an environment starts from.

    `params`: name, value. `props`: kind, entity, id, name, prop, value.
    `permissions`: kind, entity, role, value. `indexes`: entity and index
    columns. `apis`: api, prop, value. `config`: name, value. `issue`: whatever
    did not fit.
    """

    params: DataFrame
    props: DataFrame
    permissions: DataFrame
    indexes: DataFrame
    apis: DataFrame
    config: DataFrame
    issue: DataFrame


def compile_environments(
    modules: DataFrame, roots: DataFrame, given: DataFrame | None = None, defaults: DataFrame | None = None
) -> Environment:
    """Compile the environments starting at `roots`, all at once.

    `modules`: `module`, `body`; `roots`: `module`; `given`: `root, name,
    value`, parameters that go before those of any module, and `defaults` like it
    such that come after all. Imports are flattened, parameters looked up (last import first) and resolved, records
    substituted and merged (first import first).
    """
    layers = split_layers(modules)
    closure, cycles = flatten_imports(layers.imports, roots)
    closure = closure.withColumnRenamed("node", "module")
    place = closure.select("root", "module", "path_first", "path_last", (F.col("depth") == 0).alias("own"))

    declared = layers.params.join(place, "module").select(
        "root", "name", "value", "own", F.lit(1).alias("rank"), "path_last"
    )
    for rank, more in ((0, given), (2, defaults)):
        if more is not None:
            none = F.array().cast("array<int>").alias("path_last")
            declared = declared.unionByName(
                more.select("root", "name", "value", F.lit(True).alias("own"), F.lit(rank).alias("rank"), none)
            )
    looked_up = precedence_lookup(declared, ["root", "name"], ["rank", "path_last"], own=F.col("own"))
    params, unresolved = resolve_param_table(looked_up, ["root"])

    records = layers.components.join(place, "module").select(
        "root", "kind", "module", F.col("path_first").alias("layer"), "pos", "body"
    )
    # values go into JSON text, keys included
    escaped = params.select("root", "name", json_escaped(F.col("value")).alias("value"))
    filled, unfilled = substitute(records, "body", escaped, ["root", "module", "kind", "pos"], ["root"], kind="component")
    props = cut_wide(component_props(filled).drop("module"), "props")

    survivors, unmerged = surviving(props, ["root"])
    survivors = cut_wide(survivors, "survivors")
    merged = first_values(survivors, ("indexes", "permissions"), ["root"])
    granting = survivors.filter((F.col("prop") == "permissions") & F.col("kind").isin(GRANTING))
    permissions = layered_permissions(
        granting.select("root", "kind", "entity", "rank", F.explode(F.from_json("value", "map<string,string>")).alias("role", "value")),
        ["root", "kind", "entity"],
    )

    declaring = survivors.filter("prop = 'indexes' AND value IS NOT NULL").select("root", "kind", "entity", "id", "name", "rank", "value")
    others, unmergeable = _index_settings(declaring)
    merged = merged.unionByName(others)
    declaring = declaring.select("root", "entity", "rank", "value")
    founder = declaring.groupBy("root", "entity").agg(F.min("rank").alias("founder"))
    rows = index_rows(declaring.join(founder, ["root", "entity"]))
    rows = rows.withColumn("derived", F.col("rank") == F.col("founder")).withColumn("at", F.struct("rank", "sub_pos"))
    rows = _one_list(rows.drop("rank", "founder", "sub_pos"))
    indexes = merge_indexes(
        rows.filter("derived").drop("derived"), rows.filter("NOT derived").drop("derived"), ["root", "entity"], pos="at"
    )

    overrides = layers.apis.join(place, "module").select("root", "api", "prop", "value", "path_first")
    every_root = overrides.unionByName(
        roots.select(F.col("module").alias("root"), F.lit(None).cast("string").alias("api"), F.lit(None).cast("string").alias("prop"),
                     F.lit(None).cast("string").alias("value"), F.array().cast("array<int>").alias("path_first"))
    )
    apis, unknown_apis = overlay_defaults(every_root, ["root"], ["path_first"])
    wanted = closure.select("module").union(roots.select("module")).distinct()
    absent = issue_rows(wanted.join(apart(modules.select("module")), "module", "left_anti"), "module", F.col("module"), "import", "no-such-module", None)
    issue = layers.issue
    for more in (cycles, absent, unresolved, unfilled, unmerged, unmergeable, unknown_apis):
        issue = issue.unionByName(more)
    config = precedence_lookup(layers.config.join(place, "module").select("root", "name", "value", "path_last"), ["root", "name"], ["path_last"])
    return Environment(params, merged, permissions, indexes, apis, config, issue)


class Settled(NamedTuple):
    """`props`: root, kind, entity, prop (target names), type, value, validated, defaults added.
    `indexes`: the same, of index declarations, with their class as `kind`. `references`: root, name, slot,
    target. `levels`: root, name, level of each database, embedded ones included. `issue`: what broke a rule."""

    props: DataFrame
    indexes: DataFrame
    references: DataFrame
    levels: DataFrame
    issue: DataFrame


# Properties of a server that name a database.
SERVER_SLOTS = ["content", "modules"]


def settle(env: Environment, root_collation: str) -> Settled:
    """Check compiled environments and bring them into order: defaults, schemas, references, dependency levels."""
    owner = F.struct("root", "entity").alias("entity")
    records = cut_wide(env.props.select("kind", owner, "id", "name", "prop", "value"), "records")
    plain = ["kind", "entity", "prop", "value"]
    opened = flatten_nested(records.select(*plain), schemas.ALL)
    good, bad = validate(apply_defaults(opened, schemas.ALL), schemas.ALL, nested=False)

    index_schema = schemas.index(root_collation)
    parts = {c: F.col(c) for c in ("type", "positions", "invalid", "collation", "field", "path", "name", "namespace")}
    parts |= {"parent.name": F.col("parent_name"), "parent.namespace": F.col("parent_namespace")}
    rows = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("prop"), v.alias("value"))) for k, v in parts.items()]))
    kind = schemas.index_class(F.col("field"), F.col("path"), F.col("parent_name"))
    whole = F.concat_ws("|", "type", "field", "path", "parent_namespace", "parent_name", "namespace", "name")
    declared = env.indexes.select(kind.alias("kind"), F.struct("root", "entity", whole.alias("index")).alias("entity"), F.inline(rows))
    good_index, bad_index = validate(apply_defaults(declared, index_schema), index_schema, nested=False)

    # A database as one definition again: few properties each, nested ones as they stand.
    given = {c: F.max(F.when(F.col("prop") == c, F.col("value"))) for c in ("id", "name", *SLOTS)}
    parts = F.map_filter(F.create_map(*[x for c, v in given.items() for x in (F.lit(c), v)]), lambda _, v: v.isNotNull())
    bodies = (
        records.filter(F.col("kind") == "database")
        .groupBy(F.col("entity.root").alias("root"), F.to_json(F.array("entity.root", "entity.entity")).alias("key"))
        .agg(parts.alias("parts"))
    )
    nodes, refs, unopened = open_embedded(bodies, keep=("root",), kind="database")
    fields = ["id", "name", "idref", "nameref", "sysref"]
    servers = records.filter((F.col("kind") == "server") & F.col("prop").isin(SERVER_SLOTS)).select(
        F.col("entity.root").alias("root"), F.col("prop").alias("slot"), *[F.get_json_object("value", f"$.{f}").alias(f) for f in fields],
        F.lit(None).cast("string").alias("own_id"), F.col("name").alias("own_name"), F.lit("server").alias("of"),
    )
    refs = refs.select("root", "slot", *fields, "own_id", "own_name", F.lit("database").alias("of"))

    # Names hold within their environment: a list of both, whatever characters they have.
    def scoped(c) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        return F.when(c.isNotNull(), F.to_json(F.array(F.col("root"), c)))

    def part(c: str, n: int) -> Column:
        return F.get(F.from_json(F.col(c), "array<string>"), F.lit(n))

    every = refs.unionByName(servers.filter(F.coalesce(*fields).isNotNull()))
    keyed = every.select("root", "slot", "of", *[scoped(c).alias(c) for c in [*fields, "own_id", "own_name"]])
    databases = cut_wide(nodes.select("root", "id", "name"), "databases")
    found, unresolved = resolve_reference(keyed, databases.select(*[scoped(c).alias(c) for c in ("id", "name")]), own_id="own_id", own_name="own_name")
    references = found.select(
        "root", "of", part("own_name", 1).alias("name"), "slot", F.coalesce(part("target_name", 1), part("target_id", 1)).alias("target")
    )
    edges = found.filter("of = 'database'").select(
        F.coalesce("own_name", "own_id").alias("id"), F.coalesce("target_name", "target_id").alias("dep")
    )
    names = databases.select(scoped(F.coalesce("name", "id")).alias("id")).distinct()
    placed, cycles = topo_levels(names, edges, self_ok=True, kind="database")
    levels = placed.select(part("id", 0).alias("root"), part("id", 1).alias("name"), "level")

    issue = bad
    for more in (bad_index, unopened, unresolved, cycles):
        issue = issue.unionByName(more)
    typed = ["prop", "type", "value"]
    return Settled(
        good.select("entity.root", "kind", "entity.entity", *typed),
        good_index.select("entity.root", "kind", "entity.entity", "entity.index", *typed),
        references, levels, issue,
    )


def _index_settings(declaring: DataFrame) -> Checked:
    """Keys of `indexes` other than `ranges`, as properties `indexes.<key>`.

    There is no rule to merge them by: where several records of an entity declare
    indexes, each such key is an issue.
    """
    record = ["root", "kind", "entity", "id", "name"]
    keys = declaring.select(*record, "rank", F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    several = declaring.groupBy(*record).agg(F.count("*").alias("n"))
    same = [F.col(f"k.{c}").eqNullSafe(F.col(f"n.{c}")) for c in record]
    counted = keys.filter("key <> 'ranges'").alias("k").join(several.alias("n"), same).select("k.*", "n.n")
    good = counted.filter("n = 1").select(
        *record, F.concat(F.lit("indexes."), "key").alias("prop"), "value", F.col("rank.layer").alias("layer")
    )
    return Checked(good, issue_rows(counted.filter("n > 1"), F.col("kind"), F.col("entity"), F.concat(F.lit("indexes."), "key"), "no-merge-rule", F.col("value")))


def _one_list(rows: DataFrame) -> DataFrame:
    """Open the field and path lists, so that only names are left for the merge to open."""
    for c in ("field", "path"):
        rows = rows.withColumn(c, F.explode(F.col(c)))
    return rows


def load_documents(
    files: DataFrame,
    include=None,
    exclude=None,
    garbage=None,
    hook=None,
    collections: list[str] | None = None,
    base: str | None = None,
    n: int = BATCH_SIZE,
) -> DataFrame:
    """Documents of a source set in batches: select, name, give collections, number.

    `files` is a scan or a manifest with `path`. Contents are not read; attach
    them to the batches when delivering.
    """
    kept = derive_uri(select_paths(files, include, exclude, garbage, hook), base).good
    if "collections" not in kept.columns:
        kept = kept.withColumn("collections", F.lit(None).cast("array<string>"))
    else:
        kept = kept.withColumn("collections", list_column(kept, "collections"))
    default = F.array(*[F.lit(c) for c in collections or []]).cast("array<string>")
    named = effective_collections(kept, default)
    return batch_documents(named, ["uri", "full"], n)
