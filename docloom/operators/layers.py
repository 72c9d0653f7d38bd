"""Layered merge: override, hide, explicit null, defaults.

Layered metadata is kept in long form, one row per *present* property. A row
with a null value is an explicit null, which hides what lies below it; no row
at all means absent, which does not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.storage import Checked, issue_rows, missing_if_empty


def resolve_identity(keys: DataFrame, scope: list[str]) -> Checked:
    """Entity of each distinct `(scope, kind, id, name)`, seen first at `rank`.

    A record belongs to the entity with its id, or else to the one with its
    name. An entity goes by the first id and the first name it is given; names
    of overridden records are no alias. An id first seen under another entity's
    name is taken in by that entity and reported, as the outcome then hangs on
    the order of layers.
    """
    kind = [*scope, "kind"]
    ids = (
        keys.filter(F.col("id").isNotNull())
        .groupBy(*kind, "id")
        .agg(
            F.min("rank").alias("id_rank"),
            F.min_by("name", F.when(F.col("name").isNotNull(), F.col("rank"))).alias("first_name"),
        )
    )
    owners = (
        ids.filter(F.col("first_name").isNotNull())
        .groupBy(*kind, F.col("first_name").alias("name"))
        .agg(F.min(F.struct("id_rank", "id")).alias("o"))
        .select(*kind, "name", F.col("o.id").alias("owner"), F.col("o.id_rank").alias("owner_rank"))
    )
    known = keys.join(owners, [*kind, "name"], "left").join(ids, [*kind, "id"], "left")
    taken = (
        F.col("id").isNotNull()
        & (F.col("owner") != F.col("id"))
        & (F.col("owner_rank") < F.col("id_rank"))
    )
    entity = (
        F.when(taken, F.concat(F.lit("id:"), F.col("owner")))
        .when(F.col("id").isNotNull(), F.concat(F.lit("id:"), F.col("id")))
        .when(F.col("owner").isNotNull(), F.concat(F.lit("id:"), F.col("owner")))
        .when(F.col("name").isNotNull(), F.concat(F.lit("name:"), F.col("name")))
    )
    resolved = known.withColumn("entity", entity)
    return Checked(
        resolved.select(*kind, "id", "name", "entity"),
        issue_rows(resolved.filter(taken), F.col("kind"), F.col("entity"), "id", "identity-conflict", F.col("id")),
    )


def place_records(props: DataFrame, scope: list[str] | None = None) -> Checked:
    """Add `entity` and `rank` to the property rows of all layers.

    The distinct identities are resolved apart, and meet the properties in one
    equi-join; rows without id and name are issues.
    """
    kind = [*(scope or []), "kind"]
    props = props.withColumns(
        {
            "id": missing_if_empty("id"),
            "name": missing_if_empty("name"),
            "compose": F.coalesce(missing_if_empty("compose"), F.lit("merge")),
            "rank": F.struct("layer", "pos"),
        }
    )
    nameless = props.filter(F.col("id").isNull() & F.col("name").isNull())
    props = props.filter(F.col("id").isNotNull() | F.col("name").isNotNull())
    keys = props.groupBy(*kind, "id", "name").agg(F.min("rank").alias("rank"))
    identity, conflict = resolve_identity(keys, kind[:-1])
    same = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in kind]
    same += [F.col(f"p.{c}").eqNullSafe(F.col(f"i.{c}")) for c in ("id", "name")]
    placed = props.alias("p").join(identity.alias("i"), same).select("p.*", "i.entity")
    issue = issue_rows(nameless, F.col("kind"), None, F.col("prop"), "no-id-and-no-name", F.col("value"))
    return Checked(placed, issue.unionByName(conflict))


def surviving(props: DataFrame, scope: list[str] | None = None) -> Checked:
    """The property rows that count, by what their entity's records say on composing.

    Input rows: `kind, layer, pos, id, name, compose, prop, value`, and the
    `scope` columns where several environments are merged at once. `layer` may
    be any orderable value, the lowest being the most derived; `pos` orders the
    records inside a layer, which merge too. For each entity:

    * `compose = merge` (the default): all of its records count;
    * `compose = hide`: only the first record counts; whatever lies below it is
      gone, its id and name included, and the entity goes by the first record's own;
    * differing or unknown compose values are issues and the entity is left out.

    Adds `entity` and `rank`; `id` and `name` are the entity's. Whole entities are
    decided here, once for all that is merged from their properties.
    """
    kind = [*(scope or []), "kind"]
    placed, issue = place_records(props, scope)

    def first_given(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.col("rank"))).alias(f"__{c}")

    # Map-side partials: an entity in very many layers arrives as one row per task.
    heads = placed.groupBy(*kind, "entity").agg(
        F.min("rank").alias("__founder"),
        F.min_by(F.struct("id", "name"), "rank").alias("__first"),
        F.min("compose").alias("__low"),
        F.max("compose").alias("__high"),
        first_given("id"),
        first_given("name"),
    )
    mixed = F.col("__low") != F.col("__high")
    unknown = ~F.col("__low").isin("merge", "hide")
    hide = F.col("__low") == "hide"
    own = F.coalesce(F.concat(F.lit("id:"), "__first.id"), F.concat(F.lit("name:"), "__first.name"))
    decided = heads.filter(~mixed & ~unknown).select(
        *kind,
        "entity",
        F.when(hide, F.col("__founder")).alias("__only"),
        F.when(hide, own).otherwise(F.col("entity")).alias("__label"),
        F.when(hide, F.col("__first.id")).otherwise(F.col("__id")).alias("__id"),
        F.when(hide, F.col("__first.name")).otherwise(F.col("__name")).alias("__name"),
    )
    named = {"entity", "id", "name"}
    good = (
        placed.join(decided, [*kind, "entity"])
        .filter(F.col("__only").isNull() | (F.col("rank") == F.col("__only")))
        .select(
            *[c for c in placed.columns if c not in named],
            F.col("__label").alias("entity"), F.col("__id").alias("id"), F.col("__name").alias("name"),
        )
    )
    return Checked(
        good,
        issue.unionByName(
            issue_rows(
                heads.filter(mixed | unknown),
                F.col("kind"),
                F.col("entity"),
                "compose",
                F.when(mixed, "different-compose").otherwise("unknown-compose"),
                F.when(mixed, F.concat_ws("|", "__low", "__high")).otherwise(F.col("__low")),
            )
        ),
    )


def first_values(survivors: DataFrame, special: tuple[str, ...] = (), scope: list[str] | None = None) -> DataFrame:
    """Per entity and property the value of its first surviving record, an explicit null included."""
    keys = [*(scope or []), "kind", "entity", "id", "name", "prop"]
    rows = survivors.filter(~F.col("prop").isin(list(special))) if special else survivors
    return (
        rows.groupBy(*keys)
        .agg(F.min_by(F.struct("value", "rank"), "rank").alias("w"))
        .select(*keys, F.col("w.value").alias("value"), F.col("w.rank.layer").alias("layer"))
    )


def layered_merge(props: DataFrame, special: tuple[str, ...] = (), scope: list[str] | None = None) -> Checked:
    """Merge the records of all layers into one per entity, property by property: `surviving`, then `first_values`.

    Properties in `special` are left to their own merge (`merge_indexes`,
    `layered_permissions`), which starts from the same surviving rows.
    """
    survivors, issue = surviving(props, scope)
    return Checked(first_values(survivors, special, scope), issue)


def layered_permissions(grants: DataFrame, keys: list[str]) -> DataFrame:
    """`merge_permissions` over any number of layers: per role the first non-empty entry wins.

    `grants`: `keys`, `role`, `value`, `rank`. A role with only empty entries keeps one.
    """
    empty = F.coalesce(F.col("value") == "", F.lit(True))
    return (
        grants.groupBy(*keys, "role")
        .agg(F.min_by(F.struct("value"), F.struct(empty, F.col("rank"))).alias("__w"))
        .select(*keys, "role", F.col("__w.value").alias("value"))
    )


# Parameters that describe one module and are never inherited.
OWN_PARAMS = ["@title", "@desc"]


def precedence_lookup(values: DataFrame, keys: list[str], priority: list[str], value: str = "value", own: Column | None = None) -> DataFrame:
    """First value per key in order of `priority`; an explicit null stops the search.

    For parameters and config the priorities come from `flatten_imports`'s
    `path_last` (the last import wins), below those given explicitly. `own` is
    true on rows of the asking module; `@title` and `@desc` count only there.
    """
    if own is not None:
        values = values.filter(~F.col(keys[-1]).isin(OWN_PARAMS) | own)
    return (
        values.groupBy(*keys)
        .agg(F.min_by(F.struct(value), F.struct(*priority)).alias("__w"))
        .select(*keys, F.col(f"__w.{value}").alias(value))
    )


def multiply(df: DataFrame, field: str, position: str | None = None) -> DataFrame:
    """One row per member of a list field, the rest copied; a scalar field passes.

    An empty list gives no row.
    """
    if not isinstance(df.schema[field].dataType, T.ArrayType):
        return df.withColumn(position, F.lit(0)) if position else df
    if position is None:
        return df.withColumn(field, F.explode(F.col(field)))
    others = [c for c in df.columns if c != field]
    return df.select(*others, F.posexplode(F.col(field)).alias(position, field)).select(*df.columns, position)


# What identifies a range index, missing and empty being the same.
INDEX_KEY = ["type", "path", "field", "parent_name", "parent_namespace", "name", "namespace"]


def _with_index_key(df: DataFrame) -> DataFrame:
    def text(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit("")) if c in df.columns else F.lit("")

    by_path = text("path") != ""
    parts = {f"__k_{c}": text(c) for c in ("type", "path")}
    # a path alone identifies a path index
    parts |= {f"__k_{c}": F.when(by_path, "").otherwise(text(c)) for c in INDEX_KEY[2:]}
    return df.withColumns(parts)


def merge_indexes(derived: DataFrame, base: DataFrame, scope: list[str] | None = None, pos: str = "pos") -> DataFrame:
    """Range indexes of a record over those of its base, list names expanded.

    All derived ones stay, in order; then come the base ones no derived index
    equals, the first of each where the base repeats itself. Both inputs share a
    schema with `type`, `pos` and any of `path, field, parent_name,
    parent_namespace, name, namespace`. Output adds `side` (0 derived, 1 base),
    `pos` and `sub` for the order.

    Field indexes are compared by their field, too. Without that, all field
    indexes of one scalar type would count as one (a deliberate divergence).
    """
    scope = list(scope or [])
    key = [f"__k_{c}" for c in INDEX_KEY]

    def expanded(df: DataFrame, side: int) -> DataFrame:
        for field in ("name", "path", "field"):
            if field in df.columns and isinstance(df.schema[field].dataType, T.ArrayType):
                # a list in one of them is the one field allowed to multiply
                wide = df.withColumn(field, F.coalesce(F.col(field), F.array(F.lit(None).cast("string"))))
                df = multiply(wide, field, f"__sub_{field}")
        subs = [c for c in df.columns if c.startswith("__sub_")]
        sub = F.greatest(F.lit(0), *[F.col(c) for c in subs]) if subs else F.lit(0)
        return _with_index_key(df.withColumns({"side": F.lit(side), "sub": sub}).drop(*subs))

    d, b = expanded(derived, 0), expanded(base, 1)
    columns = [c for c in b.columns if c not in scope and c not in key]
    once = (
        b.groupBy(*scope, *key)
        .agg(F.min_by(F.struct(*columns), F.struct(pos, "sub")).alias("__first"))
        .select(*scope, *key, "__first.*")
    )
    added = once.join(d.select(*scope, *key).distinct(), [*scope, *key], "left_anti")
    return d.drop(*key).unionByName(added.drop(*key), allowMissingColumns=True)


def union_names(layers: DataFrame, keys: list[str] | None = None, name: str = "name", pos: list[str] | str = "pos", hide_system: bool = False) -> DataFrame:
    """Distinct names over all layers, each with the place it was first seen at.

    `hide_system` leaves out names starting with `@`.
    """
    pos = [pos] if isinstance(pos, str) else pos
    if hide_system:
        layers = layers.filter(~F.col(name).startswith("@"))
    first = F.min(F.struct(*pos)) if len(pos) > 1 else F.min(pos[0])
    return layers.groupBy(*(keys or []), name).agg(first.alias("first_seen"))


# Endpoints of the known APIs where an environment does not override them.
DEFAULT_APIS = [
    ("manage", "root", "/manage/v2"),
    ("manage", "port", "8002"),
    ("manage", "ssl", "false"),
    ("rest", "root", "/v1"),
    ("rest", "port", "8002"),
    ("rest", "ssl", "false"),
    ("admin", "root", "/admin/v1"),
    ("admin", "port", "8001"),
    ("admin", "ssl", "false"),
    ("client", "root", "/v1"),
    ("client", "port", "8000"),
    ("client", "ssl", "false"),
    ("xdbc", "root", ""),
    ("xdbc", "port", "8000"),
    ("xdbc", "ssl", "false"),
]


def overlay_defaults(overrides: DataFrame, scope: list[str], priority: list[str], defaults=DEFAULT_APIS, value: str = "value") -> Checked:
    """Collapse overrides by priority, then fill in the default where the winner is falsy.

    `overrides` has `scope` columns, `api, prop, value` and the priority.
    Every scope (environment) gets every one of the hand-written `defaults`, as
    literals. Names without a default stay out and are reported. An override of
    `0`, `false` or the empty string counts as missing, as does an explicit null.
    """
    over = precedence_lookup(overrides, [*scope, "api", "prop"], priority, value).withColumnRenamed(value, "__over")
    rows = F.array(
        *[F.struct(F.lit(a).alias("api"), F.lit(p).alias("prop"), F.lit(v).alias(value)) for a, p, v in defaults]
    )
    filled = overrides.select(*scope).distinct().select(*scope, F.inline(rows))
    falsy = F.col("__over").isNull() | F.col("__over").isin("", "0", "false")
    good = (
        filled.join(over, [*scope, "api", "prop"], "left")
        .withColumn(value, F.when(falsy, F.col(value)).otherwise(F.col("__over")))
        .drop("__over")
    )
    known = [f"{a}.{p}" for a, p, _ in defaults]
    name = F.concat_ws(".", "api", "prop")
    return Checked(
        good,
        issue_rows(
            over.filter(F.col("api").isNotNull() & ~name.isin(known)),
            "api",
            F.concat_ws("/", *[F.col(s).cast("string") for s in scope]),
            name,
            "unknown-name",
            F.col("__over"),
        ),
    )
