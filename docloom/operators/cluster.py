"""What compiled environments say about security and placement: privileges and roles in order, their actions, the
targets of sources, and where the shards of databases go."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.values import split_list
from docloom.operators.environment import Environment
from docloom.operators.graph import topo_levels
from docloom.operators.lookup import assert_uniform, placement_check, registry_lookup, resolve_targets, shard_plan
from docloom.storage import cut_wide, issue_rows

PRIVILEGES = ["execute", "uri"]


class Security(NamedTuple):
    """`levels`: root, kind (execute, uri or role), name, level. `grants`: root, role, kind, privilege, action. `issue`."""

    levels: DataFrame
    grants: DataFrame
    issue: DataFrame


class Cluster(NamedTuple):
    """`targets`: root, source, target, of (server or database), key. `shards`: root, db, shard, host, exists. `issue`."""

    targets: DataFrame
    shards: DataFrame
    issue: DataFrame


def _listed(value: Column) -> Column:
    """A JSON list, or delimited text."""
    return F.when(F.ltrim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(split_list(value))


def _key(*parts: Column) -> Column:
    """Several texts as one, whatever characters they have."""
    return F.to_json(F.array(*parts))


def _part(key: str, n: int) -> Column:
    return F.get(F.from_json(F.col(key), "array<string>"), F.lit(n))


def _records(env: Environment, kinds: list[str]) -> DataFrame:
    """Properties of records of these kinds, written, by the record's name."""
    named = env.props.filter(F.col("kind").isin(kinds) & F.col("name").isNotNull())
    return cut_wide(named.select("root", "kind", "name", "id", "prop", "value"), "records")


def settle_security(env: Environment, registry: DataFrame | None = None) -> Security:
    """Privileges and roles by dependency level, and the action of each privilege that a role is granted.

    A privilege depends on its roles, a role on its roles and privileges; names of what is not declared are no
    dependency. Names hold within an environment, and per kind. An action comes from the environment's own privilege
    of that name, or else from `registry` (`kind, privilege, action`); without either the grant is an issue, as are cycles.
    """
    records = _records(env, [*PRIVILEGES, "role"])
    nodes = records.select(_key(F.col("root"), F.col("kind"), F.col("name")).alias("id")).distinct()
    given = records.filter(F.col("value").isNotNull())
    on_roles = given.filter("prop = 'roles'").select("root", "kind", "name", F.lit("role").alias("on"), F.explode(_listed(F.col("value"))).alias("item"))
    held = given.filter("kind = 'role' AND prop = 'privileges'").select("root", "kind", "name", F.explode(F.from_json("value", "map<string,string>")).alias("on", "names"))
    held = held.select("root", "kind", "name", "on", F.explode(_listed(F.col("names"))).alias("item"))
    links = on_roles.unionByName(held.filter(F.col("on").isin(PRIVILEGES)))
    edges = links.select(_key(F.col("root"), F.col("kind"), F.col("name")).alias("id"), _key(F.col("root"), F.col("on"), F.col("item")).alias("dep"))
    placed, cycles = topo_levels(nodes, edges, kind="security")
    levels = placed.select(_part("id", 0).alias("root"), _part("id", 1).alias("kind"), _part("id", 2).alias("name"), "level")

    refs = held.filter(F.col("on").isin(PRIVILEGES)).select("root", F.col("name").alias("role"), F.col("on").alias("kind"), F.col("item").alias("privilege"))
    own = given.filter(F.col("kind").isin(PRIVILEGES) & (F.col("prop") == "action")).select("root", "kind", F.col("name").alias("privilege"), F.col("value").alias("action"))
    keys = ["root", "kind", "privilege"]
    wanted = refs.select(*keys).distinct()
    remote = wanted.join(registry.select("kind", "privilege", "action"), ["kind", "privilege"]) if registry is not None else own.limit(0)
    grants = cut_wide(registry_lookup(refs, own, remote.select(*keys, "action"), keys, "action"), "grants")
    odd = held.filter(~F.col("on").isin(PRIVILEGES))
    issue = (
        cycles.unionByName(issue_rows(grants.filter("action IS NULL"), "role", F.struct("root", "role"), F.col("kind"), "no-action", F.col("privilege")))
        .unionByName(issue_rows(odd, "role", F.struct("root", "name"), F.concat(F.lit("privileges."), "on"), "unknown-property", F.col("item")))
    )
    return Security(levels, grants.filter("action IS NOT NULL").select("root", "role", "kind", "privilege", "action"), issue)


def settle_cluster(env: Environment, existing: DataFrame | None = None) -> Cluster:
    """Targets of sources among servers and databases, and the shards of each database on the hosts of its environment.

    A database's `forests` is a number (of shards on each host; none given means one) or a list of names or of objects with `name`
    and `host`. Listed ones must name declared hosts, all or none; without hosts there must be one shard and one host. `existing`
    shards (`root, name, host`) must not be on another host. What breaks a rule is an issue.
    """
    records = _records(env, ["host", "database", "server", "source"])
    given = records.filter(F.col("value").isNotNull())
    wanted = given.filter("kind = 'source' AND prop = 'target'").select("root", F.col("name").alias("source"), _listed(F.col("value")).alias("target"))
    scoped = wanted.withColumn("target", F.transform("target", lambda t: _key(F.col("root"), t)))

    def keyed(kind: str) -> DataFrame:
        one = records.filter(F.col("kind") == kind).groupBy("root", "name").agg(F.max("id").alias("id"))
        return one.select(F.when(F.col("id").isNotNull(), _key(F.col("root"), F.col("id"))).alias("id"), _key(F.col("root"), F.col("name")).alias("name"))

    met = cut_wide(resolve_targets(scoped, keyed("server"), keyed("database"), "target", "id", "name"), "targets")
    of = F.when(F.col("target_kind") == "first", "server").when(F.col("target_kind") == "second", "database")
    targets = met.select("root", "source", _part("target", 1).alias("target"), of.alias("of"), _part("target_key", 1).alias("key"))
    issues = [issue_rows(targets.filter("of IS NULL"), "source", F.struct("root", "source"), "target", "unresolved", F.col("target"))]

    # a cluster has few hosts
    place = F.row_number().over(Window.partitionBy("root").orderBy("name"))
    hosts = cut_wide(records.filter("kind = 'host'").select("root", "name").distinct().select("root", F.col("name").alias("host"), place.alias("ordinal")), "hosts")
    spoken = F.max(F.when(F.col("prop") == "forests", F.col("value")))
    dbs = records.filter("kind = 'database'").groupBy("root", F.col("name").alias("db")).agg(spoken.alias("forests"))
    number = F.col("forests").rlike(r"^-?[0-9]{1,9}\z")
    counted = dbs.filter(F.col("forests").isNull() | number).select("root", "db", F.col("forests").cast("int").alias("shards"))
    planned, bad = shard_plan(counted, hosts, ["root"])
    issues.append(bad)
    items = F.from_json("forests", "array<string>")
    others = dbs.filter(F.col("forests").isNotNull() & ~number)
    issues.append(issue_rows(others.filter(items.isNull()), "database", F.struct("root", "db"), "forests", "no-number-or-list", F.col("forests")))
    fields = F.from_json("item", "map<string,string>")
    each = others.filter(items.isNotNull()).select("root", "db", F.explode(items).alias("item"))
    listed = cut_wide(each.select("root", "db", F.coalesce(fields["name"], "item").alias("shard_name"), fields["host"].alias("host")), "listed")
    issues.append(assert_uniform(listed, hosts.select("root", "host"), ["root"], "db", "host"))
    # without a host: on the only one, if there is one
    alone = hosts.groupBy("root").agg(F.min("host").alias("only"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    housed = listed.join(alone, "root", "left").withColumn("host", F.coalesce(F.nullif("host", F.lit("")), "only")).select("root", "db", "shard_name", "host")
    plan = planned.select("root", "db", "shard_name", "host").unionByName(housed.filter("host IS NOT NULL"))
    none = F.lit(None).cast("string")
    there = existing.select(_key(F.col("root"), F.col("name")).alias("key"), "host") if existing is not None else hosts.limit(0).select(none.alias("key"), none.alias("host"))
    rooted = plan.withColumn("key", _key(F.col("root"), F.col("shard_name")))
    good, misplaced = placement_check(rooted, there, hosts.select("root", "host"), ["root"], name="key")
    issues.append(misplaced)
    shards = good.select("root", "db", F.col("shard_name").alias("shard"), "host", "exists")
    return Cluster(targets.filter("of IS NOT NULL"), shards, reduce(DataFrame.unionByName, issues))
