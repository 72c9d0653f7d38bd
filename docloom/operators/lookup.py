"""Reference resolution by id or name, registries, shard placement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import pad_name
from docloom.storage import Checked, apart, cut_wide, issue_rows

# Fixed value: most shards one database may have on one host.
MAX_SHARDS = 100


def _keys(dim: DataFrame, id: str, name: str) -> DataFrame:
    """Every dimension row under its id and, where that is another text, under its name."""
    row = F.struct(*dim.columns)
    return (
        dim.select(
            row.alias("__row"),
            F.explode(
                F.when(F.col(id).eqNullSafe(F.col(name)), F.array(F.col(id))).otherwise(
                    F.array(F.col(id), F.col(name))
                )
            ).alias("__key"),
        )
        .filter(F.col("__key").isNotNull())
    )


def lookup_unique(refs: DataFrame, dim: DataFrame, ref: str, id: str, name: str) -> Checked:
    """Resolve each reference to the one record with that id or that name.

    Matching "id or name" directly would compare all pairs. Here the records are
    keyed both ways, reduced to one row per key with the number of candidates,
    and met by the references in a single equi-join. No match leaves the
    record's columns null; several are an issue, one row per candidate, and
    leave them null as well.
    """
    keys = _keys(dim, id, name)
    index = keys.groupBy("__key").agg(
        F.count("*").alias("__n"), F.first("__row").alias("__row")
    )
    one = F.when(F.col("__n") == 1, F.col("__row"))
    joined = refs.join(index, refs[ref] == index["__key"], "left")
    good = joined.select(
        *[refs[c] for c in refs.columns], *[one[c].alias(c) for c in dim.columns]
    )
    wanted = refs.select(F.col(ref).alias("__key")).distinct()
    several = index.filter(F.col("__n") > 1).join(wanted, "__key", "left_semi").select("__key")
    listed = keys.join(several, "__key")
    return Checked(
        good,
        issue_rows(
            listed,
            "reference",
            F.col("__key"),
            ref,
            "ambiguous",
            F.concat_ws("/", F.col(f"__row.{id}"), F.col(f"__row.{name}")),
        ),
    )


def resolve_targets(sources: DataFrame, first: DataFrame, second: DataFrame, target: str, id: str, name: str) -> DataFrame:
    """Explode a target list and resolve each name, in the first table or else in the second.

    Adds `target_kind` (`first`, `second` or null) and `target_key`, the resolved id or name.
    """

    def key(df: DataFrame, label: str, rank: int) -> DataFrame:
        rows = df.select(F.col(id).cast("string").alias("__i"), F.col(name).cast("string").alias("__n"))
        return _keys(rows, "__i", "__n").select(
            "__key",
            F.lit(rank).alias("__rank"),
            F.lit(label).alias("__kind"),
            F.coalesce("__row.__i", "__row.__n").alias("__found"),
        )

    index = (
        key(first, "first", 0)
        .unionByName(key(second, "second", 1))
        .groupBy("__key")
        .agg(F.min(F.struct("__rank", "__kind", "__found")).alias("__hit"))
    )
    each = sources.withColumn(target, F.explode(F.col(target)))
    return (
        each.join(apart(index), each[target] == index["__key"], "left")
        .withColumns({"target_kind": F.col("__hit.__kind"), "target_key": F.col("__hit.__found")})
        .drop("__key", "__hit")
    )


# The order in which the parts of a reference are tried.
REFERENCE_ORDER = ["name", "nameref", "id", "idref", "sysref"]


def resolve_reference(
    refs: DataFrame,
    dim: DataFrame,
    order: list[str] | None = None,
    id: str = "id",
    name: str = "name",
    own_id: str | None = None,
    own_name: str | None = None,
) -> Checked:
    """Resolve references that may carry a name, an id or both, in order of preference.

    `id` and `idref` are looked up among ids, the rest among names. What a
    reference resolves to depends on those parts alone, so each distinct
    combination is resolved once: its parts become candidate rows, meet the keyed
    records in one equi-join, and the best-ranked hit wins. `resolution` is the
    part that hit (an issue if there is none), `self` for a reference to its own holder (`own_id`,
    `own_name`), `system` for an unmatched system name (which stands for
    itself), or null: an issue.
    """
    order = order or REFERENCE_ORDER
    parts = [p for p in order if p in refs.columns]
    by_id = dim.select(F.lit("id").alias("__space"), F.col(id).alias("__key"), F.struct(id, name).alias("__hit"))
    by_name = dim.select(F.lit("name").alias("__space"), F.col(name).alias("__key"), F.struct(id, name).alias("__hit"))
    index = (
        by_id.unionByName(by_name)
        .filter(F.col("__key").isNotNull())
        .groupBy("__space", "__key")
        .agg(F.min("__hit").alias("__hit"))
    )
    options = [
        F.struct(
            F.lit(n).alias("__rank"),
            F.lit(p).alias("__part"),
            F.lit("id" if p in ("id", "idref") else "name").alias("__space"),
            F.col(p).alias("__key"),
        )
        for n, p in enumerate(parts)
    ]
    candidates = (
        refs.select(*parts)
        .distinct()
        .select(*parts, F.inline(F.array(*options)))
        .filter(F.col("__key") != "")
    )
    best = (
        candidates.join(apart(index), ["__space", "__key"])
        .groupBy(*[F.col(p).alias(f"__of_{p}") for p in parts])
        .agg(F.min_by(F.struct("__part", "__hit"), "__rank").alias("__best"))
    )
    same = [refs[p].eqNullSafe(best[f"__of_{p}"]) for p in parts]

    def part(p: str) -> Column:
        return F.col(p) if p in parts else F.lit(None).cast("string")

    def own(column: str | None) -> Column:
        return F.col(column) if column else F.lit(None).cast("string")

    is_self = F.coalesce(part("idref") == own(own_id), F.lit(False)) | F.coalesce(
        part("nameref") == own(own_name), F.lit(False)
    )
    resolution = F.coalesce(
        F.col("__best.__part"),
        F.when(is_self, F.lit("self")),
        F.when(part("sysref") != "", F.lit("system")),
    )
    resolved = (
        refs.join(best, same, "left")
        .withColumn("resolution", resolution)
        .withColumns(
            {
                "target_id": F.when(F.col("resolution") == "self", own(own_id)).otherwise(F.col(f"__best.__hit.{id}")),
                "target_name": F.when(F.col("resolution") == "self", own(own_name))
                .when(F.col("resolution") == "system", part("sysref"))
                .otherwise(F.col(f"__best.__hit.{name}")),
            }
        )
        .select(*refs.columns, "resolution", "target_id", "target_name")
    )
    # both results come from here: resolve once
    resolved = cut_wide(resolved, "references")
    return Checked(
        resolved.filter(F.col("resolution").isNotNull()),
        issue_rows(
            resolved.filter(F.col("resolution").isNull()),
            "reference",
            F.coalesce(own(own_id), own(own_name)),
            "reference",
            "unresolved",
            F.concat_ws("|", *[F.col(p) for p in parts]),
        ),
    )


def registry_lookup(refs: DataFrame, local: DataFrame, remote: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Attach `value` from two registries, the local one first; no match stays null.

    An empty local value does not count as declared.
    """
    ranked = local.select(*keys, value, F.lit(0).alias("__rank")).unionByName(
        remote.select(*keys, value, F.lit(1).alias("__rank"))
    )
    registry = (
        ranked.filter(F.col(value).isNotNull() & (F.col(value).cast("string") != ""))
        .groupBy(*keys)
        .agg(F.min(F.struct("__rank", value))[value].alias(value))
    )
    return refs.join(apart(registry), keys, "left")


def shard_plan(dbs: DataFrame, hosts: DataFrame, on: list[str], db: str = "db", count: str = "shards", ordinal: str = "ordinal", host: str = "host") -> Checked:
    """Named shards of each database: `1..count` on every host of its cluster.

    `on` names the cluster (environment) columns of both sides, so databases
    meet only the hosts that serve them, by equi-join. A missing count means one,
    zero disables; `ordinal` is the host's place in its cluster, from 1.
    """
    n = F.coalesce(F.col(count), F.lit(1))
    counted = dbs.withColumn(count, n)
    allowed = (F.col(count) >= 0) & (F.col(count) <= MAX_SHARDS)
    placed = (
        counted.filter(allowed & (F.col(count) > 0))
        .join(hosts, on)
        .withColumn("shard", F.explode(F.sequence(F.lit(1), F.col(count).cast("int"))))
        .withColumn("shard_name", pad_name(F.col(db).cast("string"), F.col(ordinal), F.col("shard")))
    )
    return Checked(
        placed,
        issue_rows(
            counted.filter(~allowed),
            "database",
            F.col(db),
            count,
            F.when(F.col(count) < 0, "negative-count").otherwise("count-above-100"),
            F.col(count),
        ),
    )


def assert_uniform(shards: DataFrame, hosts: DataFrame, on: list[str], db: str = "db", host: str = "host") -> DataFrame:
    """Issues of explicit shard lists: a host on all or on none, and without hosts exactly one in the cluster.

    `hosts` has one row per host and cluster `on`.
    """
    per_db = shards.groupBy(*on, db).agg(
        F.count("*").alias("__all"), F.count(F.nullif(F.col(host), F.lit(""))).alias("__with")
    )
    per_cluster = hosts.groupBy(*on).agg(F.count("*").alias("__hosts"))
    joined = per_db.join(per_cluster, on, "left").withColumn("__hosts", F.coalesce("__hosts", F.lit(0)))
    mixed = (F.col("__with") > 0) & (F.col("__with") < F.col("__all"))
    homeless = (F.col("__with") == 0) & (F.col("__hosts") != 1)
    return issue_rows(
        joined.filter(mixed | homeless),
        "database",
        F.col(db),
        "shards",
        F.when(mixed, "mixed-hosts").otherwise("no-single-host"),
        F.when(mixed, F.col("__with")).otherwise(F.col("__hosts")),
    )


def placement_check(plan: DataFrame, actual: DataFrame, hosts: DataFrame, on: list[str], name: str = "shard_name", host: str = "host") -> Checked:
    """Planned shards whose host is declared and does not contradict an existing shard.

    Adds `exists`. `actual` has the existing shards' name and host.
    """
    known = hosts.select(*on, host).distinct().withColumn("__known", F.lit(True))
    there = actual.groupBy(name).agg(F.min(host).alias("__actual_host"))
    checked = plan.join(known, [*on, host], "left").join(there, name, "left")
    rule = F.when(F.col("__known").isNull(), "no-such-host").when(
        F.col("__actual_host") != F.col(host), "host-differs"
    )
    checked = checked.withColumn("__rule", rule).withColumn("exists", F.col("__actual_host").isNotNull())
    return Checked(
        checked.filter(F.col("__rule").isNull()).drop("__known", "__actual_host", "__rule"),
        issue_rows(
            checked.filter(F.col("__rule").isNotNull()),
            "shard",
            F.col(name),
            "host",
            F.col("__rule"),
            F.concat_ws(" vs. ", F.col(host).cast("string"), F.col("__actual_host").cast("string")),
        ),
    )
