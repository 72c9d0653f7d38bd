"""Dependency levels and import closures."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.values import split_list
from docloom.storage import Checked, apart, cut_wide, cut_wide_observed, issue_rows


def node_key(kind: Column, name: Column) -> Column:
    """Nodes go by kind and name, as different kinds may share a name."""
    return F.concat(kind, F.lit("/"), name)


# Rounds of peeling between two looks for chains; doubled where there are none.
PEEL = 8


def topo_levels(nodes: DataFrame, edges: DataFrame, self_ok: bool = False, kind: str = "node") -> Checked:
    """Level of each node: 0 without dependencies, else above all it depends on.

    `nodes` has `id`; `edges` has `id, dep`. Dependencies on undeclared nodes are
    ignored. Nodes on a cycle or behind one are issues (`cycles` tells them apart). With `self_ok` a node may
    depend on itself.

    Chains go first: each node with one dependency left points at it, and pointers are doubled until
    they end at a node with none or several, so that a chain takes as many rounds as its
    length has binary digits. What depends on a chain then depends on its end, at so
    much greater a distance. Rounds of peeling follow: edges whose dependency is placed are marked, and a node is placed
    above the last of its marked edges when none is left. The edge table only shrinks. It is
    written to the shared folder once a round, and the driver sees a few counters.
    """
    ids = cut_wide(nodes.select("id").distinct(), "nodes")
    edges = _declared(ids, edges)
    if self_ok:
        edges = edges.filter(F.col("id") != F.col("dep"))
    left = cut_wide(edges.select("id", "dep", F.lit(1).alias("weight"), F.lit(0).alias("best")), "edges")
    free = cut_wide(ids.join(left.select("id").distinct(), "id", "left_anti").withColumn("level", F.lit(0)), "placed")
    placed, ready = [free], free
    chains: list[DataFrame] = []
    rounds, n = PEEL, 1
    while n:
        ends = _chain_ends(left)
        if ends is None:
            rounds *= 2
        else:
            chains.append(ends)
            on = ends.select(F.col("id").alias("dep"), "end", "distance")
            onward = left.join(ends.select("id"), "id", "left_anti").join(on, "dep", "left")
            left = onward.select("id", F.coalesce("end", "dep").alias("dep"), (F.col("weight") + F.coalesce("distance", F.lit(0))).alias("weight"), "best")
            left = left.groupBy("id", "dep").agg(F.max("weight").alias("weight"), F.max("best").alias("best"))
            # an edge may now lead to a node that was placed in an earlier round
            ready = apart(reduce(DataFrame.unionByName, placed))
        for _ in range(rounds):
            done = ready.select(F.col("id").alias("dep"), "level")
            flagged, seen = cut_wide_observed(
                left.join(done, "dep", "left").select("id", "dep", "weight", "best", (F.col("level") + F.col("weight")).alias("above")),
                "edges",
                F.count("above").alias("marked"),
                F.count_if(F.col("above").isNull()).alias("left"),
            )
            states = flagged.groupBy("id").agg(
                F.greatest(F.max("best"), F.max("above")).alias("level"), F.count_if(F.col("above").isNull()).alias("open")
            )
            ready = states.filter("open = 0").select("id", "level")
            if seen["marked"]:
                placed.append(ready)
            open_ = flagged.filter(F.col("above").isNull()).select("id", "dep", "weight")
            left = open_.join(states.filter("open > 0").select("id", F.col("level").alias("best")), "id")
            n = seen["marked"] and seen["left"]
            if not n:
                break
    found = reduce(DataFrame.unionByName, placed)
    for ends in reversed(chains):
        at = apart(found.select(F.col("id").alias("end"), "level"))
        found = cut_wide(found.unionByName(ends.join(at, "end").select("id", (F.col("level") + F.col("distance")).alias("level"))), "placed")
    rest = ids.join(apart(found.select("id")), "id", "left_anti")
    return Checked(found, issue_rows(rest, kind, F.col("id"), "level", "cycle", None))


def _declared(ids: DataFrame, edges: DataFrame) -> DataFrame:
    """Each edge once, between nodes that are declared."""
    return (
        edges.select("id", "dep").distinct()
        .join(ids, "id", "left_semi")
        .join(ids.withColumnRenamed("id", "dep"), "dep", "left_semi")
    )


def _chain_ends(edges: DataFrame) -> DataFrame | None:
    """Per node with one edge: `end`, the first node down its chain that has none or several, and the `distance`; None if there
    is no such node. Chains that run into a ring have no end and are left out."""
    single = edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("end"), F.max("weight").alias("distance"))
    ends, seen = cut_wide_observed(single.filter("n = 1").select("id", "end", "distance"), "chains", F.count(F.lit(1)).alias("n"))
    if not seen["n"]:
        return None
    names = ends.select(F.col("id").alias("end"))
    for _ in range(int(seen["n"]).bit_length() + 1):
        ends, more = _doubled(ends)
        if not more:
            return ends
    return cut_wide(ends.join(names, "end", "left_anti").select("id", "end", "distance"), "chains")


def _doubled(ends: DataFrame) -> tuple[DataFrame, int]:
    """Pointers (`id`, `end`, `distance`), each followed by the one at its end; and how many had one there."""
    on = ends.select(F.col("id").alias("via"), F.col("end").alias("far"), F.col("distance").alias("more"))
    joined = ends.join(on, F.col("end") == F.col("via"), "left")
    doubled = joined.select(
        "id", F.coalesce("far", "end").alias("end"), (F.col("distance") + F.coalesce("more", F.lit(0))).alias("distance"), F.col("via").isNotNull().alias("on")
    )
    written, seen = cut_wide_observed(doubled, "chains", F.count_if("on").alias("more"))
    return written.select("id", "end", "distance"), seen["more"]


def cycles(nodes: DataFrame, edges: DataFrame, self_ok: bool = False) -> DataFrame:
    """Nodes that cannot be placed: `id`, and `cycle`, the least id of the nodes that it is on a cycle with, or null
    where it only depends on a cycle, directly or not.

    What `topo_levels` leaves is parted into strongly connected components. Nodes with a single
    dependency are chains: rings of them alone are found by doubling pointers (what a
    pointer reaches after as many steps as there are nodes is on a ring); the others are
    taken out, and the rest goes through trimming and forward-backward search, all components at once: the least id that
    reaches a node colours it, and what reaches back to the node of that id within the colour is its component. Last,
    nodes on chains that lead from a component back into it are added.
    """
    rest = topo_levels(nodes, edges, self_ok).issue.select(F.col("entity").cast(nodes.schema["id"].dataType).alias("id"))
    ids = cut_wide(rest, "cyclic")
    links = _declared(ids, edges)
    if self_ok:
        links = links.filter(F.col("id") != F.col("dep"))
    links = cut_wide(links.select("id", "dep"), "cyclic-edges")
    degree = links.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("dep").alias("end"))
    single, seen = cut_wide_observed(degree.filter("n = 1").select("id", "end", F.lit(1).alias("distance")), "chains", F.count(F.lit(1)).alias("n"))
    names = single.select(F.col("id").alias("end"))
    # pointers by powers of two steps; those that leave the chains stop at the end
    jumps = [single]
    for _ in range(int(seen["n"]).bit_length() + 1):
        ends, more = _doubled(jumps[-1])
        jumps.append(ends)
        if not more:
            break
    last = jumps[-1]
    ring = last.join(names, "end", "left_semi").select(F.col("end").alias("id")).distinct()
    rings = _ring_names(cut_wide(ring, "rings"), jumps)
    off = last.join(names, "end", "left_anti").select("id", "end")
    on = off.select(F.col("id").alias("dep"), "end")
    inner = links.join(single.select("id"), "id", "left_anti")
    entered = cut_wide(inner.join(on, "dep", "left").select("id", F.col("dep").alias("first"), F.coalesce("end", "dep").alias("dep")), "cyclic-edges")
    parts = _components(entered.select("id", "dep").distinct())
    # chains that lead from a component back into it
    a, b = parts.select("id", F.col("part").alias("from")), parts.select(F.col("id").alias("dep"), F.col("part").alias("to"))
    back = entered.join(a, "id").join(b, "dep").filter(F.col("from") == F.col("to"))
    passed = cut_wide(back.join(single.select(F.col("id").alias("first")), "first", "left_semi").select(F.col("first").alias("id"), F.col("to").alias("part")).distinct(), "passed")
    inside = single.select("id")
    for jump in jumps[:-1]:
        further = passed.join(jump.select("id", "end"), "id").select(F.col("end").alias("id"), "part")
        passed = cut_wide(passed.unionByName(further.join(inside, "id", "left_semi")).distinct(), "passed")
    whole = parts.unionByName(passed)
    least = whole.groupBy("part").agg(F.min("id").alias("cycle"))
    known = whole.join(least, "part").select("id", "cycle").unionByName(rings).distinct()
    return ids.join(known, "id", "left").select("id", "cycle")


def _ring_names(ring: DataFrame, jumps: list[DataFrame]) -> DataFrame:
    """The least id on the ring of each of its nodes: the least over twice as many steps with each jump."""
    named = ring.withColumn("cycle", F.col("id"))
    for jump in jumps:
        ahead = named.select(F.col("id").alias("end"), F.col("cycle").alias("other"))
        named = named.join(jump.select("id", "end"), "id").join(ahead, "end", "left").select("id", F.least("cycle", "other").alias("cycle"))
        named = cut_wide(named, "rings")
    return named


def _components(edges: DataFrame) -> DataFrame:
    """Strongly connected components with a cycle: `id` and `part`, one id of the component. `edges`: `id`, `dep`, each once."""
    left = cut_wide(edges, "components")
    found = left.filter("id = dep").select("id", F.col("id").alias("part"))
    own = cut_wide(found, "components")
    out = [own]
    left = left.filter("id <> dep")
    while True:
        # nodes on a cycle have edges in and out
        while True:
            both = left.select("id").intersect(left.select(F.col("dep").alias("id")))
            kept = left.join(both, "id", "left_semi").join(both.withColumnRenamed("id", "dep"), "dep", "left_semi").select("id", "dep")
            size = left.count()
            left, seen = cut_wide_observed(kept, "components", F.count(F.lit(1)).alias("n"))
            if seen["n"] == size:
                break
        if not seen["n"]:
            break
        vertices = left.select("id").distinct()
        colours = cut_wide(vertices.withColumn("part", F.col("id")), "colours")
        while True:
            passed_on = left.join(colours, "id").groupBy("dep").agg(F.min("part").alias("other"))
            lower = colours.join(passed_on, F.col("id") == F.col("dep"), "left").select(
                "id", F.least("part", "other").alias("part"), (F.col("other") < F.col("part")).alias("changed")
            )
            lower, told = cut_wide_observed(lower, "colours", F.count_if("changed").alias("n"))
            colours = lower.select("id", "part")
            if not told["n"]:
                break
        # back from the node that gave the colour
        of_dep = colours.select(F.col("id").alias("dep"), F.col("part").alias("d_part"))
        same = cut_wide(left.join(colours, "id").join(of_dep, "dep").filter("part = d_part").select("id", "dep", "part"), "colours")
        reached = cut_wide(colours.filter("id = part"), "reached")
        frontier = reached
        while True:
            back = same.join(frontier.select(F.col("id").alias("dep"), "part"), ["dep", "part"]).select("id", "part").distinct()
            frontier, told = cut_wide_observed(back.join(reached.select("id"), "id", "left_anti"), "reached", F.count(F.lit(1)).alias("n"))
            if not told["n"]:
                break
            reached = cut_wide(reached.unionByName(frontier), "reached")
        sizes = reached.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
        out.append(cut_wide(reached.join(sizes.filter("n > 1"), "part").select("id", "part"), "components"))
        gone = reached.select("id")
        left = left.join(gone, "id", "left_anti").join(gone.withColumnRenamed("id", "dep"), "dep", "left_anti").select("id", "dep")
        left = cut_wide(left, "components")
    every = reduce(DataFrame.unionByName, out)
    # a node with an edge to itself that is in a larger component goes by that one
    several = every.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("part") != F.col("id")).alias("other"))
    return every.join(several, "id").filter("n = 1 OR other = (part <> id)").select("id", "part").distinct()


def flatten_imports(edges: DataFrame, roots: DataFrame) -> Checked:
    """Everything each root imports, directly or not, with depth and two precedence keys.

    `edges` has `module, import, pos`; `roots` has `module`. Of all the ways to
    reach a module the first in a depth-first walk counts. `path_first` orders
    modules with the first import winning, `path_last` with the last one
    winning: both are arrays of positions, compared as such (an importer comes
    before what it imports), and serve as priorities as they are. `depth` is the
    length of `path_first`. Import cycles are issues.

    Only the best paths per root and module are kept, and each round extends just
    those that improved, so a module reached in many ways costs one row.
    """
    edges = cut_wide(
        edges.select("module", F.col("import").alias("to"), F.col("pos").cast("int").alias("pos"))
        .groupBy("module", "to")
        .agg(F.min("pos").alias("pos"), F.max("pos").alias("last_pos")),
        "imports",
    )
    start = F.array().cast("array<int>")
    paths = ["path_first", "path_last"]
    frontier = roots.select(
        F.col("module").alias("root"), F.col("module").alias("node"), *[start.alias(p) for p in paths]
    ).distinct()
    frontier = cut_wide(frontier, "closure")
    found = frontier

    def best(rows: DataFrame) -> DataFrame:
        return rows.groupBy("root", "node").agg(*[F.min(p).alias(p) for p in paths])

    while True:
        reached = frontier.join(edges, F.col("node") == F.col("module")).select(
            "root",
            F.col("to").alias("node"),
            F.array_append("path_first", F.col("pos")).alias("path_first"),
            F.array_append("path_last", -F.col("last_pos")).alias("path_last"),
        )
        known = apart(best(found).select("root", "node", *[F.col(p).alias(f"__{p}") for p in paths]))
        joined = best(reached).join(known, ["root", "node"], "left")
        better = F.lit(False)
        for p in paths:
            better = better | F.col(f"__{p}").isNull() | (F.col(p) < F.col(f"__{p}"))
        # only what has improved is written, with the better of each path
        frontier, seen = cut_wide_observed(
            joined.filter(better).select("root", "node", *[F.least(p, f"__{p}").alias(p) for p in paths]),
            "closure",
            F.count("*").alias("n"),
        )
        if not seen["n"]:
            break
        found = found.unionByName(frontier)
    state = cut_wide(best(found), "closure")
    # An edge back to a module whose path leads to the importer closes a cycle.
    back = (
        state.select("root", F.col("node").alias("module"), F.col("path_first").alias("__from"))
        .join(edges, "module")
        .join(state.select("root", F.col("node").alias("to"), F.col("path_first").alias("__to")), ["root", "to"])
        .filter(F.slice("__from", F.lit(1), F.size("__to")) == F.col("__to"))
    )
    good = state.select("root", "node", F.size("path_first").alias("depth"), "path_first", "path_last")
    return Checked(
        good, issue_rows(back, "import", F.col("module"), "import", "cycle", F.col("to"))
    )


# The database slots one definition may hold another in.
SLOTS = ["schema", "security", "triggers"]


_REFERRING = ["idref", "nameref", "sysref"]


class Embedded(NamedTuple):
    """Nodes (`key`, `id`, `name`), references between them, and `issue` for what is no definition."""

    nodes: DataFrame
    refs: DataFrame
    issue: DataFrame


def open_embedded(definitions: DataFrame, slots: list[str] | None = None, keep: tuple[str, ...] = (), kind: str = "definition") -> Embedded:
    """Take nested definitions apart into nodes and the references between them.

    `definitions` has `key` and `parts`, a map of texts with `id`, `name` and, per
    slot, the JSON text of a nested definition or of a reference (`idref`, `nameref`,
    `sysref`); columns named in `keep` go along. References have `key, slot, id, name,
    idref, nameref, sysref, own_id, own_name`, ready for `resolve_reference`. A slot that holds no object, and
    a definition with neither id nor name, are issues. Each round takes one level of nesting off.
    """
    slots = slots or SLOTS
    fields = ["id", "name", *_REFERRING]

    def field(parts: str, f: str) -> Column:
        return F.try_element_at(parts, F.lit(f)).alias(f)

    frontier = cut_wide(definitions.select(*keep, "key", "parts"), "definitions")
    rounds: list[tuple[DataFrame, DataFrame, DataFrame]] = []
    while True:
        here = frontier.select(*keep, "key", field("parts", "id"), field("parts", "name"))
        held = F.array(*[F.struct(F.lit(s).alias("slot"), field("parts", s).alias("child")) for s in slots])
        children = (
            frontier.select(*keep, "key", field("parts", "id").alias("own_id"), field("parts", "name").alias("own_name"), F.inline(held))
            .filter(F.col("child").isNotNull())
            .withColumn("parts", F.from_json("child", "map<string,string>"))
        )
        nameless = here.filter(F.col("id").isNull() & F.col("name").isNull())
        issue = issue_rows(
            children.filter(F.col("parts").isNull()), kind, F.col("key"), F.col("slot"), "not-object", F.col("child")
        ).unionByName(issue_rows(nameless, kind, F.col("key"), "name", "no-name", None))
        sound = children.filter(F.col("parts").isNotNull())
        linked = sound.select(*keep, "key", "slot", *[field("parts", f) for f in fields], "own_id", "own_name")
        known = F.coalesce(*fields).isNotNull()
        rounds.append((here.filter(F.col("id").isNotNull() | F.col("name").isNotNull()), linked.filter(known), issue))
        refers = F.coalesce(*[field("parts", f) for f in _REFERRING]).isNotNull()
        frontier, seen = cut_wide_observed(
            sound.filter(~refers).select(*keep, F.concat_ws("/", "key", "slot").alias("key"), "parts"), "definitions", F.count("*").alias("n")
        )
        if not seen["n"]:
            return Embedded(*[reduce(DataFrame.unionByName, parts) for parts in zip(*rounds)])


def flatten_embedded(definitions: DataFrame, slots: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and references of `open_embedded`, of definitions that are whole JSON texts (`key`, `body`)."""
    parts = F.from_json("body", "map<string,string>").alias("parts")
    found = open_embedded(definitions.select("key", parts).filter(F.col("parts").isNotNull()), slots)
    return found.nodes, found.refs


def privilege_edges(privileges: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges among execute privileges, uri privileges and roles.

    `privileges`: `kind` (execute or uri), `name`, `roles` (delimited text).
    `roles`: `name`, `roles`, `execute`, `uri` (delimited texts).
    """
    nodes = privileges.select(node_key(F.col("kind"), F.col("name")).alias("id")).unionByName(
        roles.select(node_key(F.lit("role"), F.col("name")).alias("id"))
    )

    def links(df: DataFrame, kind: Column, field: str, to: str) -> DataFrame:
        return df.filter(F.col(field).isNotNull()).select(
            node_key(kind, F.col("name")).alias("id"),
            F.explode(F.transform(split_list(F.col(field)), lambda n: node_key(F.lit(to), n))).alias("dep"),
        )

    edges = (
        links(privileges, F.col("kind"), "roles", "role")
        .unionByName(links(roles, F.lit("role"), "roles", "role"))
        .unionByName(links(roles, F.lit("role"), "execute", "execute"))
        .unionByName(links(roles, F.lit("role"), "uri", "uri"))
    )
    return nodes, edges
