import json
import random

import pytest

from pyspark.sql import functions as F


from docloom.operators import graph
from docloom.operators import reconcile as rec
from docloom.operators.extract import extract_issues, extract_rows, lexicon, range_values
from docloom.operators.lookup import resolve_reference
from docloom.operators.validate import Prop
from docloom.streaming.documents import watch_documents, write_batches
from docloom.operators.documents import attach_mime, derive_uri, select_paths
from docloom.storage import fresh_path, local_table

LONG = "kind string, entity string, prop string, value string"
SPECS = [
    Prop("db", "schema"),
    Prop("db", "tags", compare="list"),
    Prop("db", "spaces", compare="map"),
    Prop("db", "permission", compare="perms"),
    Prop("server", "type", frozen=True),
]


def long(spark, *given):
    return spark.createDataFrame(list(given), LONG)


def test_diff_properties(spark):
    desired = long(
        spark,
        ("db", "a", "schema", "s"), ("db", "a", "tags", '["x","y"]'), ("db", "a", "spaces", '{"a":"1"}'),
        ("db", "a", "permission", '[{"r":"1","c":"read"}]'), ("db", "a", "free", "1"), ("db", "a", "range-field-index", "[]"),
        ("server", "s", "type", "http"), ("db", "b", "permission", "[]"), ("db", "b", "schema", None), ("role", "r", "permission", "[]"),
    )
    actual = long(
        spark,
        ("db", "a", "schema", "t"), ("db", "a", "tags", '["y", "x"]'), ("db", "a", "spaces", '{"a":"2"}'),
        ("db", "a", "permission", '[{"c":"read","r":"1"}]'), ("server", "s", "type", "xdbc"), ("db", "a", "undesired", "1"),
    )
    plan, issue = rec.diff_properties(desired, actual, SPECS)
    got = {(r.entity, r.prop): (r.phase, r.old, r.new) for r in plan.collect()}
    assert got == {
        ("a", "schema"): (1, "t", "s"),
        ("a", "spaces"): (1, '{"a":"2"}', '{"a":"1"}'),
        ("a", "free"): (1, None, "1"),
        ("a", "range-field-index"): (2, None, "[]"),
        ("b", "permission"): (1, None, "[]"),
        ("r", "permission"): (2, None, "[]"),
    }
    assert [(r.entity, r.rule) for r in issue.collect()] == [("s", "frozen-differs")]
    assert rec.diff_properties(desired, rec.apply_plan(actual, plan), SPECS).good.count() == 0


def test_diff_reaches_a_fixed_point(spark):
    rng = random.Random(3)

    def state():
        return long(spark, *{(("db"), str(e), p): ("db", str(e), p, rng.choice(["1", "2", "3"])) for e in range(20) for p in rng.sample("pqrs", 3)}.values())

    desired, actual = state(), state()
    plan = rec.diff_properties(desired, actual, []).good
    assert plan.count() > 0
    assert rec.diff_properties(desired, rec.apply_plan(actual, plan), []).good.count() == 0


def test_entities_and_members(spark, rows):
    desired = spark.createDataFrame([("a", False), ("b", False), ("c", True), ("d", True)], "name string, sys boolean")
    actual = spark.createDataFrame([("a",), ("c",), ("z",)], "name string")
    assert rows(rec.reconcile_entities(desired, actual, ["name"], F.col("sys")), "name", "verb") == [
        ("a", "check"), ("b", "create"), ("c", "check"), ("d", "missing"),
    ]
    want = spark.createDataFrame([("d", "f1"), ("d", "f2"), ("d", "f3")], "db string, name string")
    have = spark.createDataFrame([("d", "f1"), ("d", "f9"), ("e", "f2")], "db string, name string")
    assert rows(rec.reconcile_members(want, have, have, ["db"], "name")) == [
        ("d", "f1", "check"), ("d", "f2", "attach"), ("d", "f3", "create"), ("d", "f9", "detach"), ("e", "f2", "detach"),
    ]


def test_members_stay_dealt_to_all_tasks(spark, rows):
    ids = spark.range(0, 2000, 1, 3)
    db = (F.col("id") % 10).alias("db")
    want = ids.filter("id % 3 > 0").select(db, F.col("id").alias("name"))
    have = ids.filter("id % 3 < 2").select(db, F.when(F.col("id") % 3 == 0, F.col("id") + 2).otherwise(F.col("id")).alias("name"))
    empty = spark.createDataFrame([(None, 1), (None, None), (1, None)], "db bigint, name bigint")
    want, have = (x.unionByName(x).unionByName(empty).unionByName(empty) for x in (want, have))
    verbs = rec.reconcile_members(want, have, have, ["db"], "name")
    found = {}
    for r in verbs.collect():
        found.setdefault(r.verb, []).append((r.db, r.name))
    nulls = {(None, 1), (None, None), (1, None)}
    assert {v: (len(x), len(set(x)), set(x) & nulls) for v, x in found.items()} == {
        "check": (667, 667, set()), "detach": (670, 670, nulls), "attach": (667, 667, {(None, 1)}), "create": (2, 2, {(None, None), (1, None)})
    }
    # a join or grouping of its own would bring these few bytes together in one task
    assert verbs.filter("verb = 'check'").select(F.spark_partition_id()).distinct().count() == 4


def test_diff_reference(spark):
    cases = [  # desired, actual, expected change
        (None, None, "none"), (None, "Dflt", "none"), (None, "x", "Dflt"), ("a", None, "a"), ("a", "b", "a"), ("a", "a", "none"), ("", "x", "Dflt"),
    ]
    df = spark.createDataFrame([(n, d, a) for n, (d, a, _) in enumerate(cases)], "n int, d string, a string")
    got = {r.n: r.new for r in rec.diff_reference(df, "d", "a", F.lit("Dflt")).collect()}
    assert got == {n: e for n, (_, _, e) in enumerate(cases) if e != "none"}
    cleared = rec.diff_reference(df, "d", "a").filter("n = 2").first()
    assert cleared.new is None


def test_immutable(spark):
    specs = [Prop("s", "group", immutable=True), Prop("s", "debug", default="false"), Prop("s", "policy", default="merge")]
    desired = long(spark, ("s", "x", "group", "g"), ("s", "x", "policy", "other"), ("s", "y", "debug", "true"))
    actual = long(spark, ("s", "x", "group", "h"), ("s", "x", "debug", "false"), ("s", "x", "policy", "merge"), ("s", "y", "debug", "true"), ("s", "y", "policy", "odd"))
    plan, issue = rec.diff_with_immutable(desired, actual, specs)
    assert {(r.entity, r.prop, r.new) for r in plan.collect()} == {("x", "policy", "other"), ("y", "policy", "merge")}
    assert [(r.entity, r.prop) for r in issue.collect()] == [("x", "group")]


def test_payload(spark):
    typed = spark.createDataFrame(
        [("role", "r", "role-name", "string", 'say "hi"'), ("role", "r", "role", "list", "a, b"), ("role", "r", "n", "integer", "3"), ("role", "r", "permission", "json", "[]"), ("role", "r", "on", "boolean", "true")],
        "kind string, entity string, prop string, type string, value string",
    )
    free = long(spark, ("role", "r", "n", "4"), ("role", "r", "extra", "x"))
    good, issue = rec.creation_payload(typed, free, late=["permission"])
    assert json.loads(good.first().payload) == {"role-name": 'say "hi"', "role": ["a", "b"], "n": 3, "on": True, "extra": "x"}
    assert [(r.prop, r.rule) for r in issue.collect()] == [("n", "already-set")]


def test_same_members(spark, rows):
    declared = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "b")], "env string, host string")
    existing = spark.createDataFrame([("e", "a"), ("e", "b"), ("e", "c"), ("f", "q")], "env string, host string")
    assert rows(rec.same_members(declared, existing, ["env"], "host")) == [("e", "b", 2, 1), ("e", "c", 0, 1)]
    assert rec.same_members(declared, declared, ["env"], "host").count() == 0


# --- graphs ---


def test_levels_are_above_dependencies(spark):
    rng = random.Random(2)
    edges = [(f"n{a}", f"n{b}") for a in range(60) for b in rng.sample(range(a), min(a, 2))]
    edges += [(f"n{a}", "hub") for a in range(60)] + [("n0", "undeclared")]
    nodes = spark.createDataFrame([(f"n{n}",) for n in range(60)] + [("hub",)], "id string")
    good, issue = graph.topo_levels(nodes, spark.createDataFrame(edges, "id string, dep string"))
    level = {r.id: r.level for r in good.collect()}
    assert issue.count() == 0 and len(level) == 61 and level["hub"] == 0
    want = {"hub": 0}
    for n in range(60):
        want[f"n{n}"] = 1 + max(want[d] for i, d in edges if i == f"n{n}" and d in want)
    assert level == want


def test_cycles_and_what_is_behind_them(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcde"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "b"), ("d", "e"), ("e", "e")], "id string, dep string")
    good, issue = graph.topo_levels(nodes, edges)
    assert good.count() == 0 and {r.entity for r in issue.collect()} == set("abcde")
    good, issue = graph.topo_levels(nodes, edges, self_ok=True)
    assert {(r.id, r.level) for r in good.collect()} == {("e", 0), ("d", 1)} and {r.entity for r in issue.collect()} == set("abc")
    good, issue = graph.topo_levels(nodes, edges.limit(0))
    assert {r.level for r in good.collect()} == {0} and issue.count() == 0


def test_embedded_databases(spark):
    """A chain of triggers databases inside one definition, one shared by reference, and one that serves itself."""
    log = {"id": "log", "name": "log", "triggers": {"idref": "log"}}
    orders = {"id": "orders", "name": "orders", "triggers": {"name": "on-order", "triggers": {"name": "on-event", "schema": {"nameref": "shapes"}}}}
    shapes = {"name": "shapes", "security": {"nameref": "log"}}
    archive = {"name": "archive", "schema": {"nameref": "shapes"}, "triggers": {"nameref": "on-order"}}
    df = spark.createDataFrame([(d["name"], json.dumps(d)) for d in (log, orders, shapes, archive)], "key string, body string")
    nodes, refs = graph.flatten_embedded(df)
    good, issue = resolve_reference(refs, nodes.select("id", "name"), own_id="own_id", own_name="own_name")
    assert issue.count() == 0
    edges = good.select(F.col("own_name").alias("id"), F.col("target_name").alias("dep"))
    levels = graph.topo_levels(nodes.select(F.col("name").alias("id")), edges, self_ok=True).good
    assert {r.id: r.level for r in levels.collect()} == {"log": 0, "shapes": 1, "on-event": 2, "on-order": 3, "orders": 4, "archive": 4}


def preorder(edges, root):
    seen, out = set(), []

    def walk(m, depth):
        if m not in seen:
            seen.add(m)
            out.append((m, depth))
            for _, to, _ in sorted((e for e in edges if e[0] == m), key=lambda e: e[2]):
                walk(to, depth + 1)

    walk(root, 0)
    return out


def test_imports_in_walk_order(spark):
    rng = random.Random(4)
    edges = [(f"m{a}", f"m{b}", pos) for a in range(12) for pos, b in enumerate(rng.sample(range(a + 1, 14), min(3, 13 - a)))]
    df = spark.createDataFrame(edges, "module string, import string, pos int")
    roots = spark.createDataFrame([("m0",), ("m3",)], "module string")
    good, issue = graph.flatten_imports(df, roots)
    assert issue.count() == 0
    for root in ("m0", "m3"):
        mine = good.filter(F.col("root") == root)
        assert [(r.node, r.depth) for r in mine.orderBy("path_first").collect()] == preorder(edges, root)
        back = [(a, b, -p) for a, b, p in edges]
        assert [r.node for r in mine.orderBy("path_last").collect()] == [m for m, _ in preorder(back, root)]


def test_import_cycle_ends_and_is_reported(spark):
    df = spark.createDataFrame([("a", "b", 0), ("b", "c", 0), ("c", "a", 0), ("c", "d", 1)], "module string, import string, pos int")
    good, issue = graph.flatten_imports(df, spark.createDataFrame([("a",)], "module string"))
    assert {r.node for r in good.collect()} == set("abcd")
    assert [(r.entity, r.value) for r in issue.collect()] == [("c", "a")]


def test_privileges_and_roles_may_share_names(spark):
    privileges = spark.createDataFrame([("execute", "p", "r , gone"), ("uri", "p", None)], "kind string, name string, roles string")
    roles = spark.createDataFrame([("r", "s", None, None), ("s", None, None, "p")], "name string, roles string, execute string, uri string")
    good, issue = graph.topo_levels(*graph.privilege_edges(privileges, roles))
    assert {r.id: r.level for r in good.collect()} == {"uri/p": 0, "role/s": 1, "role/r": 2, "execute/p": 3} and issue.count() == 0


# --- extraction ---

# Measurements below stations, of which a document may have several.
TEMPLATE = {
    "context": "/report/station",
    "collections": ["weather", "tide"],
    "rows": [
        {
            "schemaName": "met",
            "viewName": "daily",
            "columns": [
                {"name": "taken", "scalarType": "dateTime", "val": "at"},
                {"name": "degrees", "scalarType": "decimal", "val": "air/temperature"},
                {"name": "place", "scalarType": "string", "val": "place"},
                {"name": "gusts", "scalarType": "int", "val": "wind/gusts"},
            ],
        }
    ],
}


def test_template_gives_the_same_rows_from_xml_and_json(spark):
    xml = [
        ("/a", ["tide"], "<!-- north --><report><station><at>2031-02-03T04:05:06</at><air><temperature>-2.75</temperature></air><place>Pier</place></station>"
         "<station><wind><gusts>many</gusts></wind></station></report>"),
        ("/b", ["tide", "old"], "<report/>"),
        ("/c", ["old"], "<report><station><place>Hill</place></station></report>"),
        ("/d", ["weather"], "<report><station><place>Gate</place></report>"),
        ("/e", ["weather"], "<summary><station><place>Dam</place></station></summary>"),
    ]
    js = [
        ("/a", ["tide"], '{"report":{"station":[{"at":"2031-02-03T04:05:06","air":{"temperature":-2.75},"place":"Pier"},{"wind":{"gusts":"many"}}]}}'),
        ("/b", ["tide", "old"], '{"report":{}}'),
        ("/c", ["old"], '{"report":{"station":{"place":"Hill"}}}'),
        ("/d", ["weather"], '{"report":{"station":{"place":"Gate"}}'),
        ("/e", ["weather"], '{"summary":{"station":{"place":"Dam"}}}'),
    ]
    for format, docs in (("xml", xml), ("json", js)):
        df = spark.createDataFrame(docs, "uri string, collections array<string>, content string")
        view = extract_rows(df, TEMPLATE, ["uri"], format=format)["met.daily"]
        assert view.dtypes == [("uri", "string"), ("taken", "timestamp"), ("degrees", "decimal(38,18)"), ("place", "string"), ("gusts", "int")]
        got = {tuple(str(x) if x is not None else None for x in r) for r in view.withColumn("degrees", F.col("degrees").cast("double")).collect()}
        assert got == {("/a", "2031-02-03 04:05:06", "-2.75", "Pier", None), ("/a", None, None, None, None)}, format


def test_range_indexes(spark, rows):
    js = spark.createDataFrame(
        [("/1", '{"a":{"n":5,"t":"\\"n\\":9"},"n":["6",{"n":"x"}],"m":[1,2]}'), ("/2", "{bad"), ("/3", '{"a":[{"n":7},{"n":8.5}]}')], "uri string, content string"
    )
    good, issue = range_values(js, {"type": "int", "path": "/a/n", "invalid": "reject"})
    assert rows(good, "uri", "value") == [("/1", 5), ("/3", 7)]
    assert rows(issue, "entity", "rule", "value") == [("/2", "malformed", None), ("/3", "invalid-value", "8.5")]
    good, issue = range_values(js, {"type": "long", "name": ["m", "t"]})
    assert rows(good) == [("/1", "m", 1), ("/1", "m", 2)]
    assert rows(issue, "entity", "rule") == [("/2", "malformed")]
    xml = spark.createDataFrame(
        [("/1", "<r><p n='1'/><x xmlns='u'><n>2</n></x><q><n>3</n></q></r>"), ("/2", "<r><p n='4'>"), ("/3", None)], "uri string, content string"
    )
    assert rows(range_values(xml, {"type": "int", "name": "n", "parent": {"name": "p"}}, format="xml").good, "value") == [(1,)]
    assert rows(range_values(xml, {"type": "int", "name": "n"}, format="xml").good, "value") == [(3,)]
    assert rows(range_values(xml, {"type": "int", "name": "n", "namespace": "u"}, format="xml").good, "value") == [(2,)]
    assert rows(range_values(xml, {"type": "int", "path": "/r/q/n"}, format="xml").good, "value") == [(3,)]
    assert rows(range_values(xml, {"type": "int", "path": "/r/p/@n"}, format="xml").good, "value") == [(1,)]


def test_texts_are_handed_to_python_in_small_batches(spark, rows):
    text = F.concat(F.format_string('{"a":{"n":%d,"t":"', "id"), F.repeat(F.lit("é"), 20_000), F.lit('"}}'))
    docs = spark.range(0, 300, 1, 1).select(F.col("id").alias("uri"), F.when(F.col("id") == 7, "{").otherwise(text).alias("content"))
    js, issue = range_values(docs, {"type": "long", "name": ["n", "none"]})
    xml = docs.select("uri", F.format_string("<r><n>%d</n></r>", "uri").alias("content"))
    for found, want in (js, [n for n in range(300) if n != 7]), (range_values(xml, {"type": "long", "name": "n"}, format="xml").good, range(300)):
        assert sorted(tuple(r) for r in found.collect()) == [(n, "n", n) for n in want]
        plan = found._jdf.queryExecution().executedPlan().toString()
        # an Arrow batch would be 10,000 whole texts
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
    assert rows(issue, "entity", "rule") == [("7", "malformed")]


def test_nested_values_under_a_key(spark, rows):
    js = spark.createDataFrame([("/1", '{"n":["6",{"n":"7"}],"k":{"n":[[8]]}}')], "uri string, content string")
    good, _ = range_values(js, {"type": "int", "name": "n"})
    assert rows(good, "value") == [(6,), (7,), (8,)]


def test_lexicon(spark, rows):
    df = spark.createDataFrame([("/1", ["a", "b", "a"]), ("/2", ["a"]), ("/3", None)], "uri string, collections array<string>")
    assert rows(lexicon(df)) == [("a", 2), ("b", 1)]
    assert rows(lexicon(df, "uri"), "value") == [("/1",), ("/2",), ("/3",)]


def test_streaming(spark, tmp_path):
    source = tmp_path / "in"
    (source / "x").mkdir(parents=True)
    for n in range(7):
        (source / "x" / f"{n}.xml").write_text(f"<n>{n}</n>")
    (source / "x" / "skip.tmp").write_text("no")
    registry = local_table(spark, {"name": ["x"], "extensions": ["xml"], "format": ["xml"]})
    kept = select_paths(watch_documents(spark, str(source)), include=["*.xml"])
    typed = attach_mime(derive_uri(kept).good, registry).good.select("uri", "mime", "length")
    target = fresh_path(spark, "stream")

    def run():
        query = write_batches(typed, target, ["uri"], 3).option("checkpointLocation", f"{target}-state").trigger(availableNow=True).start()
        query.awaitTermination(120)

    run()
    (source / "x" / "late.xml").write_text("<n/>")
    run()
    got = spark.read.parquet(target)
    assert got.count() == 8
    assert sorted(r["count"] for r in got.groupBy("arrival", "batch").count().collect()) == [1, 1, 3, 3]


def test_text_next_to_attributes_and_prefixed_names(spark, rows):
    template = {
        "context": "/m/r",
        "rows": [
            {"schemaName": "s", "viewName": "a", "columns": [{"name": "t", "scalarType": "string", "val": "t"}, {"name": "lang", "scalarType": "string", "val": "t/@lang"}]},
            {"schemaName": "s", "viewName": "b", "columns": [{"name": "n", "scalarType": "long", "val": "n"}]},
        ],
    }
    docs = spark.createDataFrame(
        [("/1", "<m><r><t lang='en'>x</t><n>1</n></r><r><t>y</t></r></m>"), ("/2", "<p:m xmlns:p='u'><p:r><p:n>2</p:n></p:r></p:m>"), ("/3", "<m><r>"), ("/4", None), ("/5", "<other/>")],
        "uri string, content string",
    )
    views = extract_rows(docs, template, ["uri"], format="xml")
    assert rows(views["s.a"]) == [("/1", "x", "en"), ("/1", "y", None), ("/2", None, None)]
    assert rows(views["s.b"]) == [("/1", None), ("/1", 1), ("/2", 2)]
    assert rows(extract_issues(docs, format="xml"), "entity", "rule") == [("/3", "malformed"), ("/4", "malformed")]
    js = spark.createDataFrame([("/1", "{}"), ("/2", "{"), ("/3", None)], "uri string, content string")
    assert rows(extract_issues(js), "entity") == [("/2",), ("/3",)]


def test_several_paths_come_from_one_parse(spark, rows):
    xml = spark.createDataFrame([("/1", "<r><p n='1'>9</p><p>8</p><q><n>3</n><n>4</n></q></r>"), ("/2", "<r")], "uri string, content string")
    good, issue = range_values(xml, {"type": "int", "path": ["/r/q/n", "/r/p/@n", "/r/p", "/other/x"]}, format="xml")
    assert rows(good, "name", "value") == [("/r/p", 8), ("/r/p", 9), ("/r/p/@n", 1), ("/r/q/n", 3), ("/r/q/n", 4)]
    assert rows(issue, "entity", "rule") == [("/2", "malformed")]
    js = spark.createDataFrame([("/1", '{"a":[{"n":[1,2]},{"n":3}],"b":4}')], "uri string, content string")
    good, _ = range_values(js, {"type": "int", "path": ["/a/n", "/b"]})
    assert rows(good, "name", "value") == [("/a/n", 1), ("/a/n", 2), ("/a/n", 3), ("/b", 4)]
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") + plan.count("LocalTableScan") <= 2 and "Python" not in plan


def test_rules_of_comparison(spark, rows):
    from docloom.operators.validate import Prop

    specs = [Prop("k", "ring", compare="ordered"), Prop("k", "priv", compare="privileges"), Prop("k", "dir", compare="default", default="here")]
    schema = "kind string, entity string, prop string, value string"
    ring = '[{"name":"b","d":"2"},{"name":"a","d":"1"}]'
    desired = spark.createDataFrame(
        [("k", "1", "ring", ring), ("k", "2", "ring", ring), ("k", "1", "priv", '[{"privilege-name":"p","kind":"uri","action":"x"}]'),
         ("k", "2", "priv", '[{"privilege-name":"p","kind":"uri"}]'), ("k", "1", "dir", None), ("k", "2", "dir", None), ("k", "3", "dir", "there")],
        schema,
    )
    actual = spark.createDataFrame(
        [("k", "1", "ring", '[{"name":"a","d":"1","e":""},{"name":"b","d":"2"}]'), ("k", "2", "ring", '[{"name":"b","d":"2"},{"name":"a","d":"1"}]'),
         ("k", "1", "priv", '[{"privilege-name":"p","kind":"uri","action":"y"}]'), ("k", "2", "priv", '[{"privilege-name":"q","kind":"uri"}]'),
         ("k", "1", "dir", "here"), ("k", "2", "dir", "elsewhere"), ("k", "3", "dir", "here")],
        schema,
    )
    plan = rec.diff_properties(desired, actual, specs).good
    assert rows(plan, "entity", "prop", "new") == [
        ("2", "dir", "here"), ("2", "priv", '[{"privilege-name":"p","kind":"uri"}]'), ("2", "ring", ring), ("3", "dir", "there"),
    ]
    assert rec.diff_properties(desired, rec.apply_plan(actual, plan.filter("prop <> 'ring'")), specs).good.filter("prop <> 'ring'").count() == 0


def _levels(nodes, edges):
    """Levels by repeated search, and what has none."""
    deps = {n: {d for i, d in edges if i == n and d in nodes} for n in nodes}
    level = {}
    while True:
        more = {n: 1 + max((level[d] for d in ds), default=-1) for n, ds in deps.items() if n not in level and all(d in level for d in ds)}
        if not more:
            return level, set(nodes) - set(level)
        level |= more


def _on_cycles(nodes, edges):
    """Per node that reaches itself, the least of those that it reaches and that reach it."""
    reach = {n: {d for i, d in edges if i == n and d in nodes} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in reach[n]:
                reach[n] |= reach[k]
    return {n: min(m for m in reach[n] | {n} if n in reach[m] and m in reach[n]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(2, 5))
def test_levels_and_cycles_of_random_graphs(spark, seed):
    import random

    rng = random.Random(seed)
    n = 45
    nodes = list(range(n))
    # chains, rings, joints and cross-links
    edges = {(k, k - 1) for k in range(1, n) if rng.random() < 0.75}
    edges |= {(a, b) for a, b in (rng.sample(nodes, 2) for _ in range(rng.randrange(2, 14))) if seed % 3 or a > b}
    edges |= {(k, k) for k in nodes if rng.random() < 0.03} | {(3, 999)}
    df = spark.createDataFrame([(k,) for k in nodes], "id int")
    links = spark.createDataFrame(sorted(edges) + sorted(edges)[:3], "id int, dep int")
    level, left = _levels(nodes, edges)
    good, issue = graph.topo_levels(df, links)
    assert {r.id: r.level for r in good.collect()} == level
    assert {int(r.entity) for r in issue.collect()} == left
    on = _on_cycles(nodes, edges)
    assert {r.id: r.cycle for r in graph.cycles(df, links).collect()} == {k: on.get(k) for k in left}


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    writes = []
    real = graph.cut_observed
    monkeypatch.setattr(graph, "cut_observed", lambda *a: writes.append(a[1]) or real(*a))
    n = 100_000
    nodes = spark.range(n)
    edges = nodes.select("id", (nodes.id - 1).alias("dep"))
    good, issue = graph.topo_levels(nodes, edges)
    assert good.filter("level <> id").count() == 0 and good.count() == n and issue.count() == 0
    assert len(writes) <= 40


def test_a_long_ring_and_what_waits_for_it(spark):
    n = 300
    ring = spark.range(n)
    edges = ring.selectExpr("id", "(id + 1) % 300 AS dep").union(spark.range(n, n + 200).selectExpr("id", "id - 1 AS dep"))
    nodes = spark.range(n + 200)
    got = graph.cycles(nodes, edges).groupBy("cycle").count().collect()
    assert {(r.cycle, r["count"]) for r in got} == {(0, n), (None, 200)}
