import json

import pytest
from pyspark.sql import functions as F

from docloom.operators.environment import compile_environments, load_documents, settle
from docloom.operators.substitute import resolve_param_table
from docloom.sources.layers import read_modules, split_layers

# A shop in three layers: what all stages share, the shop itself, and a stage that imports both that and a missing file.
COMMON = {
    "format": "0.1", "title": "Shared by all stages", "code": "shop",
    "params": {"first": "91${digit}", "digit": "4", "pool": "pool of @{code}"},
    "apis": {"client": {"port": 9400}, "rest-admin": {"colour": "blue"}},
    "roles": [{"name": "clerk", "desc": "sells", "permissions": {"clerk": "read"}}, {"name": "buyer", "permissions": {"buyer": "read", "clerk": "execute"}}],
    "hosts": [{"name": "north"}, {"name": "south"}],
}
SHOP = {
    "format": "0.1", "import": "common.json",
    "databases": [
        {"id": "stock", "name": "@{code} stock", "indexes": {"ranges": [{"type": "decimal", "name": ["price", "weight"]}, {"type": "date", "path": "/offer/until"}], "namespaces": {"o": "urn:offer"}}},
        {"id": "bills", "name": "bills", "searches": {"fast": True}, "indexes": {"ranges": [{"type": "long", "name": "total"}]}},
    ],
    "servers": [{"id": "front", "name": "front", "type": "http", "port": "${first}0", "root": "/shop", "content": {"idref": "stock"}, "rewriter": "/go.xqy"}],
    "sources": [{"name": "pages", "dir": "src/${digit}", "collections": "web, shop", "permissions": {"clerk": "update", "buyer": "read"}}],
}
STAGE = {
    "format": "0.1", "import": ["shop.json", "../elsewhere/gone.json"],
    "connect": {"user": "tester"},
    "params": {"digit": "7"},
    "apis": {"client": {"port": 0}},
    "databases": [
        {"id": "stock", "indexes": {"ranges": [{"type": "decimal", "name": "weight", "positions": True}, {"type": "string", "name": "sku"}]}},
        {"compose": "hide", "name": "bills", "indexes": {"ranges": [{"type": "int", "name": "year"}]}},
    ],
    "servers": [{"id": "front", "rewriter": None, "handler": "/oops.xqy"}],
    "sources": [{"name": "pages", "permissions": {"buyer": "read,execute"}}],
    "roles": [{"name": "buyer", "compose": "hide", "permissions": {"guest": "read"}}],
}
NAMES = {"/shop/common.json": COMMON, "/shop/shop.json": SHOP, "/shop/stage.json": STAGE}


@pytest.fixture(scope="module")
def compiled(spark):
    # a record that another one hides has to say so, too
    layers = json.loads(json.dumps(NAMES))
    layers["/shop/shop.json"]["databases"][1]["compose"] = "hide"
    layers["/shop/common.json"]["roles"][1]["compose"] = "hide"
    modules = spark.createDataFrame([(m, json.dumps({"env": b})) for m, b in layers.items()], "module string, body string")
    roots = spark.createDataFrame([(m,) for m in ("/shop/shop.json", "/shop/stage.json")], "module string")
    return compile_environments(modules, roots)


def of(df, root):
    return df.filter(F.col("root") == f"/shop/{root}.json")


def values(compiled, root, kind, entity):
    rows = of(compiled.props, root).filter((F.col("kind") == kind) & (F.col("entity") == entity)).collect()
    return {r.prop: r.value for r in rows}


def test_params(compiled):
    own = {"@code": "shop", "pool": "pool of shop"}
    assert {r.name: r.value for r in of(compiled.params, "shop").collect()} == {**own, "digit": "4", "first": "914"}
    assert {r.name: r.value for r in of(compiled.params, "stage").collect()} == {**own, "digit": "7", "first": "917", "@user": "tester"}


def test_later_layers_override_and_null_hides(compiled):
    assert values(compiled, "shop", "server", "id:front")["port"] == "9140"
    front = values(compiled, "stage", "server", "id:front")
    assert front["port"] == "9170" and front["rewriter"] is None and front["handler"] == "/oops.xqy" and front["root"] == "/shop"
    assert values(compiled, "stage", "source", "name:pages")["dir"] == "src/7"


def test_hidden_records_leave_nothing_behind(compiled):
    assert "searches" in values(compiled, "shop", "database", "id:bills")
    bills = of(compiled.props, "stage").filter("kind = 'database' AND name = 'bills'").collect()
    assert {r.prop for r in bills} == {"compose", "name"} and {(r.entity, r.id) for r in bills} == {("name:bills", None)}
    years = of(compiled.indexes, "stage").filter("entity = 'name:bills'").collect()
    assert [(r.name, r.type) for r in years] == [("year", "int")]
    assert of(compiled.indexes, "stage").filter("entity = 'id:bills'").count() == 0
    roles = {(r.entity, r.role): r.value for r in of(compiled.permissions, "stage").filter("kind = 'role'").collect()}
    assert roles == {("name:clerk", "clerk"): "read", ("name:buyer", "guest"): "read"}


def test_permissions_merge_role_by_role(compiled):
    grants = {r.role: r.value for r in of(compiled.permissions, "stage").filter("kind = 'source'").collect()}
    assert grants == {"clerk": "update", "buyer": "read,execute"}


def test_indexes(compiled):
    stock = of(compiled.indexes, "stage").filter("entity = 'id:stock'").orderBy("side", "at", "sub").collect()
    assert [(r.side, r.name, r.path, r.positions) for r in stock] == [
        (0, "weight", None, "true"), (0, "sku", None, None), (1, "price", None, None), (1, None, "/offer/until", None),
    ]
    assert values(compiled, "shop", "database", "id:stock")["indexes.namespaces"] == '{"o":"urn:offer"}'
    assert "indexes.namespaces" not in values(compiled, "stage", "database", "id:stock")


def test_what_does_not_fit_is_reported(compiled):
    found = {(r.kind, r.entity, r.prop, r.rule) for r in compiled.issue.collect()}
    assert ("module", "/elsewhere/gone.json", "import", "no-such-module") in found
    assert ("database", "id:stock", "indexes.namespaces", "no-merge-rule") in found
    assert ("api", "/shop/stage.json", "rest-admin.colour", "unknown-name") in found
    assert {rule for _, _, _, rule in found} == {"no-such-module", "no-merge-rule", "unknown-name"}


def test_apis(compiled):
    got = {r.root: r.value for r in compiled.apis.filter("api = 'client' AND prop = 'port'").collect()}
    assert got == {"/shop/shop.json": "9400", "/shop/stage.json": "8000"}
    assert compiled.apis.filter("prop = 'colour'").count() == 0


def test_settled_environment(spark, rows):
    """Defaults, schemas, references and levels of a whole environment."""
    top = {
        "format": "0.1", "config": {"verbose": "false", "depth": "2"},
        "hosts": [{"name": "h1"}],
        "databases": [
            {"id": "docs", "name": "docs", "schema": {"name": "types", "security": {"idref": "safe"}}, "lexicons": {"uri": True, "odd": 1},
             "indexes": {"ranges": [{"type": "string", "name": "title"}, {"name": "broken"}, {"type": "int", "name": "n", "parent": {"name": "p"}}]}},
            {"id": "safe", "name": "safe", "security": {"idref": "safe"}},
            {"name": "lost", "triggers": {"nameref": "nowhere"}},
        ],
        "servers": [{"id": "web", "name": "web", "type": "http", "port": "eighty", "content": {"idref": "docs"}, "modules": {"nameref": "types"}}],
    }
    derived = {"format": "0.1", "import": "top.json", "config": {"depth": "3"}}
    modules = [("/top.json", json.dumps({"e": top})), ("/low.json", json.dumps({"e": derived}))]
    modules = spark.createDataFrame(modules, "module string, body string")
    roots = spark.createDataFrame([("/low.json",)], "module string")
    defaults = spark.createDataFrame([("/low.json", "@code", "none"), ("/low.json", "@user", "me")], "root string, name string, value string")
    env = compile_environments(modules, roots, defaults=defaults)
    assert rows(env.config, "name", "value") == [("depth", "3"), ("verbose", "false")]
    assert rows(env.params, "name", "value") == [("@code", "none"), ("@user", "me")]
    got = settle(env, "http://root")
    assert ("host", "name:h1", "group", "Default") in rows(got.props, "kind", "entity", "prop", "value")
    assert ("database", "id:docs", "uri-lexicon", "true") in rows(got.props, "kind", "entity", "prop", "value")
    assert rows(got.indexes.filter("prop = 'collation'"), "kind", "value") == [("attribute-index", ""), ("element-index", ""), ("element-index", "http://root")]
    assert rows(got.references, "of", "name", "slot", "target") == [
        ("database", "docs", "schema", "types"), ("database", "safe", "security", "safe"), ("database", "types", "security", "safe"),
        ("server", "web", "content", "docs"), ("server", "web", "modules", "types"),
    ]
    assert rows(got.levels, "name", "level") == [("docs", 2), ("lost", 0), ("safe", 0), ("types", 1)]
    assert {(r.kind, r.prop, r.rule) for r in got.issue.collect()} == {
        ("database", "lexicons.odd", "unknown-property"), ("server", "port", "not-integer"), ("element-index", "scalar-type", "missing-mandatory"),
        ("reference", "reference", "unresolved"),
    }


def test_bad_modules_are_reported(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"top": {"format": "0.1",\n "code": "x"}}')
    (tmp_path / "b.json").write_text('{"top": {"format": "0.2"}}')
    (tmp_path / "c.json").write_text('{"top": {"format": "0.1"}, "more": {}}')
    (tmp_path / "d.json").write_text("{}")
    (tmp_path / "e.json").write_text("no json")
    (tmp_path / "_f.json").write_text('{"top": {"format": "0.1", "hosts": {"name": "x"}, "roles": ["text", {"name": "r"}]}}')
    layers = split_layers(read_modules(spark, str(tmp_path)))
    assert {(r.entity.rsplit("/", 1)[1], r.rule) for r in layers.issue.collect()} == {("b.json", "wrong-format"), ("c.json", "not-one-root"),
        ("d.json", "not-one-root"), ("e.json", "not-one-root"), ("_f.json", "section-no-list"), ("_f.json", "record-no-object"),
    }
    assert [(r.kind, r.body) for r in layers.components.collect()] == [("role", '{"name":"r"}')]
    assert [(r.module, r.name, r.value) for r in layers.params.collect()] == [(f"{tmp_path}/a.json", "@code", "x")]


def test_params_that_lead_nowhere(spark):
    df = spark.createDataFrame(
        [("e", "a", "1${b}"), ("e", "b", "2@{c}"), ("e", "@c", "3"), ("f", "a", "${b}"), ("f", "b", "${a}"), ("f", "d", "${none}")],
        "env string, name string, value string",
    )
    good, issue = resolve_param_table(df, ["env"])
    assert {(r.env, r.name, r.value) for r in good.collect()} == {("e", "a", "123"), ("e", "b", "23"), ("e", "@c", "3")}
    assert {r.entity for r in issue.collect()} == {"f/a", "f/b", "f/d"}


def test_load_documents(spark):
    df = spark.createDataFrame([(f"/d/{n:03}.xml",) for n in range(25)] + [("/d/x~",)], "path string")
    got = load_documents(df, include=["*.xml"], collections=["all"], base="/base", n=10).orderBy("uri").collect()
    assert [r.batch for r in got] == [n // 10 for n in range(25)]
    assert got[0].full == "/base/d/000.xml" and got[0].collections == ["all"] and not got[0].is_override


def test_schemas(spark):
    from docloom.operators import schemas
    from docloom.operators.reconcile import diff_properties
    from docloom.operators.validate import validate

    rows = [
        ("source", "s", "name", "s"), ("source", "s", "include", "*.xml , *.json"), ("source", "s", "type", "odd"),
        ("mime", "m", "extensions", "a"), ("mime", "m", "format", "xml"), ("role", "r", "name", "r"), ("role", "r", "roles", "a,b"),
        ("database", "d", "searches", "{}"), ("host", "h", "colour", "red"),
    ]
    props = spark.createDataFrame(rows, "kind string, entity string, prop string, value string")
    good, issue = validate(props, schemas.ALL)
    assert {(r.entity, r.prop, r.rule) for r in issue.collect()} == {("s", "type", "not-in-enum"), ("h", "colour", "unknown-property")}
    desired = schemas.as_json_lists(good).select("kind", "entity", "prop", "value")
    actual = spark.createDataFrame(
        [("source", "s", "include", '["*.json","*.xml"]'), ("role", "r", "role", '["a"]'), ("role", "r", "role-name", "r"), ("mime", "m", "format", "text"), ("mime", "m", "extensions", '["a"]')],
        desired.schema,
    )
    plan, frozen = diff_properties(desired, actual, schemas.by_target(schemas.ALL))
    assert {(r.entity, r.prop) for r in plan.collect()} == {("r", "role")}
    assert {(r.entity, r.prop) for r in frozen.collect()} == {("m", "format")}
