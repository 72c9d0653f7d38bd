import random

import pytest
from pyspark.sql import functions as F

from docloom.operators import layers, lookup
from docloom.operators.permissions import CAPABILITIES
from docloom.operators.substitute import resolve_params, substitute
from docloom.operators.validate import Prop, apply_defaults, ensure, validate

PROPS = "kind string, layer int, pos int, id string, name string, compose string, prop string, value string"


def merged(spark, given):
    return layers.layered_merge(spark.createDataFrame([("k", *g) for g in given], PROPS))


def as_dict(good):
    out = {}
    for r in good.collect():
        out.setdefault(r.entity, {})[r.prop] = r.value
    return out


def test_explicit_null_hides_the_base_value(spark):
    good, issue = merged(
        spark,
        [
            (0, 0, "server", None, "merge", "modules", None),
            (0, 0, "server", None, "merge", "comment", "c"),
            (1, 0, "server", "base", None, "modules", "mods"),
            (1, 0, "server", "base", None, "port", "7010"),
            (1, 1, None, "src", None, "dir", "src"),
        ],
    )
    assert as_dict(good) == {
        "id:server": {"modules": None, "comment": "c", "port": "7010"},
        "name:src": {"dir": "src"},
    }
    assert {r.name for r in good.filter("entity = 'id:server'").collect()} == {"base"}
    assert issue.count() == 0


def test_records_of_one_layer_merge_first_wins(spark):
    good, _ = merged(spark, [(0, 1, None, "x", None, "a", "late"), (0, 0, None, "x", None, "a", "early"), (0, 1, None, "x", None, "b", "2")])
    assert as_dict(good) == {"name:x": {"a": "early", "b": "2"}}


def test_hide_discards_all_but_the_first(spark):
    good, _ = merged(spark, [(0, 0, "i", "x", "hide", "a", "1"), (1, 0, "i", "y", "hide", "b", "2"), (2, 0, None, "x", "hide", "c", "3")])
    assert as_dict(good) == {"id:i": {"a": "1"}}


def test_compose_issues(spark):
    good, issue = merged(
        spark,
        [(0, 0, "i", "x", "hide", "a", "1"), (1, 0, "i", "x", None, "a", "2"), (0, 1, "j", "y", "blend", "a", "1"), (0, 2, None, "", None, "a", "1")],
    )
    assert as_dict(good) == {}
    assert sorted(r.rule for r in issue.collect()) == ["different-compose", "no-id-and-no-name", "unknown-compose"]


def test_identity_by_id_then_name(spark):
    good, issue = merged(
        spark,
        [
            (0, 0, None, "x", None, "a", "1"),  # named only
            (1, 0, "1", "x", None, "b", "2"),  # gives it an id
            (2, 0, "1", "z", None, "c", "3"),  # same id, an overridden name
            (3, 0, None, "z", None, "d", "4"),  # that name is no alias
            (4, 0, "2", "x", None, "e", "5"),  # another id under the first name
        ],
    )
    assert as_dict(good) == {"id:1": {"a": "1", "b": "2", "c": "3", "e": "5"}, "name:z": {"d": "4"}}
    assert [r.rule for r in issue.collect()] == ["identity-conflict"]


def test_special_properties_are_left_out(spark):
    props = spark.createDataFrame([("k", 0, 0, "i", None, None, "indexes", "x"), ("k", 0, 0, "i", None, None, "a", "x")], PROPS)
    assert as_dict(layers.layered_merge(props, ("indexes",)).good) == {"id:i": {"a": "x"}}


def test_merge_against_a_sequential_model(spark):
    rng = random.Random(5)
    given, model, order = [], {}, []
    for layer in range(4):
        for pos in range(6):
            name = rng.choice("abcd")
            for prop in rng.sample("pqrs", 2):
                given.append((layer, pos, None, name, None, prop, rng.choice(["1", "2", None])))
    for g in sorted(given, key=lambda g: (g[0], g[1])):
        model.setdefault(f"name:{g[3]}", {}).setdefault(g[5], g[6])
    rng.shuffle(given)
    assert as_dict(merged(spark, given).good) == model


INDEX = "pos int, type string, name array<string>, positions boolean, invalid string"


@pytest.mark.parametrize(
    "base, derived, expected",
    [
        # nothing declared above: the base's stand as they are, opened one by one
        ([(["height", "width"], True, "reject"), (["depth"], False, "ignore")], [], [("height", True), ("width", True), ("depth", False)]),
        # one of three in a list is declared anew and moves to the front
        ([(["height", "width", "depth"], True, "reject")], [(["width"], False, "reject")], [("width", False), ("height", True), ("depth", True)]),
        # two lists meet in one name only
        (
            [(["height", "width"], False, "ignore"), (["mass"], False, "ignore")],
            [(["mass", "volume"], True, "ignore"), (["age"], True, "reject")],
            [("mass", True), ("volume", True), ("age", True), ("height", False), ("width", False)],
        ),
        # all of the base's are replaced
        ([(["mass"], True, "ignore")], [(["age"], True, "ignore"), (["mass"], False, "reject")], [("age", True), ("mass", False)]),
    ],
)
def test_merge_indexes(spark, base, derived, expected):
    def table(rows):
        return spark.createDataFrame([(n, "string", *r) for n, r in enumerate(rows)], INDEX)

    got = layers.merge_indexes(table(derived), table(base)).orderBy("side", "pos", "sub").collect()
    assert [(r.name, r.positions) for r in got] == expected


def test_merge_indexes_keys(spark):
    schema = "db string, pos int, type string, path string, field string, parent_name string, name string, namespace string"
    derived = [("d", 0, "int", "/a", None, None, None, None), ("d", 1, "int", None, None, "p", "n", "")]
    base = [
        ("d", 0, "int", "/a", None, None, "other", None),  # same path: gone
        ("d", 1, "int", None, None, None, "n", None),  # element, not attribute: stays
        ("d", 2, "int", None, None, "p", "n", None),  # missing namespace equals empty: gone
        ("d", 3, "int", None, "f", None, None, None),
        ("d", 4, "int", None, "g", None, None, None),  # another field: stays
        ("d", 5, "int", None, "g", None, None, None),  # repeated in the base: gone
        ("e", 0, "int", "/a", None, None, None, None),  # another database: stays
    ]
    got = layers.merge_indexes(spark.createDataFrame(derived, schema), spark.createDataFrame(base, schema), ["db"])
    assert sorted((r.db, r.pos) for r in got.filter("side = 1").collect()) == [("d", 1), ("d", 3), ("d", 4), ("e", 0)]


def test_precedence_and_names(spark):
    df = spark.createDataFrame(
        [("p", None, 0, True), ("p", "x", 1, False), ("q", "y", 1, False), ("@title", "t", 1, False), ("@code", "c", 1, False)],
        "name string, value string, rank int, own boolean",
    )
    got = layers.precedence_lookup(df, ["name"], ["rank"], own=F.col("own"))
    assert {(r.name, r.value) for r in got.collect()} == {("p", None), ("q", "y"), ("@code", "c")}
    names = layers.union_names(df, pos="rank", hide_system=True)
    assert {(r.name, r.first_seen) for r in names.collect()} == {("p", 0), ("q", 1)}


def test_overlay_apis(spark):
    df = spark.createDataFrame(
        [("e", "manage", "port", "", 0), ("e", "manage", "root", "mine", 0), ("e", "manage", "root", "base", 1), ("e", "x", "port", "1", 0)],
        "env string, api string, prop string, value string, rank int",
    )
    good, issue = layers.overlay_defaults(df, ["env"], ["rank"])
    got = {(r.api, r.prop): r.value for r in good.collect()}
    assert len(got) == 15 and got["manage", "port"] == "8002" and got["manage", "root"] == "mine"
    assert [r.prop for r in issue.collect()] == ["x.port"]


def test_multiply(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, [])], "id int, name array<string>")
    assert [tuple(r) for r in layers.multiply(df, "name").collect()] == [(1, "a"), (1, "b")]
    plain = spark.createDataFrame([(1, "a")], "id int, name string")
    assert layers.multiply(plain, "name").collect() == plain.collect()


# --- parameters ---


def test_substitute_dict(spark):
    df = spark.createDataFrame(
        [(1, "@{code}-${a}-@{code}"), (2, "${a"), (3, "${a b}"), (4, "${none}"), (5, "plain $ @ {x}"), (6, "${empty}"), (7, None), (8, "é${a}é")],
        "id int, t string",
    )
    good, issue = substitute(df, "t", {"@code": "C", "a": "1", "empty": ""}, ["id"])
    assert {r.id: r.t for r in good.collect()} == {1: "C-1-C", 5: "plain $ @ {x}", 7: None, 8: "é1é"}
    assert {r.entity: r.rule for r in issue.collect()} == {"2": "unclosed-reference", "3": "invalid-name", "4": "no-value", "6": "no-value"}


def test_substitute_first_only(spark):
    df = spark.createDataFrame([("@{c}${a}@{c}${a}",)], "t string")
    assert substitute(df, "t", {"@c": "C", "a": "1"}, first_only=True).good.first().t == "C1@{c}${a}"


def test_substitute_by_environment(spark):
    params = spark.createDataFrame([("e", "a", "1"), ("f", "a", "2"), ("e", "@a", "s")], "env string, name string, value string")
    df = spark.createDataFrame([(1, "e", "${a}@{a}${a}"), (2, "f", "x${a}"), (3, "f", "@{a}"), (4, "g", "none")], "id int, env string, t string")
    good, issue = substitute(df, "t", params, ["id"], ["env"])
    assert {r.id: r.t for r in good.collect()} == {1: "1s1", 2: "x2", 4: "none"}
    assert [(r.entity, r.rule) for r in issue.collect()] == [("3", "no-value")]


def test_resolve_params():
    assert resolve_params({"@code": "x", "a": "@{code}-${b}", "b": "1"}) == {"@code": "x", "a": "x-1", "b": "1"}
    for bad in ({"a": "${a}"}, {"a": "${b}", "b": "${a}"}, {"a": "${c}"}):
        with pytest.raises(ValueError):
            resolve_params(bad)


# --- validation ---

SPECS = [
    Prop("index", "type", target="scalar-type", mandatory=True),
    Prop("index", "invalid", type="enum", values=("ignore", "reject")),
    Prop("index", "comment", ignored=True, mandatory=True),
    Prop("index", "collation", default=("type", lambda c: F.when(c == "string", "root").otherwise(""))),
    Prop("index", "group", default="Default"),
]


def long(spark, *given):
    return spark.createDataFrame([("index", *g) for g in given], "kind string, entity string, prop string, value string")


def test_validate(spark):
    props = long(spark, ("a", "type", "int"), ("a", "invalid", "never"), ("b", "type", None), ("b", "size", "1"), ("c", "type", "x"), ("c", "type", "y"))
    good, issue = validate(props, SPECS)
    assert {(r.entity, r.prop, r.rule) for r in issue.collect()} == {
        ("a", "invalid", "not-in-enum"),
        ("b", "scalar-type", "missing-mandatory"),
        ("b", "size", "unknown-property"),
        ("c", "scalar-type", "set-twice"),
    }
    assert {(r.entity, r.prop, r.value) for r in good.collect()} >= {("a", "scalar-type", "int")}


def test_ensure_fails_the_job(spark):
    fine = validate(long(spark, ("a", "type", "int")), SPECS)
    assert ensure(fine).count() == 1
    with pytest.raises(Exception, match="unknown-property"):
        ensure(validate(long(spark, ("a", "type", "int"), ("a", "nope", "1")), SPECS)).collect()


def test_defaults_only_where_absent(spark):
    props = long(spark, ("a", "type", "string"), ("b", "type", "int"), ("b", "group", None), ("c", "collation", "own"))
    got = {(r.entity, r.prop): r.value for r in apply_defaults(props, SPECS).collect()}
    assert got["a", "collation"] == "root" and got["b", "collation"] == "" and got["c", "collation"] == "own"
    assert got["a", "group"] == "Default" and got["b", "group"] is None and got["c", "group"] == "Default"


# --- lookups ---


def test_lookup_unique(spark):
    dim = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "b"), ("4", "4"), ("a", "z"), (None, "n")], "id string, name string")
    refs = spark.createDataFrame([("1",), ("b",), ("4",), ("a",), ("q",), ("n",), (None,)], "ref string")
    good, issue = lookup.lookup_unique(refs, dim, "ref", "id", "name")
    got = {r.ref: (r.id, r.name) for r in good.collect()}
    assert got == {"1": ("1", "a"), "b": (None, None), "4": ("4", "4"), "a": (None, None), "q": (None, None), "n": (None, "n"), None: (None, None)}
    assert {(r.entity, r.value) for r in issue.collect()} == {("b", "2/b"), ("b", "3/b"), ("a", "1/a"), ("a", "a/z")}
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_resolve_reference_order(spark):
    dim = spark.createDataFrame([("i1", "n1"), ("i2", "n2")], "id string, name string")
    schema = "own_id string, own_name string, name string, nameref string, id string, idref string, sysref string"
    refs = spark.createDataFrame(
        [
            ("o", "O", "n1", None, "i2", None, None),  # name before id
            ("o", "O", "zz", None, "i2", None, None),  # unknown name, then id
            ("o", "O", None, None, None, "o", None),  # itself by id
            ("o", "O", None, "O", None, None, None),  # itself by name
            ("o", "O", None, None, None, None, "Security"),  # system
            ("o", "O", None, "gone", None, None, None),
        ],
        schema,
    )
    good, issue = lookup.resolve_reference(refs, dim, own_id="own_id", own_name="own_name")
    got = sorted((r.resolution, r.target_name) for r in good.collect())
    assert got == [("id", "n2"), ("name", "n1"), ("self", "O"), ("self", "O"), ("system", "Security")]
    assert [r.value for r in issue.collect()] == ["gone"]


def test_shards(spark):
    dbs = spark.createDataFrame([("e", "a", None), ("e", "b", 0), ("e", "c", 2), ("e", "d", -1), ("e", "f", 101)], "env string, db string, shards int")
    hosts = spark.createDataFrame([("e", "h1", 1), ("e", "h2", 2), ("x", "h3", 1)], "env string, host string, ordinal int")
    good, issue = lookup.shard_plan(dbs, hosts, ["env"])
    assert sorted(r.shard_name for r in good.collect()) == ["a-001-001", "a-002-001", "c-001-001", "c-001-002", "c-002-001", "c-002-002"]
    assert {(r.entity, r.rule) for r in issue.collect()} == {("d", "negative-count"), ("f", "count-above-100")}
    actual = spark.createDataFrame([("a-001-001", "h1"), ("a-002-001", "h9")], "shard_name string, host string")
    placed, clash = lookup.placement_check(good, actual, hosts, ["env"])
    assert placed.filter("exists").count() == 1 and placed.count() == 5
    assert [(r.entity, r.value) for r in clash.collect()] == [("a-002-001", "h2 vs. h9")]


def test_capabilities_are_closed():
    assert sorted(CAPABILITIES) == ["execute", "insert", "node-update", "read", "update"]


def test_nested_objects_are_validated_by_their_parts(spark, rows):
    from docloom.operators import schemas
    from docloom.operators.validate import validate

    props = spark.createDataFrame(
        [
            ("database", "a", "name", "a"), ("database", "a", "lexicons", '{"uri": true, "collection": "maybe", "other": 1}'),
            ("database", "b", "name", "b"), ("database", "b", "lexicons", "text"),
            ("attribute-index", "i", "type", "int"), ("attribute-index", "i", "name", "n"), ("attribute-index", "i", "parent", '{"namespace": "u"}'),
            ("path-index", "p", "type", "int"), ("path-index", "p", "name", "n"), ("element-index", "e", "type", None), ("element-index", "e", "name", "n"),
        ],
        "kind string, entity string, prop string, value string",
    )
    good, issue = validate(props, schemas.ALL + schemas.index("root"))
    assert rows(issue, "entity", "prop", "rule") == [
        ("a", "lexicons.collection", "not-boolean"), ("a", "lexicons.other", "unknown-property"), ("b", "lexicons", "not-object"),
        ("e", "scalar-type", "missing-mandatory"), ("i", "parent-localname", "missing-mandatory"), ("p", "name", "unknown-property"),
        ("p", "path-expression", "missing-mandatory"),
    ]
    assert ("a", "uri-lexicon", "true") in rows(good, "entity", "prop", "value")
    assert ("i", "parent-namespace-uri", "u") in rows(good, "entity", "prop", "value")
