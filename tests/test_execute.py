"""Plans carried out: phases, the first error, and nothing left to do; nested records; deliveries with a ledger."""

import json

import pytest

from docloom.operators.batching import batch_documents
from docloom.operators.execute import PLAN, State, _judged, carry_out, member_plan
from docloom.operators.reconcile import reconcile_members
from docloom.operators.records import Nested, open_records, validate_records
from docloom.operators.validate import Prop
from docloom.sources.delivery import deliver_missing, ledger
from docloom.sources.sinks import write_file


def _state(spark):
    return State(
        spark.createDataFrame([("role", "a"), ("role", "b")], "kind string, entity string"),
        spark.createDataFrame([("role", "a", "desc", "x"), ("role", "b", "desc", "y")], "kind string, entity string, prop string, value string"),
        spark.createDataFrame([("role", "a", "m1")], "kind string, entity string, name string"),
    )


def _plan(spark, *rows):
    return spark.createDataFrame(rows, "phase int, verb string, kind string, entity string, prop string, old string, new string")


def _all(state):
    return [sorted(map(tuple, df.collect()), key=str) for df in state]


def test_a_plan_is_carried_out(spark):
    plan = _plan(
        spark,
        (1, "create", "role", "c", None, None, '{"desc":"new","tags":["p","q"],"none":null}'), (1, "update", "role", "a", "desc", "x", "z"),
        (2, "update", "role", "c", "late", None, "1"), (1, "update", "role", "b", "desc", "y", None), (1, "detach", "role", "a", "m1", None, None),
        (2, "attach", "role", "c", "m2", None, None), (2, "update", "role", "a", "more", None, "2"),
    )
    after, report = carry_out(_state(spark), plan)
    assert _all(after) == [
        [("role", "a"), ("role", "b"), ("role", "c")],
        [("role", "a", "desc", "z"), ("role", "a", "more", "2"), ("role", "c", "desc", "new"), ("role", "c", "late", "1"), ("role", "c", "tags", '["p","q"]')],
        [("role", "c", "m2")],
    ]
    assert report.count() == 7 and {(r.status, r.rule) for r in report.collect()} == {("done", None)}


RULES = [
    ((1, "create", "role", "b", None, None, "{}"), "already-there"), ((1, "create", "role", "bb", None, None, "text"), "malformed-payload"),
    ((1, "update", "role", "cc", "desc", None, "1"), "no-such-entity"), ((1, "update", "role", "b", "desc", "other", "1"), "changed-meanwhile"),
    ((1, "detach", "role", "b", "m9", None, None), "not-attached"), ((1, "rename", "role", "b", None, None, None), "unknown-verb"),
    ((1, "attach", "role", "a", "m1", None, None), "already-attached"), ((1, "update", "role", "b", "new", None, "1"), None),
]


def test_rules_of_actions(spark):
    judged = _judged(_plan(spark, *[a for a, _ in RULES]), *_state(spark)).collect()
    assert {(r.verb, r.entity, r.prop): r.rule for r in judged} == {(a[1], a[3], a[4]): rule for a, rule in RULES}


def test_the_first_error_stops_it(spark):
    plan = _plan(
        spark, RULES[3][0], (1, "update", "role", "a", "desc", "x", "before"), (1, "update", "role", "z", "desc", None, "behind it"),
        (1, "create", "role", "c", None, None, "{}"), (2, "attach", "role", "a", "m5", None, None),
    )
    after, report = carry_out(_state(spark), plan)
    told = {(r.verb, r.entity, r.prop): (r.status, r.rule) for r in report.collect()}
    assert told["update", "b", "desc"] == ("failed", "changed-meanwhile")
    assert told["update", "a", "desc"] == ("done", None) and told["update", "z", "desc"] == ("todo", None)
    assert told["create", "c", None] == told["attach", "a", "m5"] == ("todo", None)
    assert ("role", "a", "desc", "before") in _all(after)[1] and _all(after)[0] == [("role", "a"), ("role", "b")]


def test_repeated_actions_and_an_empty_plan(spark):
    twice = _plan(spark, *[(1, "attach", "role", "b", "m", None, None)] * 2)
    after, report = carry_out(_state(spark), twice)
    assert [(r.status, r.rule) for r in report.collect()] == [("failed", "repeated-action")] * 2 and _all(after) == _all(_state(spark))
    after, report = carry_out(_state(spark), twice.limit(0))
    assert report.count() == 0 and report.columns == [*PLAN, "status", "rule"] and _all(after) == _all(_state(spark))


def test_members_become_actions(spark):
    names = lambda *x: spark.createDataFrame(list(x), "entity string, name string")
    desired, actual = names(("a", "m1"), ("a", "m2"), ("b", "m2"), ("b", "m3")), names(("a", "m1"), ("a", "gone"))
    existing = spark.createDataFrame([("m1",), ("m2",)], "name string")
    plan = member_plan(reconcile_members(desired, actual, existing, ["entity"], "name"), "db", "entity", "name", "forest")
    assert sorted((r.phase, r.verb, r.kind, r.entity, r.prop) for r in plan.collect() if r.prop) == [
        (1, "detach", "db", "a", "gone"), (2, "attach", "db", "a", "m2"), (2, "attach", "db", "b", "m2"), (2, "attach", "db", "b", "m3"),
    ]
    assert [(r.phase, r.verb, r.kind, r.entity, r.new) for r in plan.filter("prop IS NULL").collect()] == [(1, "create", "forest", "m3", "{}")]


SCHEMA = [
    Prop("db", "name", mandatory=True), Prop("db", "forests", ignored=True), Prop("forest", "name", mandatory=True), Prop("forest", "replicas", ignored=True),
    Prop("forest", "size", type="integer", default="1"), Prop("replica", "name", mandatory=True), Prop("replica", "inner", ignored=True), Prop("replica", "dir"),
]
NESTED = [Nested("db", "forests", "forest", "name", each="name"), Nested("forest", "replicas", "replica", "name"), Nested("replica", "inner", "replica", "name")]


def _props(spark, **values):
    return spark.createDataFrame([("db", "d", k, v if isinstance(v, str) or v is None else json.dumps(v)) for k, v in values.items()], "kind string, entity string, prop string, value string")


def test_records_in_records(spark, rows):
    deep = {"name": "r0", "inner": [{"name": "r1", "inner": {"name": "r2", "dir": "x\"y"}}]}
    props = _props(spark, name="d", forests=[{"name": ["f1", "f2"], "size": 3, "replicas": [deep]}, {"name": "f3", "size": None}])
    good, issue = validate_records(props, SCHEMA, NESTED)
    assert rows(good.filter("prop = 'name'"), "kind", "entity", "value", "parent") == [
        ("db", "d", "d", None), ("forest", "d.forests[0]", "f1", "d"), ("forest", "d.forests[0]#1", "f2", "d"), ("forest", "d.forests[1]", "f3", "d"),
        ("replica", "d.forests[0]#1.replicas[0]", "r0", "d.forests[0]#1"), ("replica", "d.forests[0]#1.replicas[0].inner[0]", "r1", "d.forests[0]#1.replicas[0]"),
        ("replica", "d.forests[0]#1.replicas[0].inner[0].inner[0]", "r2", "d.forests[0]#1.replicas[0].inner[0]"),
        ("replica", "d.forests[0].replicas[0]", "r0", "d.forests[0]"), ("replica", "d.forests[0].replicas[0].inner[0]", "r1", "d.forests[0].replicas[0]"),
        ("replica", "d.forests[0].replicas[0].inner[0].inner[0]", "r2", "d.forests[0].replicas[0].inner[0]"),
    ]
    assert [r.value for r in good.filter("prop = 'dir'").collect()] == ['x"y'] * 2
    # a null size is there: it suppresses the default
    assert rows(good.filter("prop = 'size'"), "entity", "value") == [("d.forests[0]", "3"), ("d.forests[0]#1", "3")]
    assert issue.count() == 0


def test_faults_of_nested_records(spark):
    forests = [{"name": "f", "odd": 1}, "text", None, {"name": "f", "size": "many"}, {"replicas": [{"dir": "/"}, 7]}]
    issue = validate_records(_props(spark, name="d", forests=forests), SCHEMA, NESTED).issue
    assert {(r.kind, r.entity, r.prop, r.rule, r.value) for r in issue.collect()} == {
        ("forest", "d.forests[0]", "odd", "unknown-property", "1"), ("db", "d", "forests", "record-no-object", "text"), ("db", "d", "forests", "record-no-object", "null"),
        ("forest", "d", "name", "duplicate-record", "f"), ("forest", "d.forests[3]", "size", "not-integer", "many"), ("forest", "d.forests[4]", "name", "missing-mandatory", None),
        ("replica", "d.forests[4].replicas[0]", "name", "missing-mandatory", None), ("forest", "d.forests[4]", "replicas", "record-no-object", "7"),
    }
    assert open_records(_props(spark, name="d", forests=None), NESTED).good.count() == 2
    assert open_records(_props(spark, forests="no json"), NESTED).issue.first().rule == "record-no-object"
    assert open_records(_props(spark, name="d").limit(0), NESTED).good.count() == 0


def _send(folder, failing=None):
    """Notes every call in a file of its own, and fails at one batch while a mark is not there."""

    def send(batch, rows):
        import os
        import uuid

        if batch == failing and not os.path.exists(f"{folder}/mended"):
            raise RuntimeError("the store is away")
        name = "-".join(map(str, batch)) if isinstance(batch, tuple) else batch
        write_file(f"{folder}/calls/{name}~{uuid.uuid4().hex}", ",".join(str(r.id) for r in rows).encode())

    return send


def test_a_second_run_sends_what_is_missing(spark, tmp_path):
    docs = spark.createDataFrame([(n, "x" * 10) for n in range(95)], "id int, body string").repartition(3)
    batches = batch_documents(docs, ["id"], 10)
    path = f"{tmp_path}/ledger"
    with pytest.raises(Exception, match="the store is away"):
        deliver_missing(batches, _send(str(tmp_path), 4), path, ["id"])
    before = {r.batch: r.documents for r in ledger(spark, path).collect()}
    assert 4 not in before and len(list((tmp_path / "calls").iterdir())) >= len(before)
    assert [json.loads(f.read_text())["complete"] for f in (tmp_path / "ledger" / "runs").iterdir() if f.suffix == ".json"] == [False]
    (tmp_path / "mended").touch()
    told = deliver_missing(batches, _send(str(tmp_path), 4), path, ["id"])
    assert told["batches"] == 10 - len(before) and told["documents"] == 95 - sum(before.values()) and told["complete"]
    assert {r.batch: r.documents for r in ledger(spark, path).collect()} == {n: 10 if n < 9 else 5 for n in range(10)}
    calls = [f.name.split("~")[0] for f in (tmp_path / "calls").iterdir() if not f.name.startswith(".")]
    assert sorted(set(calls)) == sorted(map(str, range(10))) and len([c for c in calls if int(c) not in before]) == told["batches"]
    assert deliver_missing(batches, _send(str(tmp_path), 4), path, ["id"])["batches"] == 0
    assert {r.mb for r in ledger(spark, path).collect()} == {0.0}


def test_contents_and_sets(spark, tmp_path):
    for n in range(6):
        write_file(f"{tmp_path}/in/{n}", b"c" * 1_000_000)
    files = spark.createDataFrame([(n, None if n == 5 else f"s{n % 2}", f"{tmp_path}/in/{n}") for n in range(6)], "id int, source string, full string")
    batches = batch_documents(files, ["id"], 2, by=["source"])
    path = f"{tmp_path}/ledger"
    told = deliver_missing(batches, _send(str(tmp_path)), path, ["id"], by=["source"], full="full")
    assert told["batches"] == 4 and told["bytes"] == 6_000_000
    got = {(r.source, r.batch): (r.documents, r.mb) for r in ledger(spark, path).collect()}
    assert got == {('["s0"]', 0): (2, 1.907), ('["s0"]', 1): (1, 0.954), ('["s1"]', 0): (2, 1.907), ("[null]", 0): (1, 0.954)}
    assert deliver_missing(batches, _send(str(tmp_path)), path, ["id"], by=["source"], full="full")["batches"] == 0
