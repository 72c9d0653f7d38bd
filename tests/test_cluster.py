"""Security and placement of compiled environments."""

import json

from docloom.operators.cluster import settle_cluster, settle_security
from docloom.operators.environment import compile_environments


def _compiled(spark, **modules):
    rows = [(f"/{m}.json", json.dumps({"e": {"format": "0.1", **body}})) for m, body in modules.items()]
    df = spark.createDataFrame(rows, "module string, body string")
    return compile_environments(df, df.select("module"))


def test_privileges_and_roles(spark, rows):
    one = {
        "privileges": {"execute": [{"name": "run", "action": "urn:run", "roles": "clerk , nobody"}, {"name": "both", "action": "urn:x"}], "uri": [{"name": "both", "action": "/u"}]},
        "roles": [
            {"name": "clerk"}, {"name": "boss", "roles": ["clerk"], "privileges": {"execute": "run,far", "uri": ["both"], "odd": "z"}},
            {"name": "a", "roles": "b"}, {"name": "b", "roles": "a"}, {"name": "c", "privileges": {"execute": ["none"]}},
        ],
    }
    two = {"roles": [{"name": "boss", "privileges": {"execute": "run"}}]}
    registry = spark.createDataFrame([("execute", "far", "urn:far"), ("execute", "run", "urn:other")], "kind string, privilege string, action string")
    got = settle_security(_compiled(spark, one=one, two=two), registry)
    assert rows(got.levels, "root", "kind", "name", "level") == [
        ("/one.json", "execute", "both", 0), ("/one.json", "execute", "run", 1), ("/one.json", "role", "boss", 2), ("/one.json", "role", "c", 0),
        ("/one.json", "role", "clerk", 0), ("/one.json", "uri", "both", 0), ("/two.json", "role", "boss", 0),
    ]
    assert rows(got.grants, "root", "role", "kind", "privilege", "action") == [
        ("/one.json", "boss", "execute", "far", "urn:far"), ("/one.json", "boss", "execute", "run", "urn:run"), ("/one.json", "boss", "uri", "both", "/u"),
        ("/two.json", "boss", "execute", "run", "urn:other"),
    ]
    assert {(r.kind, r.entity, r.prop, r.rule, r.value) for r in got.issue.collect()} == {
        ("security", '["/one.json","role","a"]', "level", "cycle", None), ("security", '["/one.json","role","b"]', "level", "cycle", None),
        ("role", "{/one.json, c}", "execute", "no-action", "none"), ("role", "{/one.json, boss}", "privileges.odd", "unknown-property", "z"),
    }


def test_targets_and_shards(spark, rows):
    one = {
        "hosts": [{"name": "h2"}, {"name": "h1"}],
        "databases": [
            {"id": "d", "name": "docs", "forests": 2}, {"name": "plain"}, {"name": "none", "forests": 0}, {"name": "many", "forests": 500}, {"name": "odd", "forests": "x"},
            {"name": "own", "forests": [{"name": "f1", "host": "h1"}, {"name": "f2", "host": "h9"}]}, {"name": "mixed", "forests": [{"name": "g1", "host": "h1"}, "g2"]},
        ],
        "servers": [{"id": "s", "name": "front", "type": "http", "port": "1", "content": {"idref": "d"}}],
        "sources": [{"name": "pages", "target": "s, docs, nowhere"}],
    }
    two = {"hosts": [{"name": "solo"}], "databases": [{"name": "docs", "forests": ["only"]}, {"name": "old", "forests": [{"name": "o", "host": "solo"}]}]}
    existing = spark.createDataFrame([("/one.json", "docs-001-001", "h1"), ("/two.json", "o", "away"), ("/one.json", "only", "h2")], "root string, name string, host string")
    got = settle_cluster(_compiled(spark, one=one, two=two), existing)
    assert rows(got.targets, "source", "target", "of", "key") == [("pages", "docs", "database", "d"), ("pages", "s", "server", "s")]
    assert rows(got.shards, "root", "db", "shard", "host", "exists") == [
        ("/one.json", "docs", "docs-001-001", "h1", True), ("/one.json", "docs", "docs-001-002", "h1", False), ("/one.json", "docs", "docs-002-001", "h2", False),
        ("/one.json", "docs", "docs-002-002", "h2", False), ("/one.json", "mixed", "g1", "h1", False), ("/one.json", "own", "f1", "h1", False),
        ("/one.json", "plain", "plain-001-001", "h1", False), ("/one.json", "plain", "plain-002-001", "h2", False), ("/two.json", "docs", "only", "solo", False),
    ]
    assert {(r.kind, r.rule) for r in got.issue.collect()} == {
        ("source", "unresolved"), ("database", "count-above-100"), ("database", "no-number-or-list"), ("shard", "no-such-host"), ("database", "mixed-hosts"), ("shard", "host-differs"),
    }
