"""All paths in one pass over XML documents, against a tree walk with resolved names; collations of string values."""

from xml.etree import ElementTree

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators.collations import between, collation_name, value_lexicon
from docloom.operators.xml_paths import Machine, Wanted, extract_xml, parse_path, read

ROOT = "http://example.org/collation"
SPACES = {"a": "urn:a", "b": "urn:b"}


def _walk(text, path):
    """Values at a path, by walking the tree; in the order of their ends."""
    steps, attribute = parse_path(path, SPACES)
    out = []

    def name(tag):
        return tuple(tag[1:].split("}")) if tag.startswith("{") else ("", tag)

    def matches(chain, steps):
        if not steps:
            return not chain
        if not chain:
            return False
        step = steps[-1]
        if not step.takes(*name(chain[-1])):
            return False
        return any(matches(chain[:k], steps[:-1]) for k in range(len(chain))) if step.deep else matches(chain[:-1], steps[:-1])

    def go(e, chain):
        chain = [*chain, e.tag]
        hit = matches(chain, list(steps))
        if hit and attribute:
            out.extend(v for k, v in e.attrib.items() if name(k) == attribute)
        for child in e:
            go(child, chain)
        if hit and not attribute:
            out.append("".join(e.itertext()))

    go(ElementTree.fromstring(text), [])
    return out


NODES = st.recursive(
    st.sampled_from(["t", "u &amp; v", "", "<!-- c -->"]),
    lambda inner: st.tuples(st.sampled_from(["a:m", "b:m", "m", "a:n", "n"]), st.sampled_from(["", " id='1'", " a:id='2' id='3'"]), st.lists(inner, max_size=3)).map(
        lambda x: f"<{x[0]}{x[1]}>{''.join(x[2])}</{x[0]}>"
    ),
    max_leaves=12,
)
PATHS = ["/r/a:m", "/r/*/m", "//a:m", "/r//b:m/@id", "//*:m", "/r/a:m/a:n/@a:id", "//m//n", "/r", "/*/*:n/text()"]


@given(NODES)
@settings(max_examples=150, deadline=None)
def test_values_are_those_of_a_tree_walk(inner):
    text = f"<r xmlns:a='urn:a' xmlns:b='urn:b'>{inner}</r>"
    machine = Machine([Wanted(parse_path(p, SPACES), n, -1, p) for n, p in enumerate(PATHS)])
    got = read(machine, {}, text)
    for n, p in enumerate(PATHS):
        # attributes come when the element begins
        assert sorted(v for t, _, (v,) in got if t == n) == sorted(_walk(text, p)), p
        if "@" not in p:
            assert [v for t, _, (v,) in got if t == n] == _walk(text, p)


def test_paths_that_make_no_sense():
    for path in ("/r/@id/x", "/r[1]", "/c:r", "/r/node()"):
        with pytest.raises(ValueError):
            parse_path(path, SPACES)
    with pytest.raises(ValueError):
        Machine([]) and extract_xml(None, {"t": {"context": "//a", "rows": []}})


TEMPLATE = {
    "context": "/a:doc/a:m", "namespaces": SPACES, "collections": ["in"],
    "rows": [{"schemaName": "s", "viewName": "v", "columns": [
        {"name": "id", "scalarType": "int", "val": "@id"}, {"name": "own", "scalarType": "string", "val": "a:x"},
        {"name": "other", "scalarType": "string", "val": "b:x"}, {"name": "all", "scalarType": "string", "val": "."}]}],
}
OTHER = {"context": "/doc", "rows": [{"schemaName": "s", "viewName": "v", "columns": [
    {"name": "id", "scalarType": "int", "val": "n"}, {"name": "own", "scalarType": "string", "val": "none"},
    {"name": "other", "scalarType": "string", "val": "@k"}, {"name": "all", "scalarType": "string", "val": "text()"}]}]}


def _doc(inner, head=""):
    return f"{head}<a:doc xmlns:a='urn:a' xmlns:b='urn:b'>{inner}</a:doc>"


def test_rows_values_and_issues_from_one_parse(spark, rows):
    deep = "<y>" * 50_000 + "<b:x>deep</b:x>" + "</y>" * 50_000
    docs = [
        ("one", _doc("<a:m id='1'><b:x>B</b:x><a:x>A</a:x><a:x>second</a:x></a:m><a:m id='x'/>"), ["in"]),
        ("two", "﻿" + _doc("<m><a:x>not of the context</a:x></m><a:m><b:x>only B</b:x></a:m>"), ["in", "more"]),
        ("three", _doc("<a:m id='3'>&e;</a:m>", "<?xml version='1.0' encoding='latin1'?><!DOCTYPE d [<!ENTITY e 'ent]>ity'> <!-- ]> -->]>"), ["in"]),
        ("four", _doc(deep), ["in"]), ("five", _doc("<a:m id='5'/>"), ["out"]), ("six", "<doc k='K'>text<n>6</n></doc>", None),
        ("bad", "<a:doc/>", ["in"]), ("cut", _doc("<a:m>")[:-3], ["in"]), ("none", None, ["in"]), ("", "", ["in"]),
    ]
    df = spark.createDataFrame(docs, "uri string, content string, collections array<string>")
    indexes = {
        "b": {"type": "string", "name": "x", "namespace": "urn:b"},
        "ids": {"type": "int", "path": ["/a:doc/a:m/@id", "/doc/n"], "namespaces": SPACES, "invalid": "reject"},
    }
    got = extract_xml(df, {"t": TEMPLATE, "o": OTHER}, indexes)
    assert rows(got.views["s.v"], "uri", "id", "own", "other", "all") == sorted(
        [("one", 1, "A", "B", "BAsecond"), ("one", None, None, None, ""), ("two", None, None, "only B", "only B"), ("three", 3, None, None, "ent]>ity"), ("six", 6, None, "K", "text6")],
        key=lambda r: tuple((x is not None, str(x)) for x in r),
    )
    assert rows(got.ranges["b"], "uri", "value") == [("four", "deep"), ("one", "B"), ("two", "only B")]
    assert rows(got.ranges["ids"], "uri", "name", "value") == [
        ("five", "/a:doc/a:m/@id", 5), ("one", "/a:doc/a:m/@id", 1), ("six", "/doc/n", 6), ("three", "/a:doc/a:m/@id", 3),
    ]
    assert {(r.entity, r.rule, r.value) for r in got.issue.collect()} == {
        ("bad", "malformed", None), ("cut", "malformed", None), ("none", "malformed", None), ("", "malformed", None), ("one", "invalid-value", "x"),
    }
    assert extract_xml(df.limit(0), {"t": TEMPLATE}, indexes).values.count() == 0


def test_collation_names():
    assert collation_name(None, ROOT) == collation_name("", ROOT) == collation_name(ROOT + "/codepoint", ROOT) == "UTF8_BINARY"
    assert collation_name(ROOT, ROOT + "/") == "UNICODE" and collation_name(ROOT + "/S1", ROOT) == "UNICODE_CI_AI"
    assert collation_name(ROOT + "/fr/S2", ROOT) == "fr_CI" and collation_name(ROOT + "/de", ROOT) == "de"
    for wrong in ("http://else/x", ROOT + "/en/S1/T0020", ROOT + "/S9x1"):
        with pytest.raises(ValueError):
            collation_name(wrong, ROOT)


def test_values_obey_their_collation(spark, rows):
    words = ["Élan", "elan", "ELAN", "zebra", "Zebra", "apple"]
    df = spark.createDataFrame([(f"d{n}", f"<w>{w}</w>") for n, w in enumerate(words)] + [("d0", "<w>élan</w>")], "uri string, content string")
    names = {"bin": "/codepoint", "case": "/S2", "base": "/S1", "root": ""}
    got = extract_xml(df, {}, {k: {"type": "string", "path": "/w", "collation": ROOT + v} for k, v in names.items()}, root_collation=ROOT).ranges
    lexicon = {k: rows(value_lexicon(v), "value", "documents", "frequency") for k, v in got.items()}
    assert lexicon["base"] == [("ELAN", 3, 4), ("Zebra", 2, 2), ("apple", 1, 1)]
    assert lexicon["case"] == [("ELAN", 2, 2), ("Zebra", 2, 2), ("apple", 1, 1), ("Élan", 1, 2)]
    assert len(lexicon["bin"]) == len(lexicon["root"]) == 7
    assert {r.uri for r in between(got["base"], "ÉLAN", "élan").collect()} == {"d0", "d1", "d2"}
    assert {r.uri for r in between(got["bin"], "a", "f").collect()} == {"d1", "d5"}
    assert {r.uri for r in between(got["root"], low="f").collect()} == {"d3", "d4"}
    # joins as well
    other = got["base"].filter("uri IN ('d0', 'd3')").select("value").distinct()
    assert {r.uri for r in got["base"].join(other, "value").collect()} == {"d0", "d1", "d2", "d3", "d4"}
