"""Row templates and range indexes over XML, all paths in one pass over each document.

The paths of any number of templates and indexes are compiled into one state machine.
A state is the set of path steps that may come next; its transitions, by qualified
name, are made when first needed and kept. Each document is parsed once, by a pull of
start and end events that builds no tree, so that its depth does not matter. Names are
compared by namespace URI and local name: prefixes in paths are resolved by the
template or index, those in documents by the parser.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.operators.collations import collated
from docloom.operators.extract import spark_type
from docloom.storage import cut, dealt, issue_rows

# Rows of results that a task holds before it passes them on.
HELD = 20_000


class Step(NamedTuple):
    """One step of a path: any depth or the next one; namespace (empty: none) and local name, `*` for any."""

    deep: bool
    namespace: str
    name: str

    def takes(self, namespace: str, name: str) -> bool:
        return (self.name == "*" and self.namespace in ("*", namespace)) or (self.name == name and self.namespace in ("*", namespace))


class Path(NamedTuple):
    """Steps to an element, and the attribute of it that is meant, if one is."""

    steps: tuple[Step, ...]
    attribute: tuple[str, str] | None = None

    def then(self, other: Path) -> Path:
        return Path(self.steps + other.steps, other.attribute)


def _resolved(name: str, namespaces: dict[str, str], what: str) -> tuple[str, str]:
    prefix, colon, local = name.rpartition(":")
    if not colon:
        return "*" if name == "*" else "", local
    if prefix == "*":
        return "*", local
    if prefix not in namespaces:
        raise ValueError(f"unknown prefix in {what}: {prefix}")
    return namespaces[prefix], local


def parse_path(path: str, namespaces: dict[str, str] | None = None) -> Path:
    """A path of names (`p:name`, `name` in no namespace, `*:name` in any, `*`), `//` for any depth, and `@name` or `text()` at its end."""
    steps: list[Step] = []
    attribute, deep = None, False
    parts = path.strip().removeprefix("./").split("/")
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "":
            deep = deep or 0 < n < len(parts) - 1
        elif part == "." or (part == "text()" and last):
            continue
        elif part.startswith("@"):
            if not last:
                raise ValueError(f"an attribute has nothing below it: {path}")
            attribute = _resolved(part[1:], namespaces or {}, path)
        elif any(c in part for c in "[]()|"):
            raise ValueError(f"only names are supported in paths: {path}")
        else:
            steps.append(Step(deep, *_resolved(part, namespaces or {}, path)))
            deep = False
    return Path(tuple(steps), attribute)


class Wanted(NamedTuple):
    """What a path's nodes are for: slot `slot` of the rows of `target`, or, with slot -1, a row each."""

    path: Path
    target: int
    slot: int
    label: str


class Machine:
    """All wanted paths as one automaton over the names of elements on the way down."""

    def __init__(self, wanted: list[Wanted]):
        self.wanted = wanted
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accepts: list[tuple[Wanted, ...]] = []
        self.start = self._state(frozenset((k, 0) for k in range(len(wanted))))

    def _state(self, of: frozenset) -> int:
        if of not in self.numbers:
            self.numbers[of] = len(self.sets)
            self.sets.append(of)
            self.next.append({})
            self.accepts.append(tuple(self.wanted[k] for k, at in sorted(of) if at == len(self.wanted[k].path.steps)))
        return self.numbers[of]

    def step(self, state: int, name: str) -> int:
        """The state below an element called `name` (the parser's: URI, space, local name)."""
        to = self.next[state].get(name)
        if to is None:
            namespace, _, local = name.rpartition(" ")
            reached = set()
            for k, at in self.sets[state]:
                steps = self.wanted[k].path.steps
                if at < len(steps):
                    if steps[at].deep:
                        reached.add((k, at))
                    if steps[at].takes(namespace, local):
                        reached.add((k, at + 1))
            to = self.next[state][name] = self._state(frozenset(reached))
        return to


def _attribute(attributes: dict[str, str], namespace: str, name: str) -> list[str]:
    if namespace not in ("*",) and name != "*":
        value = attributes.get(f"{namespace} {name}" if namespace else name)
        return [] if value is None else [value]
    found = []
    for key, value in attributes.items():
        uri, _, local = key.rpartition(" ")
        if namespace in ("*", uri) and name in ("*", local):
            found.append(value)
    return found


def read(machine: Machine, contexts: dict[int, int], text: str) -> list[tuple[int, str, list[str | None]]] | None:
    """Rows (target, label, values) in document order of their ends, or None for a malformed text.

    `contexts` has the number of slots of each target that is a template: its paths of slot
    -1 begin a row, the first node of each other path fills the slot.
    """
    out: list[tuple[int, str, list[str | None]]] = []
    rows: dict[int, list[str | None]] = {}
    states, closing = [machine.start], []
    chunks: list[str] = []
    open_texts = 0

    def put(w: Wanted, value: str) -> None:
        if w.target in contexts:
            if rows[w.target][w.slot] is None:
                rows[w.target][w.slot] = value
        else:
            out.append((w.target, w.label, [value]))

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal open_texts
        state = machine.step(states[-1], name)
        states.append(state)
        ends = []
        for w in machine.accepts[state]:
            if w.target in contexts and w.slot < 0:
                rows[w.target] = [None] * contexts[w.target]
                ends.append((w, -1))
            elif w.path.attribute is not None:
                for value in _attribute(attributes, *w.path.attribute):
                    put(w, value)
            else:
                ends.append((w, len(chunks)))
                open_texts += 1
        closing.append(ends)

    def end(_: str) -> None:
        nonlocal open_texts
        states.pop()
        # values before the row that they are in
        for w, at in reversed(closing.pop()):
            if at < 0:
                out.append((w.target, w.label, rows.pop(w.target)))
            else:
                put(w, "".join(chunks[at:]))
                open_texts -= 1
        if not open_texts:
            chunks.clear()

    def characters(data: str) -> None:
        if open_texts:
            chunks.append(data)

    parser = expat.ParserCreate("utf-8", " ")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, characters
    try:
        parser.Parse(text.encode("utf-8", "surrogatepass"), True)
    except expat.ExpatError:
        return None
    return out


class Extracted(NamedTuple):
    """`views`: a DataFrame per `schema.view`. `values`: `index`, `uri`, `name`, `raw`, one row per indexed value; `ranges`
    has them typed, per index. `issue`: malformed documents, and invalid values of indexes that reject them."""

    views: dict[str, DataFrame]
    values: DataFrame
    ranges: dict[str, DataFrame]
    issue: DataFrame


def _wanted(templates: dict[str, dict], indexes: dict[str, dict]) -> tuple[list[Wanted], dict[int, int]]:
    wanted, contexts = [], {}
    for n, template in enumerate(templates.values()):
        spaces = template.get("namespaces", {})
        context = parse_path(template["context"], spaces)
        if context.attribute or any(s.deep for s in context.steps):
            raise ValueError(f"a context is a path of elements from the root: {template['context']}")
        wanted.append(Wanted(context, n, -1, ""))
        vals = [c["val"] for block in template["rows"] for c in block["columns"]]
        wanted += [Wanted(context.then(parse_path(v, spaces)), n, k, "") for k, v in enumerate(vals)]
        contexts[n] = len(vals)
    for n, (label, index) in enumerate(indexes.items(), len(templates)):
        spaces = index.get("namespaces", {})
        if "path" in index:
            paths = [(p, parse_path(p, spaces)) for p in _list(index["path"])]
        else:
            paths = [(name, _named(index, name)) for name in _list(index["name"])]
        wanted += [Wanted(path, n, -1, name) for name, path in paths]
    return wanted, contexts


def _list(x) -> list:
    return x if isinstance(x, list) else [x]


def _named(index: dict, name: str) -> Path:
    """An element at any depth, or an attribute of its parent element; names without a namespace are in none."""
    parent = index.get("parent")
    if parent:
        return Path((Step(True, parent.get("namespace", ""), parent["name"]),), (index.get("namespace", ""), name))
    return Path((Step(True, index.get("namespace", ""), name),))


def extract_xml(
    docs: DataFrame, templates: dict[str, dict], indexes: dict[str, dict] | None = None, keep: list[str] | None = None, uri: str = "uri",
    content: str = "content", collections: str = "collections", root_collation: str | None = None,
) -> Extracted:
    """All views of all templates, and the values of all indexes, from one parse of each document.

    A template has `context` (a path from the root), optionally `collections`, `namespaces`
    (prefix to URI), and `rows` as in `extract_rows`; an index has `type` and `path`,
    or `name` with `namespace` and `parent`, as in `range_values`, and `namespaces` for
    its paths. `keep` names document columns that views carry along (default: `uri`). An element's value
    is all text in it; of several nodes of one column in a row the first counts. Values that do not
    fit their type come out null in views; in indexes they are dropped, or with
    `invalid` = `reject` reported. With `root_collation`, strings of an index have the collation that it names.

    Null and malformed documents, prefixes without a namespace among the faults, are issues and
    give nothing else; a byte order mark and a doctype with an internal subset are none. External entities are not read.
    What was found is written once; repeated documents each give their rows; an empty table gives none.
    """
    templates = {k: t.get("template", t) for k, t in templates.items()}
    indexes, keep = indexes or {}, keep or [uri]
    wanted, contexts = _wanted(templates, indexes)
    scoped = any(t.get("collections") for t in templates.values())
    carried = list(dict.fromkeys([uri, *keep, *([collections] if scoped else [])]))
    source = docs.select(*carried, F.col(content).cast("string").alias("__content"))
    made = [T.StructField("__target", T.IntegerType()), T.StructField("__label", T.StringType()), T.StructField("__values", T.ArrayType(T.StringType()))]
    schema = T.StructType([*source.schema.fields[:-1], *made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine(wanted)
        for batch in batches:
            at, found = [], []
            for k, text in enumerate(batch.column(len(carried)).to_pylist()):
                rows = None if text is None else read(machine, contexts, text.removeprefix("\ufeff"))
                rows = [(-1, "", [])] if rows is None else rows
                at += [k] * len(rows)
                found += rows
                if len(found) >= HELD:
                    yield _taken(batch, at, found, schema)
                    at, found = [], []
            if found:
                yield _taken(batch, at, found, schema)

    everything = cut(dealt(source, F.xxhash64("__content")).mapInArrow(run, schema), "xml-values")
    views: dict[str, list[DataFrame]] = {}
    for n, template in enumerate(templates.values()):
        rows = everything.filter(F.col("__target") == n)
        if scope := template.get("collections"):
            rows = rows.filter(F.arrays_overlap(F.col(collections), F.array(*[F.lit(c) for c in scope])))
        slot = 0
        for block in template["rows"]:
            columns = []
            for c in block["columns"]:
                columns.append(_typed(F.get("__values", F.lit(slot)), c["scalarType"]).alias(c["name"]))
                slot += 1
            views.setdefault(f"{block['schemaName']}.{block['viewName']}", []).append(rows.select(*keep, *columns))
    named = everything.filter(F.col("__target") >= len(templates))
    label = F.array(*[F.lit(k) for k in indexes]) if indexes else F.array().cast("array<string>")
    values = named.select(
        F.get(label, F.col("__target") - len(templates)).alias("index"), uri, F.col("__label").alias("name"), F.get("__values", F.lit(0)).alias("raw")
    )
    issue = issue_rows(everything.filter("__target = -1"), "document", F.col(uri), content, "malformed", None)
    ranges = {}
    for k, index in indexes.items():
        own = values.filter(F.col("index") == k)
        typed = own.select(uri, "name", "raw", _typed(F.col("raw"), index["type"]).alias("value"))
        if index.get("invalid", "ignore") == "reject":
            bad = typed.filter("value IS NULL")
            issue = issue.unionByName(issue_rows(bad, "index", F.col(uri), F.col("name"), "invalid-value", F.col("raw")))
        good = typed.filter("value IS NOT NULL").select(uri, "name", "value")
        if index["type"] == "string" and root_collation is not None:
            good = good.withColumn("value", collated(F.col("value"), index.get("collation", root_collation), root_collation))
        ranges[k] = good
    return Extracted({k: reduce(DataFrame.unionByName, v) for k, v in views.items()}, values, ranges, issue)


def _typed(value: Column, scalar: str) -> Column:
    type = spark_type(scalar)
    return value if type == "string" else F.trim(value).try_cast(type)


def _taken(batch: pa.RecordBatch, at: list[int], found: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    of = pa.array(at, pa.int64())
    kept = [c.take(of) for c in batch.columns[:-1]]
    targets, labels, values = zip(*found)
    made = [pa.array(targets, pa.int32()), pa.array(labels, pa.string()), pa.array(values, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays([*kept, *made], names=schema.fieldNames())
