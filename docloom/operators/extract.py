"""Rows, typed index values and lexicons out of document content."""

from __future__ import annotations

import json
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import Checked, cut, issue_rows

# Scalar types of templates and indexes → Spark types.
SCALAR_TYPES = {
    "string": "string",
    "boolean": "boolean",
    "int": "int",
    "unsignedInt": "bigint",
    "long": "bigint",
    "unsignedLong": "decimal(20,0)",
    "integer": "decimal(38,0)",
    "decimal": "decimal(38,18)",
    "float": "float",
    "double": "double",
    "date": "date",
    "dateTime": "timestamp",
}

def default_collation(type: Column, root: str) -> Column:
    """Collation of an index that names none: the server's root collation for strings, else empty."""
    return F.when(type == "string", root).otherwise("")


def spark_type(scalar: str) -> str:
    if scalar not in SCALAR_TYPES:
        raise ValueError(f"unknown scalar type: {scalar}")
    return SCALAR_TYPES[scalar]


def _steps(path: str) -> list[str]:
    return [s for s in path.split("/") if s]


def _json_path(steps: list[str]) -> str:
    return "$" + "".join("['" + s.replace("'", "\\'") + "']" for s in steps)


def _members(node: Column) -> Column:
    """A variant as a list: the items of an array, or the value itself."""
    return F.coalesce(
        F.try_variant_get(node, "$", "array<variant>"), F.when(node.isNotNull(), F.array(node))
    )


def _json_array(root: Column, steps: list[str]) -> Column:
    """The nodes at the end of a path, arrays on the way opened."""
    nodes = _members(root)
    for step in steps:
        nodes = _opened(nodes, _json_path([step]))
    return nodes


def _opened(nodes: Column, path: str) -> Column:
    return F.flatten(F.transform(nodes, lambda n: _members_or_none(F.try_variant_get(n, path, "variant"))))


def _members_or_none(node: Column) -> Column:
    return F.coalesce(_members(node), F.array().cast("array<variant>"))


def _json_nodes(docs: DataFrame, content: str, steps: list[str]) -> DataFrame:
    """One row per context node, arrays on the way opened step by step."""
    nodes = docs.withColumn("__node", F.try_parse_json(_unmarked(F.col(content))))
    for step in [None, *steps]:
        inner = F.col("__node") if step is None else F.try_variant_get("__node", _json_path([step]), "variant")
        nodes = nodes.withColumn("__node", F.explode(_members(inner)))
    return nodes


# A doctype, its internal subset included.
_DOCTYPE = r"""<!DOCTYPE(?:[^\[>"']|"[^"]*"|'[^']*'|\[(?:[^\]"'<]|"[^"]*"|'[^']*'|<!--.*?-->|<\?.*?\?>|<![^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*>)*\])*>"""
# First element of an XML text, behind declaration, comments and doctype: its name without prefix.
_ROOT = r"(?s)^\x{feff}?\s*(?:<\?.*?\?>\s*|<!--.*?-->\s*|" + _DOCTYPE + r"\s*)*<(?:[^\s/>:!?]+:)?([^\s/>!?]+)"
# Names are compared without their prefixes; text next to attributes or elements has a field of its own.
_TEXT = "_VALUE"
_XML = {"attributePrefix": "_", "valueTag": _TEXT, "columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE", "ignoreNamespace": "true"}


def _xml_step(step: str) -> str:
    """The field of a step: attributes are marked, prefixes dropped."""
    name = step.removeprefix("@").rsplit(":", 1)[-1]
    return "_" + name if step.startswith("@") else name


def _xml_tree(vals: list[str]) -> dict:
    """The fields that value paths need, children under their parents; a node with a value of its own has `_TEXT`."""
    tree: dict = {}
    for val in vals:
        inner = tree
        for step in _steps(val):
            inner = inner.setdefault(_xml_step(step), {})
        inner[_TEXT] = {}
    return tree


def _xml_type(tree: dict) -> str:
    fields = []
    for name, inner in tree.items():
        plain = name == _TEXT or set(inner) <= {_TEXT}
        fields.append(f"`{name}`: {'string' if plain else _xml_type(inner)}")
    return "struct<" + ", ".join(fields) + ">"


def _xml_value(node: Column, tree: dict, val: str) -> Column:
    for step in _steps(val):
        node, tree = node[_xml_step(step)], tree[_xml_step(step)]
    return node if set(tree) <= {_TEXT} else node[_TEXT]


def _unmarked(text: Column) -> Column:
    """A text without the mark of its byte order."""
    return F.when(text.startswith("\ufeff"), text.substr(F.lit(2), F.length(text))).otherwise(text)


def _xml_parsed(docs: DataFrame, content: str, type: str) -> DataFrame:
    """`__xml`: the root as a struct, `__bad` in it where the text is malformed."""
    schema = type.removesuffix(">") + ", `__bad`: string>"
    # a generator's result is a column of its own: filter and projections behind it share one parse
    return docs.withColumn("__xml", F.explode(F.array(F.from_xml(_unmarked(F.col(content)), schema, _XML))))


def _xml_nodes(docs: DataFrame, content: str, steps: list[str], tree: dict) -> DataFrame:
    """One row per context node as a struct of texts; malformed documents give none: see `extract_issues`."""
    type = _xml_type(tree)
    for step in reversed(steps[1:]):
        type = f"struct<`{_xml_step(step)}`: array<{type}>>"
    nodes = _xml_parsed(docs.filter(F.regexp_extract(F.col(content), _ROOT, 1) == _xml_step(steps[0])), content, type)
    nodes = nodes.filter(F.col("__xml.__bad").isNull()).withColumnRenamed("__xml", "__node")
    for step in steps[1:]:
        nodes = nodes.withColumn("__node", F.explode(F.col("__node")[_xml_step(step)]))
    return nodes


def extract_issues(docs: DataFrame, entity: str = "uri", content: str = "content", format: str = "json") -> DataFrame:
    """An issue per document whose content is missing or malformed, from which nothing can be extracted."""
    if format == "json":
        bad = docs.filter(F.try_parse_json(_unmarked(F.col(content))).isNull())
    else:
        # any element will do as the schema: what does not parse is marked all the same
        bad = _xml_parsed(docs, content, "struct<`__none`: string>").filter(
            F.col(content).isNull() | (F.regexp_extract(F.col(content), _ROOT, 1) == "") | F.col("__xml.__bad").isNotNull()
        )
    return issue_rows(bad, "document", F.col(entity), content, "malformed", None)


def extract_rows(docs: DataFrame, template: dict, keep: list[str], content: str = "content", format: str = "json", collections: str = "collections") -> dict[str, DataFrame]:
    """The views of a row template: one row per context node and row block.

    `template` has `context`, optionally `collections` (documents in any of them
    are in scope), and `rows` of `schemaName, viewName, columns` with `name,
    scalarType, val`. A `val` is a path below the context; in XML `@x` is an
    attribute. Values that do not fit their type come out null, as do missing
    ones. `keep` names the document columns to carry along. Several templates
    writing one view are a `unionByName` of their results.

    In XML, prefixes in paths and documents are not compared. Malformed documents
    give no rows: `extract_issues` reports them. Everything is one projection over
    the documents: no shuffle. Where there are several views the context nodes are
    written once, so that each document is parsed once.
    """
    template = template.get("template", template)
    scope = template.get("collections")
    if scope:
        docs = docs.filter(F.arrays_overlap(F.col(collections), F.array(*[F.lit(c) for c in scope])))
    steps = _steps(template["context"])
    blocks = template["rows"]
    needed = docs.select(*keep, F.col(content).alias("__content"))
    if format == "json":
        nodes = _json_nodes(needed, "__content", steps)
    else:
        tree = _xml_tree([c["val"] for b in blocks for c in b["columns"]])
        nodes = _xml_nodes(needed, "__content", steps, tree)
    nodes = nodes.select(*keep, "__node")
    if len(blocks) > 1:
        nodes = cut(nodes, "nodes")

    def value(column: dict) -> Column:
        type = spark_type(column["scalarType"])
        if format == "json":
            return F.try_variant_get("__node", _json_path(_steps(column["val"])), type)
        node = _xml_value(F.col("__node"), tree, column["val"])
        return F.trim(node).try_cast(type) if type != "string" else node

    return {
        f"{b['schemaName']}.{b['viewName']}": nodes.select(
            *keep, *[value(c).alias(c["name"]) for c in b["columns"]]
        )
        for b in blocks
    }


def range_values(docs: DataFrame, index: dict, uri: str = "uri", content: str = "content", format: str = "json") -> Checked:
    """Typed `(uri, value)` pairs of a range index.

    `index` has `type` and either `path` (from the root; a field index is the path
    of its field) or `name` (at any depth, in `namespace`), with `parent` for an
    XML attribute. Both may be lists. `invalid = ignore` (the default) drops
    values that are not of the type; `reject` reports them as issues. Documents
    that do not parse are reported in either case.

    A document is read and parsed once, whatever the number of names and paths.
    """
    type = spark_type(index["type"])
    label = "path" if "path" in index else "name"
    labels = index[label] if isinstance(index[label], list) else [index[label]]
    needed = docs.select(uri, F.col(content).alias("__content"))
    if format == "json" and label == "path":
        parsed = needed.withColumn("__root", F.explode(F.array(F.try_parse_json(_unmarked(F.col("__content"))))))
        found = F.when(F.col("__root").isNotNull(), F.flatten(F.array(*[_labelled(_json_texts(p), p) for p in labels])))
    elif format == "json":
        parsed, found = needed, _named_in_json(labels)("__content")
    elif label == "path":
        parsed, found = _xml_paths(needed, labels)
    else:
        parent = index.get("parent")
        parsed, found = needed, _named_in_xml(
            {_qualified(index.get("namespace"), n): n for n in labels},
            _qualified(parent.get("namespace"), parent["name"]) if parent else None,
        )("__content")
    # null stands for a document that does not parse, and stays as a row without a name
    each = parsed.select(uri, F.explode(F.coalesce(found, F.array(F.lit(None)))).alias("__v"))
    typed = each.select(
        uri, F.col("__v.name").alias("name"), F.col("__v.raw").alias("raw"), F.col("__v.raw").try_cast(type).alias("value"),
        F.col("__v").isNull().alias("__malformed"),
    )
    bad = typed.filter("__malformed OR (name IS NOT NULL AND value IS NULL)")
    if index.get("invalid", "ignore") == "ignore":
        bad = bad.filter("__malformed")
    rule = F.when(F.col("__malformed"), "malformed").otherwise("invalid-value")
    issue = issue_rows(bad, "index", F.col(uri), F.coalesce("name", F.lit(content)), rule, F.col("raw"))
    return Checked(typed.filter("value IS NOT NULL").select(uri, "name", "value"), issue)


_VALUES = "array<struct<name: string, raw: string>>"


def _labelled(texts: Column, label: str) -> Column:
    kept = F.filter(texts, lambda t: t.isNotNull())
    return F.transform(kept, lambda t: F.struct(F.lit(label).alias("name"), t.alias("raw"))).cast(_VALUES)


def _json_texts(path: str) -> Column:
    return F.transform(_json_array(F.col("__root"), _steps(path)), lambda n: F.try_variant_get(n, "$", "string"))


def _xml_paths(docs: DataFrame, paths: list[str]) -> tuple[DataFrame, Column]:
    """Documents with their root parsed once for all paths, and the values at these.

    Every element on the way may be repeated; a last one as well.
    """
    tree: dict = {}
    for path in paths:
        inner = tree
        for step in _steps(path)[1:]:
            inner = inner.setdefault(_xml_step(step), {})
        inner[_TEXT] = {}

    def type_of(node: dict) -> str:
        fields = []
        for name, inner in node.items():
            own = "string" if set(inner) <= {_TEXT} else type_of(inner)
            fields.append(f"`{name}`: string" if name == _TEXT or name.startswith("_") else f"`{name}`: array<{own}>")
        return "struct<" + ", ".join(fields) + ">"

    parsed = _xml_parsed(docs, "__content", type_of(tree)).withColumn("__name", F.regexp_extract("__content", _ROOT, 1))
    every = []
    for path in paths:
        root, *steps = _steps(path)
        nodes, at = F.array(F.col("__xml")), tree
        for step in steps:
            field = _xml_step(step)
            at = at[field]
            inner = _fields(nodes, field)
            nodes = inner if step.startswith("@") else F.flatten(F.filter(inner, lambda n: n.isNotNull()))
        if set(at) > {_TEXT}:
            nodes = _fields(nodes, _TEXT)
        every.append(F.when(F.col("__name") == _xml_step(root), _labelled(nodes, path)).otherwise(F.array().cast(_VALUES)))
    sound = (F.col("__name") != "") & F.col("__xml.__bad").isNull() & F.col("__content").isNotNull()
    return parsed, F.when(sound, F.flatten(F.array(*every)))


def _fields(nodes: Column, field: str) -> Column:
    return F.transform(nodes, lambda n: n[field])


def _by_text(find: Callable[[str | None], list[dict] | None]):
    """A function of whole texts as one of columns.

    Spark hands texts to Python 100 at a time. An Arrow batch is 10,000, whatever they weigh, and each worker would hold
    several forms of all of them.
    """
    return F.udf(find, _VALUES, useArrow=False)


def _named_in_json(names: list[str]):
    """Scalar texts under keys at any depth, by key; the items of an array are values of its key.

    No path expression reaches all depths, so whole documents go through the
    parser. A malformed document gives null.
    """
    wanted = set(names)

    def find(text: str | None) -> list[dict] | None:
        try:
            # objects as lists of pairs, numbers as written
            root = json.loads((text or "").removeprefix("\ufeff"), object_pairs_hook=_Pairs, parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            # nested beyond what the parser takes: reported like a malformed one
            return None
        found, todo = [], [(None, root)]
        while todo:
            key, value = todo.pop()
            if isinstance(value, _Pairs):
                todo.extend(reversed(value))
            elif isinstance(value, list):
                todo.extend((key, item) for item in reversed(value))
            elif key in wanted and value is not None:
                found.append({"name": key, "raw": value if isinstance(value, str) else str(value).lower()})
        return found

    return _by_text(find)


class _Pairs(list):
    """A JSON object, repeated keys kept."""


def _qualified(namespace: str | None, name: str) -> str:
    return f"{{{namespace}}}{name}" if namespace else name


def _named_in_xml(names: dict[str, str], parent: str | None):
    """Texts of the elements of these (qualified) names, or of such attributes on `parent`, anywhere in a document.

    `names` gives each its label. Whole documents go through the parser. The
    built-in way, `xpath`, is slower by half and fails the job on a malformed
    document, which here gives null.
    """

    def find(text: str | None) -> list[dict] | None:
        try:
            root = ElementTree.fromstring((text or "").removeprefix("\ufeff"))
        except ElementTree.ParseError:
            return None
        if parent is None:
            found = [(names[e.tag], "".join(e.itertext())) for e in root.iter() if e.tag in names]
        else:
            found = [(names[n], v) for e in root.iter(parent) for n, v in e.attrib.items() if n in names]
        return [{"name": n, "raw": v} for n, v in found]

    return _by_text(find)


def lexicon(docs: DataFrame, what: str = "collections", uri: str = "uri", collections: str = "collections") -> DataFrame:
    """Distinct collection names, or URIs, with the number of documents of each.

    Counted on the map side before the shuffle, so a collection that holds most
    documents arrives as one row per task.
    """
    if what == "uri":
        return docs.groupBy(F.col(uri).alias("value")).agg(F.count("*").alias("documents"))
    each = docs.select(F.explode(F.array_distinct(F.col(collections))).alias("value"))
    return each.groupBy("value").agg(F.count("*").alias("documents"))
