"""Schemas of the record kinds an environment may declare."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions.values import split_list
from docloom.operators.extract import default_collation
from docloom.operators.validate import Prop

# Fixed values below: property names, target names, types, closed sets and defaults.

HOST = [
    Prop("host", "compose", ignored=True),
    Prop("host", "comment", ignored=True),
    Prop("host", "name", mandatory=True, ignored=True),
    Prop("host", "apis", ignored=True),
    Prop("host", "host"),
    Prop("host", "group", default="Default"),
]

DATABASE = [
    Prop("database", "compose", ignored=True),
    Prop("database", "comment", ignored=True),
    Prop("database", "id", ignored=True),
    Prop("database", "name", mandatory=True, ignored=True),
    Prop("database", "properties", ignored=True),
    Prop("database", "forests", ignored=True),
    Prop("database", "schema", ignored=True),
    Prop("database", "security", ignored=True),
    Prop("database", "triggers", ignored=True),
    Prop("database", "indexes", ignored=True),
    Prop("database", "indexes.ranges", ignored=True),
    Prop("database", "indexes.namespaces", ignored=True),
    Prop("database", "fields", target="field", type="list", compare="struct_list"),
    Prop("database", "searches", ignored=True),
    Prop("database", "lexicons", ignored=True),
    Prop("database", "lexicons.uri", target="uri-lexicon", type="boolean"),
    Prop("database", "lexicons.collection", target="collection-lexicon", type="boolean"),
]


# Classes of range indexes: a kind each, as they need different properties.
INDEX_CLASSES = ["field-index", "path-index", "attribute-index", "element-index"]


def index(root_collation: str) -> list[Prop]:
    """Range indexes of all classes; `root_collation` is the URI the server gives its root collation."""
    specs = []
    for kind in INDEX_CLASSES:
        specs += [
            Prop(kind, "type", target="scalar-type", mandatory=True),
            Prop(kind, "positions", target="range-value-positions"),
            Prop(kind, "invalid", target="invalid-values", type="enum", values=("ignore", "reject")),
            Prop(kind, "collation", default=("type", lambda type: default_collation(type, root_collation))),
        ]
    named = ["attribute-index", "element-index"]
    return [
        *specs,
        Prop("field-index", "field", target="field-name", mandatory=True),
        Prop("path-index", "path", target="path-expression", mandatory=True),
        *[Prop(kind, "name", target="localname", mandatory=True) for kind in named],
        *[Prop(kind, "namespace", target="namespace-uri", default="") for kind in named],
        Prop("attribute-index", "parent", ignored=True),
        Prop("attribute-index", "parent.name", target="parent-localname", mandatory=True),
        Prop("attribute-index", "parent.namespace", target="parent-namespace-uri", default=""),
    ]


def index_class(field: Column, path: Column, parent: Column) -> Column:
    """The class of a declaration: by field, path or parent, in this order, else by element."""
    return (
        F.when(field.isNotNull(), "field-index").when(path.isNotNull(), "path-index")
        .when(parent.isNotNull(), "attribute-index").otherwise("element-index")
    )


FOREST = [
    Prop("forest", "comment", ignored=True),
    Prop("forest", "name", mandatory=True, ignored=True),
    Prop("forest", "properties", ignored=True),
    Prop("forest", "host", ignored=True),
    Prop("forest", "replica", ignored=True),
    Prop("forest", "replicas", ignored=True),
    Prop("forest", "dir", target="data-directory"),
    Prop("forest", "large-dir", target="large-data-directory"),
    Prop("forest", "fast-dir", target="fast-data-directory"),
]

SERVER = [
    Prop("server", "compose", ignored=True),
    Prop("server", "comment", ignored=True),
    Prop("server", "id", ignored=True),
    Prop("server", "name", mandatory=True, ignored=True),
    Prop("server", "group", ignored=True),
    Prop("server", "properties", ignored=True),
    Prop("server", "rest-config", ignored=True),
    Prop("server", "content", mandatory=True, ignored=True),
    Prop("server", "modules", ignored=True),
    Prop("server", "type", target="server-type", type="enum", values=("http", "rest", "xdbc"), mandatory=True, frozen=True),
    Prop("server", "port", type="integer", mandatory=True),
    Prop("server", "root"),
    Prop("server", "rewriter", target="url-rewriter"),
    Prop("server", "handler", target="error-handler"),
    Prop("server", "output", ignored=True),
]

SOURCE = [
    Prop("source", "compose", ignored=True),
    Prop("source", "comment", ignored=True),
    Prop("source", "name", mandatory=True, ignored=True),
    Prop("source", "filter", ignored=True),
    Prop("source", "dir"),
    Prop("source", "type", type="enum", values=("plain", "rest-src", "tde")),
    Prop("source", "garbage", type="list", compare="list"),
    Prop("source", "include", type="list", compare="list"),
    Prop("source", "exclude", type="list", compare="list"),
    Prop("source", "target", type="list", compare="list"),
    Prop("source", "collections", target="collection", type="list", compare="list"),
    Prop("source", "permissions", target="permission", type="json", compare="perms"),
]

MIME = [
    Prop("mime", "compose", ignored=True),
    Prop("mime", "comment", ignored=True),
    Prop("mime", "name", mandatory=True, ignored=True),
    Prop("mime", "extensions", type="list", mandatory=True, frozen=True, compare="list"),
    Prop("mime", "format", type="enum", values=("binary", "json", "text", "xml"), mandatory=True, frozen=True),
]


def _privilege(kind: str) -> list[Prop]:
    return [
        Prop(kind, "compose", ignored=True),
        Prop(kind, "comment", ignored=True),
        Prop(kind, "name", target="privilege-name", mandatory=True),
        Prop(kind, "action", mandatory=True),
        Prop(kind, "roles", target="role", type="list", compare="list"),
    ]


ROLE = [
    Prop("role", "compose", ignored=True),
    Prop("role", "comment", ignored=True),
    Prop("role", "name", target="role-name", mandatory=True),
    Prop("role", "desc", target="description"),
    Prop("role", "compartment"),
    Prop("role", "permissions", target="permission", type="json", compare="perms", phase=2),
    Prop("role", "roles", target="role", type="list", compare="list"),
    Prop("role", "collections", target="collection", type="list", compare="list"),
    Prop("role", "external", target="external-name", type="list", compare="list"),
    Prop("role", "privileges", target="privilege", type="json", compare="perms"),
]

USER = [
    Prop("user", "compose", ignored=True),
    Prop("user", "comment", ignored=True),
    Prop("user", "name", target="user-name", mandatory=True),
    Prop("user", "password", mandatory=True),
    Prop("user", "desc", target="description"),
    Prop("user", "roles", target="role", type="list", compare="list"),
    Prop("user", "collections", target="collection", type="list", compare="list"),
    Prop("user", "permissions", target="permission", type="json", compare="perms"),
]

ALL = [
    *HOST, *DATABASE, *FOREST, *SERVER, *SOURCE, *MIME, *_privilege("execute"), *_privilege("uri"), *ROLE, *USER,
]


def by_target(specs: list[Prop]) -> list[Prop]:
    """The same schema keyed by target names, for comparing validated properties."""
    return [
        Prop(s.kind, s.target or s.name, type=s.type, values=s.values, frozen=s.frozen, compare=s.compare, phase=s.phase)
        for s in specs
        if not s.ignored
    ]


def as_json_lists(props, specs: list[Prop] = ALL):
    """Delimited list values as JSON lists, the form the comparisons read."""
    names = sorted({s.target or s.name for s in specs if s.type == "list"})
    value = F.col("value")
    listed = F.to_json(split_list(value))
    return props.withColumn(
        "value", F.when(F.col("prop").isin(names) & ~value.startswith("["), listed).otherwise(value)
    )
