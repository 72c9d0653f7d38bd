"""Lookups, layered merges, reconciliation and dependency graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docloom.operators import cluster, environment, execute, graph, layers, lookup, reconcile as rec, schemas
from docloom.operators.validate import Prop, apply_defaults, flatten_nested, validate
from docloom.plans.registry import Tables, query


def text(c: str):
    return F.col(c).cast("string")


# --- lookups -----------------------------------------------------------------


def _refs(t: Tables) -> DataFrame:
    ref = F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("N"), text("c_nationkey"))).otherwise(text("c_custkey"))
    return t.customer.select("c_custkey", ref.alias("ref"))


def _suppliers(t: Tables) -> DataFrame:
    return t.supplier.select(
        text("s_suppkey").alias("id"), F.concat(F.lit("N"), text("s_nationkey")).alias("name"), "s_acctbal"
    )


_REFS_SQL = """
    r AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'N' || c_nationkey ELSE CAST(c_custkey AS VARCHAR) END AS ref
          FROM customer),
    s AS (SELECT CAST(s_suppkey AS VARCHAR) AS id, 'N' || s_nationkey AS name, s_acctbal FROM supplier)
"""


@query(
    f"""
    WITH {_REFS_SQL},
    m AS (SELECT r.ref, s.id, s.name, s.s_acctbal, count(*) OVER (PARTITION BY r.c_custkey) AS n, r.c_custkey
          FROM r JOIN s ON s.id = r.ref OR s.name = r.ref)
    SELECT r.c_custkey, r.ref, m.id, m.name, m.s_acctbal
    FROM r LEFT JOIN m ON m.c_custkey = r.c_custkey AND m.n = 1
    """
)
def lookup_unique(t: Tables) -> DataFrame:
    return lookup.lookup_unique(_refs(t), _suppliers(t), "ref", "id", "name").good


@query(
    f"""
    WITH {_REFS_SQL},
    m AS (SELECT DISTINCT r.ref, s.id, s.name FROM r JOIN s ON s.id = r.ref OR s.name = r.ref)
    SELECT ref AS entity, 'ambiguous' AS rule, id || '/' || name AS value
    FROM m QUALIFY count(*) OVER (PARTITION BY ref) > 1
    """
)
def lookup_ambiguous(t: Tables) -> DataFrame:
    issue = lookup.lookup_unique(_refs(t), _suppliers(t), "ref", "id", "name").issue
    return issue.select("entity", "rule", "value")


@query(
    """
    WITH e AS (SELECT unnest([source, lang, CAST(doc_id AS VARCHAR)]) AS target FROM documents),
    a AS (SELECT DISTINCT source AS k FROM documents), b AS (SELECT CAST(doc_id AS VARCHAR) AS k FROM labels)
    SELECT CASE WHEN a.k IS NOT NULL THEN 'first' WHEN b.k IS NOT NULL THEN 'second' END AS target_kind,
           coalesce(a.k, b.k) AS target_key, count(*) AS n
    FROM e LEFT JOIN a ON a.k = target LEFT JOIN b ON b.k = target GROUP BY ALL
    """
)
def resolve_targets(t: Tables) -> DataFrame:
    sources = t.documents.select(F.array("source", "lang", text("doc_id")).alias("target"))
    first = t.documents.select(F.col("source").alias("id"), F.lit(None).cast("string").alias("name")).distinct()
    second = t.labels.select(F.lit(None).cast("string").alias("id"), text("doc_id").alias("name"))
    found = lookup.resolve_targets(sources, first, second, "target", "id", "name")
    return found.groupBy("target_kind", "target_key").agg(F.count("*").alias("n"))


@query(
    """
    WITH l AS (
      SELECT l_returnflag AS f, l_linestatus AS s, CAST(l_partkey AS VARCHAR) AS part, n.s_suppkey AS n_id, n.s_name AS n_name,
             i.s_suppkey AS i_id, i.s_name AS i_name
      FROM lineitem
      LEFT JOIN supplier n ON l_returnflag = 'A' AND n.s_name = 'Supplier#' || printf('%09d', l_suppkey)
      LEFT JOIN supplier i ON l_returnflag = 'R' AND i.s_suppkey = l_partkey),
    r AS (
      SELECT CASE WHEN n_id IS NOT NULL THEN 'nameref' WHEN i_id IS NOT NULL THEN 'idref'
                  WHEN f = 'R' THEN 'self' WHEN f = 'N' AND s = 'O' THEN 'system' ELSE 'unresolved' END AS resolution,
             CASE WHEN n_id IS NOT NULL THEN n_name WHEN i_id IS NOT NULL THEN i_name
                  WHEN f = 'R' THEN part WHEN f = 'N' AND s = 'O' THEN 'sys-O' END AS target_name
      FROM l)
    SELECT resolution, target_name, count(*) AS n FROM r GROUP BY ALL
    """
)
def resolve_reference(t: Tables) -> DataFrame:
    flag = F.col("l_returnflag")
    refs = t.lineitem.select(
        F.when(flag == "A", F.format_string("Supplier#%09d", "l_suppkey")).alias("nameref"),
        F.when(flag == "R", text("l_partkey")).alias("idref"),
        F.when((flag == "N") & (F.col("l_linestatus") == "O"), "sys-O").alias("sysref"),
        text("l_partkey").alias("own"),
    )
    dim = t.supplier.select(text("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    good, issue = lookup.resolve_reference(refs, dim, own_id="own", own_name="own")
    rows = good.select("resolution", "target_name").unionByName(
        issue.select(F.col("rule").alias("resolution"), F.lit(None).cast("string").alias("target_name"))
    )
    return rows.groupBy("resolution", "target_name").agg(F.count("*").alias("n"))


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'F' AND c_acctbal >= 0 THEN 'local ' || c_mktsegment
                WHEN o_orderstatus IN ('F', 'O') THEN 'remote ' || c_nationkey END AS action
    FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    """
)
def registry_lookup(t: Tables) -> DataFrame:
    refs = t.orders.select("o_orderkey", F.col("o_custkey").alias("name"), F.col("o_orderstatus").alias("kind"))
    local = t.customer.select(
        F.col("c_custkey").alias("name"), F.lit("F").alias("kind"),
        F.when(F.col("c_acctbal") >= 0, F.concat(F.lit("local "), "c_mktsegment")).otherwise("").alias("action"),
    )
    remote = t.customer.select(
        F.col("c_custkey").alias("name"), F.explode(F.array(F.lit("F"), F.lit("O"))).alias("kind"),
        F.concat(F.lit("remote "), text("c_nationkey")).alias("action"),
    )
    return lookup.registry_lookup(refs, local, remote, ["name", "kind"], "action").select("o_orderkey", "action")


def _shards(t: Tables) -> DataFrame:
    count = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    dbs = t.orders.select(
        F.col("o_orderkey").alias("cluster"), F.concat(F.lit("db"), text("o_orderkey")).alias("db"),
        F.when(F.col("o_orderstatus") != "P", count).alias("shards"),
    )
    return lookup.shard_plan(dbs, _hosts(t), ["cluster"]).good


def _hosts(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("cluster"), F.col("l_suppkey").alias("host"), F.col("l_suppkey").alias("ordinal")
    ).distinct()


_SHARDS_SQL = """
    o AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1 ELSE CAST(substr(o_orderpriority, 1, 1) AS INT) - 1 END AS shards
          FROM orders),
    h AS (SELECT DISTINCT l_orderkey, l_suppkey AS host FROM lineitem),
    p AS (SELECT o_orderkey, host, unnest(range(1, shards + 1)) AS shard,
                 printf('db%d-%03d-%03d', o_orderkey, host, shard) AS shard_name
          FROM o JOIN h ON l_orderkey = o_orderkey)
"""


@query(
    f"""
    WITH {_SHARDS_SQL}
    SELECT 'db' || o_orderkey AS db, count(*) AS n, min(shard_name) AS first, max(shard_name) AS last FROM p GROUP BY 1
    """
)
def shard_plan(t: Tables) -> DataFrame:
    return _shards(t).groupBy("db").agg(
        F.count("*").alias("n"), F.min("shard_name").alias("first"), F.max("shard_name").alias("last")
    )


@query(
    f"""
    WITH {_SHARDS_SQL}
    , a AS (SELECT printf('db%d-%03d-%03d', l_orderkey, l_suppkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 999 END) AS shard_name,
                 min(CASE WHEN l_quantity > 25 THEN l_suppkey ELSE l_partkey END) AS actual FROM lineitem GROUP BY 1)
    SELECT CASE WHEN actual <> host THEN 'host-differs' ELSE 'good' END AS rule,
           CASE WHEN actual <> host THEN NULL ELSE actual IS NOT NULL END AS "exists", count(*) AS n
    FROM p LEFT JOIN a USING (shard_name) GROUP BY ALL
    """
)
def placement_check(t: Tables) -> DataFrame:
    """Shards that exist: of each order line one, the first or one that no plan has."""
    number = F.when(F.col("l_returnflag") == "R", 1).otherwise(999)
    actual = t.lineitem.select(
        F.format_string("db%d-%03d-%03d", "l_orderkey", "l_suppkey", number).alias("shard_name"),
        F.when(F.col("l_quantity") > 25, F.col("l_suppkey")).otherwise(F.col("l_partkey")).alias("host"),
    )
    good, issue = lookup.placement_check(_shards(t), actual, _hosts(t), ["cluster"])
    rows = good.select(F.lit("good").alias("rule"), "exists").unionByName(
        issue.select("rule", F.lit(None).cast("boolean").alias("exists"))
    )
    return rows.groupBy("rule", "exists").agg(F.count("*").alias("n"))


@query(
    """
    WITH d AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag <> 'A') AS w, count(DISTINCT l_suppkey) AS h
               FROM lineitem GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS entity, CASE WHEN w > 0 THEN 'mixed-hosts' ELSE 'no-single-host' END AS rule,
           CAST(CASE WHEN w > 0 THEN w ELSE h END AS VARCHAR) AS value
    FROM d WHERE (w > 0 AND w < n) OR (w = 0 AND h <> 1)
    """
)
def assert_uniform(t: Tables) -> DataFrame:
    shards = t.lineitem.select(
        F.col("l_orderkey").alias("cluster"), F.col("l_orderkey").alias("db"),
        F.when(F.col("l_returnflag") != "A", text("l_suppkey")).otherwise("").alias("host"),
    )
    hosts = t.lineitem.select(F.col("l_orderkey").alias("cluster"), F.col("l_suppkey").alias("host")).distinct()
    return lookup.assert_uniform(shards, hosts, ["cluster"]).select("entity", "rule", "value")


# --- layers --------------------------------------------------------------------


def _layer(df: DataFrame, layer: int, key: str, name: str, compose, pairs: dict) -> DataFrame:
    """Long form of one table, records named by their key."""
    rows = F.array(*[F.struct(F.lit(p).alias("prop"), v.alias("value")) for p, v in pairs.items()])
    return df.select(
        F.lit("party").alias("kind"), F.lit(layer).alias("layer"), F.col(key).alias("pos"), text(key).alias("id"),
        F.col(name).alias("name"), compose.alias("compose"), F.inline(rows),
    )


def _parties(t: Tables, supplier_compose, customer_compose) -> DataFrame:
    derived = _layer(
        t.supplier, 0, "s_suppkey", "s_name", supplier_compose,
        {"nation": text("s_nationkey"), "acctbal": F.when(F.col("s_acctbal") >= 0, text("s_acctbal"))},
    )
    base = _layer(
        t.customer, 1, "c_custkey", "c_name", customer_compose,
        {"nation": text("c_nationkey"), "acctbal": text("c_acctbal"), "segment": F.col("c_mktsegment")},
    )
    return derived.unionByName(base)


@query(
    """
    WITH j AS (SELECT * FROM customer FULL JOIN supplier ON c_custkey = s_suppkey)
    SELECT 'id:' || coalesce(s_suppkey, c_custkey) AS entity, coalesce(s_name, c_name) AS name, 'nation' AS prop,
           CAST(coalesce(s_nationkey, c_nationkey) AS VARCHAR) AS value FROM j
    UNION ALL
    SELECT 'id:' || coalesce(s_suppkey, c_custkey), coalesce(s_name, c_name), 'acctbal',
           CAST(CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN s_acctbal >= 0 THEN s_acctbal END AS VARCHAR) FROM j
    UNION ALL
    SELECT 'id:' || c_custkey, coalesce(s_name, c_name), 'segment', c_mktsegment FROM j WHERE c_custkey IS NOT NULL
    """
)
def layered_merge(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    return layers.layered_merge(_parties(t, none, none)).good.select("entity", "name", "prop", "value")


def _composed(t: Tables) -> DataFrame:
    supplier = F.when(F.col("s_suppkey").cast("string").endswith("5"), "hide").when(text("s_suppkey").endswith("6"), "replace")
    customer = F.when(text("c_custkey").rlike("[45]$"), "hide").when(text("c_custkey").endswith("6"), "replace")
    return _parties(t, supplier, customer)


@query(
    """
    WITH j AS (SELECT *, right(CAST(coalesce(s_suppkey, c_custkey) AS VARCHAR), 1) AS d
               FROM customer FULL JOIN supplier ON c_custkey = s_suppkey),
    k AS (SELECT *, d = '5' AND s_suppkey IS NOT NULL AS hides FROM j
          WHERE d <> '6' AND NOT (d = '4' AND s_suppkey IS NOT NULL AND c_custkey IS NOT NULL))
    SELECT 'id:' || coalesce(s_suppkey, c_custkey) AS entity, 'nation' AS prop,
           CAST(coalesce(s_nationkey, c_nationkey) AS VARCHAR) AS value FROM k
    UNION ALL
    SELECT 'id:' || coalesce(s_suppkey, c_custkey), 'acctbal',
           CAST(CASE WHEN s_suppkey IS NULL THEN c_acctbal WHEN s_acctbal >= 0 THEN s_acctbal END AS VARCHAR) FROM k
    UNION ALL
    SELECT 'id:' || c_custkey, 'segment', c_mktsegment FROM k WHERE c_custkey IS NOT NULL AND NOT hides
    """
)
def layered_hide(t: Tables) -> DataFrame:
    return layers.layered_merge(_composed(t)).good.select("entity", "prop", "value")


@query(
    """
    WITH j AS (SELECT *, right(CAST(coalesce(s_suppkey, c_custkey) AS VARCHAR), 1) AS d
               FROM customer FULL JOIN supplier ON c_custkey = s_suppkey)
    SELECT 'id:' || coalesce(s_suppkey, c_custkey) AS entity,
           CASE d WHEN '6' THEN 'unknown-compose' ELSE 'different-compose' END AS rule
    FROM j WHERE d = '6' OR (d = '4' AND s_suppkey IS NOT NULL AND c_custkey IS NOT NULL)
    """
)
def layered_issues(t: Tables) -> DataFrame:
    return layers.layered_merge(_composed(t)).issue.select("entity", "rule")


@query(
    """
    SELECT l_partkey AS name, CASE WHEN l_returnflag <> 'N' THEN CAST(l_suppkey AS VARCHAR) END AS value FROM lineitem
    QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey, l_extendedprice, l_returnflag) = 1
    """
)
def precedence_lookup(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_returnflag"]
    values = t.lineitem.select(
        F.col("l_partkey").alias("name"), F.when(F.col("l_returnflag") != "N", text("l_suppkey")).alias("value"),
        *order,
    )
    return layers.precedence_lookup(values, ["name"], order)


@query(
    """
    WITH e AS (SELECT CASE WHEN p_size > 25 THEN 0 ELSE 1 END AS side, p_type AS type, p_partkey AS pos, p_brand AS invalid,
                      unnest([p_name, p_brand || p_size]) AS name FROM part),
    b AS (SELECT * FROM e WHERE side = 1 QUALIFY row_number() OVER (PARTITION BY type, name ORDER BY pos) = 1)
    SELECT side, type, name, pos, invalid FROM e WHERE side = 0
    UNION ALL
    SELECT side, type, name, pos, invalid FROM b
    WHERE NOT EXISTS (SELECT 1 FROM e d WHERE d.side = 0 AND d.type = b.type AND d.name = b.name)
    """
)
def merge_indexes(t: Tables) -> DataFrame:
    indexes = t.part.select(
        "p_size", F.col("p_type").alias("type"), F.col("p_partkey").alias("pos"), F.col("p_brand").alias("invalid"),
        F.array(F.col("p_name"), F.concat("p_brand", text("p_size"))).alias("name"),
    )
    derived, base = indexes.filter("p_size > 25").drop("p_size"), indexes.filter("p_size <= 25").drop("p_size")
    return layers.merge_indexes(derived, base).select("side", "type", "name", "pos", "invalid")


@query(
    """
    WITH n AS (SELECT 0 AS layer, o_orderkey AS pos, o_custkey AS k FROM orders
               UNION ALL SELECT 1, c_custkey, c_custkey FROM customer)
    SELECT 'p' || k AS name, layer, pos FROM n QUALIFY row_number() OVER (PARTITION BY k ORDER BY layer, pos) = 1
    """
)
def union_names(t: Tables) -> DataFrame:
    def named(df: DataFrame, layer: int, pos: str, key: str) -> DataFrame:
        names = F.explode(F.array(F.concat(F.lit("p"), text(key)), F.concat(F.lit("@"), text(key))))
        return df.select(F.lit(layer).alias("layer"), F.col(pos).alias("pos"), names.alias("name"))

    both = named(t.orders, 0, "o_orderkey", "o_custkey").unionByName(named(t.customer, 1, "c_custkey", "c_custkey"))
    return layers.union_names(both, pos=["layer", "pos"], hide_system=True).select("name", "first_seen.*")


_API_VALUES = ", ".join(f"('{a}', '{p}', '{v}')" for a, p, v in layers.DEFAULT_APIS)


@query(
    f"""
    WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'signup' THEN 'manage' WHEN 'view' THEN 'rest' WHEN 'click' THEN 'client'
                      WHEN 'purchase' THEN 'xdbc' ELSE 'other' END AS api, json_extract_string(props, '$.k') AS value FROM events),
    w AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, api ORDER BY event_id) = 1),
    d AS (SELECT * FROM (VALUES {_API_VALUES}) v(api, prop, value)),
    u AS (SELECT DISTINCT user_id FROM events)
    SELECT u.user_id, d.api, d.prop, coalesce(nullif(w.value, '0'), d.value) AS value
    FROM u CROSS JOIN d LEFT JOIN w ON w.user_id = u.user_id AND w.api = d.api AND d.prop = 'port'
    """
)
def overlay_apis(t: Tables) -> DataFrame:
    api = F.create_map(*[F.lit(x) for x in ("signup", "manage", "view", "rest", "click", "client", "purchase", "xdbc", "error", "other")])
    overrides = t.events.select(
        "user_id", "event_id", api[F.col("event_type")].alias("api"), F.lit("port").alias("prop"),
        F.get_json_object("props", "$.k").alias("value"),
    )
    return layers.overlay_defaults(overrides, ["user_id"], ["event_id"]).good


@query(
    """
    SELECT '/c/' || c_custkey || '.json' AS root, prop,
           CASE prop WHEN 'dir' THEN n_name || '-' || c_mktsegment WHEN 'name' THEN 'src' END AS value
    FROM customer JOIN nation ON c_nationkey = n_nationkey, (VALUES ('dir'), ('name'), ('include')) v(prop)
    """
)
def compile_environments(t: Tables) -> DataFrame:
    """One environment per customer, importing its nation's module."""
    base = F.struct(
        F.struct(
            F.lit("0.1").alias("format"),
            F.col("n_name").alias("code"),
            F.struct(F.lit("none").alias("seg"), F.lit("@{code}-${seg}").alias("label")).alias("params"),
            F.array(
                F.struct(F.lit("src").alias("name"), F.lit("${label}").alias("dir"), F.lit("*.xml").alias("include"))
            ).alias("sources"),
        ).alias("top")
    )
    derived = F.format_string(
        '{"top":{"format":"0.1","import":"../n/%d.json","params":{"seg":"%s"},"sources":[{"name":"src","include":null}]}}',
        "c_nationkey", "c_mktsegment",
    )
    own = F.format_string("/c/%d.json", "c_custkey")
    modules = t.customer.select(own.alias("module"), derived.alias("body")).unionByName(
        t.nation.select(F.format_string("/n/%d.json", "n_nationkey").alias("module"), F.to_json(base).alias("body"))
    )
    roots = t.customer.select(own.alias("module"))
    return environment.compile_environments(modules, roots).props.select("root", "prop", "value")


@query(
    """
    SELECT p_partkey AS entity, prop,
           CASE prop WHEN 'scalar-type' THEN CASE WHEN p_size > 25 THEN 'string' ELSE 'int' END
                     WHEN 'localname' THEN p_name WHEN 'parent-localname' THEN p_type WHEN 'invalid-values' THEN 'ignore'
                     WHEN 'collation' THEN CASE WHEN p_type = 'SMALL' THEN 'own' WHEN p_size > 25 THEN 'http://example.org/collation/root' ELSE '' END
                     ELSE '' END AS value
    FROM part, (VALUES ('scalar-type'), ('localname'), ('invalid-values'), ('collation'), ('namespace-uri'),
                       ('parent-localname'), ('parent-namespace-uri')) v(prop)
    WHERE (prop <> 'invalid-values' OR p_brand <> 'Brand#3') AND (prop NOT LIKE 'parent%' OR p_size % 2 = 1)
    """
)
def index_schema(t: Tables) -> DataFrame:
    """Range index declarations, of attributes where the size is odd, defaulted and validated by class."""
    parent = F.when(F.col("p_size") % 2 == 1, F.to_json(F.struct(F.col("p_type").alias("name"))))
    rows = F.array(
        F.struct(F.lit("type").alias("prop"), F.when(F.col("p_size") > 25, "string").otherwise("int").alias("value")),
        F.struct(F.lit("name").alias("prop"), F.col("p_name").alias("value")),
        F.struct(F.lit("invalid").alias("prop"), F.when(F.col("p_brand") == "Brand#3", "never").otherwise("ignore").alias("value")),
        F.when(F.col("p_type") == "SMALL", F.struct(F.lit("collation").alias("prop"), F.lit("own").alias("value"))),
        F.when(parent.isNotNull(), F.struct(F.lit("parent").alias("prop"), parent.alias("value"))),
    )
    kind = schemas.index_class(F.lit(None), F.lit(None), parent)
    props = t.part.select(kind.alias("kind"), F.col("p_partkey").alias("entity"), F.inline(F.array_compact(rows)))
    schema = schemas.index("http://example.org/collation/root")
    opened = flatten_nested(props, schema)
    good = validate(apply_defaults(opened, schema), schema, nested=False).good
    return good.select("entity", "prop", "value")


@query(
    """
    WITH v AS (SELECT p_partkey, p_size % 4 AS c, p_brand FROM part)
    SELECT CAST(p_partkey AS VARCHAR) AS entity, 'parent-localname' AS prop, 'missing-mandatory' AS rule FROM v WHERE c = 0 AND p_brand = 'Brand#1'
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'localname', 'missing-mandatory' FROM v WHERE c = 1 AND p_brand = 'Brand#2'
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'name', 'unknown-property' FROM v WHERE c > 1 AND p_brand <> 'Brand#2'
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'parent', 'not-object' FROM v WHERE c = 0 AND p_brand = 'Brand#1'
    """
)
def index_class_issues(t: Tables) -> DataFrame:
    """Declarations of all four classes: a name where a class has none, no name where it has one, a parent that is no object."""
    c, brand = F.col("p_size") % 4, F.col("p_brand")
    pairs = {
        "type": F.lit("int"),
        "name": F.when(brand != "Brand#2", F.col("p_name")).when(c == 0, F.col("p_name")),
        "parent": F.when(c == 0, F.when(brand == "Brand#1", "text").otherwise('{"name":"p","namespace":"u"}')),
        "path": F.when(c == 2, F.lit("/p")),
        "field": F.when(c == 3, F.lit("f")),
    }
    rows = F.array_compact(F.array(*[F.when(v.isNotNull(), F.struct(F.lit(k).alias("prop"), v.alias("value"))) for k, v in pairs.items()]))
    kind = schemas.index_class(pairs["field"], pairs["path"], pairs["parent"])
    props = t.part.select(kind.alias("kind"), F.col("p_partkey").alias("entity"), F.inline(rows))
    return validate(props, schemas.index("root")).issue.select("entity", "prop", "rule")


def _hidden(t: Tables) -> environment.Environment:
    """Per customer a module that hides its nation's records, or merges with them, by segment."""
    compose = F.when(F.col("c_mktsegment") == "BUILDING", "hide").otherwise("merge")
    own = F.format_string("/h/%d.json", "c_custkey")
    body = F.format_string(
        '{"top":{"format":"0.1","import":["../g/%d-%s.json","../none/%d.json"],'
        '"databases":[{"name":"data","compose":"%s","indexes":{"ranges":[{"type":"int","name":"own"}]}}],'
        '"roles":[{"name":"reader","compose":"%s","permissions":{"own":"read"}}]}}',
        "c_nationkey", compose, F.col("c_custkey") % 7, compose, compose,
    )
    modes = F.explode(F.array(F.lit("hide"), F.lit("merge")))
    base = F.format_string(
        '{"top":{"format":"0.1","databases":[{"id":"base","name":"data","compose":"%s","schema":"s","indexes":{"ranges":[{"type":"int","name":"base"}]}}],'
        '"roles":[{"name":"reader","compose":"%s","permissions":{"base":"read"}}]}}',
        "mode", "mode",
    )
    nations = t.nation.select("n_nationkey", modes.alias("mode"))
    modules = t.customer.select(own.alias("module"), body.alias("body")).unionByName(
        nations.select(F.format_string("/g/%d-%s.json", "n_nationkey", "mode").alias("module"), base.alias("body"))
    )
    return environment.compile_environments(modules, t.customer.select(own.alias("module")))


_HIDDEN_SQL = "c AS (SELECT '/h/' || c_custkey || '.json' AS root, c_mktsegment = 'BUILDING' AS hides, c_custkey % 7 AS gone FROM customer)"


@query(
    f"""
    WITH {_HIDDEN_SQL}
    SELECT root, 'name:data' AS entity, 'index' AS what, 'own' AS value FROM c WHERE hides
    UNION ALL SELECT root, 'name:reader', 'role', 'own' FROM c
    UNION ALL SELECT root, 'name:reader', 'role', 'base' FROM c WHERE NOT hides
    UNION ALL SELECT root, 'id:base', 'index', 'own' FROM c WHERE NOT hides
    UNION ALL SELECT root, 'id:base', 'index', 'base' FROM c WHERE NOT hides
    UNION ALL SELECT root, 'id:base', 'schema', 's' FROM c WHERE NOT hides
    """
)
def compile_hidden(t: Tables) -> DataFrame:
    """What hidden records leave behind, in properties, permissions and indexes: nothing."""
    env = _hidden(t)
    props = env.props.filter("kind = 'database' AND prop = 'schema'").select("root", "entity", F.col("prop").alias("what"), "value")
    grants = env.permissions.select("root", "entity", F.lit("role").alias("what"), F.col("role").alias("value"))
    indexes = env.indexes.select("root", "entity", F.lit("index").alias("what"), F.col("name").alias("value"))
    return props.unionByName(grants).unionByName(indexes)


@query(f"WITH {_HIDDEN_SQL} SELECT DISTINCT '/none/' || gone || '.json' AS entity, 'no-such-module' AS rule FROM c")
def compile_issues(t: Tables) -> DataFrame:
    """Imports that lead nowhere."""
    return _hidden(t).issue.select("entity", "rule")


@query(
    """
    WITH c AS (SELECT '/s/' || c_custkey || '.json' AS root, c_mktsegment = 'BUILDING' AS odd, c_acctbal < 0 AS chained FROM customer)
    SELECT root, 'level' AS what, 'data' AS name, CASE WHEN chained THEN '2' ELSE '1' END AS value FROM c
    UNION ALL SELECT root, 'level', 'types', CASE WHEN chained THEN '1' ELSE '0' END FROM c
    UNION ALL SELECT root, 'level', 'safe', '0' FROM c
    UNION ALL SELECT root, 'content', 'web', 'data' FROM c
    UNION ALL SELECT root, 'schema', 'data', 'types' FROM c
    UNION ALL SELECT root, 'security', 'types', 'safe' FROM c WHERE chained
    UNION ALL SELECT root, 'port', 'id:web', '8080' FROM c WHERE NOT odd
    UNION ALL SELECT root, 'group', 'name:h', 'Default' FROM c
    UNION ALL SELECT '{' || root || ', id:web}', 'not-integer', 'port', 'none' FROM c WHERE odd
    """
)
def settle_environments(t: Tables) -> DataFrame:
    """One environment per customer, checked and put in order."""
    own = F.format_string("/s/%d.json", "c_custkey")
    body = F.format_string(
        '{"top":{"format":"0.1","hosts":[{"name":"h"}],"servers":[{"id":"web","name":"web","type":"http","port":"%s","content":{"idref":"d"}}],'
        '"databases":[{"id":"d","name":"data","schema":{"nameref":"types"}},{"name":"safe"},{"name":"types"%s}]}}',
        F.when(F.col("c_mktsegment") == "BUILDING", "none").otherwise("8080"),
        F.when(F.col("c_acctbal") < 0, ',"security":{"nameref":"safe"}').otherwise(""),
    )
    modules = t.customer.select(own.alias("module"), body.alias("body"))
    done = environment.settle(environment.compile_environments(modules, modules.select("module")), "http://example.org/root")
    text_ = F.col("level").cast("string").alias("value")
    return (
        done.levels.select("root", F.lit("level").alias("what"), "name", text_)
        .unionByName(done.references.select("root", F.col("slot").alias("what"), "name", F.col("target").alias("value")))
        .unionByName(done.props.filter("prop IN ('port', 'group')").select("root", F.col("prop").alias("what"), F.col("entity").alias("name"), "value"))
        .unionByName(done.issue.select(F.col("entity").alias("root"), F.col("rule").alias("what"), F.col("prop").alias("name"), "value"))
    )


# --- reconciliation ----------------------------------------------------------


@query(
    """
    SELECT p_partkey, CASE WHEN r.k IS NOT NULL THEN 'check' WHEN p_size > 45 THEN 'missing' ELSE 'create' END AS verb
    FROM part LEFT JOIN (SELECT DISTINCT l_partkey + l_linenumber % 3 * 100000 AS k FROM lineitem) r ON k = p_partkey
    """
)
def reconcile_entities(t: Tables) -> DataFrame:
    """Parts that have been ordered exist; two of three order lines carry numbers that no part has."""
    actual = t.lineitem.select((F.col("l_partkey") + F.col("l_linenumber") % 3 * 100000).alias("p_partkey"))
    desired = t.part.select("p_partkey", "p_size")
    return rec.reconcile_entities(desired, actual, ["p_partkey"], F.col("p_size") > 45).select("p_partkey", "verb")


@query(
    """
    WITH d AS (SELECT DISTINCT l_suppkey AS db, l_partkey AS forest FROM lineitem),
    a AS (SELECT DISTINCT l_suppkey AS db, CASE l_returnflag WHEN 'R' THEN l_partkey WHEN 'A' THEN l_partkey + 1 ELSE -l_partkey END AS forest FROM lineitem),
    x AS (SELECT DISTINCT forest FROM a),
    v AS (SELECT coalesce(d.db, a.db) AS db,
                 CASE WHEN d.db IS NULL THEN 'detach' WHEN a.db IS NOT NULL THEN 'check'
                      WHEN x.forest IS NOT NULL THEN 'attach' ELSE 'create' END AS verb
          FROM d FULL JOIN a ON d.db = a.db AND d.forest = a.forest LEFT JOIN x ON x.forest = coalesce(d.forest, a.forest))
    SELECT db, verb, count(*) AS n FROM v GROUP BY ALL
    """
)
def reconcile_members(t: Tables) -> DataFrame:
    """All order lines on both sides: as they are, next to their place, or under a name that nobody wants."""
    part, flag = F.col("l_partkey"), F.col("l_returnflag")
    there = F.when(flag == "R", part).when(flag == "A", part + 1).otherwise(-part)
    desired = t.lineitem.select(F.col("l_suppkey").alias("db"), part.alias("forest"))
    actual = t.lineitem.select(F.col("l_suppkey").alias("db"), there.alias("forest"))
    verbs = rec.reconcile_members(desired, actual, actual, ["db"], "forest")
    return verbs.groupBy("db", "verb").agg(F.count("*").alias("n"))


PARTY_SCHEMA = [
    Prop("party", "nation", frozen=True),
    Prop("party", "tags", compare="list"),
    Prop("party", "spaces", compare="map"),
    Prop("party", "fields", compare="struct_list"),
]


def _party_props(df: DataFrame, prefix: str, key: str) -> DataFrame:
    nation, balance = text(f"{prefix}_nationkey"), text(f"{prefix}_acctbal")
    pairs = {
        "nation": nation,
        "tags": F.format_string('["x","%s"]', nation) if prefix == "c" else F.format_string('["%s","x"]', nation),
        "spaces": F.format_string('{"a":"1","b":"%s"}', nation) if prefix == "c" else F.format_string('{"b":"%s","a":"1"}', nation),
        "fields": F.format_string('[{"n":"%s"}]', nation) if prefix == "c" else F.lit('[{ "n" : "7" }]'),
        "balance": balance,
    }
    rows = F.array(*[F.struct(F.lit(p).alias("prop"), v.alias("value")) for p, v in pairs.items()])
    return df.select(F.lit("party").alias("kind"), F.col(key).alias("entity"), F.inline(rows))


@query(
    """
    WITH j AS (SELECT *, CAST(c_nationkey AS VARCHAR) AS cn, CAST(s_nationkey AS VARCHAR) AS sn,
                      c_nationkey IS NOT DISTINCT FROM s_nationkey AS same
               FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey)
    SELECT c_custkey AS entity, 'issue' AS what, 'nation' AS prop FROM j WHERE NOT same
    UNION ALL SELECT c_custkey, 'update', 'tags' FROM j WHERE NOT same
    UNION ALL SELECT c_custkey, 'update', 'spaces' FROM j WHERE NOT same
    UNION ALL SELECT c_custkey, 'update', 'fields' FROM j WHERE cn <> '7' OR sn IS NULL
    UNION ALL SELECT c_custkey, 'update', 'balance' FROM j WHERE s_acctbal IS DISTINCT FROM c_acctbal
    """
)
def diff_properties(t: Tables) -> DataFrame:
    plan, issue = rec.diff_properties(
        _party_props(t.customer, "c", "c_custkey"), _party_props(t.supplier, "s", "s_suppkey"), PARTY_SCHEMA
    )
    return plan.select("entity", F.col("verb").alias("what"), "prop").unionByName(
        issue.select(F.col("entity").cast("bigint").alias("entity"), F.lit("issue").alias("what"), "prop")
    )


@query(
    """
    SELECT doc_id AS entity, unnest(['quality', 'toxic']) AS prop,
           CAST(unnest([CASE WHEN quality <> toxic THEN quality END, CASE WHEN toxic <> quality THEN toxic END]) AS VARCHAR) AS new
    FROM labels WHERE quality <> toxic
    """
)
def diff_passthrough(t: Tables) -> DataFrame:
    def rows(a: str, b: str) -> DataFrame:
        pairs = F.array(
            F.struct(F.lit("quality").alias("prop"), text(a).alias("value")),
            F.struct(F.lit("toxic").alias("prop"), text(b).alias("value")),
        )
        return t.labels.select(F.lit("label").alias("kind"), F.col("doc_id").alias("entity"), F.inline(pairs))

    return rec.diff_passthrough(rows("quality", "toxic"), rows("toxic", "quality")).select("entity", "prop", "new")


REST_SCHEMA = [Prop("party", "nation", immutable=True), Prop("party", "segment", default="BUILDING")]


@query(
    """
    SELECT coalesce(c_custkey, s_suppkey) AS entity, 'issue' AS what, 'nation' AS prop FROM customer FULL JOIN supplier ON c_custkey = s_suppkey
    WHERE c_nationkey IS DISTINCT FROM s_nationkey
    UNION ALL
    SELECT c_custkey, 'update', 'segment' FROM customer WHERE c_mktsegment <> 'BUILDING'
    """
)
def diff_immutable(t: Tables) -> DataFrame:
    def rows(df: DataFrame, key: str, nation: str, segment) -> DataFrame:
        pairs = F.array(
            F.struct(F.lit("nation").alias("prop"), text(nation).alias("value")),
            F.struct(F.lit("segment").alias("prop"), segment.alias("value")),
        )
        return df.select(F.lit("party").alias("kind"), F.col(key).alias("entity"), F.inline(pairs))

    actual = rows(t.supplier, "s_suppkey", "s_nationkey", F.lit("BUILDING")).unionByName(
        rows(t.customer, "c_custkey", "c_nationkey", F.lit("BUILDING")).filter("prop = 'segment'")
        .join(t.supplier.select(F.col("s_suppkey").alias("entity")), "entity", "left_anti")
    )
    own = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    desired = rows(t.customer, "c_custkey", "c_nationkey", own).filter("value IS NOT NULL")
    plan, issue = rec.diff_with_immutable(desired, actual, REST_SCHEMA)
    return plan.select("entity", F.col("verb").alias("what"), "prop").unionByName(
        issue.select(F.col("entity").cast("bigint").alias("entity"), F.lit("issue").alias("what"), "prop")
    )


@query(
    """
    WITH r AS (SELECT o_orderkey,
                      CASE WHEN o_orderpriority LIKE '1%' THEN '' WHEN o_orderpriority LIKE '2%' THEN 'F' ELSE o_orderstatus END AS want,
                      CASE WHEN o_totalprice > 100000 THEN o_orderstatus END AS have FROM orders)
    SELECT o_orderkey, CASE WHEN want = '' THEN 'O' ELSE want END AS new FROM r
    WHERE CASE WHEN want = '' THEN have IS NOT NULL AND have <> 'O' ELSE have IS DISTINCT FROM want END
    """
)
def diff_reference(t: Tables) -> DataFrame:
    priority = F.col("o_orderpriority")
    refs = t.orders.select(
        "o_orderkey",
        F.when(priority.startswith("1"), "").when(priority.startswith("2"), "F").otherwise(F.col("o_orderstatus")).alias("want"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_orderstatus")).alias("have"),
    )
    return rec.diff_reference(refs, "want", "have", F.lit("O")).select("o_orderkey", "new")


@query(
    """
    SELECT o_orderkey AS entity,
           '{"customer":' || o_custkey || ',"note":"a \\"' || o_orderstatus || '\\"","open":' || (o_orderstatus = 'O')
           || ',"priority":["x","' || o_orderpriority || '"]}' AS payload
    FROM orders
    """
)
def creation_payload(t: Tables) -> DataFrame:
    def row(prop: str, type: str, value):
        return F.struct(F.lit(prop).alias("prop"), F.lit(type).alias("type"), value.alias("value"))

    rows = F.array(
        row("priority", "list", F.concat(F.lit("x , "), "o_orderpriority")),
        row("customer", "integer", text("o_custkey")),
        row("open", "boolean", (F.col("o_orderstatus") == "O").cast("string")),
        row("permissions", "string", F.lit("later")),
    )
    head = [F.lit("order").alias("kind"), F.col("o_orderkey").alias("entity")]
    free = F.format_string('a "%s"', "o_orderstatus")
    payload = rec.creation_payload(
        t.orders.select(*head, F.inline(rows)), t.orders.select(*head, F.lit("note").alias("prop"), free.alias("value")),
        late=["permissions"],
    ).good
    return payload.select("entity", "payload")


@query(
    """
    WITH c AS (SELECT l_returnflag AS scope, l_partkey AS name, count(*) FILTER (l_linestatus = 'F') AS declared,
                      count(*) FILTER (l_linestatus = 'O') AS existing FROM lineitem GROUP BY ALL)
    SELECT * FROM c WHERE declared <> existing AND scope IN (SELECT scope FROM c WHERE declared > 0)
    """
)
def same_members(t: Tables) -> DataFrame:
    lines = t.lineitem.select(F.col("l_returnflag").alias("scope"), F.col("l_partkey").alias("name"), "l_linestatus")
    return rec.same_members(
        lines.filter("l_linestatus = 'F'"), lines.filter("l_linestatus = 'O'"), ["scope"], "name"
    )


ROLE_SCHEMA = [
    Prop("role", "description"),
    Prop("role", "permissions", type="json", compare="struct_list"),
    Prop("role", "ring", compare="ordered"),
]


@query(
    """
    WITH e AS (SELECT c_custkey AS entity, c_custkey % 3 AS c, c_mktsegment AS seg, c_nationkey AS n FROM customer)
    SELECT 1 AS phase, 'create' AS verb, entity, NULL AS prop, '{"description":"' || seg || '"}' AS new FROM e WHERE c = 0
    UNION ALL SELECT 2, 'update', entity, 'permissions', '[{"r":"' || n || '"}]' FROM e WHERE c = 0
    UNION ALL SELECT 1, 'update', entity, 'description', seg FROM e WHERE c = 1
    UNION ALL SELECT 2, 'update', entity, 'permissions', '[{"r":"' || n || '"}]' FROM e WHERE c = 2 AND n > 10
    """
)
def phased_plan(t: Tables) -> DataFrame:
    """Roles: a third is created, the others differ in their description or, for some, in their permissions."""
    c, nation = F.col("c_custkey") % 3, F.col("c_nationkey")
    ring = '[{"name":"b"},{"name":"a","dir":""}]'
    base = t.customer.select(F.lit("role").alias("kind"), F.col("c_custkey").alias("entity"), c.alias("c"), "c_mktsegment", nation.alias("n"))

    def perm(n):
        return F.format_string('[{"r":"%d"}]', n)

    def rows(**pairs):
        made = F.array(*[F.struct(F.lit(k).alias("prop"), F.lit(y).alias("type"), v.alias("value")) for k, (y, v) in pairs.items()])
        return F.inline(made)

    ringed = F.when(F.col("c") > 0, ring)
    props = base.select("kind", "entity", rows(description=("string", F.col("c_mktsegment")), permissions=("json", perm(F.col("n"))), ring=("json", ringed)))
    description = F.when(F.col("c") == 1, "other").otherwise(F.col("c_mktsegment"))
    permissions = F.when((F.col("c") == 2) & (F.col("n") > 10), perm(-F.col("n"))).otherwise(perm(F.col("n")))
    actual = base.filter("c > 0").select(
        "kind", "entity", rows(description=("", description), permissions=("", permissions), ring=("", F.lit('[{"name":"a"},{"name":"b","dir":null}]')))
    ).drop("type")
    verbs = rec.reconcile_entities(base.select("kind", "entity"), actual, ["kind", "entity"])
    plan = rec.phased_plan(verbs, props, actual, ROLE_SCHEMA).good
    return plan.select("phase", "verb", "entity", "prop", "new")


@query("SELECT conv_id || '/' || turn AS id, CAST(turn AS INT) AS level FROM conversations")
def topo_turns(t: Tables) -> DataFrame:
    """Every turn depends on the one before it; the first ones on an undeclared node."""
    turn = lambda n: F.concat_ws("/", text("conv_id"), n.cast("string"))
    nodes = t.conversations.select(turn(F.col("turn")).alias("id"))
    edges = t.conversations.select(turn(F.col("turn")).alias("id"), turn(F.col("turn") - 1).alias("dep"))
    return graph.topo_levels(nodes, edges).good


@query(
    """
    SELECT 'role/' || c_custkey AS id, 2 AS level FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'role/' || c_custkey, 0 FROM customer WHERE c_acctbal < 0
    UNION ALL SELECT 'role/n' || n_nationkey, 0 FROM nation
    UNION ALL SELECT 'execute/' || s_name, 1 FROM supplier
    UNION ALL SELECT 'uri/' || s_name, 0 FROM supplier
    """
)
def privilege_levels(t: Tables) -> DataFrame:
    """Roles name privileges, privileges name roles; an execute and a uri privilege share each name."""
    none = F.lit(None).cast("string")
    privileges = t.supplier.select(
        F.col("s_name").alias("name"),
        F.inline(
            F.array(
                F.struct(F.lit("execute").alias("kind"), F.concat(F.lit("n"), text("s_nationkey"), F.lit(" , gone")).alias("roles")),
                F.struct(F.lit("uri").alias("kind"), none.alias("roles")),
            )
        ),
    )
    holders = t.customer.join(
        t.supplier.groupBy(F.col("s_nationkey").alias("c_nationkey")).agg(F.min("s_name").alias("priv")), "c_nationkey", "left"
    )
    any_priv = F.coalesce("priv", F.lit("Supplier#000000000"))
    roles = holders.select(
        text("c_custkey").alias("name"), none.alias("roles"),
        F.when(F.col("c_acctbal") >= 0, any_priv).alias("execute"), F.when(F.col("c_acctbal") >= 0, any_priv).alias("uri"),
    ).unionByName(
        t.nation.select(F.concat(F.lit("n"), text("n_nationkey")).alias("name"), none.alias("roles"), none.alias("execute"), none.alias("uri"))
    )
    return graph.topo_levels(*graph.privilege_edges(privileges, roles)).good


@query(
    """
    WITH c AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
    SELECT conv_id || '/' || turn AS entity, 'cycle' AS rule FROM c WHERE n > 3
    """
)
def topo_cycles(t: Tables) -> DataFrame:
    """Conversations of more than three turns whose first turn waits for the fourth."""
    turn = lambda n: F.concat_ws("/", text("conv_id"), n.cast("string"))
    nodes = t.conversations.select(turn(F.col("turn")).alias("id"))
    back = F.when(F.col("turn") == 0, F.lit(3)).otherwise(F.col("turn") - 1)
    edges = t.conversations.select(turn(F.col("turn")).alias("id"), turn(back).alias("dep"))
    return graph.topo_levels(nodes, edges).issue.select("entity", "rule")


@query(
    """
    SELECT 'content-' || s_suppkey AS name, 2 AS level FROM supplier
    UNION ALL SELECT 'schema-' || s_suppkey, 1 FROM supplier
    UNION ALL SELECT 'security-' || n_nationkey, 0 FROM nation
    """
)
def embedded_levels(t: Tables) -> DataFrame:
    """Nested definitions with references by id, by name and to themselves."""
    own = F.concat(F.lit("db-"), text("s_suppkey"))
    security = F.concat(F.lit("security-"), text("s_nationkey"))
    body = F.to_json(
        F.struct(
            own.alias("id"),
            F.concat(F.lit("content-"), text("s_suppkey")).alias("name"),
            F.struct(
                F.concat(F.lit("schema-"), text("s_suppkey")).alias("name"), F.struct(security.alias("nameref")).alias("security")
            ).alias("schema"),
            F.struct(own.alias("idref")).alias("security"),
        )
    )
    nation = F.concat(F.lit("security-"), text("n_nationkey"))
    shared = F.to_json(F.struct(nation.alias("name"), F.struct(nation.alias("nameref")).alias("security")))
    definitions = t.supplier.select(own.alias("key"), body.alias("body")).unionByName(
        t.nation.select(nation.alias("key"), shared.alias("body"))
    )
    nodes, refs = graph.flatten_embedded(definitions)
    resolved = lookup.resolve_reference(refs, nodes.select("id", "name"), own_id="own_id", own_name="own_name").good
    edges = resolved.join(nodes.select("key", F.col("name").alias("holder")), "key").select(
        F.col("holder").alias("id"), F.col("target_name").alias("dep")
    )
    levels = graph.topo_levels(nodes.select(F.col("name").alias("id")), edges, self_ok=True).good
    return levels.select(F.col("id").alias("name"), "level")


@query(
    """
    SELECT 'world' AS node, 0 AS depth, '' AS path, '' AS last_path
    UNION ALL SELECT r_name, 1, CAST(r_regionkey AS VARCHAR), CAST(-r_regionkey AS VARCHAR) FROM region
    UNION ALL SELECT n_name, 2, n_regionkey || '.' || n_nationkey, (-n_regionkey) || '.' || (-n_nationkey) FROM nation
    UNION ALL SELECT c_name, 3, n_regionkey || '.' || n_nationkey || '.' || c_custkey,
                     (-n_regionkey) || '.' || (-n_nationkey) || '.' || (-c_custkey)
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    """
)
def flatten_imports(t: Tables) -> DataFrame:
    def edges(df: DataFrame, module, to: str, pos: str) -> DataFrame:
        return df.select(module.alias("module"), F.col(to).alias("import"), F.col(pos).cast("int").alias("pos"))

    nation = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    customer = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    imports = (
        edges(t.region, F.lit("world"), "r_name", "r_regionkey")
        .unionByName(edges(nation, F.col("r_name"), "n_name", "n_nationkey"))
        .unionByName(edges(customer, F.col("n_name"), "c_name", "c_custkey"))
    )
    roots = t.region.select(F.lit("world").alias("module")).distinct()
    closure = graph.flatten_imports(imports, roots).good
    joined = lambda c: F.array_join(F.transform(c, lambda n: n.cast("string")), ".")
    return closure.select("node", "depth", joined("path_first").alias("path"), joined("path_last").alias("last_path"))


@query(
    """
    WITH c AS (SELECT '/o/' || c_custkey || '.json' AS root, c_custkey AS k, c_mktsegment = 'BUILDING' AS odd, c_acctbal < 0 AS list FROM customer)
    SELECT root, 'level' AS what, 'data]/' || k AS name, '2' AS value FROM c
    UNION ALL SELECT root, 'level', 'types', '1' FROM c
    UNION ALL SELECT root, 'level', 'in]/side', '0' FROM c
    UNION ALL SELECT root, 'level', 't', '0' FROM c WHERE NOT odd
    UNION ALL SELECT '["' || root || '","id:d"]', 'not-object', 'triggers', 'plain' FROM c WHERE odd
    UNION ALL SELECT '["' || root || '","name:types"]/security', 'not-object', 'schema', '["list"]' FROM c WHERE list
    UNION ALL SELECT '["' || root || '","name:types"]/security/schema', 'no-name', 'name', NULL FROM c WHERE NOT list
    """
)
def settle_issues(t: Tables) -> DataFrame:
    """Databases whose names have brackets and slashes, with texts, lists and empty objects in the slots: each has a level or is an issue."""
    own = F.format_string("/o/%d.json", "c_custkey")
    body = F.format_string(
        '{"top":{"format":"0.1","databases":[{"id":"d","name":"data]/%d","schema":{"nameref":"types"},"triggers":%s},'
        '{"name":"types","security":{"name":"in]/side","schema":%s}}]}}',
        F.col("c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", '"plain"').otherwise('{"name":"t"}'),
        F.when(F.col("c_acctbal") < 0, '["list"]').otherwise("{}"),
    )
    modules = t.customer.select(own.alias("module"), body.alias("body"))
    done = environment.settle(environment.compile_environments(modules, modules.select("module")), "http://example.org/root")
    levels = done.levels.select("root", F.lit("level").alias("what"), "name", text("level").alias("value"))
    return levels.unionByName(done.issue.select(F.col("entity").alias("root"), F.col("rule").alias("what"), F.col("prop").alias("name"), "value"))


@query("SELECT p_partkey AS id, CAST(row_number() OVER (ORDER BY p_partkey) - 1 AS INT) AS level FROM part")
def chain_levels(t: Tables) -> DataFrame:
    """A chain as long as the table: each part waits for the one before it."""
    edges = t.part.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("dep"))
    return graph.topo_levels(t.part.select(F.col("p_partkey").alias("id")), edges).good


@query(
    """
    WITH s AS (SELECT s_suppkey AS k, s_nationkey AS n, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS first FROM supplier)
    SELECT 's' || k AS id, CASE WHEN k % 5 <> 0 OR k = first THEN 's' || first END AS cycle FROM s WHERE n % 2 = 0
    UNION ALL SELECT 'c' || c_custkey, NULL FROM customer WHERE c_nationkey IN (SELECT n FROM s WHERE n % 2 = 0)
    UNION ALL SELECT 'x' || o_orderkey, 'x' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0
    UNION ALL SELECT 'y' || o_orderkey, 'x' || o_orderkey FROM orders WHERE o_orderkey % 10 = 0
    """
)
def cycle_members(t: Tables) -> DataFrame:
    """Suppliers in rings by nation (those of odd nations in chains), customers behind them, and orders in cross-linked pairs."""
    key = lambda letter, c: F.concat(F.lit(letter), text(c))
    order = lambda: Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    ring = t.supplier.select("s_suppkey", "s_nationkey", first.alias("first")).filter("s_suppkey % 5 <> 0 OR s_suppkey = first")
    before = F.lag("s_suppkey").over(order())
    last = F.max("s_suppkey").over(Window.partitionBy("s_nationkey"))
    links = ring.select("s_suppkey", F.coalesce(before, F.when(F.col("s_nationkey") % 2 == 0, last)).alias("dep")).filter("dep IS NOT NULL")
    firsts = t.supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("first"))
    behind = t.supplier.join(firsts, "s_nationkey").filter("s_suppkey % 5 = 0 AND s_suppkey <> first")
    pairs = t.orders.filter("o_orderkey % 10 = 0")
    edges = (
        links.select(key("s", "s_suppkey").alias("id"), key("s", "dep").alias("dep"))
        .unionByName(behind.select(key("s", "s_suppkey").alias("id"), key("s", "first").alias("dep")))
        .unionByName(t.customer.join(firsts, F.col("c_nationkey") == F.col("s_nationkey")).select(key("c", "c_custkey").alias("id"), key("s", "first").alias("dep")))
        .unionByName(pairs.select(key("x", "o_orderkey").alias("id"), key("y", "o_orderkey").alias("dep")))
        .unionByName(pairs.select(key("y", "o_orderkey").alias("id"), key("x", "o_orderkey").alias("dep")))
        .unionByName(pairs.select(key("x", "o_orderkey").alias("id"), key("c", "o_custkey").alias("dep")))
    )
    nodes = edges.select("id").union(edges.select("dep")).distinct()
    return graph.cycles(nodes, edges)


@query(
    """
    WITH d AS (SELECT 'order' AS kind, CAST(o_orderkey AS VARCHAR) AS entity, o_orderstatus AS status, o_orderpriority AS priority FROM orders)
    SELECT 'prop' AS what, kind, entity, 'status' AS name, status AS value FROM d
    UNION ALL SELECT 'prop', kind, entity, 'priority', priority FROM d
    UNION ALL SELECT DISTINCT 'member', 'order', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), NULL FROM lineitem
    UNION ALL SELECT DISTINCT 'entity', 'part', CAST(l_partkey AS VARCHAR), NULL, NULL FROM lineitem
    UNION ALL SELECT DISTINCT 'entity', kind, entity, NULL, NULL FROM d
    """
)
def carry_out_plan(t: Tables) -> DataFrame:
    """Orders with their parts, brought from a former state to the present one by a plan; nothing is left to do afterwards."""
    key = ["kind", "entity", "prop"]
    entity = t.orders.select(F.lit("order").alias("kind"), text("o_orderkey").alias("entity"), "o_orderkey", "o_orderstatus", "o_orderpriority")

    def props(status):
        pairs = F.array(
            F.struct(F.lit("status").alias("prop"), F.lit("string").alias("type"), status.alias("value")),
            F.struct(F.lit("priority").alias("prop"), F.lit("string").alias("type"), F.col("o_orderpriority").alias("value")),
        )
        return entity.select("kind", "entity", "o_orderkey", F.inline(pairs))

    desired = props(F.col("o_orderstatus")).drop("o_orderkey")
    actual = props(F.when(F.col("o_orderkey") % 3 == 1, "?").otherwise(F.col("o_orderstatus"))).filter("o_orderkey % 3 <> 0").drop("type", "o_orderkey")
    lines = t.lineitem.select(text("l_orderkey").alias("entity"), text("l_partkey").alias("name"), "l_orderkey", "l_linenumber")
    wanted = lines.select("entity", "name").distinct()
    has = lines.filter("l_orderkey % 3 <> 0 AND l_linenumber % 2 = 1").select("entity", "name")
    has = has.unionByName(entity.filter("o_orderkey % 15 = 1").select("entity", F.lit("none").alias("name"))).distinct()
    parts = has.filter("name <> 'none'").select(F.lit("part").alias("kind"), F.col("name").alias("entity")).distinct()
    entities = actual.select("kind", "entity").distinct().unionByName(parts)
    members = has.select(F.lit("order").alias("kind"), "entity", "name")
    specs = [Prop("order", "status"), Prop("order", "priority")]

    def planned(state: execute.State) -> DataFrame:
        verbs = rec.reconcile_entities(entity.select("kind", "entity"), state.entities, ["kind", "entity"])
        of_orders = rec.phased_plan(verbs, desired, state.props.select(*key, "value"), specs).good
        known = state.entities.filter("kind = 'part'").select(F.col("entity").alias("name"))
        attached = state.members.select("entity", "name")
        own = execute.member_plan(rec.reconcile_members(wanted, attached, known, ["entity"], "name"), "order", "entity", "name", "part")
        return of_orders.select(*execute.PLAN).unionByName(own)

    state = execute.State(entities, actual, members)
    after, report = execute.carry_out(state, planned(state))
    none = F.lit(None).cast("string")
    left = planned(after).select(F.lit("left").alias("what"), "kind", "entity", F.col("verb").alias("name"), F.col("new").alias("value"))
    failed = report.filter("status <> 'done'").select(F.col("status").alias("what"), "kind", "entity", F.col("verb").alias("name"), F.col("rule").alias("value"))
    return (
        after.props.select(F.lit("prop").alias("what"), "kind", "entity", F.col("prop").alias("name"), "value")
        .unionByName(after.members.select(F.lit("member").alias("what"), "kind", "entity", "name", none.alias("value")))
        .unionByName(after.entities.select(F.lit("entity").alias("what"), "kind", "entity", none.alias("name"), none.alias("value")))
        .unionByName(left)
        .unionByName(failed)
    )


@query(
    """
    WITH c AS (SELECT '/c/' || c_custkey || '.json' AS root, c_custkey % 3 AS v, c_nationkey AS n FROM customer)
    SELECT root, 'level' AS what, 'role boss' AS name, CASE WHEN v = 1 THEN '2' ELSE '1' END AS value FROM c
    UNION ALL SELECT root, 'level', 'role clerk', '0' FROM c
    UNION ALL SELECT root, 'level', 'execute run', CASE WHEN v = 1 THEN '1' ELSE '0' END FROM c
    UNION ALL SELECT root, 'action', 'boss run', 'urn:own' FROM c
    UNION ALL SELECT root, 'action', 'boss far', 'urn:' || n FROM c WHERE n < 20
    UNION ALL SELECT '{' || root || ', boss}', 'no-action', 'execute', 'far' || n FROM c WHERE n >= 20
    UNION ALL SELECT root, 'target', 'pages', 'database data' FROM c
    UNION ALL SELECT root, 'shard', printf('data-%03d-%03d', h, s), 'h' || h FROM c, (SELECT unnest([1, 2]) AS h), (SELECT unnest([1, 2]) AS s) WHERE v <> 2
    UNION ALL SELECT root, 'shard', 'f', 'h2' FROM c WHERE v = 2
    UNION ALL SELECT 'data', 'mixed-hosts', 'shards', '1' FROM c WHERE v = 2
    """
)
def settle_clusters(t: Tables) -> DataFrame:
    """One environment per customer: privileges and roles in order, actions from a registry by nation, targets and shards."""
    own = F.format_string("/c/%d.json", "c_custkey")
    v = F.col("c_custkey") % 3
    body = F.format_string(
        '{"top":{"format":"0.1","hosts":[{"name":"h1"},{"name":"h2"}],"privileges":{"execute":[{"name":"run","action":"urn:own"%s}]},'
        '"roles":[{"name":"clerk"},{"name":"boss","roles":"clerk","privileges":{"execute":"run,far%d"}}],'
        '"databases":[{"name":"data","forests":%s}],"sources":[{"name":"pages","target":"data"}]}}',
        F.when(v == 1, ',"roles":"clerk"').otherwise(""), F.col("c_nationkey"), F.when(v == 2, '[{"name":"f","host":"h2"},"g"]').otherwise("2"),
    )
    modules = t.customer.select(own.alias("module"), body.alias("body"))
    env = environment.compile_environments(modules, modules.select("module"))
    registry = t.nation.filter("n_nationkey < 20").select(
        F.lit("execute").alias("kind"), F.concat(F.lit("far"), text("n_nationkey")).alias("privilege"), F.concat(F.lit("urn:"), text("n_nationkey")).alias("action")
    )
    security, placed = cluster.settle_security(env, registry), cluster.settle_cluster(env)
    short = F.regexp_replace("privilege", r"far\d+", "far")
    issue = security.issue.unionByName(placed.issue)
    return (
        security.levels.select("root", F.lit("level").alias("what"), F.concat_ws(" ", "kind", "name").alias("name"), text("level").alias("value"))
        .unionByName(security.grants.select("root", F.lit("action").alias("what"), F.concat_ws(" ", F.col("role"), short).alias("name"), F.col("action").alias("value")))
        .unionByName(placed.targets.select("root", F.lit("target").alias("what"), F.col("source").alias("name"), F.concat_ws(" ", "of", "key").alias("value")))
        .unionByName(placed.shards.select("root", F.lit("shard").alias("what"), F.col("shard").alias("name"), F.col("host").alias("value")))
        .unionByName(issue.select(F.col("entity").alias("root"), F.col("rule").alias("what"), F.col("prop").alias("name"), "value"))
    )
