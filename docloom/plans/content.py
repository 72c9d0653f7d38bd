"""Values, lists, permissions, templates and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions import comparators as cmp
from docloom.functions.values import map_to_pairs, merge_permissions as merged_permissions, pad_name, split_list
from docloom.operators.collations import between, value_lexicon
from docloom.operators.extract import extract_issues, extract_rows, range_values
from docloom.operators.layers import multiply
from docloom.operators.permissions import explode_permissions, group_permissions
from docloom.operators.substitute import substitute
from docloom.operators.records import Nested, validate_records
from docloom.operators.stored_index import StoredIndex
from docloom.operators.validate import Prop, apply_defaults as defaulted, validate
from docloom.operators.xml_paths import extract_xml as extract_by_paths
from docloom.plans.documents import page_paths
from docloom.plans.registry import Tables, query
from docloom.storage import fresh_path

STRING_DEFAULT = "http://example.org/collation"


@query(
    r"""
    SELECT p_partkey, unnest(string_split_regex(p_brand || ' , ' || p_type || ',' || p_name, '\s*,\s*')) AS name FROM part
    """
)
def explode_names(t: Tables) -> DataFrame:
    text = F.concat_ws(",", F.concat_ws(" , ", "p_brand", "p_type"), "p_name")
    return multiply(t.part.select("p_partkey", split_list(text).alias("name")), "name")


@query("SELECT event_id, 'k' AS prefix, json_extract_string(props, '$.k') AS uri FROM events")
def map_pairs(t: Tables) -> DataFrame:
    pairs = map_to_pairs(F.from_json("props", "map<string,string>"), "prefix", "uri")
    return t.events.select("event_id", F.inline(pairs))


@query(
    "SELECT l_orderkey, l_linenumber, printf('o%d-%03d-%03d', l_orderkey, l_linenumber, CAST(l_quantity AS INT)) AS name "
    "FROM lineitem"
)
def pad_names(t: Tables) -> DataFrame:
    name = pad_name(F.concat(F.lit("o"), F.col("l_orderkey")), F.col("l_linenumber"), F.col("l_quantity").cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", name.alias("name"))


def _grants(t: Tables) -> DataFrame:
    caps = F.when(F.col("n_chars") > 1000, "update , read").otherwise("insert,delete")
    grants = F.create_map(F.col("source"), caps, F.col("lang"), F.lit("read,read,execute"))
    return t.documents.select("doc_id", grants.alias("permissions"))


@query(
    """
    WITH g AS (
      SELECT doc_id, source AS role, unnest(CASE WHEN n_chars > 1000 THEN ['update', 'read'] ELSE ['insert'] END) AS capability
      FROM documents
      UNION ALL SELECT doc_id, lang, unnest(['read', 'read', 'execute']) FROM documents)
    SELECT doc_id, role, string_agg(capability, ',' ORDER BY capability) AS capabilities FROM g GROUP BY doc_id, role
    """
)
def document_acl(t: Tables) -> DataFrame:
    pairs = explode_permissions(_grants(t), "permissions", "doc_id").good
    return group_permissions(pairs, ["doc_id"]).select("doc_id", "role", F.array_join("capabilities", ",").alias("capabilities"))


@query(
    "SELECT source AS role, 'unknown-capability' AS rule, 'delete' AS value, count(*) AS n "
    "FROM documents WHERE n_chars <= 1000 GROUP BY source"
)
def acl_issues(t: Tables) -> DataFrame:
    issue = explode_permissions(_grants(t), "permissions", "doc_id").issue
    return issue.groupBy(F.col("prop").alias("role"), "rule", "value").agg(F.count("*").alias("n"))


@query(
    """
    WITH m AS (
      SELECT doc_id, source AS role, 'read' AS capability FROM documents
      UNION ALL SELECT doc_id, lang, CASE WHEN n_chars > 500 THEN 'insert' ELSE 'update' END FROM documents
      UNION ALL SELECT doc_id, 'own', '' FROM documents)
    SELECT * FROM m
    """
)
def merge_permissions(t: Tables) -> DataFrame:
    base = F.create_map(F.col("source"), F.lit("read"), F.col("lang"), F.lit("update"))
    derived = F.create_map(
        F.col("lang"), F.when(F.col("n_chars") > 500, "insert").otherwise(""), F.lit("own"), F.lit("")
    )
    return t.documents.select("doc_id", F.explode(merged_permissions(derived, base)).alias("role", "capability"))


ORDER_SCHEMA = [
    Prop("order", "status", type="enum", values=("F", "O"), mandatory=True),
    Prop("order", "urgent", type="boolean"),
    Prop("order", "customer", target="custkey", type="integer", mandatory=True),
    Prop("order", "buyer", target="custkey", type="integer"),
    Prop("order", "total", type="integer"),
    Prop("order", "comment", ignored=True),
    Prop("order", "day", mandatory=True),
]


def _order_props(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    pairs = {
        "status": F.col("o_orderstatus"),
        "urgent": F.when(first == "1", "true").when(first == "5", "false").when(first == "2", "yes"),
        "customer": F.col("o_custkey").cast("string"),
        "buyer": F.when(first == "3", F.col("o_custkey").cast("string")),
        "total": F.when(F.col("o_totalprice") > 250000, F.col("o_totalprice").cast("string")).otherwise("12"),
        "comment": F.lit("anything"),
        "day": F.when(F.col("o_orderstatus") != "P", "monday"),
        "colour": F.when(first == "4", "red"),
    }
    rows = F.array(*[F.struct(F.lit(p).alias("prop"), v.alias("value")) for p, v in pairs.items()])
    return t.orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("entity"), F.inline(rows))


@query(
    """
    WITH i AS (
      SELECT 'status' AS prop, 'not-in-enum' AS rule FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
      UNION ALL SELECT 'urgent', 'not-boolean' FROM orders WHERE o_orderpriority LIKE '2%'
      UNION ALL SELECT 'custkey', 'set-twice' FROM orders WHERE o_orderpriority LIKE '3%'
      UNION ALL SELECT 'total', 'not-integer' FROM orders WHERE o_totalprice > 250000
      UNION ALL SELECT 'day', 'missing-mandatory' FROM orders WHERE o_orderstatus = 'P'
      UNION ALL SELECT 'colour', 'unknown-property' FROM orders)
    SELECT prop, rule, count(*) AS n FROM i GROUP BY ALL
    """
)
def strict_types(t: Tables) -> DataFrame:
    issue = validate(_order_props(t), ORDER_SCHEMA).issue
    return issue.groupBy("prop", "rule").agg(F.count("*").alias("n"))


@query(
    """
    WITH g AS (
      SELECT 'status' AS prop FROM orders WHERE o_orderstatus IN ('F', 'O')
      UNION ALL SELECT 'urgent' FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '5%'
      UNION ALL SELECT 'custkey' FROM orders
      UNION ALL SELECT 'custkey' FROM orders WHERE o_orderpriority LIKE '3%'
      UNION ALL SELECT 'total' FROM orders WHERE o_totalprice <= 250000
      UNION ALL SELECT 'day' FROM orders WHERE o_orderstatus <> 'P')
    SELECT prop, count(*) AS n FROM g GROUP BY prop
    """
)
def valid_props(t: Tables) -> DataFrame:
    return validate(_order_props(t), ORDER_SCHEMA).good.groupBy("prop").agg(F.count("*").alias("n"))


INDEX_DEFAULTS = [
    Prop("index", "type"),
    Prop("index", "invalid", default="ignore"),
    Prop("index", "collation", default=("type", lambda c: F.when(c == "purchase", STRING_DEFAULT).otherwise(""))),
]


@query(
    f"""
    SELECT event_id AS entity, 'type' AS prop, event_type AS value FROM events
    UNION ALL SELECT event_id, 'invalid', 'ignore' FROM events
    UNION ALL SELECT event_id, 'collation',
                     CASE event_type WHEN 'view' THEN 'own' WHEN 'error' THEN NULL
                                     WHEN 'purchase' THEN '{STRING_DEFAULT}' ELSE '' END FROM events
    """
)
def apply_defaults(t: Tables) -> DataFrame:
    own = F.array(
        F.struct(F.lit("type").alias("prop"), F.col("event_type").alias("value")),
        F.when(
            F.col("event_type").isin("view", "error"),
            F.struct(F.lit("collation").alias("prop"), F.when(F.col("event_type") == "view", "own").alias("value")),
        ),
    )
    props = t.events.select(
        F.lit("index").alias("kind"), F.col("event_id").alias("entity"), F.inline(F.array_compact(own))
    )
    return defaulted(props, INDEX_DEFAULTS).select("entity", "prop", "value")


@query(
    """
    SELECT c_custkey, 'shop/' || c_mktsegment || '/prod-' || c_nationkey || '/shop' AS text FROM customer
    """
)
def substitute_params(t: Tables) -> DataFrame:
    text = F.concat(F.lit("@{code}/"), "c_mktsegment", F.lit("/${env}-"), "c_nationkey", F.lit("/@{code}"))
    texts = t.customer.select("c_custkey", text.alias("text"))
    return substitute(texts, "text", {"@code": "shop", "env": "prod"}, ["c_custkey"]).good


@query(
    """
    SELECT c_custkey, n_name || '-' || r_name || '-content' AS text
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE c_acctbal >= 0
    """
)
def substitute_scoped(t: Tables) -> DataFrame:
    params = (
        t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("n_nationkey").alias("c_nationkey"),
            F.inline(
                F.array(
                    F.struct(F.lit("@code").alias("name"), F.col("n_name").alias("value")),
                    F.struct(F.lit("region-name").alias("name"), F.col("r_name").alias("value")),
                )
            ),
        )
    )
    text = F.when(F.col("c_acctbal") >= 0, "@{code}-${region-name}-content").otherwise("@{code}-${nothing}")
    texts = t.customer.select("c_custkey", "c_nationkey", text.alias("text"))
    good = substitute(texts, "text", params, ["c_custkey"], ["c_nationkey"]).good
    return good.select("c_custkey", "text")


@query(
    """
    WITH w AS (SELECT doc_id, string_split(text, ' ') AS words FROM documents)
    SELECT doc_id, true AS eq_sorted, len(words) = len(list_distinct(words)) AS eq_distinct FROM w
    """
)
def diff_lists(t: Tables) -> DataFrame:
    """Word lists of whole texts against their sorted and their distinct words."""
    words = F.split("text", " ", -1)
    return t.documents.select(
        "doc_id",
        cmp.eq_list(words, F.sort_array(words)).alias("eq_sorted"),
        cmp.eq_list(words, F.array_distinct(words)).alias("eq_distinct"),
    )


@query(
    """
    SELECT event_id, event_type <> 'error' AS same_map,
           event_type NOT IN ('view', 'signup') AS same_perms,
           event_type <> 'click' AS same_order
    FROM events
    """
)
def compare_values(t: Tables) -> DataFrame:
    """Map, permission and ordered comparisons over events."""
    is_ = lambda *v: F.col("event_type").isin(*v)
    as_map = F.from_json("props", "map<string,string>")
    other = F.when(is_("error"), F.create_map(F.lit("k"), F.lit("none"))).otherwise(as_map)

    def perm(capability: str):
        return F.array(F.struct(F.col("user_id").cast("string").alias("role-name"), F.lit(capability).alias("capability")))

    perms = F.when(is_("view"), perm("update")).when(~is_("signup"), perm("read"))

    def replica(name, dir):
        return F.struct(F.lit(name).alias("name"), dir.alias("dir"))

    empty, none = F.lit(""), F.lit(None).cast("string")
    desired = F.array(replica("b", empty), replica("a", F.col("event_type")))
    actual = F.array(replica("a", F.when(is_("click"), F.lit("elsewhere")).otherwise(F.col("event_type"))), replica("b", none))
    return t.events.select(
        "event_id",
        cmp.eq_map(as_map, other).alias("same_map"),
        cmp.eq_perms(perms, perm("read")).alias("same_perms"),
        cmp.eq_ordered(desired, actual, ["name", "dir"], "name").alias("same_order"),
    )


EVENT_TEMPLATE = {
    "context": "/",
    "rows": [{"schemaName": "web", "viewName": "events", "columns": [{"name": "k", "scalarType": "long", "val": "k"}]}],
}


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def extract_events(t: Tables) -> DataFrame:
    return extract_rows(t.events, EVENT_TEMPLATE, ["event_id"], "props")["web.events"]


SALES_TEMPLATE = {
    "context": "/sales/line",
    "collections": ["returned", "open"],
    "rows": [
        {
            "schemaName": "sales",
            "viewName": "lines",
            "columns": [
                {"name": "id", "scalarType": "long", "val": "id"},
                {"name": "shipped", "scalarType": "date", "val": "ship-date"},
                {"name": "flag", "scalarType": "string", "val": "@flag"},
            ],
        }
    ],
}


@query(
    """
    SELECT l_orderkey, l_linenumber, l_partkey AS id, CAST(l_shipdate AS DATE) AS shipped, l_returnflag AS flag FROM lineitem
    WHERE l_returnflag IN ('R', 'N')
    UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, NULL, 'second' FROM lineitem WHERE l_returnflag IN ('R', 'N')
    """
)
def extract_xml(t: Tables) -> DataFrame:
    """One XML document per line item, two context nodes each, the second with a date that does not parse."""
    xml = F.format_string(
        "<sales><line flag='%s'><id>%d</id><ship-date>%s</ship-date></line>"
        "<line flag='second'><id>%d</id><ship-date>soon</ship-date></line></sales>",
        "l_returnflag", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd"), "l_suppkey",
    )
    collection = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "N", "open").otherwise("other")
    docs = t.lineitem.select("l_orderkey", "l_linenumber", xml.alias("content"), F.array(collection).alias("collections"))
    return extract_rows(docs, SALES_TEMPLATE, ["l_orderkey", "l_linenumber"], format="xml")["sales.lines"]


@query("SELECT CAST(doc_id AS VARCHAR) AS entity, 'malformed' AS rule FROM documents WHERE doc_id % 3 = 1 OR n_chars > 20000")
def extraction_issues(t: Tables) -> DataFrame:
    """Documents as JSON, every third one and all long ones cut short."""
    whole = F.to_json(F.struct("text"))
    broken = (F.col("doc_id") % 3 == 1) | (F.col("n_chars") > 20000)
    docs = t.documents.select("doc_id", F.when(broken, whole.substr(F.lit(1), F.length(whole) - 1)).otherwise(whole).alias("content"))
    return extract_issues(docs, "doc_id").select("entity", "rule")


def _page_records(t: Tables) -> DataFrame:
    last = F.substring_index("path", "/", -1)
    return page_paths(t).select(
        F.col("page_id").alias("uri"), F.to_json(F.struct(F.struct(last.alias("n")).alias("page"))).alias("content")
    )


_LAST = "regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$')"


@query(f"SELECT page_id AS uri, CAST({_LAST} AS INT) AS value FROM pages WHERE TRY_CAST({_LAST} AS INT) IS NOT NULL")
def range_ignore(t: Tables) -> DataFrame:
    index = {"type": "int", "path": "/page/n", "invalid": "ignore"}
    return range_values(_page_records(t), index).good.select("uri", "value")


@query(f"SELECT CAST(page_id AS VARCHAR) AS entity, 'invalid-value' AS rule, {_LAST} AS value FROM pages WHERE TRY_CAST({_LAST} AS INT) IS NULL")
def range_reject(t: Tables) -> DataFrame:
    index = {"type": "int", "path": "/page/n", "invalid": "reject"}
    return range_values(_page_records(t), index).issue.select("entity", "rule", "value")


@query(
    """
    SELECT doc_id AS uri, 'n' AS name, CAST(n_chars AS BIGINT) AS value FROM documents
    UNION ALL SELECT doc_id, 'n', doc_id FROM documents
    UNION ALL SELECT doc_id, 'extra', strlen(text) FROM documents
    """
)
def range_names(t: Tables) -> DataFrame:
    """Keys at any depth, next to the whole text, which must not be mistaken for them."""
    body = F.struct(
        F.struct(F.col("n_chars").alias("n"), F.concat(F.lit('"n":5 '), "text").alias("text")).alias("meta"),
        F.array(F.struct(F.array("doc_id").alias("n"))).alias("items"),
        F.octet_length("text").cast("string").alias("extra"),
    )
    docs = t.documents.select(F.col("doc_id").alias("uri"), F.to_json(body).alias("content"))
    return range_values(docs, {"type": "long", "name": ["n", "extra"]}).good


@query(
    """
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS value FROM lineitem
    """
)
def range_attribute(t: Tables) -> DataFrame:
    """Attribute index over one XML document per line item."""
    xml = F.format_string("<line><at day='%s' n='1'>x</at></line>", F.date_format("l_shipdate", "yyyy-MM-dd"))
    docs = t.lineitem.select(F.struct("l_orderkey", "l_linenumber").alias("uri"), xml.alias("content"))
    index = {"type": "date", "name": "day", "parent": {"name": "at"}}
    return range_values(docs, index, format="xml").good.select("uri.*", "value")


# --- XML by an automaton, collations, the stored index ------------------------

PART_TEMPLATE = {
    "context": "/s:parts/s:part",
    "namespaces": {"s": "urn:shop", "w": "urn:works"},
    "rows": [
        {"schemaName": "shop", "viewName": "parts", "columns": [
            {"name": "id", "scalarType": "long", "val": "@id"}, {"name": "name", "scalarType": "string", "val": "s:name"},
            {"name": "works", "scalarType": "string", "val": "w:name"}, {"name": "size", "scalarType": "int", "val": "dim/w:size"},
        ]},
        {"schemaName": "works", "viewName": "names", "columns": [{"name": "id", "scalarType": "long", "val": "@id"}, {"name": "text", "scalarType": "string", "val": "."}]},
    ],
}
PART_INDEXES = {
    "sizes": {"type": "int", "path": "/s:parts/s:part/dim/w:size", "namespaces": {"s": "urn:shop", "w": "urn:works"}, "invalid": "reject"},
    "names": {"type": "string", "name": "name", "namespace": "urn:works"},
    "ids": {"type": "long", "name": "id", "parent": {"name": "part", "namespace": "urn:shop"}},
}


def _odd_parts(t: Tables) -> DataFrame:
    """Parts as XML with two namespaces that share a local name; by key some begin with a byte order mark, have a doctype with
    an internal subset, are deeply nested, use a prefix that is not declared, or are cut short."""
    k = F.col("p_partkey") % 7
    deep = F.lit(2_000)
    size = F.when(k == 6, "big").otherwise(F.col("p_size").cast("string"))
    dim = F.concat(F.lit("<dim><w:size>"), size, F.lit("</w:size></dim>"))
    nested = F.concat(F.repeat(F.lit("<x>"), deep), F.lit("deep"), F.repeat(F.lit("</x>"), deep))
    inner = F.concat(
        F.format_string("<s:part id='%d'><s:name>", "p_partkey"), F.when(k == 2, "&short;").otherwise(F.col("p_name")), F.lit("</s:name><w:name>"),
        F.col("p_brand"), F.lit("</w:name>"), dim, F.when(k == 3, nested).when(k == 4, "<u:name/>").otherwise(""), F.lit("</s:part>"),
    )
    doctype = F.lit("<!DOCTYPE parts [<!ENTITY short \"abc\"> <!ELEMENT parts ANY> <!-- ] > -->]>")
    body = F.concat(F.lit("<s:parts xmlns:s='urn:shop' xmlns:w='urn:works'>"), inner, F.when(k == 5, "").otherwise("</s:parts>"))
    content = F.when(k == 1, F.concat(F.lit("\ufeff"), body)).when(k == 2, F.concat(doctype, body)).otherwise(body)
    return t.part.select(F.col("p_partkey").cast("string").alias("uri"), content.alias("content"))


_SOUND = "p AS (SELECT *, p_partkey % 7 AS k FROM part WHERE p_partkey % 7 NOT IN (4, 5))"


@query(
    f"""
    WITH {_SOUND}
    SELECT p_partkey AS id, CASE WHEN k = 2 THEN 'abc' ELSE p_name END AS name, p_brand AS works, CASE WHEN k <> 6 THEN CAST(p_size AS INT) END AS size,
      (CASE WHEN k = 2 THEN 'abc' ELSE p_name END) || p_brand || (CASE WHEN k = 6 THEN 'big' ELSE CAST(p_size AS VARCHAR) END) || (CASE WHEN k = 3 THEN 'deep' ELSE '' END) AS text
    FROM p
    """
)
def extract_namespaces(t: Tables) -> DataFrame:
    """Two views of one template, joined by id: names of either namespace, sizes, and all text of a part."""
    views = extract_by_paths(_odd_parts(t), {"parts": PART_TEMPLATE}, PART_INDEXES).views
    return views["shop.parts"].select("id", "name", "works", "size").join(views["works.names"].select("id", "text"), "id")


@query(
    f"""
    WITH {_SOUND}
    SELECT 'sizes' AS what, CAST(p_partkey AS VARCHAR) AS uri, CAST(p_size AS VARCHAR) AS value FROM p WHERE k <> 6
    UNION ALL SELECT 'names', CAST(p_partkey AS VARCHAR), p_brand FROM p
    UNION ALL SELECT 'ids', CAST(p_partkey AS VARCHAR), CAST(p_partkey AS VARCHAR) FROM p
    UNION ALL SELECT 'malformed', CAST(p_partkey AS VARCHAR), NULL FROM part WHERE p_partkey % 7 IN (4, 5)
    UNION ALL SELECT 'invalid-value', CAST(p_partkey AS VARCHAR), 'big' FROM p WHERE k = 6
    """
)
def extract_odd_xml(t: Tables) -> DataFrame:
    """Index values of the same documents, from the same parse, and an issue for each that gives none."""
    found = extract_by_paths(_odd_parts(t), {"parts": PART_TEMPLATE}, PART_INDEXES)
    rows = found.issue.select(F.col("rule").alias("what"), F.col("entity").alias("uri"), "value")
    for name, values in found.ranges.items():
        rows = rows.unionByName(values.select(F.lit(name).alias("what"), "uri", F.col("value").cast("string").alias("value")))
    return rows


@query(
    """
    SELECT CAST(c_custkey AS VARCHAR) AS entity, 'malformed' AS rule FROM customer WHERE c_custkey % 50 = 1
    UNION ALL SELECT CAST(c_custkey AS VARCHAR), CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 50 <> 1
    """
)
def range_deep(t: Tables) -> DataFrame:
    """Values at any depth of JSON documents; some are nested beyond what a parser takes, or begin with a byte order mark."""
    plain = F.concat(F.when(F.col("c_custkey") % 3 == 0, "\ufeff").otherwise(""), F.format_string('{"a":[{"b":{"n":%d}}]}', "c_custkey"))
    deep = F.concat(F.repeat(F.lit("["), F.lit(100_000)), F.repeat(F.lit("]"), F.lit(100_000)))
    docs = t.customer.select(F.col("c_custkey").alias("uri"), F.when(F.col("c_custkey") % 50 == 1, deep).otherwise(plain).alias("content"))
    good, issue = range_values(docs, {"type": "long", "name": "n"})
    return issue.select("entity", "rule").unionByName(good.select(F.col("uri").cast("string").alias("entity"), F.col("value").cast("string").alias("rule")))


def _spelled(t: Tables) -> DataFrame:
    """Market segments in three spellings, by customer."""
    k = F.col("c_custkey") % 3
    spelled = F.when(k == 0, F.lower("c_mktsegment")).when(k == 1, F.col("c_mktsegment")).otherwise(F.translate(F.lower("c_mktsegment"), "u", "ü"))
    return t.customer.select(F.format_string("<c><seg>%s</seg></c>", spelled).alias("content"), F.col("c_custkey").cast("string").alias("uri"))


_SPELLED = """
    s AS (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN lower(c_mktsegment) WHEN 1 THEN c_mktsegment ELSE translate(lower(c_mktsegment), 'u', 'ü') END AS v FROM customer)
"""


@query(
    f"""
    WITH {_SPELLED}
    SELECT 'codepoint' AS collation, v AS value, count(*) AS documents, count(*) AS frequency FROM s GROUP BY v
    UNION ALL SELECT 'S2', min(v), count(*), count(*) FROM s GROUP BY lower(v)
    UNION ALL SELECT 'S1', min(v), count(*), count(*) FROM s GROUP BY translate(lower(v), 'ü', 'u')
    UNION ALL SELECT 'from', min(v), count(*), count(*) FROM s WHERE translate(lower(v), 'ü', 'u') BETWEEN 'building' AND 'furniture' GROUP BY translate(lower(v), 'ü', 'u')
    """
)
def lexicon_collations(t: Tables) -> DataFrame:
    """Values of one index as three collations tell them apart, and a range by the least strict."""
    docs, rows = _spelled(t), None
    names = {"codepoint": "/codepoint", "S2": "/S2", "S1": "/S1"}
    indexes = {k: {"type": "string", "path": "/c/seg", "collation": STRING_DEFAULT + at} for k, at in names.items()}
    ranges = extract_by_paths(docs, {}, indexes, root_collation=STRING_DEFAULT).ranges
    ranges["from"] = between(ranges["S1"], "Building", "FURNITURE")
    for k, values in ranges.items():
        one = value_lexicon(values).withColumn("collation", F.lit(k))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(
    """
    SELECT 'length' AS name, 'd' || doc_id AS uri, CAST(n_chars AS BIGINT) AS value FROM documents WHERE doc_id % 11 <> 3 AND n_chars BETWEEN 200 AND 900
    UNION ALL SELECT 'words', 'd' || doc_id, CAST(len(string_split(text, ' ')) AS BIGINT) FROM documents WHERE doc_id % 11 <> 3 AND len(string_split(text, ' ')) >= 500
    """
)
def stored_ranges(t: Tables) -> DataFrame:
    """An index built from a former state of the documents and brought up to date: a tenth had other values, a tenth is gone, some are new."""
    words = F.size(F.split("text", " ", -1))

    def as_json(length, n):
        return F.to_json(F.struct(length.cast("long").alias("length"), n.cast("long").alias("words")))

    all_ = t.documents.select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("uri"), "n_chars", words.alias("words"))
    changed = F.col("doc_id") % 11 == 5
    before = all_.filter("doc_id % 11 <> 7").select("uri", F.when(changed, as_json(F.col("n_chars") + 1, F.lit(1))).otherwise(as_json(F.col("n_chars"), F.col("words"))).alias("content"))
    now = all_.filter("doc_id % 11 <> 3").select("uri", as_json(F.col("n_chars"), F.col("words")).alias("content"))

    def values(docs: DataFrame) -> DataFrame:
        found = range_values(docs, {"type": "long", "path": ["length", "words"]}).good
        return found.select("uri", "name", "value")

    index = StoredIndex(t.spark, fresh_path(t.spark, "index"), values, file_rows=200)
    index.refresh(before)
    index.refresh(now)
    return index.search("length", 200, 900).unionByName(index.search("words", 500))


FOREST_SCHEMA = [
    Prop("database", "name", mandatory=True), Prop("database", "forests", ignored=True),
    Prop("forest", "name", mandatory=True), Prop("forest", "dir", target="data-directory", default="/data"),
    Prop("forest", "size", type="integer"), Prop("forest", "replicas", ignored=True),
    Prop("replica", "name", mandatory=True), Prop("replica", "host", default="Default"),
]
FORESTS = [Nested("database", "forests", "forest", key="name"), Nested("forest", "replicas", "replica", key="name")]


@query(
    """
    WITH s AS (SELECT s_suppkey AS k, 'n' || s_suppkey AS name, s_suppkey % 4 AS v FROM supplier)
    SELECT 'forest' AS kind, name || '.forests[0]' AS entity, 'data-directory' AS what, '/data' AS value FROM s
    UNION ALL SELECT 'forest', name || '.forests[1]', 'data-directory', '/d/' || k FROM s
    UNION ALL SELECT 'forest', name || '.forests[' || i || ']', 'name', CASE WHEN v = 1 OR i = 0 THEN 'f' ELSE 'g' END FROM s, (SELECT unnest([0, 1]) AS i)
    UNION ALL SELECT 'forest', name || '.forests[1]', 'size', '7' FROM s WHERE v <> 2
    UNION ALL SELECT 'replica', name || '.forests[1].replicas[0]', 'name', 'r' || k FROM s
    UNION ALL SELECT 'replica', name || '.forests[1].replicas[0]', 'host', CASE WHEN v = 3 THEN 'h3' ELSE 'Default' END FROM s
    UNION ALL SELECT 'forest', name, 'duplicate-record', 'f' FROM s WHERE v = 1
    UNION ALL SELECT 'forest', name || '.forests[1]', 'not-integer', 'x' FROM s WHERE v = 2
    UNION ALL SELECT 'replica', name || '.forests[1].replicas[0]', 'unknown-property', '1' FROM s WHERE v = 3
    UNION ALL SELECT 'forest', name || '.forests[1]', 'record-no-object', 'text' FROM s WHERE v = 0
    """
)
def nested_records(t: Tables) -> DataFrame:
    """Databases with forests with replicas: checked and defaulted at any depth, faults under their path."""
    v = F.col("s_suppkey") % 4
    replica = F.concat(F.format_string('{"name":"r%d"', "s_suppkey"), F.when(v == 3, ',"host":"h3","odd":1').otherwise(""), F.lit("}"))
    replicas = F.when(v == 0, F.concat(F.lit("["), replica, F.lit(',"text"]'))).otherwise(F.concat(F.lit("["), replica, F.lit("]")))
    size = F.when(v == 2, '"x"').otherwise("7")
    second = F.concat(F.format_string('{"name":"%s","dir":"/d/%d","size":', F.when(v == 1, "f").otherwise("g"), F.col("s_suppkey")), size, F.lit(',"replicas":'), replicas, F.lit("}"))
    forests = F.concat(F.lit('[{"name":"f"},'), second, F.lit("]"))
    name = F.concat(F.lit("n"), F.col("s_suppkey").cast("string"))
    pairs = F.array(F.struct(F.lit("name").alias("prop"), name.alias("value")), F.struct(F.lit("forests").alias("prop"), forests.alias("value")))
    props = t.supplier.select(F.lit("database").alias("kind"), name.alias("entity"), F.inline(pairs))
    good, issue = validate_records(props, FOREST_SCHEMA, FORESTS)
    return good.filter("parent IS NOT NULL").select("kind", "entity", F.col("prop").alias("what"), "value").unionByName(
        issue.select("kind", "entity", F.col("rule").alias("what"), "value")
    )
