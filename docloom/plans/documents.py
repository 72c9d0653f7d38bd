"""Scanning, selecting, naming, batching and writing documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.paths import extension, url_path
from docloom.operators.batching import batch_documents as cut_batches
from docloom.operators.batching import batch_summary as summarise
from docloom.operators.documents import (
    attach_mime,
    derive_uri,
    effective_collections as own_or_default,
    index_class,
    module_mime,
    route_by_root,
    select_paths,
    with_fallback,
)
from docloom.operators.environment import load_documents as load
from docloom.operators.extract import lexicon
from docloom.plans.registry import Tables, query
from docloom.sources.documents import flatten_listing as listed
from docloom.sources.documents import parse_trace, read_contents, scan_documents as scan, single_document as single
from docloom.sources.delivery import deliver_missing, ledger
from docloom.sources.sinks import deliver, write_documents, write_file, write_files
from docloom.sources.tree import scan_tree
from docloom.storage import fresh_path, local_table


def page_paths(t: Tables) -> DataFrame:
    return t.pages.select("page_id", url_path(F.col("url")).alias("path"))


def document_paths(t: Tables) -> DataFrame:
    path = F.concat(F.lit("/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return t.documents.select("doc_id", "lang", "source", "n_chars", path.alias("path"))


@query(
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, path AS uri FROM p
    WHERE NOT regexp_matches(path, '(^|/)de/') AND regexp_matches(path, '(^|/)[^/]*\.html$')
    """
)
def glob_pages(t: Tables) -> DataFrame:
    kept = select_paths(page_paths(t), include=["*.html"], garbage=["de/"])
    return derive_uri(kept).good.select("page_id", "uri")


@query(
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, path FROM p
    WHERE split_part(path, '/', 2) IN ('en', 'fr')
      AND regexp_matches(path, '^/[^/]*/[0-9][^/]*$')
      AND NOT regexp_matches(path, '[13579](\.html)?$')
    """
)
def glob_directories(t: Tables) -> DataFrame:
    return select_paths(
        page_paths(t), include=["{en,fr}/", "/*/[0-9]*"], exclude=["*[13579]", "*[13579].html"]
    )


@query(
    """
    SELECT doc_id, '/kept' || '/' || source || '/' || lang || '/' || doc_id || '.txt' AS uri
    FROM documents WHERE lang <> 'de' AND n_chars > 500 AND source <> 'src3'
    """
)
def hook_select(t: Tables) -> DataFrame:
    def hook(rows: DataFrame) -> DataFrame:
        kept = rows.filter(F.when(F.col("isdir"), F.col("name") != "de").otherwise(~F.col("is_excluded")))
        if "n_chars" in rows.columns:
            kept = kept.filter("n_chars > 500").withColumn("uri", F.concat(F.lit("/kept"), "path"))
        return kept

    kept = select_paths(document_paths(t), exclude=["/src3/**"], hook=hook)
    return derive_uri(kept, "/data").good.select("doc_id", "uri")


@query("SELECT page_id, substr(url, instr(url, '/')) AS uri FROM pages")
def single_document(t: Tables) -> DataFrame:
    return single(t.pages, "url").good.select("page_id", "uri")


@query(
    """
    WITH p AS (SELECT split_part(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/', 2) AS route FROM pages)
    SELECT route, CASE WHEN route IN ('en', 'fr', 'es') THEN 'routed' ELSE 'unknown-root' END AS rule,
           count(*) AS n
    FROM p GROUP BY ALL
    """
)
def route_first_segment(t: Tables) -> DataFrame:
    good, issue = route_by_root(page_paths(t), allowed=("en", "fr", "es"))
    rows = good.select("route", F.lit("routed").alias("rule")).unionByName(
        issue.select(F.col("value").alias("route"), "rule")
    )
    return rows.groupBy("route", "rule").agg(F.count("*").alias("n"))


@query(
    r"""
    WITH p AS (SELECT regexp_extract(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '[^/]*$') AS name FROM pages),
    e AS (SELECT CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') END AS ext FROM p)
    SELECT ext, CASE ext WHEN 'html' THEN 'page' END AS mime, CASE ext WHEN 'html' THEN 'text' END AS format,
           CASE WHEN ext IS NULL THEN 'no-extension' WHEN ext <> 'html' THEN 'unknown-extension' END AS rule,
           count(*) AS n
    FROM e GROUP BY ALL
    """
)
def ext_mime(t: Tables) -> DataFrame:
    registry = local_table(
        t.spark,
        {
            "name": ["page", "picture", "record"],
            "extensions": ["html, htm", "jpg , png", "json,xml"],
            "format": ["text", "binary", "json"],
        },
    )
    good, issue = attach_mime(page_paths(t), registry)
    none = F.lit(None).cast("string")
    rows = good.select("ext", "mime", "format", none.alias("rule")).unionByName(
        issue.select(F.col("value").alias("ext"), none.alias("mime"), none.alias("format"), "rule")
    )
    return rows.groupBy("ext", "mime", "format", "rule").agg(F.count("*").alias("n"))


@query(
    """
    WITH m AS (SELECT CASE lang WHEN 'en' THEN 'application/json' WHEN 'fr' THEN 'application/xml'
                                WHEN 'de' THEN 'application/xquery' END AS mime, n_chars FROM documents)
    SELECT mime, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM m GROUP BY mime
    """
)
def module_types(t: Tables) -> DataFrame:
    ext = F.create_map(*[F.lit(x) for x in ("en", "json", "fr", "xml", "de", "xqy", "es", "txt")])
    path = F.concat(F.lit("/"), F.col("doc_id").cast("string"), F.lit("."), ext[F.col("lang")])
    typed = t.documents.select(path.alias("path"), "n_chars").withColumn("mime", module_mime(F.col("path")))
    return typed.groupBy("mime").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query(
    """
    SELECT doc_id,
           CASE WHEN n_chars > 1000 THEN array_to_string(list_sort([source, lang]), ',') ELSE lang END AS collections,
           n_chars > 1000 AS is_override
    FROM documents
    """
)
def effective_collections(t: Tables) -> DataFrame:
    own = (
        F.when(F.col("n_chars") > 1000, F.array("source", "lang"))
        .when(F.col("n_chars") > 300, F.array("lang"))
    )
    docs = own_or_default(t.documents.select("doc_id", "lang", own.alias("collections")), F.array("lang"))
    return docs.select("doc_id", F.array_join(F.sort_array("collections"), ",").alias("collections"), "is_override")


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_mktsegment
                           WHEN n_regionkey > 0 THEN n_name ELSE '*~' END AS garbage
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
    """
)
def fallback_props(t: Tables) -> DataFrame:
    own = t.customer.select(
        "c_custkey", F.col("c_nationkey").alias("env"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")).alias("garbage"),
    )
    dflt = t.nation.select(
        F.col("n_nationkey").alias("env"), F.when(F.col("n_regionkey") > 0, F.col("n_name")).alias("garbage")
    )
    return with_fallback(own, dflt, ["env"], ["garbage"], {"garbage": "*~"}).select("c_custkey", "garbage")


@query(
    """
    SELECT p_partkey, CASE WHEN p_size > 40 THEN 'field' WHEN p_type = 'ECONOMY' THEN 'path'
                           WHEN p_retailprice < 1000 THEN 'attribute' ELSE 'element' END AS class
    FROM part
    """
)
def classify_index(t: Tables) -> DataFrame:
    rows = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") > 40, F.col("p_name")).otherwise("").alias("field"),
        F.when(F.col("p_type") == "ECONOMY", F.lit("/a/b")).alias("path"),
        F.when(F.col("p_retailprice") < 1000, F.col("p_brand")).alias("parent"),
    )
    return index_class(rows).select("p_partkey", "class")


@query(
    r"""
    WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages),
    k AS (SELECT split_part(path, '/', 2) AS lang,
                 CASE WHEN regexp_matches(path, '\.html$') THEN 'static' ELSE 'dynamic' END AS sort
          FROM p WHERE NOT regexp_matches(path, '~$')),
    c AS (SELECT lang AS value FROM k UNION ALL SELECT sort FROM k WHERE sort = 'static')
    SELECT value, count(*) AS documents FROM c GROUP BY value
    """
)
def page_lexicon(t: Tables) -> DataFrame:
    """Select pages, name them, give them collections, list the collections."""
    named = derive_uri(select_paths(page_paths(t))).good
    lang = F.split_part(F.col("path"), F.lit("/"), F.lit(2))
    own = F.when(extension(F.col("path")) == "html", F.array(lang, F.lit("static")))
    docs = own_or_default(named.withColumn("collections", own), F.array(lang))
    return lexicon(docs)


@query("SELECT lang AS value, count(*) AS documents FROM documents GROUP BY lang UNION ALL "
       "SELECT source, count(*) FROM documents GROUP BY source")
def lexicon_lang(t: Tables) -> DataFrame:
    return lexicon(t.documents.select(F.array("lang", "source", "lang").alias("collections")))


@query(
    "SELECT regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS value, count(*) AS documents FROM pages GROUP BY 1"
)
def lexicon_uri(t: Tables) -> DataFrame:
    return lexicon(page_paths(t), "uri", uri="path")


@query(
    """
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS position,
           (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS batch FROM documents
    """
)
def batch_documents(t: Tables) -> DataFrame:
    return cut_batches(t.documents.select("doc_id"), ["doc_id"])


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey,
           (row_number() OVER (PARTITION BY l_returnflag
                               ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1) // 100 AS batch
    FROM lineitem
    """
)
def batch_by_source(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    batches = cut_batches(t.lineitem.select("l_returnflag", *order), order, by=["l_returnflag"])
    return batches.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "batch")


@query(
    """
    WITH s AS (SELECT doc_id, CASE WHEN source NOT LIKE '%5' THEN source END AS source FROM documents)
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position FROM s
    """
)
def batch_without_source(t: Tables) -> DataFrame:
    """Some documents have no source: they are a source set of their own."""
    source = F.when(~F.col("source").like("%5"), F.col("source"))
    slim = t.documents.select("doc_id", source.alias("source"))
    return cut_batches(slim, ["doc_id"], by=["source"]).select("doc_id", "source", "position")


@query(
    """
    WITH b AS (SELECT (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS batch, strlen(text) AS length FROM documents)
    SELECT batch, count(*) AS documents, round(CAST(sum(length) AS BIGINT) / 1048576, 3) AS mb FROM b GROUP BY batch
    """
)
def batch_summary(t: Tables) -> DataFrame:
    slim = t.documents.select("source", "doc_id", F.octet_length("text").alias("length"))
    return summarise(cut_batches(slim, ["source", "doc_id"]))


@query(
    """
    WITH b AS (SELECT doc_id, (row_number() OVER (ORDER BY source, doc_id) - 1) // 100 AS batch, source FROM documents)
    SELECT batch, count(*) AS documents, min(doc_id) AS first_id, max(doc_id) AS last_id, count(DISTINCT source) AS sources
    FROM b GROUP BY batch
    """
)
def write_batches(t: Tables) -> DataFrame:
    """Written with the bulk sink, read back from the files."""
    path = fresh_path(t.spark, "delivered")
    batches = cut_batches(t.documents.select("source", "doc_id"), ["source", "doc_id"])
    write_documents(batches, path, ["position"])
    return t.spark.read.parquet(path).groupBy("batch").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"),
        F.count_distinct("source").alias("sources"),
    )


@query(
    """
    SELECT '/lang=' || lang || '/source=' || source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
    FROM documents WHERE lang <> 'es' GROUP BY ALL
    """
)
def scan_documents(t: Tables) -> DataFrame:
    """The documents as a tree of text files, walked with a garbage directory."""
    path = fresh_path(t.spark, "tree")
    t.documents.select("text", "lang", "source").write.partitionBy("lang", "source").text(path)
    found = select_paths(scan(t.spark, path), include=["*.txt"], garbage=["lang=es/", "*~"])
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    return found.groupBy(folder.alias("folder")).agg(F.sum("length").alias("bytes"))


@query(
    """
    SELECT CASE WHEN source LIKE '%1' THEN '/.' ELSE '/_' END || source AS folder, sum(strlen(text))::BIGINT AS bytes, count(*) AS files
    FROM documents GROUP BY ALL
    """
)
def scan_hidden(t: Tables) -> DataFrame:
    """A tree whose folders begin with a dot or an underscore: nothing is passed over."""
    path = fresh_path(t.spark, "hidden")
    folder = F.concat(F.when(F.col("source").like("%1"), "/.").otherwise("/_"), "source")
    full = F.concat(F.lit(path), folder, F.lit("/"), F.col("doc_id").cast("string"))
    write_files(t.documents.select(full.alias("full"), F.col("text").cast("binary").alias("content")))
    found = scan(t.spark, path)
    return found.groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")).agg(
        F.sum("length").alias("bytes"), F.count("*").alias("files")
    )


@query("SELECT doc_id // 100 AS batch, doc_id, sha256(text) AS digest FROM documents")
def deliver_contents(t: Tables) -> DataFrame:
    """Batched by path, contents read in the tasks that deliver the batches, and read back."""
    path = fresh_path(t.spark, "contents")
    full = F.concat(F.lit(f"{path}/in/"), F.col("doc_id").cast("string"))
    files = t.documents.select("doc_id", full.alias("full"))
    write_files(t.documents.select(full.alias("full"), F.col("text").cast("binary").alias("content")))
    batches = cut_batches(files, ["doc_id"])
    deliver(batches, _Save(f"{path}/out"), ["position"], full="full")
    back = read_contents(scan(t.spark, f"{path}/out"))
    parts = F.split(F.col("name"), "-")
    return back.select(parts[0].cast("long").alias("batch"), parts[1].cast("long").alias("doc_id"), F.sha2("content", 256).alias("digest"))


class _Save:
    """Writes the documents of a batch as files `batch-id`; doing so again changes nothing."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch: int, rows: list) -> None:
        for row in rows:
            write_file(f"{self.folder}/{batch}-{row.doc_id}", row.content)


@query(
    """
    WITH w AS (SELECT unnest(string_split(text, ' ')) AS nameref FROM documents)
    SELECT nameref, count(*) AS n FROM w GROUP BY nameref
    """
)
def flatten_listing(t: Tables) -> DataFrame:
    """Each document as a listing of its words, taken apart and counted."""
    items = F.transform(F.split("text", " ", -1), lambda w: F.struct(w.alias("nameref")))
    payload = F.to_json(
        F.struct(
            F.struct(F.struct(items.alias("list-item")).alias("list-items")).alias("forest-default-list")
        )
    )
    listings = t.documents.select("doc_id", payload.alias("payload"))
    return listed(listings, "payload", "forest-default-list").groupBy("nameref").agg(F.count("*").alias("n"))


@query(
    """
    SELECT CASE event_type WHEN 'error' THEN 'unknown-suffix' WHEN 'view' THEN 'request' ELSE 'response' END AS entry,
           CASE WHEN event_type = 'view' THEN 'GET' END AS verb,
           CASE WHEN event_type IN ('click', 'purchase') THEN CAST(json_extract(props, '$.k') AS VARCHAR) END AS status,
           count(*) AS n
    FROM events WHERE event_type <> 'signup' GROUP BY ALL
    """
)
def trace_entries(t: Tables) -> DataFrame:
    suffix = (
        F.when(F.col("event_type") == "view", "-request.json")
        .when(F.col("event_type") == "signup", "-params.json")
        .when(F.col("event_type") == "error", "-error.json")
        .otherwise("-response.json")
    )
    body = F.when(
        F.col("event_type") == "view",
        F.to_json(F.struct(F.lit("GET").alias("verb"), F.concat(F.lit("/u/"), "user_id").alias("url"))),
    ).otherwise(F.regexp_replace("props", '"k"', '"status"'))
    files = t.events.select(F.concat(F.format_string("%012d", "event_id"), suffix).alias("file_name"), body.alias("body"))
    good, issue = parse_trace(files)
    none = F.lit(None).cast("string")
    rows = good.select("entry", "verb", "status").unionByName(
        issue.select(F.col("rule").alias("entry"), none.alias("verb"), none.alias("status"))
    )
    return rows.groupBy("entry", "verb", "status").agg(F.count("*").alias("n"))


@query(
    """
    WITH d AS (SELECT '/' || source || '/' || lang || '/' || doc_id || '.txt' AS uri, lang, n_chars FROM documents
               WHERE lang <> 'es' AND source <> 'src7')
    SELECT uri, CASE WHEN n_chars > 800 THEN 'all,' || lang ELSE 'all' END AS collections, n_chars > 800 AS is_override,
           (row_number() OVER (ORDER BY uri) - 1) // 100 AS batch
    FROM d
    """
)
def load_documents(t: Tables) -> DataFrame:
    """A whole load: select, name, give collections, cut into batches."""
    own = F.when(F.col("n_chars") > 800, F.array("lang", F.lit("all")))
    files = document_paths(t).select("path", own.alias("collections"))
    batches = load(files, include=["*.txt"], exclude=["/src7/**"], garbage=["es/"], collections=["all"], base="/data")
    return batches.select("uri", F.array_join(F.sort_array("collections"), ",").alias("collections"), "is_override", "batch")


def _document_tree(t: Tables, name: str) -> str:
    """The documents as files `/lang/source/id.txt`, some of them hidden; returns the root."""
    path = fresh_path(t.spark, name)
    base = F.concat(F.when(F.col("doc_id") % 5 == 0, ".").otherwise(""), F.col("doc_id").cast("string"), F.lit(".txt"))
    full = F.concat(F.lit(f"{path}/"), "lang", F.lit("/"), "source", F.lit("/"), base)
    write_files(t.documents.select(full.alias("full"), F.col("text").cast("binary").alias("content")))
    return path


@query(
    """
    WITH d AS (SELECT lang, source, CAST(strlen(text) AS BIGINT) AS size FROM documents)
    SELECT 'listed' AS what, '' AS folder, count(DISTINCT lang) AS n, CAST(0 AS BIGINT) AS bytes FROM d
    UNION ALL SELECT 'listed', '/' || lang, count(DISTINCT source), 0 FROM d WHERE lang <> 'es' GROUP BY lang
    UNION ALL SELECT 'listed', '/' || lang || '/' || source, count(*), 0 FROM d WHERE lang <> 'es' AND NOT (lang = 'de' AND source LIKE '%1') GROUP BY lang, source
    UNION ALL SELECT 'files', '/' || lang || '/' || source, count(*), CAST(sum(size) AS BIGINT) FROM d
      WHERE lang <> 'es' AND NOT (lang = 'de' AND source LIKE '%1') GROUP BY lang, source
    """
)
def scan_pruned(t: Tables) -> DataFrame:
    """Files by folder, and which folders were listed for them: none that is rejected, and none below one."""
    path = _document_tree(t, "pruned")
    globs = {"include": ["*.txt"], "exclude": ["es/"], "garbage": ["/de/*1/"]}
    files = scan_tree(t.spark, path, page=50, **globs).groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"))
    listed = scan_tree(t.spark, path, page=50, report=True, **globs)
    return listed.select(F.lit("listed").alias("what"), F.col("path").alias("folder"), F.col("entries").alias("n"), F.lit(0).cast("long").alias("bytes")).unionByName(
        files.agg(F.count("*").alias("n"), F.sum("length").alias("bytes")).select(F.lit("files").alias("what"), "folder", "n", "bytes")
    )


@query(
    """
    SELECT '/fr/' || source || '/' || CASE WHEN doc_id % 5 = 0 THEN '.' ELSE '' END || doc_id || '.txt' AS path, CAST(strlen(text) AS BIGINT) AS length
    FROM documents WHERE lang = 'fr'
    """
)
def scan_under(t: Tables) -> DataFrame:
    """A filter on the path narrows the listing to one folder."""
    return scan_tree(t.spark, _document_tree(t, "under")).filter(F.col("path").startswith("/fr/")).select("path", "length")


@query(
    """
    WITH b AS (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 100 AS batch, text FROM documents)
    SELECT source, batch, count(*) AS documents, round(sum(strlen(text) + strlen(source)) / 1048576.0, 3) AS mb,
      CASE WHEN source LIKE '%1' THEN 'first' ELSE 'second' END AS run FROM b GROUP BY source, batch
    """
)
def deliver_ledger(t: Tables) -> DataFrame:
    """Batches by source, some sent by a first run, the rest by a second one: which run sent which, by the ledger."""
    path = fresh_path(t.spark, "delivery")
    content = t.documents.select("source", "doc_id", "text")
    batches = cut_batches(content, ["doc_id"], by=["source"])
    out = f"{path}/out"
    first = deliver_missing(batches.filter("source LIKE '%1'"), _Keep(out), path, ["doc_id"], by=["source"])
    deliver_missing(batches, _Keep(out), path, ["doc_id"], by=["source"])
    source = F.get(F.from_json("source", "array<string>"), F.lit(0))
    run = F.when(F.col("run") == first["run"], "first").otherwise("second")
    return ledger(t.spark, path).select(source.alias("source"), "batch", "documents", "mb", run.alias("run"))


class _Keep:
    """Writes one file per set and batch; doing so again changes nothing."""

    def __init__(self, folder: str):
        self.folder = folder

    def __call__(self, batch: tuple, rows: list) -> None:
        write_file(f"{self.folder}/{batch[0]}-{batch[1]}", "\n".join(str(r.doc_id) for r in rows).encode())
