import random

import pytest
from pyspark.sql import functions as F

from docloom.operators.batching import batch_documents, batch_summary
from docloom.operators.documents import (
    attach_mime,
    classify_first,
    derive_uri,
    effective_collections,
    index_class,
    route_by_root,
    select_paths,
    with_fallback,
)
from docloom.operators.permissions import explode_permissions, group_permissions
from docloom.sources.documents import flatten_listing, parse_trace, read_trace, scan_documents, single_document
from docloom.sources.sinks import attach_content, deliver, write_documents
from docloom.storage import fresh_path, local_table

PATHS = ["/a.xml", "/b.html", "/x/c.html", "/x/y/d.html", "/x/y/e.xml", "/z/y/f.html", "/z/g~", "/.h/i.html"]


def paths(spark, given=PATHS):
    return spark.createDataFrame([(p,) for p in given], "path string")


@pytest.mark.parametrize(
    "rules, expected",
    [
        ({}, ["/a.xml", "/b.html", "/x/c.html", "/x/y/d.html", "/x/y/e.xml", "/z/y/f.html", "/.h/i.html"]),
        ({"include": ["*.xml"]}, ["/a.xml", "/x/y/e.xml"]),
        ({"exclude": ["y/"]}, ["/a.xml", "/b.html", "/x/c.html", "/.h/i.html"]),
        ({"include": ["x/"]}, ["/a.xml", "/b.html", "/x/c.html"]),
        ({"include": ["x/", "/x/y/"]}, ["/a.xml", "/b.html", "/x/c.html", "/x/y/d.html", "/x/y/e.xml"]),
        ({"include": ["{x,y}/", "*.html"], "exclude": ["d.*"]}, ["/b.html", "/x/c.html"]),
        ({"garbage": ["/x/", "*.xml", ".*/"]}, ["/b.html", "/z/y/f.html", "/z/g~"]),
    ],
)
def test_select_paths(spark, rules, expected):
    got = {r.path for r in select_paths(paths(spark), **rules).collect()}
    assert got == set(expected)


def test_select_is_one_filter_without_shuffle(spark):
    plan = select_paths(paths(spark), include=["x/", "*.html"], exclude=["d.*"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_hook_sees_directories_and_prunes_below(spark):
    seen = []

    def hook(df):
        seen.append(df.columns)
        return df.filter(~(F.col("isdir") & (F.col("name") == "y")) & F.col("is_included"))

    got = {r.path for r in select_paths(paths(spark), include=["*.html"], hook=hook).collect()}
    assert got == {"/b.html", "/x/c.html", "/.h/i.html"}
    assert len(seen) == 2


def test_derive_uri(spark):
    df = spark.createDataFrame([("", "/a", None), ("/u", "", "/f"), ("", "", None), ("/u", "", "")], "uri string, path string, full string")
    good, issue = derive_uri(df, "/base")
    assert {(r.uri, r.full) for r in good.collect()} == {("/a", "/base/a"), ("/u", "/f")}
    assert sorted(r.prop for r in issue.collect()) == ["full", "uri"]


def test_classify(spark):
    df = spark.createDataFrame([(1,), (5,), (9,)], "n int")
    got = classify_first(df, [("big", F.col("n") > 4), ("bigger", F.col("n") > 8)], "small")
    assert [r["class"] for r in got.orderBy("n").collect()] == ["small", "big", "big"]
    got = index_class(spark.createDataFrame([("", None), (None, "/p"), (None, "")], "field string, path string"))
    assert [r["class"] for r in got.collect()] == ["element", "path", "element"]


def test_route(spark):
    good, issue = route_by_root(paths(spark, ["/root/a", "/services/b.xqy", "/transforms", "/readme"]))
    assert [(r.route) for r in good.orderBy("route").collect()] == ["root", "services"]
    assert {(r.entity, r.rule) for r in issue.collect()} == {("/transforms", "not-a-directory"), ("/readme", "unknown-root")}


def test_mime_first_name_wins(spark):
    registry = local_table(spark, {"name": ["b", "a"], "extensions": ["x,y", "y"], "format": ["text", "xml"]})
    good, issue = attach_mime(paths(spark, ["/1.x", "/2.y", "/3.z", "/4"]), registry)
    assert {(r.path, r.stem, r.mime) for r in good.collect()} == {("/1.x", "1", "b"), ("/2.y", "2", "a")}
    assert {(r.entity, r.rule) for r in issue.collect()} == {("/3.z", "unknown-extension"), ("/4", "no-extension")}


def test_effective_collections(spark):
    df = spark.createDataFrame([(1, None), (2, ["b", "a"]), (3, ["a"]), (4, [])], "id int, collections array<string>")
    got = effective_collections(df, F.array(F.lit("a"), F.lit("b"))).orderBy("id").collect()
    assert [(r.collections, r.is_override) for r in got] == [(["a", "b"], False), (["a", "b"], False), (["a"], True), ([], True)]


def test_fallback(spark):
    own = spark.createDataFrame([("e", ["x"]), ("e", None), ("f", None)], "env string, garbage array<string>")
    dflt = spark.createDataFrame([("e", ["d"])], "env string, garbage array<string>")
    got = with_fallback(own, dflt, ["env"], ["garbage"], {"garbage": ["*~"]})
    assert sorted(tuple(r.garbage) for r in got.collect()) == [("*~",), ("d",), ("x",)]


def test_permissions_round(spark):
    df = spark.createDataFrame([(1, {"r": "read, update,read", "s": "fly"})], "id int, p map<string,string>")
    good, issue = explode_permissions(df, "p", "id")
    grouped = group_permissions(good, ["id"]).collect()
    assert [(r.role, r.capabilities) for r in grouped] == [("r", ["read", "read", "update"])]
    assert [(r.prop, r.value) for r in issue.collect()] == [("s", "fly")]


def test_batches_partition_the_input_when_one_value_dominates(spark):
    keys = [7] * 400 + list(range(300))
    random.Random(1).shuffle(keys)
    df = spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int").repartition(5)
    got = batch_documents(df, ["k", "n"], 64).orderBy("k", "n").collect()
    assert [r.position for r in got] == list(range(1, 701))
    assert [r.batch for r in got] == [n // 64 for n in range(700)]


def test_batches_restart_by_source(spark):
    df = spark.createDataFrame([("a" if n % 3 else "b", n) for n in range(250)], "s string, n int")
    got = batch_documents(df, ["n"], 10, by=["s"])
    for s in "ab":
        mine = [r for r in got.filter(F.col("s") == s).orderBy("n").collect()]
        assert [r.batch for r in mine] == [n // 10 for n in range(len(mine))]
    assert batch_documents(df.limit(0), ["n"]).count() == 0


def test_batch_summary(spark):
    df = spark.createDataFrame([(0, 1048576), (0, 524288), (1, 0)], "batch int, length long")
    assert sorted(tuple(r) for r in batch_summary(df).collect()) == [(0, 2, 1.5), (1, 1, 0.0)]


def test_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "out").mkdir()
    for n in range(25):
        (tmp_path / "in" / str(n)).write_text(f"c{n}")
    df = spark.createDataFrame([(n, f"{tmp_path}/in/{n}") for n in range(25)], "n int, full string")
    batches = batch_documents(df, ["n"], 10)
    target = fresh_path(spark, "test")
    write_documents(batches, target, ["position"])
    assert spark.read.parquet(target).count() == 25
    sent = str(tmp_path / "out")

    def send(batch, rows):
        with open(f"{sent}/{batch}", "w") as f:
            f.write(" ".join(str(r.n) for r in rows))

    deliver(batches, send, ["position"])
    assert (tmp_path / "out" / "2").read_text() == "20 21 22 23 24" and len(list((tmp_path / "out").iterdir())) == 3

    def send_contents(batch, rows):
        with open(f"{sent}/{batch}", "wb") as f:
            f.write(b" ".join(r.content for r in rows))

    deliver(batches, send_contents, ["position"], full="full")
    assert (tmp_path / "out" / "2").read_text() == "c20 c21 c22 c23 c24"
    assert attach_content(batches).filter("content = cast('c24' AS binary) AND batch = 2").count() == 1


def test_batches_of_rows_without_source(spark):
    df = spark.createDataFrame([(n, [None, "a", "b"][n % 3]) for n in range(30)], "n int, source string")
    got = batch_documents(df, ["n"], 4, by=["source"]).collect()
    assert len(got) == 30 and sorted(r.position for r in got if r.source is None) == list(range(1, 11))


def test_scan(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x y.txt").write_text("héllo")
    (tmp_path / "z.xml").write_text("<z/>")
    for root in (str(tmp_path), f"file://{tmp_path}/"):
        got = scan_documents(spark, root).collect()
        assert {(r.path, r.name, r.length) for r in got} == {("/a/b/x y.txt", "x y.txt", 6), ("/z.xml", "z.xml", 4)}
    assert scan_documents(spark, str(tmp_path), content=True).filter("path = '/z.xml'").first().content == b"<z/>"
    for hidden in (".x", "_y", "a/.z"):
        (tmp_path / hidden).write_text("h")
    assert {r.path for r in scan_documents(spark, str(tmp_path)).collect()} == {"/a/b/x y.txt", "/z.xml", "/.x", "/_y", "/a/.z"}
    manifest = spark.createDataFrame([("a/.hidden",)], "path string")
    assert scan_documents(spark, "/base", manifest).first().full == "/base/a/.hidden"


def test_single_document(spark):
    good, issue = single_document(paths(spark, ["a/b/c.xml", "/x", "nope"]))
    assert {r.uri for r in good.collect()} == {"/b/c.xml", "/x"}
    assert [r.entity for r in issue.collect()] == ["nope"]


def test_listing(spark):
    payload = '{"host-default-list":{"list-items":{"list-item":[{"nameref":"a","kind":"k"},{"nameref":"b"}]}}}'
    df = spark.createDataFrame([(1, payload), (2, "{}")], "id int, payload string")
    got = flatten_listing(df, "payload", "host-default-list", ("nameref", "kind")).collect()
    assert [tuple(r) for r in got] == [(1, "a", "k"), (1, "b", None)]


def test_trace_folder(spark, tmp_path):
    (tmp_path / "002-response.json").write_text('{\n"status": 201}')
    (tmp_path / "001-request.json").write_text('{"verb": "GET",\n"url": "/x"}')
    (tmp_path / "001-params.json").write_text("{}")
    (tmp_path / "003-odd.json").write_text("{}")
    (tmp_path / "readme.txt").write_text("no")
    good, issue = read_trace(spark, str(tmp_path))
    assert [(r.entry, r.verb, r.url, r.status) for r in good.collect()] == [("request", "GET", "/x", None), ("response", None, None, "201")]
    assert [r.entity for r in issue.collect()] == ["003-odd.json"]
    assert parse_trace(spark.createDataFrame([("a.txt", "")], "file_name string, body string")).good.count() == 0


def test_a_long_registry_is_a_table_as_well(spark):
    assert local_table(spark, {"x": ["a"] * 20_000}).count() == 20_000


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from docloom.storage import shared_dir

    def session(master, named):
        conf = SimpleNamespace(get=lambda key, default: named, set=lambda key, value: None)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))

    assert shared_dir(session("yarn", "hdfs:///shared/")) == "hdfs:///shared"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("yarn", None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(session("local-cluster[2,1,1024]", None))


def test_a_real_session_without_a_folder_gets_one(tmp_path):
    """Only where one process is all there is. Named folders come from the machine's defaults, so these are put aside."""
    import os
    import subprocess
    import sys

    code = (
        "from pyspark.sql import SparkSession\n"
        "from docloom.storage import cut, scratch, shared_dir\n"
        "import os, glob\n"
        "spark = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "with scratch() as made:\n"
        "    assert cut(spark.range(3), 'x').count() == 3 and len(made) == 1\n"
        "assert 'docloom-' in shared_dir(spark) and shared_dir(spark) == shared_dir(spark)\n"
        "assert not os.path.exists(made[0].removeprefix('file:'))\n"
    )
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": os.getcwd()}
    done = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
