"""Listing as a data source: the rows of the plain scan, without entering what is rejected."""

import os

from docloom.operators.documents import select_paths
from docloom.sources.documents import scan_documents
from docloom.sources.tree import TreeReader, scan_tree
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith


def _tree(root, *paths):
    for p in paths:
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(b"x" * len(p))
    return str(root)


PATHS = [
    "a.xml", "b.txt", ".hidden", "_odd/in.xml", "docs/one.xml", "docs/two~", "docs/old/three.xml", "docs/old/deep/er/four.xml", "de/x.xml",
    "de/old/y.xml", "src/lib/z.xqy", "src/lib/.git/config", "sp ace/ü[1].xml", "docs2/q.xml",
]

GLOBS = [
    {}, {"include": ["*.xml"]}, {"exclude": ["old/"]}, {"garbage": [".git/", "*~"]}, {"include": ["docs/", "*.xml"]},
    {"include": ["/docs/**"], "exclude": ["/docs/old/deep/"]}, {"exclude": ["/{de,src}/"], "garbage": []}, {"include": ["{docs,old}/"]},
]


def test_same_rows_as_the_plain_scan(spark, rows, tmp_path):
    root = _tree(tmp_path, *PATHS)
    plain = scan_documents(spark, root).cache()
    for n, globs in enumerate(GLOBS):
        want = rows(select_paths(plain, **globs), "base", "path", "full", "name", "length")
        assert rows(scan_tree(spark, root, page=[3, 10_000][n % 2], **globs)) == want, globs


def test_rejected_folders_are_not_entered(spark, rows, tmp_path):
    root = _tree(tmp_path, *PATHS)
    listed = {r.path for r in scan_tree(spark, root, exclude=["old/"], garbage=[".git/"], report=True).collect()}
    assert listed == {"", "/_odd", "/docs", "/de", "/src", "/src/lib", "/sp ace", "/docs2"}
    few = {r.path for r in scan_tree(spark, root, include=["docs/"], report=True).collect()}
    assert few == {"", "/docs"}


def test_a_filter_narrows_the_listing(spark, rows, tmp_path):
    root = _tree(tmp_path, *PATHS)
    found = scan_tree(spark, root)
    below = found.filter("path LIKE '/docs/%' AND length > 0")
    assert {r.path for r in below.collect()} == {"/docs/one.xml", "/docs/old/three.xml", "/docs/old/deep/er/four.xml"}
    assert {r.path for r in found.filter(F.col("path").isin("/de/x.xml", "/nowhere")).collect()} == {"/de/x.xml"}

    def entered(*filters):
        reader = TreeReader({"path": root, "garbage": "[]"})
        assert list(reader.pushFilters(list(filters))) == list(filters)
        return {folder for folder, _ in reader.walk()}

    assert entered(StringStartsWith(("path",), "/docs/o")) == {"", "/docs", "/docs/old", "/docs/old/deep", "/docs/old/deep/er"}
    assert entered(EqualTo(("path",), "/src/lib/z.xqy")) == {"", "/src", "/src/lib"}
    assert entered(In(("path",), ("/de/x.xml", "/docs2/q.xml"))) == {"", "/de", "/docs2"}
    assert entered(StringStartsWith(("path",), "/de"), EqualTo(("path",), "/docs/one.xml")) == {""}
    assert len(entered(EqualTo(("name",), "one.xml"))) == len(entered())


def test_a_large_folder_is_many_pages(spark, tmp_path):
    root = _tree(tmp_path, *[f"big/{n:04d}.txt" for n in range(500)], "small/a", "small/b")
    found = scan_tree(spark, root, page=50)
    assert found.count() == 502 and found.select("path").distinct().count() == 502
    report = {r.path: (r.entries, r.pages) for r in scan_tree(spark, root, page=50, report=True).collect()}
    assert report == {"": (2, 1), "/big": (500, 10), "/small": (2, 1)}
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 10 and max(sizes) < 100


def test_pages_share_tasks(spark, tmp_path):
    root = _tree(tmp_path, *[f"big/{n:04d}.txt" for n in range(600)], *[f"small/{n}.txt" for n in range(5)])
    reader = TreeReader({"path": root, "page": "2", "tasks": "10"})
    tasks = reader.partitions()
    # every page once, in few tasks, each of which lists a folder once
    assert len(tasks) <= 10 and all(len({s.folder for s in t.shares}) == len(t.shares) for t in tasks)
    dealt = sorted((s.folder, p, s.pages) for t in tasks for s in t.shares for p in range(s.first, s.last))
    assert dealt == sorted([("", 0, 1), *[("/big", p, 300) for p in range(300)], *[("/small", p, 3) for p in range(3)]])
    assert len(TreeReader({"path": root, "page": "2", "report": "folders"}).partitions()) == 1
    found = scan_tree(spark, root, page=2)
    assert found.rdd.getNumPartitions() <= 130 and found.count() == found.select("path").distinct().count() == 605


def test_links_end(spark, tmp_path):
    root = _tree(tmp_path, "d/file.txt", "e/other.txt")
    os.symlink(f"{root}/d", f"{root}/d/up")
    os.symlink(f"{root}/e", f"{root}/d/e")
    os.symlink(f"{root}/d", f"{root}/e/d")
    os.symlink(f"{root}/nowhere", f"{root}/gone")
    want = {"/d/file.txt", "/d/e/other.txt", "/e/other.txt", "/e/d/file.txt", "/gone"}
    assert {r.path for r in scan_tree(spark, root).collect()} == want
    assert {r.path for r in scan_documents(spark, root).collect()} == want


def test_an_empty_tree(spark, tmp_path):
    assert scan_tree(spark, str(tmp_path)).count() == 0
    assert [tuple(r) for r in scan_tree(spark, str(tmp_path), report=True).collect()] == [("", 0, 1)]
