import re

import pytest
from pyspark.sql import functions as F

from docloom.functions import comparators as cmp
from docloom.functions.paths import GlobList, ancestors, expand_braces, extension, parent_path, stem
from docloom.functions.values import (
    merge_permissions,
    pad_name,
    split_list,
    strict_boolean,
    strict_integer,
)


def values(spark, column, inputs, schema="x string"):
    df = spark.createDataFrame([(i,) for i in inputs], schema)
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


def test_split_list_keeps_ends_and_repeats(spark):
    assert values(spark, split_list, ["a , b,b", "", " a", "x,"]) == [["a", "b", "b"], [""], [" a"], ["x", ""]]


def test_strict_boolean(spark):
    assert values(spark, strict_boolean, ["true", "false", "yes", "TRUE", "1", None]) == [True, False, None, None, None, None]


def test_strict_integer(spark):
    given = ["12", "-1", "1.0", "12\n", "", "99999999999999999999", "007"]
    assert values(spark, strict_integer, given) == [12, None, None, None, None, None, 7]


def test_strict_integer_numbers(spark):
    got = values(spark, lambda c: strict_integer(c, F.lit(True)), ["-3", "4.0", "4.5", "x"])
    assert got == [-3, 4, None, None]


def test_pad_name(spark):
    got = spark.range(1).select(pad_name(F.lit("db"), F.lit(1), F.lit(1234))).first()[0]
    assert got == "db-001-1234"


@pytest.mark.parametrize(
    "base, derived, expected",
    [
        ({}, {}, {}),
        ({"ape": "read"}, {"bear": "read"}, {"ape": "read", "bear": "read"}),
        ({"ape": "read", "bear": "read"}, {"bear": "update"}, {"ape": "read", "bear": "update"}),
        ({"ape": "read"}, {"ape": ""}, {"ape": "read"}),
        ({}, {"ape": ""}, {"ape": ""}),
        (None, {"ape": "read"}, {"ape": "read"}),
    ],
)
def test_merge_permissions(spark, base, derived, expected):
    df = spark.createDataFrame([(base, derived)], "b map<string,string>, d map<string,string>")
    assert df.select(merge_permissions(F.col("d"), F.col("b"))).first()[0] == expected


@pytest.mark.parametrize(
    "left, right, same",
    [
        (None, [], True),
        (["a", "b"], ["b", "a"], True),
        (["a", "a", "b"], ["a", "b", "b"], True),
        (["a"], ["a", "a"], False),
        (["a", "c"], ["a", "b"], False),
    ],
)
def test_eq_list(spark, left, right, same):
    df = spark.createDataFrame([(left, right)], "l array<string>, r array<string>")
    assert df.select(cmp.eq_list(F.col("l"), F.col("r"))).first()[0] is same


def test_eq_struct_list_map_and_default(spark):
    df = spark.createDataFrame(
        [([("a", "1")], [("a", "1")], {"x": "1", "y": "2"}, {"y": "2", "x": "1"}, None)],
        "l array<struct<n:string,v:string>>, r array<struct<n:string,v:string>>, m map<string,string>, k map<string,string>, c string",
    )
    row = df.select(
        cmp.eq_struct_list(F.col("l"), F.col("r")),
        cmp.eq_map(F.col("m"), F.col("k")),
        cmp.eq_map(F.col("m"), F.lit(None).cast("map<string,string>")),
        cmp.eq_default(F.lit("d"), F.col("c"), "d"),
        cmp.eq_default(F.lit("e"), F.col("c"), "d"),
    ).first()
    assert tuple(row) == (True, True, False, True, False)


def test_eq_perms_missing_is_not_empty(spark):
    type = "array<struct<role:string,capability:string>>"
    df = spark.createDataFrame([(None, [], None)], f"a {type}, b {type}, c {type}")
    row = df.select(
        cmp.eq_perms(F.col("a"), F.col("c")), cmp.eq_perms(F.col("a"), F.col("b")), cmp.eq_privileges(F.col("b"), F.col("b"))
    ).first()
    assert tuple(row) == (True, False, True)


def test_eq_ordered(spark):
    type = "array<struct<name:string,host:string>>"
    df = spark.createDataFrame([([("b", ""), ("a", "h")], [("a", "h"), ("b", None)], [("b", None), ("a", "h")])], f"d {type}, a {type}, w {type}")
    row = df.select(
        cmp.eq_ordered(F.col("d"), F.col("a"), ["name", "host"], "name"),
        cmp.eq_ordered(F.col("d"), F.col("w"), ["name", "host"], "name"),
    ).first()
    assert tuple(row) == (True, False)


def test_paths(spark):
    df = spark.createDataFrame([("/a/b/c.tar.gz",), ("/c",), ("/a/.b",)], "p string")
    got = [tuple(r) for r in df.select(stem(F.col("p")), extension(F.col("p")), parent_path(F.col("p")), ancestors(F.col("p"))).collect()]
    assert got == [("c.tar", "gz", "/a/b", ["/a", "/a/b"]), (None, None, "", []), ("", "b", "/a", ["/a"])]


@pytest.mark.parametrize(
    "glob, expected",
    [
        ("a{b,c}d", ["abd", "acd"]),
        ("{a,b{1..3}}", ["a", "b1", "b2", "b3"]),
        ("{a}", ["{a}"]),
        ("{a,b}/{c,d}", ["a/c", "a/d", "b/c", "b/d"]),
        (r"\{a,b}", [r"\{a,b}"]),
    ],
)
def test_expand_braces(glob, expected):
    assert expand_braces(glob) == expected


@pytest.mark.parametrize(
    "glob, hits, misses",
    [
        ("*.html", ["/a.html", "/x/.b.html", "/.html"], ["/a.htm", "/a.html/b"]),
        ("*~", ["/a/b~", "/~"], ["/a~/b"]),
        ("/a/*.x", ["/a/b.x"], ["/b.x", "/a/b/c.x"]),
        ("/a/**", ["/a/b", "/a/b/c"], ["/a", "/b/a/c"]),
        ("**/z.x", ["/z.x", "/a/b/z.x"], ["/az.x"]),
        ("/a/**/z", ["/a/z", "/a/b/c/z"], ["/a/bz"]),
        ("[a-c]?.x", ["/ab.x", "/q/cc.x"], ["/d1.x", "/a.x"]),
        ("[!a].x", ["/b.x"], ["/a.x"]),
        ("$$$", ["/$$$"], ["/$$"]),
        ("#x.{xqy,sjs}", ["/#x.xqy", "/#x.sjs"], ["/x.xqy"]),
        ("*.x", ["/é.x"], ["/a.xx"]),
    ],
)
def test_globs(spark, glob, hits, misses):
    paths = hits + misses
    got = values(spark, GlobList([glob]).matches_file, paths)
    assert got == [True] * len(hits) + [False] * len(misses)


@pytest.mark.parametrize("glob", ["!a", "a/@(b|c)", "+(x)"])
def test_unsupported_globs(glob):
    with pytest.raises(ValueError, match=re.escape(glob)):
        GlobList([glob])


@pytest.mark.parametrize("low, high", [(0, 9), (0, 150), (7, 123), (99, 1001), (100, 4321), (1234, 1234)])
def test_number_ranges_as_one_pattern(low, high):
    import re

    from docloom.functions.paths import number_regex

    pattern = re.compile(number_regex(low, high))
    assert [n for n in range(6000) if pattern.fullmatch(str(n))] == list(range(low, high + 1))
    assert not pattern.fullmatch("007")


def test_brace_ranges(spark):
    assert expand_braces("{01..03}") == ["01", "02", "03"]
    assert expand_braces("{a..c}x") == ["ax", "bx", "cx"]
    assert expand_braces("{0..6..2}") == ["0", "2", "4", "6"] and expand_braces("{3..1}") == ["3", "2", "1"]
    df = spark.createDataFrame([("/p1.x",), ("/p999999.x",), ("/p1000001.x",), ("/p01.x",)], "path string")
    globs = GlobList(["p{1..1000000}.x"])
    assert [r.path for r in df.filter(globs.matches_file(df.path)).collect()] == ["/p1.x", "/p999999.x"]
