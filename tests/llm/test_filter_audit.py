"""The audit of filters against applying them in every order, row by row."""

import math
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from check import compare, oracle_connection
from docloom.llm import filter_audit
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _fails(docs):
    """Per document the set of letters that it fails."""
    out = []
    for i, t, *_ in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": any(i is not None and j is not None and j < i and (u or "") == t for j, u, *_ in docs),
        }
        out.append({f for f, x in own.items() if x})
    return out


def _slow(rows):
    """`rows`: part, failed letters, good, toxic. Every order is applied in full."""
    out, shapley = [], Counter()
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                redundant = sum(f in r[1] for r in own) - len(gone)
                shapley[part, f] += len(gone)
                out.append([part, "".join(order), k + 1, len(left), len(gone), redundant, sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)])
    return sorted((*r, shapley[r[0], r[1][r[2] - 1]]) for r in out)


def _got(df):
    assert df.columns == COLUMNS
    return sorted(map(tuple, df.collect()))


@given(st.integers(1, 7))
@settings(max_examples=7, deadline=None)
def test_paths_are_counted(n):
    forward, backward = filter_audit.path_counts(n)
    for state in range(1 << n):
        size = state.bit_count()
        assert (forward[state], backward[state]) == (math.factorial(size), math.factorial(n - size))


def test_random_failures(spark):
    rng = np.random.default_rng(4)
    rows = [
        (["", "en", "fr"][rng.integers(0, 3)], {f for f in "ABCDE" if rng.random() < 0.4}, bool(rng.random() < 0.5), bool(rng.random() < 0.1))
        for _ in range(120)
    ]
    df = spark.createDataFrame(
        [(p, *[None if f not in s and k % 2 else f in s for f in "ABCDE"], g, t or None) for k, (p, s, g, t) in enumerate(rows)],
        "part string, A boolean, B boolean, C boolean, D boolean, E boolean, good boolean, toxic boolean",
    )
    assert _got(filter_audit.audit(df, list("ABCDE"), "part", ["good", "toxic"])) == _slow(rows)
    none = filter_audit.audit(df.filter("false"), list("ABCDE"), "part", ["good", "toxic"])
    assert none.count() == 0
    two = filter_audit.audit(df, ["A", "E"], "part", []).collect()
    assert len(two) == 2 * 2 * 3 and {r.filter_order for r in two} == {"AE", "EA"}
    with pytest.raises(ValueError):
        filter_audit.audit(df, [], "part", [])


def test_documents_with_odd_rows(spark, documents, odd_texts):
    long = " ".join(f"word{k}" for k in range(250))
    few = " ".join(f"word{k % 90}" for k in range(250))
    texts = [
        *odd_texts, (20, long), (21, long), (21, long), (22, long + " #"), (23, few), (24, few.upper()), (25, long + " |"), (None, long), (26, ""),
        (27, " ".join(f"w{k % 100}" for k in range(200))), (28, "A" * 3 + "b" * 97), (29, "A" * 4 + "b" * 96), (30, "a b " * 150), (31, "x\x0b" * 200),
    ]
    docs = documents(texts, clash=True).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "en").when(F.col("doc_id") % 3 == 1, ""))
    marks = [(1, 1, 0), (1, 0, 1), (20, 1, None), (21, None, 1), (21, 1, 0), (None, 1, 1), (7, 0, 1), (99, 1, 1)]
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    rows = [
        ("en" if i is not None and i % 3 == 0 else "", fails, any(d == i and q == 1 for d, q, _ in marks if d is not None), any(d == i and x == 1 for d, _, x in marks if d is not None))
        for (i, _), fails in zip(texts, _fails(texts))
    ]
    got = filter_audit.audit_documents(docs, labels)
    assert sorted(map(tuple, got.select(*COLUMNS).collect())) == _slow(rows)
    assert filter_audit.audit_documents(documents([]), labels).count() == 0


def test_query_against_sql_and_brute_force(spark):
    assert compare(spark, oracle_connection(FOLDER), "op13_filter_audit", FOLDER) == ""
    from docloom.llm.queries import QUERIES

    docs = [(r.doc_id, r.text, r.lang or "") for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    marks = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    rows = [(p, fails, i in marks and marks[i].quality == 1, i in marks and marks[i].toxic == 1) for (i, _, p), fails in zip(docs, _fails(docs))]
    got = QUERIES["op13_filter_audit"](spark, FOLDER)
    assert _got(got.select(*COLUMNS)) == _slow(rows)
