"""Whitening against numpy on the same vectors, and its handling of odd rows."""

import math

import numpy as np
import pytest
from docloom.llm import whitening
from docloom.llm.queries import QUERIES
from pyspark.sql import types as T

FOLDER = "/root/testdata/sf0.001"
SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
NEW = ["n", "deviation", "whitened", "explained", "identity_error"]


def _whole(vector):
    return tuple(math.floor(64 * float(c)) + 1_000_000 for c in vector)


def _check(rows, vectors, components):
    """`rows` against the definition: exact whole numbers, eigenpairs of the covariance, an identity."""
    kept = {i: _whole(v) for i, v in vectors}
    fit = np.array(sorted(set(kept.values())), np.int64)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    cov = centred.T @ centred / n
    values = np.linalg.eigvalsh(cov)[::-1]
    assert sorted(i for i, *_ in rows) == sorted(i for i, _ in vectors)
    for i, got_n, deviation, whitened, explained, error in rows:
        x = np.array(kept[i], object)
        assert got_n == n and deviation == sum((n * x - sums.astype(object)) ** 2)
        assert len(whitened) == len(explained) == components
        assert explained == pytest.approx((values[:components] / values.sum()).tolist(), rel=1e-9)
        assert error <= 1e-9
    # the whitened rows of the fit list are uncorrelated with variance one, and their products with the
    # centred vectors are the eigenvectors, up to the sign
    by_x = {kept[i]: np.array(w) for i, _, _, w, _, _ in rows}
    made = np.array([by_x[tuple(x)] for x in fit.tolist()])
    assert np.abs(made.T @ made / n - np.eye(components)).max() < 1e-9
    vectors_ = centred.T @ made / n / np.sqrt(values[:components])
    assert np.abs(vectors_.T @ vectors_ - np.eye(components)).max() < 1e-7
    assert np.abs(cov @ vectors_ - vectors_ * values[:components]).max() < 1e-7 * values[0]


def _rows(df):
    return [(r.vec_id, *[r[c] for c in NEW]) for r in df.collect()]


def _random(n, width, seed=3):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, width)) @ rng.normal(size=(width, width)) * 0.3
    return [(i, v) for i, v in enumerate(mixed.astype(np.float32).tolist())]


@pytest.mark.parametrize("n, width, block", [(300, 6, 7), (300, 20, 64), (40, 3, 1)])
def test_against_numpy(spark, monkeypatch, n, width, block):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", block)
    monkeypatch.setattr(whitening, "TOGETHER", 2)
    vectors = _random(n, width)
    # repeated rows, and different vectors of the same whole numbers, count once in the fit
    vectors += [(n + k, vectors[k % 5][1]) for k in range(30)] + [(2 * n, [c + 1e-6 for c in vectors[7][1]])]
    got = whitening.whiten(spark.createDataFrame(vectors, SCHEMA).repartition(5))
    _check(_rows(got), vectors, min(width, 16))


def test_query(spark):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    by_id = {}
    for r in QUERIES["op11_whitening"](spark, FOLDER).orderBy("vec_id", "component").collect():
        by_id.setdefault(r.vec_id, []).append(r)
    rows = [(i, r[0].n, r[0].deviation, [x.whitened for x in r], [x.explained for x in r], r[0].identity_error) for i, r in by_id.items()]
    assert all([x.component for x in r] == list(range(1, 17)) for r in by_id.values())
    _check(rows, vectors, 16)


def test_odd_rows(spark):
    good = _random(50, 3)
    odd = [
        (100, None), (101, [1.0, None, 2.0]), (102, [1.0, float("nan"), 2.0]), (103, [float("inf"), 0.0, 0.0]), (104, [-float("inf"), 0.0, 0.0]),
        (105, []), (106, [1.0, 2.0]), (None, good[0][1]),
    ]
    df = spark.createDataFrame(good + odd, SCHEMA)
    from pyspark.sql import functions as F

    clash = df.withColumns({c: F.lit("own") for c in [*NEW, "x", "of_x", "index", "values", "at"]})
    got = whitening.whiten(clash)
    assert sorted(got.columns) == sorted(clash.columns)
    rows = got.collect()
    assert sorted((r.vec_id for r in rows), key=str) == sorted([*range(50), None], key=str)
    assert {r.x for r in rows} == {"own"} and {r.n for r in rows} == {len({_whole(v) for _, v in good})}
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None)], SCHEMA)).count() == 0
    # no variance, no components
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.5]), (2, [0.5, 0.5])], SCHEMA)).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(1, 0, [], [], 0.0)] * 2
    # variance in one direction only, exactly
    line = whitening.whiten(spark.createDataFrame([(i, [i / 64, i / 32, 0.0]) for i in range(9)], SCHEMA)).collect()
    assert all(len(r.whitened) == 1 and r.explained == pytest.approx([1.0]) for r in line)
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], SCHEMA)).count() == 2
