"""Removal of repeated byte strings, its suffix order and its common prefixes, against brute force."""

import hashlib

import numpy as np
import pytest
from check import compare, oracle_connection
from docloom.llm import suffix_dedup
from hypothesis import given, settings
from hypothesis import strategies as st

FOLDER = "/root/testdata/sf0.001"


def _slow(rows, least):
    """Per row its spans, from all windows of all rows."""
    smallest = {}
    for i, t in rows:
        data = (t or "").encode()
        for k in range(len(data) - least + 1):
            if i is not None:
                smallest[data[k : k + least]] = min(i, smallest.get(data[k : k + least], i))
    out = []
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data) + 2, bool)
        for k in range(len(data) - least + 1):
            if i is not None and smallest[data[k : k + least]] < i:
                gone[k + 1 : k + least + 1] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2)
        out.append((i, len(data), tuple(map(tuple, edges.tolist())), bytes(b for k, b in enumerate(data) if not gone[k + 1])))
    return sorted(out, key=str)


def _got(df, **options):
    made = suffix_dedup.dedup_substrings(df, **options)
    assert made.columns == ["doc_id", "n_bytes", "spans", "kept"]
    return sorted(((r.doc_id, r.n_bytes, tuple((s.start, s.stop) for s in r.spans), bytes(r.kept)) for r in made.collect()), key=str)


@given(st.lists(st.text(alphabet="ab\0", max_size=30).map(str.encode), min_size=1, max_size=6, unique=True), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_suffixes_and_bounds(texts, least):
    joined = np.concatenate([np.append(np.frombuffer(t, np.uint8).astype(np.uint16) + 1, 0) for t in texts]).astype(np.uint16)
    own = [(k, o) for k, t in enumerate(texts) for o in range(len(t) + 1)]
    # a separator is less than all bytes, and an earlier one less than a later one
    key = lambda p: [(1, b) for b in texts[own[p][0]][own[p][1] :]] + [(0, own[p][0])]
    rows = sorted(range(len(own)), key=key)
    order, rank = suffix_dedup.suffix_order(joined)
    assert order.tolist() == rows and [rows[r] for r in rank.tolist()] == list(range(len(own)))
    suffixes = [texts[own[p][0]][own[p][1] :] for p in rows]
    share = [True] + [len(a) < least or a[:least] != b[:least] for a, b in zip(suffixes, suffixes[1:])]
    assert suffix_dedup.prefix_bounds(joined, order, rank, least).tolist() == share


def _texts(rng, n):
    """Texts that share passages of all lengths, whole copies, near copies and periodic parts among them."""
    word = lambda: "".join(rng.choice(list("abcdeé "), rng.integers(1, 7)))
    shared = [" ".join(word() for _ in range(rng.integers(3, 60))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.integers(0, 6)):
            kind = rng.integers(0, 4)
            if kind == 0:
                parts.append(" ".join(word() for _ in range(rng.integers(1, 40))))
            elif kind == 1:
                p = shared[rng.integers(0, len(shared))]
                a = rng.integers(0, max(1, len(p) // 2))
                parts.append(p[a : a + rng.integers(1, len(p) + 1)])
            elif kind == 2:
                parts.append("-" * rng.integers(1, 150))
            else:
                parts.append(str(rng.choice(texts)) if texts else "")
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize(
    "least, options",
    [(50, {"pack": 700, "part": 64, "bucket": 500}), (50, {"pack": 900, "bucket": 800, "hot": 2}), (12, {}), (3, {"hot": 3})],
)
def test_same_bytes_go_as_by_brute_force(spark, documents, least, options):
    rng = np.random.default_rng(least)
    texts = _texts(rng, 70)
    ids = rng.permutation(len(texts)).tolist()
    rows = list(zip(ids, texts)) + [(3, texts[5]), (None, texts[5]), (None, "x" * 200), (200, "x" * 200), (201, "x" * 200), (201, "x" * 200), (202, None)]
    assert _got(documents(rows), least=least, **options) == _slow(rows, least)


def test_long_texts_over_blocks_and_windows(spark, documents, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1 << 10)
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdef"), 9_000))
    rows = [(5, long), (7, "start " + long[300:8_000] + " end"), (2, long[4_000:4_049]), (9, long[4_000:4_050] * 3), (1, "y" * 6_000), (4, "y" * 3_000 + "z")]
    assert _got(documents(rows)) == _slow(rows, 50)


def test_odd_rows(spark, documents, odd_texts):
    short = [(i, t) for i, t in odd_texts if t is None or len(t) < 1_000]
    assert _got(documents(short, clash=True)) == _slow(short, 50)
    assert _got(documents([])) == []
    assert len(_got(documents(odd_texts))) == len(odd_texts)


def test_query_against_brute_force_and_sql(spark):
    from docloom.llm.queries import QUERIES

    got = QUERIES["op12_suffix_dedup"](spark, FOLDER).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    want = [(i, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in _slow(docs, 50)]
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
    assert sum(w[2] for w in want) > 0
    assert compare(spark, oracle_connection(FOLDER), "op12_suffix_dedup", FOLDER) == ""
