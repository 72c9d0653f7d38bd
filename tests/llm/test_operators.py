"""The training-data operators on small cases, each against a brute-force version or an exact property."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
import xxhash
from docloom.llm import bpe, chat, decontaminate, labels, line_dedup, quality, resharding, secret_scan, simhash, toxicity, winnowing
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = st.lists(
    st.sampled_from(list("abe thE'sreS 12.,!\n\t é日😀#\\<>/turn:") + ["<|endoftext|>", "###", "</turn>"]), max_size=60
).map("".join)


# 1 BPE


@pytest.fixture(scope="module")
def tokenizers():
    theirs = Tokenizer.from_file(PATH)
    theirs.no_truncation()
    theirs.no_padding()
    with open(PATH, encoding="utf-8") as f:
        return bpe.Tokenizer(f.read()), theirs


@given(TEXTS)
@settings(max_examples=200, deadline=None)
def test_ids_are_those_of_the_library(tokenizers, text):
    ours, theirs = tokenizers
    packed = ours.encode(text)
    ids = theirs.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packed, "<u4").tolist() == ids
    assert ours.decode(packed) == theirs.decode(ids, skip_special_tokens=False) == text


def test_every_character_class_and_long_words(tokenizers):
    ours, theirs = tokenizers
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x1F600, 0x1F640))
    for text in ["".join(f"a{chr(c)} {chr(c)}b" for c in points), "the" * 900, " " * 700, "é" * 700]:
        assert np.frombuffer(ours.encode(text), "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


@given(st.text(alphabet="abcd", min_size=1, max_size=40), st.dictionaries(st.tuples(st.sampled_from("abcd"), st.sampled_from("abcd")), st.integers(0, 9), max_size=8))
def test_heap_and_scan_merge_alike(word, ranked):
    parts = [ord(c) for c in word]
    pairs = {(ord(a), ord(b)): rank << 32 | (1000 + i) for i, ((a, b), rank) in enumerate(sorted(ranked.items()))}
    # one rank per pair, as in a vocabulary
    pairs = {p: (i << 32) | (v & 0xFFFFFFFF) for i, (p, v) in enumerate(sorted(pairs.items(), key=lambda x: x[1]))}
    assert bpe.merge_scan(list(parts), pairs) == bpe.merge_heap(list(parts), pairs)


def test_encode_odd_rows(spark, documents, odd_texts):
    df = documents(odd_texts, clash=True)
    coded = bpe.encode(df, PATH, decoded="decoded")
    rows = coded.collect()
    assert len(rows) == len(odd_texts) and Counter(coded.columns) == Counter([*df.columns, "decoded"])
    assert Counter((r.doc_id, r.decoded) for r in rows) == Counter((i, t or "") for i, t in odd_texts)
    again = bpe.decode(coded.select("doc_id", "ids"), PATH).collect()
    assert Counter((r.doc_id, r.text) for r in again) == Counter((i, t or "") for i, t in odd_texts)
    assert bpe.encode(documents([]), PATH).count() == 0


# 2 quality


def _shouting(n):
    clean = [(i, f"The quiet river number {i} runs past the mill and the old bridge.") for i in range(n)]
    loud = [(n + i, f"BUY!! NOW!! {i}!! CHEAP!! DEAL!! BUY!! NOW!!") for i in range(n)]
    return clean + loud


def test_quality_learns_and_is_calibrated(spark, documents):
    rows = _shouting(150)
    docs = documents(rows)
    marks = spark.createDataFrame([(i, int(i < 150), 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    apart = labels.remainder(F.col("doc_id"), 4) == 2
    scored = quality.score(docs, quality.fit(docs, marks, ~apart)).filter(apart).collect()
    assert len(scored) > 40 and all((r.score >= quality.THRESHOLD) == (r.doc_id < 150) for r in scored)


def test_quality_odd_rows(spark, documents, odd_texts):
    docs = documents(odd_texts, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    network = quality.fit(docs, none, F.lit(True))
    scored = quality.score(docs, network)
    assert sorted(scored.columns) == sorted(docs.columns)
    assert [r.score for r in scored.collect()] == pytest.approx([0.5] * len(odd_texts))
    one = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 1, 0), (4, 1, 0), (4, 1, 0)], "doc_id long, quality int, toxic int")
    assert all(0.9 < r.score <= 1 for r in quality.score(docs, quality.fit(docs, one, F.lit(True))).collect())
    assert quality.score(documents([]), quality.fit(documents([]), none, F.lit(True))).count() == 0


def test_context_vectors_do_not_cross_documents(spark, documents):
    both = quality.context_counts(documents([(1, "alpha beta"), (2, "gamma delta")]))
    alone = quality.context_counts(documents([(1, "alpha beta")]))
    other = quality.context_counts(documents([(2, "gamma delta")]))
    assert np.array_equal(both[0], alone[0] + other[0]) and both[1].sum() == 4


def test_sample_is_bounded(spark, documents):
    docs = documents(_shouting(30))
    marks = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    assert labels.labelled_texts(docs, marks, "doc_id", "text", "quality", F.lit(True), 10).count() == 10


def test_sample_has_one_row_per_id(spark, documents):
    docs = documents([(1, f"text {k % 300}") for k in range(1000)] + [(2, "two"), (2, "two"), (3, "three"), (None, "none")])
    marks = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    every = labels.labelled_texts(docs, marks, "doc_id", "text", "quality", F.lit(True)).collect()
    assert sorted((r.id, r.label) for r in every) == [(1, 1), (2, 0), (3, 1)]
    assert labels.labelled_texts(docs, marks, "doc_id", "text", "quality", F.lit(True), 2).count() == 2
    again = labels.labelled_texts(docs.repartition(7), marks, "doc_id", "text", "quality", F.lit(True)).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, every))


def test_word_vectors_against_counting_by_hand(spark, documents):
    texts = ["the Quick fox, the fox", "", "one", "fox FOX 9 the a b c the", None]
    context, seen = quality.context_counts(documents(list(enumerate(texts))).repartition(3))
    places, signs = quality._index()
    want, times = np.zeros_like(context), np.zeros_like(seen)
    for text in texts:
        ids = [zlib.crc32(w.lower().encode()) % quality.WORD_BUCKETS for w in (text or "").split()]
        for i, a in enumerate(ids):
            times[a] += 1
            for j, b in enumerate(ids):
                if 0 < abs(i - j) <= quality.NEAR:
                    for k in range(quality.PLACES):
                        want[a, places[k][b]] += signs[k][b]
    assert np.array_equal(context, want) and np.array_equal(seen, times)
    # vectors of length one, less their mean over all tokens, then weighted
    share = times / times.sum()
    unit = np.array([v / n if (n := np.linalg.norm(v)) > 1e-9 else v for v in want])
    centred = unit - sum(share[b] * unit[b] for b in np.flatnonzero(times))
    for b in np.flatnonzero(times).tolist():
        assert quality.word_vectors(context, seen)[b] == pytest.approx(centred[b] * 1e-3 / (1e-3 + share[b]), rel=1e-5, abs=1e-9)


def test_features_against_pooling_by_hand():
    vectors = np.random.default_rng(0).normal(size=(quality.WORD_BUCKETS, quality.DIM)).astype(np.float32)
    shapes = quality.shape_vectors()
    text = "The cat, 42 cat\nCAT cat"
    row = quality.Features(vectors)([text, ""])[0]
    tokens = text.split()
    words = [zlib.crc32(t.lower().encode()) % quality.WORD_BUCKETS for t in tokens]
    kinds = ["Aa", "a,", "9", "a", "A", "a"]
    marks = [zlib.crc32(k.encode()) % quality.SHAPE_BUCKETS for k in kinds]
    assert row[: quality.DIM] == pytest.approx(vectors[words].mean(0), abs=1e-5)
    assert row[quality.DIM : 2 * quality.DIM] == pytest.approx(shapes[marks].mean(0), abs=1e-5)
    assert row[2 * quality.DIM :] == pytest.approx([np.log1p(6), 5 / 6, len(text) / 6, 1 / 6], abs=1e-5)
    assert not quality.Features(vectors)([""]).any()


def test_temperature_is_the_best_of_the_grid():
    rng = np.random.default_rng(1)
    logits = rng.normal(0, 3, 400)
    y = (rng.random(400) < 1 / (1 + np.exp(-logits / 2.5))).astype(float)
    got = quality.fit_temperature(logits, y)
    loss = lambda t: -np.mean(np.log(np.where(y == 1, 1 / (1 + np.exp(-logits / t)), 1 - 1 / (1 + np.exp(-logits / t)))))
    fine = np.linspace(0.25, 8, 3000)
    best = fine[int(np.argmin([loss(t) for t in fine]))]
    assert got == pytest.approx(best, rel=0.06) and loss(got) <= loss(1.0)


def test_gradients_of_the_network_reach_a_separating_line():
    rng = np.random.default_rng(2)
    z = rng.normal(size=(600, 5))
    y = (z[:, 0] - z[:, 3] > 0).astype(float)
    layers = quality.train(z, y)
    assert (((quality._logits(z, layers) > 0) == (y == 1)).mean()) > 0.97


# 3 winnowing


def _slow_winnow(text, k, window):
    points = np.array([ord(c) for c in text], "<u4")
    if not len(points):
        return [], []
    gram = min(k, len(points))
    keys = [int(winnowing._hashes(points[i : i + gram], gram)[0]) >> winnowing._BLOCK_BITS for i in range(len(points) - gram + 1)]
    chosen = set()
    for a in range(max(1, len(keys) - window + 1)):
        part = keys[a : a + window]
        chosen.add(a + max(i for i, h in enumerate(part) if h == min(part)))
    return [keys[i] for i in sorted(chosen)], sorted(chosen)


@given(st.text(alphabet="ab é", max_size=80), st.integers(1, 9), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_windows_choose_the_rightmost_least(text, k, window):
    hashes, at = winnowing.select(winnowing.code_points(text), k, window)
    assert (hashes.tolist(), at.tolist()) == _slow_winnow(text, k, window)


def test_texts_over_many_blocks(monkeypatch):
    monkeypatch.setattr(winnowing, "_BLOCK_BITS", 7)
    text = "".join(chr(97 + (i * i * 7 + i // 3) % 26) for i in range(1500))
    hashes, at = winnowing.select(winnowing.code_points(text))
    assert (hashes.tolist(), at.tolist()) == _slow_winnow(text, winnowing.K, winnowing.WINDOW)


def test_shared_run_is_found():
    run = "a passage that both of these two texts hold, word for word, at other places"
    a, b = winnowing.select(winnowing.code_points("start " + run + " end")), winnowing.select(winnowing.code_points("else, 123 " + run))
    assert set(a[0].tolist()) & set(b[0].tolist())


def _edited(pairs):
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""), reverse=True)
    out = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        out[i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()] += 1
    return out


def _likenesses(pairs):
    """By sets of chosen hashes, from all windows."""
    hashes = lambda t: set(_slow_winnow(t, winnowing.K, winnowing.WINDOW)[0]) if len(t) < 5000 else set(winnowing.select(winnowing.code_points(t))[0].tolist())
    like = lambda a, b: len(a & b) / len(a | b) if a and b else float(bool(a) == bool(b))
    order = sorted(pairs, key=lambda p: (p[0] is not None, p[0] or 0, p[1] or ""), reverse=True)
    out = Counter()
    for (i, t), (_, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        half = len(t) // 2
        own = hashes(t)
        out[i, len(t), round(like(own, hashes(t[: len(t) - half] + n[:half])), 9), round(like(own, hashes(n)), 9)] += 1
    return out


def test_edited_texts(spark, documents, odd_texts):
    for pairs in (odd_texts, [(1, "alone here")], [(i, f"text {i} " * i) for i in range(40)]):
        got = winnowing.with_next(documents(pairs, clash=True)).collect()
        assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == _edited(pairs)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
        assert Counter((r.doc_id, r.n_chars, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == _likenesses(pairs)
    assert winnowing.with_next(documents([])).count() == 0
    prints = winnowing.fingerprints(documents(odd_texts, clash=True)).filter("doc_id = 8").select("hashes", "positions").collect()
    assert prints[0] == prints[1]


# 4 resharding


def _least_moves(supply, capacity):
    return sum(supply) - sum(min(s, c) for s, c in zip(supply, capacity))


@given(st.lists(st.integers(0, 30), min_size=1, max_size=5), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_flow_moves_the_fewest_bytes(supply, shards):
    capacity = resharding.even_capacities(sum(supply), shards)
    flow = resharding.solve_flow(supply, capacity)
    for i, s in enumerate(supply):
        assert sum(v for (a, _), v in flow.items() if a == i) == s
    for j, c in enumerate(capacity):
        assert sum(v for (_, b), v in flow.items() if b == j) <= c
    assert sum(v for (a, b), v in flow.items() if a != b) == _least_moves(supply, capacity)


def test_flow_by_cost_takes_the_cheaper_way_round():
    cost = [[1, 4], [0, 9]]
    flow = resharding.solve_flow([2, 2], [2, 2], lambda i, j: cost[i][j])
    assert sum(v * cost[i][j] for (i, j), v in flow.items()) == 8


def test_resharding_files_and_slots(spark, documents, odd_texts):
    pairs = odd_texts + [(100 + i, "t" * (i % 50)) for i in range(400)]
    docs = documents(pairs, clash=True)
    size, by = F.octet_length(F.coalesce("text", F.lit(""))) + 1, [F.col("doc_id"), F.col("text")]
    old = F.when(F.coalesce("doc_id", F.lit(0)) < 300, 0).otherwise(1)
    planned = resharding.plan(docs, old, size, 3, by, 64)
    moved = resharding.reshard(docs, planned, old, by, 64)
    rows = resharding.with_slots(moved, order=["doc_id", "text"]).collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(pairs)
    for shard in {r.shard for r in rows}:
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots)))
    # a shard whose capacity is its size stays where it is
    same = resharding.plan(docs, F.lit(0), size, 1, by, 64)
    assert resharding.touched(same) == set()
    assert resharding.reshard(docs, same, F.lit(0), by, 64).count() == len(pairs)
    # only blocks that move are in new files
    assigned = resharding.assign(docs, planned, old, by, 64)
    files = spark.read.parquet(resharding.rewrite(assigned))
    assert files.count() == assigned.filter("shard <> old_shard").count() < len(pairs)
    empty = documents([])
    nothing = resharding.plan(empty, old, size, 3, by, 64)
    assert resharding.with_slots(resharding.reshard(empty, nothing, old, by, 64), order=["doc_id"]).count() == 0


def test_shards_are_even_and_few_bytes_move(spark, documents):
    rng = np.random.default_rng(3)
    docs = documents([(i, "x" * int(n)) for i, n in enumerate(rng.integers(0, 400, 3000))])
    size, by = F.octet_length("text") + 1, [F.col("doc_id")]
    old = F.pmod(F.hash("doc_id"), F.lit(6))
    planned = resharding.plan(docs, old, size, 8, by, 256)
    supply = Counter()
    for (i, _), n in planned.sizes.items():
        supply[i] += n
    total = sum(supply.values())
    capacity = resharding.even_capacities(total, 8)
    least = _least_moves([supply[i] for i in range(6)] + [0, 0], capacity)
    assert least <= resharding.moved_bytes(planned) <= 1.02 * least
    rows = resharding.reshard(docs, planned, old, by, 256).groupBy("shard").agg(F.sum(size).alias("bytes")).collect()
    assert len(rows) == 8 and all(abs(r.bytes - total / 8) <= 0.01 * total / 8 for r in rows)


def test_rows_without_a_shard_and_names_that_clash(spark, documents):
    docs = documents([(i, f"text {i}") for i in range(200)]).withColumns({c: F.lit(f"own {c}") for c in ("place", "offset", "count", "slot", "o_shard", "block")})
    old = F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3 - 1)
    size, by = F.octet_length("text"), [F.col("doc_id")]
    planned = resharding.plan(docs, old, size, 4, by, 64)
    moved = resharding.reshard(docs, planned, old, by, 64)
    assert moved.count() == 200 and moved.filter("shard IS NULL").count() == 0
    rows = resharding.with_slots(moved, order=["doc_id"]).collect()
    assert {(r.place, r.offset, r["count"], r.o_shard) for r in rows} == {("own place", "own offset", "own count", "own o_shard")}
    for shard in range(4):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and slots
    assert resharding.plan(docs, F.lit(None), size, 4, by, 64).flow.keys() == {(resharding.NOWHERE, j) for j in range(4)}


def test_equal_texts_stay_together_unless_they_are_too_many(spark, documents):
    docs = documents([(i, f"text {i // 4}") for i in range(2000)] + [(5000 + i, "the same") for i in range(1000)])
    size = F.octet_length("text") + 1
    by = resharding.group_key(docs, F.col("text"), size, F.col("doc_id"))
    assert len(by) == 2 and len(resharding.group_key(docs.filter("doc_id < 2000"), F.col("text"), size, F.col("doc_id"))) == 1
    old = F.pmod(F.hash(*by), F.lit(2))
    planned = resharding.plan(docs, old, size, 4, by, 512)
    at = resharding.reshard(docs, planned, old, by, 512).groupBy("text").agg(F.count_distinct("shard").alias("n")).collect()
    assert {r.n for r in at if r.text != "the same"} == {1} and {r.n for r in at if r.text == "the same"} == {4}


# 5 decontamination


def _slow_overlaps(docs, items):
    """All alignments of all windows, word by word, whatever a mask would find: the best of each pair."""
    words = lambda t: [w for w in re.split(r"[^\w]|_", (t or "").lower()) if w]
    found = {}
    split = [(k, words(x)) for k, x in items]
    for i, t in docs:
        d = words(t)
        for k, w in split:
            size = min(len(w), 13)
            least = -(-size * 8 // 10)
            for start in range(-len(w) + 1, len(d)) if set(d) & set(w) else []:
                equal = [0 <= start + p < len(d) and d[start + p] == w[p] for p in range(len(w))]
                for s in range(len(w) - size + 1):
                    n = sum(equal[s : s + size])
                    if n >= least and start + s < len(d):
                        found[i, k] = max(found.get((i, k), (0,)), (n, size, -max(start + s, 0)))
    return found


def test_masks_ignore_any_replaced_words():
    for n in range(1, 14):
        allowed = n - -(-n * 8 // 10)
        for gone in combinations(range(n), allowed):
            assert any(all(m[p] == "0" for p in gone) for m in decontaminate.masks(n))
        assert all(len(m) == n and "1" in m for m in decontaminate.masks(n))


def _quoted(rng, vocabulary, items, n):
    """Documents that quote items whole and in part, with words replaced, some over their begin or end."""
    docs = []
    for i in range(n):
        base = rng.choices(vocabulary, k=rng.randrange(0, 40))
        quoted = (items[i % 8][1]).split()
        for p in rng.sample(range(len(quoted)), rng.randrange(0, 1 + len(quoted) // 4)):
            quoted[p] = "other"
        a = rng.randrange(0, 4)
        docs.append((i, " ".join(base[: rng.choice([0, 40])] + quoted[a : a + rng.randrange(1, 40)] + base[:3])))
    return docs


def test_overlaps_against_all_alignments(spark, documents):
    import random

    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    sizes = [3, 5, 7, 9, 12, 13, 14, 59]
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate(sizes)] + [(8, None), (9, ""), (None, " ".join(f"n{i}" for i in range(13)))]
    docs = _quoted(rng, vocabulary, items, 90)
    docs += [(100, None), (101, ""), (None, items[3][1]), (102, items[3][1]), (102, items[3][1]), (103, items[10][1]), (104, items[7][1][30:])]
    tests = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.overlaps(documents(docs, clash=True), tests)
    rows = got.collect()
    assert len(rows) == len({(r.doc_id, r.item_id) for r in rows})
    assert {(r.doc_id, r.item_id): (r.n_equal, r.n_words, -r.start_word) for r in rows} == _slow_overlaps(docs, items)
    kept = decontaminate.without_overlaps(documents(docs, clash=True), tests)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, _ in docs if i not in {r.doc_id for r in rows})


def test_no_overlap_is_lost(spark, documents):
    """Each of these was lost by a search with fewer masks."""
    item = lambda k, n: " ".join(f"i{k}x{p}" for p in range(n))
    items = [(1, item(1, 13)), (2, item(2, 7)), (None, item(3, 20)), (4, item(4, 59))]
    replaced = " ".join("other" if p in (5, 7) else w for p, w in enumerate(items[0][1].split()))
    part = " ".join(items[3][1].split()[17:37])
    docs = [(1, "so " + replaced + " on"), (2, "so " + items[1][1]), (3, items[2][1].upper()), (4, "so " + part), (5, " ".join(part.split()[:10]))]
    got = decontaminate.overlaps(documents(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.n_equal) for r in got if r.item_id) == [(1, 1, 11), (2, 2, 7), (4, 4, 13)]
    assert [r.doc_id for r in got if r.item_id is None] == [3]


def test_overlaps_without_rows_and_without_broadcast(spark, documents, monkeypatch):
    tests = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(20)))], "item_id long, text string")
    text = "before " + " ".join(f"t{i}" if i != 7 else "changed" for i in range(20)) + " after"
    assert decontaminate.overlaps(documents([]), tests).count() == 0
    assert decontaminate.overlaps(documents([(1, text)]), tests.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "BROADCAST_HASHES", 0)
    # the word replaced is in each window but for the last twelve words: some window has one of 13 replaced
    assert [tuple(r) for r in decontaminate.overlaps(documents([(1, text)]), tests).select("doc_id", "n_words", "n_equal", "start_word").collect()] == [(1, 13, 12, 1)]


# 6 chat


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=4))
@settings(max_examples=40, deadline=None)
def test_template_is_reversible(turns):
    import pyarrow as pa

    put = lambda t, marks: re.sub(marks, lambda m: "\\" + m[0], t)
    roles = pa.array([put(r, chat._IN_ROLE) for r, _ in turns], pa.string())
    texts = pa.array([put(t, chat._IN_TEXT) for _, t in turns], pa.string())
    whole, begins, ends = chat.assemble(roles, texts, np.arange(min(1, len(turns))))
    if turns:
        assert chat.parse_chat(whole[0].as_py()) == turns
        data = whole[0].as_py().encode()
        assert [chat.unescape(data[a:b].decode()) for a, b in zip(begins, ends)] == [t for _, t in turns]


def test_long_and_short_values_are_put_alike(monkeypatch):
    import pyarrow as pa

    turns = [("user", "x" * n) for n in (0, 3, 9, 10, 11, 200, 1)]
    made = []
    for limit in (10, 1 << 16):
        monkeypatch.setattr(chat, "LONG_VALUE", limit)
        made.append(chat.assemble(pa.array([r for r, _ in turns]), pa.array([t for _, t in turns]), np.array([0, 2]))[0].to_pylist())
    assert made[0] == made[1] and chat.parse_chat(made[0][0]) == turns[:2] and chat.parse_chat(made[0][1]) == turns[2:]


def test_conversations(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [
        (1, 2, "assistant", "b é"), (1, 1, "user", "a"), (1, 3, "assistant", None), (2, 1, None, "x"), (2, None, "user", said),
        (None, 1, "assistant", said), (3, 1, "as:sis", ""), (4, 1, "assistant", "y" * 100_000), (4, 1, "assistant", "same"), (4, 1, "assistant", "same"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("conv", F.lit(2))
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in turns).encode()).hexdigest()
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == (
            len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()
        )
    assert chat.format_chats(df.limit(0)).count() == 0


# 7 SimHash


def _slow_hash(text):
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _slow_components(prints, radius):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in combinations(sorted(set(prints)), 2):
        if (a ^ b).bit_count() <= radius:
            root[max(find(a), find(b))] = min(find(a), find(b))
    return {p: find(p) for p in prints}


@given(st.text(alphabet="aB é\x0b\x85\n", max_size=40))
@settings(deadline=None)
def test_simhash_against_its_definition(text):
    assert simhash.simhash(text) == _slow_hash(text)


def test_near_duplicates(spark, documents, odd_texts):
    base = "one two three four five six seven eight nine ten " * 40
    pairs = odd_texts + [(20 + i, base + f"tail{i % 7}") for i in range(30)] + [(70, base.upper() + "tail1")]
    got = simhash.near_duplicates(documents(pairs, clash=True)).collect()
    prints = {(i, t): _slow_hash(t) for i, t in pairs}
    roots = _slow_components(set(prints.values()), 2)
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[roots[p]] = min(least.get(roots[p], i), i)
    want = Counter((i, f"{prints[i, t]:016x}", least.get(roots[prints[i, t]])) for i, t in pairs)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    kept = simhash.keep_one(documents(pairs, clash=True)).collect()
    assert len(kept) == len(set(roots.values()))
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.keep_one(documents([])).count() == 0


@pytest.mark.parametrize("shard", [3, 2048])
def test_links_join_all_within_the_radius(spark, shard):
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    values = {0, (1 << 64) - 1, 1 << 63}
    for c in centres.tolist():
        for _ in range(12):
            values.add(c := c ^ int(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 4), replace=False))))
    signed = np.array(sorted(values), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    roots = {r.v % (1 << 64): r.root for r in simhash.components(simhash.links(df, shard=shard)).collect()}
    want = _slow_components(values, 2)
    groups = lambda m: {frozenset(g) for g in _grouped(m) if len(g) > 1}
    assert groups(roots) == groups(want)


def _grouped(of):
    by = defaultdict(set)
    for k, v in of.items():
        by[v].add(k)
    return by.values()


def test_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    values = list(dict.fromkeys((rng.integers(0, 1 << 10, 200)).tolist()))
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in range(0, 1 << 10, 37):
        assert sorted(tree.values[i] for i in tree.near(q, 2)) == sorted(v for v in values if (v ^ q).bit_count() <= 2)


# 8 secrets


def _slow_spans(text):
    rules = [
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, re.I | re.A),
        ("access", r"AKIA[A-Z0-9]+", 0, 20, 0),
        ("hex", r"[0-9a-f]+", 0, 24, 0),
    ]
    found = []
    for k, (kind, pattern, group, least, flags) in enumerate(rules):
        found += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [(kind, a, b) for a, _, kind, b in sorted(found)]


SECRETS = [
    'API_KEY = "abcdef123456" and password: short secret=longenough', "AKIA" + "A" * 20 + " AKIA123 AKIA" + "9" * 16, "0123456789abcdef" * 2,
    "é😀token='deadbeefdeadbeefdeadbeef'", "token = token = abcdefgh", "f" * 23 + " " + "e" * 24, "password:" + " " * 50 + "x1y2z3", "PassWD=abcdef" * 3,
]


def test_spans_and_odd_rows(spark, documents, odd_texts):
    pairs = odd_texts + [(50 + i, t) for i, t in enumerate(SECRETS * 2)]
    got = secret_scan.scan_versions(documents(pairs, clash=True)).collect()
    want = Counter((i, tuple(_slow_spans(t))) for i, t in pairs)
    assert Counter((r.doc_id, tuple((f["kind"], f["start"], f["end"]) for f in r.found)) for r in got) == want
    assert secret_scan.scan_versions(documents([])).count() == 0


def test_ledger_scans_only_what_is_new(spark, documents):
    ledger = secret_scan.Ledger(spark)
    first = documents([(1, SECRETS[0]), (2, "nothing")])
    secret_scan.scan_versions(first, ledger=ledger)
    n = ledger.scanned().count()
    assert n == 2 * 3
    both = first.union(documents([(3, SECRETS[0]), (4, SECRETS[2])]))
    got = {r.doc_id: len(r.found) for r in secret_scan.scan_versions(both, ledger=ledger).collect()}
    assert got == {1: 2, 2: 0, 3: 2, 4: 1}
    assert ledger.scanned().count() == n + 3
    newer = tuple(r._replace(version="2") if r.kind == "hex" else r for r in secret_scan.RULES)
    again = {r.doc_id: len(r.found) for r in secret_scan.scan_versions(both, ledger=ledger, rules=newer).collect()}
    assert again == got and ledger.scanned().count() == n + 3 + 3


# 9 line dedup


def _slow_dedup(pairs):
    """Every chunk against all earlier ones, by a list of texts; what stands next to a first place is looked up whole."""
    seen, order, marks = {}, sorted(set(pairs), key=lambda p: (p[0] is not None, p[0] or 0)), defaultdict(list)
    for i, t in order:
        text = t or ""
        starts, stops = (x.tolist() for x in line_dedup.chunks(text)[:2])
        parts = [text[a:b] for a, b in zip(starts, stops)]
        for k, part in enumerate(parts):
            if len(part) >= line_dedup.SHORTEST:
                if part in seen:
                    marks[i, t].append((k, *seen[part]))
                else:
                    seen[part] = text[line_dedup.neighbour(starts, stops, k, -1)], text[line_dedup.neighbour(starts, stops, k, 1)]
    for which, found in marks.items():
        at = {k for k, _, _ in found}
        starts, stops, _ = line_dedup.chunks(which[1] or "")
        marks[which] = [
            (int(starts[k]), int(stops[k]), before if k - 1 not in at else None, after if k + 1 not in at else None) for k, before, after in found
        ]
    return Counter((i, t if t is None else line_dedup.strip_runs(t, marks[i, t])[0]) for i, t in pairs)


def _lines(seed, n, words=9):
    return "\n".join(" ".join(f"w{seed}x{(i * 31 + j * 7) % 97}" for j in range(words)) for i in range(n))


def _prose(seed, n):
    return " ".join(" ".join(f"p{seed}q{(i * 13 + j * 5) % 101}" for j in range(4 + (i * i) % 9)) + "." for i in range(n))


@given(st.text(alphabet="ab. \n!é\t\r", max_size=120))
@settings(deadline=None)
def test_chunks_are_the_text(text):
    starts, stops, hashes = line_dedup.chunks(text)
    assert starts[0] == 0 and stops[-1] == len(text) and len(hashes) == len(starts)
    assert (starts[1:] == stops[:-1] + 1).all() and all(text[s] in " \n\t\r" for s in stops[:-1])


def test_long_texts_without_ends_are_cut_as_well():
    starts, stops, _ = line_dedup.chunks("\n" * 1000)
    assert len(starts) > 1000 // line_dedup.LONGEST - 1 and stops[-1] == 1000


def test_chunks_withstand_shifts():
    passage = _prose(1, 30)
    found = []
    for text in (_prose(2, 5) + " " + passage + " " + _prose(3, 4), _lines(4, 2) + "\nwords before " + passage + "\n" + _lines(5, 3)):
        starts, stops, _ = line_dedup.chunks(text)
        found.append({text[a:b] for a, b in zip(starts, stops)})
    assert sum(map(len, found[0] & found[1])) > 0.75 * len(passage)


def test_repeated_passages_go_from_all_but_the_first(spark, documents, odd_texts):
    passage, long, prose = _lines(1, 14), " ".join(f"long{i}." if i % 7 == 6 else f"long{i}" for i in range(70)), _prose(9, 12)
    pairs = odd_texts[:-1] + [
        (100, _lines(2, 3) + "\n" + passage), (101, _lines(3, 3) + "\n" + passage + "\n" + _lines(4, 2)), (102, f"head a\n{long}\ntail"),
        (103, f"other\n{long}\nend"), (104, "Licensed to all of you, without any warranty.\nkept"), (105, "Licensed to all of you, without any warranty.\nalso"),
        (106, long + "\n" + long), (107, f"In the middle of {prose} of a line"), (108, f"At another place {prose} too"),
    ]
    docs = documents(pairs, clash=True)
    got = line_dedup.dedup_lines(docs, count="n_removed")
    assert Counter((r.doc_id, r.text) for r in got.collect()) == _slow_dedup(pairs)
    texts = {r.doc_id: r.text for r in got.collect() if r.doc_id and r.doc_id >= 100}
    assert texts[102] == dict(pairs)[102] and texts[103] == "other\nend" and texts[106] == ""
    assert texts[104].startswith("Licensed") and texts[105].startswith("Licensed")
    assert texts[101] == _lines(3, 3) + "\n" + _lines(4, 2)
    assert texts[107] == dict(pairs)[107] and texts[108] == "At another place too"
    assert line_dedup.dedup_lines(documents([])).count() == 0


def test_all_shared_runs_of_over_fifty_words_go(spark, documents):
    """A plain search by words finds no run of over 50 words left that stands in an earlier text, wherever sentences end."""
    rng = np.random.default_rng(11)
    own = lambda n: [f"u{w}" + ". "[: int(rng.random() < 0.1)] for w in rng.integers(0, 1 << 60, n).tolist()]
    passages = [own(51 + k % 9) for k in range(60)] + [["and"] * 51, ["to", "and", "fro"] * 17]
    pairs = [(2 * k + side, " ".join(own(5 + k % 40) + p + own(7 + k % 23))) for k, p in enumerate(passages) for side in (0, 1)]
    texts = [(r.doc_id, r.text.split()) for r in line_dedup.dedup_lines(documents(pairs)).collect()]
    seen, left = set(), []
    for i, words in sorted(texts):
        runs = {tuple(words[k : k + 51]) for k in range(len(words) - 50)}
        left += [i] * bool(runs & seen)
        seen |= runs
    assert left == []
    # the words about them stay, and all of each first text
    before = {i: t.split() for i, t in pairs}
    assert all(words == before[i] for i, words in texts if i % 2 == 0)
    assert all(not set(before[i]) - set(words) - set(passages[i // 2]) for i, words in texts)


def test_other_white_space_and_scripts_without_spaces(spark, documents):
    tabbed = "\t".join(f"word{k}" for k in range(200))
    chinese = "".join(chr(0x4E00 + (k * 37) % 5000) for k in range(400))
    pairs = [(1, f"one a\n{tabbed}\nfinis"), (2, f"two b\n{tabbed}\nstop here"), (3, f"three\n{chinese}\nover"), (4, f"four\n{chinese}\ndone")]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(pairs)).collect()}
    assert got == {1: pairs[0][1], 2: "two b\nstop here", 3: pairs[2][1], 4: "four\ndone"}
    assert line_dedup.count_words("two words") == 2 and line_dedup.count_words("漢字漢字 kana") == 4


def test_repeated_rows_are_one_document(spark, documents):
    text = _lines(7, 14)
    once = [(1, text), (2, "head of it\n" + text), (3, None), (None, text)]
    many = once + [once[1]] * 300 + [once[2]] * 3 + [once[3]] * 3
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(documents(once)).collect()}
    got = line_dedup.dedup_lines(documents(many)).collect()
    assert len(got) == len(many) and {(r.doc_id, r.text) for r in got} == set(want.items())
    marks = line_dedup.repeated(documents(many)).collect()
    assert sorted(len(r.repeats) for r in marks) == sorted(len(r.repeats) for r in line_dedup.repeated(documents(once)).collect())


def test_a_full_filter_changes_nothing(spark, documents, monkeypatch):
    pairs = [(i, _prose(i % 5, 12) + f" own {i}") for i in range(20)]
    want = line_dedup.dedup_lines(documents(pairs)).collect()
    monkeypatch.setattr(line_dedup, "repeat_filter", lambda df, text="text": np.full(line_dedup.FILTER_BITS // 64, (1 << 64) - 1, np.uint64))
    got = line_dedup.dedup_lines(documents(pairs)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and want != []


# 10 toxicity


def _slow_segments(scores):
    """All maximal segments by repeated splitting: take the best segment, then go on to its left and right."""
    scores = list(scores)

    def go(a, b):
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return go(a, i) + [(i, j, sum(scores[i:j]))] + go(j, b)

    return go(0, len(scores))


@given(st.lists(st.integers(-5, 5).map(lambda x: x + 0.0), max_size=14))
@settings(max_examples=150, deadline=None)
def test_segments_have_the_best_scores(scores):
    got = toxicity.segments(np.array(scores))
    want = _slow_segments(scores)
    assert sorted(s for _, _, s in got if s > 0)[-1:] == sorted(s for _, _, s in want)[-1:]
    assert sum(s for _, _, s in got) == pytest.approx(sum(s for _, _, s in want))
    assert all(b <= c for (_, b, _), (c, _, _) in zip(got, got[1:]))


def test_log_odds_by_hand():
    rng = np.random.default_rng(5)
    toxic, other = rng.integers(0, 400, 50).astype(float), rng.integers(0, 400, 50).astype(float)
    corpus = toxic + other + rng.integers(0, 1000, 50)
    got = toxicity._sure_log_odds(toxic, other, corpus)
    whole = sum(c + 0.1 for c in corpus)
    for k in range(50):
        prior = toxicity.PRIOR * (corpus[k] + 0.1) / whole
        a = np.log((toxic[k] + prior) / (toxic.sum() + toxicity.PRIOR - toxic[k] - prior))
        b = np.log((other[k] + prior) / (other.sum() + toxicity.PRIOR - other[k] - prior))
        error = toxicity.ERRORS * (1 / (toxic[k] + prior) + 1 / (other[k] + prior)) ** 0.5
        want = a - b - error if a - b > error else a - b + error if a - b < -error else 0.0
        assert got[k] == pytest.approx(min(max(want, -4), 8), abs=1e-12)


def test_extreme_value_law_and_scores(spark):
    # the law's rate solves its equation, and its factor makes the expected number of best segments that of the texts
    values, times = np.array([-1.0, 0.5, 2.0]), np.array([90.0, 8.0, 2.0])
    best, lengths = np.array([0.5, 2.0, 2.5, 4.0]), np.array([40.0, 60.0, 80.0, 100.0])
    rate, factor = toxicity.fit_law(best, lengths, values, times)
    assert sum(t / 100 * np.exp(rate * v) for v, t in zip(values, times)) == pytest.approx(1, abs=1e-4)
    assert sum(factor * n * np.exp(-rate * s) for s, n in zip(best, lengths)) == pytest.approx(len(best))
    # E-values, evidence and probability of a text, from its segments
    words = np.zeros(toxicity.WORD_BUCKETS) - 0.5
    ids = labels.Words(toxicity._number).ids("calm vile villain words here vile and some more of them")
    bad = [zlib.crc32(w) % toxicity.WORD_BUCKETS for w in (b"vile", b"villain")]
    words[bad] = 4.0
    scores = toxicity.Scores(words, np.zeros(toxicity.STEM_BUCKETS), np.ones(toxicity.WORD_BUCKETS, bool))
    model = toxicity.Model(scores, 1.2, 0.1, np.array([2.0, 1.0, -3.0]))
    found = model.passages(ids)
    assert [(a, b, s) for a, b, s, _ in found] == [(1, 6, 11.0)]
    e = 0.1 * len(ids) * np.exp(-1.2 * 11.0)
    assert found[0][3] == pytest.approx(e)
    surprise = np.log1p(-np.log(e))
    assert model.evidence(ids) == pytest.approx((surprise, surprise))
    assert model.probability(ids) == pytest.approx(1 / (1 + np.exp(-(3 * surprise - 3))))
    assert model.passages(ids[:1]) == [] and model.evidence(ids[:0]) == (0.0, 0.0)


def test_logistic_fit_has_no_slope_left():
    rng = np.random.default_rng(6)
    x = np.column_stack([rng.normal(size=(300, 2)), np.ones(300)])
    y = (rng.random(300) < 1 / (1 + np.exp(-(x @ [1.5, -0.7, 0.2])))).astype(float)
    w = toxicity._logistic(x, y)
    assert np.abs(x.T @ (1 / (1 + np.exp(-x @ w)) - y) + 0.05 * w).max() < 1e-8


def test_toxicity_learns_and_shows_passages(spark, documents):
    rows = [(i, f"calm words about day {i % 17} and the weather over hill {i % 13} " * 3) for i in range(400)]
    rows += [(400 + i, f"calm words about day {i % 17} and you horrid villain vile over hill {i % 13} ") for i in range(200)]
    docs = documents(rows)
    marks = spark.createDataFrame([(i, 1, int(i >= 400)) for i, _ in rows], "doc_id long, quality int, toxic int")
    apart = labels.remainder(F.col("doc_id"), 5) == 0
    scored = toxicity.score(docs, toxicity.fit(docs, marks, ~apart), passages="passages").filter(apart).collect()
    assert all((r.score >= toxicity.THRESHOLD) == (r.doc_id >= 400) for r in scored)
    for r in scored:
        assert bool(r.passages) == (r.doc_id >= 400)
        assert all("villain" in r.text[p["start"] : p["end"]] for p in r.passages)


def test_toxicity_odd_rows(spark, documents, odd_texts):
    docs = documents(odd_texts, clash=True)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, none, F.lit(True)), passages="passages")
    assert [r.score for r in scored.collect()] == pytest.approx([0.5] * len(odd_texts))
    assert toxicity.score(documents([]), toxicity.fit(documents([]), none, F.lit(True))).count() == 0


def test_crc_of_the_id_is_that_of_its_text(spark):
    got = spark.range(50).select("id", labels.remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in got)
