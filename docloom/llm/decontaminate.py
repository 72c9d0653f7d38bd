"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

A test and a document overlap where a window of words of the test stands in the
document with few words replaced. A mask is as long as the window and ignores some of its
positions, so a hash under it is the same although words there were replaced.
Whichever words are replaced, as many as are allowed, one of the masks ignores
them all: no overlap is without a common hash. Equal hashes of test and document
windows are hits, and the words of both are compared.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import name

# An overlap is a window of this many words, or a whole shorter test, with so great a part of them equal.
WINDOW, MIN_EQUAL = 13, 0.8
# Test hashes that are broadcast at most (some 30 bytes each, and the words of each test); with more, the joins shuffle.
BROADCAST_HASHES = 1_000_000


def needed(length: int) -> int:
    """Words that must be equal in a window of `length` words."""
    return math.ceil(length * MIN_EQUAL - 1e-9)


def masks(length: int) -> tuple[str, ...]:
    """Masks of `length` positions (1: the word counts, 0: it is ignored).

    With `e` replacements allowed, position p is of class p mod (e + 2), and each mask
    ignores `e` classes: of any `e` positions, some mask ignores all.
    """
    allowed = length - needed(length)
    classes = allowed + 2 if allowed else 1
    return tuple(
        "".join("0" if p % classes in ignored else "1" for p in range(length)) for ignored in combinations(range(classes), allowed)
    )


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hash(of: Column, at: Column, number: int, mask: str) -> Column:
    return F.xxhash64(F.lit(len(mask)), F.lit(number), *[F.get(of, at + k) for k, bit in enumerate(mask) if bit == "1"])


def _seeds(df: DataFrame, length: int) -> DataFrame:
    """One row per window of `length` words (its place `at`, from 0) and mask: `seed`."""
    places = F.when(F.size("words") >= length, F.sequence(F.lit(0), F.size("words") - length)).otherwise(
        F.array().cast("array<int>")
    )
    placed = df.withColumn("at", F.explode(places))
    return placed.withColumn("seed", F.explode(F.array(*[_hash(F.col("words"), F.col("at"), n, m) for n, m in enumerate(masks(length))])))


def overlaps(
    docs: DataFrame,
    tests: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    test_id: str = "item_id",
    test_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """One row per document and test that overlap, with the best common window of the two.

    A test of `window` words or more is searched by each of its windows, a shorter one as
    a whole; a window may reach over the document's begin or end, where words
    count as replaced. Columns: the document's id, `text_hash` (xxhash64 of its
    text), the test's id, `start_word` (where the window begins in the document, from 0),
    `n_words` (of the window) and `n_equal` (those that agree); of several windows the one with the
    most equal words, then the longest, then the first. Null texts have no words, and tests without words
    overlap nothing. Documents that are equal in id and text give one row, as do tests of one
    id; ids may be null; other columns are not read; empty tables give no rows.
    """
    one = tests.select(name(test_id).alias("item"), words(name(test_text)).alias("words")).distinct()
    # a test goes by a hash of its id and words, as ids may be null or repeated
    items = one.filter(F.size("words") > 0).select("item", "words", F.xxhash64("item", "words").alias("key"))
    # the lengths that occur, `window` at most, and whether the tests' seeds are few enough for every executor to hold
    sizes = items.groupBy(F.least(F.size("words"), F.lit(window)).alias("length")).agg(F.sum(F.size("words") + 1 - F.least(F.size("words"), F.lit(window))).alias("n"))
    found = {r.length: r.n for r in sizes.collect()}
    small = sum(n * len(masks(length)) for length, n in found.items()) <= BROADCAST_HASHES
    held = F.broadcast if small else (lambda df: df)
    rows = docs.select(name(id_column).alias("id"), F.xxhash64(name(text)).alias("text_hash"), words(name(text)).alias("words"))
    best = None
    for length in sorted(found):
        own = items.filter(F.size("words") == length if length < window else F.size("words") >= length)
        seeds = _seeds(own.select("key", "words"), length).select("seed", "key", F.col("at").alias("item_at"))
        # words that equal none of any test, as many as may be replaced, before and after the document's
        more = length - needed(length)
        beside = F.array_repeat(F.lit(""), more)
        padded = rows.withColumn("words", F.concat(beside, "words", beside)) if more else rows
        hits = _seeds(padded, length).join(held(seeds), "seed").select(
            "id", "text_hash", "key", "item_at", (F.col("at") - more).alias("at"), F.slice("words", F.col("at") + 1, length).alias("found")
        )
        texts = own.select(F.col("key").alias("of"), "item", F.col("words").alias("wanted"))
        agree = F.filter(F.sequence(F.lit(0), F.lit(length - 1)), lambda k: F.get("found", k) == F.get("wanted", F.col("item_at") + k))
        aligned = hits.distinct().join(held(texts), F.col("key") == F.col("of")).withColumn("n_equal", F.size(agree))
        rank = F.struct("n_equal", F.lit(length).alias("n_words"), (-F.greatest("at", F.lit(0))).alias("before"))
        ranked = aligned.filter(F.col("n_equal") >= needed(length)).select("id", "text_hash", "item", rank.alias("best"))
        best = ranked if best is None else best.unionByName(ranked)
    if best is None:
        nothing = F.struct(F.lit(0).alias("n_equal"), F.lit(0).alias("n_words"), F.lit(0).alias("before"))
        best = rows.join(one.select("item"), F.lit(False)).select("id", "text_hash", "item", nothing.alias("best")).limit(0)
    return (
        best.groupBy("id", "text_hash", "item")
        .agg(F.max("best").alias("best"))
        .select(
            F.col("id").alias(id_column),
            "text_hash",
            F.col("item").alias(test_id),
            (-F.col("best.before")).alias("start_word"),
            F.col("best.n_words").alias("n_words"),
            F.col("best.n_equal").alias("n_equal"),
        )
    )


def without_overlaps(docs: DataFrame, tests: DataFrame, id_column: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, all columns, whose texts overlap no test.

    Null texts overlap nothing; repeated rows stay or go together; rows of null id go by
    their text; columns may have any names; an empty table, or one without tests, comes back as it is.
    """
    found = overlaps(docs, tests, id_column, text, **how)
    gone = found.select(F.col(id_column).alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct()
    rows = docs.select(
        F.struct(*map(name, docs.columns)).alias("row"), name(id_column).alias("id"), F.xxhash64(name(text)).alias("text_hash")
    )
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    return rows.join(gone, same, "left_anti").select("row.*")
