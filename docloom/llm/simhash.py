"""SimHash near-duplicates: fingerprints, links found by BK-trees, and their connected components.

A pair within `radius` bits agrees on `blocks - radius` whole blocks of bits, so
fingerprints are dealt by every choice of that many blocks: no link is lost, and
no task holds more than the fingerprints of one such key. Each task builds a
BK-tree per key (children keyed by their distance to the parent) and follows only
the edges within the radius. A key with over `SHARD` fingerprints is cut into
shards; each shard's tree is sent to the tasks that search it for the members of
one shard. Trees give links to one fingerprint per local group, as many as there
are fingerprints at most, never all pairs.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import free, groups, map_texts, name
from docloom.storage import cut, cut_observed

WORDS, RADIUS, BLOCKS, SHARD = 3, 2, 4, 2048
# Of each byte value, its bits, the lowest first.
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def simhash(text: str, words: int = WORDS) -> int:
    """64 bits, each set where over half the word shingles' hashes have it; 0 without words.

    A-Z are lower-cased; words end at space, tab to carriage return; shingles
    count as often as they occur; fewer words than a shingle has are one shingle.
    """
    found = text.encode().lower().split()
    if not found:
        return 0
    if len(found) <= words:
        return xxhash.xxh64_intdigest(b" ".join(found), seed=42)
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found])
    starts = np.concatenate(([0], ends[: len(found) - words])).tolist()
    digest = xxhash.xxh64_digest
    hashes = b"".join([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())])
    # digests are big-endian
    by_byte = np.frombuffer(hashes, np.uint8).reshape(-1, 8)
    made = 0
    for k in range(8):
        counts = np.bincount(by_byte[:, 7 - k], minlength=256) @ _BITS
        made |= int(np.packbits(2 * counts > len(by_byte), bitorder="little")[0]) << 8 * k
    return made


def fingerprints(df: DataFrame, text: str = "text", words: int = WORDS, keep: list[str] | None = None) -> DataFrame:
    """Add `fingerprint`, the SimHash of the whole text as a signed long; null texts count as empty."""

    def setup():
        def work(texts):
            return [pa.array(np.array([simhash(t, words) for t in texts], np.uint64).view(np.int64))]

        return work

    return map_texts(df, text, [T.StructField("fingerprint", T.LongType())], setup, keep)


class BKTree:
    """Integers under Hamming distance."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def near(self, value: int, radius: int) -> list[int]:
        """Places of all values within `radius`."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            children = self.children[at]
            if children:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if edge in children:
                        open_.append(children[edge])
        return found

    def add(self, value: int) -> int:
        """The place of `value`, new or known."""
        at, new = 0, len(self.values)
        while new:
            d = (self.values[at] ^ value).bit_count()
            if not d:
                return at
            if (child := self.children[at].get(d)) is None:
                self.children[at][d] = new
                break
            at = child
        self.values.append(value)
        self.children.append({})
        return new


def _root(parent: list[int], at: int) -> int:
    while parent[at] != at:
        parent[at] = parent[parent[at]]
        at = parent[at]
    return at


def local_links(trees: list[int], searched: list[int] | None, radius: int) -> list[tuple[int, int]]:
    """Links (fingerprint, least one of its local group) within one key.

    All of `trees` with each other, or, with `searched`, those against the tree of `trees`.
    """
    tree, parent, values = BKTree(), [], list(trees)

    def link(a: int, b: int) -> None:
        a, b = _root(parent, a), _root(parent, b)
        low, high = (a, b) if values[a] < values[b] else (b, a)
        parent[high] = low

    for place, value in enumerate(trees):
        parent.append(place)
        if searched is None:
            for other in tree.near(value, radius):
                link(place, other)
        tree.add(value)
    for value in searched or []:
        near = tree.near(value, radius)
        if near:
            values.append(value)
            parent.append(len(parent))
            for other in near:
                link(len(parent) - 1, other)
    return [(values[i], values[r]) for i in range(len(values)) if (r := _root(parent, i)) != i]


def _keys(fp, blocks: int, radius: int):
    """Per choice of blocks that may all agree: its number and the bits of those blocks."""
    edges = [64 * b // blocks for b in range(blocks + 1)]
    masks = [((1 << (edges[b + 1] - edges[b])) - 1) << edges[b] for b in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    return F.array(
        *[
            F.struct(F.lit(n).alias("choice"), fp.bitwiseAND(F.lit(signed(sum(masks[b] for b in chosen)))).alias("bits"))
            for n, chosen in enumerate(combinations(range(blocks), blocks - radius))
        ]
    )


def links(distinct: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, shard: int = SHARD) -> DataFrame:
    """Links (`a`, `b`) among different fingerprints (column `fingerprint`) that join all within `radius` bits."""
    if not 0 <= radius < blocks:
        raise ValueError("more blocks than differing bits are needed")
    key = ["choice", "bits"]
    dealt = distinct.select("fingerprint", F.explode(_keys(F.col("fingerprint"), blocks, radius)).alias("k")).select(
        "k.choice", "k.bits", "fingerprint"
    )
    # Keys with too many fingerprints for one tree: a few, if any.
    hot, seen = cut_observed(
        dealt.groupBy(*key).count().filter(F.col("count") > shard), "simhash-keys", F.count(F.lit(1)).alias("n")
    )
    searched = F.lit(False)
    if seen["n"]:
        n = F.coalesce(F.ceil(F.col("count") / shard).cast("int"), F.lit(1))
        mine = F.pmod(F.xxhash64("fingerprint"), F.col("n")).cast("int")
        pairs = F.transform(
            F.sequence(F.lit(0), F.col("n") - 1),
            lambda other: F.struct(
                F.least(F.col("mine"), other).alias("tree"),
                F.greatest(F.col("mine"), other).alias("side"),
                (F.col("mine") > other).alias("searched"),
            ),
        )
        dealt = (
            dealt.join(hot, key, "left")
            .withColumn("n", n)
            .withColumn("mine", mine)
            .withColumn("to", F.explode(pairs))
            .select(*key, "to.tree", "to.side", "to.searched", "fingerprint")
        )
    else:
        dealt = dealt.select(*key, F.lit(0).alias("tree"), F.lit(0).alias("side"), searched.alias("searched"), "fingerprint")
    by = [*key, "tree", "side"]
    dealt = dealt.repartition(*by).sortWithinPartitions(*by, "searched", "fingerprint")

    def run(batches):
        out = []
        for table in groups(batches, len(by)):
            if table.num_rows > 1:
                values = (np.asarray(table.column("fingerprint")).view(np.uint64)).tolist()
                sides = table.column("searched").to_pylist()
                if table.column("tree")[0] == table.column("side")[0]:
                    out += local_links(values, None, radius)
                else:
                    middle = len(values) - sum(sides)
                    out += local_links(values[:middle], values[middle:], radius)
            if len(out) >= 50_000:
                yield _pairs(out)
                out = []
        if out:
            yield _pairs(out)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    both = np.array(rows, np.uint64).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy())], names=["a", "b"])


def components(pairs: DataFrame) -> DataFrame:
    """Per vertex of `pairs` (`a`, `b`): `root`, one vertex of its component, the same for all of it.

    Each round gives every vertex the least root next to it, then the root of its
    root; rounds are written to the shared folder, and end when nothing changes.
    Long chains take rounds in the logarithm of their length, in practice.
    """
    both = cut(pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "simhash-pairs")
    roots = both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("near")).select("v", F.least("v", "near").alias("root"))
    roots = cut(roots, "simhash-roots")
    while True:
        near = both.join(roots, both.b == roots.v).groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, roots.v == near.a).select("v", F.col("root").alias("was"), F.least("root", "near").alias("low"))
        of = roots.select(F.col("v").alias("w"), F.col("root").alias("jump"))
        next_ = lower.join(of, F.col("low") == F.col("w")).select("v", F.least("low", "jump").alias("root"), "was")
        next_, seen = cut_observed(next_, "simhash-roots", F.count_if(F.col("root") != F.col("was")).alias("changed"))
        roots = next_.select("v", "root")
        if not seen["changed"]:
            return roots


def classes(
    prints: DataFrame, id_column: str, radius: int = RADIUS, blocks: int = BLOCKS, linked: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """`prints` (an id and `fingerprint` per row) with `component`, the least id reachable over links,
    and `root`, a fingerprint that names the component.

    Fingerprints are compared once each, however many rows have them. Null ids
    take part, but are never the least id, unless a component has no other: then
    it is null. Pass written rows: they are read twice. `linked`, if given, makes
    the links of different fingerprints in another way than `links`.
    """
    ident = name(id_column)
    distinct = cut(prints.groupBy("fingerprint").agg(F.min(ident).alias("least")), "simhash-distinct")
    roots = components(linked(distinct) if linked else links(distinct, radius, blocks))
    rooted = distinct.join(roots, distinct.fingerprint == roots.v, "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    rooted = cut(rooted, "simhash-rooted")
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    # `component` is unique per fingerprint: adaptive execution splits a hot fingerprint's rows
    per_print = rooted.join(of_root, "root").select(F.col("fingerprint").alias("of_print"), "component", "root")
    per_print = cut(per_print, "simhash-components")
    return prints.join(per_print, F.col("fingerprint") == F.col("of_print"), "left").drop("of_print")


def _prints(df: DataFrame, id_column: str, text: str, words: int) -> DataFrame:
    """Per row of `df`: `id`, `text_hash` and `fingerprint`, written."""
    slim = df.select(
        name(id_column).alias("id"), F.xxhash64(name(text)).alias("text_hash"), name(text).alias("text")
    )
    return cut(fingerprints(slim, "text", words, ["id", "text_hash"]), "simhash-prints")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """Per row of `df`: the id, `fingerprint` (16 hex digits) and `component_id`, the least id reachable.

    Two texts link at `radius` or fewer differing bits. Null and empty texts have
    fingerprint zero and link like any other; repeated rows each give a row; other
    columns are not read; an empty table gives no rows.
    """
    found = classes(_prints(df, id_column, text, words).drop("text_hash"), "id", radius, blocks)
    return found.select(
        F.col("id").alias(id_column),
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_one(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS, blocks: int = BLOCKS
) -> DataFrame:
    """The rows of `df`, all columns, with one row of each group of near-duplicates.

    That with the least id stays (null ids last); among rows of that id, one of
    them, repeated rows included. An empty table gives no rows.
    """
    return kept_rows(df, classes(_prints(df, id_column, text, words), "id", radius, blocks), id_column, text)


def kept_rows(df: DataFrame, found: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows of `df` that stay, one per `root` of `found` (`id`, `text_hash` and `root` per row)."""
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    kept = (
        found.groupBy("root")
        .agg(F.min(order).alias("kept"))
        .select(F.col("kept.id").alias("kept_id"), F.col("kept.text_hash").alias("kept_hash"))
    )
    rows = df.select(
        F.struct(*map(name, df.columns)).alias("row"), name(id_column).alias("id"), F.xxhash64(name(text)).alias("text_hash")
    )
    same = F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("text_hash") == F.col("kept_hash"))
    turn = F.row_number().over(Window.partitionBy("id", "text_hash").orderBy("text_hash"))
    return rows.join(kept, same, "left_semi").withColumn("turn", turn).filter("turn = 1").select("row.*")
