"""Document fingerprints by winnowing: few k-gram hashes per text, with a match guarantee.

All `k`-grams of code points are hashed by a rolling polynomial. Of every `window`
consecutive hashes the least is chosen, the rightmost among equals, and kept once
with its position. So two texts that share a run of `k + window - 1` code points
share a chosen hash, wherever the run stands.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import map_texts, name

K, WINDOW = 16, 32
# An odd multiplier for the polynomial, and the finalizer of a common 64-bit mix.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
# Code points worked on at a time. Positions within such a block take the low bits of a key.
_BLOCK_BITS = 20


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def _hashes(points: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all k-grams, by doubling: 2m-grams from two m-grams."""
    with np.errstate(over="ignore"):
        made, length, done, total = points.astype(np.uint64) + np.uint64(1), 1, None, 0
        power = _BASE  # _BASE ** length
        while True:
            if k & length:
                if done is None:
                    done, total = made, length
                else:
                    n = len(points) - total - length + 1
                    done, total = done[:n] * power + made[total : total + n], total + length
            if (length := length * 2) > k:
                break
            half = length // 2
            made = made[: len(made) - half] * power + made[half:]
            power = power * power
        done = done ^ (done >> np.uint64(33))
        done = done * _MIX
        return done ^ (done >> np.uint64(29))


def select(points: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Chosen hashes (44 bits) and their positions. A text shorter than `k` is one gram; an empty one has none."""
    n = len(points)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    gram = min(k, n)
    low = np.uint64((1 << _BLOCK_BITS) - 1)
    step = (1 << _BLOCK_BITS) - window
    found_hash, found_at = [], []
    for start in range(0, n - gram + 1, step):
        # a block's windows begin at `step` positions; the hashes reach over the block's end
        part = _hashes(points[start : start + step + window - 1 + gram - 1], gram)
        width = min(window, len(part))
        places = np.arange(len(part), dtype=np.uint64)
        keys = (part >> np.uint64(_BLOCK_BITS) << np.uint64(_BLOCK_BITS)) | (low - places)  # ties: the rightmost is least
        least, size = keys, 1
        while size < width:
            shift = min(size, width - size)
            least = np.minimum(least[: len(least) - shift], least[shift:])
            size += shift
        chosen = least[np.concatenate(([True], least[1:] != least[:-1]))]
        found_hash.append(chosen >> np.uint64(_BLOCK_BITS))
        found_at.append((low - (chosen & low)).astype(np.int64) + start)
    at, first = np.unique(np.concatenate(found_at), return_index=True)
    return np.concatenate(found_hash)[first], at


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of different hashes; two empty ones are equal."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(hashes: np.ndarray, at: np.ndarray) -> str:
    """A short name of a whole fingerprint, positions included."""
    return hashlib.blake2b(hashes.astype("<u8").tobytes() + at.astype("<i8").tobytes(), digest_size=16).hexdigest()


def fingerprints(df: DataFrame, text: str = "text", k: int = K, window: int = WINDOW, keep: list[str] | None = None) -> DataFrame:
    """Add `hashes` and `positions` (arrays of longs, by position), the winnowed fingerprint of the whole text.

    Null texts count as empty and have no hashes. Rows are independent of each
    other: no shuffle; repeated rows have equal fingerprints; an empty table gives
    an empty one; columns named `hashes` or `positions` are replaced.
    """
    fields = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("hashes", "positions")]

    def setup():
        def work(texts):
            made = [select(code_points(t), k, window) for t in texts]
            ends = np.concatenate(([0], np.cumsum([len(h) for h, _ in made])))
            joined = [
                np.concatenate([np.empty(0, np.int64), *(m[i].astype(np.int64) for m in made)]) for i in (0, 1)
            ]
            return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x)) for x in joined]

        return work

    return map_texts(df, text, fields, setup, keep)


def in_turn(df: DataFrame, id_column: str, text: str, parts: int | None = None) -> DataFrame:
    """Rows of `id`, `text` by descending id (nulls last), cut into ordered partitions that each end
    with the row that begins the next one (`lead`, there true). After the last row comes the first.

    One shuffle moves each text once, but for the rows that begin a partition.
    Ranges come from the ids' quantiles; the ids that begin a partition are found
    from the ids alone. Rows of equal id are ordered by their text, and ids are
    taken whole: all rows of one id meet in one task.
    """
    spark = df.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # A null id goes after all others: by descending id that is the least one.
    key = F.coalesce(name(id_column).cast("long"), F.lit(-(1 << 63)))
    keyed = df.select(
        name(id_column).cast("long").alias("id"),
        F.coalesce(name(text).cast("string"), F.lit("")).alias("text"),
        key.alias("key"),
        key.cast("double").alias("at"),
    )
    steps = [i / parts for i in range(1, parts)]
    cuts = sorted(set(keyed.approxQuantile("at", steps, 0.25 / parts))) if steps else []
    # The partition's number, from 0 for the greatest ids.
    if cuts:
        ranges = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="at", outputCol="range")
        numbered = ranges.transform(keyed).withColumn("part", (F.lit(len(cuts)) - F.col("range")).cast("int"))
    else:
        numbered = keyed.withColumn("part", F.lit(0))
    # At most one row per partition comes to the driver.
    first = {r.part: r.key for r in numbered.groupBy("part").agg(F.max("key").alias("key")).collect()}
    filled = sorted(first)
    before = {p: filled[i - 1] for i, p in enumerate(filled)}  # the first partition's row also ends the last one
    lead_to = F.create_map(*[F.lit(x) for p in filled for x in (first[p], before[p])]) if filled else F.lit(None)
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("lead"))
    if filled:
        copy = F.struct(F.element_at(lead_to, F.col("key")).cast("int").alias("part"), F.lit(True).alias("lead"))
        to = F.when(F.col("key").isin(list(first.values())), F.array(own, copy)).otherwise(F.array(own))
    else:
        to = F.array(own)
    return (
        numbered.withColumn("to", F.explode(to))
        .select("id", "text", "key", F.col("to.part").alias("part"), F.col("to.lead").alias("lead"))
        .repartitionByRange(max(1, len(filled)), "part")
        .sortWithinPartitions("part", "lead", F.desc("key"), F.desc("text"))
    )


def with_next(df: DataFrame, id_column: str = "doc_id", text: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """Per row: the fingerprint of its text, of its edited text, and their likeness, and that to the next row's.

    The next row is the one with the next lower id, after the last the first.
    The edited text has its last floor(n / 2) code points replaced by the first as
    many of the next row's text (all, if it has fewer). A table of one row is its
    own next. Null texts are empty, null ids come last, equal ids go by their
    text; extra columns are not read; an empty table gives no rows.
    """
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_hashes int"

    def run(batches):
        held = None  # the row whose next one is to come
        for batch in batches:
            out = []
            for id_, text_, part, lead in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "part", "lead"))):
                if held is not None and held[4] != part:
                    held = None
                if held is None and lead:
                    continue
                points = code_points(text_)
                hashes, at = select(points, k, window)
                distinct = np.unique(hashes)
                if held is not None:
                    h_id, h_points, h_hashes, h_at, _, h_distinct = held
                    half = len(h_points) // 2
                    edited = np.concatenate((h_points[: len(h_points) - half], points[:half]))
                    e_hashes, e_at = select(edited, k, window)
                    out.append(
                        (
                            h_id,
                            len(h_points),
                            hashlib.sha256(edited.tobytes().decode("utf-32-le").encode()).hexdigest(),
                            digest(h_hashes, h_at),
                            digest(e_hashes, e_at),
                            likeness(h_distinct, np.unique(e_hashes)),
                            likeness(h_distinct, distinct),
                            len(h_hashes),
                        )
                    )
                # one row begins the next partition; further rows with its id and the lead mark are of no use
                held = None if lead else (id_, points, hashes, at, part, distinct)
            if out:
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32()))],
                    names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_hashes"],
                )

    made = in_turn(df, id_column, text).drop("key").mapInArrow(run, schema)
    return made.select(F.col("id").alias(id_column), *[c for c in made.columns if c != "id"])
