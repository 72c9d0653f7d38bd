"""Line dedup by content-defined chunks.

The logical line is a word: passages begin and end inside lines and sentences, so that hashes of
whole lines would meet too few of them. Rolling hashes over word hashes choose the
boundaries, and chunks are runs of words, in one line or over several. One begins where the hash of `WINDOW`
words is less than those of the `REACH` places on either side, so the same
passage is cut alike wherever it stands, in whatever sentence or line. A long
line always ends a chunk on either side, and is cut for itself. Chunks that
occur again anywhere are removed from all places but the first. A run of them
takes in those whole words of the chunks next to it that agree with the chunks
next to its first place, and goes if it has `MIN_WORDS` words. Chunks are
compared by all of their bytes.
"""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import free, name, pieces
from docloom.storage import cut, cut_observed

# A chunk begins where the mixed hash of `WINDOW` words is the least of `REACH` places on either side, so it has over `REACH`
# words; one of over `LONGEST` words (as the same few words over and over) is cut after so many, or fewer by less than `REACH`.
WINDOW, REACH, LONGEST = 2, 4, 24
# A line of so many characters begins and ends a chunk; a shorter chunk is not looked for by itself.
LONG_LINE, SHORTEST = 96, 24
# Chunks next to a run that are compared: its first may have come out otherwise, as its window reaches over the run's start.
NEXT = 2
# A run of repeated chunks goes if it has so many words: a common heading or notice stays. Of scripts that have no spaces
# between words, two characters count as one word.
MIN_WORDS = 32
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
# Bits of the filter that says which hashes may be repeated. It is of this size whatever the table's; a fuller one lets
# more chunks through to the exact comparison, and loses none.
FILTER_BITS = 1 << 27
_MIX, _PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_UNPLACE = np.uint64(pow(int(_PLACE), -1, 1 << 64))
_BYTES = np.random.default_rng(9).integers(1, 1 << 64, 256, np.uint64)
# Bytes that are cut at a time; a longer text by itself.
BLOCK_BYTES = 1 << 18


class Chunks(NamedTuple):
    """Of a list of texts: where each one's chunks begin in the arrays, and per chunk its start and end (code points,
    the separator behind it not included) and its hash."""

    bounds: np.ndarray
    starts: np.ndarray
    stops: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = slice(self.bounds[i], self.bounds[i + 1])
        return self.starts[at], self.stops[at], self.hashes[at]


def chunk_all(texts: list[str]) -> Chunks:
    """Cut all texts, each for itself; a text has one chunk at least."""
    coded = [text.encode() for text in texts]
    made, block, held = [], [], 0
    for data in coded:
        if block and held + len(data) > BLOCK_BYTES:
            made.append(_chunk_block(block))
            block, held = [], 0
        block.append(data)
        held += len(data) + 1
    if block:
        made.append(_chunk_block(block))
    if not made:
        return Chunks(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
    counts = np.concatenate([np.diff(m.bounds) for m in made])
    return Chunks(np.concatenate(([0], np.cumsum(counts))), *(np.concatenate([m[k] for m in made]) for k in (1, 2, 3)))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n - 1, p, np.uint64))), dtype=np.uint64) for p in (_PLACE, _UNPLACE))


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(29))) * _MIX
        return h ^ (h >> np.uint64(32))


def _chunk_block(coded: list[bytes]) -> Chunks:
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    lengths = np.fromiter(map(len, coded), np.int64, len(coded))
    up, down = _powers(max(BLOCK_BYTES + 1, 1 << (len(data) - 1).bit_length()))
    stops = np.flatnonzero((data == 32) | ((data >= 9) & (data <= 13)))  # of the words, in bytes: any white space of ASCII
    starts = np.concatenate(([0], stops[:-1] + 1))
    n = len(stops)
    with np.errstate(over="ignore"):
        # hashes of any bytes from running totals
        totals = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64)))
        words = _mixed((totals[stops] - totals[starts]) * down[starts])
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))  # code points before a byte
    last = np.searchsorted(stops, np.cumsum(lengths + 1) - 1)  # of each text, its last word
    head = np.concatenate(([0], last[:-1] + 1))
    # a long line begins and ends a chunk, and so does a text
    line_end = np.flatnonzero(data[stops] == 10)
    line = np.concatenate(([0], line_end[:-1] + 1))
    long = chars[stops[line_end]] - chars[starts[line]] >= LONG_LINE
    begins = np.zeros(n + 1, bool)
    begins[line[long]] = begins[line_end[long] + 1] = True
    begins[head] = begins[n] = True
    # least hashes around each place; none is chosen within `REACH` of where a line or text is cut anyway
    part = np.cumsum(begins[:n])
    at = np.arange(n) + REACH * part
    with np.errstate(over="ignore"):
        rolling = words.copy()
        for k in range(1, min(WINDOW, n)):
            rolling[:-k] += np.where(part[k:] == part[:-k], words[k:], np.uint64(0)) * _PLACE ** np.uint64(k)
    rolling = _mixed(rolling)
    padded = np.zeros(n + REACH * (int(part[-1]) + 1), np.uint64)
    padded[at] = rolling
    least = np.ones(len(padded) - 2 * REACH, bool)
    middle = padded[REACH : len(padded) - REACH]
    for k in range(1, REACH + 1):
        least &= middle < padded[REACH + k : len(padded) - REACH + k]
        least &= middle <= padded[REACH - k : len(padded) - REACH - k]
    begins[:n] |= least[at - REACH]
    first = np.flatnonzero(begins[:n])
    parts = np.diff(np.append(first, n))
    if parts.max() > LONGEST:
        # after the least of the last places, so that pieces of a few words over and over begin with the same of them
        for begin, end in zip(first[parts > LONGEST].tolist(), (first + parts)[parts > LONGEST].tolist()):
            while end - begin > LONGEST:
                begin += LONGEST - int(np.argmin(rolling[begin + LONGEST : begin + LONGEST - REACH : -1]))
                begins[begin] = True
        first = np.flatnonzero(begins[:n])
    begin, end = starts[first], stops[np.append(first[1:], n) - 1]
    with np.errstate(over="ignore"):
        hashes = _mixed((totals[end] - totals[begin]) * down[begin])
    bounds = np.append(np.searchsorted(first, head), len(first))
    base = np.repeat(chars[starts[head]], np.diff(bounds))
    return Chunks(bounds, chars[begin] - base, chars[end] - base, hashes)


def chunks(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of each chunk of one text."""
    return chunk_all([text]).of(0)


def neighbour(starts: list[int], stops: list[int], k: int, side: int) -> slice:
    """Where the `NEXT` chunks before (-1) or after (1) chunk `k` stand; short ones in between do not count."""
    far = at = k + side
    long = 0
    while 0 <= at < len(starts) and long < NEXT:
        long += stops[at] - starts[at] >= SHORTEST
        far, at = at, at + side
    if not 0 <= far < len(starts):
        return slice(0, 0)
    return slice(starts[far], stops[k - 1]) if side < 0 else slice(starts[k + 1], stops[far])


def _probes(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places in the filter per hash."""
    with np.errstate(over="ignore"):
        bits = np.uint64(FILTER_BITS - 1)
        return hashes & bits, (hashes * _MIX >> np.uint64(20)) & bits


def _keyed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """Each document (`id`, `text_hash`, `text`) once, however many rows it has."""
    ident, text_hash = name(id_column).cast("long").alias("id"), F.xxhash64(name(text)).alias("text_hash")
    again, seen = cut_observed(
        df.select(ident, text_hash).groupBy("id", "text_hash").count().filter("count > 1"), "line-rows", F.count(F.lit(1)).alias("n")
    )
    rows = df.select(ident, text_hash, F.coalesce(name(text).cast("string"), F.lit("")).alias("text"))
    if not seen["n"]:
        return rows
    # only texts of repeated rows are moved, and one of each per task
    known = again.select(F.col("id").alias("a_id"), F.col("text_hash").alias("a_hash"))
    same = F.col("id").eqNullSafe(F.col("a_id")) & (F.col("text_hash") == F.col("a_hash"))
    first = rows.join(known, same, "left_semi").groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    return rows.join(known, same, "left_anti").unionByName(first)


def fixed_filter(hashes: DataFrame) -> np.ndarray:
    """`FILTER_BITS` bits, set where a hash of the one long column falls.

    Tasks turn hashes into words of bits; these, of a bounded number, come to the driver.
    """

    def places(batches):
        for batch in batches:
            at = np.concatenate(_probes(np.asarray(batch.column(0)).view(np.uint64)))
            words, bits = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    words = hashes.mapInArrow(places, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[np.asarray(words.column("word"))] = np.asarray(words.column("bits")).view(np.uint64)
    return out


def passes(allowed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes the filter lets through: all that were put in, and some more."""
    may = np.ones(len(hashes), bool)
    for at in _probes(hashes):
        may &= (allowed[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
    return may


def repeat_filter(df: DataFrame, text: str = "text") -> np.ndarray:
    """The filter of all hashes of chunks that are met more than once, counted with partial counts per task."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, 0):
                found = chunk_all(piece.column(0).to_pylist())
                kept = found.hashes[found.stops - found.starts >= SHORTEST]
                yield pa.RecordBatch.from_arrays([pa.array(kept.view(np.int64))], names=["hash"])

    texts = df.select(F.coalesce(name(text).cast("string"), F.lit("")).alias("text"))
    return fixed_filter(texts.mapInArrow(run, "hash long").groupBy("hash").count().filter("count > 1").select("hash"))


def _passing(df: DataFrame, column: str, allowed: np.ndarray) -> DataFrame:
    """The rows of `df` whose `column`, a long hash, passes the filter."""
    shared = df.sparkSession.sparkContext.broadcast(allowed)
    at = df.columns.index(column)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(passes(shared.value, np.asarray(batch.column(at)).view(np.uint64))))

    return df.mapInArrow(run, df.schema)


def candidates(df: DataFrame, id_column: str, text: str, allowed: np.ndarray) -> DataFrame:
    """Chunks that may be repeated: the document's key, the chunk's number `n` and start, its hash and bytes, and the chunks
    `before` and `after` it, where the one next to it is none that may be repeated and so has no row of its own."""
    source = _keyed(df, id_column, text)
    shared = df.sparkSession.sparkContext.broadcast(allowed)
    schema = T.StructType(
        [*source.schema.fields[:2], T.StructField("n", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("hash", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("chunk", "before", "after")]
    )

    def run(batches):
        bits = shared.value
        for batch in batches:
            for piece in pieces(batch, 2):
                rows, n, at, hashes, parts, before, after = [], [], [], [], [], [], []
                texts = piece.column(2).to_pylist()
                cut_up = chunk_all(texts)
                all_may = passes(bits, cut_up.hashes) & (cut_up.stops - cut_up.starts >= SHORTEST)
                owners = np.repeat(np.arange(len(texts)), np.diff(cut_up.bounds))
                for r in np.unique(owners[all_may]).tolist():
                    value = texts[r]
                    starts, stops, made = (x.tolist() for x in cut_up.of(r))
                    may = all_may[cut_up.bounds[r] : cut_up.bounds[r + 1]]
                    chosen, may = np.flatnonzero(may).tolist(), may.tolist()
                    for k in chosen:
                        rows.append(r)
                        n.append(k)
                        at.append(starts[k])
                        hashes.append(made[k])
                        parts.append(value[starts[k] : stops[k]])
                        before.append(None if k and may[k - 1] else value[neighbour(starts, stops, k, -1)])
                        after.append(None if k + 1 < len(may) and may[k + 1] else value[neighbour(starts, stops, k, 1)])
                taken = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(taken), piece.column(1).take(taken), pa.array(n, pa.int32()), pa.array(at, pa.int32()),
                     pa.array(np.array(hashes, np.uint64).view(np.int64)), *(pa.array(x, pa.string()) for x in (parts, before, after))],
                    names=schema.fieldNames(),
                )

    return source.mapInArrow(run, schema)


def repeated(df: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document that has chunks which occur earlier: its key (`id`, `text_hash`) and `repeats`, with the start and
    end of each and, at the ends of a run of them, the chunks next to its first place.

    Occurrences are in the order of id (null first), hash of the text and place; the first is not returned.
    """
    key = ["id", "text_hash"]
    found = cut(candidates(df, id_column, text, repeat_filter(df, text)), "line-candidates")
    place = F.struct(*key, "n")
    # Equal bytes meet in one group, after as many groups per task have been combined.
    same_bytes = (
        found.groupBy("hash", "chunk")
        .agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))
        .select("hash", F.xxhash64("chunk").alias("second"), "first", "times")
    )
    # From here on a chunk goes by two hashes. Chunks of the same two but other bytes, should there ever be any, are not
    # taken for each other: none of them goes.
    firsts = (
        same_bytes.groupBy(F.col("hash").alias("f_hash"), F.col("second").alias("f_second"))
        .agg(F.count(F.lit(1)).alias("variants"), F.first("first").alias("first"), F.first("times").alias("times"))
        .filter("variants = 1 AND times > 1")
        .select("f_hash", "f_second", "first")
    )
    # Written, and with one row per chunk: adaptive execution splits a chunk that many documents share.
    firsts = cut(firsts, "line-firsts")
    same = (F.col("hash") == F.col("f_hash")) & (F.col("second") == F.col("f_second"))
    span = [F.col("start"), (F.col("start") + F.char_length("chunk")).alias("stop")]
    again = found.select(*key, "n", *span, "hash", F.xxhash64("chunk").alias("second")).join(firsts, same).filter(place != F.col("first"))
    # Windows within one document's chunks.
    in_turn = Window.partitionBy(*key).orderBy("n")
    lag = lambda c, k=1: F.lag(c, k).over(in_turn)
    lead = lambda c, k=1: F.lead(c, k).over(in_turn)
    begins, ends = lag("n"), lead("n")
    again = cut(
        again.select(*key, "start", "stop", "first", (begins.isNull() | (begins != F.col("n") - 1)).alias("begins"), (ends.isNull() | (ends != F.col("n") + 1)).alias("ends")),
        "line-again",
    )
    # What stands next to those first places that a run ends at: only they and their neighbours are brought together.
    asked = again.filter("begins OR ends").select("first").distinct()
    near = asked.select(F.explode(F.array(*[F.xxhash64("first.id", "first.text_hash", F.col("first.n") + F.lit(k)) for k in range(-NEXT, NEXT + 1)])))
    around = _passing(found.select(*key, "n", "chunk", "before", "after", F.xxhash64(*key, "n").alias("at")), "at", fixed_filter(near)).select(
        place.alias("place"),
        # where the next chunk has a row of its own, that one and what stands next to it
        F.coalesce("before", F.concat_ws(" ", F.coalesce(lag("before"), lag("chunk", 2)), lag("chunk"))).alias("before"),
        F.coalesce("after", F.concat_ws(" ", lead("chunk"), F.coalesce(lead("after"), lead("chunk", 2)))).alias("after"),
    )
    outer = again.filter("begins OR ends").join(around, F.col("first") == F.col("place"))
    none = F.lit(None).cast("string")
    marks = outer.select(*key, "start", "stop", F.when(F.col("begins"), F.col("before")).alias("before"), F.when(F.col("ends"), F.col("after")).alias("after"))
    inner = again.filter("NOT (begins OR ends)").select(*key, "start", "stop", none.alias("before"), none.alias("after"))
    # No more marks than the document has chunks.
    return marks.unionByName(inner).groupBy(*key).agg(F.collect_list(F.struct("start", "stop", "before", "after")).alias("repeats"))


def _alike(a: str, b: str) -> bool:
    """The same character; any white space for any other."""
    return a == b or (a.isspace() and b.isspace())


def _agree_before(text: str, stop: int, context: str) -> int:
    """Where the whole words begin that stand before `stop` and its separator, and end `context` alike."""
    at, n = stop - 1, 0
    most = min(at, len(context))
    while n < most and _alike(text[at - 1 - n], context[-1 - n]):
        n += 1
    # not within a word, of either text
    if (n < at and not text[at - 1 - n].isspace()) or (n < len(context) and not context[-1 - n].isspace()):
        while n and not text[at - n].isspace():
            n -= 1
    return at - n if n else stop


def _agree_after(text: str, start: int, context: str) -> int:
    """Where the whole words end that stand after `start` and its separator, and begin `context` alike."""
    at, n = start + 1, 0
    most = min(len(text) - at, len(context))
    while n < most and _alike(text[at + n], context[n]):
        n += 1
    if (at + n < len(text) and not text[at + n].isspace()) or (n < len(context) and not context[n].isspace()):
        while n and not text[at + n - 1].isspace():
            n -= 1
    return at + n if n > 0 else start


def count_words(text: str) -> int:
    return len(text.split()) + (0 if text.isascii() else len(_UNSPACED.findall(text)) // 2)


def strip_runs(text: str, repeats: list[tuple[int, int, str | None, str | None]], min_words: int = MIN_WORDS) -> tuple[str, int]:
    """The text without those runs of repeated chunks that have enough words, and the number of runs removed.

    `repeats`: start and end of each repeated chunk, and what stands next to its first place.
    """
    spans: list[list[int]] = []
    for a, b, before, after in sorted(repeats, key=lambda r: r[0]):
        if before:
            a = _agree_before(text, a, before)
        if after:
            b = _agree_after(text, b, after)
        # only white space, and chunks too short to be looked for, may lie between two parts of a run
        if spans and not text[spans[-1][1] : a].strip():
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    gone = [(a, b) for a, b in spans if count_words(text[a:b]) >= min_words]
    if not gone:
        return text, 0
    out, at = "", 0
    for a, b in [*gone, (len(text), len(text))]:
        part = text[at:a]
        if at:
            # of the white space on both sides of a removed run, that of one side is enough
            part = part.lstrip(" ")
            if part.startswith("\n") and (not out or out.endswith("\n")):
                part = part[1:]
            elif out and part and not out[-1].isspace() and not part[0].isspace():
                out += " "
        out, at = out + part, b
    return out, len(gone)


def dedup_lines(df: DataFrame, id_column: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, count: str | None = None) -> DataFrame:
    """The rows of `df`, all columns, `text` without repeated chunks; with `count`, also how many runs were removed.

    A repetition counts within a document, too. Null texts stay null. Documents
    that are equal in id and text are one document: repeated rows are cleaned alike
    and none of them is a repetition of another. A text all of whose chunks go
    is left empty. An empty table gives no rows; a column named as `count` is replaced.
    """
    marks = repeated(df, id_column, text).select(F.col("id").alias("m_id"), F.col("text_hash").alias("m_hash"), "repeats")
    kept = [c for c in df.columns if c.lower() != str(count).lower()]
    rows = df.select(
        F.struct(*map(name, kept)).alias("row"), name(id_column).cast("long").alias("id"), F.xxhash64(name(text)).alias("text_hash")
    )
    same = F.col("id").eqNullSafe(F.col("m_id")) & (F.col("text_hash") == F.col("m_hash"))
    joined = rows.join(marks, same, "left").select("row.*", F.col("repeats").alias(free("repeats", kept)))
    at, last = kept.index(text), len(kept)
    schema = T.StructType([*(df.schema[c] for c in kept), *([T.StructField(count, T.IntegerType())] if count else [])])

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, at):
                made = [
                    (t, 0) if not r or t is None else strip_runs(t, [(m["start"], m["stop"], m["before"], m["after"]) for m in r], min_words)
                    for t, r in zip(piece.column(at).to_pylist(), piece.column(last).to_pylist())
                ]
                columns = list(piece.columns[:last])
                columns[at] = pa.array([m[0] for m in made], pa.string())
                columns += [pa.array([m[1] for m in made], pa.int32())] if count else []
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return joined.mapInArrow(run, schema)
