"""Removal of byte strings that a document with a smaller id has, too, found on a Burrows-Wheeler transform.

No task can hold the suffixes of all texts, so windows of `least` bytes are first dealt
by content: each goes by its anchor, the least hash of its grams of `GRAM` bytes, so
that equal windows go to the same place, wherever they stand. Runs of windows of one
anchor are one segment. Anchors that only one document has are left out (per anchor
four bytes are exchanged to know this); segments of all others go to buckets of
bounded size, equal ones once per pack of documents.

Per bucket the suffixes of its segments are sorted and transformed. Breadth-first
backward extension then visits the intervals of rows that share a prefix of 1, 2, 3 ...
bytes; each interval that ends where no shorter one did bounds two rows whose
common prefix is one byte shorter. It stops at `least`: rows without a bound between
them share at least that many bytes, and the least id among them decides.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.batches import groups, name
from docloom.storage import cut, cut_observed, fresh_path

LEAST, GRAM = 50, 20
# Bytes of text in a pack, anchors in a part, bytes of segments in a bucket; windows in a segment.
PACK, PART, BUCKET, LONGEST = 8 << 20, 1 << 20, 2 << 20, 1024
# An anchor in more documents than this is dealt window by window.
HOT = 1 << 16
# Odd multipliers.
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD)]
_BLOCK = 1 << 17


# Suffix order and bounded common prefixes


def suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the rank of each. 0 is a separator, the last symbol is one; each differs from all others, by place."""
    n, first_symbols = len(symbols), 7
    key, alive = np.zeros(n, np.uint64), np.ones(n, bool)
    for t in range(min(n, first_symbols)):
        s = np.zeros(n, np.uint64)
        s[: n - t] = symbols[t:]
        s[~alive] = 0
        key = key << np.uint64(9) | s
        alive &= s > 0
    order = np.argsort(key, kind="stable")
    in_order = key[order]
    first = np.ones(n, bool)
    first[1:] = in_order[1:] != in_order[:-1]
    # what meets a separator is told apart by its place
    first |= ~alive[order]
    rank, places, length = np.empty(n, np.int64), np.arange(n), first_symbols
    start = np.maximum.accumulate(np.where(first, places, 0))
    rank[order] = start
    open_ = np.flatnonzero(~first | np.append(~first[1:], False))
    while len(open_):
        of, began = order[open_], start[open_]
        second = rank[of + length]
        turn = np.argsort(began * n + second, kind="stable")
        of, second = of[turn], second[turn]
        order[open_] = of
        new = np.ones(len(open_), bool)
        new[1:] = (began[1:] != began[:-1]) | (second[1:] != second[:-1])
        start[open_] = np.maximum.accumulate(np.where(new, open_, 0))
        rank[of] = start[open_]
        more = ~new | np.append(~new[1:], False)
        open_, length = open_[more], 2 * length
    return order, rank


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., then those of starts[1], and so on."""
    ends = np.cumsum(sizes, dtype=np.int64)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def prefix_bounds(symbols: np.ndarray, order: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """For each row whether it shares fewer than `least` symbols with the row before it.

    A queue holds the intervals of one prefix length whose end was not yet a bound.
    Extended to the left by each symbol that stands before their rows, they give the
    intervals of the next length; of these, ends that are no bound yet become one.
    """
    n = len(symbols)
    first = np.append(symbols[order], np.uint16(0xFFFF))
    before = symbols[order - 1]
    # the row after that of the suffix one longer to the left; 0, which is a bound, where a separator stands there
    left = (rank[order - 1] + 1).astype(np.int32)
    left[before == 0] = 0
    right = np.append(rank[(order + 1) % n], n).astype(np.int32)
    bound = np.zeros(n + 1, bool)
    bound[[0, n]] = True
    bound[1:n] = (first[1:n] != first[: n - 1]) | (first[: n - 1] == 0)
    bounds = np.flatnonzero(bound).astype(np.int32)
    ends, begins = bounds[1:], bounds[:-1]
    for _ in range(2, least + 1):
        alone = ends - begins == 1
        found = left[begins[alone]]
        begins, ends = begins[~alone], ends[~alone]
        if len(ends):
            sizes = ends - begins
            rows, end = _ranges(begins, sizes), np.repeat(ends, sizes)
            after = left[rows]
            # the last row of its symbol: the next one has another symbol, or comes from beyond the interval
            last = (right[after] >= end) | (first[after] != before[rows])
            found = np.concatenate((found, after[last]))
        ends = np.sort(found[~bound[found]])
        if not len(ends):
            break
        bound[ends] = True
        bounds = np.flatnonzero(bound).astype(np.int32)
        begins = bounds[np.searchsorted(bounds, ends) - 1]
    return bound[:n]


def repeated_windows(texts: list[bytes], ids: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Places in the joined texts (one byte between them) where a window of `least` bytes starts
    that also starts in a text with a smaller id."""
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + np.uint16(1)
    ends = np.cumsum([len(t) + 1 for t in texts])
    joined[ends - 1] = 0
    order, rank = suffix_order(joined)
    bound = prefix_bounds(joined, order, rank, least)
    id_of_row = np.repeat(ids, np.diff(ends, prepend=0))[order]
    starts = np.flatnonzero(bound)
    smallest = np.repeat(np.minimum.reduceat(id_of_row, starts), np.diff(np.append(starts, len(bound))))
    return np.sort(order[smallest < id_of_row])


# Packs of documents and their anchors


class Pack:
    """The different texts of a pack that can have repeated windows, joined, each with its least id."""

    def __init__(self, ids: list[int | None], texts: list[bytes], least: int):
        same: dict[bytes, int] = {}
        for id_, text in zip(ids, texts):
            if id_ is not None and len(text) >= least:
                same[text] = min(id_, same.get(text, id_))
        self.least_bytes = least
        self.number = {text: k for k, text in enumerate(same)}
        self.ids = np.array(list(same.values()), np.int64)
        self.data = b"".join(same)
        self.ends = np.cumsum([len(t) for t in same], dtype=np.int64)

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows of one anchor: the first window's place, that after the last one's, and the anchor."""
        data, least = np.frombuffer(self.data, np.uint8), self.least_bytes
        starts, stops, keys = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        edges = np.unique(np.concatenate((self.ends, self.ends - least + 1))) if len(self.ends) else self.ends
        for at in range(0, len(data) - least + 1, _BLOCK):
            key = anchors(data[at : at + _BLOCK + least - 1], least)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            inside = edges[np.searchsorted(edges, at) : np.searchsorted(edges, at + len(key))]
            new[inside - at] = True
            new[::LONGEST] = True
            start = np.flatnonzero(new)
            stop = np.append(start[1:], len(key))
            valid = start + at + least <= self.ends[np.searchsorted(self.ends, start + at, "right")]
            starts.append(start[valid] + at)
            stops.append(stop[valid] + at)
            keys.append(key[start[valid]])
        return np.concatenate(starts), np.concatenate(stops), _mixed(np.concatenate(keys))

    def document(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def anchors(data: np.ndarray, least: int) -> np.ndarray:
    """Per window of `least` bytes the least hash of its grams, of GRAM bytes or, in a shorter window, all."""
    gram = min(GRAM, least)
    n = len(data) - gram + 1
    with np.errstate(over="ignore"):
        if gram >= 8:
            padded = np.concatenate((data, np.zeros(16, np.uint8)))
            words = np.empty(len(data) + 8, np.uint64)
            for o in range(8):
                part = padded[o : o + (len(padded) - o) // 8 * 8].view("<u8")
                words[o::8] = part[: len(words[o::8])]
            key = words[:n] * _ODD[0]
            for o in [*range(8, gram - 8, 8), gram - 8]:
                key = (key ^ (key >> np.uint64(29))) * _ODD[1] + words[o : o + n] * _ODD[2]
        else:
            key = np.zeros(n, np.uint64)
            for o in range(gram):
                key = (key + data[o : o + n]) * _ODD[0]
        key = _mixed(key)
    size, width = 1, least - gram + 1
    while size < width:
        shift = min(size, width - size)
        key = np.minimum(key[: len(key) - shift], key[shift:])
        size += shift
    return key


def _mixed(key: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = (key ^ (key >> np.uint64(32))) * _ODD[3]
        return key ^ (key >> np.uint64(29))


def _codes(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that an anchor is counted in, and 32 bits that stand for it there."""
    return (keys >> np.uint64(40)) % np.uint64(parts) << np.uint64(32) | keys & np.uint64(0xFFFFFFFF)


def packed(df: DataFrame, id_column: str, text: str, pack: int) -> DataFrame:
    """All rows as packs of some `pack` bytes (`pack`, `ids`, `texts`), in a table bucketed by pack, so that what
    is found out about a pack can be joined to it without moving texts."""
    spark = df.sparkSession
    rows = df.select(name(id_column).cast("long").alias("id"), F.coalesce(name(text).cast("string"), F.lit("")).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = min(100_000, max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / pack)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size, number = [], [], 0, TaskContext.get().partitionId() << 32

        def full():
            arrays = [pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([texts], pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(arrays, names=["pack", "ids", "texts"])

        for batch in batches:
            for id_, text_ in zip(batch.column(0).to_pylist(), batch.column(1)):
                value = text_.as_py()
                if texts and size + len(value) > pack:
                    yield full()
                    ids, texts, size, number = [], [], 0, number + 1
                ids.append(id_)
                texts.append(value)
                size += len(value)
        if texts:
            yield full()

    table = f"docloom_packs_{uuid.uuid4().hex}"
    made = rows.mapInArrow(run, "pack long, ids array<long>, texts array<binary>")
    made.write.format("parquet").bucketBy(buckets, "pack").option("path", fresh_path(spark, "packs")).saveAsTable(table)
    return spark.table(table)


def _with_replies(packs: DataFrame, replies: DataFrame, columns: list[str]) -> DataFrame:
    """Documents of packs, in order; the first of each pack has the pack's `replies`."""
    told = replies.groupBy("pack").agg(F.collect_list(F.struct(*columns)).alias("replies")).withColumnRenamed("pack", "of")
    joined = packs.join(told.hint("shuffle_hash"), F.col("pack") == F.col("of"), "left")
    return _documents(joined, F.col("replies"))


def _documents(packs: DataFrame, replies) -> DataFrame:
    one = packs.select("pack", replies.alias("told"), F.posexplode(F.arrays_zip("ids", "texts")).alias("at", "row"))
    return one.select("pack", "row.ids", "row.texts", F.when(F.col("at") == 0, F.col("told")).alias("replies"))


def _packs_of(batches: Iterator[pa.RecordBatch], least: int):
    """Per pack: its number, ids, texts, what is joined, and the replies."""
    for table in groups(batches, 1):
        ids, texts = table.column("ids").to_pylist(), table.column("texts").to_pylist()
        replies = table.column("replies")[0].as_py() or []
        yield table.column("pack")[0].as_py(), ids, texts, Pack(ids, texts, least), replies


def _rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns.values()], names=list(columns))


def repeated_anchors(packs: DataFrame, least: int, parts: int, hot: int) -> DataFrame:
    """Per pack and part: a bit per anchor of the pack, in order, whether two documents have it; and which ones over `hot` have."""

    def ask(batches):
        for number, _, _, pack, _ in _packs_of(batches, least):
            start, _, keys = pack.runs()
            codes, of = np.unique(_codes(keys, parts), return_inverse=True)
            if not len(codes):
                continue
            pairs = np.unique(of.astype(np.int64) * len(pack.ids) + pack.document(start)) // len(pack.ids)
            documents = np.bincount(pairs, minlength=len(codes))
            part, edge = np.unique(codes >> np.uint64(32), return_index=True)
            edge = [*edge.tolist(), len(codes)]
            low, cells = codes.astype(np.uint32), list(zip(edge, edge[1:]))
            more = [np.flatnonzero(documents[a:b] > 1) for a, b in cells]
            yield _rows({
                "part": (part.astype(np.int64), pa.int64()), "pack": ([number] * len(cells), pa.int64()),
                "low": ([low[a:b].tobytes() for a, b in cells], pa.binary()),
                "more": ([m.astype(np.uint32).tobytes() for m in more], pa.binary()),
                "documents": ([documents[a:b][m].astype(np.uint32).tobytes() for (a, b), m in zip(cells, more)], pa.binary()),
            })

    asked = _documents(packs, F.lit(None).cast("string")).mapInArrow(ask, "part long, pack long, low binary, more binary, documents binary")

    def answer(batches):
        for table in groups(batches, 1):
            lows = [np.frombuffer(x, np.uint32) for x in table.column("low").to_pylist()]
            counts = [np.ones(len(x), np.int64) for x in lows]
            for count, more, documents in zip(counts, table.column("more").to_pylist(), table.column("documents").to_pylist()):
                count[np.frombuffer(more, np.uint32)] = np.frombuffer(documents, np.uint32)
            _, of = np.unique(np.concatenate(lows), return_inverse=True)
            total = np.bincount(of, np.concatenate(counts))[of]
            edges = np.cumsum([0, *map(len, lows)]).tolist()
            cells = [total[a:b] for a, b in zip(edges, edges[1:])]
            rows = [(p, c) for p, c in zip(table.column("pack").to_pylist(), cells) if c.max() > 1]
            yield _rows({
                "pack": ([p for p, _ in rows], pa.int64()), "part": (table.column("part").to_pylist()[: len(rows)], pa.int64()),
                "known": ([np.packbits(c > 1).tobytes() for _, c in rows], pa.binary()),
                "hot": ([np.flatnonzero(c > hot).astype(np.uint32).tobytes() for _, c in rows], pa.binary()),
                "n": ([int((c > 1).sum()) for _, c in rows], pa.int64()),
            })

    dealt = asked.repartition(parts, "part").sortWithinPartitions("part", "pack")
    return dealt.mapInArrow(answer, "pack long, part long, known binary, hot binary, n long")


def segments(packs: DataFrame, known: DataFrame, least: int, parts: int, buckets: int) -> DataFrame:
    """Per pack and bucket: the different segments, and where they stand (`segment`, `place`, the document's `id`)."""

    def run(batches):
        for number, _, _, pack, replies in _packs_of(batches, least):
            if not replies:
                continue
            start, stop, keys = pack.runs()
            codes, of = np.unique(_codes(keys, parts), return_inverse=True)
            repeated, hot = np.zeros(len(codes), bool), np.zeros(len(codes), bool)
            for r in replies:
                a, b = np.searchsorted(codes, [r["part"] << 32, (r["part"] + 1) << 32])
                repeated[a:b] = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=b - a).astype(bool)
                hot[a + np.frombuffer(r["hot"], np.uint32)] = True
            cool, single = repeated[of] & ~hot[of], hot[of]
            # windows of hot anchors one by one, by their own content
            alone = _ranges(start[single], (stop - start)[single])
            begin = np.concatenate((start[cool], alone))
            end = np.concatenate((stop[cool] + least - 1, alone + least))
            ids = pack.ids[pack.document(begin)]
            data, seen, content, which = pack.data, {}, [], np.empty(len(begin), np.int64)
            for k, (a, b) in enumerate(zip(begin.tolist(), end.tolist())):
                segment = data[a:b]
                which[k] = seen.setdefault(segment, len(seen))
            content = list(seen)
            by = _mixed(keys[cool] * _ODD[0])
            bucket = np.empty(len(content), np.int64)
            bucket[which[: len(by)]] = by % np.uint64(buckets)
            for k in np.unique(which[len(by) :]).tolist():
                bucket[k] = hash_of(content[k]) % buckets
            order = np.argsort(bucket[which], kind="stable")
            begin, ids, which = begin[order], ids[order], which[order]
            found, edge = np.unique(bucket[which], return_index=True)
            edge = [*edge.tolist(), len(which)]
            rows = {c: [] for c in ("content", "lengths", "segment", "place", "id")}
            for a, b in zip(edge, edge[1:]):
                own, at = np.unique(which[a:b], return_inverse=True)
                parts_ = [content[k] for k in own.tolist()]
                rows["content"].append(b"".join(parts_))
                rows["lengths"].append(np.array([len(x) for x in parts_], np.uint32).tobytes())
                rows["segment"].append(at.astype(np.uint32).tobytes())
                rows["place"].append(begin[a:b].astype(np.uint32).tobytes())
                rows["id"].append(ids[a:b].tobytes())
            yield _rows({
                "bucket": (found, pa.int64()), "pack": ([number] * len(found), pa.int64()), **{c: (v, pa.binary()) for c, v in rows.items()}
            })

    told = _with_replies(packs, known, ["part", "known", "hot"])
    return told.mapInArrow(run, "bucket long, pack long, content binary, lengths binary, segment binary, place binary, id binary")


def hash_of(window: bytes) -> int:
    """A bucket number's source for a window that goes by its own content."""
    padded = np.frombuffer(window + bytes(-len(window) % 8), "<u8")
    made = np.uint64(len(window))
    with np.errstate(over="ignore"):
        for word in padded:
            made = (made ^ word) * _ODD[1]
            made ^= made >> np.uint64(31)
    return int(made)


def removed_spans(segments_: DataFrame, least: int, tasks: int) -> DataFrame:
    """Per pack and bucket: the start and end of removed bytes in the pack."""

    def run(batches):
        for table in groups(batches, 1):
            seen: dict[bytes, int] = {}
            which, places, ids, lengths, owner = [], [], [], [], []
            for k, row in enumerate(table.to_pylist()):
                length = np.frombuffer(row["lengths"], np.uint32).astype(np.int64)
                ends = np.cumsum(length).tolist()
                number = np.array([seen.setdefault(row["content"][a:b], len(seen)) for a, b in zip([0, *ends], ends)], np.int64)
                segment = np.frombuffer(row["segment"], np.uint32)
                which.append(number[segment])
                lengths.append(length[segment])
                places.append(np.frombuffer(row["place"], np.uint32).astype(np.int64))
                ids.append(np.frombuffer(row["id"], np.int64))
                owner.append(np.full(len(segment), k))
            which, places, ids, lengths, owner = map(np.concatenate, (which, places, ids, lengths, owner))
            smallest = np.full(len(seen), np.iinfo(np.int64).max)
            np.minimum.at(smallest, which, ids)
            texts = list(seen)
            found = repeated_windows(texts, smallest, least)
            # runs of windows per segment, from its begin on
            begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
            first = np.ones(len(found), bool)
            first[1:] = found[1:] != found[:-1] + 1
            a = found[first]
            b = found[np.append(first[1:], True)[: len(found)]] + least
            segment = np.searchsorted(begins, a, "right") - 1
            edge = np.searchsorted(segment, np.arange(len(texts) + 1))
            # those with the smallest id lose what others have; all others the whole segment
            whole = ids > smallest[which]
            n = np.where(whole, 0, edge[which + 1] - edge[which])
            run_ = _ranges(edge[which], n)
            by = np.repeat(np.arange(len(which)), n)
            shift = places[by] - begins[segment[run_]]
            start = np.concatenate((places[whole], a[run_] + shift))
            stop = np.concatenate(((places + lengths)[whole], b[run_] + shift))
            owner = np.concatenate((owner[whole], owner[by]))
            order = np.argsort(owner, kind="stable")
            spans = np.stack((start, stop), 1)[order].astype(np.uint32)
            has, edge = np.unique(owner[order], return_index=True)
            edge = [*edge.tolist(), len(order)]
            packs = table.column("pack").to_pylist()
            yield _rows({
                "pack": ([packs[k] for k in has.tolist()], pa.int64()),
                "spans": ([spans[x:y].tobytes() for x, y in zip(edge, edge[1:])], pa.binary()),
            })

    dealt = segments_.repartition(tasks, "bucket").sortWithinPartitions("bucket", "pack")
    return dealt.mapInArrow(run, "pack long, spans binary")


def merged(spans: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Starts and ends of the union of `spans`, adjoining ones joined unless a document begins between them."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.ones(len(spans), bool)
    first[1:] = (spans[1:, 0] > reach[:-1]) | ((spans[1:, 0] > spans[:-1, 0]) & np.isin(spans[1:, 0], begins))
    return np.stack((spans[first, 0], reach[np.append(first[1:], True)[: len(spans)]]), 1)


def dedup_substrings(
    df: DataFrame, id_column: str = "doc_id", text: str = "text", least: int = LEAST, pack: int = PACK, part: int = PART, bucket: int = BUCKET, hot: int = HOT
) -> DataFrame:
    """Per row of `df`: its id, `n_bytes`, `spans` (start and end of each maximal removed run of UTF-8 bytes, end
    exclusive) and `kept`, the other bytes, which need not be whole characters.

    Removed is each byte covered by a string of `least` bytes that also starts in a
    row with a smaller id, judged on the texts as given. Null texts are empty. A null
    id is neither smaller nor greater than any: such rows keep all, and take nothing
    from others. Rows of one id lose nothing to each other. Texts shorter than `least`
    stay whole; other columns are not read; an empty table gives no rows.
    """
    if least < 1:
        raise ValueError("least must be positive")
    packs = packed(df, id_column, text, pack)
    size = packs.select(F.sum(F.aggregate("texts", F.lit(0).cast("long"), lambda n, t: n + F.octet_length(t)))).first()[0] or 0
    parts = max(1, math.ceil(2 * size / max(1, least - GRAM + 2) / part))
    known, seen = cut_observed(repeated_anchors(packs, least, parts, hot), "suffix-known", F.sum("n").alias("n"))
    buckets = max(1, math.ceil((seen["n"] or 0) * 1.4 * least / bucket))
    tasks = max(1, buckets // 4, min(buckets, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    spans = cut(removed_spans(segments(packs, known, least, parts, buckets), least, tasks), "suffix-spans")

    def run(batches):
        for _, ids, texts, pack_, replies in _packs_of(batches, least):
            begins = np.concatenate(([0], pack_.ends))
            spans_ = [np.frombuffer(r["spans"], np.uint32).reshape(-1, 2) for r in replies]
            cuts = merged(np.concatenate([np.empty((0, 2), np.uint32), *spans_]), begins)
            edge = np.searchsorted(cuts[:, 0], begins)
            out, size_ = [], 0
            for id_, text_ in zip(ids, texts):
                k = pack_.number.get(text_) if id_ is not None else None
                own = []
                if k is not None:
                    own = [[0, len(text_)]] if id_ > pack_.ids[k] else (cuts[edge[k] : edge[k + 1]] - begins[k]).tolist()
                at, kept = 0, []
                for a, b in own:
                    kept.append(text_[at:a])
                    at = b
                kept.append(text_[at:])
                out.append((id_, len(text_), [{"start": a, "stop": b} for a, b in own], b"".join(kept)))
                size_ += len(text_)
                if size_ >= 4 << 20:
                    yield _result(out)
                    out, size_ = [], 0
            if out:
                yield _result(out)

    made = _with_replies(packs, spans, ["spans"]).mapInArrow(run, "id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary")
    return made.select(F.col("id").alias(id_column), "n_bytes", "spans", "kept")


def _result(rows: list[tuple]) -> pa.RecordBatch:
    types = {"id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), "kept": pa.binary()}
    return _rows({c: (v, types[c]) for c, v in zip(types, zip(*rows))})
