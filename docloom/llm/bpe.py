"""Byte-level BPE: texts to token ids and back, by the vocabulary file of a public tokenizer.

Each word (a match of the pre-tokenizing pattern) starts as its bytes. One list
holds the parts between the word's boundaries, one beside it the rank of each
adjacent pair. The least rank, the leftmost among equals, is found by a scan;
its boundary is deleted and the two ranks next to it are looked up anew. Scans
are quadratic, so a word of over `LONG_WORD` bytes uses a heap of pairs over a
linked list instead, which gives the same ids.
"""

from __future__ import annotations

import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import map_texts, name

# Fixed value: the pre-tokenizing pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG_WORD = 128
# Words remembered per Python worker, twice (new and older), and the longest that is remembered: bounds of
# memory, not of the result.
CACHE_TEXTS, CACHE_CHARS = 200_000, 48
NONE = 1 << 60
# A space between two other characters always begins a word and no word spans it, so texts may be cut there.
_LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def _byte_letters() -> list[str]:
    """The character that stands for each byte: printable ones for themselves, the rest from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def merge_scan(parts: list[int], pairs: dict) -> list[int]:
    """Merge in place by scans over the contiguous ranks."""
    ranks = [pairs.get(p, NONE) for p in zip(parts, parts[1:])]
    while ranks:
        low = min(ranks)
        if low == NONE:
            break
        i = ranks.index(low)
        parts[i] = low & 0xFFFFFFFF
        del parts[i + 1], ranks[i]
        if i:
            ranks[i - 1] = pairs.get((parts[i - 1], parts[i]), NONE)
        if i < len(ranks):
            ranks[i] = pairs.get((parts[i], parts[i + 1]), NONE)
    return parts


def merge_heap(parts: list[int], pairs: dict) -> list[int]:
    """The same merges in n log n, for long words."""
    n = len(parts)
    after, before = [*range(1, n), -1], [-1, *range(n - 1)]
    heap = [(r, i) for i, p in enumerate(zip(parts, parts[1:])) if (r := pairs.get(p, NONE)) != NONE]
    heapq.heapify(heap)
    while heap:
        low, i = heapq.heappop(heap)
        j = after[i]
        if parts[i] < 0 or j < 0 or pairs.get((parts[i], parts[j]), NONE) != low:
            continue
        parts[i], parts[j] = low & 0xFFFFFFFF, -1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
            if (r := pairs.get((parts[i], parts[k]), NONE)) != NONE:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := pairs.get((parts[h], parts[i]), NONE)) != NONE:
            heapq.heappush(heap, (r, h))
    return [p for p in parts if p >= 0]


class _Remembered(dict):
    """Packed ids per text, made by `encode` where not known; the texts met least lately go when it is full."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text) or self.encode(text)
        if len(text) <= CACHE_CHARS:
            if len(self) >= CACHE_TEXTS:
                self.older = dict(self)
                self.clear()
            self[text] = packed
        return packed


class Tokenizer:
    """Encodes and decodes; made from the text of a tokenizer's JSON file."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        pairs = {}
        for rank, pair in enumerate(merges):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            pairs[vocab[a], vocab[b]] = rank << 32 | vocab[a + b]  # ordered by rank; the low half is the merged id
        self.first, self.pairs = [vocab[c] for c in letters], pairs
        self.find = regex.compile(PATTERN).finditer
        self.words = _Remembered(self._word)
        self.chunks = _Remembered(lambda chunk: self._words(" " + chunk))
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.added = {content: np.array([i], "<u4").tobytes() for content, i in added.items()}
        longest = sorted(added, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None
        known = {**{i: bytes(byte_of[c] for c in s) for s, i in vocab.items()}, **{i: s.encode() for s, i in added.items()}}
        self.bytes = [known.get(i, b"") for i in range(max(known) + 1)]

    def _word(self, word: str) -> bytes:
        parts = [self.first[b] for b in word.encode()]
        parts = (merge_scan if len(parts) <= LONG_WORD else merge_heap)(parts, self.pairs)
        return struct.pack(f"<{len(parts)}I", *parts)

    def _words(self, text: str) -> bytes:
        return b"".join([self.words[m[0]] for m in self.find(text)])

    def encode(self, text: str) -> bytes:
        """The ids as packed little-endian unsigned 32-bit integers."""
        out = []
        for segment in self.special.split(text) if self.special else [text]:
            if segment in self.added:
                out.append(self.added[segment])
            else:
                first, *rest = _LONE_SPACE.split(segment)
                out.append(self._words(first))
                out.extend(map(self.chunks.__getitem__, rest))
        return b"".join(out)

    def decode(self, packed: bytes) -> str:
        ids = np.frombuffer(packed, "<u4").tolist()
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _spec(spark: SparkSession, path: str):
    """The vocabulary file, read once where the job is planned; executors need no such path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(
    df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids", decoded: str | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add `ids`, the token ids of the whole `text` as packed little-endian unsigned 32-bit integers.

    With `decoded`, also add the text that these ids decode to. Null texts count
    as empty and give no ids; strings of added tokens in a text become those
    tokens. Every row is encoded on its own: no shuffle, ties and repeated rows
    stay as they are, an empty table gives an empty table. A column named as a
    new one is replaced. `tokenizer` is a path that the driver reads.
    """
    spec = _spec(df.sparkSession, tokenizer)
    fields = [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def setup():
        t = Tokenizer(spec.value)

        def work(texts):
            packed = [t.encode(x) for x in texts]
            made = [pa.array(packed, pa.binary())]
            return made + [pa.array([t.decode(p) for p in packed], pa.string())] * bool(decoded)

        return work

    return map_texts(df, text, fields, setup, keep)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """Add `text`, decoded from packed `ids`; null ids give null. Invalid UTF-8 becomes U+FFFD.

    Ids that the vocabulary lacks, or bytes that are no whole number of ids, fail the job.
    """
    spec = _spec(df.sparkSession, tokenizer)
    schema = T.StructType([*(f for f in df.schema.fields if f.name.lower() != text.lower()), T.StructField(text, T.StringType())])
    kept = [f.name for f in schema.fields[:-1]]

    def run(batches):
        t = Tokenizer(spec.value)
        for b in batches:
            made = pa.array([None if p is None else t.decode(p) for p in b.column(len(kept)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], made], names=[*kept, text])

    return df.select(*map(name, kept), name(ids).alias("packed")).mapInArrow(run, schema)


def digests(df: DataFrame, ids: str = "ids", decoded: str = "decoded") -> dict:
    """Columns that sum up an encoding: number of ids, and digests of the ids and the decoded text."""
    return {
        "n_tokens": (F.octet_length(name(ids)) / 4).cast("long"),
        "ids_sha256": F.sha2(name(ids), 256),
        "decoded_sha256": F.sha2(name(decoded).cast("binary"), 256),
    }
