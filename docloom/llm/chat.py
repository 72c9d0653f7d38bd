"""Chat formatting: conversations as one text each, with a reversible template and a loss mask.

Template of a turn: `### role: text</turn>` and a line break. A backslash goes before
each backslash, and before `###` and `</turn>` wherever they stand in a text; a
role also has its colons escaped. So the marks are those that no backslash precedes.

Bytes are assembled by columns: the lengths of all segments of a batch (marks,
roles, texts) give cumulative offsets, these the places where numpy scatters
headers and contents into one buffer, which becomes the Arrow column unchanged.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.llm.batches import groups, name

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
# Escaped contents, as regular expressions of the JVM: what gets a backslash before it.
_IN_TEXT, _IN_ROLE = r"\\|(?=###)|(?=</turn>)", r"\\|(?=###)|(?=</turn>)|(?=:)"
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
# Turns and bytes that are assembled at a time, unless one conversation has more.
BATCH_TURNS, BATCH_BYTES = 4096, 32 << 20
# A longer value is copied as a whole: its bytes need no indices of their own.
LONG_VALUE = 1 << 16


def escape(column, marks: str):
    return F.regexp_replace(F.coalesce(column, F.lit("")), marks, r"\\$0")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def scatter(segments: list[pa.Array], out: np.ndarray, offsets: list[np.ndarray]) -> None:
    """Copy each value of each string array to its offset in `out`."""
    for values, at in zip(segments, offsets):
        sizes = np.asarray(pa.compute.binary_length(values), np.int64)
        total = int(sizes.sum())
        if not total:
            continue
        bounds = np.frombuffer(values.buffers()[1], np.int32 if pa.types.is_string(values.type) else np.int64)
        begins = bounds[values.offset : values.offset + len(values)].astype(np.int64)
        data = np.frombuffer(values.buffers()[2], np.uint8)
        for i in np.flatnonzero(sizes > LONG_VALUE).tolist():
            out[at[i] : at[i] + sizes[i]] = data[begins[i] : begins[i] + sizes[i]]
        short = np.where(sizes > LONG_VALUE, 0, sizes)
        # the i-th byte of a value goes from i places after its begin to i places after its offset
        within = np.arange(int(short.sum())) - np.repeat(np.cumsum(short) - short, short)
        out[np.repeat(at, short) + within] = data[np.repeat(begins, short) + within]


def assemble(roles: pa.Array, texts: pa.Array, first_of: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Formatted conversations, and per turn the byte range of its text within its conversation.

    `first_of` are the turns that begin a conversation; roles and texts are escaped.
    """
    n = len(roles)
    size = lambda a: np.asarray(pa.compute.binary_length(a), np.int64)
    marks = [len(OPEN), len(COLON), len(CLOSE)]
    role_sizes, text_sizes = size(roles), size(texts)
    turn_sizes = role_sizes + text_sizes + sum(marks)
    starts = np.cumsum(turn_sizes) - turn_sizes
    role_at = starts + marks[0]
    colon_at = role_at + role_sizes
    text_at = colon_at + marks[1]
    close_at = text_at + text_sizes
    out = np.empty(int(turn_sizes.sum()), np.uint8)
    for mark, at in ((OPEN, starts), (COLON, colon_at), (CLOSE, close_at)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark.encode(), np.uint8)
    scatter([roles, texts], out, [role_at, text_at])
    bounds = np.append(starts[first_of], len(out)).astype(np.int64)
    whole = pa.LargeStringArray.from_buffers(len(first_of), pa.py_buffer(bounds), pa.py_buffer(out))
    base = np.repeat(bounds[:-1], np.diff(np.append(first_of, n)))
    return whole.cast(pa.string()), text_at - base, close_at - base


def format_chats(
    df: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = "assistant"
) -> DataFrame:
    """One row per conversation: its id, `formatted`, `n_turns`, and the loss mask.

    `loss_starts` and `loss_ends` are code point offsets into `formatted` of the texts
    of `trained` turns. Turns go by number, then by role and text, so repeated rows
    stay and ties are settled; a null number comes first, a null id is a
    conversation of its own, null roles and texts are empty. Extra columns are not
    read; an empty table gives no rows. A conversation is one value: all of its
    turns meet in one task.
    """
    schema = T.StructType(
        [
            T.StructField(conversation, df.schema[conversation].dataType),
            T.StructField("formatted", T.StringType()),
            T.StructField("n_turns", T.LongType()),
            T.StructField("loss_starts", T.ArrayType(T.LongType())),
            T.StructField("loss_ends", T.ArrayType(T.LongType())),
        ]
    )
    rows = df.select(
        name(conversation).alias("conv"),
        name(turn).alias("turn"),
        escape(name(role), _IN_ROLE).alias("role"),
        escape(name(text), _IN_TEXT).alias("text"),
        F.coalesce(name(role) == trained, F.lit(False)).alias("trained"),
    )
    rows = rows.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").drop("turn")

    def emit(tables: list[pa.Table]) -> pa.RecordBatch:
        table = pa.concat_tables(tables).combine_chunks()
        lengths = np.array([t.num_rows for t in tables])
        first_of = np.cumsum(lengths) - lengths
        one = lambda c: table.column(c).chunk(0)
        whole, begins, ends = assemble(one("role"), one("text"), first_of)
        # code points of each conversation before a byte: those bytes that continue none
        flags = np.asarray(one("trained").to_numpy(zero_copy_only=False))
        convs = np.repeat(np.arange(len(tables)), lengths)
        begin_of = np.frombuffer(whole.buffers()[1], np.int32)[convs]
        leads = np.concatenate(([0], np.cumsum((np.frombuffer(whole.buffers()[2], np.uint8) & 0xC0) != 0x80)))
        chars = [(leads[begin_of + x] - leads[begin_of])[flags] for x in (begins, ends)]
        counts = np.concatenate(([0], np.cumsum(np.bincount(convs[flags], minlength=len(tables)))))
        lists = [pa.ListArray.from_arrays(pa.array(counts, pa.int32()), pa.array(x, pa.int64())) for x in chars]
        made = [one("conv").take(pa.array(first_of)), whole, pa.array(lengths, pa.int64()), *lists]
        return pa.RecordBatch.from_arrays(made, names=schema.fieldNames())

    def run(batches):
        held, turns, size = [], 0, 0
        for table in groups(batches, 1):
            held.append(table)
            turns += table.num_rows
            size += table.nbytes
            if turns >= BATCH_TURNS or size >= BATCH_BYTES:
                yield emit(held)
                held, turns, size = [], 0, 0
        if held:
            yield emit(held)

    return rows.mapInArrow(run, schema)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The roles and texts that a formatted conversation was made of."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


def read_back(df: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """Per formatted conversation: digests of its parsed turns and of the text under the loss mask."""
    schema = T.StructType(
        [df.schema[conversation]]
        + [T.StructField(c, T.StringType() if c.endswith("256") else T.LongType()) for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")]
    )

    def run(batches):
        for b in batches:
            out = []
            for whole, starts, ends in zip(*(b.column(c).to_pylist() for c in (1, 2, 3))):
                turns = parse_chat(whole)
                loss = unescape("".join(whole[s:e] for s, e in zip(starts, ends)))
                digest = hashlib.sha256()
                for role, text in turns:
                    digest.update(f"{role}\n{text}\n".encode())
                out.append((len(turns), digest.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(whole)))
            columns = list(zip(*out)) or [()] * 5
            made = [pa.array(c, pa.string() if i in (1, 3) else pa.int64()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([b.column(0), *made], names=schema.fieldNames())

    return df.select(name(conversation), "formatted", "loss_starts", "loss_ends").mapInArrow(run, schema)
