"""Resharding that moves the fewest bytes: a minimum-cost flow from old shards to new capacities.

Rows are dealt into blocks by a hash; a block is the unit that moves, and the unit that files
hold. Block sizes (a bounded number of rows) go to the driver, which solves the flow between shards,
picks the blocks that make up each transfer, and sends the plan back as one small
table. Only blocks that move are written again; the files of all others stay as they are.

Rows without an old shard (null) have a supply of their own, from which every byte moves.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import free, name
from docloom.storage import fresh_path

# Blocks over all old shards: what the driver holds, whatever the table's size.
BLOCKS = 1 << 15
# The old shard of rows that have none.
NOWHERE = -1
# A group with over one part in so many of all bytes is dealt row by row.
LARGE = 64


class Plan(NamedTuple):
    """`flow[old, new]` bytes to transfer, and (old shard, block) to new shard."""

    flow: dict[tuple[int, int], int]
    moves: dict[tuple[int, int], int]
    sizes: dict[tuple[int, int], int]


def solve_flow(supply: list[int], capacity: list[int], cost=None) -> dict[tuple[int, int], int]:
    """Amounts old -> new that empty every supply, fill no capacity over, and cost the least.

    `cost(old, new)` per byte is 0 for a byte that stays and 1 for one that moves,
    unless given. Successive shortest paths with potentials: each path fills up a
    supply or a capacity, or turns an earlier choice round.
    """
    cost = cost or (lambda i, j: int(i != j))
    n, m = len(supply), len(capacity)
    if sum(supply) > sum(capacity):
        raise ValueError("the capacities do not hold the data")
    left, room = list(supply), list(capacity)
    flow = {(i, j): 0 for i in range(n) for j in range(m)}
    potential = [0] * (n + m)
    while any(left):
        distance, origin = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if left[i]:
                distance[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, v = heapq.heappop(heap)
            if d > distance[v]:
                continue
            if v < n:
                edges = ((n + j, cost(v, j)) for j in range(m))
            else:
                edges = ((i, -cost(i, v - n)) for i in range(n) if flow[i, v - n])
            for w, c in edges:
                if d + c + potential[v] - potential[w] < distance[w]:
                    distance[w], origin[w] = d + c + potential[v] - potential[w], v
                    heapq.heappush(heap, (distance[w], w))
        ends = [n + j for j in range(m) if room[j] and distance[n + j] < float("inf")]
        end = min(ends, key=lambda v: (distance[v] + potential[v], v))
        path = [end]
        while origin[path[-1]] >= 0:
            path.append(origin[path[-1]])
        path.reverse()
        amount = min([left[path[0]], room[end - n], *(flow[w, v - n] for v, w in zip(path, path[1:]) if v >= n)])
        for v, w in zip(path, path[1:]):
            if v < n:
                flow[v, w - n] += amount
            else:
                flow[w, v - n] -= amount
        left[path[0]] -= amount
        room[end - n] -= amount
        top = max(d for d in distance if d < float("inf"))
        potential = [p + min(d, top) for p, d in zip(potential, distance)]
    return {k: v for k, v in flow.items() if v}


def choose_blocks(flow: dict, sizes: dict[tuple[int, int], int], n_new: int) -> dict[tuple[int, int], int]:
    """New shard per (old shard, block), as near to the flow as whole blocks come.

    The largest blocks are dealt first, each to the target of its shard that has
    the most still to come, so the smallest even out what is left over.
    """
    due = dict(flow)
    targets: dict[int, list[int]] = {}
    for i, j in flow:
        targets.setdefault(i, []).append(j)
    excess = [0] * n_new
    for (i, j), amount in flow.items():
        excess[j] += amount
    moves = {}
    for key in sorted(sizes, key=lambda k: (-sizes[k], k)):
        i = key[0]
        options = targets.get(i) or [i if i < n_new else key[1] % n_new]
        fit = [j for j in options if due.get((i, j), 0) >= sizes[key]]
        # a block that fits stays if it can; else it goes where the whole shard lacks the most
        j = i if i in fit else max(fit or options, key=lambda j: (due.get((i, j), 0) if fit else excess[j], -j))
        moves[key] = j
        due[i, j] = due.get((i, j), 0) - sizes[key]
        excess[j] -= sizes[key]
    return moves


def even_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def _block(columns: list[Column], n: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def group_key(df: DataFrame, group: Column, size: Column, apart: Column) -> list[Column]:
    """What deals rows such that those of a group stay together: the group's hash, and for a large group `apart`, too.

    A group is large with over a `LARGE`th of all bytes, so there are less than `LARGE` of them.
    """
    of = F.xxhash64(group)
    sizes = df.select(of.alias("of"), size.cast("long").alias("size")).groupBy("of").agg(F.sum("size").alias("size"))
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    large = [r["of"] for r in sizes.filter(F.col("size") * LARGE > total).collect()]
    return [of, F.when(of.isin(large), F.xxhash64(apart))] if large else [of]


def plan(df: DataFrame, old: Column, size: Column, capacities: list[int] | int, by: list[Column], blocks: int = BLOCKS) -> Plan:
    """Plan transfers to `capacities` (bytes per new shard, or a number of equal ones).

    `old` is each row's present shard (from 0; null: none yet), `size` its bytes (null: 0), `by` what deals
    it to a block. Reads only these columns; one row per block reaches the driver. An empty table moves nothing.
    """
    was = F.coalesce(old.cast("int"), F.lit(NOWHERE))
    measured = df.select(was.alias("old"), _block(by, blocks).alias("block"), F.coalesce(size.cast("long"), F.lit(0)).alias("size"))
    rows = measured.groupBy("old", "block").agg(F.sum("size").alias("size")).collect()
    sizes = {(r.old, r.block): r.size for r in rows}
    n_old = 1 + max((k[0] for k in sizes), default=NOWHERE)
    # the supply of rows without a shard comes last, and none of it stays
    supply = [0] * (n_old + 1)
    for (i, _), s in sizes.items():
        supply[i] += s
    if isinstance(capacities, int):
        capacities = even_capacities(sum(supply), capacities)
    flow = solve_flow(supply, capacities, lambda i, j: int(i != j or i == n_old))
    flow = {(NOWHERE if i == n_old else i, j): amount for (i, j), amount in flow.items()}
    return Plan(flow, choose_blocks(flow, sizes, len(capacities)), sizes)


def assign(df: DataFrame, planned: Plan, old: Column, by: list[Column], blocks: int = BLOCKS, shard: str = "shard", was: str = "old_shard") -> DataFrame:
    """Add each row's new `shard`, its old one as `was` (null where it had none), and its `block`.

    The plan has at most `blocks` rows per old shard, so it may be broadcast. Any
    columns of these names are replaced; repeated rows each stay; an empty table gives no rows.
    """
    moves = sorted(planned.moves.items())
    table = df.sparkSession.createDataFrame(
        pa.table(
            {
                "p_old": pa.array([k[0] for k, _ in moves], pa.int32()),
                "p_block": pa.array([k[1] for k, _ in moves], pa.int32()),
                "p_shard": pa.array([v for _, v in moves], pa.int32()),
            }
        )
    )
    new = {shard.lower(), was.lower(), "block"}
    kept = [c for c in df.columns if c.lower() not in new]
    own = F.coalesce(old.cast("int"), F.lit(NOWHERE))
    dealt = df.select(F.struct(*map(name, kept)).alias("row"), own.alias("r_old"), _block(by, blocks).alias("r_block"))
    joined = dealt.join(F.broadcast(table), (F.col("r_old") == F.col("p_old")) & (F.col("r_block") == F.col("p_block")))
    before = F.when(F.col("r_old") != NOWHERE, F.col("r_old"))
    return joined.select("row.*", F.col("p_shard").alias(shard), before.alias(was), F.col("r_block").alias("block"))


def touched(planned: Plan) -> set[int]:
    """Shards that a block leaves or comes to."""
    return {s for (i, _), j in planned.moves.items() if i != j for s in (i, j) if s != NOWHERE}


def moved_bytes(planned: Plan) -> int:
    """Bytes of the blocks that move."""
    return sum(planned.sizes[k] for k, j in planned.moves.items() if k[0] != j)


def _moves(shard: str, was: str) -> Column:
    return ~F.col(shard).eqNullSafe(F.col(was))


def rewrite(assigned: DataFrame, path: str | None = None, shard: str = "shard", was: str = "old_shard") -> str:
    """Write the rows of blocks that move below `path`, one folder per new shard; returns the path.

    Files are of whole blocks, so those of other blocks need not be touched. No shuffle: each
    task writes to every shard that its rows go to.
    """
    path = path or fresh_path(assigned.sparkSession, "resharded")
    assigned.filter(_moves(shard, was)).drop(was).write.partitionBy(shard).parquet(path)
    return path


def reshard(df: DataFrame, planned: Plan, old: Column, by: list[Column], blocks: int = BLOCKS, shard: str = "shard") -> DataFrame:
    """Carry out a plan: write the rows of blocks that move, and return all rows with `shard` and `block`.

    Rows that moved are read from their new files, the others from where they are. Columns named `shard`
    or `block` are replaced; nulls, repeated rows and empty tables as in `assign`.
    """
    was = free("old_shard", [*df.columns, shard])
    assigned = assign(df, planned, old, by, blocks, shard, was)
    written = assigned.drop(was)
    if all(i == j for (i, _), j in planned.moves.items()):
        return written
    path = rewrite(assigned, shard=shard, was=was)
    rows = df.sparkSession.read.schema(written.schema).parquet(path).select(*map(name, written.columns))
    return rows.union(assigned.filter(~_moves(shard, was)).drop(was))


def with_slots(df: DataFrame, shard: str = "shard", order: list[str] | None = None) -> DataFrame:
    """Add `slot`, gapless from 0 within each shard: block after block, within a block by `order`.

    Rows are numbered per block; the blocks' counts (a bounded number of rows) give
    each its offset. No task sees a whole shard. A column named `slot` is replaced, others stay, whatever
    their names; ties and repeated rows get slots of their own; an empty table gives no rows.
    """
    kept = [c for c in df.columns if c.lower() != "slot"]
    block = [name(shard).alias("o_shard"), name("block").alias("o_block")]
    counts = df.select(*block).groupBy("o_shard", "o_block").count()
    before = Window.partitionBy("o_shard").orderBy("o_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("o_shard", "o_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("o_offset"))
    within = F.row_number().over(Window.partitionBy(name(shard), name("block")).orderBy(*map(name, order or [])))
    rows = df.select(F.struct(*map(name, kept)).alias("row"), name(shard).alias("r_shard"), name("block").alias("r_block"), within.alias("r_place"))
    same = (F.col("r_shard") == F.col("o_shard")) & (F.col("r_block") == F.col("o_block"))
    return rows.join(F.broadcast(offsets), same).select("row.*", (F.col("o_offset") + F.col("r_place") - 1).cast("long").alias("slot"))
