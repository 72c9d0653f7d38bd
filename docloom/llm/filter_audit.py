"""How filters act on each other, over all orders in which they can be applied.

A state is the set of filters applied so far; an edge adds one more. What an edge
removes depends on its state alone, not on the order in which that was reached, so
rows are counted once per set of filters that they fail, and 5 filters need 80 edges
instead of 120 orders of 5 steps. Forward counting gives the number of orders that
reach a state, backward counting the number that leave it; their product weighs
each edge's removals for the Shapley sums. The steps of each order are read
from the same edges.
"""

from __future__ import annotations

from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.llm.batches import name
from docloom.storage import cut, local_table

# Limits of the filters, and the most filters whose orders are listed.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, ODD, MOST_FILTERS = 200, 50, 3, "[#$%&*|]", 7


def path_counts(filters: int) -> tuple[list[int], list[int]]:
    """Per state (a set of filters, as bits) the orders that reach it, and those that lead on from it to the full set."""
    states = 1 << filters
    forward, backward = [0] * states, [0] * states
    forward[0] = backward[-1] = 1
    for state in range(states):
        for f in range(filters):
            if not state >> f & 1:
                forward[state | 1 << f] += forward[state]
    for state in reversed(range(states)):
        for f in range(filters):
            if not state >> f & 1:
                backward[state] += backward[state | 1 << f]
    return forward, backward


def failures(text: Column) -> dict[str, Column]:
    """Whether a text (null: empty) fails A: under 200 words; B: fewer than half of its words are different; C: over 3 % of its
    code points are capitals A-Z; D: it has one of the odd characters. Words lie between white space of ASCII."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < LEAST_DISTINCT * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > MOST_CAPITALS * F.char_length(text).cast("long"),
        "D": text.rlike(ODD),
    }


def checked(docs: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per row of `docs`: `id`, `part` (null: empty) and whether it fails A to D, and E: its text stands in a row with a smaller id.

    Texts are compared by their SHA-256 and length. A null id is neither smaller nor
    greater than any, so such rows never fail E. Rows of one id and text are no
    copies of each other. The result is written; an empty table gives no rows.
    """
    whole = F.coalesce(name(text).cast("string"), F.lit(""))
    one = docs.select(
        name(id_column).alias("id"),
        F.coalesce(name(part).cast("string"), F.lit("")).alias("part"),
        *[c.alias(f) for f, c in failures(name(text)).items()],
        F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"),
        F.octet_length(whole).alias("size"),
    )
    one = cut(one, "audit-rows")
    # Copies are combined on the map side; the join's other side has one row per text.
    first = one.groupBy("digest", "size").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return one.join(first, ["digest", "size"], "left").select("id", "part", *failures(F.lit("")), copy.alias("E"))


def audit(rows: DataFrame, filters: list[str], part: str, losses: list[str]) -> DataFrame:
    """Per `part`, order of the filters and step: what the step does, in counts of rows.

    `filters` and `losses` name boolean columns of `rows`: whether a row fails the
    filter (null: it does not), and whether losing it is to be counted (null: not).
    Columns: the part, `filter_order` (the filters' names, joined), `step` (from 1),
    `kept` after it, `removed` by it, `redundant` (fail its filter, but were removed
    before), `unique_fails` (fail this filter only), per loss `<loss>_lost` (counted
    rows that the step removes), `shapley` (rows removed by its filter, summed over
    all orders). Every part that has rows has all orders, zeros included; parts may
    be null; an empty table gives no rows. Other columns are not read.
    """
    if not 0 < len(filters) <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters")
    bits = sum((F.coalesce(name(f), F.lit(False)).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    counted = [F.sum(F.coalesce(name(c), F.lit(False)).cast("long")).alias(f"loss{k}") for k, c in enumerate(losses)]
    # At most one row per part and set of failed filters, combined on the map side.
    failed = rows.groupBy(name(part).alias("part"), bits.alias("fails")).agg(F.count(F.lit(1)).alias("n"), *counted)
    forward, backward = path_counts(len(filters))
    edges = [(s, f, forward[s] * backward[s | 1 << f]) for s in range(1 << len(filters)) for f in range(len(filters)) if not s >> f & 1]
    edge = [F.struct(F.lit(s).alias("state"), F.lit(f).alias("filter"), F.lit(1 << f).alias("bit"), F.lit(w).cast("long").alias("weight")) for s, f, w in edges]
    spread = failed.withColumn("edge", F.explode(F.array(*edge)))
    state, bit = F.col("edge.state"), F.col("edge.bit")
    mine = F.col("fails").bitwiseAND(bit) != 0
    before = F.col("fails").bitwiseAND(state) != 0

    def total(condition: Column, of: str, to: str) -> Column:
        return F.sum(F.when(condition, F.col(of)).otherwise(0)).alias(to)

    effect = spread.groupBy("part", "edge").agg(
        total(~mine & ~before, "n", "kept"),
        total(mine & ~before, "n", "removed"),
        total(mine & before, "n", "redundant"),
        total(F.col("fails") == bit, "n", "unique_fails"),
        *[total(mine & ~before, f"loss{k}", f"loss{k}") for k in range(len(losses))],
    )
    # A part has few edges, the same number whatever the rows.
    shapley = F.sum(F.col("removed") * F.col("edge.weight")).over(Window.partitionBy("part", "edge.filter"))
    effect = effect.withColumn("shapley", shapley)
    steps = {"filter_order": [], "step": [], "at_state": [], "at_filter": []}
    for order in permutations(range(len(filters))):
        reached = 0
        for k, f in enumerate(order):
            for c, v in zip(steps, ("".join(filters[i] for i in order), k + 1, reached, f)):
                steps[c].append(v)
            reached |= 1 << f
    listed = local_table(rows.sparkSession, steps, {c: pa.int32() for c in ("step", "at_state", "at_filter")})
    at = (F.col("edge.state") == F.col("at_state")) & (F.col("edge.filter") == F.col("at_filter"))
    # one row per order and step, whatever the input
    return effect.join(F.broadcast(listed), at).select(
        F.col("part").alias(part), "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
        *[F.col(f"loss{k}").alias(f"{c}_lost") for k, c in enumerate(losses)], "shapley",
    )


def audit_documents(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """The audit of filters A to E over `docs`, per `part`, with the losses of good and of toxic documents.

    A document is good (toxic) if any row of `labels` with its id has quality (toxic)
    1; null ids and missing labels are neither.
    """
    marks = (
        labels.filter(name(id_column).isNotNull())
        .groupBy(name(id_column).alias("m_id"))
        .agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    )
    rows = checked(docs, id_column, text, part)
    return audit(rows.join(marks, F.col("id") == F.col("m_id"), "left"), list("ABCDE"), "part", ["good", "toxic"])
