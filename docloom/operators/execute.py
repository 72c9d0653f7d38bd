"""A change plan carried out on state tables, phase by phase, up to the first error."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.storage import cut_wide

PLAN = ["phase", "verb", "kind", "entity", "prop", "old", "new"]
# What a plan may ask for. `prop` names the property of an update, and the member of the last two.
CREATE, UPDATE, ATTACH, DETACH = "create", "update", "attach", "detach"


class State(NamedTuple):
    """`entities`: kind, entity. `props`: kind, entity, prop, value. `members`: kind, entity, name."""

    entities: DataFrame
    props: DataFrame
    members: DataFrame


class Outcome(NamedTuple):
    """The state afterwards, and per action of the plan its `status` (done, failed or todo) and the `rule` that a failed one broke."""

    state: State
    report: DataFrame


def member_plan(verbs: DataFrame, kind: str, entity: str, name: str, member_kind: str) -> DataFrame:
    """The verbs of `reconcile_members` as actions: detach first, with creations of members that do not exist; then attach."""
    none = F.lit(None).cast("string")

    def actions(which: Column, phase: int, verb: str, of_kind: str, of: str, prop: Column, new: Column) -> DataFrame:
        return verbs.filter(which).select(
            F.lit(phase).alias("phase"), F.lit(verb).alias("verb"), F.lit(of_kind).alias("kind"), F.col(of).cast("string").alias("entity"),
            prop.alias("prop"), none.alias("old"), new.alias("new"),
        )

    verb, member = F.col("verb"), F.col(name).cast("string")
    created = actions(verb == "create", 1, CREATE, member_kind, name, none, F.lit("{}")).distinct()
    return (
        actions(verb == "detach", 1, DETACH, kind, entity, member, none)
        .unionByName(created)
        .unionByName(actions(verb.isin("attach", "create"), 2, ATTACH, kind, entity, member, none))
    )


def carry_out(state: State, plan: DataFrame) -> Outcome:
    """Carry out the rows of `plan` (`phase, verb, kind, entity, prop, old, new`, as `phased_plan` and `member_plan` give them).

    Phases follow each other; within one, actions go by kind, entity, verb and property, creations of a phase
    counting as there for all of it. An action fails that creates what is
    there, or with a payload that is no object; that touches an entity which is not; that updates a value other than the
    `old` one it was planned on; that attaches a member twice or detaches none; that occurs twice; or whose verb is
    unknown. The first failure in this order ends it: what comes before is done, all else is left to do.

    Each phase is a few equi-joins of its actions with the state, which is written once per phase; the driver
    sees the phases and the first failure.
    """
    plan = cut_wide(plan.select(*PLAN), "plan")
    entities, props, members = state.entities.select("kind", "entity").distinct(), state.props, state.members.distinct()
    reports, failed = [], False
    for phase in sorted(r.phase for r in plan.select("phase").distinct().collect()):
        actions = plan.filter(F.col("phase") == phase)
        judged = _judged(actions, entities, props, members)
        order = F.struct(F.col("kind").alias("k"), F.col("entity").cast("string").alias("e"), F.col("verb").alias("v"), F.coalesce("prop", F.lit("")).alias("p"))
        judged = cut_wide(judged.withColumn("order", order), "judged")
        first = None if failed else judged.filter(F.col("rule").isNotNull()).agg(F.min("order").alias("order")).first().order
        if failed:
            status = F.lit("todo")
        elif first is None:
            status = F.lit("done")
        else:
            at = F.struct(*[F.lit(x).alias(c) for c, x in first.asDict().items()])
            status = F.when(F.col("order") < at, "done").when(F.col("order") == at, "failed").otherwise("todo")
        told = judged.withColumn("status", status)
        rule = F.when(F.col("status") == "failed", F.col("rule"))
        reports.append(told.select(*PLAN, "status", rule.alias("rule")))
        if failed:
            continue
        failed = first is not None
        done = told.filter("status = 'done'")
        entities, props, members = _applied(done, entities, props, members)
    report = reduce(DataFrame.unionByName, reports) if reports else plan.withColumns({"status": F.lit("todo"), "rule": F.lit(None).cast("string")})
    return Outcome(State(entities, props, members), report)


def _judged(actions: DataFrame, entities: DataFrame, props: DataFrame, members: DataFrame) -> DataFrame:
    """Actions with the `rule` that each breaks, null if none."""
    there = entities.withColumn("__there", F.lit(True))
    soon = actions.filter(F.col("verb") == CREATE).select("kind", "entity").distinct().withColumn("__soon", F.lit(True))
    is_, has = props.select("kind", "entity", "prop", F.col("value").alias("__is")), members.select("kind", "entity", F.col("name").alias("prop")).withColumn("__has", F.lit(True))
    # null properties, those of creations, meet nothing
    times = actions.groupBy("kind", "entity", "verb", "prop").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    times = times.select("kind", "entity", "verb", F.coalesce("prop", F.lit("")).alias("__p"), "__n")
    joined = (
        actions.withColumn("__p", F.coalesce("prop", F.lit("")))
        .join(there, ["kind", "entity"], "left")
        .join(soon, ["kind", "entity"], "left")
        .join(is_, ["kind", "entity", "prop"], "left")
        .join(has, ["kind", "entity", "prop"], "left")
        .join(times, ["kind", "entity", "verb", "__p"], "left")
    )
    verb, here = F.col("verb"), F.coalesce("__there", "__soon").isNotNull()
    rule = (
        F.when(~verb.isin(CREATE, UPDATE, ATTACH, DETACH), "unknown-verb")
        .when(F.col("__n").isNotNull(), "repeated-action")
        .when((verb == CREATE) & F.col("__there").isNotNull(), "already-there")
        .when((verb == CREATE) & F.from_json("new", "map<string,string>").isNull(), "malformed-payload")
        .when((verb != CREATE) & ~here, "no-such-entity")
        .when((verb == UPDATE) & ~F.col("__is").eqNullSafe(F.col("old")), "changed-meanwhile")
        .when((verb == ATTACH) & F.col("__has").isNotNull(), "already-attached")
        .when((verb == DETACH) & F.col("__has").isNull(), "not-attached")
    )
    return joined.select(*PLAN, rule.alias("rule"))


def _applied(done: DataFrame, entities: DataFrame, props: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    created = done.filter(F.col("verb") == CREATE)
    entities_ = cut_wide(entities.unionByName(created.select("kind", "entity")), "state-entities")
    opened = created.select("kind", "entity", F.explode(F.from_json("new", "map<string,string>")).alias("prop", "__new"))
    updates = done.filter(F.col("verb") == UPDATE).select("kind", "entity", "prop", F.col("new").alias("__new"))
    new = opened.unionByName(updates).withColumn("__hit", F.lit(True))
    value = F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("value"))
    props_ = props.join(new, ["kind", "entity", "prop"], "full").select("kind", "entity", "prop", value.alias("value")).filter("value IS NOT NULL")
    member = ["kind", "entity", "name"]
    gone = done.filter(F.col("verb") == DETACH).select("kind", "entity", F.col("prop").alias("name"))
    added = done.filter(F.col("verb") == ATTACH).select("kind", "entity", F.col("prop").alias("name"))
    members_ = cut_wide(members.join(gone, member, "left_anti").unionByName(added), "state-members")
    return entities_, cut_wide(props_, "state-props"), members_
