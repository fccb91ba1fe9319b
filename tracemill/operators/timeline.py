"""Status of sessions, pages of their events, and trajectories of turns, steps and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORK = ("user_message", "reasoning", "assistant_message", "tool_call", "tool_result", "turn_start")
STALE_MS, SETTLE_MS = 600_000, 90_000


def status(events: DataFrame, now: int, stale_ms: int = STALE_MS, settle_ms: int = SETTLE_MS) -> DataFrame:
    """(session, status, since, reason, last): the last telling event decides; work that is silent for too long is over.

    ``since`` is the time of the last change (times never run backwards), or when silence became too long.
    """
    telling = events.where(F.col("kind").isin(*WORK, "turn_end")).withColumn("s", F.when(F.col("kind") == "turn_end", F.lit("idle")).otherwise(F.lit("work")))
    order = Window.partitionBy("session").orderBy("seq")
    run = F.max("ts_ms").over(order.rowsBetween(Window.unboundedPreceding, 0))
    rows = telling.withColumn("run", run).withColumn("flip", F.coalesce(F.lag("s").over(order) != F.col("s"), F.lit(True)))
    out = rows.groupBy("session").agg(F.max_by("s", "seq").alias("s"), F.max_by("kind", "seq").alias("reason"), F.max("run").alias("last"), F.expr("max_by(run, seq) filter (where flip)").alias("since"))
    window = F.when(F.col("reason") == "assistant_message", F.lit(min(settle_ms, stale_ms))).otherwise(F.lit(stale_ms))
    over = (F.col("s") == "work") & (F.lit(now) - F.col("last") > window)
    return out.select("session", F.when(over, F.lit("idle")).otherwise(F.col("s")).alias("status"), F.when(over, F.col("last") + window).otherwise(F.col("since")).alias("since"), F.when(over, F.lit("stale")).otherwise(F.col("reason")).alias("reason"), "last")


def page(events: DataFrame, limit: int, before: DataFrame | None = None) -> DataFrame:
    """The newest ``limit`` events of each session under its cursor, with ``next_before``, the cursor of the next older page, null where none is left.

    ``before`` are cursors (session, before); a session without one has no page. Without ``before`` pages are the newest.
    """
    rows = events if before is None else events.join(before, "session").where(F.col("seq") < F.col("before")).drop("before")
    placed = rows.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("seq")))).where(F.col("rn") <= limit + 1)
    whole = Window.partitionBy("session")
    older = F.max("rn").over(whole) > limit
    next_ = F.when(older, F.min(F.when(F.col("rn") <= limit, F.col("seq"))).over(whole))
    return placed.withColumn("next_before", next_).where(F.col("rn") <= limit).drop("rn")


def oldest(events: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` events of each session; events that share the last position all stay."""
    return events.withColumn("rk", F.rank().over(Window.partitionBy("session").orderBy("seq"))).where(F.col("rk") <= limit).drop("rk")


def around(events: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """Up to ``limit`` events around each session's anchor (session, id), it in the middle; a short side gives its share to the other."""
    order = Window.partitionBy("session").orderBy("seq")
    rows = events.withColumn("rn", F.row_number().over(order)).withColumn("n", F.count("*").over(Window.partitionBy("session")))
    at = rows.join(anchors, ["session", "id"]).select("session", F.col("rn").alias("at"), "n")
    half = (limit - 1) // 2
    older, newer = F.col("at") - 1, F.col("n") - F.col("at")
    after = F.least(newer, F.lit(limit - 1) - F.least(F.lit(half), older))
    spans = at.select("session", (F.col("at") - F.least(older, F.lit(limit - 1) - after)).alias("low"), (F.col("at") + after).alias("high"))
    return rows.join(spans, "session").where("rn between low and high").drop("rn", "n", "low", "high")


def trajectory(events: DataFrame) -> DataFrame:
    """Items, at their first position, with the step they lead to: the next usage of the same turn, null if none follows."""
    firsts = events.where("first")
    ahead = Window.partitionBy("session", "turn").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    usage = F.when(F.col("kind") == "usage", F.col("id"))
    rows = firsts.withColumn("step", F.first(usage, True).over(ahead)).withColumn("step_ended_at", F.first(F.when(F.col("kind") == "usage", F.col("ts_ms")), True).over(ahead))
    return rows.where("kind <> 'usage'").select("session", "turn", "seq", "id", "kind", "step", "step_ended_at")


def tool_results(events: DataFrame) -> DataFrame:
    """Each call (session, id, call_id, name, seq, ts_ms) with its latest result: ended_at, is_error, result, running.

    A result belongs to the last call with its id before it, so an id that is used again is another call. Results without
    a call are left out; a call without one is still running. Events are latest contents (``ledger.latest``).
    """
    both = events.where(F.col("kind").isin("tool_call", "tool_result")).withColumn("is_call", F.col("kind") == "tool_call")
    order = Window.partitionBy("session", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    owned = both.withColumn("call_seq", F.max(F.when(F.col("is_call"), F.col("seq"))).over(order)).where("call_seq is not null")
    call = [F.expr(f"any_value({c}) filter (where is_call)").alias(c) for c in ("id", "name", "ts_ms")]
    got = F.expr("max_by(struct(ts_ms, coalesce(is_error, false) as is_error, text), seq) filter (where not is_call)").alias("r")
    return owned.groupBy("session", "call_id", F.col("call_seq").alias("seq")).agg(*call, got).select(
        "session", "id", "call_id", "name", "seq", "ts_ms", F.col("r.ts_ms").alias("ended_at"), F.col("r.is_error").alias("is_error"), F.col("r.text").alias("result"), F.col("r").isNull().alias("running"))


def step_times(events: DataFrame, calls: DataFrame) -> DataFrame:
    """(session, id, turn, seq, started_at, ended_at, items) of every step.

    A step ends with its usage or the last of its items, a call ending with its result; it starts where the step before
    it in the turn ended, the first one at the turn's first known time, and never after its own usage. ``events`` are
    deliveries with turns, ``calls`` those of ``tool_results``.
    """
    ended = calls.where("ended_at is not null").select("session", "id", "ended_at")
    own = trajectory(events).where(F.col("kind").isin("reasoning", "assistant_message", "tool_call", "system")).where("step is not null")
    at = events.where("first").select("session", "id", "ts_ms")
    items = own.join(at, ["session", "id"]).join(ended, ["session", "id"], "left").groupBy("session", F.col("step").alias("id")).agg(F.max(F.greatest("ts_ms", F.coalesce("ended_at", "ts_ms"))).alias("last"), F.count("*").alias("items"))
    used = events.where("kind = 'usage'").groupBy("session", "id").agg(F.min("seq").alias("seq"), F.min_by("turn", "seq").alias("turn"), F.max_by("ts_ms", "seq").alias("ts_ms"))
    known = F.expr("min(if(ts_ms > 0, ts_ms, null))")
    begun = events.where("first and kind not in ('tool_result', 'turn_end')").groupBy("session", "turn").agg(known.alias("begun"))
    rows = used.join(items, ["session", "id"], "left").join(begun, ["session", "turn"], "left").withColumn("ended_at", F.greatest("ts_ms", F.coalesce("last", "ts_ms")))
    before = F.lag("ended_at").over(Window.partitionBy("session", "turn").orderBy("seq"))
    return rows.select("session", "id", "turn", "seq", F.least(F.coalesce(before, "begun", "ts_ms"), "ts_ms").alias("started_at"), "ts_ms", "ended_at", F.coalesce("items", F.lit(0)).cast("bigint").alias("items"))


def child_links(children: DataFrame, calls: DataFrame, steps: DataFrame) -> DataFrame:
    """(child, parent, call, step): the call or, failing that, the step that each child session hangs from.

    ``children`` are (child, parent, parent_call, started_at), ``calls`` (session, id, call_id, name, ts_ms, seq), ``steps``
    (session, id, started_at, ts_ms). A child that names a call of its parent hangs from the first one with that id. One
    that names none takes the latest call of an agent before its start that no other child has: children in order of their
    start take calls from a stack, so with calls as opening and children as closing brackets a pair is two neighbours of
    one depth, which windows find. Others, and those that name a call the parent does not have, hang from the step they
    started in, else from the last one that had started; steps of a session follow one another. A null parent has no rows.
    """
    one = calls.groupBy(F.col("session").alias("parent"), F.col("call_id").alias("parent_call")).agg(F.min_by("id", "seq").alias("named"))
    told = children.where("parent is not null").join(one, ["parent", "parent_call"], "left").select("child", "parent", "parent_call", "started_at", "named")
    taken = told.where("named is not null").select(F.col("parent").alias("session"), F.col("named").alias("id")).distinct()
    agents = calls.where(F.lower("name").rlike("agent|task|spawn")).join(taken, ["session", "id"], "left_anti")
    open_ = agents.select(F.col("session").alias("parent"), F.col("ts_ms").alias("at"), F.lit(1).alias("d"), F.col("seq"), F.lit("").alias("child"), F.col("id").alias("call"))
    close = told.where("parent_call is null").select("parent", F.col("started_at").alias("at"), F.lit(-1).alias("d"), F.lit(0).cast("bigint").alias("seq"), "child", F.lit(None).cast("string").alias("call"))
    order = Window.partitionBy("parent").orderBy("at", F.desc("d"), "seq", "child")
    summed = open_.unionByName(close).withColumn("s", F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    floor = F.coalesce(F.min("s").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    deep = summed.withColumn("low", F.least(floor, F.lit(0))).where("d = 1 or s >= low").withColumn("depth", F.expr("s - low + if(d = 1, 0, 1)"))
    pairs = deep.withColumn("call", F.when(F.col("d") == -1, F.lag("call").over(Window.partitionBy("parent", "depth").orderBy("at", F.desc("d"), "seq", "child")))).where("d = -1").select("parent", "child", F.col("call").alias("near"))
    hung = told.join(pairs, ["parent", "child"], "left").select("child", "parent", "started_at", F.coalesce("named", "near").alias("call"))
    marks = steps.select(F.col("session").alias("parent"), F.col("started_at").alias("at"), F.struct(F.col("started_at").alias("a"), F.col("ts_ms").alias("z"), F.col("id").alias("id")).alias("step"), F.lit(None).cast("string").alias("child"))
    asks = hung.where("call is null").select("parent", F.col("started_at").alias("at"), F.lit(None).cast(marks.schema["step"].dataType).alias("step"), "child")
    timed = Window.partitionBy("parent").orderBy("at")
    seen = marks.unionByName(asks).withColumn("b", F.max("step").over(timed.rangeBetween(Window.unboundedPreceding, -1))).withColumn("e", F.max("step").over(timed.rangeBetween(Window.unboundedPreceding, 0)))
    fell = seen.where("child is not null").select("parent", "child", F.expr("if(b.z >= at, b.id, e.id)").alias("step"))
    return hung.join(fell, ["parent", "child"], "left").select("child", "parent", "call", "step")
