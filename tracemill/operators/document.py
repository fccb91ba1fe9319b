"""A session's trajectory as one nested document: turns of steps of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .ledger import TOKENS

ITEMS = ("reasoning", "assistant_message", "tool_call", "system")
#: Characters kept of a prompt, and of a reply, a call's arguments or an output.
PROMPT, PREVIEW = 300, 200


def _clip(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def items(deliveries: DataFrame) -> DataFrame:
    """(session, id, turn, seq, step, hint, item, end): each item at its first position with what was delivered last.

    ``step`` is the next usage that is delivered in its turn, again or not; null where none follows. A call keeps its first
    time and call id; its result is the last one delivered for it, and belongs to the last call of that id before it.
    """
    ahead = Window.partitionBy("session", "turn").orderBy("seq").rowsBetween(0, Window.unboundedFollowing)
    told = deliveries.withColumn("step", F.first(F.when(F.col("kind") == "usage", F.col("id")), True).over(ahead)).where(F.col("kind").isin(*ITEMS))
    first = F.min_by(F.struct("turn", "seq", "step", F.col("ts_ms").alias("hint"), "call_id"), "seq").alias("f")
    last = F.max_by(F.struct("kind", "ts_ms", "text", "name", "args"), "seq").alias("l")
    own = told.groupBy("session", "id").agg(first, last).select("session", "id", "f.*", "l.kind", "l.ts_ms", "l.text", "l.name", "l.args")
    calls = own.where("kind = 'tool_call'").select("session", "call_id", "seq", "id", F.lit(None).cast("struct<at: bigint, is_error: boolean, text: string>").alias("r"))
    given = deliveries.where("kind = 'tool_result'").select("session", "call_id", "seq", F.lit(None).cast("string").alias("id"), F.struct(F.col("ts_ms").alias("at"), F.coalesce("is_error", F.lit(False)).alias("is_error"), "text").alias("r"))
    before = Window.partitionBy("session", "call_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    results = calls.unionByName(given).withColumn("call", F.last("id", True).over(before)).where("r is not null and call is not null").groupBy("session", F.col("call").alias("id")).agg(F.max_by("r", "seq").alias("r"))
    rows = own.join(results, ["session", "id"], "left")
    call, text = F.col("kind") == "tool_call", F.coalesce("text", F.lit(""))
    item = F.struct(
        F.col("kind"), F.col("id").alias("event"), F.when(call, F.col("hint")).otherwise(F.col("ts_ms")).alias("ts"), F.when(F.col("kind").isin("reasoning", "assistant_message"), F.length(text).cast("bigint")).alias("chars"), F.when(F.col("kind") == "assistant_message", _clip(text, PREVIEW)).alias("preview"),
        F.when(F.col("kind").isin("tool_call", "system"), F.col("name")).alias("name"), F.when(call, F.col("call_id")).alias("call_id"), F.when(call, _clip(F.coalesce("args", F.lit("")), PREVIEW)).alias("input_preview"), F.when(call, F.col("r.at")).alias("ended_at"), F.when(call, F.col("r.is_error")).alias("is_error"),
        F.when(call, _clip(F.col("r.text"), PREVIEW)).alias("output_preview"), F.when(call, F.col("r").isNull()).alias("running"))
    return rows.select("session", "id", "turn", "seq", "step", "hint", item.alias("item")).withColumn("end", F.greatest("item.ts", F.coalesce("item.ended_at", F.lit(0))))


def _gathered(rows: DataFrame, *keys: str) -> DataFrame:
    inner = F.transform(F.array_sort(F.collect_list(F.struct("seq", "item"))), lambda x: x["item"])
    return rows.groupBy(*keys).agg(inner.alias("items"), F.max("end").alias("last"))


def turns(deliveries: DataFrame, found: DataFrame) -> DataFrame:
    """(session, turn, event, prompt, started_at, turn_end) of each turn that has a prompt, a step or an item of its own.

    A turn comes to be with its first prompt or first usage, whichever is first, else with its end. It begins at the least
    known time of a turn start before that, of what made it (for a usage: the first item it closes) and of its prompt.
    """
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    asked = deliveries.where("kind = 'user_message'")
    asked = asked.where("not coalesce(synthetic, false)") if "synthetic" in deliveries.columns else asked
    prompt = asked.groupBy("session", "turn").agg(F.min_by(F.struct("seq", "id", F.col("ts_ms").alias("at"), _clip(F.coalesce("text", F.lit("")), PROMPT).alias("text")), "seq").alias("p"))
    start = deliveries.where("kind = 'turn_start'").groupBy("session", "turn").agg(F.min_by(F.struct("seq", F.col("ts_ms").alias("at")), "seq").alias("b"))
    # The first new usage of a turn, with the first item that waited for it.
    begun = deliveries.where("kind = 'usage'").groupBy("session", "id").agg(F.min_by(F.struct("turn", "seq", F.col("ts_ms").alias("at")), "seq").alias("u")).select("session", "id", "u.*")
    waited = begun.join(found.select("session", F.col("step").alias("id"), F.col("seq").alias("item_seq"), "hint"), ["session", "id"], "left").where("item_seq is null or item_seq < seq")
    opened = waited.groupBy("session", "turn", "id", "seq", "at").agg(F.min_by("hint", "item_seq").alias("hint"))
    usage = begun.join(opened.select("session", "id", "hint"), ["session", "id"], "left").groupBy("session", "turn").agg(F.min_by(F.struct("seq", F.coalesce("hint", "at").alias("at")), "seq").alias("u"))
    own = found.where("step is null").groupBy("session", "turn").agg(F.min_by(F.struct("seq", F.col("hint").alias("at")), "seq").alias("o"))
    keys = ["session", "turn"]
    all_ = prompt.join(usage, keys, "full").join(own, keys, "full").join(start, keys, "left")
    by_prompt = F.coalesce(F.col("p.seq") < F.coalesce(F.col("u.seq"), F.lit((1 << 63) - 1)), F.lit(False))
    made = F.when(by_prompt, F.col("p.seq")).otherwise(F.col("u.seq")).alias("made")
    hint = F.when(by_prompt, F.col("p.at")).otherwise(F.coalesce("u.at", "o.at")).alias("hint")
    rows = all_.select(*keys, "p", "b", made, hint).withColumn("early", F.when(F.col("made").isNull() | (F.col("b.seq") < F.col("made")), F.col("b.at")))
    ends = deliveries.where("kind = 'turn_end'").select(*keys, F.col("seq").alias("end_seq"), F.col("ts_ms").alias("end_at"))
    ended = rows.select(*keys, "made").join(ends, keys).where("end_seq > made").groupBy(*keys).agg(F.max("end_at").alias("turn_end"))
    began = F.coalesce(F.least(positive("early"), positive("hint"), positive("p.at")), F.lit(0).cast("bigint"))
    return rows.join(ended, keys, "left").select(*keys, F.col("p.id").alias("event"), F.col("p.text").alias("prompt"), began.alias("started_at"), F.coalesce("turn_end", F.lit(0).cast("bigint")).alias("turn_end"))


def document(deliveries: DataFrame, steps: DataFrame) -> DataFrame:
    """(session, turns): one row a session that has a turn; turns in their order, each with steps and the items of none.

    ``deliveries`` are those of ``ledger.turned`` with call_id, name, args, text and is_error, ``steps`` the priced ones of
    the ledger (id or event, step_idx, turn, seq, ts_ms, model, TOKENS, pico). A step ends with its usage or the last of
    its items, a call with its result; it begins where the one before it in its turn ended, the first where the turn did,
    and never after its own usage. A session's document is one row, as it is read as a whole.
    """
    found = items(deliveries)
    steps = steps.withColumnRenamed("event", "id") if "event" in steps.columns else steps
    placed = _gathered(found.where("step is not null"), "session", "step").withColumnRenamed("step", "id")
    heads = turns(deliveries, found)
    done = steps.join(placed, ["session", "id"], "left").withColumn("end", F.greatest("ts_ms", F.coalesce("last", F.lit(0)))).join(heads.select("session", "turn", F.col("started_at").alias("begun")), ["session", "turn"])
    lag = F.lag("end").over(Window.partitionBy("session", "turn").orderBy("seq"))
    before = F.coalesce(lag, "begun")
    none = F.array().cast(placed.schema["items"].dataType)
    done = done.withColumn("started_at", F.when(before > 0, F.least(before, "ts_ms")).otherwise(F.col("ts_ms"))).withColumn("items", F.coalesce("items", none))
    step = F.struct(F.col("step_idx").alias("index"), F.col("id").alias("event"), "started_at", F.col("ts_ms").alias("ts"), "model", *TOKENS, "pico", "items")
    inner = done.groupBy("session", "turn").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", step.alias("step")))), lambda x: x["step"]).alias("steps"), F.max("end").alias("steps_end"))
    own = _gathered(found.where("step is null"), "session", "turn")
    whole = heads.join(inner, ["session", "turn"], "left").join(own, ["session", "turn"], "left")
    ended = F.greatest("started_at", "turn_end", F.coalesce("steps_end", F.lit(0)), F.coalesce("last", F.lit(0)))
    turn = F.struct("turn", "event", "prompt", "started_at", ended.alias("ended_at"), F.coalesce("steps", F.array().cast(inner.schema["steps"].dataType)).alias("steps"), F.coalesce("items", none).alias("items"))
    return whole.groupBy("session").agg(F.array_sort(F.collect_list(turn.alias("t"))).alias("turns"))


def flat(documents: DataFrame) -> DataFrame:
    """The items of documents, a row each, with their turn and, where they have one, their step."""
    each = documents.select("session", F.explode("turns").alias("t"))
    nothing = F.lit(None).cast(each.schema["t"].dataType["steps"].dataType.elementType)
    groups = each.select("session", "t", F.explode(F.concat("t.steps", F.array(nothing))).alias("s"))
    rows = groups.select("session", "t", "s", F.posexplode(F.coalesce("s.items", "t.items")).alias("item_no", "i"))
    return rows.select("session", "t.turn", F.col("t.event").alias("prompt"), "t.started_at", "t.ended_at", F.col("s.index").alias("step"), F.col("s.started_at").alias("step_started_at"), "item_no", F.col("i.kind").alias("kind"), F.col("i.event").alias("event"), F.col("i.ts").alias("ts"), F.col("i.chars").alias("chars"), F.col("i.preview").alias("preview"), F.col("i.name").alias("name"), F.col("i.ended_at").alias("item_ended_at"), F.col("i.is_error").alias("is_error"), F.col("i.output_preview").alias("output_preview"), F.col("i.running").alias("running"))
