"""Steps and prompts of sessions: turn numbering, model fill-forward and upserts as windows over one shuffle by session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BOUNDARIES = ("user_message", "turn_start")
CLOSERS = ("usage", "assistant_message", "reasoning", "tool_call", "tool_result", "turn_end")
TOKENS = ("input", "output", "cache_read", "cache_write", "reasoning")


def _of(rows: DataFrame) -> list[str]:
    """What tells one ledger: the session, and the source where sessions can have several."""
    return ["session", "source"] if "source" in rows.columns else ["session"]


def latest(raw: DataFrame) -> DataFrame:
    """One row an event id: its first position with its latest content."""
    content = [c for c in raw.columns if c not in ("session", "id", "seq")]
    both = raw.groupBy("session", "id").agg(F.min("seq").alias("seq"), F.max_by(F.struct(*content), "seq").alias("c"))
    return both.select("session", "id", "seq", "c.*")


def turned(raw: DataFrame) -> DataFrame:
    """Every delivery with ``first`` (first of its id), ``turn`` and ``fill``, the model that holds at this point.

    A model holds from an answer or a record of the session's metadata on (kind 'meta') until another one is named. A
    first-seen prompt or turn start opens a turn unless the last relevant event before it did too. Source order counts,
    not time. A session's events meet in one task; that is the unit that order is defined in.
    """
    of = _of(raw)
    by_id, order = Window.partitionBy(*of, "id").orderBy("seq"), Window.partitionBy(*of).orderBy("seq")
    seen = raw.repartition(*of).withColumn("first", F.row_number().over(by_id) == 1)
    opens = F.col("kind").isin(*BOUNDARIES) & F.col("first")
    if "synthetic" in raw.columns:
        opens = opens & ~F.coalesce("synthetic", F.lit(False))
    flagged = seen.withColumn("opens", opens).withColumn("relevant", F.col("opens") | F.col("kind").isin(*CLOSERS))
    before = F.last(F.when(F.col("relevant"), F.col("opens")), True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    fill = F.last(F.when(F.col("kind").isin("assistant_message", "meta") & (F.col("model") != ""), F.col("model")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lagged = flagged.withColumn("inc", (F.col("opens") & ~F.coalesce(before, F.lit(False))).cast("bigint")).withColumn("fill", fill)
    return lagged.withColumn("turn", F.sum("inc").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("inc", "opens", "relevant")


def steps(events: DataFrame) -> DataFrame:
    """One row a model call: numbers of its last delivery, turn and position of its first; the last model it named itself, else the one that held first."""
    usage = events.where("kind = 'usage'")
    kept = [c for c in ("harness", "cwd", "user_id") if c in events.columns]
    of = _of(events)
    out = usage.groupBy(*of, "id", *kept).agg(
        F.min("seq").alias("seq"), F.min_by("turn", "seq").alias("turn"), F.max_by("ts_ms", "seq").alias("ts_ms"), *[F.max_by(c, "seq").alias(c) for c in TOKENS],
        F.coalesce(F.expr("max_by(model, seq) filter (where model is not null)"), F.min_by("fill", "seq")).alias("model"))
    return out.withColumn("step_idx", F.row_number().over(Window.partitionBy(*of).orderBy("seq")).cast("bigint"))


def prompts(events: DataFrame) -> DataFrame:
    """First deliveries of what users wrote; what a harness wrote in their place (``synthetic``) is left out."""
    asked = events.where("kind = 'user_message' and first")
    return asked.where("not coalesce(synthetic, false)") if "synthetic" in events.columns else asked


def final_models(events: DataFrame) -> DataFrame:
    """(session, final_model): the model that held last."""
    return events.where("fill is not null").groupBy("session").agg(F.max_by("fill", "seq").alias("final_model"))


def combined(events: DataFrame, found: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One ledger a session from several sources': steps and prompts with their turns counted on from source to source.

    ``events``, ``found`` (steps) and ``asked`` (prompts) have a ``source``. Sources are taken in the order of their first
    step's time, else their first prompt's, else as if at 0; of equal times by name. Steps are numbered by time, those of
    one time by source and position. A session with one source stays as it is but for steps whose times run backwards.
    """
    keys = ["session", "source"]
    turns = events.groupBy(*keys).agg(F.max("turn").alias("turns"))
    first = lambda rows, name: rows.groupBy(*keys).agg(F.min_by("ts_ms", "seq").alias(name))
    parts = turns.join(first(found, "a"), keys, "left").join(first(asked, "b"), keys, "left").withColumn("at", F.coalesce("a", "b", F.lit(0)))
    order = Window.partitionBy("session").orderBy("at", "source")
    base = F.coalesce(F.sum("turns").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = parts.select(*keys, base.alias("base"), F.row_number().over(order).alias("part"))
    moved = lambda rows: rows.join(placed, keys).withColumn("turn", F.col("turn") + F.col("base"))
    steps_ = moved(found).withColumn("step_idx", F.row_number().over(Window.partitionBy("session").orderBy("ts_ms", "part", "seq")).cast("bigint"))
    return steps_.drop("base", "part"), moved(asked).drop("base", "part")
