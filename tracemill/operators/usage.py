"""Usage reports: steps and prompts by one of ten dimensions, with folding, totals and per-session detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import base_name, below, civil, first_parts, usd, usd_sum, weekday
from ..storage import settled
from . import ledger, pricing

SUMS = ("input", "output", "cache_read", "cache_write", "reasoning")


def steps_of(raw: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(priced steps, deliveries with turns) of raw events; what both are read from is written once."""
    events = settled(ledger.turned(raw))
    found = settled(ledger.steps(events).withColumnRenamed("id", "event"))
    return pricing.priced(found, catalog), events


def facts(steps: DataFrame, events: DataFrame) -> DataFrame:
    """Steps and prompts in one shape. A prompt counts for the model of its turn's first step, else for the session's last model."""
    first = steps.groupBy("session", "turn").agg(F.min_by("model_key", "seq").alias("turn_model"))
    asked = ledger.prompts(events).join(first, ["session", "turn"], "left").join(ledger.final_models(events), "session", "left")
    zero = [F.lit(0).cast("bigint").alias(c) for c in SUMS]
    common = ["session", "harness", "cwd", "ts_ms"]
    a = steps.select(*common, "model_key", F.lit(1).alias("is_step"), F.lit(0).alias("is_prompt"), *SUMS, "pico", F.col("pico").isNull().cast("int").alias("unpriced"))
    b = asked.select(*common, F.coalesce("turn_model", base_name(F.col("final_model")), F.lit("")).alias("model_key"), F.lit(0).alias("is_step"), F.lit(1).alias("is_prompt"), *zero, F.lit(None).cast("bigint").alias("pico"), F.lit(0).alias("unpriced"))
    return a.unionByName(b)


def dimension(name: str, tz: str = "UTC", under: str = "/", depth: int = 1) -> Column:
    """The key of a row for ``name``; rows without a directory or time have the empty key."""
    wall = civil(F.col("ts_ms"), tz)
    keys = {
        "harness": F.col("harness"), "cwd": F.col("cwd"), "session": F.col("session"), "model": F.col("model_key"), "project": F.coalesce(F.col("root"), F.col("cwd")) if name == "project" else F.lit(None), "dir": first_parts(F.col("cwd"), under, depth),
        "day": F.substring(wall, 1, 10), "hour": F.substring(wall, 12, 2), "weekday": weekday(wall), "weekday_hour": F.concat_ws("-", weekday(wall), F.substring(wall, 12, 2)),
    }
    if name not in keys:
        raise ValueError(f"unknown grouping {name!r}")
    return F.coalesce(keys[name], F.lit(""))


def with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``root`` of each row: the longest of ``roots`` (path) that is its cwd or above it."""
    dirs = rows.select("cwd").distinct()
    ups = dirs.select("cwd", F.explode(F.expr("transform(sequence(1, size(split(cwd, '/'))), n -> array_join(slice(split(cwd, '/'), 1, n), '/'))")).alias("path"))
    best = ups.join(roots.select("path").distinct(), "path").groupBy("cwd").agg(F.max_by("path", F.length("path")).alias("root"))
    return rows.join(best, "cwd", "left")


def summed(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(c).cast("bigint").alias(c) for c in SUMS]
    return rows.groupBy(*keys).agg(F.count_distinct("session").alias("sessions"), F.sum("is_step").cast("bigint").alias("steps"), F.sum("is_prompt").cast("bigint").alias("prompts"), *sums, usd_sum("pico").alias("cost"), F.sum("unpriced").cast("bigint").alias("unpriced"))


def chosen(rows: DataFrame, since: int | None = None, until: int | None = None, model: str | None = None, under: str | None = None) -> DataFrame:
    """Rows in [since, until), of one model, below a directory."""
    for at, keep in ((since, F.col("ts_ms") >= F.lit(since)), (until, F.col("ts_ms") < F.lit(until)), (model, F.col("model_key") == F.lit(model))):
        rows = rows if at is None else rows.where(keep)
    return rows if under is None else rows.where(below(F.col("cwd"), under))


def report(rows: DataFrame, by: str, tz: str = "UTC", under: str | None = None, depth: int = 1, roots: DataFrame | None = None) -> DataFrame:
    """A row a key. The invariant: sums over the rows of any grouping are the totals."""
    rows = with_roots(rows, roots) if by == "project" and roots is not None else rows.withColumn("root", F.lit(None).cast("string"))
    return summed(chosen(rows, under=under).withColumn("key", dimension(by, tz, under or "/", depth)), "key")


def folded(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` dearest keys (cost, then tokens, then key) and one row (other), its sessions counted once each."""
    keyed = rows.withColumn("root", F.lit(None).cast("string")).withColumn("key", dimension(by))
    tokens = sum((F.col(c) for c in SUMS[1:4]), F.col("input"))
    top = summed(keyed, "key").orderBy(F.desc(F.coalesce("cost", F.lit(0.0))), F.desc(tokens), "key").limit(limit).select("key", F.lit(True).alias("top"))
    return summed(keyed.join(top, "key", "left").withColumn("key", F.when(F.col("top"), F.col("key")).otherwise(F.lit("(other)"))), "key")


SORTS = ("auto", "cost", "tokens", "steps", "sessions", "prompts", "key")
BY_TIME = ("day", "hour", "weekday", "weekday_hour")


def ordered(rows: DataFrame, by: str, sort: str = "auto", limit: int = 20, tz: str = "UTC") -> DataFrame:
    """The first ``limit`` keys of a report with their place from 1, and last a row (other) of all that is left, labelled with their number.

    ``auto`` is by key for dimensions of time and by cost for others. Costs that are not known count as nothing, equal
    costs go by tokens, and what is still equal by key. Sums over the rows are the totals; a session counts once a row.
    """
    if sort not in SORTS:
        raise ValueError(f"unknown sort {sort!r}; one of {', '.join(SORTS)}")
    sort = ("key" if by in BY_TIME else "cost") if sort == "auto" else sort
    keyed = rows.withColumn("root", F.lit(None).cast("string")).withColumn("key", dimension(by, tz))
    tokens = sum((F.col(c) for c in SUMS[1:4]), F.col("input"))
    order = {"cost": [F.desc(F.coalesce("cost", F.lit(0.0))), tokens.desc()], "tokens": [tokens.desc()], "key": []}.get(sort, [F.desc(sort)])
    # Only the limited rows are numbered in one task.
    first = summed(keyed, "key").orderBy(*order, "key").limit(limit)
    top = first.select("key", F.row_number().over(Window.orderBy(*order, "key")).cast("bigint").alias("place"))
    marked = keyed.join(top, "key", "left").withColumn("own", F.col("key")).withColumn("key", F.when(F.col("place").isNotNull(), F.col("key")).otherwise(F.lit("(other)"))).withColumn("place", F.coalesce("place", F.lit(limit + 1)))
    label = F.when(F.col("place") <= limit, F.first("key")).otherwise(F.concat(F.count_distinct("own").cast("string"), F.lit(" more"))).alias("label")
    return summed(marked, "place", "key").join(marked.groupBy("place").agg(label), "place")


def session_totals(steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Sums of each session, the context of its last step and the limit of that step's model."""
    context = F.col("input") + F.col("cache_read") + F.col("cache_write")
    totals = steps.groupBy("session").agg(F.count("*").alias("steps"), F.sum("input").cast("bigint").alias("input"), F.sum("output").cast("bigint").alias("output"), usd_sum("pico").alias("cost"), F.max_by(context, "step_idx").alias("context_tokens"), F.max_by("model_key", "step_idx").alias("last_model"))
    # Sessions end with few models: joined by a shuffle, nearly all of them would meet in a few tasks. A catalog's size does not follow the steps.
    limits = F.broadcast(catalog.select(F.col("id").alias("last_model"), "context_limit"))
    return totals.join(limits, "last_model", "left").withColumn("context_pct", F.col("context_tokens") * 100.0 / F.col("context_limit"))


def turn_totals(steps: DataFrame, prompts: DataFrame) -> DataFrame:
    """Steps, prompts, tokens and cost of each turn, and its earliest known time."""
    a = steps.select("session", "turn", "ts_ms", F.lit(1).alias("s"), F.lit(0).alias("p"), "input", "output", "pico")
    b = prompts.select("session", "turn", "ts_ms", F.lit(0).alias("s"), F.lit(1).alias("p"), F.lit(0).cast("bigint").alias("input"), F.lit(0).cast("bigint").alias("output"), F.lit(None).cast("bigint").alias("pico"))
    return a.unionByName(b).groupBy("session", "turn").agg(F.min(F.when(F.col("ts_ms") > 0, F.col("ts_ms"))).alias("started_at"), F.sum("s").cast("bigint").alias("steps"), F.sum("p").cast("bigint").alias("prompts"), F.sum("input").cast("bigint").alias("input"), F.sum("output").cast("bigint").alias("output"), usd_sum("pico").alias("cost"))


def models_seen(steps: DataFrame) -> DataFrame:
    """A row a raw model name: its key, steps, sessions and cost."""
    named = steps.withColumn("model", F.coalesce("model", F.lit("")))
    return named.groupBy("model", "model_key").agg(F.count("*").alias("steps"), F.count_distinct("session").alias("sessions"), usd_sum("pico").alias("cost"))


def against_before(rows: DataFrame, since: int, until: int) -> DataFrame:
    """Cost of a period, of the equally long one before it, and the daily mean, by harness."""
    days = (until - since) / 86_400_000
    inside = (F.col("ts_ms") >= since) & (F.col("ts_ms") < until)
    before = (F.col("ts_ms") >= 2 * since - until) & (F.col("ts_ms") < since)
    out = rows.groupBy("harness").agg(usd_sum(F.when(inside, F.col("pico"))).alias("cost"), usd_sum(F.when(before, F.col("pico"))).alias("cost_before"))
    return out.withColumn("daily_mean", F.col("cost") / days)


def share_of_day(rows: DataFrame) -> DataFrame:
    """Cost by day and model, with its share of the day."""
    keyed = rows.withColumn("root", F.lit(None).cast("string")).withColumn("day", dimension("day")).where("is_step = 1")
    each = keyed.groupBy("day", "model_key").agg(F.sum(F.col("pico").cast("decimal(28,0)")).alias("pico"))
    share = F.col("pico").cast("double") / F.sum("pico").over(Window.partitionBy("day")).cast("double")
    return each.select("day", "model_key", usd(F.col("pico")).alias("cost"), share.alias("share"))
