"""The driver's tables as canonical frames: events, sessions, documents to search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import epoch_ms

WEEK_MS = 604_800_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def harness(user: str) -> str:
    return f"element_at(array('alpha', 'beta', 'gamma', 'delta'), cast({user} % 4 + 1 as int))"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every delivery: session, harness, user_id, cwd, seq, id, ts_ms, kind, model, call_id and token counts; some ids come twice."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", epoch_ms(F.col("ts")).alias("ts_ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    kind = F.expr("case event_type when 'signup' then 'user_message' when 'view' then 'tool_call' when 'click' then 'assistant_message' when 'purchase' then 'usage' else if(k % 2 = 0, 'turn_end', 'system') end")
    model = F.expr("case when event_type in ('purchase', 'click') then case k % 6 when 0 then 'model-a' when 1 then 'vendor/model-a' when 2 then 'model-b' when 3 then 'model-b[1m]' when 4 then 'model-x' end end")
    own = e.select(
        F.expr(f"concat({harness('user_id')}, ':u', user_id, '-w', ts_ms div {WEEK_MS})").alias("session"), F.expr(harness("user_id")).alias("harness"), "user_id",
        F.expr("concat('/w/repo', user_id % 5, '/sub', user_id % 3)").alias("cwd"), F.col("event_id").alias("seq"), F.expr("concat('e', event_id)").alias("id"), "ts_ms", kind.alias("kind"), model.alias("model"),
        F.expr("cast(floor(value * 10) as bigint)").alias("input"), F.col("k").alias("output"), (F.col("k") * 50).alias("cache_read"), F.expr("(event_id % 3) * k").alias("cache_write"), F.expr("k div 4").alias("reasoning"))
    again = own.where("seq % 17 = 0").withColumns({"seq": F.col("seq") + 1_000_000_000, "input": F.col("input") + 1})
    return own.unionByName(again)


def sessions(raw: DataFrame) -> DataFrame:
    """One row a session, with its parent: the session of user ``user_id div 3`` in the same week, where there is one."""
    own = raw.groupBy("session", "harness", "user_id", "cwd").agg(F.min("ts_ms").alias("started_at"), F.max("ts_ms").alias("updated_at"), F.count_distinct("id").alias("n_events"))
    week = F.substring_index("session", "-w", -1)
    linked = own.withColumn("p", F.concat(F.expr(harness("(user_id div 3)")), F.lit(":u"), F.expr("user_id div 3"), F.lit("-w"), week))
    there = own.select(F.col("session").alias("parent"))
    return linked.join(there, (F.col("p") == F.col("parent")) & (F.col("p") != F.col("session")), "left").drop("p")
