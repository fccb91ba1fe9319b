"""Parent and child sessions: ancestors by pointer doubling, and totals over descendants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import usd_sum
from . import chains


def ancestors(sessions: DataFrame) -> DataFrame:
    """(session, ancestor, depth) along ``parent`` links; a chain ends where it would meet itself. Self-parents have no family."""
    return chains.closure(sessions.select(F.col("session").alias("node"), "parent")).withColumnRenamed("node", "session")


def totals(sessions: DataFrame, usage: DataFrame) -> DataFrame:
    """Sums over each session that has descendants and over those; ``sessions`` does not count the root itself."""
    pairs = ancestors(sessions)
    both = pairs.select(F.col("ancestor").alias("root"), "session", F.lit(1).alias("n")).unionByName(pairs.select(F.col("ancestor").alias("root"), F.col("ancestor").alias("session"), F.lit(0).alias("n")).distinct())
    return both.join(usage, "session", "left").groupBy("root").agg(F.sum("n").cast("bigint").alias("sessions"), F.coalesce(F.sum("steps"), F.lit(0)).cast("bigint").alias("steps"), F.coalesce(F.sum("input"), F.lit(0)).cast("bigint").alias("input"), F.coalesce(F.sum("output"), F.lit(0)).cast("bigint").alias("output"), usd_sum("pico").alias("cost"))
