"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent and normalised. The exponent comes from bisection: the weights'
entropy rises as the exponent falls, and so does the most that any source must repeat, so either a target entropy or a
limit on repetition fixes it. Weights become token budgets; a budget is met by whole passes over the source and a part
of one more. Each pass is a permutation of the source's blocks (and of the rows in a block) by hash, so that the part
pass takes whole blocks in order and only its last block is cut, by a running sum inside that block.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import saved, table

#: Blocks a source is dealt into by hash. A block of the largest source holds a 4096th of it.
BLOCKS = 4096
#: No source is repeated more often than this; the total budget is the number of tokens there are.
MOST_REPEATS = 4.0
SEED = 17


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def weights(tokens: dict, exponent: float) -> dict:
    """Normalised shares ** exponent; sources without tokens get none."""
    total = sum(tokens.values())
    raw = {s: (n / total) ** exponent if n else 0.0 for s, n in tokens.items()} if total else dict.fromkeys(tokens, 0.0)
    whole = sum(raw.values())
    return {s: w / whole if whole else 0.0 for s, w in raw.items()}


def exponent_for(tokens: dict, budget: float, target_entropy: float | None = None, most_repeats: float | None = MOST_REPEATS, steps: int = 60) -> float:
    """The least exponent in [0, 1] whose weights stay within the repetition limit, or that meets the target entropy.

    One exactly (natural shares) where even that is over the limit, or the target is under the natural entropy; zero
    (equal weights) where all is allowed or the target is over the greatest entropy.
    """

    def fits(x: float) -> bool:
        w = weights(tokens, x)
        if target_entropy is not None:
            return entropy(list(w.values())) <= target_entropy
        return all(w[s] * budget <= most_repeats * n * (1 + 1e-12) for s, n in tokens.items() if n)

    if fits(0.0):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(steps):
        mid = (low + high) / 2
        low, high = (low, mid) if fits(mid) else (mid, high)
    return high


def mix(docs: DataFrame, budget: float | None = None, target_entropy: float | None = None, most_repeats: float | None = MOST_REPEATS) -> DataFrame:
    """(doc_id, source, pass, block, position, n_tokens): a row for each time a document is taken, position its place in its block and pass.

    Tokens are words by white space. A null source is a source of its own; null and empty texts have no tokens and are
    taken as often as whole passes go over their source; equal rows are separate rows. A source's taken tokens are
    within one document of its budget. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    n_tokens = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), n_tokens.alias("n_tokens"), F.xxhash64(text).alias("t"))
    block = F.pmod(F.xxhash64("doc_id", "t", F.lit(SEED)), F.lit(BLOCKS)).cast("int")
    rows = saved(rows.select("*", block.alias("block")))
    # At most BLOCKS rows a source; the driver sees one row a source.
    sums = rows.groupBy("source", "block").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
    tokens = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    spark = docs.sparkSession
    total = float(sum(tokens.values()) if budget is None else budget)
    w = weights(tokens, exponent_for(tokens, total, target_entropy, most_repeats))
    plan = []
    for s, n in tokens.items():
        goal = round(w[s] * total)
        plan.append((s, goal // n if n else 1, goal % n if n else 0))
    plan = spark.createDataFrame(plan, "p_source string, whole bigint, part bigint")
    passes = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole"))).alias("pass")
    # Block order of the part pass, at most BLOCKS rows a source: which blocks fit whole, and how much the cut one gives.
    order = F.xxhash64("block", "whole", F.lit(SEED + 1))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sums.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("order", order).withColumn("room", F.col("part") - before)
    blocks = ranked.select(F.col("source").alias("b_source"), F.col("block").alias("b_block"), "whole", passes, "room", "n").where((F.col("pass") < F.col("whole")) | (F.col("room") > 0))
    taken = rows.join(blocks, F.col("source").eqNullSafe(F.col("b_source")) & (F.col("block") == F.col("b_block")))
    inside = Window.partitionBy("source", "block", "pass").orderBy("shuffled", "doc_id", "t")
    placed = taken.withColumn("shuffled", F.xxhash64("doc_id", "t", "pass", F.lit(SEED + 2))).withColumn("position", F.row_number().over(inside).cast("bigint"))
    placed = placed.withColumn("run", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    return placed.where((F.col("pass") < F.col("whole")) | (F.col("run") < F.col("room"))).select("doc_id", "source", "pass", "block", "position", "n_tokens")


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
