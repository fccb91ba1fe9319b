"""Prices of model calls: catalog layers, the as-of segment, the prompt-size tier, and costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.columns import base_name, match_key, strip_date

RATE = "input: double, output: double, cache_read: double, cache_write: double"
SCHEMA = f"id string, prices array<struct<from: bigint, {RATE}, tiers: array<struct<above: bigint, {RATE}>>>>, context_limit bigint"
#: A small catalog for the driver's tables, in USD per million tokens.
SAMPLE = [
    ("model-a", [(0, 3.0, 15.0, 0.3, None, []), (1705276800000, 4.0, 20.0, 0.4, None, [(3000, 6.0, 30.0, 0.6, None)])], 200000),
    ("model-b", [(0, 1.0, 5.0, 0.1, None, [])], 100000),
]


def sample_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SAMPLE, SCHEMA)


def layered(layers: list[DataFrame]) -> DataFrame:
    """Catalog entries by match key, the first layer that has one winning; within a layer the smallest id."""
    ranked = None
    for n, layer in enumerate(layers):
        part = layer.withColumn("layer", F.lit(n)).withColumn("match_key", match_key(F.col("id")))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = Window.partitionBy("match_key").orderBy("layer", "id")
    return ranked.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")


def consensus(offers: DataFrame) -> DataFrame:
    """Median prices of (id, input, output) offers by match key, rounded to six places; offers that cost nothing count only where all do."""
    keyed = offers.withColumn("match_key", match_key(F.col("id"))).withColumn("paid", (F.col("input") > 0) | (F.col("output") > 0))
    some = keyed.withColumn("any_paid", F.max("paid").over(Window.partitionBy("match_key"))).where("paid or not any_paid")
    return some.groupBy("match_key").agg(F.round(F.median("input"), 6).alias("input"), F.round(F.median("output"), 6).alias("output"), F.count("*").alias("n_offers"))


def model_map(models: DataFrame, catalog: DataFrame) -> DataFrame:
    """(model, match_kind, id) of each distinct model name.

    The name without provider path and suffix is exact on an id's match key; approximate on an id without its date, or
    on the longest run of its dash-separated words that starts with a letter and is an id.
    """
    names = models.select("model").distinct().where("model <> ''").withColumn("key", match_key(base_name(F.col("model"))))
    ids = catalog.select("id", match_key(F.col("id")).alias("k"))
    undated = ids.select("id", strip_date(F.col("k")).alias("k")).groupBy("k").agg(F.max("id").alias("id"))
    words = names.withColumn("ws", F.split("key", "[-:]"))
    runs = words.select("model", "key", F.explode(F.expr("flatten(transform(sequence(1, size(ws)), i -> transform(sequence(i, size(ws)), j -> named_struct('n', j - i + 1, 'start', i, 'run', array_join(slice(ws, i, j - i + 1), '-')))))")).alias("r")).where("r.run rlike '^[a-z]' and (r.n > 1 or r.run rlike '[0-9]')")
    exact = names.join(ids, F.col("key") == F.col("k")).select("model", "id", F.lit(0).alias("rank"), F.lit(0).alias("n"))
    dated = names.join(undated, F.col("key") == F.col("k")).select("model", "id", F.lit(1).alias("rank"), F.lit(0).alias("n"))
    windows = runs.join(undated, F.col("r.run") == F.col("k")).select("model", "id", F.lit(2).alias("rank"), (-F.col("r.n")).alias("n"))
    best = exact.unionByName(dated).unionByName(windows).groupBy("model").agg(F.min(F.struct("rank", "n", "id")).alias("b"))
    return best.select("model", F.when(F.col("b.rank") == 0, F.lit("exact")).otherwise(F.lit("approx")).alias("match_kind"), "b.id")


PARTS = ("input", "output", "cache_read", "cache_write")


def priced(steps: DataFrame, catalog: DataFrame) -> DataFrame:
    """Steps with ``model_key``, ``pico`` (cost in whole 1e-12 USD, null where no price is known), its parts and ``source``.

    Rates are USD per million tokens, read to six places, so that costs are exact whole numbers and sum alike in any
    order. The segment is the last that began by the step's time, else the first; the tier the highest that the prompt is
    above; a missing cache-write price is 1.25 of the input price. A positive ``reported`` cost (USD) comes before the
    catalog; a step without any tokens, reasoning included, costs nothing whatever its model.
    """
    # Spark broadcasts the names if they are few; how many there are grows with the steps.
    known = model_map(steps, catalog).join(catalog.select("id", "prices"), "id").withColumnRenamed("id", "id_")
    with_price = steps.join(known, "model", "left")
    segment = F.expr("coalesce(try_element_at(filter(prices, s -> s.from <= ts_ms), -1), try_element_at(prices, 1))")
    out = with_price.withColumn("seg", segment).withColumn("prompt", F.col("input") + F.col("cache_read") + F.col("cache_write"))
    out = out.withColumn("tier", F.expr("array_max(filter(seg.tiers, t -> prompt > t.above))"))
    micro = lambda rate: F.round(rate * 1e6).cast("bigint")
    rate = {name: micro(F.coalesce(f"tier.{name}", f"seg.{name}")) for name in PARTS[:3]}
    own_write = F.when(F.col("tier").isNotNull(), F.col("tier.cache_write")).otherwise(F.col("seg.cache_write"))
    base = micro(F.when(F.col("tier").isNotNull(), F.col("tier.input")).otherwise(F.col("seg.input")))
    rate["cache_write"] = F.coalesce(micro(own_write), F.floor(base * 5 / 4).cast("bigint"))
    each = {name: F.col(name) * rate[name] for name in PARTS}
    catalog_cost = each["input"] + each["output"] + each["cache_read"] + each["cache_write"]
    reported = F.col("reported") if "reported" in steps.columns else F.lit(None).cast("double")
    told = F.when((reported > 0) & (reported < float("inf")), F.round(reported * 1e12).cast("bigint"))
    nothing = (F.col("prompt") + F.col("output") + F.col("reasoning")) == 0
    key = F.when(F.coalesce("model", F.lit("")) == "", F.lit("")).when(F.col("match_kind") == "exact", F.col("id_")).otherwise(base_name(F.col("model")))
    source = F.when(told.isNotNull(), "harness").when(catalog_cost.isNotNull(), F.when(F.col("match_kind") == "exact", "catalog").otherwise("approx"))
    parts = [F.when(told.isNull(), each[name]).alias(f"pico_{name}") for name in PARTS]
    kept = [F.col(f"`{c}`") for c in steps.columns]
    return out.select(*kept, key.alias("model_key"), F.coalesce(told, catalog_cost, F.when(nothing, F.lit(0).cast("bigint"))).alias("pico"), *parts, source.alias("source"))
