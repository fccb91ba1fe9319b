"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

An item's windows of ``WINDOW`` words are sets of ``SHINGLE``-word shingles. A document contains a window only if it has
all of its shingles (containment one), so one necessary shingle is prefix enough: the one that is rarest in the corpus.
Document positions are joined on that shingle's hash; its place inside the window gives the window's start in the
document (positional bound), which must leave room for the whole window (length bound); the words then decide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, fresh, only, saved, table

WINDOW, SHINGLE = 10, 3
#: Distinct benchmark shingles up to which their table is broadcast; beyond it Spark shuffles both sides.
BROADCAST_ROWS = 500_000
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, with one space between; null or empty: the empty string."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAP, " "))


def words(text: Column) -> Column:
    """The words of a text; null or empty: none."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def shingles(spaced_words: Column, size: int) -> Column:
    """The shingles of ``size`` words that start at each word, as strings; one regular expression keeps this in compiled code."""
    return F.regexp_extract_all(spaced_words, F.lit("(?=(" + " ".join(["[^ ]+"] * size) + "))[^ ]+"), F.lit(1))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, win, w): the windows of every item; an item of fewer words, but not none, is one window. Each has a hash ``win``."""
    listed = only(items, item_id="string", text="string").select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    each = listed.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("ws", i + 1, F.lit(window)))).alias("w"))
    return each.distinct()


#: Stands for a null doc_id; rows are told apart by their id and a hash of their text.
NO_ID = (1 << 63) - 1


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, t, text) of every row."""
    whole = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.col("text").cast("string").alias("text"))
    return whole.select("doc_id", "d", F.xxhash64("text").alias("t"), "text")


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(d, t, start, length, item_id): every place where a window of an item stands in a document."""
    wins = saved(item_windows(items, window))
    lone = wins.select("w").distinct().select("w", F.size("w").alias("length"), F.least(F.size("w"), F.lit(SHINGLE)).alias("size"))
    # A window has three-word shingles unless it is shorter than that: at most three sizes, whatever the benchmark is.
    sizes = [r["size"] for r in lone.select("size").distinct().orderBy("size").limit(SHINGLE).collect()] or [SHINGLE]
    each = lone.select("w", "length", F.posexplode(F.expr("transform(sequence(1, length - size + 1), i -> xxhash64(array_join(slice(w, i, size), ' ')))")).alias("offset", "h"))
    own = saved(each)
    wanted = own.select("h").distinct()
    few = wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    wanted = F.broadcast(wanted) if few else wanted
    texts = keyed(docs)
    clean = texts.select("d", "t", spaced(F.col("text")).alias("ws"))
    spots = [clean.select("d", "t", F.posexplode(shingles(F.col("ws"), n)).alias("pos", "s")).select("d", "t", "pos", F.xxhash64("s").alias("h")) for n in sizes]
    found = saved(reduce(DataFrame.unionByName, spots).join(wanted, "h", "left_semi"))
    seen = found.groupBy("h").agg(F.count("*").alias("n"))
    # The prefix: of each window's shingles the rarest in the corpus; one that the corpus lacks rules the window out.
    counted = own.join(seen, "h", "left").select("w", "length", "offset", "h", F.coalesce("n", F.lit(0)).alias("n"))
    prefix = counted.groupBy("w", "length").agg(F.min(F.struct("n", "h", "offset")).alias("p")).where("p.n > 0").select("w", "length", F.col("p.h").alias("h"), F.col("p.offset").alias("offset"))
    near = found.join(F.broadcast(prefix) if few else prefix, "h").select("d", "t", (F.col("pos") - F.col("offset")).alias("start"), "length", "w").where("start >= 0").distinct()
    # Exact words: candidates of a document meet its text once, as one row, so no text is copied per candidate.
    asked = near.groupBy("d", "t").agg(F.collect_list(F.struct("start", "length", "w")).alias("c"))
    met = texts.join(asked, ["d", "t"]).select("d", "t", words(F.col("text")).alias("ws"), "c")
    sure = met.select("d", "t", F.explode(F.filter("c", lambda c: (c["start"] + c["length"] <= F.size("ws")) & (F.slice("ws", c["start"] + 1, c["length"]) == c["w"]))).alias("c"))
    return sure.select("d", "t", "c.start", "c.length", "c.w").join(wins, "w").select("d", "t", "start", "length", "item_id").distinct()


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every row.

    Null and empty texts have no words and are clean; null item texts have no windows; a null item_id counts as the
    empty string; rows that share a doc_id, or have none, are each judged by their own text; an empty benchmark leaves
    every document clean.
    """
    hits = saved(occurrences(docs, items, window))
    spans = hits.select("d", "t", "start", "length").distinct()
    marked = spans.select("d", "t", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("at")).distinct().groupBy("d", "t").agg(F.count("*").alias("n_hit"))
    items_of = hits.select("d", "t", F.coalesce("item_id", F.lit("")).alias("item_id")).distinct().groupBy("d", "t").agg(F.sort_array(F.collect_list("item_id")).alias("items"))
    counted = keyed(docs).select("doc_id", "d", "t", F.size(words(F.col("text"))).cast("bigint").alias("n_words"))
    out = counted.join(marked.join(items_of, ["d", "t"]), ["d", "t"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP6_SQL = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
w AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(list_slice(ws, i, i + {WINDOW} - 1), ' ') AS t
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW} + 1, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM w),
p AS (SELECT doc_id, n, i, array_to_string(list_slice(ws, i, i + n - 1), ' ') AS t
      FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, sizes WHERE len(ws) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, w.item_id FROM p JOIN w ON p.t = w.t AND p.n = w.n),
k AS (SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS spot FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN m ON d.doc_id = m.doc_id
"""


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without those that hold a window of an item, all columns as they came.

    Null and empty texts stay; rows are judged each by their own text, whatever their ids; an empty benchmark keeps all.
    """
    d, t = fresh(docs, "d", "t")
    hit = occurrences(docs, items).select(F.col("d").alias(d), F.col("t").alias(t)).distinct()
    same = (F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)) == F.col(d)) & (F.xxhash64(F.col("text").cast("string")) == F.col(t))
    return docs.join(hit, same, "left_anti")
