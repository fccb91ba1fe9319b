"""SimHash near-duplicate detection with multi-index hashing.

Fingerprints are 64 bits over 3-word shingles; two documents are linked when their fingerprints differ in at most two
bits. Identical fingerprints become one representative first, so copies cost one row however many there are. The
fingerprint has two 32-bit segments, and each segment's Hamming ball of radius one is enumerated beside the other
segment's value. Two fingerprints are at distance two or less exactly if their balls share a point, so one table over the
points holds all matches; a point is near at most 65 fingerprints, whatever the corpus holds, so no table entry is ever
large and no group is expanded into all its pairs. What a table entry brings together is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, only, saved, table

WORDS, SEED, BITS = 3, 42, 64


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The fingerprint of one text as a signed 64-bit number; null, or no word: zero."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) <= words:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(found), SEED)], dtype=np.uint64)
    else:
        joined, digest = b" ".join(found), xxhash.xxh64_intdigest
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[: -words] + 1))
        hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[words - 1 :].tolist())), np.uint64, len(found) - words + 1)
    count = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 4096):
        count += np.unpackbits(hashes[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(count * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            fps = pa.array([fingerprint(texts[i].as_py()) for i in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fps], names=["doc_id", "fp"])

    return only(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, fp bigint")


def links(fps: DataFrame, most: int = 2) -> DataFrame:
    """Links (a, b) between different fingerprints whose connected parts are those of distance ``most`` = 2; ``fps`` has distinct fp.

    All members of a table entry are within ``most`` of each other, so links from its smallest member to the others are enough.
    A member is one bit away from its point, or is the point: the entry is a mask of bits, combined by ``bit_or``.
    """
    assert most == 2, "balls of radius one meet at distance two"
    flip = "if(bit < 0, 0L, shiftleft(1L, bit))"
    # Each fingerprint becomes 65 rows, so they are dealt out before that; by a hash, as dealing by the fingerprint itself is
    # taken for the exchange that made them distinct, which then is packed into a few tasks.
    dealt = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fp"))
    balls = dealt.select("fp", F.explode(F.expr(f"sequence(-1, {BITS - 1})")).alias("bit"))
    points = balls.select(F.expr(f"fp ^ {flip}").alias("point"), F.expr(flip).alias("mask"), F.expr("if(bit < 0, 1, 0)").alias("own"))
    entries = points.groupBy("point").agg(F.bit_or("mask").alias("mask"), F.max("own").alias("own")).where("bit_count(mask) + own > 1")
    members = f"concat(transform(filter(sequence(0, {BITS - 1}), k -> (mask & shiftleft(1L, k)) <> 0), k -> point ^ shiftleft(1L, k)), if(own = 1, array(point), array()))"
    listed = entries.select(F.expr(members).alias("members")).select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    return listed.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most)).distinct()


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row.

    A null or empty text has fingerprint zero and is linked like any other; rows with the same doc_id each keep their own
    fingerprint; a null doc_id takes part in links but never becomes a component's id (a group of such rows alone has a
    null one). An empty table gives no rows.
    """
    fps = saved(fingerprints(docs))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    near, _ = components(links(reps.select("fp")))
    least = reps.join(near, reps.fp == near.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "rep")
    roots = least.groupBy("root").agg(F.min("rep").alias("component_id"))
    ids = least.join(roots, "root").select("fp", "component_id")
    # One row a fingerprint on the right; the left may hold one fingerprint very often, which a skewed join splits.
    return fps.join(ids, "fp").select("doc_id", "fp", "component_id")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame) -> DataFrame:
    """The documents with exactly one row of each group kept.

    It is the one with the smallest doc_id, then hash of its text, then number in the written table; null ids come last.
    Rows are grouped and dropped by their number, so repeated rows, ids that stand on several texts and null ids are rows like any other.
    """
    row = "_row" + "_" * max(map(len, docs.columns))
    rows = saved(docs.select("*", F.monotonically_increasing_id().alias(row)))
    found = groups(rows.select(F.col(row).alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    named = rows.select(F.col(row).alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("bigint").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("t"), F.col(row).alias("row")).alias("place"))
    placed = saved(found.join(named, "row"))
    firsts = placed.groupBy("component_id").agg(F.min("place").alias("kept"))
    drop = placed.join(firsts, "component_id").where("row <> kept.row").select(F.col("row").alias(row))
    return rows.join(drop, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
