"""Sorts, pages and kept tables at their edges."""

import pytest
from pyspark.sql import functions as F

from tracemill import catalog, storage
from tracemill.operators import search, timeline, usage

FACTS = "session string, harness string, cwd string, ts_ms bigint, model_key string, is_step int, is_prompt int, " + ", ".join(f"{c} bigint" for c in usage.SUMS) + ", pico bigint, unpriced int"


def test_orders(spark):
    row = lambda s, cost, tokens, steps: (s, "h", None, 10**12, "m", steps, 1, tokens, 0, 0, 0, 0, cost, 0)
    facts = spark.createDataFrame([row("a", 5, 1, 1), row("b", 5, 2, 1), row("c", None, 9, 4), row("d", 7, 0, 2), row("e", None, 9, 3)], FACTS)
    got = {s: [r["key"] for r in usage.ordered(facts, "session", s, 3).orderBy("place").collect()] for s in usage.SORTS}
    assert got == {"auto": ["d", "b", "a", "(other)"], "cost": ["d", "b", "a", "(other)"], "tokens": ["c", "e", "b", "(other)"], "steps": ["c", "e", "d", "(other)"], "sessions": ["a", "b", "c", "(other)"], "prompts": ["a", "b", "c", "(other)"], "key": ["a", "b", "c", "(other)"]}
    assert [(r["label"], r["sessions"]) for r in usage.ordered(facts, "session", "cost", 3).where("place = 4").collect()] == [("2 more", 2)]
    assert usage.ordered(facts, "session", "cost", 9).where("key = '(other)'").count() == 0
    assert [r["key"] for r in usage.ordered(facts, "day").collect()] == ["2001-09-09"]
    assert usage.ordered(facts.limit(0), "day").count() == 0
    with pytest.raises(ValueError):
        usage.ordered(facts, "day", "size")


def test_event_pages_follow_each_other(spark):
    events = spark.createDataFrame([("a", n) for n in range(7)] + [("b", 3)], "session string, seq bigint")
    seen, cursor = [], None
    for _ in range(4):
        page = timeline.page(events, 3, cursor).collect()
        seen.append(sorted((r["session"], r["seq"]) for r in page))
        nexts = {(r["session"], r["next_before"]) for r in page if r["next_before"] is not None}
        cursor = spark.createDataFrame(list(nexts), "session string, before bigint")
    assert seen == [[("a", 4), ("a", 5), ("a", 6), ("b", 3)], [("a", 1), ("a", 2), ("a", 3)], [("a", 0)], []]


def test_session_pages_do_not_overlap(spark):
    hits = spark.createDataFrame([(f"s{n}", 1.0 if n % 2 else 2.0) for n in range(9)] + [("s1", 0.5)], "session string, score double")
    sessions = spark.createDataFrame([(f"s{n}", n // 4) for n in range(9)], "session string, updated_at bigint")
    pages = [[r["session"] for r in search.sessions_page(hits, sessions, 4, k).orderBy("place").collect()] for k in (0, 4, 8, 12)]
    assert pages == [["s8", "s4", "s6", "s0"], ["s2", "s5", "s7", "s1"], ["s3"], []]


def test_kept_tables_follow_their_source_and_version(spark, tmp_path):
    source = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(source)
    built = []
    make = lambda: built.append(1) or spark.read.parquet(source).select(F.sum("id").alias("s"))
    value = lambda version="": storage.once(spark, "test", source, make, version).first()["s"]
    assert (value(), value(), len(built)) == (3, 3, 1)
    assert (value("2"), value("2"), len(built)) == (3, 3, 2)
    spark.range(5).write.mode("overwrite").parquet(source)
    assert (value("2"), len(built)) == (10, 3)
    storage.dropped(storage.once(spark, "test", source, make, "2"))
    assert (value("2"), len(built)) == (10, 4)


def test_session_totals_shuffle_by_session_alone(spark):
    """Sessions end with few models, so a shuffle by the last model puts them in a few tasks."""
    plan = catalog.QUERIES["session_totals"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(session" in plan and "hashpartitioning(last_model" not in plan
