"""Trajectories: child links against a plain greedy version, results of calls, times of steps."""

import random

from tracemill.operators import timeline

CHILD = "child string, parent string, parent_call string, started_at bigint"
CALL = "session string, id string, call_id string, name string, ts_ms bigint, seq bigint"
STEP = "session string, id string, started_at bigint, ts_ms bigint"


def greedy(children, calls, steps):
    got = {}
    for parent in {c[1] for c in children if c[1] is not None}:
        kids = sorted((c for c in children if c[1] == parent), key=lambda c: (c[3], c[0]))
        own = sorted((c for c in calls if c[0] == parent), key=lambda c: c[5])
        took = set()
        for child, _, named, _ in kids:
            hit = next((c for c in own if named is not None and c[2] == named), None)
            if hit:
                took.add(hit[1])
                got[child] = (hit[1], None)
        for child, _, named, start in kids:
            free = [c for c in own if c[1] not in took and c[4] <= start and any(w in c[3].lower() for w in ("agent", "task", "spawn"))]
            if child in got or named is not None or not free:
                continue
            best = max(free, key=lambda c: (c[4], c[5]))
            took.add(best[1])
            got[child] = (best[1], None)
        order = sorted((s for s in steps if s[0] == parent), key=lambda s: s[2])
        for child, _, _, start in kids:
            if child not in got:
                begun = [s for s in order if s[2] <= start]
                inside = [s for s in begun if start <= s[3]]
                got[child] = (None, inside[0][1] if inside else begun[-1][1] if begun else None)
    return got


def test_child_links_take_calls_as_a_greedy_pass_would(spark):
    rng = random.Random(5)
    children, calls, steps = [(f"lost{i}", None, None, 3) for i in range(2)], [], []
    for p in range(30):
        session = f"s{p}"
        for i in range(rng.randint(0, 9)):
            calls.append((session, f"e{i}", f"c{rng.randint(0, 6)}", rng.choice(["Task", "grep", "spawn_x", "my_Agent"]), rng.randint(0, 20), i))
        at = 0
        for i in range(rng.randint(0, 4)):
            begin = at + rng.randint(0, 2) + (1 if i else 0)
            at = begin + rng.randint(1, 4)
            steps.append((session, f"u{i}", begin, at))
        for i in range(rng.randint(0, 8)):
            children.append((f"{session}k{i}", session, rng.choice([None, None, None, "c1", "none"]), rng.randint(0, 22)))
    found = timeline.child_links(spark.createDataFrame(children, CHILD), spark.createDataFrame(calls, CALL), spark.createDataFrame(steps, STEP)).collect()
    assert {r["child"]: (r["call"], r["step"]) for r in found} == greedy(children, calls, steps)
    assert len(found) == len(children) - 2


def test_child_links_of_nothing(spark):
    empty = lambda s: spark.createDataFrame([], s)
    assert timeline.child_links(empty(CHILD), empty(CALL), empty(STEP)).count() == 0
    assert [tuple(r) for r in timeline.child_links(spark.createDataFrame([("a", "p", None, 1)], CHILD), empty(CALL), empty(STEP)).collect()] == [("a", "p", None, None)]


def test_results_go_to_the_last_call_before_them(spark):
    e = "session string, id string, seq bigint, kind string, call_id string, name string, ts_ms bigint, is_error boolean, text string"
    rows = [("s", "a", 1, "tool_call", "c", "x", 10, None, None), ("s", "r1", 2, "tool_result", "c", None, 11, None, "one"), ("s", "r2", 3, "tool_result", "c", None, 12, True, "two"), ("s", "b", 4, "tool_call", "c", "y", 13, None, None), ("s", "r0", 5, "tool_result", "zz", None, 14, None, "lost"), ("s", "d", 6, "tool_call", None, "n", 15, None, None)]
    got = {r["id"]: (r["ended_at"], r["is_error"], r["result"], r["running"]) for r in timeline.tool_results(spark.createDataFrame(rows, e)).collect()}
    assert got == {"a": (12, True, "two", False), "b": (None, None, None, True), "d": (None, None, None, True)}


def test_steps_last_until_their_results(spark):
    e = "session string, id string, seq bigint, kind string, turn bigint, first boolean, ts_ms bigint"
    rows = [("s", "p", 1, "user_message", 1, True, 5), ("s", "c", 2, "tool_call", 1, True, 8), ("s", "u", 3, "usage", 1, True, 9), ("s", "u2", 4, "usage", 1, True, 15), ("s", "u3", 5, "usage", 1, True, 16)]
    calls = spark.createDataFrame([("s", "c", 20)], "session string, id string, ended_at bigint")
    got = [tuple(r) for r in timeline.step_times(spark.createDataFrame(rows, e), calls).orderBy("seq").select("id", "started_at", "ended_at", "items").collect()]
    assert got == [("u", 5, 20, 1), ("u2", 15, 15, 0), ("u3", 15, 16, 0)]
