"""The stateful ledger and status against the batch operators on all deliveries so far, after every micro-batch."""

import random
import time

from pyspark.sql import functions as F

from tracemill.operators import ledger, timeline
from tracemill.streaming import sessions as live

SCHEMA = "session string, id string, seq bigint, ts_ms bigint, kind string, model string, " + ", ".join(f"{c} bigint" for c in ledger.TOKENS) + ", synthetic boolean"
KINDS = ["user_message", "turn_start", "usage", "assistant_message", "reasoning", "tool_call", "tool_result", "turn_end", "system", "meta"]


def deliveries(rng, begin, count, now):
    out = []
    for seq in range(begin, begin + count):
        kind = rng.choice(KINDS)
        model = rng.choice(["m1", "m2", None]) if kind in ("usage", "assistant_message", "meta") else None
        # Half of the sessions have just been heard of, the others long ago; times may run backwards and ids come again.
        s, n = rng.randrange(12), rng.randrange(40)
        ts = (now if s % 2 else 10**12) + rng.randrange(50_000)
        out.append((f"s{s}", f"{kind}{n}", seq, ts, kind, model, *[rng.randrange(100) for _ in ledger.TOKENS], n % 5 == 0))
    return out


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


def test_equals_batch_after_every_micro_batch(spark, tmp_path):
    rng, base, now = random.Random(9), f"file://{tmp_path}", int(time.time() * 1000) + 3_600_000
    seen = []
    for k in range(3):
        part = deliveries(rng, 1000 * k, 150, now)
        seen += part
        spark.createDataFrame(part, SCHEMA).repartition(3).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(SCHEMA).parquet(f"{base}/in")
        # A new query each time: state and offsets come from the checkpoint.
        live.keep(live.kept_up(stream), f"{base}/out", f"{base}/checkpoint").awaitTermination()
        raw = spark.createDataFrame(seen, SCHEMA)
        turned = ledger.turned(raw)
        changes = live.kept(spark, f"{base}/out")
        columns = ["session", "id", "seq", "step_idx", "turn", "ts_ms", "model", *ledger.TOKENS]
        assert rows(live.current(changes, "step"), *columns) == rows(ledger.steps(turned), *columns)
        assert rows(live.current(changes, "prompt"), "session", "id", "turn", "ts_ms") == rows(ledger.prompts(turned), "session", "id", "turn", "ts_ms")
        columns = ["session", "status", "since", "reason", "last"]
        want = rows(timeline.status(raw, now), *columns)
        assert rows(live.current(changes, "status"), *columns) == want
        assert {r[3] for r in want} > {"stale"}
    assert rows(live.current(changes, "step", until=0), "session", "id", "step_idx") == rows(ledger.steps(ledger.turned(raw.where("seq < 1000"))), "session", "id", "step_idx")


def test_partial_deliveries_and_a_session_that_wakes(spark, tmp_path):
    base, zero = f"file://{tmp_path}", (0,) * len(ledger.TOKENS)
    future = int(time.time() * 1000) + 3_600_000
    schema = SCHEMA + ", partial boolean"
    for part in ([("a", "x", 1, 5, "turn_end", None, *zero, False, True)], [("a", "y", 2, future, "user_message", None, *zero, False, False)], [("a", "z", 3, future + 1, "turn_end", None, *zero, False, False)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(f"{base}/in")
        live.keep(live.kept_up(spark.readStream.schema(schema).parquet(f"{base}/in")), f"{base}/out", f"{base}/checkpoint").awaitTermination()
    told = live.kept(spark, f"{base}/out").where("what = 'status'").orderBy("batch", "version").select("status", "since", "reason", "last").collect()
    assert [tuple(r) for r in told] == [("work", 5, "streaming", 5), ("idle", 5 + timeline.STALE_MS, "stale", 5), ("work", 5, "user_message", future), ("idle", future + 1, "turn_end", future + 1)]
    assert live.kept(spark, f"{base}/out").where("what = 'prompt'").agg(F.count("*")).first()[0] == 1


def test_reads_and_writes_of_state_do_not_grow_with_deliveries():
    """Every read and write of state is a message; a page's are few however many deliveries and sessions it has."""

    class Held:
        def __init__(self):
            self.value, self.map, self.asked, self.timers = None, {}, 0, set()

        def get(self):
            self.asked += 1
            return self.value

        def update(self, value):
            self.asked, self.value = self.asked + 1, value

        def getValue(self, key):
            self.asked += 1
            return self.map.get(key)

        def updateValue(self, key, value):
            self.asked += 1
            self.map[key] = value

        def getValueState(self, *a):
            return self

        getMapState = getValueState

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.discard(at)

    class Times:
        def getCurrentProcessingTimeInMs(self):
            return 1

    names = [*[c.split()[0] for c in SCHEMA.split(", ")], "partial"]
    held, told = Held(), live.Sessions()
    told.init(held)
    for k in range(3):
        held.asked = 0
        rows = [dict(zip(names, (f"s{n % 20}", f"e{n}", n, 5, ("usage", "user_message")[n % 2], None, 1, 1, 1, 1, 1, False, False))) for n in range(2000 * k, 2000 * k + 2000)]
        out = list(told.handleInputRows((0,), iter(rows), Times()))
        assert sum(r["what"] == "step" for r in out) == 1000 and held.asked <= 60
    steps = [r for r in out if r["what"] == "step" and r["session"] == "s0"]
    assert [r["step_idx"] for r in steps] == list(range(201, 301)) and len(held.timers) == 1
