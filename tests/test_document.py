"""Nested documents against a fold that takes one delivery after the other."""

import random

from tracemill.operators import document, ledger

KINDS = ["user_message", "turn_start", "usage", "usage", "assistant_message", "reasoning", "tool_call", "tool_call", "tool_result", "tool_result", "turn_end", "system", "meta"]
SCHEMA = "session string, id string, seq bigint, ts_ms bigint, kind string, model string, call_id string, name string, args string, text string, is_error boolean, synthetic boolean, " + ", ".join(f"{c} bigint" for c in ledger.TOKENS)


def deliveries(rng, n):
    out = []
    for seq in range(n):
        kind, k = rng.choice(KINDS), rng.randrange(30)
        text = rng.choice(["", "short", "é" * 450])
        out.append((f"s{rng.randrange(6)}", f"{kind}{k}", seq, rng.choice([0, 1000 + 10 * seq, 1000 + rng.randrange(3000)]), kind, "m", f"c{k % 8}" if kind.startswith("tool") else None, f"n{seq % 3}", text or None, text, rng.choice([None, True, False]), k % 6 == 0, *[rng.randrange(9) for _ in ledger.TOKENS]))
    return out


def fold(rows):
    """The turns of one session."""
    turn, open_, seen, pending, arena, at, calls = 0, False, set(), [], [], {}, {}
    turns, starts, steps, step_at, cur = {}, {}, [], {}, 0

    def made(t, hint):
        if t not in turns:
            turns[t] = {"turn": t, "event": None, "prompt": None, "started": min([x for x in (starts.get(t, 0), hint) if x > 0], default=0), "end": 0, "steps": [], "items": []}
        return turns[t]

    def close():
        if pending:
            made(cur, arena[pending[0]]["hint"])["items"].extend(pending)
            pending.clear()

    for r in rows:
        kind, id_, ts = r["kind"], r["id"], r["ts_ms"]
        if kind in ("user_message", "turn_start") and not r["synthetic"] and id_ not in seen:
            if not open_:
                turn += 1
            open_ = True
        elif kind in ledger.CLOSERS:
            open_ = False
        seen.add(id_)
        if turn != cur:
            close()
            cur = turn
        if kind == "user_message" and not r["synthetic"]:
            t = made(turn, ts)
            if t["event"] is None:
                t["event"], t["prompt"] = id_, r["text"][:300]
                if ts > 0 and (t["started"] == 0 or ts < t["started"]):
                    t["started"] = ts
        elif kind == "turn_start":
            starts.setdefault(turn, ts)
        elif kind == "turn_end" and turn in turns:
            turns[turn]["end"] = max(turns[turn]["end"], ts)
        elif kind in document.ITEMS:
            args = (r["args"] or "")[:200]
            new = {"kind": kind, "event": id_, "ts": ts, "hint": ts, "chars": len(r["text"]) if kind in ("reasoning", "assistant_message") else None, "preview": r["text"][:200] if kind == "assistant_message" else None, "name": r["name"] if kind in ("tool_call", "system") else None, "input_preview": args if kind == "tool_call" else None, "ended_at": None, "is_error": None, "output_preview": None, "running": True if kind == "tool_call" else None}
            if id_ in at:
                old = arena[at[id_]]
                old.update({"name": new["name"], "input_preview": args} if kind == "tool_call" else {k: v for k, v in new.items() if k != "hint"})
            else:
                at[id_] = len(arena)
                pending.append(len(arena))
                arena.append(new)
                if kind == "tool_call":
                    calls[r["call_id"]] = at[id_]
        elif kind == "tool_result" and r["call_id"] in calls:
            arena[calls[r["call_id"]]].update(ended_at=ts, is_error=bool(r["is_error"]), output_preview=r["text"][:200], running=False)
        elif kind == "usage":
            if id_ not in step_at:
                step_at[id_] = {"id": id_, "index": len(steps) + 1, "items": []}
                steps.append(step_at[id_])
                made(turn, arena[pending[0]]["hint"] if pending else ts)["steps"].append(step_at[id_])
            step_at[id_]["ts"] = ts
            step_at[id_]["items"] += pending
            pending.clear()
    close()
    out, over = [], lambda i: max(i["ts"], i["ended_at"] or 0)
    shown = lambda ids: [tuple(v for k, v in arena[i].items() if k != "hint") for i in ids]
    for t in sorted(turns.values(), key=lambda t: t["turn"]):
        before, ended, told = t["started"], max(t["end"], t["started"]), []
        for s in t["steps"]:
            end = max([s["ts"], *(over(arena[i]) for i in s["items"])])
            told.append((s["index"], s["id"], min(before, s["ts"]) if before > 0 else s["ts"], s["ts"], shown(s["items"])))
            before, ended = end, max(ended, end)
        ended = max([ended, *(over(arena[i]) for i in t["items"])])
        out.append((t["turn"], t["event"], t["prompt"], t["started"], ended, told, shown(t["items"])))
    return out


def test_equals_the_fold(spark):
    rng = random.Random(4)
    rows = deliveries(rng, 1200)
    frame = spark.createDataFrame(rows, SCHEMA)
    turned = ledger.turned(frame)
    from pyspark.sql import functions as F

    steps = ledger.steps(turned).withColumn("pico", F.lit(7).cast("bigint"))
    got = {r["session"]: r["turns"] for r in document.document(turned, steps).collect()}
    item = lambda i: (i["kind"], i["event"], i["ts"], i["chars"], i["preview"], i["name"], i["input_preview"], i["ended_at"], i["is_error"], i["output_preview"], i["running"])
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for s in sorted({r[0] for r in rows}):
        want = fold([dict(zip(names, r)) for r in rows if r[0] == s])
        ours = [(t["turn"], t["event"], t["prompt"], t["started_at"], t["ended_at"], [(x["index"], x["event"], x["started_at"], x["ts"], [item(i) for i in x["items"]]) for x in t["steps"]], [item(i) for i in t["items"]]) for t in got[s]]
        assert ours == want
    assert all(x["pico"] == 7 and x["model"] == "m" for t in got["s0"] for x in t["steps"])
    flat = document.flat(document.document(turned, steps)).count()
    assert flat == sum(len(x["items"]) for turns in got.values() for t in turns for x in t["steps"]) + sum(len(t["items"]) for turns in got.values() for t in turns)
    assert document.document(turned.limit(0), steps.limit(0)).count() == 0
