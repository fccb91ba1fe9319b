"""Compact archives against a plain version, and as round trips."""

import json
import random
import re

from tracemill.sinks import archive

SCHEMA = "session string, id string, seq bigint, kind string, text string, args string, input bigint"


def plain_strip(s):
    def swap(m):
        r = m.group()
        mixed = len(r) >= 256 and re.search("[A-Z]", r) and re.search("[a-z]", r) and re.search("[0-9]", r)
        return f"[binary omitted: {len(r)} bytes]" if mixed else r

    return re.sub("[A-Za-z0-9+/=_-]+", swap, s)


def plain_clip(s, most):
    return s.encode()[:most].decode(errors="ignore")


def texts():
    rng = random.Random(5)
    b64 = lambda n: "Aa0" + "".join(rng.choice("abcXYZ0189+/=-_") for _ in range(n - 3))
    out = ["", "short", "é" * 20_000, "a" + "é" * 9000, "€" * 6000, "ab" + "😀" * 5000, "=" * 400, "A" * 400, "a1" * 200, b64(255), b64(256), f"x {b64(300)} y {b64(5000)}", f"({b64(256)})é{b64(400)}", b64(256) + "é", "line\n" + b64(999) + "\n\tquote \" \\", "x" * 16_384, "x" * 16_385, "x" * 16_383 + "é", "x" * 2046 + "€y", "x" * 2045 + "😀"]
    return out + ["".join(rng.choice(["é", "a", " ", b64(260), "😀", "Z9"]) for _ in range(rng.randrange(400))) for _ in range(15)]


def test_compacted(spark):
    rows = []
    for n, t in enumerate(texts()):
        rows += [("s", f"a{n}", n, "assistant_message", t, None, None), ("s", f"r{n}", n, "tool_result", t, None, None), ("s", f"c{n}", n, "tool_call", None, t, None), ("s", f"u{n}", n, "usage", t, None, 5)]
    got = {r["id"]: r for r in archive.compacted(spark.createDataFrame(rows, SCHEMA)).collect()}
    for _, id_, _, kind, text, args, _ in rows:
        whole = args if kind == "tool_call" else text
        want = whole if kind == "usage" else plain_clip(plain_strip(whole), 16_384 if kind == "assistant_message" else 2048)
        r = got[id_]
        assert (r["args"] if kind == "tool_call" else r["text"]) == want
        assert r["truncated"] == (want != whole)
        assert (r["text"] if kind == "tool_call" else r["args"]) is None


def test_round_trip(spark, tmp_path):
    rows = [(s, f"e{n}", n, "user_message", t, None, n) for s in ("a/b", "a_b", "c") for n, t in enumerate(texts())]
    events = archive.compacted(spark.createDataFrame(rows, SCHEMA))
    sessions = spark.createDataFrame([("a/b", "T\n1"), ("a_b", None), ("c", ""), ("none", "x")], "session string, title string")
    archive.write(sessions, events, f"file://{tmp_path}/x")
    archive.write(sessions, events, f"file://{tmp_path}/x")
    got = {}
    for r in archive.read(spark, f"file://{tmp_path}/x").orderBy("source", "line").collect():
        got.setdefault(r["source"], []).append(json.loads(r["record"]))
    assert sorted((v[0]["session"], v[0].get("title")) for v in got.values()) == [("a/b", "T\n1"), ("a_b", None), ("c", ""), ("none", "x")]
    want = {r["id"]: r for r in events.where("session = 'c'").collect()}
    for lines in got.values():
        own = lines[1:]
        assert [e["seq"] for e in own] == (sorted(r["seq"] for r in want.values()) if lines[0]["session"] != "none" else [])
        assert all(e["text"] == want[e["id"]]["text"] and e["truncated"] == want[e["id"]]["truncated"] and e["input"] == e["seq"] for e in own)
    assert archive.read(spark, f"file://{tmp_path}").count() == sum(map(len, got.values()))
