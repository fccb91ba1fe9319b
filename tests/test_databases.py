"""Databases as a source, and what their decoders make of single rows."""

import json
import sqlite3

import pytest

from tracemill.sources import databases, jsonl, sqlite

DAY = 1_930_000_000_000


def database(path, ddl, **tables):
    path.parent.mkdir(parents=True, exist_ok=True)
    con = sqlite3.connect(path)
    con.executescript(ddl)
    for table, rows in tables.items():
        for row in rows:
            con.execute(f"INSERT INTO {table} VALUES ({', '.join('?' * len(row))})", row)
    con.commit()
    con.close()


@pytest.mark.parametrize("piece", [1 << 30, 4096, 100])
def test_scan(spark, tmp_path, piece):
    rows = [(n * 7 + 1, n if n % 5 else None, f"é{n}" if n % 3 else n / 4, bytes([65, n])) for n in range(120)]
    database(tmp_path / "a" / "x.db", "CREATE TABLE t (k INTEGER PRIMARY KEY, i INTEGER, v, b BLOB); CREATE TABLE other (z)", t=rows)
    database(tmp_path / "b y%.db", "CREATE TABLE t (i TEXT PRIMARY KEY) WITHOUT ROWID", t=[("p",), ("q",)])
    database(tmp_path / "empty.db", "CREATE TABLE t (i)")
    database(tmp_path / "none.db", "CREATE TABLE u (i)")
    got = sqlite.scan(spark, f"file://{tmp_path}", "t", ["i", "v", "b", "gone"], piece=piece).collect()
    text = lambda v: None if v is None else str(v)
    assert sorted((r["row"], r["i"], r["v"], r["b"], r["gone"]) for r in got if r["source"].endswith("x.db")) == sorted((k, text(i), text(v), b.decode("utf-8", "replace"), None) for k, i, v, b in rows)
    assert sorted((r["i"], r["v"]) for r in got if r["source"].endswith("y%.db")) == [("p", None), ("q", None)]
    assert len(got) == 122


def test_a_store_without_local_files(tmp_path):
    from pyarrow import fs as pafs

    database(tmp_path / "x.db", "CREATE TABLE t (i)", t=[(1,), (2,)])
    store = pafs.SubTreeFileSystem(str(tmp_path), pafs.LocalFileSystem())
    assert list(sqlite.rows_of(sqlite.opened(store, "x.db"), "t", ["i"], 0, 1)) == [(1, 1), (2, 2)]


def told(spark, tmp_path, harness, *columns):
    events = databases.named(databases.DECODERS[harness](databases.scan(spark, f"file://{tmp_path}", harness)))
    return events, [tuple(r) for r in events.where("kind <> 'meta'").orderBy("session", "seq").select("session", "id", "kind", *columns).collect()]


OPENCODE = "CREATE TABLE session (id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INTEGER, time_updated INTEGER); CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, data TEXT); CREATE TABLE part (id TEXT PRIMARY KEY, message_id TEXT, session_id TEXT, time_created INTEGER, data TEXT);"


def test_opencode(spark, tmp_path):
    answer = lambda **m: json.dumps({"role": "assistant", "modelID": "model-o", **m})
    messages = [("m1", "s", json.dumps({"role": "user"})), ("m2", "s", answer(time={"created": 1})), ("m3", "s", answer(error={"name": "MessageAbortedError", "data": {"message": "stop"}}, time={"created": DAY})), ("m4", "s", answer(time={"completed": DAY + 9}, finish="stop")), ("m5", "s", "{broken")]
    part = lambda i, m, **p: (f"p{i}", m, "s", DAY + i, json.dumps(p))
    parts = [
        part(1, "m1", type="text", text="dig", synthetic=True), part(2, "m2", type="text", text="dig", time={"start": DAY}), part(3, "m2", type="reasoning", text="deep", time={"start": DAY, "end": DAY + 1}), part(4, "m2", type="tool", tool="spade", state={"status": "error", "error": "rock", "input": {"cm": 5}, "time": {"end": DAY + 3}}),
        part(5, "m3", type="patch", files=["a", "b"]), part(6, "m3", type="snapshot"), part(7, "m3", type="compaction"), part(8, "m3", type="hologram"), part(9, "m3", type="step-finish", tokens={"input": 4, "output": 3, "reasoning": 8, "cache": {"read": 1}})]
    database(tmp_path / "o.db", OPENCODE, session=[("s", "top", "/w", " a  title ", DAY, DAY + 77), ("top", "top", "", "", 0, 0)], message=messages, part=parts)
    events, got = told(spark, tmp_path, "opencode", "text", "partial", "name", "ts_ms")
    assert got == [
        ("s", "m4:end", "turn_end", None, None, "stop", DAY + 9), ("s", "p1", "user_message", "dig", None, None, DAY + 1), ("s", "p2", "assistant_message", "dig", True, None, DAY), ("s", "p3", "reasoning", "deep", False, None, DAY), ("s", "p4", "tool_call", None, False, "spade", DAY + 4), ("s", "p4:r", "tool_result", "rock", None, "spade", DAY + 3),
        ("s", "p5", "system", "a\nb", None, "patch", DAY + 5), ("s", "p7", "system", "", None, "compact", DAY + 7), ("s", "@8", "unknown", None, None, "part=hologram", DAY + 8), ("s", "p9", "usage", None, None, None, DAY + 9), ("s", "m3:err", "system", "MessageAbortedError: stop", None, "error", DAY), ("s", "m3:end", "turn_end", None, None, "aborted", DAY)]
    assert [tuple(r) for r in events.where("kind = 'usage'").select("input", "output", "cache_read", "reasoning").collect()] == [(4, 11, 1, 8)]
    s = {r["session"]: (r["parent"], r["title"], r["cwd"], r["model"], r["started_at"]) for r in jsonl.sessions(events).collect()}
    assert s == {"s": (s["s"][0], "a title", "/w", "model-o", DAY), "top": (None, None, None, None, None)} and s["s"][0].endswith("top")


def test_hermes_and_copilot_rows(spark, tmp_path):
    # Older databases lack columns; blank texts are no messages.
    database(tmp_path / "h" / "h.db", "CREATE TABLE sessions (id TEXT PRIMARY KEY, title TEXT, title_source TEXT, output_tokens INTEGER, actual_cost_usd REAL, ended_at REAL); CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, tool_call_id TEXT, tool_calls TEXT, tool_name TEXT, timestamp REAL, finish_reason TEXT, compacted INTEGER)",
        sessions=[("a", "t", "derived", 5, 0.25, 1930000000.5), ("b", None, None, 0, 1.0, None)],
        messages=[(1, "a", "user", "  ", None, None, None, 1e9, None, 0), (2, "a", "user", "sail", None, None, None, 1e9 + 0.5, None, 0), (3, "a", "assistant", None, None, "not json", None, -5, "length", 0), (4, "a", "tool", "wind", None, None, None, 1e9, None, 0), (5, "a", "user", "gone", None, None, None, 1e9, None, 1), (6, "a", "odd", "", None, None, None, None, None, None)])
    events, got = told(spark, tmp_path / "h", "hermes", "ts_ms", "call_id", "output", "reported")
    assert got == [("a", "m2", "user_message", 1_000_000_000_500, None, None, None), ("a", "m3:e", "turn_end", 0, None, None, None), ("a", "m4", "tool_result", 1_000_000_000_000, "m4", None, None), ("a", "@6", "unknown", 0, None, None, None), ("a", "session:usage", "usage", 1930000000500, None, 5, 0.25)]
    assert {(r["session"], r["title"]) for r in jsonl.sessions(events).collect()} == {("a", "t"), ("b", None)}
    database(tmp_path / "c" / "c.db", "CREATE TABLE sessions (id TEXT, cwd TEXT, summary TEXT, created_at TEXT, updated_at TEXT); CREATE TABLE turns (session_id TEXT, user_message TEXT, assistant_response TEXT, timestamp TEXT)", sessions=[("k", "/w", "sum", "2031-02-27T12:00:00", None)], turns=[("k", "ask", None, "2031-02-27T12:00:01.5"), ("k", "", "said", "junk")])
    events, got = told(spark, tmp_path / "c", "copilot", "ts_ms")
    assert got == [("k", "t1", "user_message", 1929960001500), ("k", "t1:end", "turn_end", 1929960001500), ("k", "t2:a", "assistant_message", 0), ("k", "t2:end", "turn_end", 0)]
    assert jsonl.sessions(events).first()["started_at"] == 1929960000000


def test_devin_shows_the_chosen_branch(spark, tmp_path):
    say = lambda role, content, **m: json.dumps({"role": role, "content": content, **m})
    nodes = [(1, "s", 10, None, say("user", "paint"), 5), (2, "s", 11, 10, say("assistant", "red", tool_calls=[{"function": {"name": "brush"}}], thinking={"thinking": "hue"}, metadata={"generation_model": "m2", "metrics": {"input_tokens": 3}}), 6), (3, "s", 12, 10, say("assistant", "<summary> blue", thinking=" "), 7), (4, "s", 13, 12, say("user", "Now summarize the conversation"), 8), (5, "h", 1, None, say("user", "hidden"), 1), (6, "b", 1, 9, say("poet", "x"), 1)]
    database(tmp_path / "d.db", "CREATE TABLE sessions (id TEXT, model TEXT, hidden INTEGER, main_chain_id INTEGER); CREATE TABLE message_nodes (row_id INTEGER PRIMARY KEY, session_id TEXT, node_id INTEGER, parent_node_id INTEGER, chat_message TEXT, created_at INTEGER)", sessions=[("s", "m1", 0, 13), ("h", "m1", 1, 1), ("b", None, None, 1)], message_nodes=nodes)
    _, got = told(spark, tmp_path, "devin", "text", "name", "synthetic", "ts_ms")
    assert got == [("b", "@1", "unknown", None, "role=poet", None, 1000), ("s", "n10", "user_message", "paint", None, False, 5000), ("s", "n12", "system", "<summary> blue", "compact", None, 7000), ("s", "n12:e", "turn_end", None, "completed", None, 7000), ("s", "n13", "user_message", "Now summarize the conversation", None, True, 8000)]
    con = sqlite3.connect(tmp_path / "d.db")
    con.execute("UPDATE sessions SET main_chain_id = 11 WHERE id = 's'")
    con.commit()
    con.close()
    _, got = told(spark, tmp_path, "devin", "text", "name", "model")
    assert [g[1:] for g in got if g[0] == "s"] == [("n10", "user_message", "paint", None, None), ("n11:r", "reasoning", "hue", None, None), ("n11", "assistant_message", "red", None, "m2"), ("n11:c0", "tool_call", None, "brush", None), ("n11:u", "usage", None, None, "m2")]


@pytest.mark.parametrize("harness", sorted(databases.DECODERS))
def test_no_databases(spark, tmp_path, harness):
    assert told(spark, tmp_path, harness)[1] == []


def test_databases_are_built_one_at_a_time(spark, tmp_path):
    """A task that builds many databases hands each over before the next, and the writer takes a few at once by their bytes."""
    import pyarrow as pa

    from tracemill.sinks import files
    from tracemill.sources import samples

    rows = [{"t": "sessions", "v": json.dumps(["s", "/w"])}]
    batch = pa.record_batch([pa.array(["a", "b", "c"]), pa.array([rows, [], rows * 0])], names=["path", "rows"])
    out = list(samples._built(samples.DDL["copilot"])(iter([batch])))
    assert [b.num_rows for b in out] == [1, 1, 1] and all(b.column("content")[0].as_py()[:6] == b"SQLite" for b in out)
    seen, before = tmp_path / "seen", spark.conf.get(files.BATCH)
    seen.mkdir()

    def large(batches):
        for b in batches:
            (seen / f"{b.num_rows}-{b.column(0)[0].as_py()}").touch()
            yield pa.record_batch([pa.array([str(x) for x in b.column(0).to_pylist()]), pa.array([b"x" * (1 << 20)] * b.num_rows)], names=["path", "content"])

    files.write(spark.range(40).coalesce(1).selectExpr("cast(id as string) as id", f"repeat('y', {1 << 20}) as pad").mapInArrow(large, "path string, content binary"), f"file://{tmp_path}/out")
    assert max(int(p.name.split("-")[0]) for p in seen.iterdir()) <= 8 and spark.conf.get(files.BATCH) == before
    assert sum(p.stat().st_size for p in (tmp_path / "out").iterdir()) == 40 << 20
