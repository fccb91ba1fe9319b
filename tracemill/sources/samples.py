"""The driver's conversations written down as each harness would write them: whole-table input for the decoders.

A conversation is a session, a turn a line. Times are a day a conversation and a second a turn.
"""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bridge

#: SQL for epoch milliseconds of a turn; DuckDB takes it as well.
AT = "(1704067200000 + conv_id * 86400000 + turn * 1000)"
BEFORE = "concat('c', conv_id, '-', turn - 1)"
CALL = "concat('c', conv_id, '-', turn)"

_CLAUDE = f"""case role
 when 'system' then to_json(named_struct('type', 'system', 'uuid', concat('m', turn), 'timestamp', {AT}, 'subtype', 'notice', 'content', text))
 when 'user' then if(turn % 4 < 2, to_json(named_struct('type', 'user', 'uuid', concat('m', turn), 'timestamp', {AT}, 'cwd', '/w', 'message', named_struct('role', 'user', 'content', text))),
  to_json(named_struct('type', 'user', 'uuid', concat('m', turn), 'timestamp', {AT}, 'message', named_struct('role', 'user', 'content', array(
   named_struct('type', 'tool_result', 'tool_use_id', {BEFORE}, 'content', left(text, 20), 'is_error', turn % 3 = 0, 'text', cast(null as string)),
   named_struct('type', 'text', 'tool_use_id', cast(null as string), 'content', cast(null as string), 'is_error', cast(null as boolean), 'text', text))))))
 else to_json(named_struct('type', 'assistant', 'uuid', concat('m', turn), 'timestamp', {AT}, 'message', named_struct('id', concat('a', turn), 'model', 'model-a', 'stop_reason', if(turn % 4 = 1, 'end_turn', 'tool_use'),
  'content', array(named_struct('type', 'thinking', 'thinking', left(text, 10), 'text', cast(null as string), 'id', cast(null as string), 'name', cast(null as string)), named_struct('type', 'text', 'thinking', cast(null as string), 'text', text, 'id', cast(null as string), 'name', cast(null as string)),
   named_struct('type', 'tool_use', 'thinking', cast(null as string), 'text', cast(null as string), 'id', {CALL}, 'name', 'grep')),
  'usage', named_struct('input_tokens', length(text), 'output_tokens', turn * 10, 'cache_read_input_tokens', conv_id)))) end"""

_CODEX = f"""case role
 when 'system' then to_json(named_struct('type', 'turn_context', 'timestamp', {AT}, 'payload', named_struct('model', 'model-b', 'cwd', '/w')))
 when 'user' then to_json(named_struct('type', 'response_item', 'timestamp', {AT}, 'payload', named_struct('type', 'message', 'id', concat('m', turn), 'role', 'user', 'content', array(named_struct('type', 'input_text', 'text', text)))))
 else if(turn % 4 = 1, to_json(named_struct('type', 'response_item', 'timestamp', {AT}, 'payload', named_struct('type', 'function_call', 'id', concat('m', turn), 'call_id', {CALL}, 'name', 'shell', 'arguments', '{{}}'))),
  to_json(named_struct('type', 'event_msg', 'timestamp', {AT}, 'payload', named_struct('type', 'token_count', 'info', named_struct('last_token_usage', named_struct('input_tokens', length(text), 'cached_input_tokens', turn, 'output_tokens', 5, 'reasoning_output_tokens', turn),
   'total_token_usage', named_struct('total_tokens', turn div 4)))))) end"""

_GEMINI = f"""case role
 when 'system' then to_json(named_struct('id', concat('m', turn), 'type', 'info', 'timestamp', {AT}, 'content', text))
 when 'user' then to_json(named_struct('id', concat('m', turn), 'type', 'user', 'timestamp', {AT}, 'content', array(named_struct('text', left(text, 30)), named_struct('text', right(text, 5)))))
 else to_json(named_struct('id', concat('m', turn), 'type', 'gemini', 'timestamp', {AT}, 'model', 'model-a', 'content', if(turn % 4 = 1, '', text), 'thoughts', array(named_struct('subject', 'Plan', 'description', left(text, 10))),
  'toolCalls', if(turn % 4 = 1, array(named_struct('id', {CALL}, 'name', 'ls', 'status', 'success', 'resultDisplay', left(text, 15))), array()), 'tokens', named_struct('input', length(text), 'cached', conv_id, 'output', 7, 'thoughts', turn, 'tool', 2))) end"""

_PI = f"""case role
 when 'system' then to_json(named_struct('type', 'session', 'id', concat('m', turn), 'timestamp', {AT}, 'cwd', '/w', 'title', left(text, 200)))
 when 'user' then to_json(named_struct('type', 'message', 'id', concat('m', turn), 'timestamp', {AT}, 'message', named_struct('role', 'user', 'content', text)))
 else to_json(named_struct('type', 'message', 'id', concat('m', turn), 'timestamp', {AT}, 'message', named_struct('role', 'assistant', 'model', 'model-a', 'content', array(named_struct('type', 'text', 'text', text)),
  'usage', named_struct('input', length(text), 'output', turn, 'reasoning', 3, 'cost', named_struct('total', if(turn % 4 = 1, 0D, length(text) / 1024D)))))) end"""

LINES = {"claude": _CLAUDE, "codex": _CODEX, "gemini": _GEMINI, "pi": _PI}


def lines(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """(session, parent, at, line) of all conversations; the session is the conversation's number."""
    told = bridge.table(spark, sf_dir, "conversations")
    return told.select(F.col("conv_id").cast("string").alias("session"), F.lit(None).cast("string").alias("parent"), F.col("turn").alias("at"), F.expr(LINES[harness]).alias("line"))


def files(spark: SparkSession, sf_dir: str, harness: str) -> DataFrame:
    """(path, content) of transcript files that hold the conversations: a file a conversation, gemini's as one JSON value each."""
    told = lines(spark, sf_dir, harness).groupBy("session").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("ls"))
    each = F.transform("ls", lambda x: x["line"])
    if harness == "gemini":
        head = F.expr(f"to_json(named_struct('sessionId', session, 'startTime', {AT.replace('conv_id', 'cast(session as bigint)').replace('turn', 'ls[0].at')}))")
        content = F.concat(F.expr("substring_index(h, '}', 1)"), F.lit(', "messages": ['), F.array_join(each, ","), F.lit("]}"))
        return told.withColumn("h", head).select(F.concat(F.lit("p"), F.expr("cast(session as bigint) % 7"), F.lit("/chats/"), "session", F.lit(".json")).alias("path"), content.alias("content"))
    return told.select(F.concat(F.lit("d"), F.expr("cast(session as bigint) % 7"), F.lit("/"), "session", F.lit(".jsonl")).alias("path"), F.concat(F.array_join(each, "\n"), F.lit("\n")).alias("content"))


def framed(files: DataFrame, each: int = 3) -> DataFrame:
    """(path, content) of ``files`` of lines as zstd frames of so many lines, one frame after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor()
        for batch in batches:
            split = [c.encode().splitlines(True) for c in batch.column("content").to_pylist()]
            bodies = [b"".join(press.compress(b"".join(x[k : k + each])) for k in range(0, len(x), each)) for x in split]
            yield pa.RecordBatch.from_arrays([pa.array([p + ".zstd" for p in batch.column("path").to_pylist()]), pa.array(bodies, pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


#: The harnesses' tables, as far as conversations fill them.
DDL = {
    "opencode": "CREATE TABLE session (id TEXT PRIMARY KEY, parent_id TEXT, directory TEXT, title TEXT, time_created INTEGER, time_updated INTEGER); CREATE TABLE message (id TEXT PRIMARY KEY, session_id TEXT, data TEXT); CREATE TABLE part (n INTEGER PRIMARY KEY, id TEXT, message_id TEXT, session_id TEXT, time_created INTEGER, data TEXT);",
    "hermes": "CREATE TABLE sessions (id TEXT PRIMARY KEY, model TEXT, started_at REAL, input_tokens INTEGER, output_tokens INTEGER, reasoning_tokens INTEGER, estimated_cost_usd REAL); CREATE TABLE messages (id INTEGER PRIMARY KEY, session_id TEXT, role TEXT, content TEXT, tool_call_id TEXT, tool_calls TEXT, tool_name TEXT, timestamp REAL, finish_reason TEXT, reasoning TEXT, active INTEGER);",
    "copilot": "CREATE TABLE sessions (id TEXT PRIMARY KEY, cwd TEXT); CREATE TABLE turns (n INTEGER PRIMARY KEY, session_id TEXT, user_message TEXT, assistant_response TEXT, timestamp TEXT);",
    "devin": "CREATE TABLE sessions (id TEXT PRIMARY KEY, model TEXT, created_at INTEGER, hidden INTEGER, main_chain_id INTEGER); CREATE TABLE message_nodes (row_id INTEGER PRIMARY KEY, session_id TEXT, node_id INTEGER, parent_node_id INTEGER, chat_message TEXT, created_at INTEGER);",
}
_N = "conv_id * 100000 + turn * 10"
_PID = "concat('p', conv_id, '-', turn, '{0}')"
_DONE = "turn % 4 <> 3"


def _cell(value: str) -> str:
    return f"coalesce(nullif(to_json(named_struct('x', {value})), '{{}}'), '{{\"x\":null}}')"


def _insert(table: str, *values: str, when: str = "true") -> str:
    """SQL for an insertion, the values as a JSON array, null where ``when`` does not hold."""
    return f"if({when}, named_struct('t', '{table}', 'v', concat('[', array_join(transform(array({', '.join(map(_cell, values))}), x -> substring(x, 6, length(x) - 6)), ','), ']')), null)"


def _part(letter: int, data: str, when: str) -> str:
    # A part's rows are told from a message's by their own numbers; an absent value of a JSON object is left out.
    return _insert("part", f"{_N} + {letter}", _PID.format(letter), "concat('m', conv_id, '-', turn)", "cast(conv_id as string)", AT, data, when=when)


ROWS = {
    "opencode": [
        _insert("session", "cast(conv_id as string)", "if(conv_id % 3 = 1, cast(conv_id - 1 as string), 'none')", "'/w'", "left(text, 30)", AT, AT, when="turn = 0"),
        _insert("message", "concat('m', conv_id, '-', turn)", "cast(conv_id as string)", f"if(role = 'assistant', to_json(named_struct('role', 'assistant', 'modelID', 'model-a', 'finish', if(turn % 4 = 1, 'tool-calls', 'stop'), 'time', named_struct('created', {AT}, 'completed', if({_DONE}, {AT} + 500, null)), 'error', if(turn % 5 = 4, named_struct('name', 'Busy', 'data', named_struct('message', 'later')), null))), to_json(named_struct('role', 'user')))"),
        _part(0, "to_json(named_struct('type', 'file', 'filename', left(text, 12)))", "role = 'system'"),
        _part(1, "to_json(named_struct('type', 'text', 'text', text, 'synthetic', turn % 4 >= 2))", "role = 'user'"),
        _part(2, f"to_json(named_struct('type', 'reasoning', 'text', left(text, 10), 'time', named_struct('start', {AT} + 1, 'end', {AT} + 2)))", "role = 'assistant'"),
        _part(3, f"to_json(named_struct('type', 'text', 'text', text, 'time', named_struct('start', {AT} + 3)))", "role = 'assistant'"),
        _part(4, f"to_json(named_struct('type', 'tool', 'tool', 'grep', 'callID', {CALL}, 'state', named_struct('status', if(turn % 4 = 1, 'completed', 'running'), 'output', left(text, 15), 'time', named_struct('end', {AT} + 9))))", "role = 'assistant'"),
        _part(5, "to_json(named_struct('type', 'step-finish', 'cost', turn / 8D, 'tokens', named_struct('input', length(text), 'output', 7, 'reasoning', turn, 'cache', named_struct('read', conv_id, 'write', 0), 'total', length(text) + 7 + conv_id + if(turn % 3 = 0, 0, turn))))", "role = 'assistant'"),
    ],
    "hermes": [
        _insert("sessions", "cast(conv_id as string)", "'model-h'", f"{AT} / 1000D", "conv_id % 4", "3", "5", "0.5D", when="turn = 0"),
        _insert("messages", _N, "cast(conv_id as string)", "if(role = 'system', 'tool', role)", "text", "if(role = 'system', 'x', null)", f"if(role = 'assistant' and turn % 4 = 1, to_json(array(named_struct('call_id', {CALL}, 'function', named_struct('name', 'grep', 'arguments', '{{}}')), named_struct('call_id', '', 'function', named_struct('name', 'ls', 'arguments', '{{}}')))), null)", "if(role = 'system', 'notes', null)", f"{AT} / 1000D", "if(role = 'assistant', if(turn % 4 = 1, 'tool_calls', 'stop'), null)", "if(role = 'assistant', left(text, 6), null)", "if(turn % 7 = 6, 0, 1)"),
    ],
    "copilot": [
        _insert("sessions", "cast(conv_id as string)", "'/w'", when="turn = 0"),
        _insert("turns", _N, "cast(conv_id as string)", "text", "if(turn % 4 = 0, ' ', concat('re ', left(text, 10)))", f"if(turn % 4 = 0, concat(from_unixtime({AT} div 1000, 'yyyy-MM-dd'), 'T', from_unixtime({AT} div 1000, 'HH:mm:ss')), cast({AT} div 1000 as string))", when="role = 'user'"),
    ],
    # A node hangs from the one before it; each third user's turn was tried once more, and nothing goes on from the second try.
    "devin": [
        _insert("sessions", "cast(conv_id as string)", "'model-d'", f"{AT} div 1000", "if(conv_id % 10 = 9, 1, 0)", "if(conv_id % 10 = 8, 99999, last)", when="turn = 0"),
        _insert("message_nodes", _N, "cast(conv_id as string)", "turn", "before", f"to_json(named_struct('role', if(role = 'system' and turn % 2 = 1, 'tool', role), 'content', text, 'tool_calls', if(role = 'assistant' and turn % 4 = 1, array(named_struct('id', {CALL}, 'function', named_struct('name', 'grep', 'arguments', '{{}}'))), array()), 'thinking', if(role = 'assistant', left(text, 8), null), 'metadata', named_struct('is_user_input', turn % 4 < 2, 'metrics', if(role = 'assistant', named_struct('input_tokens', length(text), 'output_tokens', turn), null))))", f"{AT} div 1000"),
        _insert("message_nodes", f"{_N} + 1", "cast(conv_id as string)", "turn + 1000", "before", "to_json(named_struct('role', 'user', 'content', concat('again ', text)))", f"{AT} div 1000 + 1", when="role = 'user' and turn % 3 = 0"),
    ],
}


def _built(ddl: str):
    """Databases of groups of insertions, as the bytes of their files: one at a time is built and handed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, rows in zip(*batch.columns):
                con = sqlite3.connect(":memory:")
                con.executescript(ddl)
                for low in range(0, len(rows.values or ()), 1000):
                    for r in rows.values.slice(low, 1000).to_pylist():
                        values = json.loads(r["v"])
                        con.execute(f"INSERT INTO {r['t']} VALUES ({', '.join('?' * len(values))})", values)
                con.commit()
                made = con.serialize()
                con.close()
                yield pa.RecordBatch.from_arrays([pa.array([path.as_py()]), pa.array([made], pa.binary())], names=["path", "content"])

    return run


def databases(spark: SparkSession, sf_dir: str, harness: str, each: int = 500) -> DataFrame:
    """(path, content) of databases that hold the conversations, so many in a database."""
    told = bridge.table(spark, sf_dir, "conversations")
    by = Window.partitionBy("conv_id")
    told = told.withColumn("before", F.lag("turn").over(by.orderBy("turn"))).withColumn("last", F.max("turn").over(by)).withColumn("turn0", F.min("turn").over(by))
    rows = [r.replace("turn = 0", "turn = turn0") for r in ROWS[harness]]
    one = told.select(F.concat(F.lit("d"), F.expr(f"conv_id div {each}"), F.lit("/store.db")).alias("path"), F.explode(F.expr(f"array({', '.join(rows)})")).alias("r")).where("r is not null")
    return one.groupBy("path").agg(F.collect_list("r").alias("rows")).mapInArrow(_built(DDL[harness]), "path string, content binary")
