"""Decoders of harnesses that keep their sessions in SQLite databases: joins of their tables, then one projection and one explode.

A session's key is the database's path, '#', and the harness's own id until ``named`` takes them apart. A record's number is
its row id, as that is the order in which a harness writes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import chains
from . import sqlite
from .decoders import among, with_reasoning
from .jsonl import count, emitted, event, filled, get, is_kind, items, text_of, time, when

PARTLESS = ("step-start", "snapshot", "agent", "subtask", "retry", "timeline")
# Fixed values of the formats: how a request to shorten the conversation begins.
SHORTEN = ("Conversation to summarize:", "Now summarize the conversation")

TABLES = {
    "opencode": {"session": ["id", "parent_id", "directory", "title", "time_created", "time_updated"], "message": ["id", "session_id", "data"], "part": ["id", "message_id", "session_id", "time_created", "data"]},
    "hermes": {
        "sessions": ["id", "title", "cwd", "model", "parent_session_id", "started_at", "title_source", "input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens", "actual_cost_usd", "estimated_cost_usd", "last_activity_at", "ended_at"],
        "messages": ["id", "session_id", "role", "content", "tool_call_id", "tool_calls", "tool_name", "timestamp", "finish_reason", "reasoning", "reasoning_content", "active", "compacted"],
    },
    "copilot": {"sessions": ["id", "cwd", "summary", "created_at", "updated_at"], "turns": ["session_id", "user_message", "assistant_response", "timestamp"]},
    "devin": {"sessions": ["id", "title", "working_directory", "model", "created_at", "last_activity_at", "hidden", "main_chain_id"], "message_nodes": ["session_id", "node_id", "parent_node_id", "chat_message", "created_at"]},
}


def scan(spark: SparkSession, path: str, harness: str, **how) -> dict[str, DataFrame]:
    """The harness's tables in all databases below ``path``."""
    return {t: sqlite.scan(spark, path, t, columns, **how) for t, columns in TABLES[harness].items()}


def _key(own: str = "session_id") -> Column:
    return F.concat("source", F.lit("#"), F.coalesce(own, F.lit(""))).alias("session")


def said(c: str) -> str:
    """SQL for a text that holds more than white space, else null."""
    return f"if({c} rlike '\\\\S', {c}, null)"


def whole(c: str) -> str:
    return f"try_cast({c} as bigint)"


def _metas(sessions: DataFrame, parent: str, cwd: str, title: str, model: str, started: str, updated: str, rank: str = "2") -> DataFrame:
    """A meta row a session; its time is that of its last change, where one is told."""
    rows = sessions.select(_key("id"), F.expr(f"if({parent} <> id, concat(source, '#', {parent}), null)").alias("parent"), F.lit(0).cast("bigint").alias("n"), "*").withColumn("t", F.expr(f"coalesce({updated}, 0L)"))
    meta = when("true", event(id="'@0'", kind="'meta'", title=said(title), rank=rank, model=said(model), started=f"if({started} > 0, {started}, null)"))
    return emitted(rows.select("session", "parent", "n", "t", *[c for c in sessions.columns if c not in ("n", "t", "parent", "session")]), meta, cwd=said(cwd))


def named(events: DataFrame) -> DataFrame:
    """Events with ``source``, the database's path, and the harness's own ids of session and parent."""
    own = lambda c: F.regexp_replace(c, "^.*#", "")
    return events.select(own("session").alias("session"), F.regexp_replace("session", "#[^#]*$", "").alias("source"), own("parent").alias("parent"), *[c for c in events.columns if c not in ("session", "parent")])


def opencode(tables: dict[str, DataFrame]) -> DataFrame:
    """Messages of parts, updated in place. An answer's text is partial while neither it nor its message has ended; the turn ends with a message that is completed or failed, unless to call tools."""
    last = F.max("row").over(Window.partitionBy("source", "message_id"))
    parts = tables["part"].select("source", "row", F.col("id").alias("pid"), "message_id", F.col("session_id").alias("part_session"), F.expr(f"coalesce({whole('time_created')}, 0L)").alias("made"), F.expr("try_parse_json(data)").alias("p")).withColumn("last", F.col("row") == last)
    messages = tables["message"].select("source", F.col("id").alias("message_id"), F.col("session_id"), F.expr("try_parse_json(data)").alias("m"))
    rows = messages.join(parts, ["source", "message_id"], "left").select(_key(), F.lit(None).cast("string").alias("parent"), F.coalesce("row", F.lit(0)).alias("n"), "message_id", "pid", "p", "m", "made", F.coalesce("last", F.lit(True)).alias("last"))
    rows = rows.select("*", *[F.expr(e).alias(c) for c, e in {
        "role": f"coalesce({get('m', 'role')}, '')", "model": filled("m", "modelID"), "ty": f"if(pid is null, null, coalesce({get('p', 'type')}, ''))", "t": f"coalesce({get('p', 'time.start', 'bigint')}, made, 0L)", "status": f"coalesce({get('p', 'state.status')}, '')",
        "done": f"coalesce({get('m', 'role')}, '') <> 'assistant' or {get('m', 'time.completed', 'bigint')} is not null or {is_kind(get('m', 'error', 'variant'), 'OBJECT')}"}.items()])
    open_ = f"not done and {get('p', 'time.end', 'bigint')} is null"
    text, call = f"coalesce({get('p', 'text')}, '')", f"coalesce({get('p', 'callID')}, pid)"
    finished = "status in ('completed', 'error')"
    meta = when("role = 'assistant' and model is not null and pid is not null", event(id="concat('@', n)", kind="'meta'", model="model"))
    prompt = when("ty = 'text' and role = 'user'", event(id="pid", kind="'user_message'", text=text, synthetic=f"coalesce({get('p', 'synthetic', 'boolean')}, false)"))
    answer = when("ty = 'text' and role <> 'user'", event(id="pid", kind="'assistant_message'", text=text, model="model", partial=open_)) + ", " + when("ty = 'reasoning'", event(id="pid", kind="'reasoning'", text=text, partial=open_))
    tool = when("ty = 'tool'", event(id="pid", kind="'tool_call'", call_id=call, name=f"coalesce({get('p', 'tool')}, '')", args=get("p", "state.input"), partial=f"not {finished}")) + ", " + when(f"ty = 'tool' and {finished}", event(
        id="concat(pid, ':r')", kind="'tool_result'", ts_ms=f"coalesce({get('p', 'state.time.end', 'bigint')}, t)", call_id=call, name=f"coalesce({get('p', 'tool')}, '')", text=f"coalesce({get('p', 'state.output')}, {get('p', 'state.error')}, '')", is_error="status = 'error'"))
    i, o, r, cr, cw = (count("p", f"tokens.{k}") for k in ("input", "output", "reasoning", "cache.read", "cache.write"))
    total = get("p", "tokens.total", "bigint")
    # Whether the output holds the reasoning differs by version; the total tells.
    output = f"case when {total} = {i} + {o} + {cr} + {cw} then {o} when {total} = {i} + {o} + {r} + {cr} + {cw} then {o} + {r} else {with_reasoning(o, r)} end"
    cost = get("p", "cost", "double")
    used = when("ty = 'step-finish'", event(id="pid", kind="'usage'", model="model", input=i, output=output, cache_read=cr, cache_write=cw, reasoning=r, reported=f"if({cost} > 0, {cost}, null)"))
    notes = ", ".join([
        when("ty = 'patch'", event(id="pid", kind="'system'", name="ty", text=f"array_join({get('p', 'files', 'array<string>')}, '\\n')")), when("ty = 'file'", event(id="pid", kind="'system'", name="ty", text=f"coalesce({get('p', 'filename')}, {get('p', 'url')}, '')")),
        when("ty = 'compaction'", event(id="pid", kind="'system'", name="'compact'", text="''")), when(f"pid is not null and not {among('ty', ('text', 'reasoning', 'tool', 'step-finish', 'patch', 'file', 'compaction', *PARTLESS))}", event(id="concat('@', n)", kind="'unknown'", name="concat('part=', ty)"))])
    at = f"coalesce({get('m', 'time.completed', 'bigint')}, {get('m', 'time.created', 'bigint')}, 0L)"
    failed, named_ = is_kind(get("m", "error", "variant"), "OBJECT"), f"coalesce({get('m', 'error.name')}, 'error')"
    reason = f"case when {failed} then if({named_} = 'MessageAbortedError', 'aborted', 'error') else {get('m', 'finish')} end"
    over = "role = 'assistant' and last and done"
    ended = when(f"{over} and {failed}", event(id="concat(message_id, ':err')", kind="'system'", ts_ms=at, name="'error'", text=f"concat({named_}, ': ', coalesce({get('m', 'error.data.message')}, ''))")) + ", " + when(f"{over} and coalesce({reason}, '') <> 'tool-calls'", event(id="concat(message_id, ':end')", kind="'turn_end'", ts_ms=at, name=reason))
    metas = _metas(tables["session"], "parent_id", "directory", "title", "cast(null as string)", whole("time_created"), whole("time_updated"))
    return metas.unionByName(emitted(rows, meta, prompt, answer, tool, used, notes, ended, cwd="cast(null as string)"))


def hermes(tables: dict[str, DataFrame]) -> DataFrame:
    """Messages that are active and not compacted, and one usage a session from its own row, behind all of them."""
    ms = lambda c: f"if(try_cast({c} as double) > 0 and try_cast({c} as double) < 1e300, cast(try_cast({c} as double) * 1000 as bigint), 0L)"
    kept = tables["messages"].where("coalesce(active, '1') <> '0' and coalesce(compacted, '0') = '0'")
    rows = kept.select(_key(), F.lit(None).cast("string").alias("parent"), F.expr(whole("id")).alias("n"), "role", "content", "tool_call_id", "tool_name", F.expr(said("finish_reason")).alias("finish"), F.expr(ms("timestamp")).alias("t"), F.expr(f"coalesce({said('reasoning')}, {said('reasoning_content')})").alias("thought"), F.expr("try_parse_json(tool_calls)").alias("calls"))
    own = "concat('m', n)"
    call = f"coalesce({filled('c', 'call_id')}, {filled('c', 'id')}, concat('m', n, ':c', i))"
    called = event(id="concat('m', n, ':c', i)", kind="'tool_call'", call_id=call, name=f"coalesce({get('c', 'function.name')}, 'tool')", args=get("c", "function.arguments"))
    parts = ", ".join([
        when("role = 'user' and content rlike '\\\\S'", event(id=own, kind="'user_message'", text="content", synthetic="false")), when("role = 'assistant' and thought is not null", event(id="concat('m', n, ':r')", kind="'reasoning'", text="thought")),
        when("role = 'assistant' and content rlike '\\\\S'", event(id=own, kind="'assistant_message'", text="content")),
        f"if(role = 'assistant', transform(coalesce(try_variant_get(calls, '$', 'array<variant>'), cast(array() as array<variant>)), (c, i) -> {called}), array())",
        when("role = 'assistant' and finish <> 'tool_calls'", event(id="concat('m', n, ':e')", kind="'turn_end'", name="finish")), when("role = 'tool'", event(id=own, kind="'tool_result'", call_id=f"coalesce({said('tool_call_id')}, {own})", name=said("tool_name"), text="coalesce(content, '')", is_error="false")),
        when("coalesce(role, '') not in ('user', 'assistant', 'tool')", event(id="concat('@', n)", kind="'unknown'", name="concat('role=', coalesce(role, ''))"))])
    messages = emitted(rows, parts, cwd="cast(null as string)")
    sessions = tables["sessions"]
    rank = "if(trim(title_source) = 'derived', 1, 2)"
    metas = _metas(sessions, said("parent_session_id"), "cwd", "title", "model", ms("started_at"), "cast(null as bigint)", rank)
    n = {c: f"greatest(coalesce(cast(try_cast({c} as double) as bigint), 0L), 0L)" for c in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens", "reasoning_tokens")}
    money = lambda c: f"if(try_cast({c} as double) > 0, try_cast({c} as double), null)"
    output = with_reasoning(n["output_tokens"], n["reasoning_tokens"])
    usage = when(f"{n['input_tokens']} + {output} + {n['cache_read_tokens']} + {n['cache_write_tokens']} > 0", event(
        id="'session:usage'", kind="'usage'", model=said("model"), input=n["input_tokens"], output=output, cache_read=n["cache_read_tokens"], cache_write=n["cache_write_tokens"], reasoning=n["reasoning_tokens"], reported=f"coalesce({money('actual_cost_usd')}, {money('estimated_cost_usd')})"))
    told = sessions.withColumn("t", F.expr(f"coalesce(nullif({ms('last_activity_at')}, 0L), nullif({ms('ended_at')}, 0L), {ms('started_at')})"))
    return metas.unionByName(messages).unionByName(emitted(told.select(_key("id"), F.lit(None).cast("string").alias("parent"), F.lit(1 << 40).alias("n"), "t", *n, "model", "actual_cost_usd", "estimated_cost_usd"), usage, cwd="cast(null as string)"))


def copilot(tables: dict[str, DataFrame]) -> DataFrame:
    """Each row a finished turn: prompt, answer, end. Times are texts or numbers of seconds."""
    at = lambda c: f"if({c} rlike '^[0-9]{{4}}-', {time('to_variant_object(named_struct(' + repr('timestamp') + ', ' + c + '))')}, coalesce(cast(try_cast({c} as double) * 1000 as bigint), 0L))"
    rows = tables["turns"].select(_key(), F.lit(None).cast("string").alias("parent"), F.col("row").alias("n"), "user_message", "assistant_response", F.expr(at("timestamp")).alias("t"))
    parts = [when("user_message rlike '\\\\S'", event(id="concat('t', n)", kind="'user_message'", text="user_message", synthetic="false")), when("assistant_response rlike '\\\\S'", event(id="concat('t', n, ':a')", kind="'assistant_message'", text="assistant_response")), when("true", event(id="concat('t', n, ':end')", kind="'turn_end'", name="'completed'"))]
    metas = _metas(tables["sessions"], "cast(null as string)", "cwd", "summary", "cast(null as string)", at("created_at"), at("updated_at"))
    return metas.unionByName(emitted(rows, *parts, cwd="cast(null as string)"))


def devin(tables: dict[str, DataFrame]) -> DataFrame:
    """Messages of a tree: the chain from a session's chosen leaf to the root, or all of them in order of time where that chain is broken. Hidden sessions are left out."""
    ms = lambda c: f"if({whole(c)} > 100000000000, {whole(c)}, greatest(coalesce({whole(c)}, 0L), 0L) * 1000)"
    sessions = tables["sessions"].where("coalesce(hidden, '0') = '0'")
    shown = sessions.select(_key("id"), F.col("model").alias("session_model"), F.expr(whole("main_chain_id")).alias("leaf"))
    nodes = tables["message_nodes"].select(_key(), F.expr(whole("node_id")).alias("node"), F.expr(whole("parent_node_id")).alias("up"), F.struct(F.expr(f"coalesce({whole('created_at')}, 0L)").alias("made"), "row").alias("at"), "row", F.expr(ms("created_at")).alias("t"), F.expr("try_parse_json(chat_message)").alias("v")).join(shown.select("session"), "session", "left_semi")
    placed = chains.active(nodes.select("session", "node", "up", "at"), shown.select("session", "leaf"))
    rows = nodes.join(placed, ["session", "node", "at"]).join(shown.select("session", "session_model"), "session")
    rows = rows.select("session", F.lit(None).cast("string").alias("parent"), F.col("place").alias("n"), "node", "t", "v", "session_model", *[F.expr(e).alias(c) for c, e in {
        "role": f"coalesce({get('v', 'role')}, '')", "said": text_of(get("v", "content", "variant")), "calls": items("v", "tool_calls"), "own": filled("v", "metadata.generation_model"),
        "thought": f"coalesce({get('v', 'thinking.thinking')}, if({is_kind(get('v', 'thinking', 'variant'), 'STRING')}, {get('v', 'thinking')}, null))"}.items()])
    asks = "(" + " or ".join(f"startswith(ltrim(said), {m!r})" for m in SHORTEN) + ")"
    inside = f"coalesce({get('v', 'metadata.telemetry.source')} <> 'user', false) or coalesce(not {get('v', 'metadata.is_user_input', 'boolean')}, false) or {asks}"
    f = f"coalesce({get('c', 'function', 'variant')}, c)"
    call = event(id="concat('n', node, ':c', i)", kind="'tool_call'", call_id=f"coalesce({get('c', 'id')}, concat('n', node, ':c', i))", name=f"coalesce({get(f, 'name')}, 'tool')", args=get(f, "arguments"))
    n = lambda k: count("v", f"metadata.metrics.{k}")
    each = [n(k) for k in ("input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens")]
    own = "concat('n', node)"
    parts = [
        when("role = 'assistant' and own is not null", event(id="concat('@', n)", kind="'meta'", model="own")),
        when("role = 'user' and said rlike '\\\\S'", event(id=own, kind="'user_message'", text="said", synthetic=inside)), when("role = 'assistant' and thought rlike '\\\\S'", event(id="concat('n', node, ':r')", kind="'reasoning'", text="thought")),
        when("role = 'assistant' and startswith(ltrim(said), '<summary>')", event(id=own, kind="'system'", name="'compact'", text="said")), when("role = 'assistant' and said rlike '\\\\S' and not startswith(ltrim(said), '<summary>')", event(id=own, kind="'assistant_message'", text="said", model="coalesce(own, session_model)")),
        f"if(role = 'assistant', transform(calls, (c, i) -> {call}), array())",
        when("role = 'tool'", event(id=own, kind="'tool_result'", call_id=f"coalesce({get('v', 'tool_call_id')}, '')", text="said", is_error="false")), when("role = 'system' and said rlike '\\\\S'", event(id=own, kind="'system'", name="role", text="said")),
        when(" + ".join(each) + " > 0", event(id="concat('n', node, ':u')", kind="'usage'", model="own", input=each[0], output=each[1], cache_read=each[2], cache_write=each[3], reasoning="0")),
        when("role = 'assistant' and size(calls) = 0", event(id="concat('n', node, ':e')", kind="'turn_end'", name="'completed'")), when("role not in ('user', 'assistant', 'tool', 'system')", event(id="concat('@', n)", kind="'unknown'", name="concat('role=', role)"))]
    metas = _metas(sessions, "cast(null as string)", "working_directory", "title", "model", ms("created_at"), ms("last_activity_at"))
    return metas.unionByName(emitted(rows, *parts, cwd="cast(null as string)"))


DECODERS = {"opencode": opencode, "hermes": hermes, "copilot": copilot, "devin": devin}
