"""Decoders: what each harness writes, as events of one shape. All are DataFrame expressions over variant records.

Each takes the lines of its files (``jsonl.scan`` or ``jsonl.whole``) and gives the rows of ``jsonl.emitted``. Broken lines
give nothing, records of an unknown type an event of kind 'unknown' with the type as its name, ids that a format does not
give are '@' and the record's number. Events that are delivered again keep their id; ``ledger.latest`` merges them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .jsonl import count, emitted, event, filled, get, is_kind, items, records, text_of, time, when

# Fixed values of the formats.
ENDS = ("end_turn", "stop_sequence", "stop", "length", "refusal")
COMMANDS = ("<command-name>", "<command-message>", "<local-command-stdout>", "<local-command-stderr>")
INTERRUPTED = "[Request interrupted by user"
SYNTHETIC = ("<task-notification>", "<system-reminder>", "<cross-session-message", "<user-prompt-submit-hook>", "<local-command-caveat>", "Caveat:", "This session is being continued", "Stop hook feedback", "Another Claude session sent a message", "[Your previous response")
INJECTED = ("<environment_context>", "<user_instructions>", "# AGENTS.md instructions", "<permissions instructions>", "<turn_aborted>", "<subagent_notification>", "<collaboration_mode>", "<skill>")
SILENT = {
    "claude": ("attachment", "file-history-snapshot", "file-history-delta", "last-prompt", "mode", "permission-mode", "atis-latch", "queue-operation", "pr-link", "cost-state", "active-leaf", "workspace-directories", "worktree-state", "progress", "tag", "session-meta", "resend-fork-notice", "fork-context-ref", "agent-setting", "api-request", "api-request-blob", "api-request-shape", "tools-used"),
    "codex": ("world_state", "inter_agent_communication_metadata"),
    "pi": ("thinking_level_change", "custom", "context_edit", "ttsr_injection", "label", "branch_summary", "mode_change", "model_usage", "mcp_tool_selection", "service_tier_change", "session_state", "git_state", "child_usage_attributed"),
}


def among(value: str, choices: tuple[str, ...]) -> str:
    return f"coalesce({value} in ({', '.join(map(repr, choices))}), false)"


def begins(text: str, marks: tuple[str, ...]) -> str:
    return "(" + " or ".join(f"startswith(ltrim(' \\t\\r\\n', {text}), {m!r})" for m in marks) + ")"


def with_reasoning(output: str, reasoning: str) -> str:
    """Output tokens with the reasoning in them; more reasoning than output shows that it was left out."""
    return f"if({reasoning} > {output}, {output} + {reasoning}, {output})"


def said(id: str, text: str, synthetic: str) -> str:
    """SQL for a user's text: an interruption, a command's plumbing, or a prompt."""
    end, command = event(id=id, kind="'turn_end'", name="'interrupted'"), event(id=id, kind="'system'", name="'command'", text=text)
    return f"case when {begins(text, (INTERRUPTED,))} then {end} when {begins(text, COMMANDS)} then {command} else {event(id=id, kind=repr('user_message'), text=text, synthetic=f'{synthetic} or {begins(text, SYNTHETIC)}')} end"


def unknown(condition: str, name: str) -> str:
    return when(condition, event(id="concat('@', n)", kind="'unknown'", name=name))


def claude(lines: DataFrame) -> DataFrame:
    """JSONL of messages with content blocks; repeated usage of one message has one id. Side chains inside a parent's file are left out."""
    rows = records(lines).select("session", "parent", "n", "v", *[F.expr(e).alias(c) for c, e in {
        "ty": f"coalesce({get('v', 'type')}, '')", "t": time("v"), "uuid": f"coalesce({get('v', 'uuid')}, '')", "cwd": filled("v", "cwd"), "m": get("v", "message", "variant"), "c": get("v", "message.content", "variant"), "blocks": items("v", "message.content"),
        "side": f"coalesce({get('v', 'isSidechain', 'boolean')}, false)", "sub": f"coalesce({get('v', 'subtype')}, 'system')", "named": f"coalesce({filled('v', 'message.model')}, {filled('v', 'model')})",
        "auto": f"coalesce({get('v', 'isMeta', 'boolean')}, false) or coalesce({get('v', 'isCompactSummary', 'boolean')}, false) or coalesce({get('v', 'origin.kind')} <> 'human', false)"}.items()]).where("not side or parent is not null")
    rows = rows.withColumn("model", F.expr("nullif(named, '<synthetic>')")).withColumn("mid", F.expr(f"coalesce({get('m', 'id')}, uuid)"))
    kind, own = get("b", "type"), get("b", "text")
    result = event(id="concat(uuid, '#', i)", kind="'tool_result'", call_id=f"coalesce({get('b', 'tool_use_id')}, '')", text=text_of("try_variant_get(b, '$.content', 'variant')"), is_error=f"coalesce({get('b', 'is_error', 'boolean')}, false)")
    halt = event(id="concat(uuid, '#', i)", kind="'turn_end'", name="'interrupted'")
    user_blocks = f"if(ty = 'user', transform(blocks, (b, i) -> case when {kind} = 'tool_result' then {result} when {kind} = 'text' and {begins(own, (INTERRUPTED,))} then {halt} end), array())"
    piece = f"case when {kind} = 'tool_result' then null when {kind} = 'text' then if({begins(own, (INTERRUPTED,))}, null, {own}) else concat('[', coalesce({kind}, ''), ']') end"
    rows = rows.withColumn("typed", F.expr(f"if({is_kind('c', 'STRING')}, try_variant_get(c, '$', 'string'), nullif(array_join(filter(transform(blocks, b -> {piece}), p -> p <> ''), '\\n'), ''))"))
    prompt = when("ty = 'user' and typed is not null", said(f"if({is_kind('c', 'STRING')}, uuid, concat(uuid, '#t'))", "typed", "auto"))
    at = "concat(uuid, '#', i)"
    failed = f"coalesce({get('v', 'isApiErrorMessage', 'boolean')}, false)"
    answer = f"""if(ty = 'assistant', transform(blocks, (b, i) -> case
        when {kind} = 'text' and {failed} then {event(id=at, kind="'system'", name="'api_error'", text=f"coalesce({own}, '')")}
        when {kind} = 'text' then {event(id=at, kind="'assistant_message'", text=f"coalesce({own}, '')", model="model")}
        when {kind} = 'thinking' then {event(id=at, kind="'reasoning'", text=f"coalesce({get('b', 'thinking')}, '')")}
        when {kind} = 'redacted_thinking' then {event(id=at, kind="'reasoning'", text="'[redacted]'")}
        when {kind} in ('tool_use', 'server_tool_use', 'mcp_tool_use') then {event(id=at, kind="'tool_call'", call_id=f"coalesce({get('b', 'id')}, '')", name=f"coalesce({get('b', 'name')}, '')", args=f"coalesce({get('b', 'input')}, '{{}}')")}
        when {kind} like '%\\_tool\\_result' then {result}
        else {event(id=at, kind="'unknown'", name=kind)} end), array())"""
    used = when(f"ty = 'assistant' and coalesce(named, '') <> '<synthetic>' and {is_kind(get('m', 'usage', 'variant'), 'OBJECT')}", event(
        id="concat(mid, ':usage')", kind="'usage'", model="model", input=count("m", "usage.input_tokens"), output=count("m", "usage.output_tokens"), cache_read=count("m", "usage.cache_read_input_tokens"),
        cache_write=count("m", "usage.cache_creation_input_tokens"), reasoning=count("m", "usage.output_tokens_details.thinking_tokens")))
    ended = when(f"ty = 'assistant' and {among(get('m', 'stop_reason'), ENDS)}", event(id="concat(mid, ':end')", kind="'turn_end'", name=get("m", "stop_reason")))
    text = text_of(get("v", "content", "variant"))
    system = when("ty = 'system' and sub <> 'turn_duration'", event(id="uuid", kind="'system'", name="sub", text=text)) + ", " + when("ty = 'system' and sub in ('away_summary', 'agents_killed')", event(id="concat(uuid, ':end')", kind="'turn_end'", name="sub"))
    over = when("ty = 'system' and sub = 'turn_duration'", event(id="uuid", kind="'turn_end'", name="sub")) + ", " + when("ty = 'continued-in'", event(id="concat('continued:', n)", kind="'turn_end'", name="'continued_in'"))
    title = f"case ty when 'summary' then {get('v', 'summary')} when 'ai-title' then {get('v', 'aiTitle')} when 'agent-name' then coalesce({get('v', 'agentName')}, {get('v', 'name')}) when 'custom-title' then {get('v', 'customTitle')} end"
    meta = when("ty in ('summary', 'ai-title', 'agent-name', 'custom-title', 'runtime-config')", event(id="concat('@', n)", kind="'meta'", title=title, rank="case ty when 'summary' then 1 when 'custom-title' then 3 else 2 end", model="if(ty = 'runtime-config', model, null)"))
    known = ("user", "assistant", "system", "summary", "ai-title", "agent-name", "custom-title", "runtime-config", "continued-in", *SILENT["claude"])
    return emitted(rows, user_blocks, prompt, answer, used, ended, system, over, meta, unknown(f"not {among('ty', known)}", "concat('type=', ty)"))


def codex(lines: DataFrame) -> DataFrame:
    """JSONL of {timestamp, type, payload}. The model holds from each turn context on; token counts that repeat the last total, or follow usage records, are no steps."""
    rows = records(lines).select("session", "parent", "n", *[F.expr(e).alias(c) for c, e in {
        "ty": f"coalesce({get('v', 'type')}, '')", "t": time("v"), "p": get("v", "payload", "variant")}.items()])
    rows = rows.select("*", *[F.expr(e).alias(c) for c, e in {
        "pt": f"coalesce({get('p', 'type')}, '')", "own": f"coalesce({filled('p', 'id')}, concat('@', n))", "call": f"coalesce({get('p', 'call_id')}, {get('p', 'id')}, '')", "cwd": f"if(ty in ('session_meta', 'turn_context'), {filled('p', 'cwd')}, null)",
        "switch": f"if(ty = 'turn_context', {filled('p', 'model')}, null)", "said": text_of(get("p", "content", "variant")),
        "total": f"if(ty = 'event_msg' and {get('p', 'type')} = 'token_count' and {is_kind(get('p', 'info.last_token_usage', 'variant'), 'OBJECT')} and {get('p', 'info.total_token_usage', 'variant')} is not null, struct(" + ", ".join(count("p", f"info.total_token_usage.{k}") for k in ("input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens", "total_tokens")) + "), null)"}.items()])
    before = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("model", F.last("switch", True).over(before)).withColumn("again", F.coalesce(F.col("total") == F.last("total", True).over(before), F.lit(False)))
    recorded = F.expr(f"ty = 'token_usage_record' and {is_kind(get('p', 'usage', 'variant'), 'OBJECT')}")
    rows = rows.withColumn("recorded", F.coalesce(F.max(recorded).over(before), F.lit(False)))

    def usage(id: str, at: str) -> str:
        cached, written, reasoning = (count("p", f"{at}.{k}") for k in ("cached_input_tokens", "cache_write_input_tokens", "reasoning_output_tokens"))
        return event(id=id, kind="'usage'", model="model", input=f"greatest({count('p', f'{at}.input_tokens')} - {cached} - {written}, 0L)", output=with_reasoning(count("p", f"{at}.output_tokens"), reasoning), cache_read=cached, cache_write=written, reasoning=reasoning)

    item = lambda *kinds: f"ty = 'response_item' and pt in ({', '.join(map(repr, kinds))})"
    role = f"coalesce({get('p', 'role')}, '')"
    message = when(f"{item('message')} and {role} = 'user'", event(id="own", kind="'user_message'", text="said", synthetic=begins("said", INJECTED))) + ", " + when(f"{item('message')} and {role} = 'assistant'", event(id="own", kind="'assistant_message'", text="said")) + ", " + when(f"{item('message')} and {role} not in ('user', 'assistant')", event(id="own", kind="'system'", name=f"if({role} = '', 'message', {role})", text="said"))
    thought = f"coalesce(nullif({text_of(get('p', 'summary', 'variant'))}, ''), said)"
    calls = ", ".join([
        when(f"{item('reasoning')} and {thought} <> ''", event(id="own", kind="'reasoning'", text=thought)),
        when(item("function_call"), event(id="own", kind="'tool_call'", call_id="call", name=f"coalesce({get('p', 'name')}, '')", args=f"coalesce({get('p', 'arguments')}, '{{}}')")),
        when(item("custom_tool_call"), event(id="own", kind="'tool_call'", call_id="call", name=f"coalesce({get('p', 'name')}, '')", args=get("p", "input"))),
        when(item("local_shell_call"), event(id="own", kind="'tool_call'", call_id="call", name="'shell'", args=get("p", "action"))),
        when(item("web_search_call", "image_generation_call", "tool_search_call"), event(id="own", kind="'tool_call'", call_id="call", name="replace(pt, '_call', '')", args=f"coalesce({get('p', 'action')}, {get('p', 'arguments')})")),
    ])
    asked = f"coalesce({get('p', 'query')}, {get('p', 'action.query')})"
    listed = f"array_join(transform({get('p', 'action.queries', 'array<string>')}, q -> concat('• ', q)), '\\n')"
    found = f"case when size({get('p', 'action.queries', 'array<string>')}) > 0 then concat('Search queries executed:\\n', {listed}) when {asked} <> '' then concat('Search query: ', {asked}) else 'Search completed' end"
    made = f"coalesce({filled('p', 'revised_prompt')}, {get('p', 'arguments.query')}, concat(replace(pt, '_call', ''), ' completed'))"
    done = f"coalesce({get('p', 'status')} = 'completed', pt = 'web_search_call')"
    answers = when(f"{item('web_search_call', 'image_generation_call', 'tool_search_call')} and {done}", event(id=f"concat(coalesce({filled('p', 'id')}, call), ':res')", kind="'tool_result'", call_id="call", name="replace(pt, '_call', '')", text=f"if(pt = 'web_search_call', {found}, {made})", is_error="false"))
    raw = text_of(get("p", "output", "variant"))
    inner = f"if(startswith({raw}, '{{'), {get(f'try_parse_json({raw})', 'output')}, null)"
    exit_code = f"try_cast(nullif(regexp_extract({raw}, '^Exit code: \\\\s*(-?[0-9]+)(?!\\\\S)', 1), '') as bigint)"
    code = f"coalesce(if({inner} is null, {exit_code}, {get(f'try_parse_json({raw})', 'metadata.exit_code', 'bigint')}), 0L)"
    results = when(item("function_call_output", "custom_tool_call_output", "tool_search_output"), event(id="own", kind="'tool_result'", call_id="call", text=f"coalesce({inner}, {raw})", is_error=f"{code} <> 0"))
    notes = when(item("agent_message"), event(id="own", kind="'system'", name="pt", text="said")) + ", " + when(item("compaction"), event(id="own", kind="'system'", name="'compact'", text="''")) + ", " + when("ty = 'compacted'", event(id="concat('@', n)", kind="'system'", name="'compact'", text=f"coalesce({get('p', 'message')}, '')")) + ", " + when("ty = 'event_msg' and pt in ('error', 'stream_error')", event(id="concat('@', n)", kind="'system'", name="'error'", text=f"coalesce({get('p', 'message')}, '')"))
    turn = f"coalesce({get('p', 'turn_id')}, '')"
    turns = when("ty = 'event_msg' and pt = 'task_started'", event(id=f"concat('turn:', {turn}, ':start')", kind="'turn_start'")) + ", " + when("ty = 'event_msg' and pt in ('task_complete', 'turn_aborted')", event(id=f"concat('turn:', {turn}, ':end')", kind="'turn_end'", name=f"if(pt = 'task_complete', 'complete', coalesce({filled('p', 'reason')}, 'aborted'))"))
    used = when(f"ty = 'token_usage_record' and {is_kind(get('p', 'usage', 'variant'), 'OBJECT')}", usage(f"coalesce(concat({filled('p', 'response_id')}, ':usage'), concat('@', n))", "usage")) + ", " + when(f"ty = 'event_msg' and pt = 'token_count' and not recorded and not again and {is_kind(get('p', 'info.last_token_usage', 'variant'), 'OBJECT')}", usage("concat('@', n)", "info.last_token_usage"))
    started = f"if({time('p')} > 0, {time('p')}, nullif(t, 0L))"
    meta = when("ty in ('session_meta', 'turn_context')", event(id="concat('@', n)", kind="'meta'", model="switch", parent_of=get("p", "source.subagent.thread_spawn.parent_thread_id"), started=f"if(ty = 'session_meta', {started}, null)"))
    items_known = ("message", "reasoning", "function_call", "custom_tool_call", "local_shell_call", "web_search_call", "image_generation_call", "tool_search_call", "function_call_output", "custom_tool_call_output", "tool_search_output", "agent_message", "compaction", "ghost_snapshot")
    known = ("session_meta", "turn_context", "response_item", "event_msg", "token_usage_record", "compacted", *SILENT["codex"])
    odd = unknown(f"not {among('ty', known)} or ty = 'response_item' and not {among('pt', items_known)}", "if(ty = 'response_item', concat('response_item=', pt), concat('type=', ty))")
    return emitted(rows, ", ".join([message, calls, answers, results, notes, turns, used, meta, odd]))


def gemini(lines: DataFrame) -> DataFrame:
    """JSONL, or one whole JSON: a header with or without messages, ``$set`` of messages, or a message; a message that is written again keeps its ids."""
    head = f"({get('v', 'sessionId', 'variant')} is not null and {get('v', 'startTime', 'variant')} is not null)"
    all_ = F.expr(f"case when {head} then {items('v', 'messages')} when variant_get(v, '$[\"$set\"]', 'variant') is not null then coalesce(try_variant_get(v, '$[\"$set\"].messages', 'array<variant>'), cast(array() as array<variant>)) else array(v) end")
    base = records(lines).select("session", "parent", "n", "v", F.expr(head).alias("head"))
    begun = emitted(base.where("head"), when("true", event(id="concat('@', n)", kind="'meta'", ts_ms="0", started=f"nullif({time('v', 'startTime')}, 0L)")), cwd="cast(null as string)")
    each = base.select("session", "parent", "n", F.posexplode(all_).alias("j", "v")).withColumn("n", F.row_number().over(Window.partitionBy("session").orderBy("n", "j")).cast("bigint"))
    rows = each.select("session", "parent", "n", *[F.expr(e).alias(c) for c, e in {
        "v": "v", "ty": f"coalesce({get('v', 'type')}, '')", "id": f"coalesce({get('v', 'id')}, '')", "t": time("v"), "model": filled("v", "model"), "said": text_of(get("v", "content", "variant")), "calls": items("v", "toolCalls"), "thoughts": items("v", "thoughts")}.items()])
    shown = f"if({get('v', 'displayContent', 'variant')} is null, said, {text_of(get('v', 'displayContent', 'variant'))})"
    later = lambda b: f"if({time(b)} > 0, {time(b)}, t)"
    subject, note = f"coalesce({get('b', 'subject')}, '')", f"coalesce({get('b', 'description')}, '')"
    thinking = event(id="concat(id, ':t', i)", kind="'reasoning'", ts_ms=later("b"), text=f"if({subject} = '', {note}, concat({subject}, '\\n', {note}))")
    thought = f"if(ty = 'gemini', transform(thoughts, (b, i) -> {thinking}), array())"
    done = among(get("b", "status"), ("success", "error", "cancelled"))
    response = "coalesce(try_variant_get(r, '$.functionResponse.response', 'variant'), r)"
    piece = text_of(f"coalesce({get(response, 'output', 'variant')}, {get(response, 'error', 'variant')}, {response})", 1)
    output = f"coalesce(if({is_kind(get('b', 'resultDisplay', 'variant'), 'STRING')}, {filled('b', 'resultDisplay')}, null), nullif(array_join(filter(transform({items('b', 'result')}, r -> {piece}), p -> p <> ''), '\\n'), ''), {text_of(get('b', 'result', 'variant'))})"
    call = event(id="concat(id, ':c', i)", kind="'tool_call'", ts_ms=later("b"), call_id=f"coalesce({get('b', 'id')}, '')", name=f"coalesce({get('b', 'name')}, '')", args=f"coalesce({get('b', 'args')}, '{{}}')", partial=f"not {done}")
    result = event(id="concat(id, ':r', i)", kind="'tool_result'", ts_ms=later("b"), call_id=f"coalesce({get('b', 'id')}, '')", name=f"coalesce({get('b', 'name')}, '')", text=output, is_error=f"{get('b', 'status')} <> 'success'")
    tools = f"if(ty = 'gemini', flatten(transform(calls, (b, i) -> array({call}, if({done}, {result}, null)))), array())"
    n = lambda k: count("v", f"tokens.{k}")
    used = when(f"ty = 'gemini' and {is_kind(get('v', 'tokens', 'variant'), 'OBJECT')}", event(id="concat(id, ':u')", kind="'usage'", model="model", input=f"greatest({n('input')} + {n('tool')} - {n('cached')}, 0L)", output=f"{n('output')} + {n('thoughts')}", cache_read=n("cached"), cache_write="0", reasoning=n("thoughts")))
    plain = when("ty = 'user'", event(id="id", kind="'user_message'", text=shown, synthetic="false")) + ", " + when("ty in ('info', 'error', 'warning')", event(id="id", kind="'system'", name="ty", text="said"))
    reply = when("ty = 'gemini' and said <> ''", event(id="id", kind="'assistant_message'", text="said", model="model"))
    ended = when("ty = 'gemini' and said <> '' and size(calls) = 0", event(id="concat(id, ':end')", kind="'turn_end'", name="'stop'"))
    odd = unknown(f"not {among('ty', ('user', 'gemini', 'info', 'error', 'warning'))}", "concat('message.type=', ty)")
    return begun.withColumn("seq", F.lit(0).cast("bigint")).unionByName(emitted(rows, plain, thought, reply, tools, used, ended, odd, cwd="cast(null as string)"))


def pi(lines: DataFrame) -> DataFrame:
    """JSONL of sessions, model changes, titles and messages by role; costs that the harness reports come along where they are over 0."""
    rows = records(lines).select("session", "parent", "n", "v", *[F.expr(e).alias(c) for c, e in {
        "ty": f"coalesce({get('v', 'type')}, '')", "id": f"coalesce({get('v', 'id')}, '')", "m": get("v", "message", "variant"), "c": get("v", "message.content", "variant"), "blocks": items("v", "message.content"), "cwd": f"if({get('v', 'type')} = 'session', {filled('v', 'cwd')}, null)",
        "role": f"if({get('v', 'type')} = 'message', coalesce({get('v', 'message.role')}, ''), null)", "t": f"if({time('v')} > 0, {time('v')}, if({get('v', 'type')} = 'message', {time('v', 'message.timestamp')}, 0L))", "model": filled("v", "message.model")}.items()])
    kind = f"coalesce({get('b', 'type')}, '')"
    result = event(id="concat(id, '#', i)", kind="'tool_result'", call_id=f"coalesce({get('b', 'tool_use_id')}, '')", text=text_of(get("b", "content", "variant")), is_error=f"coalesce({get('b', 'is_error', 'boolean')}, false)")
    user_blocks = f"if(role = 'user', transform(blocks, (b, i) -> if({kind} = 'tool_result', {result}, null)), array())"
    typed = f"if({is_kind('c', 'ARRAY')}, array_join(filter(transform(blocks, b -> if({kind} = 'tool_result', null, if({is_kind('b', 'STRING')}, try_variant_get(b, '$', 'string'), coalesce({get('b', 'text')}, {get('b', 'content')}, concat('[', {get('b', 'type')}, ']'))))), p -> p <> ''), '\\n'), {text_of('c')})"
    rows = rows.withColumn("typed", F.expr(typed)).withColumn("said", F.expr(text_of("c")))
    prompt = when("role = 'user' and typed <> ''", event(id="id", kind="'user_message'", text="typed", synthetic="startswith(typed, '[Wait interrupted') or startswith(typed, '<system-reminder>')"))
    at = "concat(id, '#', i)"
    answer = f"""if(role = 'assistant', transform(blocks, (b, i) -> case
        when {kind} = 'text' then {event(id=at, kind="'assistant_message'", text=f"coalesce({get('b', 'text')}, '')", model="model")}
        when {kind} = 'thinking' then {event(id=at, kind="'reasoning'", text=f"coalesce({get('b', 'thinking')}, '')")}
        when {kind} in ('redactedThinking', 'redacted_thinking') then {event(id=at, kind="'reasoning'", text="'[redacted]'")}
        when {kind} in ('toolCall', 'tool_use') then {event(id=at, kind="'tool_call'", call_id=f"coalesce({get('b', 'id')}, '')", name=f"coalesce({get('b', 'name')}, '')", args=f"coalesce({get('b', 'arguments')}, {get('b', 'input')}, '{{}}')")}
        else {event(id=at, kind="'unknown'", name=kind)} end), array())"""
    n = lambda a, b: f"greatest(coalesce({get('m', f'usage.{a}', 'bigint')}, {get('m', f'usage.{b}', 'bigint')}, 0L), 0L)"
    thinking = n("reasoning", "reasoningTokens")
    cost = f"coalesce({get('m', 'usage.cost.total', 'double')}, {get('m', 'usage.cost', 'double')})"
    used = when(f"role = 'assistant' and {is_kind(get('m', 'usage', 'variant'), 'OBJECT')}", event(
        id="concat(id, ':usage')", kind="'usage'", model="model", input=n("input", "inputTokens"), output=with_reasoning(n("output", "outputTokens"), thinking), cache_read=n("cacheRead", "cacheReadTokens"), cache_write=n("cacheWrite", "cacheWriteTokens"),
        reasoning=thinking, reported=f"if({cost} > 0, {cost}, null)"))
    failed = when(f"role = 'assistant' and {filled('m', 'errorMessage')} is not null", event(id="concat(id, ':error')", kind="'system'", name="'error'", text=get("m", "errorMessage")))
    stop = get("m", "stopReason")
    of = lambda *kinds: f"exists(blocks, b -> {among(get('b', 'type'), kinds)})"
    reason = f"case when {among(stop, (*ENDS, 'error', 'aborted'))} then {stop} when {stop} is null and {of('text')} and not {of('toolCall', 'tool_use')} then 'stop' end"
    ended = when(f"role = 'assistant' and {reason} is not null", event(id="concat(id, ':end')", kind="'turn_end'", name=reason))
    others = ", ".join([
        when("role = 'toolResult'", event(id="id", kind="'tool_result'", call_id=f"coalesce({get('m', 'toolCallId')}, '')", name=filled("m", "toolName"), text="said", is_error=f"coalesce({get('m', 'isError', 'boolean')}, false)")),
        when("role = 'bashExecution'", event(id="id", kind="'system'", name="'bash'", text=f"concat('$ ', coalesce({get('m', 'command')}, ''), '\\n', coalesce({get('m', 'output')}, ''))")),
        when("role in ('system', 'developer')", event(id="id", kind="'system'", name="role", text="said")),
        when("ty = 'compaction'", event(id="id", kind="'system'", name="'compact'", text=f"coalesce({filled('v', 'shortSummary')}, {get('v', 'summary')}, '')")),
        when("ty = 'reset_boundary'", event(id="id", kind="'system'", name="ty", text="''")),
        when("ty = 'custom_message'", event(id="id", kind="'system'", name=f"coalesce({filled('v', 'customType')}, 'custom')", text=text_of(get("v", "content", "variant")))),
        when(f"ty = 'agent_status' and {filled('v', 'status.summary')} is not null", event(id="id", kind="'system'", name="ty", text=get("v", "status.summary"))),
    ])
    told = f"case ty when 'session_info' then {get('v', 'name')} when 'session' then {get('v', 'title')} when 'title' then {get('v', 'title')} when 'title_change' then {get('v', 'title')} end"
    switch = f"case ty when 'model_change' then coalesce({filled('v', 'modelId')}, {filled('v', 'model')}) when 'session_init' then {filled('v', 'resolvedModel')} end"
    metas = ("session", "model_change", "session_init", "session_info", "title", "title_change")
    meta = when(among("ty", metas), event(id="concat('@', n)", kind="'meta'", title=told, rank=f"if(ty = 'session' or ty <> 'session_info' and coalesce({get('v', 'source')} = 'auto', false), 2, 3)", model=switch, started="if(ty = 'session', nullif(t, 0L), null)"))
    known = (*metas, "message", "compaction", "reset_boundary", "custom_message", "agent_status", *SILENT["pi"])
    odd = unknown(f"not {among('ty', known)} or ty = 'message' and not {among('role', ('user', 'assistant', 'toolResult', 'bashExecution', 'system', 'developer'))}", "if(ty = 'message', concat('message.role=', role), concat('type=', ty))")
    return emitted(rows, user_blocks, prompt, answer, used, failed, ended, others, meta, odd)


DECODERS = {"claude": claude, "codex": codex, "gemini": gemini, "pi": pi}
