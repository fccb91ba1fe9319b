"""Decoders record by record: each case is a session of its own, its records beside the events they must give."""

import json

import pytest

from tracemill.operators import ledger
from tracemill.sources import decoders, jsonl

T, MS = "2031-03-09T14:25:10.250Z", 1930832710250


def talk(role, content, **more):
    """A claude record."""
    return {"type": role, "uuid": "r", "timestamp": T, "message": {"role": role, "content": content, **more}}


def item(kind, **more):
    """A codex response item."""
    return {"type": "response_item", "timestamp": T, "payload": {"type": kind, "id": "i", **more}}


def note(kind, **more):
    return {"type": "event_msg", "timestamp": T, "payload": {"type": kind, **more}}


def tokens(last, total):
    return note("token_count", info={"last_token_usage": last, "total_token_usage": {"total_tokens": total}})


def bubble(kind, **more):
    """A gemini message."""
    return {"id": "g", "type": kind, "timestamp": T, **more}


def turn(role, **more):
    """A pi message."""
    return {"type": "message", "id": "p", "timestamp": T, "message": {"role": role, **more}}


# Each case: records, then the events (id, kind, other fields that must hold).
CASES = {
    "claude": {
        "a prompt": ([talk("user", "plot the tides")], [("r", "user_message", {"text": "plot the tides", "synthetic": False, "ts_ms": MS})]),
        "prompts of the harness": ([talk("user", " <system-reminder> low ink"), {**talk("user", "hello"), "isMeta": True}, {**talk("user", "relayed"), "origin": {"kind": "agent"}}], [("r", "user_message", {"synthetic": True})] * 3),
        "a command is no prompt": ([talk("user", "<command-name>/tide</command-name>")], [("r", "system", {"name": "command"})]),
        "an interruption ends the turn": ([talk("user", [{"type": "text", "text": "[Request interrupted by user for tool use]"}])], [("r#0", "turn_end", {"name": "interrupted"})]),
        "blocks of a prompt": ([talk("user", [{"type": "text", "text": "one"}, {"type": "image"}, {"type": "tool_result", "tool_use_id": "k9", "content": "7 buoys"}])], [("r#2", "tool_result", {"call_id": "k9", "text": "7 buoys", "is_error": False}), ("r#t", "user_message", {"text": "one\n[image]"})]),
        "nested result content": ([talk("user", [{"type": "tool_result", "tool_use_id": "k", "is_error": True, "content": [{"type": "text", "text": "up"}, "down", {"type": "chart"}]}])], [("r#0", "tool_result", {"text": "up\ndown\n[chart]", "is_error": True})]),
        "an answer's blocks": ([talk("assistant", [{"type": "thinking", "thinking": "moon"}, {"type": "redacted_thinking"}, {"type": "text", "text": "High at six"}, {"type": "server_tool_use", "id": "k1", "name": "fetch", "input": {"sea": "north"}}, {"type": "web_search_tool_result", "tool_use_id": "k1", "content": []}, {"type": "hologram"}], model="model-z")],
            [("r#0", "reasoning", {"text": "moon"}), ("r#1", "reasoning", {"text": "[redacted]"}), ("r#2", "assistant_message", {"text": "High at six", "model": "model-z"}), ("r#3", "tool_call", {"call_id": "k1", "name": "fetch", "args": '{"sea":"north"}'}), ("r#4", "tool_result", {"call_id": "k1"}), ("r#5", "unknown", {"name": "hologram"})]),
        "usage is the message's": ([talk("assistant", [], id="msg4", model="model-z", stop_reason="refusal", usage={"input_tokens": 31, "output_tokens": 17, "cache_creation_input_tokens": 900, "output_tokens_details": {"thinking_tokens": 4}})], [("msg4:usage", "usage", {"input": 31, "output": 17, "cache_read": 0, "cache_write": 900, "reasoning": 4, "model": "model-z"}), ("msg4:end", "turn_end", {"name": "refusal"})]),
        "an error of the service": ([{**talk("assistant", [{"type": "text", "text": "overloaded"}], model="<synthetic>", usage={"input_tokens": 1}), "isApiErrorMessage": True}], [("r#0", "system", {"name": "api_error", "text": "overloaded"})]),
        "notices": ([{"type": "system", "uuid": "n", "subtype": "away_summary", "content": "back soon"}, {"type": "system", "uuid": "d", "subtype": "turn_duration"}, {"type": "continued-in"}], [("n", "system", {"name": "away_summary", "text": "back soon"}), ("n:end", "turn_end", {}), ("d", "turn_end", {}), ("continued:3", "turn_end", {"name": "continued_in"})]),
        "silent, broken and new kinds": ([{"type": "queue-operation"}, "{half", {"type": "weather"}], [("@3", "unknown", {"name": "type=weather"})]),
        "side chains of a parent's file": ([{**talk("user", "aside"), "isSidechain": True}], []),
    },
    "codex": {
        "messages by role": ([item("message", role="user", content=[{"type": "input_text", "text": "sort"}, {"type": "input_text", "text": "these"}]), item("message", role="user", content=[{"text": "<skill> x"}]), item("message", role="assistant", content=[{"text": "sorted"}]), item("message", role="developer", content=[{"text": "be brief"}])],
            [("i", "user_message", {"text": "sort\nthese", "synthetic": False}), ("i", "user_message", {"synthetic": True}), ("i", "assistant_message", {"text": "sorted"}), ("i", "system", {"name": "developer", "text": "be brief"})]),
        "reasoning without a summary is silent": ([item("reasoning", summary=[], content=None), item("reasoning", summary=[{"text": "quick"}, {"text": "sort"}])], [("i", "reasoning", {"text": "quick\nsort"})]),
        "calls": ([item("custom_tool_call", call_id="z1", name="patch", input="*** x"), item("local_shell_call", call_id="z2", action={"cmd": ["ls"]})], [("i", "tool_call", {"call_id": "z1", "name": "patch", "args": "*** x"}), ("i", "tool_call", {"call_id": "z2", "name": "shell"})]),
        "outputs and their exit codes": ([item("function_call_output", call_id="z1", output='{"output": "gone", "metadata": {"exit_code": 127}}'), item("custom_tool_call_output", call_id="z2", output="Exit code: 0\nok"), item("function_call_output", call_id="z3", output="Exit code: -9\nkilled")],
            [("i", "tool_result", {"call_id": "z1", "text": "gone", "is_error": True}), ("i", "tool_result", {"call_id": "z2", "is_error": False}), ("i", "tool_result", {"call_id": "z3", "is_error": True})]),
        "turns": ([note("task_started", turn_id="q5"), note("task_complete", turn_id="q5"), note("turn_aborted", turn_id="q6", reason="replaced")], [("turn:q5:start", "turn_start", {}), ("turn:q5:end", "turn_end", {"name": "complete"}), ("turn:q6:end", "turn_end", {"name": "replaced"})]),
        "usage holds the model of the last context": ([{"type": "turn_context", "payload": {"model": "model-q"}}, tokens({"input_tokens": 50, "cached_input_tokens": 8, "cache_write_input_tokens": 2, "output_tokens": 6, "reasoning_output_tokens": 1}, 56)], [("@2", "usage", {"model": "model-q", "input": 40, "output": 6, "cache_read": 8, "cache_write": 2, "reasoning": 1})]),
        "a repeated total is no step": ([tokens({"input_tokens": 5}, 5), tokens({"input_tokens": 5}, 5), tokens({"input_tokens": 6}, 11)], [("@1", "usage", {"input": 5}), ("@3", "usage", {"input": 6})]),
        "usage records take over from counts": ([{"type": "token_usage_record", "payload": {"response_id": "resp", "usage": {"input_tokens": 9, "output_tokens": 3, "reasoning_output_tokens": 12}}}, tokens({"input_tokens": 1}, 1)], [("resp:usage", "usage", {"input": 9, "output": 15, "reasoning": 12})]),
        "compaction and errors": ([{"type": "compacted", "payload": {"message": "short"}}, item("compaction"), note("stream_error", message="cut")], [("@1", "system", {"name": "compact", "text": "short"}), ("i", "system", {"name": "compact"}), ("@3", "system", {"name": "error", "text": "cut"})]),
        "new kinds": ([item("hologram"), {"type": "weather"}], [("@1", "unknown", {"name": "response_item=hologram"}), ("@2", "unknown", {"name": "type=weather"})]),
    },
    "gemini": {
        "a user's text, as displayed": ([bubble("user", content=[{"text": "@map what is here"}], displayContent="what is here")], [("g", "user_message", {"text": "what is here"})]),
        "thoughts have their own times": ([bubble("gemini", content="", thoughts=[{"subject": "Harbour", "description": "look east", "timestamp": "2031-03-09T14:25:09Z"}, {"description": "no subject"}])], [("g:t0", "reasoning", {"text": "Harbour\nlook east", "ts_ms": MS - 1250}), ("g:t1", "reasoning", {"text": "no subject", "ts_ms": MS})]),
        "an answer without calls ends the turn": ([bubble("gemini", content="A lighthouse", model="model-g")], [("g", "assistant_message", {"text": "A lighthouse", "model": "model-g"}), ("g:end", "turn_end", {"name": "stop"})]),
        "a call is partial until it is done": ([bubble("gemini", content="wait", toolCalls=[{"id": "y7", "name": "dive", "args": {"m": 30}, "status": "scheduled"}])], [("g", "assistant_message", {}), ("g:c0", "tool_call", {"call_id": "y7", "name": "dive", "args": '{"m":30}', "partial": True})]),
        "done calls with the ways a result is told": ([bubble("gemini", content="", toolCalls=[{"id": "y1", "name": "dive", "status": "success", "resultDisplay": "30 m"}, {"id": "y2", "name": "dive", "status": "cancelled", "result": [{"functionResponse": {"response": {"error": "no air"}}}]}, {"id": "y3", "name": "log", "status": "success", "result": [{"functionResponse": {"response": {"output": "noted"}}}]}])],
            [("g:c0", "tool_call", {"partial": False}), ("g:r0", "tool_result", {"text": "30 m", "is_error": False}), ("g:c1", "tool_call", {}), ("g:r1", "tool_result", {"text": "no air", "is_error": True}), ("g:c2", "tool_call", {}), ("g:r2", "tool_result", {"call_id": "y3", "text": "noted"})]),
        "tokens": ([bubble("gemini", content="", model="model-g", tokens={"input": 70, "cached": 12, "output": 8, "thoughts": 21, "tool": 3})], [("g:u", "usage", {"input": 61, "output": 29, "cache_read": 12, "reasoning": 21})]),
        "notices and new kinds": ([bubble("warning", content="low battery"), bubble("weather")], [("g", "system", {"name": "warning", "text": "low battery"}), ("@2", "unknown", {"name": "message.type=weather"})]),
        "a snapshot's messages come in order": ([{"$set": {"messages": [bubble("info", content="first"), bubble("user", content="second")]}}], [("g", "system", {"text": "first"}), ("g", "user_message", {"text": "second"})]),
    },
    "pi": {
        "prompts": ([turn("user", content="bake"), turn("user", content="<system-reminder> hot"), turn("user", content=[])], [("p", "user_message", {"text": "bake", "synthetic": False, "ts_ms": MS}), ("p", "user_message", {"synthetic": True})]),
        "results inside a prompt": ([turn("user", content=[{"type": "text", "text": "and then"}, {"type": "tool_result", "tool_use_id": "o3", "content": "200 C", "is_error": True}])], [("p#1", "tool_result", {"call_id": "o3", "text": "200 C", "is_error": True}), ("p", "user_message", {"text": "and then"})]),
        "an answer's blocks": ([turn("assistant", model="model-p", stopReason="toolUse", content=[{"type": "thinking", "thinking": "knead"}, {"type": "redactedThinking"}, {"type": "text", "text": "Rising"}, {"type": "tool_use", "id": "o1", "name": "oven", "input": {"c": 220}}, {"type": "crumb"}])],
            [("p#0", "reasoning", {"text": "knead"}), ("p#1", "reasoning", {"text": "[redacted]"}), ("p#2", "assistant_message", {"text": "Rising", "model": "model-p"}), ("p#3", "tool_call", {"call_id": "o1", "name": "oven", "args": '{"c":220}'}), ("p#4", "unknown", {"name": "crumb"})]),
        "usage, with reasoning left out of the output": ([turn("assistant", content=[], stopReason="error", errorMessage="burnt", usage={"inputTokens": 14, "output": 5, "reasoningTokens": 6, "cacheWrite": 2, "cost": 0.125})], [("p:usage", "usage", {"input": 14, "output": 11, "cache_write": 2, "reasoning": 6, "reported": 0.125}), ("p:error", "system", {"name": "error", "text": "burnt"}), ("p:end", "turn_end", {"name": "error"})]),
        "text without calls ends the turn": ([turn("assistant", content=[{"type": "text", "text": "Done"}])], [("p#0", "assistant_message", {}), ("p:end", "turn_end", {"name": "stop"})]),
        "other roles": ([turn("toolResult", toolCallId="o1", toolName="oven", content="hot", isError=True), turn("bashExecution", command="date", output="noon"), turn("developer", content="rules"), turn("baker")], [("p", "tool_result", {"call_id": "o1", "name": "oven", "text": "hot", "is_error": True}), ("p", "system", {"name": "bash", "text": "$ date\nnoon"}), ("p", "system", {"name": "developer"}), ("@4", "unknown", {"name": "message.role=baker"})]),
        "other records": ([{"type": "compaction", "id": "c", "summary": "long", "shortSummary": "short"}, {"type": "custom_message", "id": "m", "customType": "timer", "content": "ding"}, {"type": "label"}, {"type": "weather"}], [("c", "system", {"name": "compact", "text": "short"}), ("m", "system", {"name": "timer", "text": "ding"}), ("@4", "unknown", {"name": "type=weather"})]),
    },
}


def lines_of(spark, sessions):
    rows = [(name, None, k, r if isinstance(r, str) else json.dumps(r)) for name, records in sessions.items() for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "session string, parent string, at int, line string")


@pytest.mark.parametrize("harness", sorted(CASES))
def test_records(spark, harness):
    events = decoders.DECODERS[harness](lines_of(spark, {name: records for name, (records, _) in CASES[harness].items()})).where("kind <> 'meta'")
    found = {}
    for r in events.orderBy("session", "seq").collect():
        found.setdefault(r["session"], []).append(r)
    for name, (_, want) in CASES[harness].items():
        rows = found.get(name, [])
        assert [(r["id"], r["kind"]) for r in rows] == [(i, k) for i, k, _ in want], name
        for r, (_, _, fields) in zip(rows, want):
            assert {k: r[k] for k in fields} == fields, name


SESSIONS = {
    "claude": ([{"type": "summary", "summary": "least"}, {**talk("user", "  map   the\nreef "), "cwd": "/sea"}, {"type": "ai-title", "aiTitle": "middle"}, {"type": "custom-title", "customTitle": "The  reef"}, {"type": "agent-name", "agentName": "late"}, talk("assistant", [{"type": "text", "text": "ok"}], model="model-z")], ("The reef", "map the reef", "/sea", "model-z", MS)),
    "codex": ([{"type": "session_meta", "timestamp": T, "payload": {"cwd": "/yard", "timestamp": "2031-03-09T14:25:00Z"}}, {"type": "turn_context", "payload": {"model": "model-q", "cwd": "/yard/shed"}}, item("message", role="user", content=[{"text": "<user_instructions> no"}]), item("message", role="user", content=[{"text": "saw"}])], (None, "saw", "/yard/shed", "model-q", MS - 10250)),
    "gemini": ([{"sessionId": "any", "startTime": "2031-03-09T14:24:10.250Z"}, bubble("user", content="dive"), bubble("gemini", content="ok", model="model-g")], (None, "dive", None, "model-g", MS - 60000)),
    "pi": ([{"type": "session", "id": "s", "cwd": "/oven", "timestamp": T, "title": "given"}, {"type": "title_change", "title": "made", "source": "auto"}, {"type": "session_info", "name": "chosen"}, {"type": "model_change", "modelId": "model-p"}, turn("user", content="bake")], ("chosen", "bake", "/oven", "model-p", MS)),
}


@pytest.mark.parametrize("harness", sorted(SESSIONS))
def test_sessions(spark, harness):
    records, want = SESSIONS[harness]
    row = jsonl.sessions(decoders.DECODERS[harness](lines_of(spark, {"s": records}))).first()
    assert (row["title"], row["preview"], row["cwd"], row["model"], row["started_at"]) == want


def test_usage_that_is_told_again_is_one_step(spark):
    part = lambda out: talk("assistant", [], id="msg", model="model-z", usage={"input_tokens": 20, "output_tokens": out})
    events = decoders.claude(lines_of(spark, {"s": [talk("user", "go"), part(1), part(8), talk("user", "on"), part(9)]}))
    steps = ledger.steps(ledger.turned(events.where("kind <> 'meta'"))).collect()
    assert [(r["id"], r["turn"], r["output"]) for r in steps] == [("msg:usage", 1, 9)]


def put(folder, name, *records):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


def test_files_with_one_stem_stay_apart(spark, tmp_path):
    put(tmp_path, "a/log.jsonl", talk("user", "from a"), talk("user", "again a"))
    put(tmp_path, "b/log.jsonl", talk("user", "from b"))
    put(tmp_path, "a/log/subagents/agent-1.jsonl", {**talk("user", "child of log"), "isSidechain": True})
    put(tmp_path, "a/log/subagents/agent-1.meta.json", {"toolUseId": "k5"})
    put(tmp_path, "c/subagents/agent-1.jsonl", {**talk("user", "child of c"), "isSidechain": True})
    put(tmp_path, "c/subagents/agent-1.meta.json", {"agentType": "none"})
    events = jsonl.named(decoders.claude(jsonl.scan(spark, str(tmp_path))), "claude").cache()
    got = sorted((r["session"], r["parent"], r["source"].rsplit("/", 3)[-3:], r["text"], r["seq"] >> jsonl.PER) for r in events.collect())
    assert [(s, p, t, n) for s, p, _, t, n in got] == [("agent-1", "c", "child of c", 1), ("agent-1", "log", "child of log", 1), ("log", None, "again a", 2), ("log", None, "from a", 1), ("log", None, "from b", 1)]
    calls = jsonl.parent_calls(spark, str(tmp_path)).join(events, "source").select("parent", "parent_call").collect()
    assert [tuple(r) for r in calls] == [("log", "k5")]


def test_whole_files_of_one_folder_stay_apart(spark, tmp_path):
    for n in (1, 2, 3):
        head = {"sessionId": "x", "startTime": T, "messages": [bubble("user", content=f"text {n}")]}
        put(tmp_path, f"{'reef' if n < 3 else 'cove'}/chats/session-{n}.json", head)
    projects = spark.createDataFrame([("reef", "/home/reef"), ("other", "/o")], "name string, path string")
    events = jsonl.named(decoders.gemini(jsonl.whole(spark, str(tmp_path))), "gemini", projects).where("kind <> 'meta'")
    assert sorted((r["session"], r["cwd"], r["text"]) for r in events.collect()) == [("session-1", "/home/reef", "text 1"), ("session-2", "/home/reef", "text 2"), ("session-3", None, "text 3")]


def test_names_of_timed_files(spark, tmp_path):
    long = "0123abcd-4567-89ab-cdef-0123456789ab"
    put(tmp_path, f"x/rollout-2031-03-09T14-25-10-{long}.jsonl", item("message", role="user", content="a"))
    put(tmp_path, "y/short.jsonl", item("message", role="user", content="a"))
    assert sorted(r["session"] for r in jsonl.named(decoders.codex(jsonl.scan(spark, str(tmp_path))), "codex").collect()) == [long, "short"]
    time, other = "2031-03-09T14-25-10-250Z", tmp_path / "pi"
    put(other, f"{time}_top.jsonl", turn("user", content="a"))
    put(other, f"{time}_top/{time}_sub.jsonl", turn("user", content="a"))
    put(other, f"{time}_top/deep/worker.jsonl", turn("user", content="a"))
    put(other, "2031_no.jsonl", turn("user", content="a"))
    got = jsonl.named(decoders.pi(jsonl.scan(spark, str(other))), "pi").collect()
    assert sorted((r["session"], r["parent"] or "") for r in got) == [("2031_no", ""), ("sub", "top"), ("top", ""), ("top.worker", "top")]


@pytest.mark.parametrize("harness", sorted(decoders.DECODERS))
def test_empty_null_and_scalar_lines(spark, harness):
    lines = spark.createDataFrame([("s", None, 1, None), ("s", None, 2, ""), ("s", None, 3, "7"), ("s", None, 4, '"x"'), ("s", None, 5, "[1]"), ("s", None, 6, "null")], "session string, parent string, at int, line string")
    found = decoders.DECODERS[harness](lines)
    assert {r["kind"] for r in found.collect()} <= {"unknown"}
    assert decoders.DECODERS[harness](lines.limit(0)).count() == 0
