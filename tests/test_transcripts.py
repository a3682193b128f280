"""Session files of both dialects, from bytes to events, signals and scores."""

import hashlib
import hmac
import json

SALT = b"0123456789abcdef"


def salted(s):
    return "sha256:" + hmac.new(SALT, s.encode(), hashlib.sha256).hexdigest()


def record(kind, n, **more):
    return {"type": kind, "uuid": f"u{n}", "sessionId": "s1", "timestamp": f"2026-06-01T00:00:{n:02d}Z", "cwd": "/w", "gitBranch": "main", "isSidechain": False, **more}


def call(n, cid, name, **given):
    usage = {"input_tokens": 10, "output_tokens": 5, "cache_creation_input_tokens": 1, "cache_read_input_tokens": 2}
    blocks = [{"type": "text", "text": f"step {n}"}, {"type": "tool_use", "id": cid, "name": name, "input": given}]
    return record("assistant", n, message={"role": "assistant", "model": "some-opus", "usage": usage, "content": blocks})


def result(n, cid, text, bad=False):
    return record("user", n, message={"role": "user", "content": [{"type": "tool_result", "tool_use_id": cid, "is_error": bad, "content": text}]})


A = [
    record("started", 0),
    record("user", 1, message={"role": "user", "content": "fix the bug"}),
    call(2, "c1", "Edit", file_path="src/a.py", new="x"),
    result(3, "c1", "ok\n@@ -1 +1 @@\n"),
    "{not json",
    "",
    call(4, "c2", "Bash", command="pytest -q"),
    result(5, "c2", "1 failed"),
    record("user", 6, message={"role": "user", "content": [{"type": "text", "text": "That is wrong, try again"}]}),
    call(7, "c3", "Edit", file_path="src/a.py", new="y"),
    result(8, "c3", "ok"),
    call(9, "c4", "Bash", command="pytest -q"),
    result(10, "c4", "2 passed, exit code 0"),
    call(11, "c5", "Bash", command="git commit -m x"),
    result(12, "c5", "done", bad=False),
    record("user", 13, message={"role": "user", "content": "Base directory for this skill: /h/.x/skills/tidy\nmore"}),
    record("user", 14, message={"role": "user", "content": "[Request interrupted by user]"}),
    record("user", 15, message={"role": "user", "content": "looks good, thanks"}),
    record("system", 16),
    record("result", 17, subtype="success"),
]


def lines_of(spark, *files):
    from tracewell.sources.lines import split_lines

    rows = [(p, "".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records)) for p, records in files]
    return split_lines(spark.createDataFrame(rows, "path string, content string"))


def test_lines_and_stats(spark):
    from tracewell.sources.lines import dialect_of, scan_stats, split_lines, working_folder

    text = 'é{"a":1}\n\n  \n{"cwd":"/x","message":1}\nunfinished'
    lines = split_lines(spark.createDataFrame([("f", text)], "path string, content string"))
    rows = [(r.offset, r.line_no, r.kind) for r in lines.orderBy("offset").collect()]
    assert rows == [(0, 0, "line"), (10, 1, "blank"), (11, 1, "blank"), (14, 1, "line")]
    stats = scan_stats(lines).first()
    assert (stats.cursor, stats.emitted, stats.malformed, stats.oversized, stats.blank) == (len(text.encode()) - len("unfinished"), 1, 1, 0, 2)
    assert dialect_of(lines).first().dialect == "a" and working_folder(lines).first().cwd == "/x"
    from pyspark.sql import functions as F

    rest = split_lines(spark.createDataFrame([("f", text)], "path string, content string"), F.lit(14))
    assert [(r.offset, r.line_no) for r in rest.collect()] == [(14, 0)]


def test_dialect_a_events(spark):
    from tracewell.sources.dialects import events_a

    rows = events_a(lines_of(spark, ("/p/s1.jsonl", A)), SALT).orderBy("offset", "place").collect()
    kinds = [r.type for r in rows]
    assert kinds[:5] == ["session_start", "user_prompt", "assistant_message", "tool_call", "tool_result"] and kinds[-2:] == ["system", "session_end"]
    assert rows[1].prompt_hash == salted('"fix the bug"') and rows[2].message_hash == salted(json.dumps([salted("step 2")], separators=(",", ":")))
    assert (rows[2].input_tokens, rows[3].input_tokens, rows[3].name, rows[3].arguments["keys"]) == (10, 0, "Edit", ["file_path", "new"])
    assert rows[4].tool_call_id == "c1" and rows[4].result.json_type == "string" and rows[1].session_id == "s1"
    assert rows[5].turn_index == 5  # the broken line took a turn index
    assert rows[-2].harness == "claudecode" and rows[-2].session_id is None and rows[-1].reason == "success"
    assert not any("fix the bug" in str(r) for r in rows)


def test_signals_and_scores(spark):
    from tracewell.operators.signals import evidence, outcome_signals, scored, session_fold
    from tracewell.sources.dialects import events_a, facts_a

    open_end = [*A[:3]]
    lines = lines_of(spark, ("/p/s1.jsonl", A), ("/p/s2.jsonl", open_end)).cache()
    fold = {r.path: r for r in session_fold(events_a(lines, SALT)).collect()}
    one = fold["/p/s1.jsonl"]
    assert (one.model, one.input_tokens, one.cache_tokens, one.turns, one.tool_calls, one.edits, one.tool_errors, one.duration_ms) == ("some-opus", 50, 15, 5, 5, 2, 0, 17_000)
    out = {r.path: r for r in outcome_signals(facts_a(lines)).collect()}
    s = out["/p/s1.jsonl"]
    assert (s.verification, s.landing_quality, s.termination, s.human_turns, s.interruptions) == ("passed", "succeeded", "clean", 3, 1)
    assert (s.corrections, s.acceptances, s.rework, s.verified_after_edit, s.skills_used, s.files_touched, s.edit_count, s.diff_hunks) == (1, 1, 1, True, ["tidy"], 1, 2, 1)
    assert (out["/p/s2.jsonl"].termination, out["/p/s2.jsonl"].landing_quality, out["/p/s2.jsonl"].verification) == ("abandoned", "none", "")
    score = {r.path: r for r in scored(session_fold(events_a(lines, SALT)), outcome_signals(facts_a(lines))).collect()}["/p/s1.jsonl"]
    assert (score.success, score.autonomy, score.friction, score.confidence) == (95.0, 100.0, 72.7, "high")
    logit = -0.35 + 1.7 + 0.7 + 1.1 + 0.4 + 0.25 - 0.35 - 0.2 - 0.2 + 0.8
    assert abs(score.utility - 100 / (1 + 2.718281828459045 ** -logit)) < 0.06 and score.evidence[1] == "verification passed +1.70"
    listed = {r.path: [e.signal for e in r.evidence] for r in evidence(facts_a(lines)).collect()}
    assert listed["/p/s1.jsonl"] == ["scope", "verification", "human_correction", "scope", "verification", "landing_quality", "skill_used", "interruption", "human_acceptance"]


def item(n, **payload):
    return {"timestamp": f"2026-06-01T00:00:{n:02d}Z", "type": "response_item", "payload": payload}


def tokens(n, i, o):
    return {"timestamp": f"2026-06-01T00:00:{n:02d}Z", "type": "event_msg", "payload": {"type": "token_count", "info": {"last_token_usage": {"input_tokens": i, "cached_input_tokens": 1, "output_tokens": o, "reasoning_output_tokens": 2}}}}


def message(n, role, text):
    return item(n, type="message", role=role, content=[{"type": "x_text", "text": text}] if text else [])


B = [
    {"timestamp": "2026-06-01T00:00:00Z", "type": "session_meta", "payload": {"id": "sess", "timestamp": "2026-06-01T00:00:00Z", "cwd": "/w", "git": {"branch": "dev"}}},
    {"timestamp": "1780272001.5", "type": "turn_context", "payload": {"turn_id": "t1", "cwd": "/w2", "model": "gpt-x"}},
    message(2, "user", "do it"), tokens(3, 7, 1), message(4, "assistant", "well"), item(5, type="function_call", name="exec_command", call_id="k1", arguments='{"cmd":"go test ./..."}'),
    item(6, type="function_call_output", call_id="k1", output="FAIL x"), tokens(7, 11, 3), message(8, "user", "no, actually broken"), tokens(9, 13, 5), item(10, type="reasoning"),
    {"timestamp": "2026-06-01T00:00:11Z", "type": "future", "payload": {"secret": "no"}}, {"timestamp": "2026-06-01T00:00:12Z", "type": "event_msg", "payload": {"type": "odd"}},
]


def test_dialect_b(spark):
    from tracewell.operators.signals import outcome_signals
    from tracewell.sources.dialects import events_b, facts_b
    from tracewell.sources.lines import dialect_of

    lines = lines_of(spark, ("/s/rollout-2026-06-01T00-00-00-abc.jsonl", B))
    rows = events_b(lines, SALT).orderBy("offset").collect()
    assert [r.type for r in rows] == ["session_start", "user_prompt", "assistant_message", "tool_call", "tool_result", "user_prompt", "future", "event_msg.odd"]
    said = rows[2]
    assert (said.input_tokens, said.output_tokens, said.cache_read_input_tokens, said.model, said.cwd, said.session_id, said.turn_index) == (18, 8, 2, "gpt-x", "/w2", "sess", 4)
    assert rows[0].model is None and rows[0].event_id == "sess" and rows[3].event_id == "k1" and rows[3].arguments["keys"] == ["cmd"]
    assert rows[1].event_id == "2026-06-01T00:00:02Z:user_prompt:2" and dialect_of(lines).first().dialect == "b"
    s = outcome_signals(facts_b(lines)).first()
    assert (s.verification, s.termination, s.human_turns, s.corrections) == ("failed", "abandoned", 2, 1)


def test_held_tokens_against_a_walk(spark):
    import random

    from pyspark.sql import functions as F

    from tracewell.operators.carry import held_tokens

    r = random.Random(4)
    rows = [(p, i, r.choice("abttt"), r.randint(1, 9)) for p in range(12) for i in range(r.randint(0, 30))]
    want = {}
    for p in {x[0] for x in rows}:
        held, carried = None, 0
        for _, i, kind, n in sorted(x for x in rows if x[0] == p):
            if kind == "a":
                held, want[p, i], carried = i, carried, 0
            elif kind == "b":
                held = None
            elif held is not None:
                want[p, held] += n
            else:
                carried += n
    df = spark.createDataFrame(rows, "p int, i int, kind string, n int")
    out = held_tokens(df, F.col("kind") == "a", F.col("kind") == "b", F.when(F.col("kind") == "t", F.col("n")), ["p"], ["i"])
    assert {(x.p, x.i): x.tokens for x in out.collect()} == want


def test_scan_of_real_files(spark, tmp_path):
    from tracewell.sources.lines import MOST_LINE_BYTES, scan_lines, scan_stats

    deep = tmp_path / "projects" / "slug" / "sub"
    deep.mkdir(parents=True)
    odd = b'{"a":"\xff\xfe"}\n{"b":1}\r\n\n  \n{"c":2}\nunfinished'
    (deep / "odd.jsonl").write_bytes(odd)
    (deep.parent / "whole.jsonl").write_bytes(b'{"x":1}\n{"y":2}\n')
    (deep / "rollout-1.txt").write_bytes(b"no\n")
    (deep / "empty.jsonl").write_bytes(b"")
    big = b'{"big":"' + b"x" * MOST_LINE_BYTES + b'"}\n'
    (deep / "big.jsonl").write_bytes(b'{"a":1}\n' + big + b'{"z":1}\n')
    many = [f'{{"n":{k},"s":"{"é" * (k % 40)}"}}\n'.encode() for k in range(3_000)]
    (deep / "many.jsonl").write_bytes(b"".join(many))
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")  # cuts files into many blocks
    try:
        rows = scan_lines(spark, str(tmp_path)).collect()
        stats = {r.path.rsplit("/", 1)[1]: r for r in scan_stats(scan_lines(spark, str(tmp_path))).collect()}
        later = scan_lines(spark, str(tmp_path), "many.jsonl", spark.createDataFrame([(next(r.path for r in rows if r.path.endswith("many.jsonl")), sum(map(len, many[:1_000])))], "path string, cursor long")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    by = lambda name: sorted((r.offset, r.line_no, r.kind) for r in rows if r.path.endswith("/" + name))
    assert by("odd.jsonl") == [(0, 0, "line"), (11, 1, "line"), (20, 2, "blank"), (21, 2, "blank"), (24, 2, "line")]
    assert by("whole.jsonl") == [(0, 0, "line"), (8, 1, "line")] and by("empty.jsonl") == [] and by("rollout-1.txt") == []
    assert by("big.jsonl") == [(0, 0, "line"), (8, 1, "oversized"), (8 + len(big), 1, "line")]
    at = [0]
    for line in many:
        at.append(at[-1] + len(line))
    assert by("many.jsonl") == [(at[k], k, "line") for k in range(3_000)]
    assert {r.line for r in rows if r.path.endswith("many.jsonl")} == {line[:-1].decode() for line in many}
    assert (stats["odd.jsonl"].cursor, stats["odd.jsonl"].blank, stats["big.jsonl"].oversized, stats["many.jsonl"].emitted) == (32, 2, 1, 3_000)
    assert sorted((r.offset, r.line_no) for r in later) == [(at[k], k - 1_000) for k in range(1_000, 3_000)]


def test_both_dialects_as_one(spark):
    from tracewell.sources.dialects import events, facts, judge_turns

    lines = lines_of(spark, ("/p/s1.jsonl", A), ("/q/rollout-x.jsonl", B)).cache()
    assert {(r.path[1], r.harness) for r in events(lines, SALT).collect()} == {("p", "claudecode"), ("q", "codex")}
    assert facts(lines).count() > 20
    turns = [(r.role, r.text) for r in judge_turns(lines).where("path like '/p%'").orderBy("offset").collect()]
    assert turns[0] == ("user", "fix the bug") and not any("Base directory" in t for _, t in turns)
    import pytest

    with pytest.raises(ValueError, match="salt"):
        events(lines, b"short")
