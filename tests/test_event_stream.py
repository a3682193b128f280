"""Events of a stream of lines against one pass over the file, however it is cut, and their order against a plain parser."""

import json
import random

import pytest

SALT = b"0123456789abcdef"


def message(role, said):
    return {"timestamp": "2026-06-01T00:00:00Z", "type": "response_item", "payload": {"type": "message", "role": role, "content": [{"type": "output_text", "text": said}]}}


def item(kind, **more):
    return {"timestamp": "2026-06-01T00:00:01Z", "type": "response_item", "payload": {"type": kind, **more}}


def tokens(n):
    return {"type": "event_msg", "payload": {"type": "token_count", "turn_id": "t", "info": {"last_token_usage": {"input_tokens": n, "cached_input_tokens": 1, "output_tokens": 2, "reasoning_output_tokens": 3}}}}


def records(rng, n):
    """A random file's records."""
    make = [
        lambda k: message("assistant", f"a{k}"), lambda k: message("assistant", ""), lambda k: message("user", f"u{k}"), lambda k: message("user", ""), lambda k: message("developer", "x"),
        lambda k: tokens(k + 1), lambda k: tokens(k + 1), lambda k: tokens(0), lambda k: item("function_call", name="exec", call_id=f"c{k}", arguments='{"b":1,"a":2}'), lambda k: item("function_call_output", call_id=f"c{k}", output="done"),
        lambda k: {"type": "session_meta", "timestamp": "2026-06-01T00:00:00Z", "payload": {"id": f"s{k}", "cwd": f"/w{k}", "git": {"branch": "main"}}}, lambda k: {"type": "turn_context", "payload": {"turn_id": f"t{k}", "cwd": f"/v{k}", "model": f"m{k}"}},
        lambda k: item("reasoning"), lambda k: {"type": "event_msg", "payload": {"type": "task_complete"}}, lambda k: {"type": "event_msg", "payload": {"type": "odd"}}, lambda k: {"type": "compacted", "payload": {}}, lambda k: "{broken",
    ]
    return [rng.choice(make)(k) for k in range(n)]


def emission(rows):
    """(type or text, tokens) in the order in which a plain parser that holds one message lets events go."""
    out, held, carry = [], None, 0

    def flush():
        nonlocal held
        out.extend([held] if held else [])
        held = None

    for offset, r in rows:
        if isinstance(r, str):
            continue
        p, kind = r["payload"], r["type"]
        if kind == "session_meta":
            flush()
            out.append([offset, "session_start", 0])
        elif kind == "turn_context":
            continue
        elif kind == "event_msg":
            if p["type"] == "token_count":
                if held:
                    held[2] += p["info"]["last_token_usage"]["input_tokens"]
                else:
                    carry += p["info"]["last_token_usage"]["input_tokens"]
            elif p["type"] == "odd":
                out.append([offset, "event_msg.odd", 0])
        elif kind == "compacted":
            out.append([offset, kind, 0])
        elif p["type"] == "message":
            said = p["content"][0]["text"]
            if p["role"] == "user":
                flush()
                out.extend([[offset, "user_prompt", 0]] if said else [])
            elif p["role"] == "assistant" and said:
                flush()
                held, carry = [offset, "assistant_message", carry], 0
            elif p["role"] == "developer":
                out.append([offset, "response_item.message.developer", 0])
        elif p["type"] != "reasoning":
            out.append([offset, {"function_call": "tool_call", "function_call_output": "tool_result"}[p["type"]], 0])
    flush()
    return [tuple(x) for x in out]


def placed(rows):
    out, at = [], 0
    for r in rows:
        line = r if isinstance(r, str) else json.dumps(r)
        out.append((at, line))
        at += len(line) + 1
    return out


def test_emission_order_of_random_files(spark):
    from tracewell.sources.dialects import events_b

    rng = random.Random(12)
    files = {f"rollout-2026-06-01T00-00-00-f{k}.jsonl": records(rng, rng.choice((0, 1, 5, 60))) for k in range(25)}
    lines = spark.createDataFrame([(p, o, 0, line, "line") for p, rs in files.items() for o, line in placed(rs)], "path string, offset long, line_no int, line string, kind string")
    got = {}
    for r in events_b(lines, SALT).orderBy("path", "emitted", "place").collect():
        got.setdefault(r.path, []).append((r.offset, r.type, r.input_tokens))
    for p, rs in files.items():
        assert got.get(p, []) == emission([(o, r) for (o, _), r in zip(placed(rs), rs, strict=True)]), p


@pytest.fixture
def rocks(spark):
    from tracewell.streaming.events import PROVIDER

    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, PROVIDER)
    yield
    spark.conf.set(name, before)


def test_any_micro_batches_equal_one_pass(spark, tmp_path, rocks):
    from tracewell.sources.dialects import EVENT, events_b
    from tracewell.streaming.events import events_b_stream

    rng = random.Random(5)
    files = {f"/r/rollout-2026-06-01T00-00-00-f{k}.jsonl": placed(records(rng, 40) + [message("user", "last")]) for k in range(3)}
    (tmp_path / "in").mkdir()
    cuts = {p: sorted([0, len(ls), *rng.sample(range(len(ls)), 2)]) for p, ls in files.items()}
    stream = events_b_stream(spark.readStream.schema("path string, offset long, line string").json(str(tmp_path / "in")), SALT, 3600)
    for b in range(3):
        part = [(p, o, line) for p, ls in files.items() for o, line in ls[cuts[p][b] : cuts[p][b + 1]]]
        rng.shuffle(part)
        (tmp_path / "in" / f"{b}.json").write_text("".join(json.dumps({"path": p, "offset": o, "line": line}) + "\n" for p, o, line in part))
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(once=True).start(str(tmp_path / "out"))  # timers keep other triggers going
        assert q.awaitTermination(60) and q.exception() is None
    lines = spark.createDataFrame([(p, o, 0, line, "line") for p, ls in files.items() for o, line in ls], "path string, offset long, line_no int, line string, kind string")
    want = sorted(map(str, events_b(lines, SALT).select(EVENT).collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).select(EVENT).collect())) == want and len(want) > 50


def test_a_still_file_lets_its_message_go(spark, tmp_path, rocks):
    import time

    from tracewell.streaming.events import events_b_stream

    (tmp_path / "in").mkdir()
    write = lambda n, rows: (tmp_path / "in" / n).write_text("".join(json.dumps({"path": "p", "offset": o, "line": json.dumps(r)}) + "\n" for o, r in rows))
    stream = events_b_stream(spark.readStream.schema("path string, offset long, line string").json(str(tmp_path / "in")), SALT, 1)
    write("1.json", [(0, {"type": "session_meta", "payload": {"id": "session-a", "cwd": "/workspace", "git": {"branch": "main"}}}), (9, {"type": "turn_context", "payload": {"model": "m"}}), (20, message("assistant", "done")), (30, tokens(4))])
    q = stream.writeStream.format("memory").queryName("still").option("checkpointLocation", str(tmp_path / "mark")).trigger(processingTime="500 milliseconds").start()
    try:
        rows, until = [], time.time() + 60
        while len(rows) < 2 and time.time() < until:
            time.sleep(0.5)
            rows = spark.sql("select * from still order by offset").collect()
        assert [(r.type, r.emitted, r.place, r.input_tokens, r.output_tokens) for r in rows] == [("session_start", 0, 1, 0, 0), ("assistant_message", 30, 2, 4, 5)]
        assert (rows[1].session_id, rows[1].cwd, rows[1].git_branch, rows[1].model) == ("session-a", "/workspace", "main", "m")
        write("2.json", [(40, tokens(5)), (50, message("assistant", "more")), (60, message("user", "thanks"))])
        while len(rows) < 4 and time.time() < until:
            time.sleep(0.5)
            rows = spark.sql("select * from still order by offset").collect()
        assert [(r.type, r.emitted, r.place, r.input_tokens, r.turn_index) for r in rows[2:]] == [("assistant_message", 60, 0, 5, 5), ("user_prompt", 60, 1, 0, 6)]
    finally:
        q.stop()


def test_a_salt_and_a_store_with_timers_are_needed(spark):
    from tracewell.sources.dialects import events_b
    from tracewell.streaming.events import events_b_stream

    lines = spark.createDataFrame([], "path string, offset long, line_no int, line string, kind string")
    with pytest.raises(ValueError, match="salt"):
        events_b(lines, b"short")
    with pytest.raises(ValueError, match="RocksDB"):
        events_b_stream(lines, SALT)
