"""Source spans of JSON values against a plain scanner, canonical JSON, hashes over source bytes, and file names."""

import hashlib
import hmac
import json
import random

import pyarrow as pa
from pyspark.sql import functions as F

from tracewell.functions import rawjson

SALT = b"0123456789abcdef"


def value(rng, depth):
    """A random JSON value with odd spelling."""
    gap = lambda: rng.choice(("", "", " ", "\t", "  "))
    kind = rng.randrange(7 if depth else 4)
    if kind == 0:
        return rng.choice(("1", "-2.50", "1e5", "true", "null", "12345678901234567890"))
    if kind < 4:
        return '"' + "".join(rng.choice(("a", "é", "\\u0041", '\\"', "\\\\", "{", "]", ",", ":", " ", "😀")) for _ in range(rng.randrange(6))) + '"'
    if kind == 4:
        return "[" + gap() + (gap() + "," + gap()).join(value(rng, depth - 1) for _ in range(rng.randrange(4))) + gap() + "]"
    return "{" + gap() + (gap() + "," + gap()).join(f'"{rng.choice(("m", "c", "input", "x"))}"{gap()}:{gap()}{value(rng, depth - 1)}' for _ in range(rng.randrange(5))) + gap() + "}"


def plain(text, path):
    """The spelled value at a path of keys and '[]', by the standard decoder's raw scanner."""
    decode = json.JSONDecoder().raw_decode

    def parts(t):
        """(key, value) spellings of a container."""
        at, out = 1, []
        while True:
            while t[at] in " \t,":
                at += 1
            if t[at] in "]}":
                return out
            key = None
            if t[0] == "{":
                key, end = decode(t, at)
                at = t.index(":", end) + 1
                while t[at] in " \t":
                    at += 1
            _, end = decode(t, at)
            out.append((key, t[at:end]))
            at = end

    if not path:
        return text
    if path[0] == "[]":
        return [plain(x, path[1:]) for _, x in parts(text)] if text[0] == "[" else []
    found = [x for k, x in parts(text) if k == path[0]] if text[0] == "{" else []
    return plain(found[-1], path[1:]) if found else ([] if "[]" in path else None)


def test_spans_of_random_values():
    rng = random.Random(2)
    paths = {"a": ["m"], "b": ["m", "c"], "c": ["m", "[]", "input"], "d": ["m", "c", "[]"], "e": ["x", "x", "x"], "f": ["[]", "m"]}
    named = {k: ".".join(p).replace(".[]", "[]") for k, p in paths.items()}
    for _ in range(60):
        texts = [rng.choice(("", " ")) + value(rng, 5) + rng.choice(("", " ", "\r")) for _ in range(40)]
        mixed = [x for t in texts for x in (t, rng.choice((None, "", '{"broken": "', "}]{", '"\\')))]
        got = rawjson.raw_spans(pa.array(mixed), named).to_pylist()[::2]
        assert got == [{k: plain(t.strip(), p) for k, p in paths.items()} for t in texts]


def test_a_slice_and_an_empty_column():
    column = pa.array(['{"m":1}', '{"m":"é"}', '{"m": [2] }']).slice(1)
    assert rawjson.raw_spans(column, {"m": "m"}).to_pylist() == [{"m": '"é"'}, {"m": "[2]"}]
    assert rawjson.raw_spans(pa.array([], pa.string()), {"m": "m[]"}).to_pylist() == []


def test_hashes_are_over_source_bytes(spark):
    from tracewell.sources.dialects import events
    from tracewell.sources.lines import split_lines

    salted = lambda s: "sha256:" + hmac.new(SALT, s.encode(), hashlib.sha256).hexdigest()
    a = [
        '{"type":"user","message":{"role":"user","content":"A"}}', '{"type":"user","message":{"role":"user","content":"\\u0041"}}', '{"type":"user","message":{"role":"user","content":[{"type":"text","text":"\\u0041"}]}}',
        '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"c","name":"n","input":{ "b" : 1.0, "a":"\\u0041" }}]}}', '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"c","content": [ {"type":"text","text":"x"} ]}]}}',
    ]
    b = [
        '{"type":"response_item","payload":{"type":"function_call","call_id":"d","name":"n","arguments":"{\\"z\\": 1, \\"y\\":2}"}}', '{"type":"response_item","payload":{"type":"function_call","call_id":"e","name":"n","arguments":{"z": 1}}}',
        '{"type":"response_item","payload":{"type":"function_call","call_id":"f","name":"n","arguments":"{broken \\u0041"}}', '{"type":"response_item","payload":{"type":"function_call_output","call_id":"d","output":"\\u0041"}}',
    ]
    lines = split_lines(spark.createDataFrame([("a.jsonl", "\n".join(a) + "\n"), ("b.jsonl", "\n".join(b) + "\n")], "path string, content string"))
    rows = events(lines, SALT).orderBy("path", "emitted", "place").collect()
    assert [r.prompt_hash for r in rows if r.type == "user_prompt"] == [salted('"A"'), salted('"\\u0041"'), salted(json.dumps([salted("A")], separators=(",", ":")))]
    calls = {r.tool_call_id: (r.arguments.hash, r.arguments["keys"], r.arguments.json_type) for r in rows if r.type == "tool_call"}
    assert calls == {"c": (salted('{ "b" : 1.0, "a":"\\u0041" }'), ["a", "b"], "object"), "d": (salted('{"z": 1, "y":2}'), ["y", "z"], "object"), "e": (salted('{"z": 1}'), ["z"], "object"), "f": (salted('"{broken \\u0041"'), None, "string")}
    assert {r.tool_call_id: r.result.hash for r in rows if r.type == "tool_result"} == {"c": salted('[ {"type":"text","text":"x"} ]'), "d": salted('"\\u0041"')}


def test_canonical_json(spark):
    cases = {
        '{"b":{"z":1,"a":[{"y":2,"x":null}]},"a":true}': '{"a":true,"b":{"a":[{"x":null,"y":2}],"z":1}}',
        '"<a href=\\"x\\">&\\u2028\\u2029</a>\\t\\u0001\\b\\f/"': '"\\u003ca href=\\"x\\"\\u003e\\u0026\\u2028\\u2029\\u003c/a\\u003e\\t\\u0001\\b\\f/"',
        "[1.0, 1.50, -0.0, 1e21, 1e20, 1e-7, 0.000001, 123456789012345678901234, 12345678901234567890, 1e-10]": "[1,1.5,-0,1e+21,100000000000000000000,1e-7,0.000001,1.2345678901234569e+23,12345678901234567000,1e-10]",
        '{"é":"\\ud800","a":"😀"}': '{"a":"😀","é":"�"}', "[]": "[]", "{}": "{}", "{broken": None, "NaN": None, "1e999": None,
    }
    rows = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string").select("t", rawjson.canonical_json("t").alias("c")).collect()
    assert {r.t: r.c for r in rows} == cases | {None: None}


def test_facts_keep_canonical_inputs(spark):
    from tracewell.sources.dialects import facts
    from tracewell.sources.lines import split_lines

    a = ['{"type":"assistant","message":{"content":[{"type":"text","text":"hi"},{"type":"tool_use","id":"c","name":"n","input":{"b":1.0,"a":"<"}},{"type":"tool_use","id":"s","name":"n","input":"{\\"b\\":1,\\"a\\":2}"}]}}']
    b = ['{"type":"response_item","payload":{"type":"function_call","call_id":"d","name":"n","arguments":"{\\"z\\": 1, \\"y\\":2}"}}', '{"type":"response_item","payload":{"type":"function_call","call_id":"e","name":"n","arguments":{"z": 1, "y": [2.0]}}}']
    lines = split_lines(spark.createDataFrame([("a.jsonl", "\n".join(a) + "\n"), ("b.jsonl", "\n".join(b) + "\n")], "path string, content string"))
    assert {r.id: r.body for r in facts(lines).where("kind = 'call'").collect()} == {"c": '{"a":"\\u003c","b":1}', "s": '{"b":1,"a":2}', "d": '{"z": 1, "y":2}', "e": '{"y":[2],"z":1}'}


def test_file_names_need_no_python(spark):
    patch = "*** Begin Patch\n*** Update File: src/a.py\n@@\n*** Add File: b c.txt\n*** End Patch"
    cases = [
        ('{"file_path":"a.py","x":{"Path":"b/c.py","y":[{"FILENAME":"d"}]},"name":"no"}', ["a.py", "b/c.py", "d"]), (json.dumps({"input": patch}), ["src/a.py", "b c.txt"]), (json.dumps(json.dumps({"path": "p\"q", "z": "\\"})), ['p"q']),
        (patch, ["src/a.py", "b c.txt"]), ('{"path":["x","y"],"file":[],"filename":7}', ["x", "y"]), (json.dumps({"text": 'say "path": "no"', 'k"path': "no", "file": ""}), [""]), ("", []), (None, []), ("[broken", []), ('{"path":"é\\u0041\\n"}', ["éA\n"]),
        (json.dumps({"file": "f", "text": "x" * 300_000 + '"\\' * 20_000}), ["f"]), (json.dumps({"input": "*** Add File: a\r\n*** Delete File: b\r"}), ["a\r", "b\r"]),
    ]
    df = spark.createDataFrame([(k, b) for k, (b, _) in enumerate(cases)], "k int, b string").select("k", rawjson.file_names(F.col("b")).alias("f"))
    assert {r.k: r.f for r in df.collect()} == {k: want for k, (_, want) in enumerate(cases)}
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_memory_of_a_scan_does_not_grow_with_its_batch():
    import tracemalloc

    import pyarrow as pa

    from tracewell.functions import rawjson

    line = '{"message":{"content":[{"type":"tool_use","input":{"a":"' + "b\\n" * 500 + '"}}]}}'
    column = pa.array([line, None] * 4_000)
    tracemalloc.start()
    found = rawjson.raw_spans(column, {"inputs": "message.content[].input"})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 8_000 and found[7_998].as_py() == {"inputs": ['{"a":"' + "b\\n" * 500 + '"}']} and found[7_999].as_py() == found[1].as_py()
    assert peak < 16 * column.nbytes
