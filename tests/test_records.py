"""Lookups, rescoring, URLs and client keys."""

from pyspark.sql import functions as F


def test_records(spark):
    from tracewell.functions import hashing
    from tracewell.operators import records as r

    salt = b"0123456789abcdef"
    events = spark.createDataFrame([("s1", "user_prompt"), ("s2", "tool_call"), (None, "x")], "session_id string, type string")
    key = events.where("session_id = 's2'").select(hashing.salted(F.col("session_id"), salt).alias("k")).first().k
    assert r.find_session(events, "s1", salt).count() == 1 and r.find_session(events, key, salt).first().session_id == "s2"
    lines = events.select(r.event_line(["session_id", "type"]).alias("line")).union(spark.createDataFrame([("{bad",), ("{}",)], "line string"))
    assert sorted(map(tuple, r.read_events(lines, "session_id string, type string").collect()), key=repr) == sorted(map(tuple, events.collect()), key=repr)
    tasks = spark.createDataFrame(
        [(["a"] * 20, ["p"], 0, 2, "passed", True, True, 0, 0, 0, 0)],
        "tool_calls array<string>, prompts array<string>, human_turns int, files_touched int, verification string, landed boolean, terminated boolean, corrections int, interruptions int, rework int, acceptances int",
    )
    s = r.rescored(tasks).first()
    assert (s.efficiency, s.autonomy, s.success, s.friction, s.confidence) == (75.0, 100.0, 95.0, 88.9, "high")
    urls = spark.createDataFrame([("https://github.com/o/n/pull/3", "c/1", "/tasks/x"), ("https://other.org/o/n", "c", "p"), ("https://github.com/o", "c", "p"), ("https://github.com/o/n", "", "p")], "u string, c string, p string")
    assert [x.v for x in urls.select(r.corpus_url(F.col("u"), F.col("c"), F.col("p")).alias("v")).collect()] == ["https://github.com/o/n/blob/c%2F1/tasks/x", "", "", ""]
    asked = spark.createDataFrame([({"x-real-ip": " 1.1.1.1 "}, "9:1"), ({"x-forwarded-for": "2.2.2.2, 3.3.3.3"}, "9:1"), ({}, "4.4.4.4:80")], "h map<string,string>, r string")
    assert [x.v for x in asked.select(r.client_key(F.col("h"), F.col("r")).alias("v")).collect()] == ["1.1.1.1", "2.2.2.2", "4.4.4.4"]
