"""Reading line files by byte ranges: cursors, unfinished and oversized lines, cuts anywhere, and what a scan reads."""

import io
import json
import os
import random
import resource

import pytest

from tracewell.sources import lines as L
from tracewell.sources import ranges as R


def plain(data, most):
    """The lines of bytes as one pass gives them."""
    out, at = [], 0
    for line in data.split(b"\n")[:-1]:
        text = line.decode("utf-8", "replace")
        kind = "oversized" if len(line) + 1 > most else "blank" if not text.strip(R.BLANK) else "line"
        out.append((at, len(line), kind, None if kind == "oversized" else line))
        at += len(line) + 1
    return out


def test_any_cut_gives_each_line_once(monkeypatch):
    monkeypatch.setattr(R, "STEP", 7)
    rng = random.Random(1)
    for _ in range(300):
        data = b"\n".join(rng.choice((b"", b" ", b"\xc2\x85", b"ab", b"\xff\xfe{", b"x" * rng.randrange(60))) for _ in range(rng.randrange(9)))
        f, want = io.BufferedReader(io.BytesIO(data), 16), plain(data, 20)
        cuts = sorted({0, len(data), *(rng.randrange(len(data) + 1) for _ in range(rng.randrange(6)))})
        assert [x for a, b in zip(cuts, cuts[1:]) for x in R.lines_in(f, a, b, 20)] == want


def write(path, text, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, mode) as f:
        f.write(text)


def rows(df):
    return sorted((r.path.rsplit("/", 1)[-1], r.offset, r.line_no, r.line, r.kind) for r in df.collect())


def test_resumes_from_saved_cursors(spark, tmp_path):
    a, marks = tmp_path / "in" / "d" / "a.jsonl", str(tmp_path / "marks")
    write(a, '{"n":1}\n{"n":2}\n')
    write(tmp_path / "in" / "other.txt", "{}\n")
    read = lambda: L.scan_lines(spark, str(tmp_path / "in"), cursors=L.load_cursors(spark, marks))

    def take():
        found = read()
        got = rows(found)
        L.save_cursors(L.scan_stats(found), marks, L.load_cursors(spark, marks))
        return got

    assert L.load_cursors(spark, marks).count() == 0
    assert take() == [("a.jsonl", 0, 0, '{"n":1}', "line"), ("a.jsonl", 8, 1, '{"n":2}', "line")]
    assert take() == []
    write(a, '{"n":3}\n{"n"', "a")
    write(tmp_path / "in" / "b.jsonl", "\n  \n{broken\n{}\n")
    assert take() == [("a.jsonl", 16, 0, '{"n":3}', "line"), ("b.jsonl", 0, 0, "", "blank"), ("b.jsonl", 1, 0, "  ", "blank"), ("b.jsonl", 4, 0, "{broken", "line"), ("b.jsonl", 12, 1, "{}", "line")]
    assert {r.path.rsplit("/", 1)[-1]: r.cursor for r in L.load_cursors(spark, marks).collect()} == {"a.jsonl": 24, "b.jsonl": 15}
    write(a, ":4}\n", "a")
    assert take() == [("a.jsonl", 24, 0, '{"n":4}', "line")]
    write(a, '{"n":9}\n')
    assert take() == [("a.jsonl", 0, 0, '{"n":9}', "line")], "a shorter file was written anew"


def test_negative_cursor_is_refused(spark, tmp_path):
    spark.createDataFrame([("p", -1)], "path string, cursor long").write.parquet(str(tmp_path / "version=0"))
    with pytest.raises(Exception, match="negative cursor"):
        L.load_cursors(spark, str(tmp_path)).collect()


def test_oversized_lines(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"a":1}\n"' + "x" * 128 + '"\n{"b":2}\n')
    write(tmp_path / "b.jsonl", '{"a":1}\n' + "x" * 128)
    write(tmp_path / "c.jsonl", "x" * 119 + "\n" + "y" * 120 + "\n")
    found = L.scan_lines(spark, str(tmp_path), most=120)
    got = {r.path.rsplit("/", 1)[-1]: (r.cursor, r.emitted, r.malformed, r.oversized, r.blank) for r in L.scan_stats(found).collect()}
    assert got == {"a.jsonl": (147, 2, 0, 1, 0), "b.jsonl": (8, 1, 0, 0, 0), "c.jsonl": (241, 0, 1, 1, 0)}


def test_cursor_passes_a_last_oversized_line(spark, tmp_path):
    write(tmp_path / "a.jsonl", '{"a":1}\n' + "x" * (17 << 20) + "\n")
    found, seen = L.observed(L.scan_lines(spark, str(tmp_path)))
    assert [(r.cursor, r.oversized) for r in L.scan_stats(found).collect()] == [(9 + (17 << 20), 1)]
    assert seen.get == {"emitted": 1, "malformed": 0, "oversized": 1, "blank": 0}


def test_numbers_over_several_ranges(spark, tmp_path):
    text = "".join(random.Random(k).choice(("\n", " \n", json.dumps({"k": k, "t": "é" * (k % 40)}) + "\n")) for k in range(900))
    write(tmp_path / "a.jsonl", text)
    write(tmp_path / "b.jsonl", "{}\n" * 5)
    one = rows(L.scan_lines(spark, str(tmp_path)))
    assert rows(L.scan_lines(spark, str(tmp_path), range_bytes=100)) == one
    assert [r[2] for r in one if r[0] == "a.jsonl" and r[4] == "line"] == list(range(sum(bool(x.strip()) for x in text.split("\n"))))


def test_only_wanted_files_are_opened(spark, tmp_path):
    for name in "abc":
        write(tmp_path / f"{name}.jsonl", '{"n":"%s"}\n' % name)
    wanted = spark.createDataFrame([(f"file:{tmp_path}/b.jsonl",), (f"file:{tmp_path}/none.jsonl",)], "path string")
    ranges = R.ranges_of(R.files_below(spark, str(tmp_path), "*.jsonl"), wanted=wanted)
    assert [r.path for r in ranges.collect()] == [f"file:{tmp_path}/b.jsonl"]
    os.chmod(tmp_path / "a.jsonl", 0)
    (tmp_path / "c.jsonl").unlink()
    (tmp_path / "c.jsonl").symlink_to(tmp_path / "b.jsonl")
    assert [r[3] for r in rows(L.scan_lines(spark, str(tmp_path), wanted=wanted))] == ['{"n":"b"}']


def test_a_cursor_near_the_end_reads_little_and_memory_stays_bounded(tmp_path):
    path = tmp_path / "big.jsonl"
    with open(path, "wb") as f:
        f.truncate(1 << 30)  # a hole: one line of 1 GiB of zero bytes, never held
        f.seek(1 << 30)
        f.write(b"\n" + b'{"n":1}\n' * 1000)

    class Counted(io.RawIOBase):
        def __init__(self):
            self.f, self.n = open(path, "rb", buffering=0), 0

        readable = seekable = lambda self: True
        seek = lambda self, *a: self.f.seek(*a)

        def readinto(self, b):
            got = self.f.readinto(b)
            self.n += got
            return got

    end = path.stat().st_size
    raw = Counted()
    assert sum(1 for _ in R.lines_in(io.BufferedReader(raw, R.STEP), end - 4000, end)) == 500 and raw.n < 1 << 20
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    kinds = [k for _, _, k, _ in R.lines_in(R.opened(str(path)), 0, end)]
    assert kinds[0] == "oversized" and len(kinds) == 1001
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 50 << 10, "over 50 MB"


def test_tail_in_pieces(spark, tmp_path):
    from tracewell.streaming.tail import TailSource

    spark.dataSource.register(TailSource)
    folder, text = tmp_path / "in", "".join(json.dumps({"k": k, "t": "x" * (k % 30)}) + "\n" for k in range(200))

    def run():
        q = spark.readStream.format("session_tail").option("rangeBytes", "100").load(str(folder)).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).start(str(tmp_path / "out"))
        q.awaitTermination(90)

    for a, b in ((0, 10), (10, 3000), (3000, 3001), (3001, len(text))):
        write(folder / "a.jsonl", text[a:b], "a")
        run()
    got = sorted((r.offset, r.line) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert [x for _, x in got] == text.splitlines() and [a for a, _ in got] == [o for o, *_ in plain(text.encode(), 1 << 20)]
