"""The capture source on real gzip files: members, torn tails, growth between runs, many members."""

import gzip
import io
import os
import time

import pytest

from skyledger.sources import bronze, captures
from skyledger.streaming import streams


def member(*lines, level=6):
    return gzip.compress("".join(x + "\n" for x in lines).encode(), level)


def put(root, name, content):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content)


def read(spark, root, **options):
    spark.dataSource.register(captures.Captures)
    rows = spark.read.format("captures").options(**options).load(str(root)).collect()
    return sorted((os.path.basename(r["path"]), r["member"], r["torn"], r["line"] or "") for r in rows)


def test_members_and_torn_tails(spark, tmp_path):
    put(tmp_path, "dt=2024-01-01/polls/a.jsonl.gz", member("one", "two") + member("three") + member())
    put(tmp_path, "dt=2024-01-01/polls/b.jsonl.gz", member("one") + member("two", "three", level=0)[:-12])
    put(tmp_path, "dt=2024-01-02/polls/c.jsonl.gz", b"")
    put(tmp_path, "dt=2024-01-02/polls/d.jsonl.gz", member("one") + b"no gzip")
    put(tmp_path, "dt=2024-01-02/polls/note.txt", b"no capture")
    want = [("a.jsonl.gz", 0, False, "one"), ("a.jsonl.gz", 0, False, "two"), ("a.jsonl.gz", 1, False, "three"), ("b.jsonl.gz", 0, False, "one"), ("b.jsonl.gz", 1, False, "two"), ("b.jsonl.gz", 1, True, ""), ("c.jsonl.gz", 0, False, ""), ("d.jsonl.gz", 0, False, "one"), ("d.jsonl.gz", 1, True, "")]
    assert read(spark, tmp_path) == want == read(spark, tmp_path, partitionBytes="1")
    whole = bronze.gzip_lines(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.gz").load(str(tmp_path)))
    assert sorted((os.path.basename(r["path"]), r["members"], r["torn"], r["line"] or "") for r in whole.collect()) == [("a.jsonl.gz", 3, False, "one"), ("a.jsonl.gz", 3, False, "three"), ("a.jsonl.gz", 3, False, "two"), ("b.jsonl.gz", 1, True, "one"), ("b.jsonl.gz", 1, True, "two"), ("d.jsonl.gz", 1, True, "one")]  # Spark passes over empty files
    assert read(spark, tmp_path / "nothing") == []


@pytest.mark.parametrize("level", [0, 6])
def test_a_file_read_in_any_two_parts_is_the_file(level):
    members = [member(*[f"line {i} {k}" * (1 + 40 * (k % 3 == 0)) for k in range(i % 4)], level=level) for i in range(12)]
    content = b"".join(members)
    ends = [sum(map(len, members[:k])) for k in range(len(members) + 1)]
    whole = [x for _, _, lines in captures.lines_of(io.BytesIO(content)) for x in lines]
    for cut in range(0, len(content) + 1, 7):
        file = io.BytesIO(content)
        start = captures.member_end(file, cut)
        assert start == max(e for e in ends if e <= cut)
        first = [x for _, _, lines in captures.lines_of(io.BytesIO(content[:cut])) for x in lines]
        rest = [x for _, _, lines in captures.lines_of(captures.Window(file, start, len(content)), None, cut - start) for x in lines]
        assert first + rest == whole


def test_stream_goes_on_where_files_grew(spark, tmp_path):
    spark.dataSource.register(captures.Captures)
    root, out, checkpoint = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "checkpoint")
    a, b, c = member("a1", "a2"), member("b1", "b2", "b3", level=0), member("c1")
    steps = [{"1/x": a}, {"1/x": a + b[:25]}, {"1/x": a + b + c, "1/y": a}, {}, {"2/x": a}, {"2/x": a + b, "3/x": c, "4/x": c}, {"4/x": c + a}]
    want = []
    for step in steps:
        for name, content in step.items():
            put(root, f"dt=2024-01-0{name}.gz", content)
        root.mkdir(exist_ok=True)
        streams.to_table(spark.readStream.format("captures").load(str(root)), out, checkpoint)
    for name, lines in {"1/x": ["a1", "a2", "b1", "b2", "b3", "c1"], "1/y": ["a1", "a2"], "2/x": ["a1", "a2", "b1", "b2", "b3"], "3/x": ["c1"], "4/x": ["c1", "a1", "a2"]}.items():
        want += [(f"dt=2024-01-0{name}.gz", x) for x in lines]
    got = [(r["path"].split("/in/")[1], r["line"]) for r in spark.read.parquet(out).where("line is not null").collect()]
    assert sorted(got) == sorted(want)


def test_many_members_take_linear_time():
    def seconds(n):
        content = b"".join(member(f"line {i}") for i in range(n))
        began = time.perf_counter()
        assert sum(len(lines) for _, _, lines in captures.lines_of(io.BytesIO(content))) == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(20_000) < 12 * max(seconds(5_000), 0.02)


def test_spans_are_packed():
    parts = captures.packed([("a", 0, 10), ("b", 0, 100), ("c", 5, 10), ("d", 0, 60)], 100)
    assert [sum(e - b for _, b, e in p.spans) for p in parts] == [100, 75] and sum(len(p.spans) for p in parts) == 4


def test_plain_layout_keeps_what_a_torn_file_holds(spark, tmp_path):
    lines = ['{"ts_utc": "2024-01-01T00:00:0%dZ", "endpoint": "/x", "http_status": 200, "latency_ms": 1, "payload": {"ticker": "T%d", "ok": true, "event_id": %d}}' % (i, i, i) for i in range(4)]
    put(tmp_path, "2024-01-01/polls/a.jsonl.gz", member(*lines[:2]) + member("no json", *lines[2:], level=0)[:-12])
    put(tmp_path, "2024-01-01/trades/a.jsonl.gz", member(lines[3]))
    rows = bronze.read_envelopes(spark, str(tmp_path), "polls", layout="plain")
    assert sorted(r["event_id"] for r in rows.select("payload.event_id").collect()) == [0, 1, 2]
    assert {r["file"].rsplit("/", 1)[1] for r in rows.collect()} == {"a.jsonl.gz"}
