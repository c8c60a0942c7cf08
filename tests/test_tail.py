"""Tailed files: growth, rotation, truncation, long lines, tasks of any size, and a stream that starts again."""

import os
import random

import pytest

from beamlog.sources import tail


def offset(path):
    return tail.TailReader(str(path)).latestOffset()


def told(start, end):
    return [(line, problem) for p in tail.pieces(start, end) for _, _, line, problem in tail.lines_of(p)]


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 22])
def test_lines_are_told_once_however_ranges_fall(tmp_path, monkeypatch, size):
    monkeypatch.setattr(tail, "RANGE", size)
    rng, path, before, got = random.Random(size), tmp_path / "a.log", {}, []
    wanted = ["".join(rng.choice("abé ") for _ in range(rng.randint(0, 30))) for _ in range(60)]
    raw = "".join(w + rng.choice(["\n", "\r\n"]) for w in wanted).encode()
    at = 0
    while at < len(raw):
        step = rng.randint(1, 90)
        with open(path, "ab") as f:
            f.write(raw[at : at + step])
        at += step
        now = offset(path)
        got += told(before, now)
        before = now
    assert got == [(w, None) for w in wanted]


def test_rotation_truncation_and_long_lines(tmp_path, monkeypatch):
    monkeypatch.setattr(tail, "MAX_LINE", 100)
    monkeypatch.setattr(tail, "RANGE", 50)
    path = tmp_path / "a.log"
    path.write_bytes(b"one\n" + b"x" * 300 + b"\n" + b"y" * 100 + b"\ntwo\nhalf")
    first = offset(path)
    assert told({}, first) == [("one", None), (None, "oversized"), ("y" * 100, None), ("two", None)]
    with open(path, "ab") as f:
        f.write(b" done\nthree\nnever ended")
    os.rename(path, tmp_path / "a.log.1")
    path.write_bytes(b"new\n")
    second = offset(path)
    assert told(first, second) == [("half done", None), ("three", None), (None, "partial"), ("new", None)]
    path.write_bytes(b"z\n")  # the same file, shorter than before
    third = offset(path)
    assert third[str(path)][:2] == second[str(path)][:2] and told(second, third) == [(None, "truncated"), ("z", None)]
    os.rename(path, tmp_path / "keep")
    path.write_bytes(b"again\n")
    fourth = offset(path)
    os.remove(tmp_path / "keep")
    assert told(third, fourth) == [(None, "lost"), ("again", None)]
    assert told(fourth, fourth) == [] and offset(tmp_path / "none.log") == {}
    os.symlink(path, tmp_path / "link.log")
    assert offset(tmp_path / "link.log") == {}


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    spark.dataSource.register(tail.TailSource)
    path = tmp_path / "app.log"
    path.write_bytes(b"a\nb\n")

    def drained(name):
        lines = spark.readStream.format("tail").option("path", str(tmp_path / "*.log")).load()
        query = lines.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out")).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
        return sorted((str(r["line"]), r["offset"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert drained("one") == [("a", 0), ("b", 2)]
    with open(path, "ab") as f:
        f.write(b"c\nd")
    assert drained("two") == [("a", 0), ("b", 2), ("c", 4)]
    os.rename(path, tmp_path / "app.log.1")
    path.write_bytes(b"e\n")
    got = [(r["line"], r["problem"]) for r in (drained("three"), spark.read.parquet(str(tmp_path / "out")).collect())[1]]
    assert sorted(map(str, got)) == sorted(map(str, [("a", None), ("b", None), ("c", None), (None, "partial"), ("e", None)]))
