"""Paged reads, periodic jobs and bucketed upserts: overlaps, deadlines, stops, restarts, crashes between files and manifest."""

import json
import time
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException

from barquet.sources import pages
from barquet.streaming import buckets, jobs, periodic

BARS = [("A", "1h", i, 1.0 + i, 2.0 + i, 0.5 + i, 1.5 + i, 9.0) for i in range(0, 2500, 10)] + [("B", "1h", 5, 1.0, 1.0, 1.0, 1.0, 1.0)]


def listed(rows, calls=None):
    """An endpoint over a list that answers a bar too early, as overlapping pages do, with another close."""

    def fetch(symbol, interval, first, last, most):
        if calls is not None:
            calls.append(first)
        own = [r[2:] for r in rows if r[:2] == (symbol, interval) and r[2] <= last]
        at = next((i for i, r in enumerate(own) if r[0] >= first), len(own))
        early = [(*own[at - 1][:4], -1.0, 0.0)] if at else []
        return (early + own[at:])[:most]

    return fetch


def test_pages():
    calls = []
    got = list(pages.walked(listed(BARS, calls), "A", "1h", 100, 2000, page=50))
    assert got == [r for r in BARS if r[0] == "A" and 100 <= r[2] <= 2000] and len(calls) == 4
    assert list(pages.walked(listed(BARS), "C", "1h", 0, 10**9)) == []
    ticks = iter(range(100))
    part = list(pages.walked(listed(BARS), "A", "1h", 0, 2490, page=50, deadline=2.0, clock=lambda: float(next(ticks))))
    assert 0 < len(part) < 250 and part == [r for r in BARS if r[0] == "A"][: len(part)]
    rest = list(pages.walked(listed(BARS), "A", "1h", part[-1][2] + 1, 2490, page=50))
    assert part + rest == [r for r in BARS if r[0] == "A"]


def test_paged_source(spark):
    df = pages.read(spark, listed(BARS), [("A", "1h"), ("B", "1h"), ("C", "1h")], 0, 2490, page=7, span=300)
    assert df.rdd.getNumPartitions() == 27
    assert sorted(map(tuple, df.collect())) == sorted(BARS)
    try:
        some = pages.read(spark, listed(BARS), [("A", "1h"), ("B", "1h")], 0, 2490, page=7).where("symbol = 'A' and ts >= 500 and ts < 600 and close > 510")
        assert some.rdd.getNumPartitions() == 1
        assert sorted(map(tuple, some.collect())) == [r for r in BARS if r[0] == "A" and 500 <= r[2] < 600 and r[6] > 510]
        assert pages.read(spark, listed(BARS), [("A", "1h")], 0, 2490).where("symbol = 'Z'").count() == 0
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "false")
        assert pages.read(spark, listed(BARS), [("A", "1h")], 0, 2490).where("ts < 100").count() == 10
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def test_paged_stream_goes_on(spark, tmp_path):
    folder = str(tmp_path / "candles")
    columns = pages.SCHEMA
    spark.createDataFrame(BARS[:100] + BARS[-1:], columns).write.parquet(folder)
    at = pages.FolderPages(folder)
    stream = lambda: pages.read_stream(spark, at, at.newest, [("A", "1h"), ("B", "1h")], 20, page=30)
    jobs.run_available(stream(), str(tmp_path / "out"))
    rows = lambda: sorted(map(tuple, spark.read.parquet(str(tmp_path / "out/rows")).collect()))
    assert rows() == sorted(r for r in BARS[:100] if r[2] >= 20)
    spark.createDataFrame(BARS[100:250], columns).write.mode("append").parquet(folder)
    jobs.run_available(stream(), str(tmp_path / "out"))
    jobs.run_available(stream(), str(tmp_path / "out"))
    assert rows() == sorted(r for r in BARS[:250] if r[2] >= 20)


def set_clock(file, to):
    """In one step, as streams read it at any time."""
    new = file.with_suffix(".new")
    new.write_text(str(to))
    new.replace(file)


def test_periodic_jobs(spark, tmp_path):
    """Five jobs on a fast clock, stopped and started: every due time runs once, also those of the pause; one job fails at first."""
    clock_file, ran = tmp_path / "clock", {}
    set_clock(clock_file, 1000)
    path = str(clock_file)

    def clock():
        return int(Path(path).read_text())

    def job(name, period, catch_up=True, fails=0):
        left = [fails]

        def run(_, due):
            if left[0]:
                left[0] -= 1
                raise RuntimeError("not yet")
            ran.setdefault(name, []).append(due)

        return periodic.Job(name, period, run, catch_up)

    made = [job("a", 100), job("b", 250), job("c", 500), job("latest", 100, catch_up=False), job("fails", 500, fails=1)]

    def until(times, done):
        steps, last = iter(times), time.monotonic() + 120

        def reached():
            t = next(steps, None)
            if t is not None:
                time.sleep(1.5)
                set_clock(clock_file, t)
                return False
            return done() or time.monotonic() > last

        return reached

    whole = lambda period, to: [t for t in range(0, to + 1, period) if t > 1000]
    caught = lambda to: all(ran.get(n) == whole(p, to) for n, p in (("a", 100), ("b", 250), ("c", 500), ("fails", 500)))
    restarts = periodic.run_all(spark, made, str(tmp_path / "jobs"), until([1000, 1310, 1760], lambda: caught(1760)), clock, "200 milliseconds", wait=0.2)
    assert caught(1760), ran
    assert restarts == {"a": 0, "b": 0, "c": 0, "latest": 0, "fails": 1}
    set_clock(clock_file, 2900)  # a pause
    periodic.run_all(spark, made, str(tmp_path / "jobs"), until([3050], lambda: caught(3050)), clock, "200 milliseconds", wait=0.2)
    assert caught(3050), ran
    assert ran["latest"] == sorted(set(ran["latest"])) and ran["latest"][-1] == 3000 and 2000 not in ran["latest"]


def test_job_that_never_works(spark, tmp_path):
    set_clock(tmp_path / "clock", 0)
    path = str(tmp_path / "clock")

    def run(*_):
        raise RuntimeError("never")

    begun = time.monotonic()

    def until():
        set_clock(Path(path), int((time.monotonic() - begun) * 100))
        return time.monotonic() - begun > 60

    with pytest.raises(StreamingQueryException):
        periodic.run_all(spark, [periodic.Job("x", 100, run)], str(tmp_path / "jobs"), until, lambda: int(Path(path).read_text()), "200 milliseconds", wait=0.1, most=0)


def table(spark, path):
    return sorted((tuple(r) for r in buckets.read_buckets(spark, path, "k long, v string, seq long").collect()), key=lambda r: (r[0] is not None, r[0] or 0))


def test_buckets(spark, tmp_path):
    path = str(tmp_path / "t")
    assert table(spark, path) == []
    df = lambda rows: spark.createDataFrame(rows, "k long, v string, seq long")
    put = buckets.upsert_buckets(path, ["k"], 8, "seq")
    put(df([(i, "old", 0) for i in range(200)] + [(3, "late", 2), (3, "early", 1)]), 0)
    want = {i: (i, "old", 0) for i in range(200)} | {3: (3, "late", 2)}
    assert table(spark, path) == sorted(want.values())
    put(df([(5, "new", 1), (5, "newer", 2), (None, "null", 1)]), 1)
    written = {p.parent.name for p in Path(path).glob("v=1/*/*.parquet")}
    assert len(written) <= 2
    want |= {5: (5, "newer", 2)}
    everything = [tuple(r) for r in buckets.read_buckets(spark, path, "k long, v string, seq long").collect()]
    assert sorted(everything, key=str) == sorted([*want.values(), (None, "null", 1)], key=str)
    put(df([(5, "new", 1), (5, "newer", 2), (None, "null", 1)]), 1)  # repeated after a restart
    assert len(table(spark, path)) == 201

    def crash(_):
        raise OSError("lost")

    with pytest.raises(OSError):
        buckets.upsert_buckets(path, ["k"], 8, "seq", crash)(df([(7, "torn", 3)]), 2)
    assert len(table(spark, path)) == 201 and (7, "torn", 3) not in table(spark, path)
    put(df([(7, "whole", 3)]), 2)
    put(df([]), 3)
    assert (7, "whole", 3) in table(spark, path) and len(table(spark, path)) == 201
    manifests = sorted(int(p.name) for p in Path(path, "manifests").iterdir() if p.name.isdigit())
    named = {f for m in manifests for f in json.loads(Path(path, "manifests", str(m)).read_text()).values()}
    assert manifests == [2, 3] and {str(p.relative_to(path)) for p in Path(path).glob("v=*/_bucket=*")} == named
