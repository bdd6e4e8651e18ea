"""Jobs that run at whole multiples of a period, as concurrent streams of due times, each with its own checkpoint.

A stream's source is the clock: its offset is the last period that has begun. After a pause the offsets between
are still due, so what was missed is caught up, or only the last of it. A finished run leaves a mark, so that a batch
that is repeated after a crash doesn't run it again.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import StreamingQueryException
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.query import StreamingQuery

from barquet.streaming.jobs import _file

MINUTE = 60_000
#: How often each job is due, in ms; offsets are whole multiples since 1970 in UTC.
PERIODS = {
    "check_alerts": 5 * MINUTE, "sync_candles": 15 * MINUTE, "sync_candles_1m": MINUTE, "sync_candles_5m": 5 * MINUTE, "signals_scalping": MINUTE, "signals_day_trading": 5 * MINUTE, "signals_swing_trading": 15 * MINUTE,
    "signals_position_trading": 60 * MINUTE, "signals_by_user": 10 * MINUTE, "snapshots_1h": 15 * MINUTE, "snapshots_4h": 240 * MINUTE, "snapshots_1d": 1440 * MINUTE, "snapshot_portfolios": 1440 * MINUTE,
}


@dataclass(frozen=True)
class Job:
    """``run`` gets the session and the time, in ms, that is due. It should do no harm if run twice for a time: a crash may fall between its end and its mark."""

    name: str
    period_ms: int
    run: Callable[[SparkSession, int], None]
    catch_up: bool = True


def now_ms() -> int:
    return int(time.time() * 1000)


@dataclass
class _Slots(InputPartition):
    first: int
    end: int


class _Due(DataSourceStreamReader):
    def __init__(self, period: int, clock: Callable[[], int]):
        self.period, self.clock = period, clock

    def initialOffset(self):
        return {"slot": self.clock() // self.period}

    def latestOffset(self):
        return {"slot": self.clock() // self.period}

    def partitions(self, start, end):
        return [_Slots(start["slot"] + 1, end["slot"] + 1)]

    def read(self, partition):
        return ((slot * self.period,) for slot in range(partition.first, partition.end))

    def commit(self, end):
        pass


def _source(clock: Callable[[], int]) -> type[DataSource]:
    class DueTimes(DataSource):
        @classmethod
        def name(cls):
            return "due_times"

        def schema(self):
            return "due long"

        def streamReader(self, schema):
            return _Due(int(self.options["period_ms"]), clock)

    return DueTimes


def start(spark: SparkSession, job: Job, folder: str, clock: Callable[[], int] = now_ms, poll: str = "1 second") -> StreamingQuery:
    """Starts a job's stream. Its first due time is the next after the first start; later starts go on where the last run ended."""
    spark.dataSource.register(_source(clock))

    def run(batch, _: int) -> None:
        due = sorted(r["due"] for r in batch.collect())  # times since the last run, not data
        for at in due if job.catch_up else due[-1:]:
            files, mark = _file(batch.sparkSession, f"{folder}/{job.name}/runs/{at}")
            if not files.exists(mark):
                job.run(batch.sparkSession, at)
                files.mkdirs(mark.getParent())
                files.createNewFile(mark)

    due = spark.readStream.format("due_times").option("period_ms", job.period_ms).load()
    return due.writeStream.queryName(job.name).option("checkpointLocation", f"{folder}/{job.name}/checkpoint").trigger(processingTime=poll).foreachBatch(run).start()


def run_all(spark: SparkSession, jobs: list[Job], folder: str, until: Callable[[], bool], clock: Callable[[], int] = now_ms, poll: str = "1 second", wait: float = 3.0, most: int = 5) -> dict[str, int]:
    """Runs all jobs side by side until ``until()``; one that fails is started anew, alone, up to ``most`` times in a row, each after twice the wait.

    Returns how often each was started anew. The error of a job that is given up is raised when the others have stopped.
    """
    running, failures, restarts, lost = {j.name: start(spark, j, folder, clock, poll) for j in jobs}, {}, {j.name: 0 for j in jobs}, None
    by_name, again = {j.name: j for j in jobs}, {}
    try:
        while not until() and lost is None:
            if running:
                spark.streams.resetTerminated()
                with contextlib.suppress(StreamingQueryException):  # which of them it was is seen below
                    spark.streams.awaitAnyTermination(1)
            else:
                time.sleep(0.2)
            for name, q in list(running.items()):
                if not q.isActive:
                    failures[name] = 1 if q.recentProgress else failures.get(name, 0) + 1
                    if failures[name] > most:
                        lost = q.exception()
                    again[name] = time.monotonic() + wait * 2 ** (failures[name] - 1)
                    del running[name]
            for name in [n for n, at in again.items() if time.monotonic() >= at]:
                del again[name]
                running[name] = start(spark, by_name[name], folder, clock, poll)
                restarts[name] += 1
    finally:
        for q in running.values():
            q.stop()
    if lost is not None:
        raise lost
    return restarts
