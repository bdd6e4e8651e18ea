"""Candles from an endpoint that answers in pages, as a data source for batch and stream reads.

Each series and span of time is a partition. A task asks page after page, each from the last time and a millisecond more on; an
empty or short page is the end, a deadline ends early. Filters on symbol, interval and time become part of the request.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

#: Rows of a page, and seconds after which a range is left as far as it came.
PAGE, DEADLINE = 1000, 120.0
SCHEMA = "symbol string, interval string, ts long, open double, high double, low double, close double, volume double"
#: (symbol, interval, first ms, last ms, most rows) to rows of ts, open, high, low, close, volume in the order of ts.
Fetch = Callable[[str, str, int, int, int], list[tuple]]


@dataclass
class _Span(InputPartition):
    symbol: str
    interval: str
    start: int
    end: int


def walked(fetch: Fetch, symbol: str, interval: str, start: int, end: int, page: int = PAGE, deadline: float = DEADLINE, pause: float = 0.0, clock: Callable[[], float] = time.monotonic) -> Iterator[tuple]:
    """Rows of the closed range, page by page. Rows before the cursor came already: of a time the first row is kept."""
    cursor, until = start, clock() + deadline
    while cursor <= end and clock() <= until:
        rows = fetch(symbol, interval, cursor, end, page)
        for row in rows:
            if row[0] >= cursor:
                cursor = row[0] + 1
                yield (symbol, interval, *row)
        if len(rows) < page:
            return
        if pause:
            time.sleep(pause)


class _Options:
    def __init__(self, fetch: Fetch, options):
        self.fetch, self.series = fetch, [tuple(x) for x in json.loads(options["series"])]
        self.start, self.end = int(options["start"]), int(options["end"]) if "end" in options else None
        self.page, self.deadline, self.pause = int(options.get("page", PAGE)), float(options.get("deadline", DEADLINE)), float(options.get("pause", 0.0))
        self.span = int(options["span"]) if "span" in options else None

    def spans(self, symbol: str, interval: str, start: int, end: int) -> list[_Span]:
        step = self.span or max(1, end - start + 1)
        return [_Span(symbol, interval, a, min(a + step - 1, end)) for a in range(start, end + 1, step)]

    def read(self, partition: _Span) -> Iterator[tuple]:
        return walked(self.fetch, partition.symbol, partition.interval, partition.start, partition.end, self.page, self.deadline, self.pause)


class _Reader(DataSourceReader):
    def __init__(self, o: _Options):
        self.o = o

    def partitions(self):
        return [p for s, i in self.o.series for p in self.o.spans(s, i, self.o.start, self.o.end)] or [_Span("", "", 1, 0)]

    def read(self, partition):
        return self.o.read(partition)


class _FilteredReader(_Reader):
    """For sessions in which Python data sources are given filters; others refuse a reader that takes some."""

    def pushFilters(self, filters):
        """Takes what bounds the time or names a series; hands back the rest."""
        for f in filters:
            name = getattr(f, "attribute", None)
            if name == ("ts",) and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo):
                self.o.start = max(self.o.start, f.value + isinstance(f, GreaterThan))
            if name == ("ts",) and isinstance(f, LessThanOrEqual | LessThan | EqualTo):
                self.o.end = min(self.o.end, f.value - isinstance(f, LessThan))
            if name in (("symbol",), ("interval",)) and isinstance(f, EqualTo):
                self.o.series = [x for x in self.o.series if x[name == ("interval",)] == f.value]
            elif not (name == ("ts",) and isinstance(f, GreaterThanOrEqual | GreaterThan | EqualTo | LessThanOrEqual | LessThan)):
                yield f


class _Stream(DataSourceStreamReader):
    """The offset has, for each series, the time from which it goes on: the last one and a millisecond."""

    def __init__(self, o: _Options, newest: Callable[[str, str], int | None]):
        self.o, self.newest = o, newest

    def initialOffset(self):
        return {json.dumps(s): self.o.start for s in self.o.series}

    def latestOffset(self):
        found = {json.dumps(s): self.newest(*s) for s in self.o.series}
        return {k: max(self.o.start, v + 1) if v is not None else self.o.start for k, v in found.items()}

    def partitions(self, start, end):
        return [p for k, to in end.items() for p in self.o.spans(*json.loads(k), start.get(k, self.o.start), to - 1)]

    def read(self, partition):
        return self.o.read(partition)

    def commit(self, end):
        pass


def source(fetch: Fetch, newest: Callable[[str, str], int | None] | None = None) -> type[DataSource]:
    """The data source ``paged_klines`` over an endpoint; ``newest`` gives the last closed bar's time of a series, which streams need.

    Options: series (JSON of pairs of symbol and interval), start and end (ms, inclusive; streams have no end), page, deadline and pause
    (seconds), span (ms of a partition; a series is one by default), filters (whether the session gives sources filters).
    """

    class PagedKlines(DataSource):
        @classmethod
        def name(cls):
            return "paged_klines"

        def schema(self):
            return SCHEMA

        def reader(self, schema):
            kind = _FilteredReader if str(self.options.get("filters", False)).lower() == "true" else _Reader
            return kind(_Options(fetch, self.options))

        def streamReader(self, schema):
            return _Stream(_Options(fetch, self.options), newest)

    return PagedKlines


def read(spark: SparkSession, fetch: Fetch, series: list[tuple[str, str]], start: int, end: int, **options) -> DataFrame:
    """Candles of a closed range of time; with ``spark.sql.python.filterPushdown.enabled`` filters narrow what is asked for."""
    spark.dataSource.register(source(fetch))
    filters = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("paged_klines").options(series=json.dumps(series), start=start, end=end, filters=filters, **options).load()


def read_stream(spark: SparkSession, fetch: Fetch, newest: Callable[[str, str], int | None], series: list[tuple[str, str]], start: int, **options) -> DataFrame:
    """New candles of each series as they close, from ``start`` on; after a stop it goes on from its checkpoint."""
    spark.dataSource.register(source(fetch, newest))
    return spark.readStream.format("paged_klines").options(series=json.dumps(series), start=start, **options).load()


class FolderPages:
    """Pages of candles that lie as Parquet in a folder that all tasks reach: an endpoint without a network."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").removeprefix("file:")

    def _rows(self, symbol: str, interval: str, first: int, last: int):
        import pyarrow.dataset as ds

        at = ds.field("ts")
        return ds.dataset(self.path).to_table(filter=(ds.field("symbol") == symbol) & (ds.field("interval") == interval) & (at >= first) & (at <= last)).sort_by("ts")

    def __call__(self, symbol: str, interval: str, first: int, last: int, most: int) -> list[tuple]:
        rows = self._rows(symbol, interval, first, last).slice(0, most).to_pylist()
        return [tuple(r[c] for c in ("ts", "open", "high", "low", "close", "volume")) for r in rows]

    def newest(self, symbol: str, interval: str) -> int | None:
        ts = self._rows(symbol, interval, 0, 1 << 62)["ts"]
        return ts[-1].as_py() if len(ts) else None
