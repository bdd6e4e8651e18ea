"""Sliding-window rate limit: at most so many admitted requests in any window; refused ones don't count."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from barquet.operators.scan import ordered_scan

RESULT = T.StructType([T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("success", T.BooleanType()), T.StructField("remaining", T.IntegerType()), T.StructField("reset", T.LongType())])


class Limiter:
    """State: the times of the admitted requests in the window, ``most`` at most."""

    def __init__(self, most: int, window_ms: int, admitted: list[int] | None = None):
        self.most, self.window, self.admitted = most, window_ms, deque(admitted or ())

    def ask(self, now: int) -> tuple[bool, int, int]:
        """Whether the request is admitted, how many more would be, and when the window is free again."""
        while self.admitted and self.admitted[0] <= now - self.window:
            self.admitted.popleft()
        if len(self.admitted) < self.most:
            self.admitted.append(now)
            return True, self.most - len(self.admitted), now + self.window
        return False, 0, self.admitted[0] + self.window

    def step(self, row):
        yield (row["ts"], row["seq"], *self.ask(row["ts"]))

    def finish(self):
        return ()


def limit(requests: DataFrame, most: int, window_ms: int) -> DataFrame:
    """Requests (key, ts in ms, seq) with success, remaining and reset, in order of time and seq by key."""
    return ordered_scan(requests, ["key"], ["ts", "seq"], ["ts", "seq"], lambda *_: Limiter(most, window_ms), RESULT)
