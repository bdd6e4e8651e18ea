"""A session with the settings that this package expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; ``conf`` has further settings, dots written as two underscores.

    ANSI mode stays on: divisions that may meet a zero use ``try_divide``.
    """
    builder = SparkSession.builder.appName("barquet")
    if master:
        builder = builder.master(master)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.python.filterPushdown.enabled": "true", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    for k, v in (settings | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
