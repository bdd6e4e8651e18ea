"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset, as in tests, a temporary folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith(("local[", "local-cluster[")) and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="barquet-"))
    return sc.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once, so that what follows doesn't compute it again."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
