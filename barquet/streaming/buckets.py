"""A keyed table that a stream updates bucket by bucket.

Rows lie in buckets by a hash of their key. A batch rewrites the buckets that its keys fall in, as new files beside the old ones, and then a
manifest that says which files count. Until the manifest is there the table is what it was; a repeated batch writes the same files anew.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.operators.bars import upsert
from barquet.streaming.jobs import _file


def _manifests(spark: SparkSession, path: str) -> list[int]:
    files, at = _file(spark, f"{path}/manifests")
    return sorted(int(f.getPath().getName()) for f in files.listStatus(at) if f.getPath().getName().isdigit()) if files.exists(at) else []


def _manifest(spark: SparkSession, path: str, version: int) -> dict[str, str]:
    """Folders of buckets, by bucket."""
    files, at = _file(spark, f"{path}/manifests/{version}")
    stream = files.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def read_buckets(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The table as of its last batch, or as of one of the last two; empty before the first."""
    known = _manifests(spark, path)
    folders = sorted(_manifest(spark, path, known[-1] if version is None else version).values()) if known else []
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], schema)


def upsert_buckets(path: str, keys: list[str], buckets: int = 64, seq: str | None = None, before_manifest: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: puts a batch's rows in place of those with the same key, and adds the others.

    Of a batch's rows with one key the last by ``seq`` wins. Only buckets with a key of the batch are read and written. Versions of the last two
    batches stay. ``before_manifest`` is called, in tests, between files and manifest.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            schema = batch.schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")
            bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
            touched = sorted(r[0] for r in batch.select(bucket).distinct().collect())  # at most ``buckets`` numbers
            earlier = [v for v in _manifests(spark, path) if v < batch_id]
            now = _manifest(spark, path, earlier[-1]) if earlier else {}
            folders = [f"{path}/{now[str(b)]}" for b in touched if str(b) in now]
            old = spark.read.schema(batch.schema).parquet(*folders) if folders else batch.limit(0)
            rows = upsert(old, batch, keys, seq).withColumn("_bucket", bucket)
            if touched:
                rows.repartition(len(touched), "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/v={batch_id}")
            if before_manifest:
                before_manifest(batch_id)
            new = now | {str(b): f"v={batch_id}/_bucket={b}" for b in touched}
            files, made = _file(spark, f"{path}/manifests/.{batch_id}")
            out = files.create(made, True)
            out.write(json.dumps(new).encode())
            out.close()
            _, final = _file(spark, f"{path}/manifests/{batch_id}")
            files.delete(final, False)
            files.rename(made, final)
            _tidy(spark, path, batch_id)
        finally:
            batch.unpersist()

    return write


def _tidy(spark: SparkSession, path: str, batch_id: int) -> None:
    """Deletes manifests before the last two, and the folders that only they name."""
    known = [v for v in _manifests(spark, path) if v <= batch_id]
    kept = {f for v in known[-2:] for f in _manifest(spark, path, v).values()}
    for v in known[:-2]:
        files, at = _file(spark, f"{path}/manifests/{v}")
        for f in set(_manifest(spark, path, v).values()) - kept:
            files.delete(_file(spark, f"{path}/{f}")[1], True)
        files.delete(at, False)
