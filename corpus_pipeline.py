"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark leaks, token ids.

Each stage takes all that its predecessor kept, as rows with the columns of documents; ``run``
writes every stage's rows to the folder that the cluster shares and reads them again, so that a
lost executor costs at most one stage. A stage's rows are deleted once the next one's are written.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import bpe
from barquet.llm.common import delete, durable, shared_folder, table
from barquet.llm.decontaminate import contamination
from barquet.llm.jaccard import in_slots, near_duplicates, slots
from barquet.llm.quality import fit, keep_good
from barquet.llm.substrings import drop_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, doesn't reject.

    Null and empty texts are scored like any other; an empty table or one without labels keeps all.
    """
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, fit(docs, labels))


def near_duplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, 0.8): that with the smallest doc_id, null last.

    Groups are made by links between texts alone; unlike texts under one doc_id stay, and of a group's texts under its smallest doc_id the one
    with the smallest hash. Texts without words have no group and stay. Of rows that repeat both doc_id and text the one stays whose
    other columns come first.
    """
    found = durable(near_duplicates(docs, words=5, percent=80, by_doc_id=False).where("part is not null").select("part", F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version").alias("row")))
    best = durable(found.groupBy("part").agg(F.min("row").alias("best"), F.count("*").alias("n")).where("n > 1").drop("n"))
    named = lambda df: df.select(F.col("row.doc_id").alias("other_id"), F.col("row.version").alias("other_version"))
    in_groups = found.join(best, "part")
    others = named(in_groups.where(~F.col("row").eqNullSafe(F.col("best")))).distinct()
    repeated = durable(named(in_groups.where(F.col("row").eqNullSafe(F.col("best"))).groupBy("row").count().where("count > 1")))

    version = F.xxhash64(docs.text.cast("string"))

    def same(df: DataFrame):
        return docs.doc_id.eqNullSafe(df.other_id) & (version == df.other_version)

    # Texts whose class of hashes none of the others has stay where they are; only the rest is shuffled.
    others = durable(others)
    classes, asked = slots(others, "other_version"), in_slots("xxhash64(cast(text as string))")
    kept = docs.join(classes, asked, "left_semi").join(others, same(others), "left_anti").select(docs.columns)
    kept = docs.join(classes, asked, "left_anti").select(docs.columns).unionByName(kept)
    if repeated.isEmpty():
        return kept
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    once = docs.join(repeated, same(repeated), "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0), *rest)).alias("row"))
    once = once.select("doc_id", "text", *[F.col("row")[c].alias(c) for c in rest])
    return kept.join(repeated, same(repeated), "left_anti").select(docs.columns).unionByName(once.select(docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 40 words or more that stand earlier in the corpus; texts without such passages stay as they are.

    Every row stays; where a text loses words, the others are joined by one space and n_chars follows.
    """
    rest = [c for c in docs.columns if c != "text"]
    kept = drop_repeats(docs.select("doc_id", "text", F.struct(*rest).alias("row")), window=40)  # the row's names can't clash
    lost = F.col("n_removed") > 0
    new = {c: F.col("row")[c] for c in rest} | {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in new:
        new["n_chars"] = F.when(lost, F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(new["n_chars"])
    return kept.select(*[new[c].alias(c) for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item; an item of fewer words is one window.

    Texts that share a doc_id, or have none, are judged each on its own.
    """
    found = contamination(docs, table(spark, sf_dir, "benchmark"), window=10).where("contaminated")
    leaks = found.select(F.col("doc_id").alias("leak_id"), F.col("version").alias("leak_version"))  # one row a text
    same = docs.doc_id.eqNullSafe(leaks.leak_id) & (F.xxhash64(docs.text.cast("string")) == leaks.leak_version)
    return docs.join(leaks, same, "left_anti").select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the text that the ids stand for, of every document."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"), texts=True)
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicate),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: A fitted model and a tokenizer are among the stages: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, of all documents."""
    folder, docs = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}", table(spark, sf_dir, "documents")
    last = None
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
