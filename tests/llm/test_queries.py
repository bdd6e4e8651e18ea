"""Queries against SQL or brute force on the smallest tables."""

import hashlib
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from barquet.llm import queries
from tests.conftest import SMALL


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def texts(spark):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, x in texts(spark).items():
        ids = t.encode(x, add_special_tokens=False).ids
        want[i] = (len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in queries.op8_bpe(spark, SMALL).collect()}
    assert got == want


def test_sharding(spark):
    rows = queries.op10_sharding(spark, SMALL).collect()
    docs = texts(spark)
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {i: (len(x.encode()) + 8, zlib.crc32(x.encode())) for i, x in docs.items()}
    sizes = Counter(r["shard"] for r in rows)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(n))


def test_quality_held_out(spark):
    d = "/root/testdata/sf0.01"
    scored = {r["doc_id"]: r for r in queries.op6_quality(spark, d).collect()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in scored.items())
    labels = [r for r in spark.read.parquet(f"{d}/labels.parquet").collect() if scored[r["doc_id"]]["held_out"]]
    right = sum(scored[r["doc_id"]]["predicted"] == r["quality"] for r in labels)
    assert len(labels) > 100 and right >= 0.95 * len(labels)


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == columns
        docs = docs.cache()
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= before and now
        before = now
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert {r["doc_id"]: r["text"] for r in out.collect()} == kept


def test_pipeline_runs(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and len({r["doc_id"] for r in rows}) == len(rows)


def test_pipeline_cases(spark):
    """Stages take nulls, empty texts, repeated rows, further columns with names that operators use, and empty tables."""
    import corpus_pipeline

    text = " ".join(f"word{i % 37} and{i % 11}" for i in range(300)) + "."
    rows = [(1, text, "en", "s", len(text)), (1, text, "en", "s", len(text)), (2, text + " end", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "some words here, and more.", "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("n_words", "kept_text", "row", "block", "ids", "component_id", "label"):
        docs = docs.selectExpr("*", f"'clash' AS {c}")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).count() == 0
        out = stage(spark, docs, SMALL).collect()
        assert out and all(r["kept_text"] == "clash" for r in out if "kept_text" in r)
    kept = [r["doc_id"] for r in corpus_pipeline.near_duplicate(spark, docs, SMALL).collect()]
    assert sorted(kept, key=str) == [1, 3, 4, None]  # one row of a group, repeated or not
    other = "quite other words " * 40
    rows = [(7, text, "fr", "s", 1), (7, text, "de", "z", 2), (7, other, "en", "s", 3), (8, text + " end", "en", "s", 4), (None, other + "x", "en", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicate(spark, docs, SMALL).collect()
    assert sorted(map(tuple, kept), key=str) == sorted([rows[1], rows[2], rows[4]], key=str)  # unlike texts under one doc_id stay


def test_pipeline_leaks_by_text(spark):
    """Only the texts that hold a window go, not others with their doc_id or, like them, without one."""
    import corpus_pipeline

    leak = max((r["text"] or "" for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()), key=len)
    rows = [(None, leak), (None, "clean a"), (None, "clean b"), (1, f"before {leak} after"), (1, "clean c"), (2, leak), (2, leak), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for c in ("version", "leak_id", "leak_version"):
        docs = docs.selectExpr("*", f"'clash' AS {c}")
    kept = [(r["doc_id"], r["text"]) for r in corpus_pipeline.benchmark_leaks(spark, docs, SMALL).collect()]
    assert sorted(kept, key=str) == [(1, "clean c"), (3, None), (None, "clean a"), (None, "clean b")]
