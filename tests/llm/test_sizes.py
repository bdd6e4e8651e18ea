"""What operators hold in memory or send, and that nothing is lost by it."""

from __future__ import annotations

import os
import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from barquet.llm import jaccard, substrings
from barquet.llm.blocks import Block
from barquet.llm.common import Scratch, durable, word_hashes
from tests.llm.test_cases import classes


def test_a_block_of_repeats_is_small():
    """Two workers share what the JVM leaves of an executor: a block of default size may need so much at most."""
    rng, size, texts = random.Random(1), 0, []
    while size < substrings.BLOCK_BYTES:
        texts.append(" ".join(f"w{rng.randrange(60_000)}" for _ in range(300)))
        size += len(texts[-1])
    rows = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "tie": pa.array([0] * len(texts), pa.int32()), "text": texts})
    del texts
    tracemalloc.start()
    block = Block(rows, substrings._split)
    found = substrings._anchor_keys(block, 20, 45)
    substrings._windows(block, 40, np.full(len(found[1]), 2, np.uint8), found)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert peak < 110


def test_sizes_that_may_link_share_a_cell(spark):
    for percent in (50, 80, 90, 100):
        sizes = spark.range(1, 400).select(F.lit(7).cast("long").alias("box"), F.col("id").cast("int").alias("size"))
        cells = sizes.select("size", F.explode(jaccard._cells("box", "size", percent)).alias("cell")).collect()
        of = {}
        for size, cell in cells:
            of.setdefault(size, set()).add(cell)
        assert all(of[a] & of[b] for b in of for a in of if a <= b and 100 * a >= percent * b)
        assert not of[1] & of[399]


def test_unlike_texts_with_a_rare_passage_meet_in_few_pairs(spark, monkeypatch):
    """Unlike sizes don't meet at all, and of long unlike texts none is sent: 64 coordinates can't part those, coarse counts can."""
    rng = random.Random(2)
    words = [f"v{i}" for i in range(5000)]
    rows = [(i, " ".join(["rare passage of seven words to share", *rng.choices(words, k=40 * 2 ** (i % 5))])) for i in range(30)]
    rows += [(100 + i, " ".join(["long and rare passage of many words", *rng.choices(words, k=6000)])) for i in range(6)]
    rows += [(200 + i, rows[i][1] + " end") for i in range(3)]
    frames, written = [], Scratch.__call__

    def kept(keep, df, texts=False):
        out = written(keep, df, texts)
        if out.columns == ["id_a", "id_b"]:
            frames.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "__call__", kept)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()}
    assert got == classes(rows, 3, 90)
    assert frames[-1] <= 6 and frames[0] < 100  # pairs whose texts are sent, and all that met


def test_token_ids_take_one_worker_a_task(spark):
    """Idle workers keep their memory, and two Python steps in one task double their number."""
    import corpus_pipeline

    docs = spark.createDataFrame([(i, f"word{i} and <|endoftext|> {'é' * i}") for i in range(40)], "doc_id long, text string").repartition(3)
    found = corpus_pipeline.token_ids(spark, docs, "")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 2 - plan.count("ReusedExchange")  # the split of texts, which both sides of the join read
    rows = {r["doc_id"]: r for r in found.collect()}
    assert all(rows[r["doc_id"]]["text"] == r["text"] and len(rows[r["doc_id"]]["ids"]) == rows[r["doc_id"]]["n_tokens"] for r in docs.collect())


def test_shuffle_files_go_when_a_table_is_durable(spark):
    env = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()

    def shuffled():
        return {f.split("_")[1] for d in env.localDirsString() for _, _, files in os.walk(d) for f in files if f.startswith("shuffle_")}

    before, df = shuffled(), spark.range(1000).repartition(3, "id")
    kept = durable(df.groupBy((F.col("id") % 7).alias("m")).count())
    until = time.time() + 20
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert sorted(r["count"] for r in kept.collect()) == [142, 143, 143, 143, 143, 143, 143]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None


def test_words_are_hashed_without_being_made():
    texts = [b"", b" ", b"a", b" b\x0bc\x1cd ", b"ab ba abba baab", b"q" * 64 + b" " + b"q" * 65 + b" " + b"q" * 300, b"x yz " * 40_000, b" " * 200_000 + b"end", b"\0 \0\0", "é ü ÿ".encode()]
    rng, known = random.Random(3), {}
    texts += [bytes(rng.choices(range(256), k=rng.randrange(3000))) for _ in range(20)]
    for text in texts:
        words, hashes = text.split(), word_hashes(text).tolist()
        assert len(words) == len(hashes)
        assert all(known.setdefault(w, h) == h for w, h in zip(words, hashes, strict=True))
    assert len(set(known.values())) == len(known)
