"""Large groups of near copies, pages that are left out by their boxes, and what is left in the checkpoint folder."""

from __future__ import annotations

import os
import random
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from barquet.llm import jaccard
from barquet.llm.common import Scratch, shared_folder
from tests.llm.test_cases import classes


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("page", [1 << 18, 512])
def test_a_third_are_near_copies_with_different_edits(spark, monkeypatch, page):
    monkeypatch.setattr(jaccard, "RUN", 7)
    monkeypatch.setattr(jaccard, "STEP_BITS", 1)
    rng = random.Random(page)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4]))) for i in range(70)]
    # Others hold a passage of the copies among words of their own, or are copies of each other.
    rows += [(100 + i, " ".join(base[:20] + [f"o{rng.randrange(10**9)}" for _ in range(40)])) for i in range(70)]
    rows += [(200 + i, edited(rng, [f"c{i % 20}x{j}" for j in range(40)], rng.choice([0, 1, 2]))) for i in range(70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df, 5, 80, page).collect()}
    assert got == classes(rows, 5, 80)


def test_boxes_leave_pages_out(spark):
    """Three families of unlike points under one box: few pairs of pages are visited, and none that a link needs is left out."""
    rng, families = np.random.default_rng(1), 3
    pages, points, rows = 1 << 10, [], []
    for i in range(240):
        point = np.zeros(jaccard.GROUPS, int)
        point[np.arange(i % families, jaccard.GROUPS, families)] = 5 + rng.integers(0, 2, len(range(i % families, jaccard.GROUPS, families)))
        points.append((i, [int(x) for x in point]))
        rows.append((7, i, int(point.sum()), i, int(point.sum())))
    points = spark.createDataFrame(points, "id long, point array<int>")
    rows = spark.createDataFrame(rows, "box long, id long, size long, part long, weight long")
    keep = Scratch()
    found = jaccard._page_pairs(rows, points, 80, pages, keep).collect()
    n_pages = next(k for k in keep.kept if "part_low" in k.columns).count()
    visits = {(r["page_a"], r["page_b"]) for r in found}
    assert n_pages >= 24 and len(visits) < 0.6 * n_pages * (n_pages + 1) / 2
    at = {r["id"]: r["page"] for r in found}
    linked = [(i, j) for i in range(240) for j in range(i) if i % families == j % families]
    assert len(at) == 240 and all(tuple(sorted((at[i], at[j]))) in {tuple(sorted(v)) for v in visits} for i, j in linked[:2000])
    one_part = jaccard._page_pairs(rows.withColumn("part", F.lit(1).cast("long")), points, 80, pages, keep)
    assert one_part.isEmpty()
    keep.release()


def test_checkpoints_are_deleted(spark):
    folder = urlparse(shared_folder(spark)).path
    before = set(os.listdir(folder))
    rows = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "h i j")], "doc_id long, text string")
    found = jaccard.near_duplicates(rows)
    left = [d for d in os.listdir(folder) if d not in before]
    assert len(left) <= 4 and {r["doc_id"]: r["component_id"] for r in found.collect()} == {1: 1, 2: 1, 3: 3}


def test_chance_meetings_are_not_sent_with_fine_counts(spark, monkeypatch):
    """Unlike texts that share rare passages meet in boxes; their few coordinates part them, and only the rest is sent with more."""
    rng = random.Random(5)
    passages = [" ".join(f"p{i}x{j}" for j in range(30)) for i in range(12)]
    rows = [(6 * i + j, f"{passages[i]} {passages[6 + j]}") for i in range(6) for j in range(6)]
    rows += [(500 + i, edited(rng, rows[i][1].split(), 1)) for i in range(6)]
    sent, visits = {}, jaccard._visits

    def counted(rows, f, schema):
        for c in {"coarse", "fine", "shingles"} & set(rows.columns):
            sent[c] = rows.count()
        return visits(rows, f, schema)

    monkeypatch.setattr(jaccard, "_visits", counted)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == classes(rows, 5, 80)
    assert sent["fine"] < 0.2 * sent["coarse"]


def test_texts_that_nobody_asks_for_stay(spark):
    asked = spark.range(20_000).select(F.xxhash64("id").alias("version"))
    others = spark.range(10**6, 10**6 + 20_000).select(F.xxhash64("id").alias("v"))
    classes_of = jaccard.slots(asked, "version")
    assert others.join(classes_of, jaccard.in_slots("v"), "left_semi").count() < 200  # 2,800 with 2 ** 17 classes
    assert asked.join(classes_of, jaccard.in_slots("version"), "left_semi").count() == 20_000


def test_workers_get_small_batches_of_texts(spark, monkeypatch):
    name, seen, written = "spark.sql.execution.arrow.maxRecordsPerBatch", [], Scratch.__call__
    before = spark.conf.get(name)
    monkeypatch.setattr(Scratch, "__call__", lambda keep, df, texts=False: (seen.append(int(spark.conf.get(name))), written(keep, df, texts))[1])
    jaccard.near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string"))
    assert seen and max(seen) <= 1024 and spark.conf.get(name) == before
