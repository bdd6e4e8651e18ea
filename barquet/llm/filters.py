"""What a chain of filters costs in every order: kept, removed, redundant and lost rows of each step, and Shapley shares.

A document is one cell of a small table: the set of filters that it fails, as a mask. Spark counts the
cells of each part; from then on no order needs the documents. The orders are visited by adjacent
transpositions: two neighbours change places, and only their two steps are computed anew from the cells. Shapley
shares add up along the same walk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import durable, slices

WORD = r"[^\x20\x09-\x0D]+"
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_failures(text: Column, min_words: int = 50, distinct_percent: int = 65, capital_percent: int = 5) -> dict[str, Column]:
    """Conditions under which a text fails: A too few words, B too few different ones, C too many of A-Z, D a sign of code or markup. Null is empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < min_words,
        "B": F.size(F.array_distinct(words)) * 100 < F.size(words) * distinct_percent,
        "C": capitals * 100 > F.length(text) * capital_percent,
        "D": text.rlike("[#$%&*|]"),
    }


def failure_cells(docs: DataFrame, labels: DataFrame, part: Column) -> DataFrame:
    """Counts of documents by part and mask: part, mask, n, good, toxic. Bit i of a mask is the filter i of ABCDE.

    docs: doc_id, text; other columns may be there. A to D are those of ``text_failures``. E fails where the whole table
    has an equal text under a smaller doc_id; a null doc_id is neither smaller nor larger, and rows that repeat doc_id and
    text don't fail one another. Texts are equal if their SHA-256 are. labels: doc_id, quality, toxic; of several rows for a document
    one with 1 is enough, a null is no 1. A null part is an empty string. Texts aren't shuffled.
    """
    mask = F.lit(0)
    for i, fails in enumerate(text_failures(docs["text"]).values()):
        mask = mask + fails.cast("int") * (1 << i)
    digest = F.unhex(F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256))
    rows = durable(docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce(part.cast("string"), F.lit("")).alias("part"), mask.alias("mask"), digest.alias("digest")))
    # A group of copies leaves one row per task; only texts under several ids meet the documents again.
    copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(*[F.max(F.coalesce((labels[c] == 1).cast("int"), F.lit(0))).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))])
    found = rows.join(copies, "digest", "left").join(marks, "doc_id", "left")
    late = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    count = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0)).cast("long")).alias(c)
    return found.groupBy("part", (F.col("mask") + late * 16).alias("mask")).agg(F.count("*").alias("n"), count("good"), count("toxic"))


def transpositions(n: int) -> Iterator[tuple[list[int], int | None]]:
    """All orders of n things, each from the one before by one swap of neighbours: (order, place of the swap; None at first).

    The largest thing that can still move walks on in its direction; those larger than it turn round.
    """
    order, step = list(range(n)), [-1] * n
    yield order, None
    while True:
        movers = [x for x in order if 0 <= order.index(x) + step[x] < n and order[order.index(x) + step[x]] < x]
        if not movers:
            return
        x = max(movers)
        i = order.index(x)
        j = i + step[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            step[y] = -step[y]
        yield order, min(i, j)


def walk(cells: np.ndarray, n: int) -> tuple[list[tuple[int, ...]], np.ndarray, np.ndarray]:
    """Figures of all orders of n filters. cells: (parts, 3, 2**n): documents, good and toxic ones by mask.

    Returns the orders, figures as (parts, orders, n steps, FIGURES) and Shapley sums as (parts, n filters).
    """
    masks = np.arange(1 << n)
    now = np.zeros((len(cells), n, len(FIGURES)), np.int64)
    shapley = np.zeros((len(cells), n), np.int64)

    def visit(order: list[int], k: int) -> None:
        """Step k of the order, from the cells."""
        mine, before = 1 << order[k], sum(1 << f for f in order[:k])
        fails, gone = masks & mine != 0, masks & before != 0
        lost = cells[:, :, fails & ~gone].sum(axis=2)
        now[:, k] = np.stack([cells[:, 0, ~fails & ~gone].sum(axis=1), lost[:, 0], cells[:, 0, fails & gone].sum(axis=1), cells[:, 0, mine], lost[:, 1], lost[:, 2]], axis=1)

    orders, out = [], []
    for order, swapped in transpositions(n):
        for k in range(n) if swapped is None else (swapped, swapped + 1):
            visit(order, k)
        shapley[:, order] += now[:, :, 1]
        orders.append(tuple(order))
        out.append(now.copy())
    return orders, np.stack(out, axis=1), shapley


def interactions(cells: DataFrame, filters: str = "ABCDE", parts_at_once: int = 100) -> DataFrame:
    """The audit of each part in all orders of its filters: part, filter_order, step from 1, FIGURES, shapley.

    cells: part, mask, n, good, toxic, as from ``failure_cells``; missing cells are empty. Each part has at most 2**filters
    cells and is one row here; parts are worked on in small groups. No cells give no rows.
    """
    n = len(filters)
    lists = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))

    def audited(batches):
        for batch in slices(batches, parts_at_once):
            parts = batch["part"]
            table = np.zeros((len(parts), 3, 1 << n), np.int64)
            flat, row = batch["cells"].flatten(), np.repeat(np.arange(len(parts)), batch["cells"].value_lengths().to_numpy(zero_copy_only=False))
            for i, c in enumerate(("n", "good", "toxic")):
                np.add.at(table, (row, i, flat.field("mask").to_numpy()), flat.field(c).to_numpy())
            orders, figures, shapley = walk(table, n)
            each = len(orders) * n
            place = np.tile(np.array(orders).ravel(), len(parts))
            cols = [pa.array(np.repeat(np.array(parts.to_pylist(), object), each), pa.string()), pa.array(np.tile(np.repeat(["".join(filters[f] for f in o) for o in orders], n), len(parts)), pa.string())]
            cols += [pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders) * len(parts)))]
            cols += [pa.array(figures[..., i].ravel()) for i in range(len(FIGURES))] + [pa.array(shapley[np.repeat(np.arange(len(parts)), each), place])]
            yield pa.RecordBatch.from_arrays(cols, names=["part", "filter_order", "step", *FIGURES, "shapley"])

    return lists.mapInArrow(audited, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in (*FIGURES, "shapley")))
