"""N-gram Jaccard join: count vectors in an R-tree, bounded by summed coordinate minima.

A document is the set of its distinct word shingles. Shingles are hashed into groups, and the set
becomes the point of its group counts. Two sets share at most the sum over groups of the smaller
count, so that sum bounds their similarity from above. Groups nest: 2**48 fine ones at the root,
65,536 in which the mass of the whole corpus is counted, 64 coordinates in the boxes of the levels below,
and for each point as many as tell unrelated texts of its size apart.

1. Root. A child is the half-space of points with a count in one fine group. A point goes to as few
   children as the bound allows: groups are taken by rising mass until those left, summed, fall below
   the least overlap that a link needs. Two points without a common child have summed minima below it,
   so no link is lost; and what a third of all documents hold has a large mass and is hardly ever taken.
   A child of two points is a pair, and none if their sizes are too unlike; others are cut into cells of alike
   size, two for each point, so that sizes which allow a link share one. Below, cells stand for children.
2. Each point of a child is compared with the child's first point: sizes and coordinates first, then
   shingles. That joins copies into parts with a number of comparisons in proportion to the entries.
   The first point's text is sent once for some hundred others, whatever number a child has.
3. Children of which the other points still lie in more than one part are searched on. Their points fall into
   classes of alike size, in these a part that would fill pages into a branch of its own, and in branches
   points are halved at the means of the coordinates of the largest spread, until a page is left. So pages hold alike points. Classes,
   branches, every fourth halving and pages have boxes of lowest and highest size and highest coordinates: from
   the top down, pairs are left out by sizes and summed minima, and if all their points are in one part.
   In a pair of pages, pairs of points are, and what survives is verified on the shingles.

In visits, points are first parted by their coordinates, then by finer counts. Children with the same points are searched once. Equal sets are one point. All steps are exact but for
hashes: shingles and sets are told apart by 64 bits. The result doesn't depend on the size of pages.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import Scratch, distinct, durable, few, rolling, runs, slices, small_batches, tidily, word_hashes
from barquet.llm.components import components

#: Coordinates of points and boxes below the root, groups in which the corpus is counted, and bits of a fine group.
GROUPS, MASSES, FINE_BITS = 64, 1 << 16, 48
#: Coarse counts have groups of so many shingles on average, as a power of two: enough to part most unrelated texts of any length.
COARSER = 2
#: Classes of text hashes: texts whose class nobody asks for are not shuffled. A 64th of so many rows, words of bits, are broadcast at most.
SLOTS = 1 << 24
#: Points of a page at most on average, halvings of a branch at most (more pages than that are dealt by hash), and
#: halvings from one level of boxes to the next.
PAGE_POINTS, MOST_BITS, STEP_BITS = 512, 24, 4
#: Points that are compared with one copy of the first text of their group.
RUN = 256
_DESCRIBED = "doc_id long, version long, n_shingles long, id long, point array<int>, coarse binary, fine binary, masses array<long>"
_LEAST = np.uint64(64 - FINE_BITS)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles of ``text``; with fewer words, of all words as one."""
    words = word_hashes((text or "").encode().lower())
    return distinct(rolling(words, min(k, len(words)))) if len(words) else words


def _id(s: np.ndarray) -> int | None:
    """What a set is known by; an empty set has none."""
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None


def _mass_group(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - MASSES.bit_length() + 1)).astype(np.int64)


def _points(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([np.bincount((s >> np.uint64(64 - GROUPS.bit_length() + 1)).astype(np.int64), minlength=GROUPS) for s in sets], np.int32).reshape(-1, GROUPS)


def _fine_point(s: np.ndarray, more: int = 0) -> np.ndarray:
    """Counts in so many groups, a power of two, that a group has a shingle of the set at most on average, or 2 ** ``more``."""
    bits = min(24, max(GROUPS.bit_length() - 1, len(s).bit_length() - more))
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)


def _coded(point: np.ndarray) -> bytes:
    """Half a byte a group if that is enough, else one, else four."""
    most = int(point.max())
    if most < 16:
        return b"\0" + (point[::2] * 16 + point[1::2]).astype(np.uint8).tobytes()
    return b"\1" + point.astype(np.uint8).tobytes() if most < 256 else b"\4" + point.astype(np.uint32).tobytes()


def _decoded(data: bytes) -> np.ndarray:
    if data[0]:
        return np.frombuffer(data, np.uint8 if data[0] == 1 else np.uint32, offset=1).astype(np.int64)
    both = np.frombuffer(data, np.uint8, offset=1)
    return np.stack([both >> 4, both & 15], 1).ravel().astype(np.int64)


def _fine_minima(a: np.ndarray, b: np.ndarray) -> int:
    """Summed minima in the groups of the coarser of both."""
    if len(a) > len(b):
        a, b = b, a
    return int(np.minimum(a, b.reshape(len(a), -1).sum(1)).sum())


def _least_overlap(n: int, percent: int) -> int:
    """The least overlap with a set of ``n`` that a link needs: no union is smaller than ``n``."""
    return -(-percent * n // 100)


def _children(s: np.ndarray, masses: np.ndarray, percent: int) -> np.ndarray:
    """Fine groups in order of mass, until the counts of those left sum to less than the least overlap."""
    order = np.argsort(masses[_mass_group(s)], kind="stable")
    return distinct(s[order[: len(s) - _least_overlap(len(s), percent) + 1]] >> _LEAST)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if len(a) + len(b) > 2000 and (100 + percent) * _fine_minima(_fine_point(a), _fine_point(b)) < percent * (len(a) + len(b)):
        return False
    same = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * same >= percent * (len(a) + len(b) - same)


def _survivors(n: np.ndarray, fine: list[bytes], page: np.ndarray, part: np.ndarray, percent: int, step: int = 1024) -> np.ndarray:
    """Which points have another in a different part whose bounds allow a link: in the other page, or within one if there is one."""
    order = np.argsort(n, kind="stable")
    n, page, part = n[order], page[order], part[order]
    points = np.array([_decoded(fine[i]).reshape(GROUPS, -1).sum(1) for i in order], np.int32)
    found, two = np.zeros(len(n), bool), len(np.unique(page)) > 1
    read: dict[int, np.ndarray] = {}
    for i in range(1, len(n)):
        low = int(np.searchsorted(n, _least_overlap(n[i], percent)))
        for high in range(i, low, -step):
            others = np.arange(max(low, high - step), high)
            others = others[(part[others] != part[i]) & ((page[others] != page[i]) | (not two)) & ~(found[others] & found[i])]
            ok = (100 + percent) * np.minimum(points[others], points[i]).sum(1) >= percent * (n[others] + n[i])
            for j in others[ok].tolist():
                if not (found[i] and found[j]):
                    for x in (i, j):
                        if x not in read:
                            read[x] = _decoded(fine[order[x]])
                    if (100 + percent) * _fine_minima(read[i], read[j]) >= percent * (n[i] + n[j]):
                        found[i] = found[j] = True
    out = np.empty(len(n), bool)
    out[order] = found
    return out


def _links(sets: list[np.ndarray], page: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between different parts, enough to connect what is linked: between the two pages, or within one if there is one."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, page, names = [sets[i] for i in order], page[order], part[order]
    part = np.unique(names, return_inverse=True)[1]
    n, points = np.array([len(s) for s in sets]), _points(sets)
    out, two = [], len(np.unique(page)) > 1
    for i in range(1, len(sets)):
        others = np.arange(int(np.searchsorted(n, _least_overlap(n[i], percent))), i)
        others = others[(part[others] != part[i]) & ((page[others] != page[i]) | (not two))]
        bound = np.minimum(points[others], points[i]).sum(1)
        ok = (100 + percent) * bound >= percent * (n[others] + n[i])
        for j in others[ok][np.argsort(-bound[ok], kind="stable")]:
            if part[j] != part[i] and _linked(sets[i], sets[j], percent):
                out.append((int(names[i]), int(names[j])))
                part[part == part[i]] = part[j]
    return out


def _slot(version: str) -> tuple[Column, Column]:
    """The word and the bit in it of the class of a text hash."""
    slot = f"pmod({version}, {SLOTS}L)"
    return F.expr(f"shiftright({slot}, 6)"), F.expr(f"shiftleft(1L, cast({slot} & 63 as int))")


def slots(df: DataFrame, version: str) -> DataFrame:
    """The classes of the text hashes in ``df``, in words of bits, to be broadcast and asked by ``in_slots``."""
    word, bit = _slot(version)
    return F.broadcast(df.select(word.alias("slot_word"), bit.alias("bit")).groupBy("slot_word").agg(F.bit_or("bit").alias("slot_bits")))


def in_slots(version: str) -> Column:
    """Whether a text hash is in a class of the ``slots`` that are joined."""
    word, bit = _slot(version)
    return (word == F.col("slot_word")) & (F.col("slot_bits").bitwiseAND(bit) != 0)


def _cells(box: str, size: str, percent: int) -> Column:
    """The two cells of a box that a point goes to: sizes of which the smaller is ``percent`` hundredths of the larger or more share one."""
    n = F.floor(F.log(size) / math.log(100 / max(percent, 1) * (1 + 1e-9))).cast("long")  # a bit wider, so that rounding parts none
    return F.array(F.xxhash64(box, n), F.xxhash64(box, n + 1))


def _asked(points: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """The points (id and ``columns``) whose class ``ids`` hold, so that few others are shuffled."""
    return points.join(slots(ids, "id"), in_slots("id"), "left_semi").select("id", *columns)


def _summed_minima(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda acc, x: acc + x)


def _may_link(percent: int) -> Column:
    """Whether boxes a and b (low and high size, most of each coordinate) may hold points that link."""
    sizes = (100 * F.col("high_a") >= percent * F.col("low_b")) & (100 * F.col("high_b") >= percent * F.col("low_a"))
    return sizes & ((100 + percent) * _summed_minima("most_a", "most_b") >= percent * (F.col("low_a") + F.col("low_b")))


def _side(df: DataFrame, side: str, *same: str) -> DataFrame:
    return df.select(*same, *[F.col(c).alias(f"{c}_{side}") for c in df.columns if c not in same])


def _hull(*more: Column) -> list[Column]:
    """The box of boxes: sizes, the parts between which points lie, highest coordinates."""
    shape = [F.min("low").alias("low"), F.max("high").alias("high"), F.min("part_low").alias("part_low"), F.max("part_high").alias("part_high")]
    return [*shape, F.array(*[F.max(F.col("most")[g]) for g in range(GROUPS)]).alias("most"), *more]


_VISIT = ["box", "page_a", "page_b"]


def _visits(rows: DataFrame, f: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """``f`` of the rows of each visit to a pair of pages; a task holds one visit at a time."""

    def each(batches):
        for rows in runs(tidily(batches), _VISIT):
            yield f(rows)

    return rows.repartition(*_VISIT).sortWithinPartitions(*_VISIT).mapInArrow(each, schema)


def _paged(rows: DataFrame, points: DataFrame, page_shingles: int) -> DataFrame:
    """Rows with the class, branch, halvings (code, of so many bits) and page that they lie in, and their points."""
    rows = rows.withColumn("class", F.floor(F.log("size") / F.log(F.lit(1.25))).cast("long"))
    heavy = rows.groupBy("box", "class", "part").agg(F.sum("weight").alias("mass")).where(F.col("mass") > page_shingles).select("box", "class", "part", F.col("part").alias("heavy"))
    rows = rows.join(heavy, ["box", "class", "part"], "left").withColumn("branch", F.xxhash64("class", "heavy")).drop("heavy")
    rows = rows.join(points.select("id", "point"), "id")
    g = [F.col("point")[g].cast("long") for g in range(GROUPS)]
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(g)] + [F.sum(c * c).alias(f"q{i}") for i, c in enumerate(g)]
    branches = rows.groupBy("box", "branch").agg(F.count("*").alias("n"), F.sum("weight").alias("mass"), *sums)
    mean = [F.col(f"s{i}") / F.col("n") for i in range(GROUPS)]
    spread = F.array(*[F.struct((F.col(f"q{i}") / F.col("n") - m * m).alias("spread"), F.lit(i).alias("g"), m.alias("mean")) for i, m in enumerate(mean)])
    bits = F.least(F.lit(MOST_BITS), F.greatest(F.lit(0), F.ceil(F.log2(F.col("mass") / page_shingles)))).cast("int")
    branches = branches.select("box", "branch", bits.alias("bits"), F.slice(F.sort_array(spread, asc=False), F.lit(1), bits).alias("cuts"))
    code = F.aggregate("cuts", F.lit(0).cast("long"), lambda acc, cut: 2 * acc + F.when(F.col("point")[cut["g"]] > cut["mean"], 1).otherwise(0))
    rows = rows.join(branches, ["box", "branch"]).withColumn("code", code).drop("cuts")
    cells = rows.groupBy("box", "branch", "code").agg(F.ceil(F.sum("weight") / page_shingles).alias("pages"))
    rows = rows.join(cells, ["box", "branch", "code"])
    return rows.withColumn("page", F.xxhash64("branch", "code", F.pmod(F.xxhash64("id"), "pages"))).drop("pages")


def _page_pairs(rows: DataFrame, points: DataFrame, percent: int, page_shingles: int, keep: Scratch) -> DataFrame:
    """The rows (box, id, size, part, weight) of boxes of more than a page, once for each pair of pages that may hold a link between parts."""
    paged = keep(_paged(rows, points, page_shingles))
    own = [F.col("size").alias("low"), F.col("size").alias("high"), F.col("part").alias("part_low"), F.col("part").alias("part_high"), F.col("point").alias("most")]
    leaf = paged.select("box", "class", "branch", "code", "bits", "page", *own).groupBy("box", "page")
    leaf = keep(leaf.agg(*_hull(*[F.first(c).alias(c) for c in ("class", "branch", "code", "bits")])))
    deepest = leaf.agg(F.max("bits")).first()[0] or 0
    levels = [F.xxhash64("class"), F.col("branch")]
    levels += [F.xxhash64("branch", F.expr(f"shiftright(code, greatest(bits - {b}, 0))"), F.lit(b)) for b in range(STEP_BITS, deepest, STEP_BITS)]
    apart = F.least("part_low_a", "part_low_b") < F.greatest("part_high_a", "part_high_b")
    pairs, parent = leaf.select("box").distinct().select("box", F.lit(0).cast("long").alias("node_a"), F.lit(0).cast("long").alias("node_b")), F.lit(0).cast("long")
    for level in [*levels, F.col("page")]:
        nodes = leaf.select("box", parent.alias("parent"), level.alias("node"), "low", "high", "part_low", "part_high", "most")
        nodes = nodes.groupBy("box", "parent", "node").agg(*_hull())
        below = lambda side: _side(nodes.withColumnRenamed("node", "child"), side, "box").withColumnRenamed(f"parent_{side}", f"node_{side}")  # noqa: B023, E731
        pairs = pairs.join(below("a"), ["box", "node_a"]).join(below("b"), ["box", "node_b"])
        pairs = pairs.where((F.col("node_a") != F.col("node_b")) | (F.col("child_a") <= F.col("child_b"))).where(apart).where(_may_link(percent))
        pairs, parent = pairs.select("box", F.col("child_a").alias("node_a"), F.col("child_b").alias("node_b")), level
    pairs = pairs.toDF(*_VISIT)
    return pairs.select(*_VISIT, F.explode(F.array_distinct(F.array("page_a", "page_b"))).alias("page")).join(paged.select("box", "page", "id", "size", "part"), ["box", "page"])


def _once(rows: DataFrame, keep: Scratch) -> DataFrame:
    """Of visits with the same points in the same pages, the rows of one: they have the same links."""
    both = {c: F.bit_xor(F.xxhash64("id", "page", F.lit(i))).alias(c) for i, c in enumerate("xy")}
    visits = rows.groupBy(*_VISIT).agg(F.count("*").alias("n"), *both.values())
    return keep(rows.join(visits.groupBy("n", "x", "y").agg(F.min(F.struct(*_VISIT)).alias("visit")).select("visit.*"), _VISIT))


def _search(rows: DataFrame, points: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int, page_shingles: int, keep: Scratch) -> DataFrame:
    """Links (a, b) between parts: of rows (box, id, part), those of each box against each other, by classes, branches, pages and points."""
    rows = keep(rows.join(points.select("id", "size"), "id").withColumn("weight", F.greatest("size", F.lit(page_shingles // PAGE_POINTS))))
    in_box = keep(rows.groupBy("box").agg(F.sum("weight").alias("in_box")))  # aggregated before it is shuffled
    large = in_box.where(F.col("in_box") > page_shingles).select("box")
    columns = [*_VISIT, "page", "id", "size", "part"]
    none = {c: F.lit(0).cast("long") for c in ("page_a", "page_b", "page")}
    if large.isEmpty():
        visited = rows.withColumns(none).select(columns)
    else:
        visited = rows.join(large, "box", "left_anti").withColumns(none).select(columns)
        visited = visited.unionByName(_page_pairs(rows.join(large, "box"), points, percent, page_shingles, keep).select(columns))

    def survivors(rows: DataFrame, counted: DataFrame, counts: str) -> DataFrame:
        def survive(rows: pa.Table) -> pa.RecordBatch:
            found = _survivors(rows["size"].to_numpy(), rows[counts].to_pylist(), rows["page"].to_numpy(), rows["part"].to_numpy(), percent)
            return pa.RecordBatch.from_struct_array(rows.select(columns).filter(pa.array(found)).to_struct_array().combine_chunks())

        return keep(_visits(rows.join(counted, "id"), survive, ", ".join(f"{c} long" for c in columns)))

    def link(rows: pa.Table) -> pa.RecordBatch:
        found = _links([np.frombuffer(s, np.uint64) for s in rows["shingles"].to_pylist()], rows["page"].to_numpy(), rows["part"].to_numpy(), percent)
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    # Chance meetings grow faster than the input, and coordinates part most of them: only what those leave is sent with the fine counts.
    left = survivors(visited, points.select("id", "coarse"), "coarse")
    left = _once(survivors(left, _asked(points, left, "fine"), "fine").drop("size"), keep)
    return _visits(left.join(fetch(left), "id"), link, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, page_shingles: int = 1 << 18, by_doc_id: bool = True) -> DataFrame:
    """Groups documents whose shingle sets have a Jaccard similarity of ``percent`` hundredths or more, directly or by a chain.

    docs: doc_id and text; other columns are left out. Words are what ASCII white space divides,
    with A-Z in lower case. Returns a row per row of docs: doc_id, version (xxhash64 of its text), n_shingles
    (size of the set), component_id, the smallest doc_id reachable by links, itself included, and part, a
    number that rows share if they are reachable. Texts that are null or have no words have an
    empty set, no part, and link with nothing; texts of fewer words than a shingle are one shingle. Rows with words
    that share a doc_id are reachable from each other, if ``by_doc_id``; else links alone count. Rows with a null doc_id link like others, but have a null
    component_id. An empty table gives an empty one.
    """
    with small_batches(docs.sparkSession):
        return _near_duplicates(docs, words, percent, page_shingles, by_doc_id)


def _near_duplicates(docs: DataFrame, words: int, percent: int, page_shingles: int, by_doc_id: bool) -> DataFrame:
    spark, keep = docs.sparkSession, Scratch()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("version", F.xxhash64("text"))

    def describe(batches):
        """A row per document, and at the end one with the masses of all groups."""
        names, masses = ["doc_id", "version", "n_shingles", "id", "point", "coarse", "fine", "masses"], np.zeros(MASSES, np.int64)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        for batch in slices(batches):
            sets = [shingles(t, words) for t in batch["text"].to_pylist()]
            masses += np.bincount(_mass_group(np.concatenate(sets)), minlength=MASSES)
            counts = _points(sets)
            points = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * GROUPS), pa.array(counts.ravel()))
            coded = [[_coded(_fine_point(s, more)) for s in sets] for more in (COARSER, 0)]
            cols = [batch["doc_id"], batch["version"], [len(s) for s in sets], [_id(s) for s in sets], points, *coded, [None] * len(sets)]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([None if t is not types[-1] else masses], t) for t in types], names=names)

    described = keep(docs.mapInArrow(describe, _DESCRIBED), texts=True)
    rows = described.where("masses is null").select("doc_id", "version", "n_shingles", "id")
    counted = described.where("masses is not null").select(F.posexplode("masses")).groupBy("pos").agg(F.sum("col").alias("mass"))
    masses = np.zeros(MASSES, np.int64)
    for pos, mass in counted.collect():  # one row a group, a fixed number of them
        masses[pos] = mass
    sent = spark.sparkContext.broadcast(masses)

    def enter(batches):
        """The root's children of each set, once a task: copies of a set are one point before anything is shuffled."""
        done: set[int] = set()
        for batch in slices(batches):
            ids, sizes, children = [], [], []
            for text in batch["text"].to_pylist():
                s = shingles(text, words)
                if len(s) and (i := _id(s)) not in done:
                    ids.append(i)
                    sizes.append(len(s))
                    children.append(_children(s, sent.value, percent).view(np.int64))
            done.update(ids)
            if len(done) > 1 << 20:
                done.clear()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(children, pa.list_(pa.int64()))], names=["id", "size", "boxes"])

    # Written, as both the first points and the join need it. Spark aggregates before it shuffles, and in the join of written tables splits a box that many points share.
    entered = keep(docs.select("text").mapInArrow(enter, "id long, size int, boxes array<long>"), texts=True)
    entries = entered.select("id", "size", F.explode("boxes").alias("box"))
    ends = [F.min("id").alias("first"), F.max("id").alias("last"), F.count("*").alias("n")]
    first = entries.groupBy("box").agg(*ends, F.min("size").alias("low"), F.max("size").alias("high")).where("first < last")
    # Two entries with different points are a pair, which is all that such a box can give, and none if their sizes are too unlike.
    first = keep(first.where((F.col("n") > 2) | (100 * F.col("low") >= percent * F.col("high"))).select("box", "first", "last", "n"))
    shared = keep(entries.join(first.where("n > 2").select("box"), "box").select("box", "id", "size").distinct())
    # Boxes of more are cut into cells of alike size. A point goes to two, so that sizes which allow a link have one in common.
    cells = shared.select("id", F.explode(_cells("box", "size", percent)).alias("box"))
    cell = keep(cells.groupBy("box").agg(*ends).where("first < last"))
    live = keep(cells.join(cell.where("n > 2").select("box", "first"), "box").select("box", "id", "first"))
    met = first.unionByName(cell).where("n = 2").select(F.col("last").alias("id_a"), F.col("first").alias("id_b"))
    met = keep(met.unionByName(live.where("id <> first").select(F.col("id").alias("id_a"), F.col("first").alias("id_b"))).distinct())
    keep.release(entered, first, shared, cell)

    # Of each point that shares a box: a row with its text, its size and its coordinates.
    best = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "version")).alias("best")
    points = described.where("id is not null").groupBy("id").agg(best, F.first("n_shingles").alias("size"), F.first("point").alias("point"), F.first("coarse").alias("coarse"), F.first("fine").alias("fine"))
    points = keep(points.join(met.select(F.explode(F.array("id_a", "id_b")).alias("id")).distinct(), "id", "left_semi").select("id", F.col("best.doc_id").alias("best_id"), F.col("best.version").alias("best_version"), "size", "point", "coarse", "fine"))

    def as_sets(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array([shingles(t, words).tobytes() for t in batch["text"].to_pylist()], pa.binary())], names=["id", "shingles"])

    def texts_of(ids: DataFrame) -> DataFrame:
        """A text of each point: id, text. It is about half as large as the set."""
        asked = points.join(ids.select("id").distinct(), "id", "left_semi").select("id", "best_id", "best_version")
        near = docs.join(slots(asked, "best_version"), in_slots("version"), "left_semi")
        # Keys without nulls: rows that repeat one are aggregated before texts are shuffled, and the join finds them where they then lie.
        key = lambda c: [F.coalesce(c, F.lit(0)).alias("named"), F.col(c).isNull().alias("unnamed")]
        near = near.groupBy(*key("doc_id"), "version").agg(F.first("text").alias("text"))
        asked = asked.select(*key("best_id"), F.col("best_version").alias("version"), "id")
        return keep(near.join(asked, ["named", "unnamed", "version"]).select("id", "text"), texts=True)

    def fetch(ids: DataFrame) -> DataFrame:
        """The sets of points: id, shingles."""
        return keep(texts_of(ids).mapInArrow(as_sets, "id long, shingles binary"), texts=True)

    boxed = points.select("id", F.col("size").alias("low"), F.col("size").alias("high"), F.col("point").alias("most"))
    pairs = keep(met.join(_side(boxed, "a"), "id_a").join(_side(boxed, "b"), "id_b").where(_may_link(percent)).select("id_a", "id_b"))
    keep.release(met)

    def bounded(batches):
        for batch in tidily(batches):
            a, b = batch["coarse_a"].to_pylist(), batch["coarse_b"].to_pylist()
            sizes = (batch["size_a"].to_numpy() + batch["size_b"].to_numpy()).tolist()
            ok = [(100 + percent) * _fine_minima(_decoded(x), _decoded(y)) >= percent * n for x, y, n in zip(a, b, sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id_a"], batch["id_b"]], names=["id_a", "id_b"]).filter(pa.array(ok, pa.bool_()))

    # Only what coarse counts leave is sent with a text a pair.
    counted = _asked(points, pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")), "size", "coarse")
    pairs = keep(pairs.join(_side(counted, "a"), "id_a").join(_side(counted, "b"), "id_b").mapInArrow(bounded, "id_a long, id_b long"))
    leaves = texts_of(pairs.select(F.explode(F.array("id_a", "id_b")).alias("id")))

    def verify(batches):
        b = None  # the set of the run's first text, in a row without id_a before the others
        for batch in slices(batches):
            linked = []
            for i, id_a in enumerate(batch["id_a"].to_pylist()):  # texts one by one: a slice may hold long ones
                s = shingles(batch["text"][i].as_py(), words)
                if id_a is None:
                    b = s
                linked.append(id_a is not None and _linked(s, b, percent))
            yield pa.RecordBatch.from_arrays([batch["id_a"], batch["id_b"]], names=["a", "b"]).filter(pa.array(linked, pa.bool_()))

    several = keep(pairs.groupBy("id_b").agg(F.ceil(F.count("*") / RUN).alias("runs")))
    compared = pairs.join(several, "id_b").select("id_a", "id_b", F.pmod(F.xxhash64("id_a"), "runs").alias("run"))
    compared = compared.join(leaves.withColumnRenamed("id", "id_a"), "id_a").select("id_a", "id_b", "run", "text")
    firsts = leaves.withColumnRenamed("id", "id_b").join(several, "id_b").select(F.lit(None).cast("long").alias("id_a"), "id_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("runs") - 1)).alias("run"), "text")
    met = firsts.unionByName(compared).repartition("id_b", "run").sortWithinPartitions("id_b", "run", "id_a")
    parts = keep(components(met.select("id_a", "id_b", "text").mapInArrow(verify, "a long, b long")))
    keep.release(pairs, leaves, several)

    # Boxes that still hold points of several parts, besides the first, which was compared with all.
    others = live.where("id <> first").select("box", "id").join(parts, F.col("id") == F.col("node"), "left").select("box", "id", F.coalesce("component", "id").alias("part"))
    open_boxes = others.groupBy("box").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"))
    open_boxes = keep(open_boxes.where("low < high").groupBy("n", "x", "y").agg(F.min("box").alias("box")).select("box"))
    if not open_boxes.isEmpty():
        found = _search(others.join(open_boxes, "box"), points, fetch, percent, page_shingles, keep)
        parts = _joined(parts, components(found), keep)
    rows = durable(few(rows.join(parts, F.col("id") == F.col("node"), "left").select("doc_id", "version", "n_shingles", F.coalesce("component", "id").alias("part"))))
    keep.release()
    if not by_doc_id:
        return _named(rows)
    shared = durable(rows.where("doc_id is not null and part is not null").groupBy("doc_id").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high"))
    if not shared.isEmpty():
        same = components(rows.join(shared.select("doc_id", "low"), "doc_id").where("part is not null").select(F.col("part").alias("a"), F.col("low").alias("b")))
        rows = rows.join(same, F.col("part") == F.col("node"), "left").select("doc_id", "version", "n_shingles", F.coalesce("component", "part").alias("part"))
    return _named(rows)


def _named(rows: DataFrame) -> DataFrame:
    """Rows with part, and component_id, the smallest doc_id of the part."""
    lowest = durable(few(rows.where("part is not null").groupBy("part").agg(F.min("doc_id").alias("lowest"), F.count("*").alias("n")).where("n > 1").drop("n")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("lowest", "doc_id")).alias("component_id")
    return rows.join(lowest, "part", "left").select("doc_id", "version", "n_shingles", component, "part")


def _joined(parts: DataFrame, joined: DataFrame, keep: Scratch) -> DataFrame:
    """(node, component) after the components ``joined`` (node, component) have been merged; what only ``joined`` has is added."""
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("end"))
    moved = parts.join(to, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
    return keep(moved.unionByName(joined.join(parts, "node", "left_anti")))
