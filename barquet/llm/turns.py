"""Repair of conversations: the cheapest edits that leave turns in a legal order, and what they make of the text.

A conversation is read as a row of codes, and edits by their initials: D(elete), I(nsert), K(eep), R(erole). Going back
from the end, the cost to go is known for each state of the grammar; going forward, of the
transitions that waste no cost the one with the least initial is taken. In a state, an initial
leads to one state only, so this gives the least of all cheapest strings of edits.

Rows are dealt out by ranges of conversation and turn, so that a conversation may fill any number of tasks. A task's part of
a conversation is summed up twice: as a matrix of costs from state to state, which gives
the costs to go at its end, and then as a map of states, which gives the state at its start. Both are
chained over the few parts of the conversations that tasks share; the rest of a task's conversations need neither.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barquet.llm.common import durable

SPACE = " \t\n\v\f\r"
#: States of the grammar (s?(ua)+)?: at the start, after s, after u, after a. By state, the next state for each legal initial.
STATES, NEXT = range(4), ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
FAR = 1 << 60
#: Costs to go after the last row: an end is legal at the start and after a, else turns are inserted.
END = (0, 4, 2, 0)
ROLES = {"u": "user", "a": "assistant"}
#: Codes of rows: GONE has to be deleted; others are the place of their initial in INITIALS, and LATE more if the text is cut off.
INITIALS, LATE, GONE = ("s", "u", "a", ""), 4, 8


@cache
def _edits(code: int, state: int) -> tuple[tuple[str, int, int, str], ...]:
    """What may be done with a row in a state, by initial: (initial, cost, next state, role to write); inserts stay before the row."""
    out = [("D", 3, state, "")]
    out += [("I", 2, to, ROLES[i]) for i, to in NEXT[state].items() if i in ROLES]
    if code != GONE:
        late, own = divmod(code, LATE)
        initial = INITIALS[own]
        if initial in NEXT[state]:
            out.append(("K", late, NEXT[state][initial], ""))
        out += [("R", 2 + late, to, ROLES[i]) for i, to in NEXT[state].items() if i in ROLES and i != initial]
    return tuple(out)


def _less(cost: Iterable[int]) -> tuple[int, tuple[int, ...]]:
    """The least cost, and the costs less that; what can't be reached stays FAR."""
    cost = list(cost)
    least = min(cost)
    return least, tuple(c - least if c < FAR // 2 else FAR for c in cost)


@cache
def _before(code: int, after: tuple[int, ...]) -> tuple[int, tuple[int, ...]]:
    """Costs to go before a row from those after it, both less their least; and that least. Few tuples ever occur."""
    cost = [min((c + after[to] for e, c, to, _ in _edits(code, s) if e != "I"), default=FAR) for s in STATES]
    for _ in STATES:  # inserts may follow one another
        cost = [min([cost[s], *(c + cost[to] for e, c, to, _ in _edits(code, s) if e == "I")]) for s in STATES]
    return _less(cost)


@cache
def _choice(code: int, state: int, after: tuple[int, ...]) -> tuple[str, int, str]:
    """The least initial that wastes no cost before a row in a state, the next state, the role to write."""
    least, before = _before(code, after)
    return next((e, to, role) for e, c, to, role in _edits(code, state) if c + (least + before[to] if e == "I" else after[to]) == least + before[state])


def back(codes: bytes, end: tuple[int, ...]) -> tuple[list[tuple[int, ...]], list[int]]:
    """Relative costs to go after each row, and the costs to go before the first."""
    total, now = _less(end)
    after = []
    for code in reversed(codes):
        after.append(now)
        least, now = _before(code, now)
        total += least
    after.reverse()
    return after, [min(c + total, FAR) for c in now]


def forward(codes: bytes, after: list[tuple[int, ...]], state: int) -> Iterator[tuple[int, str, str, int]]:
    """The edits from a state on: (row, initial, role to write, next state)."""
    for i, code in enumerate(codes):
        while True:
            edit, state, role = _choice(code, state, after[i])
            yield i, edit, role, state
            if edit != "I":
                break


def closing(state: int) -> Iterator[str]:
    """Roles to insert after the last row."""
    while END[state]:
        initial = "a" if state == 2 else "u"
        yield ROLES[initial]
        state = NEXT[state][initial]


def matrix(codes: bytes) -> list[list[int]]:
    """Least costs from each state before the rows to each state after them."""
    return [list(x) for x in zip(*[back(codes, tuple(0 if s == t else FAR for s in STATES))[1] for t in STATES], strict=True)]


def _turn_order(turn: Column) -> Column:
    return F.struct(turn.isNotNull().alias("named"), turn.alias("turn"))


def damage(turns: DataFrame) -> DataFrame:
    """Rows with reproducible faults: conv_id, turn, role, text, copies.

    crc32 of ``conv_id:turn`` modulo 20 decides: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 doubles it, 4
    makes its role user. A null conv_id or turn counts as one space there, a null role or text is one space.
    """
    conv, turn = turns["conv_id"].cast("long"), turns["turn"].cast("long")
    key = F.crc32(F.concat(F.coalesce(conv.cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(turn.cast("string"), F.lit(" ")))) % 20
    role, text = F.coalesce(turns["role"].cast("string"), F.lit(" ")), F.coalesce(turns["text"].cast("string"), F.lit(" "))
    text = F.when(key == 1, "").when(key == 2, F.translate(text, ".!?", "")).otherwise(text)
    rows = turns.select(conv.alias("conv_id"), turn.alias("turn"), F.when(key == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.when(key == 3, 2).otherwise(1).cast("long").alias("copies"), key.alias("_key"))
    return rows.where("_key <> 0").drop("_key")


def _coded(turns: DataFrame) -> DataFrame:
    """One row per conv_id, turn, role and digest of the text, with copies, code of the first copy, the counts of its faults."""
    digest = F.unhex(F.sha2("text", 256))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    rows = turns.select("conv_id", "turn", "role", "copies", digest.alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    rows = durable(rows.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.sum("copies").alias("copies")))
    same = ["conv_id", "role", "digest"]
    first = rows.groupBy(*same).agg(F.min(_turn_order(F.col("turn"))).alias("first"), F.count("*").alias("n")).where("n > 1").select(*[F.col(c).alias(f"_{c}") for c in same], "first")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in same]
    rows = rows.join(first, on, "left").drop(*[f"_{c}" for c in same])
    again = F.coalesce(_turn_order(F.col("turn")) != F.col("first"), F.lit(False))
    initial = F.left("role", F.lit(1))
    own = F.coalesce(F.array_position(F.array(*[F.lit(i) for i in INITIALS[:3]]), initial), F.lit(0))
    own = F.when(own > 0, own - 1).otherwise(3) + F.when(F.col("cut"), LATE).otherwise(0)
    extra = F.when(again, F.col("copies")).otherwise(F.col("copies") - 1)
    blank, cut = F.col("blank"), F.col("cut") & ~F.col("blank") & ~again
    return rows.select(
        "conv_id", "turn", "role", "digest", "copies", F.when(blank | again, GONE).otherwise(own).cast("tinyint").alias("code"),
        F.when(blank, F.col("copies")).otherwise(0).alias("blank"), F.when(blank, 0).otherwise(extra).alias("duplicate"), cut.cast("long").alias("truncated"),
    )


def _parts(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, list[pa.RecordBatch]]]:
    """The rows of one conversation after the other."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids, null = batch["conv_id"].fill_null(0).to_numpy(), batch["conv_id"].is_null().to_numpy(zero_copy_only=False)
        cuts = (np.flatnonzero((ids[1:] != ids[:-1]) | (null[1:] != null[:-1])) + 1).tolist()
        for i, j in zip([0, *cuts], [*cuts, len(ids)], strict=True):
            if i == j:
                continue
            if held and held[0]["conv_id"][0].as_py() != batch["conv_id"][i].as_py():
                yield held[0]["conv_id"][0].as_py(), held
                held = []
            held.append(batch.slice(i, j - i))
    if held:
        yield held[0]["conv_id"][0].as_py(), held


def _codes(part: list[pa.RecordBatch]) -> tuple[bytes, np.ndarray]:
    """Codes of all copies, and for each the row it comes from; copies after the first are duplicates."""
    code = np.concatenate([b["code"].to_numpy() for b in part]).astype(np.uint8)
    copies = np.concatenate([b["copies"].to_numpy() for b in part])
    row = np.repeat(np.arange(len(code)), copies)
    out = code[row]
    out[np.concatenate([[False], row[1:] == row[:-1]])] = GONE
    return out.tobytes(), row


def _first(part: list[pa.RecordBatch], c: str):
    return part[0][c][0].as_py()


_PLACE = "conv_id long, part int"


def _shared(coded: DataFrame) -> DataFrame:
    """For parts of conversations that several tasks hold: conv_id, part, ends (costs to go at its end), state (at its start), closes (whether it is the last).

    The parts of a conversation are chained in order; a part is a row of a few numbers.
    """

    def summed(batches):
        out, n = [], 0
        for conv, part in _parts(batches):
            row = (conv, _first(part, "part"), [c for m in matrix(_codes(part)[0]) for c in m])
            out = [*out[:1], row] if n else [row]  # only a task's first and last can go on elsewhere
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * 3, (pa.int64(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["conv_id", "part", "costs"])

    def chained(back_to_front: bool, column: str, step, start):
        def run(batches):
            current, n, now = None, 0, start
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    if not n or row["conv_id"] != current:
                        current, now = row["conv_id"], start
                    n += 1
                    out.append((row["conv_id"], row["part"], now))
                    now = step(row[column], now)
                kind = pa.list_(pa.int64()) if back_to_front else pa.int32()
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), kind), strict=True)] if out else [pa.array([], t) for t in (pa.int64(), pa.int32(), kind)], names=["conv_id", "part", "found"])

        return run

    def ordered(df: DataFrame, desc: bool) -> DataFrame:
        return df.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("part") if desc else "part")

    costs = durable(coded.select("conv_id", "part", "code", "copies").mapInArrow(summed, f"{_PLACE}, costs array<long>"))
    several = costs.groupBy("conv_id").agg(F.count("*").alias("n"), F.max("part").alias("last")).where("n > 1")
    several = several.select(F.col("conv_id").alias("_conv"), "last")
    costs = durable(costs.join(several, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv"))
    onward = lambda m, now: [min(min(m[4 * s + t] + now[t] for t in STATES), FAR) for s in STATES]
    ends = durable(ordered(costs.select("conv_id", "part", "costs"), True).mapInArrow(chained(True, "costs", onward, list(END)), f"{_PLACE}, found array<long>"))

    def mapped(batches):
        for conv, part in _parts(batches):
            codes, _ = _codes(part)
            after, _ = back(codes, tuple(_first(part, "ends")))
            to = []
            for s in STATES:
                for *_, state in forward(codes, after, s):
                    pass
                to.append(state)
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([_first(part, "part")], pa.int32()), pa.array([to], pa.list_(pa.int32()))], names=["conv_id", "part", "to"])

    maps = _placed(coded.select("conv_id", "part", "code", "copies"), ends.withColumnRenamed("found", "ends"), "inner").mapInArrow(mapped, f"{_PLACE}, to array<int>")
    states = ordered(durable(maps), False).mapInArrow(chained(False, "to", lambda m, now: m[now], 0), f"{_PLACE}, found int")
    out = _placed(ends.withColumnRenamed("found", "ends"), states.withColumnRenamed("found", "state"), "inner")
    out = _placed(out, costs.select("conv_id", "part", "last"), "inner")
    return durable(out.select("conv_id", "part", "ends", "state", (F.col("part") == F.col("last")).alias("closes")))


def _placed(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """A join by conversation and part. ``right`` has at most two rows per task of ``left``'s, of a few numbers; broadcast, it leaves the order of rows."""
    right = right.withColumnsRenamed({"conv_id": "_conv", "part": "_part"})
    return left.join(F.broadcast(right), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("part") == F.col("_part")), how).drop("_conv", "_part")


def _walked(coded: DataFrame) -> DataFrame:
    """By kind: 0 a part's audit, cost, illegal pairs and outer initials; 1 a row that stays: seq, the roles inserted before it, its role afterwards."""
    schema = f"kind int, {_PLACE}, seq long, audit string, cost long, illegal long, first string, last string, inserted array<string>, turn long, role string, digest binary, new_role string"
    legal = {"su", "ua", "au"}

    def walked(batches):
        for conv, part in _parts(batches):
            codes, rows = _codes(part)
            place, ends = _first(part, "part"), _first(part, "ends")
            after, costs = back(codes, END if ends is None else tuple(ends))
            state = 0 if ends is None else _first(part, "state")
            closes = ends is None or _first(part, "closes")
            roles = [r for b in part for r in b["role"].to_pylist()]
            audit, kept, inserted, cost = [], [], [], 0
            for i, edit, role, to in forward(codes, after, state):
                audit.append(edit)
                if edit == "I":
                    inserted.append(role)
                    cost += 2
                elif edit == "D":
                    cost += 3
                else:
                    kept.append((rows[i], inserted, role))
                    inserted = []
                    cost += (2 if edit == "R" else 0) + codes[i] // LATE
                state = to
            if closes:
                more = list(closing(state))
                inserted, cost = inserted + more, cost + 2 * len(more)
                audit += ["I"] * len(more)
            initials = [roles[r][:1] for r in rows.tolist()]
            illegal = sum(a + b not in legal for a, b in zip(initials, initials[1:], strict=False))
            table = pa.Table.from_batches([b.select(["turn", "role", "digest"]) for b in part]).take(pa.array([k[0] for k in kept], pa.int64()))
            n, tail = len(kept), [(None, inserted)] if inserted else []
            whole = [0] * n + [0] * len(tail)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([0] + [1] * len(whole), pa.int32()), pa.array([conv] * (1 + len(whole)), pa.int64()), pa.array([place] * (1 + len(whole)), pa.int32()), pa.array(range(-1, len(whole)), pa.int64()),
                    pa.array(["".join(audit), *[None] * len(whole)], pa.string()), pa.array([cost, *[None] * len(whole)], pa.int64()), pa.array([illegal, *[None] * len(whole)], pa.int64()),
                    pa.array([initials[0], *[None] * len(whole)], pa.string()), pa.array([initials[-1], *[None] * len(whole)], pa.string()), pa.array([None, *[k[1] for k in kept], *[t[1] for t in tail]], pa.list_(pa.string())),
                    pa.array([None, *table["turn"].to_pylist(), *[None] * len(tail)], pa.int64()), pa.array([None, *table["role"].to_pylist(), *[None] * len(tail)], pa.string()), pa.array([None, *table["digest"].to_pylist(), *[None] * len(tail)], pa.binary()),
                    pa.array([None, *[k[2] or r for k, r in zip(kept, table["role"].to_pylist(), strict=True)], *[None] * len(tail)], pa.string()),
                ],
                names=["kind", "conv_id", "part", "seq", "audit", "cost", "illegal", "first", "last", "inserted", "turn", "role", "digest", "new_role"],
            )

    return coded.select("conv_id", "part", "turn", "role", "digest", "code", "copies", "ends", "state", "closes").mapInArrow(walked, schema)


def repair(turns: DataFrame, rows_a_part: int = 1 << 18) -> tuple[DataFrame, DataFrame]:
    """Conversations made legal at least cost: a report per conversation, and the repaired turns.

    turns: conv_id, turn, role, text and copies (equal rows may be given once); rows of a conversation are taken by turn, null first,
    rows of a turn by role and digest. No value but conv_id and turn may be null; null is a conv_id like any other. Legal is (s?(ua)+)? by
    initials of roles. Keep costs 0, Rerole to user or assistant 2, Delete 3, Insert of an empty turn of either 2, a truncated
    row that stays 1 more; blank and repeated rows must go. Of the cheapest strings of edits the ASCII-least is taken.

    Report: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit; conversations without rows have none. Repaired
    turns: conv_id, part, seq, at, line (``role:text``), to be read in the order of part, seq and at. An empty table gives empty ones.
    rows_a_part: rows that a task walks at a time, without their texts.
    """
    coded = durable(_coded(turns))
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-coded.count() // rows_a_part))
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    coded = coded.repartitionByRange(n, *order).sortWithinPartitions(*order)
    coded = durable(coded.withColumn("part", F.spark_partition_id()))
    found = durable(_walked(_placed(coded, _shared(coded), "left")))

    per = lambda c: F.sum(c).cast("long").alias(c)
    span = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = coded.groupBy("conv_id").agg(span.alias("gaps"), per("blank"), per("duplicate"), per("truncated"))
    parts = found.where("kind = 0").groupBy(F.col("conv_id").alias("_conv")).agg(F.array_sort(F.collect_list(F.struct("part", "audit", "first", "last"))).alias("p"), per("cost"), per("illegal"))
    # Parts are few: one, or one per task that holds the conversation. Between two of them stands one more pair.
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), F.slice("p", 2, F.size("p") - 1), lambda a, b: (~F.concat(a["last"], b["first"]).isin("su", "ua", "au")).cast("long"))
    parts = parts.select("_conv", "cost", (F.col("illegal") + F.aggregate(pairs, F.lit(0).cast("long"), lambda a, b: a + b)).alias("illegal"), F.array_join(F.transform("p", lambda x: x["audit"]), "").alias("audit"))
    report = counts.join(parts, F.col("conv_id").eqNullSafe(F.col("_conv"))).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    texts = turns.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", "turn", "role")], F.unhex(F.sha2("text", 256)).alias("_digest")).agg(F.first("text").alias("text"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("conv_id", "turn")] + [F.col(c) == F.col(f"_{c}") for c in ("role", "digest")]
    stays = found.where("kind = 1")
    own = stays.where("digest is not null").join(texts, same).select("conv_id", "part", "seq", F.size("inserted").alias("at"), F.concat("new_role", F.lit(":"), "text").alias("line"))
    new = stays.select("conv_id", "part", "seq", F.posexplode("inserted").alias("at", "role")).select("conv_id", "part", "seq", "at", F.concat("role", F.lit(":")).alias("line"))
    return report, own.unionByName(new)


def digests(lines: DataFrame) -> DataFrame:
    """conv_id and sha256 of a conversation's repaired lines, joined by line breaks. A part's lines are joined first; parts pass through the hash in order."""
    parts = lines.groupBy("conv_id", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "at", "line"))), lambda x: x["line"]), "\n").alias("text"))

    def hashed(batches):
        current, state, out = None, None, []
        for batch in batches:
            for i in range(batch.num_rows):
                conv, text = batch["conv_id"][i].as_py(), batch["text"][i].as_py()
                if state is None or conv != current:
                    if state is not None:
                        out.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256(text.encode())
                else:
                    state.update(b"\n" + text.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
                out = []
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def repaired(turns: DataFrame) -> DataFrame:
    """Every conv_id of ``turns``, damaged and repaired: its report and repaired_sha256.

    turns: conv_id, turn, role, text; other columns are left out. A conversation that loses all rows has zeros, an empty audit and
    the hash of an empty string. Repeated rows count each. An empty table gives an empty one.
    """
    report, lines = repair(damage(turns))
    known = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = known.join(report.withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    out = out.join(digests(lines).withColumnRenamed("conv_id", "_conv"), F.col("conv_id").eqNullSafe(F.col("_conv")), "left").drop("_conv")
    return out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna("", ["audit"]).withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)))
