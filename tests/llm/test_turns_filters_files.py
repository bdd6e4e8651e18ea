"""Conversations, filter audits and token files against brute force: nulls, empty and long texts, ties, repeated rows, clashing columns, hot keys."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barquet.llm import queries, token_files, turns
from barquet.llm.filters import FIGURES, failure_cells, interactions, transpositions
from tests.conftest import SMALL

LEGAL = re.compile(r"(s?(ua)+)?")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def cheapest(rows):
    """All strings of edits up to a growing cost, tried in full: (cost, least audit, lines)."""
    for limit in itertools.count():
        found = []

        def tried(i, left, audit, initials, lines):
            if i == len(rows):
                if LEGAL.fullmatch(initials):
                    found.append((audit, lines))
            else:
                role, text, gone, late = rows[i]
                if left >= 3:
                    tried(i + 1, left - 3, audit + "D", initials, lines)
                if not gone and left >= late:
                    tried(i + 1, left - late, audit + "K", initials + (role[:1] or "-"), [*lines, f"{role}:{text}"])
                for new in ("user", "assistant"):
                    if not gone and left >= 2 + late:
                        tried(i + 1, left - 2 - late, audit + "R", initials + new[0], [*lines, f"{new}:{text}"])
            for new in ("user", "assistant"):
                if left >= 2:
                    tried(i, left - 2, audit + "I", initials + new[0], [*lines, f"{new}:"])

        tried(0, limit, "", "", [])
        if found:
            audit, lines = min(found)
            return limit, audit, lines


def expected(rows):
    """The report of one conversation by brute force. rows: (turn, role, text), undamaged order not needed."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, marked, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), int(fault == "truncated")))
    known = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, lines = cheapest(marked)
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    return (gaps, *counts.values(), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        out.setdefault(conv, []).extend([(turn, "user" if what == 4 else role, text)] * (0 if what == 0 else 2 if what == 3 else 1))
    return out


REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations(spark):
    rng = random.Random(11)
    texts = ["Yes.", "No!", "so what", "", " \t\n", None, "Yes.", "why? ", "end. \n", "\u0085"]
    rows = [(c, t + 3 * (rng.random() < 0.1), rng.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), rng.choice(texts)) for c in range(150) for t in range(rng.randrange(1, 5))]
    rows += [(None, None, "user", "a."), (None, None, None, None), (None, 3, "assistant", "b."), (200, None, "user", "x."), (200, None, "user", "x."), (200, 1, "user", "x."), (201, 4, "system", "x.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("part", "copies", "code", "seq", "line", "audit", "first"):
        df = df.withColumn(c, F.lit("clash"))
    got = {r["conv_id"]: tuple(r[c] for c in REPORT) for r in turns.repaired(df).collect()}
    found = damaged(rows)
    assert got == {c: expected(found[c]) for c in {r[0] for r in rows}}
    assert turns.repaired(df.limit(0)).count() == 0


def test_conversation_over_many_tasks(spark):
    """A conversation with most rows is split over tasks, and gets what one walk over all of its rows gives."""
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["", "cut off", "so.", f"said {t}.", f"asked {t}?"])) for t in range(900)]
    rows += [(1, 5000, "user", "again.")] * 300 + [(c, t, "user", "hm.") for c in (0, 2) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("copies", F.lit(1).cast("long"))
    report, lines = turns.repair(df, rows_a_part=50)
    assert lines.where("conv_id = 1").select("part").distinct().count() > 8
    got = {r["conv_id"]: r for r in report.join(turns.digests(lines), "conv_id").collect()}
    for conv in (0, 1, 2):
        own = sorted(((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0], r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, codes = set(), []
        for _, role, text in own:
            gone = not text or (role, text) in seen
            seen.add((role, text))
            codes.append(turns.GONE if gone else (turns.INITIALS.index(role[0]) if role[0] in "sua" else 3) + turns.LATE * (text[-1] not in ".!?"))
        after, costs = turns.back(bytes(codes), turns.END)
        edits = list(turns.forward(bytes(codes), after, 0))
        audit, state, out = "", 0, []
        for i, edit, role, state in edits:
            audit += edit
            if edit != "D":
                out.append(f"{role}:" if edit == "I" else f"{role or own[i][1]}:{own[i][2]}")
        more = [f"{r}:" for r in turns.closing(state)]
        assert (got[conv]["cost"], got[conv]["audit"]) == (costs[0], audit + "I" * len(more))
        assert got[conv]["repaired_sha256"] == hashlib.sha256("\n".join(out + more).encode()).hexdigest()


def test_transpositions():
    seen = [(tuple(o), k) for o, k in transpositions(4)]
    assert len({o for o, _ in seen}) == len(seen) == 24
    for (a, _), (b, k) in zip(seen, seen[1:]):
        assert b[k] == a[k + 1] and b[k + 1] == a[k] and a[:k] == b[:k] and a[k + 2 :] == b[k + 2 :]


def test_filter_audit(spark):
    good = "word " + " ".join(f"w{i}" for i in range(60))
    docs = [
        (1, good, "a"), (2, good, "a"), (2, good, "b"), (3, None, None), (4, "", ""), (5, "", "a"), (6, "LOUD " * 60, "a"), (7, good + " #", "b"), (None, good, "b"), (None, "few", "b"), (8, "a b c d " * 20, "b"),
        (9, "Tab\tTab\nTab " * 30 + "|", "a"), (1, good, "a"), (10, "x" * 200_000, "b"), (11, " ".join(f"Ää{i}" for i in range(100)), "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, 1), (6, 1, 1), (9, 0, 1), (None, 1, 1), (11, 1, 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    for c in ("part", "mask", "digest", "good", "n", "quality"):
        df = df.withColumn(c, F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (*FIGURES, "shapley")) for r in interactions(failure_cells(df, marks, df["source"])).collect()}

    def failing(i, text):
        words, text = re.findall(r"[^ \t-\r]+", text or ""), text or ""
        late = any(j is not None and i is not None and j < i and (x or "") == text for j, x, _ in docs)
        return {f for f, yes in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), bool(re.search("[#$%&*|]", text)), late)) if yes}

    rows = [(p or "", failing(i, x), any(i is not None and i == j and q == 1 for j, q, _ in labels), any(i is not None and i == j and t == 1 for j, _, t in labels)) for i, x, p in docs]
    want, share = {}, {}
    for part in {r[0] for r in rows}:
        for order in itertools.permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                out = [r for r in left if f in r[1]]
                gone = [r for r in rows if r[0] == part and r[1] & set(order[:k]) and f in r[1]]
                left = [r for r in left if f not in r[1]]
                want[part, "".join(order), k + 1] = (len(left), len(out), len(gone), sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in out), sum(r[3] for r in out))
                share[part, f] = share.get((part, f), 0) + len(out)
    assert got == {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in want.items()}
    assert interactions(failure_cells(df.limit(0), marks, F.lit("x"))).count() == 0


@pytest.mark.parametrize("share", [0.5, 0.9, 1.0])
def test_blocks(share):
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_000, 5000), np.array([7]), np.zeros(100), np.array([0, 2**32 - 1] * 40), rng.integers(0, 2**32, 77), np.where(rng.random(8192) < 0.05, 2**31, 3)):
        ids = ids.astype(np.uint32)
        assert (token_files.unpack_block(token_files.pack_block(ids, share)) == ids).all()


TEXTS = [
    None, "", " ", "Hello WORLD it's I'LL x", "á ́b É x y　z\u0085w \x1c\x1d q", "12 345 ½ ٣", "<|endoftext|> a<|startoftext|>b < |endoftext|>", "가 ᆨ", "ΟΔΟΣ ΣΑΣ", "😀 👍🏽x",
    "tab\tnew\nline\r\n\x0b\x0c end", "x" * 3000, " ".join(f"tok{i % 700}" for i in range(20_000)),
]


def test_token_files(spark, tmp_path):
    """A third of the rows have one id, some equal texts too; files are small, so that documents and blocks span them."""
    t = Tokenizer.from_file(WORD_BPE)
    rng = random.Random(4)
    fuzz = ["".join(rng.choice("aB é́'sS 1 \n.ßİ Σ<|>") for _ in range(rng.randrange(60))) for _ in range(200)]
    docs = [(i, x) for i, x in enumerate([*TEXTS, *fuzz])] + [(50, x) for x in fuzz] + [(50, "same text")] * 60 + [(None, x) for x in fuzz[:30]] + [(-5, "first")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for c in ("part", "ids", "start", "n_tokens"):
        df = df.withColumn(c, F.lit("clash"))
    encoded = token_files.encode_ordered(df, WORD_BPE, end=2, part_bytes=20_000, most_words=100)
    assert encoded.where("doc_id = 50").select(F.spark_partition_id()).distinct().count() > 1
    path = str(tmp_path / "tokens")
    token_files.write_tokens(encoded, path, block_ids=64, file_ids=1000)
    plain = token_files.unpacked(encoded)
    token_files.write_tokens(plain, path + "-plain")
    assert token_files.read_tokens(spark, path + "-plain").select("ids").count() == len(docs)
    rows = sorted(token_files.read_tokens(spark, path, read_ids=100).collect(), key=lambda r: r["start"])
    assert len({f.name for f in (tmp_path / "tokens").glob("*.pfor")}) > 5
    ids = [r["doc_id"] for r in rows]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    ends = [0, *itertools.accumulate(r["n_tokens"] for r in rows)]
    assert [r["start"] for r in rows] == ends[:-1] and all(len(r["ids"]) == r["n_tokens"] for r in rows)
    assert [tuple(r) for r in plain.collect()] == [(r["doc_id"], r["ids"]) for r in rows]
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    want = sorted(((i, t.encode(x or "", add_special_tokens=False).ids + [2]) for i, x in docs), key=key)
    assert sorted(((r["doc_id"], r["ids"]) for r in rows), key=key) == want
    raw = token_files.read_tokens(spark, path, raw=True).collect()
    assert {(r["doc_id"], r["start"]): bytes(r["ids"]) for r in raw} == {(r["doc_id"], r["start"]): np.array(r["ids"], "<u4").tobytes() for r in rows}


def test_ranges_and_damage(tmp_path):
    from pyarrow import fs

    ids = np.arange(1000, dtype=np.uint32) ** 2
    with fs.LocalFileSystem().open_output_stream(str(tmp_path / "x.pfor")) as out:
        w = token_files.FileWriter(out, 64, 0.9)
        for i in range(0, 1000, 10):
            w.add(np.array([i]), np.array([i == 0]), np.array([10]), ids[i : i + 10])
        assert w.close() == 100
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "x.pfor")) as f:
        r = token_files.FileReader(f)
        for a, b in ((0, 1000), (63, 65), (5, 5), (999, 1000), (64, 128)):
            assert (r.range(a, b) == ids[a:b]).all()
        at = int(r.index[-1])
    data = bytearray((tmp_path / "x.pfor").read_bytes())
    data[at] ^= 1
    (tmp_path / "y.pfor").write_bytes(data)
    with fs.LocalFileSystem().open_input_file(str(tmp_path / "y.pfor")) as f, pytest.raises(ValueError):
        token_files.FileReader(f)


def test_no_tokens(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    token_files.write_tokens(token_files.encode_ordered(empty, WORD_BPE), str(tmp_path / "none"))
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        token_files.read_spaceless(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_query(spark):
    t, start, want = Tokenizer.from_file(WORD_BPE), 0, []
    for r in sorted(spark.read.parquet(f"{SMALL}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*t.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r["doc_id"], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, queries.op13_token_files(spark, SMALL).collect())) == want


def test_packing_makes_no_compressor_a_document(monkeypatch):
    import zstandard

    from barquet.llm import bpe

    made, make = [], zstandard.ZstdCompressor
    monkeypatch.setattr(zstandard, "ZstdCompressor", lambda *a, **k: (made.append(1), make(*a, **k))[1])
    monkeypatch.setattr(zstandard, "compress", lambda data, level: zstandard.ZstdCompressor(level=level).compress(data))
    for n in (0, 1, 700):
        ids = np.arange(n, dtype=np.uint32) * 60
        assert (bpe._unpacked(bpe._packed(ids)) == ids).all()
    assert len(made) <= 1
