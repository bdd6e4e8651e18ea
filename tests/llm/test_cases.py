"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import random
import re

import public_tokenizers
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barquet.llm import bpe
from barquet.llm.components import components
from barquet.llm.decontaminate import contamination
from barquet.llm.jaccard import near_duplicates
from barquet.llm.licenses import LICENSES, known_licenses, scan_licenses
from barquet.llm.lm import stupid_backoff
from barquet.llm.quality import _ranked, fit, keep_good, score_documents
from barquet.llm.sharding import shard_rows
from barquet.llm.substrings import drop_repeats
from barquet.llm.topk import top_k
from barquet.llm.urls import judge_urls

BPE = public_tokenizers.path("byte_bpe_50k.json")
RNG = random.Random(5)
WORDS = [f"{a}{b}" for a in ("alpha", "Beta", "gamma", "DELTA", "über", "naïve") for b in ("", "1", "x!", "-y", "é")]


def made(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


PASSAGE, LONG = made(45), made(6000)
TEXTS = [
    (0, PASSAGE + " " + made(30)),
    (1, made(10) + " " + PASSAGE + "\n" + made(5)),
    (2, None),
    (3, ""),
    (4, " \t\n"),
    (5, "one"),
    (6, "one two"),
    (7, LONG),
    (8, LONG + " tail"),
    (9, PASSAGE),
    (10, PASSAGE),
    (11, PASSAGE + " " + PASSAGE),
    (12, "loop " * 60),
    (13, made(80)),
    (14, "<|endoftext|> it's <|endoftext|>\u00a0\u2003 12 345\r\n\x00 end "),
]


@pytest.fixture(scope="module")
def docs(spark):
    """With columns whose names operators use themselves."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for c in ("w", "block", "n_words", "kept_text", "shard", "slot", "ids", "score", "box", "version", "token", "component", "label", "count"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# 1


def found(doc, items, window):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    words, hit, names = re.findall(pattern, lower(doc)), set(), set()
    for item, text in items:
        w = re.findall(pattern, lower(text))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            x = w[i : i + window]
            for j in range(len(words) - len(x) + 1):
                if words[j : j + len(x)] == x:
                    hit.update(range(j, j + len(x)))
                    names.add(str(item))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("most", [200_000, 0])
def test_contamination(spark, docs, most):
    items = [(1, " ".join(PASSAGE.split()[5:25])), (2, "ONE"), (3, None), (4, ""), (5, "loop loop"), (6, "loop loop"), (7, made(30)), (None, "one"), (10, " ".join(LONG.split()[100:140]))]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("len", F.lit(0))
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in contamination(docs, benchmark, most_windows=most).collect()}
    own = [x for x in items if x[0] is not None]
    assert got == {i: found(t, own, 10) for i, t in TEXTS}


def test_contamination_without_rows(spark, docs, none):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert contamination(none, items).count() == 0
    assert contamination(docs, items.limit(0)).where("contaminated or n_items > 0").count() == 0


def test_contamination_repeated_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c"), (None, "a b")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["n_hit"]) for r in contamination(rows, items).collect()), key=str)
    assert got == [(1, 0), (1, 2), (None, 2)]


@pytest.mark.parametrize("most", [200_000, 0])
def test_contamination_null_ids(spark, most):
    """Documents and items without an id count on both paths; the id of such an item is all that is left out."""
    items = spark.createDataFrame([(None, "x y"), (1, "a b"), (None, "a b")], "item_id long, text string")
    rows = [(None, "a b"), (None, "a b"), (None, "c"), (None, "c x y"), (2, "x y a b"), (3, None)]
    got = contamination(spark.createDataFrame(rows, "doc_id long, text string"), items, most_windows=most).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items"], r["contaminated"]) for r in got), key=str)
    want = [(None, 2, 2, 2, ["1"], True), (None, 1, 0, 0, [], False), (None, 3, 2, 1, [], True), (2, 4, 4, 2, ["1"], True), (3, 0, 0, 0, [], False)]
    assert got == sorted(want, key=str)


# 2


def test_top_k(spark):
    rng = random.Random(1)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(8)], 0) for i in range(300)]
    rows += [(300, rows[0][1], 0), (301, rows[0][1], 0), (302, None, 0), (303, [1.0, None], 0), (304, [float("nan")] * 8, 0), (305, [float("inf")] * 8, 0), (306, [], 0), (307, [5.0], 0)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int")
    got = {}
    for r in top_k(v, v.where("vec_id % 20 = 0"), 5, 256.0, block_rows=16, window_blocks=4, query_chunk=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: [int(x * 256 // 1) for x in e] for i, e, _ in rows if e is not None and all(x is not None and abs(x) < 1e9 for x in e)}
    for q in [i for i in vectors if i % 20 == 0]:
        best = sorted((-sum(a * b for a, b in zip(vectors[q], e, strict=False)), i) for i, e in vectors.items() if i != q)[:5]
        assert sorted(got[q]) == [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
    assert set(got) == {i for i in vectors if i % 20 == 0}
    assert top_k(v.limit(0), v).count() == 0 and top_k(v, v.limit(0)).count() == 0


def test_top_k_of_large_components(spark):
    """Scores are exact up to a long, and at its end beyond."""
    rows = [(0, [100000.0, 1.0]), (20, [70000.0, -3.5]), (1, [200000.0, 0.0]), (2, [1e30, 0.0]), (3, [-1e30, 1.0]), (4, [0.0, 3e15])]
    v = spark.createDataFrame([*rows, (0, [100000.0, 1.0])], "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(v, v.where("vec_id % 20 = 0"), 6).collect()]
    want, top = [], (1 << 63) - 1
    for q, e in rows[:2]:
        whole = lambda x: [int(c * 256 // 1) for c in x]
        scores = [(max(1 - top, min(top, sum(a * b for a, b in zip(whole(e), whole(x), strict=True)))), i) for i, x in [*rows, rows[0]] if i != q]
        want += [(q, n, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:6], 1)]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("block_rows", [1, 2, 256])
def test_top_k_beyond_a_long(spark, block_rows):
    """Halves of a bound beyond a long exclude nothing, however blocks are cut."""
    big = 2.0**24
    rows = [(0, [big, -big]), (1, [big, 2**23.5]), (2, [big, big]), (3, [1.0, -(2.0**17)]), (4, [-big, -big]), (5, [big, -1.0]), (6, [0.0, -(2.0**23)])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["rank"], r["vec_id"], r["score"]) for r in top_k(v, v.where("vec_id = 0"), 6, block_rows=block_rows, window_blocks=3).collect()]
    whole, top = [[int(c * 256 // 1) for c in x] for _, x in rows], (1 << 63) - 1
    scores = sorted((-max(1 - top, min(top, sum(a * b for a, b in zip(whole[0], whole[i], strict=True)))), i) for i in range(1, 7))
    assert sorted(got) == [(n, i, -s) for n, (s, i) in enumerate(scores, 1)]


# 3


def test_language_model(spark, docs, none):
    got = {r["doc_id"]: (r["n_words"], r["n_seen"]) for r in stupid_backoff(docs, order=3, block_bytes=1 << 12).collect()}
    grams = lambda w, n: {tuple(w[max(0, i - n + 1) : i + 1]) for i in range(len(w))}
    words = {i: lower(t).split() if t else [] for i, t in TEXTS}
    words = {i: split(lower(t)) for i, t in TEXTS}
    for i, w in words.items():
        others = set()
        for j, x in words.items():
            if j != i:
                for n in (1, 2, 3):
                    others |= {tuple(x[k : k + n]) for k in range(len(x) - n + 1)}
        assert got[i] == (len(w), sum(tuple(w[max(0, k - 2) : k + 1]) in others for k in range(len(w))))
    assert grams and stupid_backoff(none).count() == 0


# 4


def without_repeats(rows, window):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = split(t)
        gone = [False] * len(w)
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize("window", [4, 7, 20])
def test_repeats(docs, none, window):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_text"]) for r in drop_repeats(docs, window, block_bytes=1 << 12).collect()}
    assert got == without_repeats(TEXTS, window)
    assert drop_repeats(none, window).count() == 0


def test_repeats_keep_other_columns(docs):
    r = drop_repeats(docs, 20).where("doc_id = 13").first()
    assert r["shard"] == r["block"] == "clash" and r["text"] == dict(TEXTS)[13]


def test_repeats_of_shared_ids(spark):
    rows = spark.createDataFrame([(None, PASSAGE), (1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert sorted(r["n_removed"] for r in drop_repeats(rows, 20).collect()) == [0, 45, 45]


# 5


def test_licenses(spark, docs, none):
    mit = "Copyright (c) 2020 Some Body\n\n" + LICENSES["MIT"].upper().replace("SOFTWARE", "software").replace(", ", ",\n   ")
    rows = spark.createDataFrame([(1, mit), (2, "/* " + LICENSES["Zlib"].replace("acknowledgment", "acknowledgement") + " */"), (3, mit + " extra"), (4, None), (5, "(c) nobody"), (5, mit)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["license_id"] or "") for r in scan_licenses(rows, known_licenses(spark)).collect())
    assert got == [(1, "MIT"), (2, "Zlib"), (3, ""), (4, ""), (5, ""), (5, "MIT")]
    assert scan_licenses(docs, known_licenses(spark)).where("license_id is not null").count() == 0
    assert scan_licenses(none, known_licenses(spark)).count() == 0


def test_licenses_as_files(spark):
    """Titled, wrapped at any width, in either spelling; a body line that begins with "copyright" stays."""
    import textwrap

    notice = "Copyright (c) 2019-2021 Some One <x@y.z>\nAll rights reserved.\n\n"
    rows, want = [], []
    for name, title in (("MIT", "MIT License"), ("ISC", "ISC License"), ("Zlib", "zlib License"), ("MIT", "The MIT License (MIT)"), ("0BSD", "BSD Zero Clause License")):
        for width in (40, 60, 72, 79, 100):
            body = "\n\n".join(textwrap.fill(x, width) for x in LICENSES[name].split("\n\n"))
            rows += [(len(rows), f"{title}\n\n{notice}{body}\n"), (len(rows) + 1, notice + body), (len(rows) + 2, body.replace("software", "programme", 1))]
            want += [name, name, None]
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known_licenses(spark)).collect()}
    assert [got[i] for i, _ in rows] == want
    known = spark.createDataFrame([("A", "you fulfil the licence; fulfil, whilst wilful")], "license_id string, text string")
    texts = spark.createDataFrame([(1, "You fulfill the license; fulfill while willful."), (2, "You fulfilled the license; fulfill while willful.")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["license_id"]) for r in scan_licenses(texts, known).collect()) == [(1, "A"), (2, None)]


def test_licence_items(spark):
    """Items "(c)" and a first line that ends with "license" are text of a licence, at any width; a notice with a year is none."""
    import textwrap

    terms = "By using this work you accept all terms of this simple license and agree to:\n\n(a) keep this notice in place, and\n\n(c) You must retain, in the source form, all notices of origin."
    other = terms.replace("(c) You must retain, in the source form, all notices of origin.", "(c) You may do anything at all.")
    known = spark.createDataFrame([("T", terms)], "license_id string, text string")
    rows, want = [], []
    for width in (30, 50, 64, 100):
        wrap = lambda x: "\n\n".join(textwrap.fill(p, width) for p in x.split("\n\n"))  # noqa: E731, B023
        for text, found in ((wrap(terms), "T"), ("Simple Terms License\n(c) 2020 Some One\n\n" + wrap(terms), "T"), (wrap(other), None)):
            rows.append((len(rows), text))
            want.append(found)
    got = {r["doc_id"]: r["license_id"] for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known).collect()}
    assert [got[i] for i, _ in rows] == want


# 6


def test_quality(spark, docs, none):
    good, bad = [(i, made(40 + i) + ".") for i in range(40)], [(100 + i, " ".join(w + "###" for w in made(40).split())) for i in range(40)]
    train = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good + bad] + [(1, None), (None, 1), (9999, 0)], "doc_id long, label int")
    ranker = fit(train, labels)
    assert score_documents(train, ranker).where((F.col("doc_id") < 100) != (F.col("predicted") == 1)).count() == 0
    scored = score_documents(docs, ranker)
    assert scored.count() == len(TEXTS) and scored.where("score between 0 and 1").count() == len(TEXTS)
    assert keep_good(none, ranker).count() == 0 and keep_good(docs, ranker).columns == docs.columns
    empty = fit(train, labels.limit(0))
    assert [r["score"] for r in score_documents(train.limit(2), empty).collect()] == [0.5, 0.5]


def test_quality_learns_from_every_label(spark):
    """The only bad rows are those with the highest hashes of 20,300, and blocks are smaller than the rows."""
    rows = spark.range(20_300).select(F.col("id").alias("doc_id"), F.row_number().over(Window.orderBy(F.xxhash64("id"))).alias("place"))
    rows = rows.select("doc_id", F.when(F.col("place") <= 20_100, F.concat(F.lit("Plain words number "), F.col("doc_id"))).otherwise(F.concat(F.lit("###|| @@ {} "), F.col("doc_id"))).alias("text"), (F.col("place") <= 20_100).cast("int").alias("label")).localCheckpoint()
    ranker = fit(rows.select("doc_id", "text"), rows.select("doc_id", "label"), block=1000)
    found = score_documents(rows.select("doc_id", "text"), ranker).join(rows.select("doc_id", "label"), "doc_id").groupBy("label", "predicted").count().collect()
    assert {(r["label"], r["predicted"]): r["count"] for r in found} == {(1, 1): 20_100, (0, 0): 200}


def test_exact_places_of_scores(spark):
    """Of many equal, few different, tiny and huge scores."""
    values = [0.5] * 500 + [i / 7 for i in range(300)] + [1e-300, -1e300, 1e300, -0.25]
    scores = spark.createDataFrame([(v,) for v in values], "score double")
    places = [0, 1, 2, 3, 400, 503, 600, 802, 803]
    assert _ranked(scores, places, bins=16) == [sorted(values)[i] for i in places]


# 7


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_urls(spark, most):
    rules = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"), ("org", "/es/", "allow"), ("a.b", "", "block")]
    urls = ["http://X.Example.COM/en/77?x", "http://example.com/en/8", "http://notexample.com/en/7", "https://example.net/de/8", "https://m.example.net/de/9#a", "http://q.org/es/1", None, "", "nothing", "a://b://c/d", "http://x.a.b", "http://com/en/", "http://com/en"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("rule", F.lit("clash"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, rules, most_rules=most).collect()}
    for i, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h), len(p), n, h + p, v) for n, (h, p, v) in enumerate(rules) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert got[i] == (host, path, best[3] if best else None, best[4] if best else "allow")
    assert judge_urls(pages.limit(0), rules).count() == 0


# 8


def test_bpe(docs, none):
    t = Tokenizer.from_file(BPE)
    encoded = bpe.encode(docs, BPE, part_bytes=1 << 12, chunk_bytes=1 << 10)
    got = {r["doc_id"]: r for r in bpe.decode(encoded, BPE).collect()}
    for i, text in TEXTS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["text"] == (text or "") == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode(none, BPE).count() == 0


def test_decode_odd_ids(spark):
    rows = spark.createDataFrame([(1, [None, -1, 10**6, 50256]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, BPE).collect()} == {1: "<|endoftext|>", 2: "", 3: ""}


# 9


def classes(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = split(lower(t))
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("k", "percent", "page"), [(3, 90, 1 << 20), (5, 80, 200), (2, 60, 64)])
def test_near_duplicates(spark, none, k, percent, page):
    rng = random.Random(k)
    rows = list(TEXTS)
    for i in range(20, 120):
        base = split(rng.choice([t for _, t in rows[:40] if t and len(t) < 900 and t.strip()]))
        w = list(base)
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component", F.lit(1)).repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, k, percent, page).collect()}
    assert got == classes(rows, k, percent)
    assert near_duplicates(none).count() == 0


def test_near_duplicates_of_shared_ids(spark):
    rows = spark.createDataFrame([(5, PASSAGE), (5, "x y z u v w"), (2, PASSAGE), (9, "x y z u v w"), (None, PASSAGE)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in near_duplicates(rows).collect()), key=str) == [(2, 2), (5, 2), (5, 2), (9, 2), (None, None)]


def test_near_duplicates_of_texts_under_one_id(spark):
    """Each text of an id is compared, whichever rows come first."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60 + i)) for i in range(6)]
    rows = [(50, t) for t in texts] + [(50, texts[0])] + [(i, t + " tail") for i, t in enumerate(texts)] + [(60, made(70)), (None, texts[1])]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got if r["doc_id"] is not None) == [(i, 0) for i in range(6)] + [(50, 0)] * 7 + [(60, 60)]


def test_components_by_rounds_and_at_once(spark, monkeypatch):
    """A path, a star, loops and repeated edges: rounds down to no edge, and one task for the last ones, give the same."""
    from barquet.llm import components as module

    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (3, 2), (3, 2), (-5, 200), (200, 201)]
    df, found = spark.createDataFrame(edges, "a long, b long"), []
    for last in (0, 25, 1 << 18):
        monkeypatch.setattr(module, "LAST", last)
        found.append({r["node"]: r["component"] for r in components(df).collect()})
    want = {i: 0 for i in range(31)} | {100 + i: 100 for i in range(20)} | {-5: -5, 200: -5, 201: -5}
    assert found == [want] * 3


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(1000, 1060)] + [(1, x) for x in range(2, 80)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)]
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    for _ in range(200):
        for a, b in edges:
            low[a] = low[b] = min(low[a], low[b])
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in low.items() if any(n in e and e[0] != e[1] for e in edges)}


# 10


@pytest.mark.parametrize(("n", "shards"), [(0, 5), (3, 7), (500, 1), (500, 24), (501, 24)])
def test_sharding(spark, n, shards):
    rows = [(None if i % 50 == 0 else i % 40 if i % 3 == 0 else i, "same", i % 2) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, shard string, count int")
    out = [r.asDict() for r in shard_rows(df, "doc_id", shards, virtual_nodes=8).collect()]
    assert len(out) == n
    loads = [sorted(r["slot"] for r in out if r["shard"] == s) for s in range(shards)]
    assert all(x == list(range(len(x))) for x in loads) and max(map(len, loads)) - min(map(len, loads)) <= 1
    assert sorted(str((r["doc_id"], r["count"])) for r in out) == sorted(str((a, c)) for a, _, c in rows)
