"""The queries of this subpackage, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barquet.llm import bpe
from barquet.llm.common import shared_folder, table
from barquet.llm.decontaminate import contamination
from barquet.llm.filters import failure_cells, interactions
from barquet.llm.jaccard import near_duplicates
from barquet.llm.licenses import COPYRIGHT_LINE, EQUIVALENT, TITLE_LINE, known_licenses, scan_licenses
from barquet.llm.lm import stupid_backoff
from barquet.llm.quality import fit, score_documents
from barquet.llm.sharding import shard_rows
from barquet.llm.substrings import drop_repeats
from barquet.llm.token_files import encode_ordered, read_tokens, write_tokens
from barquet.llm.topk import top_k
from barquet.llm.turns import repaired
from barquet.llm.urls import judge_urls

#: Rules of op7: host, path, verdict.
URL_RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]
SHARDS = 24


def held_out(doc_id: F.Column) -> F.Column:
    """Whether a document's label is kept from learning: crc32 of its id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5, scale=256.0)


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stupid_backoff(table(spark, sf_dir, "documents"), order=2, alpha=0.4)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"), known_licenses(spark))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = score_documents(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard_rows(docs, "doc_id", SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return interactions(failure_cells(docs, table(spark, sf_dir, "labels"), docs["source"]))


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(encode_ordered(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end=2), folder)
    return read_tokens(spark, folder, raw=True).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_decontamination, op2_topk, op3_lm_scores, op4_substring_dedup, op5_licenses, op6_quality, op7_urls, op8_bpe, op9_jaccard, op10_sharding, op11_conversations, op12_filter_audit, op13_token_files]
    return {f.__name__: f for f in own}


_SQL1 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, len AS n, list_aggregate(w[s : s + len - 1], 'string_agg', ' ') AS key
  FROM (SELECT item, w, least(len(w), 10) AS len, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, s, n, list_aggregate(w[s : s + n - 1], 'string_agg', ' ') AS key
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, s, dw.n AS n, item FROM dw JOIN win ON dw.n = win.n AND dw.key = win.key),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + n - 1)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_SQL2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_SQL3 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, unnest(ws) AS w, unnest(generate_series(1, len(ws))) AS i FROM d WHERE len(ws) > 0),
g AS (SELECT doc_id, w, i, lag(w) OVER (PARTITION BY doc_id ORDER BY i) AS before, count(*) OVER (PARTITION BY doc_id) AS own FROM p),
u AS (SELECT w, count(*) AS c FROM p GROUP BY w), ud AS (SELECT doc_id, w, count(*) AS c FROM p GROUP BY ALL),
b AS (SELECT before, w, count(*) AS c FROM g WHERE before IS NOT NULL GROUP BY ALL), bd AS (SELECT doc_id, before, w, count(*) AS c FROM g WHERE before IS NOT NULL GROUP BY ALL),
x AS (SELECT g.doc_id, g.before, (SELECT count(*) FROM p) - g.own AS others, u.c - ud.c AS c1, ub.c - ubd.c AS cb, coalesce(b.c - bd.c, 0) AS c2
  FROM g JOIN u USING (w) JOIN ud ON ud.doc_id = g.doc_id AND ud.w = g.w
  LEFT JOIN u ub ON ub.w = g.before LEFT JOIN ud ubd ON ubd.doc_id = g.doc_id AND ubd.w = g.before
  LEFT JOIN b ON b.before = g.before AND b.w = g.w LEFT JOIN bd ON bd.doc_id = g.doc_id AND bd.before = g.before AND bd.w = g.w),
y AS (SELECT *, CASE WHEN c1 > 0 THEN CAST(c1 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END / greatest(others, 1) AS one FROM x),
z AS (SELECT doc_id, others, CASE WHEN before IS NULL THEN c1 > 0 ELSE c2 > 0 END AS seen,
  CASE WHEN before IS NULL THEN one WHEN c2 > 0 THEN CAST(c2 AS DOUBLE) / greatest(cb, 1) ELSE CAST(0.4 AS DOUBLE) * one END AS v FROM y),
s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (seen AND others > 0) AS n_seen, sum(CASE WHEN others > 0 THEN CAST(round_even(1e6 * ln(v), 0) AS BIGINT) ELSE 0 END) AS score_micro FROM z GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, CAST(coalesce(score_micro, 0) AS BIGINT) AS score_micro FROM d LEFT JOIN s USING (doc_id)
"""

_SQL4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, md5(list_aggregate(w[s : s + 19], 'string_agg', ' ')) AS key FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 19)) AS s FROM d WHERE len(w) >= 20)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY key ORDER BY doc_id, s) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS p FROM again),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
m AS (SELECT doc_id, w, p FROM (SELECT doc_id, unnest(w) AS w, unnest(generate_series(1, len(w))) AS p FROM d JOIN g USING (doc_id)) x ANTI JOIN gone USING (doc_id, p)),
k AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS kept FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN coalesce(list_aggregate(w, 'string_agg', ' '), '') ELSE coalesce(kept, '') END) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN k USING (doc_id)
"""


def _sql5() -> str:
    from barquet.llm.licenses import LICENSES

    def canonical(text: str) -> str:
        quoted = [x.replace("'", "''") for x in (COPYRIGHT_LINE, TITLE_LINE)]
        out = f"translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
        out = f"regexp_replace(regexp_replace({out}, '{quoted[0]}', '', 'g'), '{quoted[1]}', '')"
        out = f"concat(' ', regexp_replace({out}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+', '  ', 'g'), ' ')"
        for spelling, one in EQUIVALENT.items():
            out = f"replace({out}, ' {spelling.replace(' ', '  ')} ', ' {one.replace(' ', '  ')} ')"
        return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"

    known = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in LICENSES.items())
    return f"""
WITH known AS (SELECT sha256(c) AS digest, min(license_id) AS license_id FROM (SELECT license_id, {canonical("text")} AS c FROM (VALUES {known}) t(license_id, text)) WHERE c <> '' GROUP BY 1),
d AS (SELECT doc_id, sha256({canonical("text")}) AS digest FROM documents)
SELECT doc_id, digest, license_id FROM d LEFT JOIN known USING (digest)
"""


_SQL7 = r"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
rules AS (SELECT * FROM (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')) t(h, p, v)),
hit AS (SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h) DESC, length(p) DESC) AS r
  FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM u LEFT JOIN (SELECT * FROM hit WHERE r = 1) USING (page_id)
"""

_SQL9 = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, hash(list_aggregate(w[s : s + 2], 'string_agg', ' ')) AS h FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
sn AS (SELECT doc_id, h, n FROM sh JOIN n USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM sn a JOIN sn b ON a.h = b.h AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs WHERE 100 * c >= 90 * (na + nb - c)),
bi AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS x, a AS y FROM bi UNION SELECT x, b FROM reach JOIN bi ON y = a),
comp AS (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(c, d.doc_id) AS component_id FROM d LEFT JOIN n USING (doc_id) LEFT JOIN comp USING (doc_id)
"""


_SQL11 = r"""
WITH RECURSIVE crc AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS tbl FROM range(256) g(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' ')) AS key FROM conversations),
h AS (SELECT k.*, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(tbl[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS what FROM k, crc),
w AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM h, generate_series(1, CASE WHEN what = 3 THEN 2 ELSE 1 END) WHERE what <> 0),
f AS (SELECT conv_id AS c, turn, role, text, left(role, 1) AS ini, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, trim(text, E' \t\n\x0B\f\r') = '' AS blank,
  CASE WHEN right(rtrim(text, E' \t\n\x0B\f\r'), 1) IN ('.', '!', '?') THEN 0 ELSE 1 END AS late FROM w),
g AS (SELECT *, blank OR dup AS gone FROM (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS dup FROM f)),
pair AS (SELECT c, ini || lead(ini) OVER (PARTITION BY c ORDER BY i) AS p FROM f),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (dup AND NOT blank) AS duplicate, count(*) FILTER (late = 1 AND NOT gone) AS truncated FROM g GROUP BY c),
ill AS (SELECT c, count(*) FILTER (p NOT IN ('su', 'ua', 'au')) AS illegal FROM pair GROUP BY c),
back AS (SELECT c, n + 1 AS i, [0, 4, 2, 0] AS v FROM n
  UNION ALL SELECT c, i, [least(w[1], 2 + w[3], 4 + w[4]), least(w[2], 2 + w[3], 4 + w[4]), least(w[3], 2 + w[4]), least(w[4], 2 + w[3])] FROM (
    SELECT b.c, g.i, CASE WHEN gone THEN [3 + v[1], 3 + v[2], 3 + v[3], 3 + v[4]] ELSE [
      least(3 + v[1], CASE ini WHEN 's' THEN late + least(v[2], 2 + v[3]) WHEN 'u' THEN late + v[3] ELSE 2 + late + v[3] END),
      least(3 + v[2], late + v[3] + CASE WHEN ini = 'u' THEN 0 ELSE 2 END), least(3 + v[3], late + v[4] + CASE WHEN ini = 'a' THEN 0 ELSE 2 END), least(3 + v[4], late + v[3] + CASE WHEN ini = 'u' THEN 0 ELSE 2 END)] END AS w
    FROM back b JOIN g ON g.c IS NOT DISTINCT FROM b.c AND g.i = b.i - 1)),
walk AS (SELECT c, CAST(1 AS BIGINT) AS i, 0 AS s, '' AS audit, '' AS body, false AS begun FROM n
  UNION ALL SELECT c, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND ini = 's' THEN 1 WHEN s = 2 THEN 3 ELSE 2 END, audit || e,
    CASE WHEN e = 'D' THEN body ELSE body || CASE WHEN begun THEN chr(10) ELSE '' END || CASE WHEN e = 'K' THEN role WHEN s = 2 THEN 'assistant' ELSE 'user' END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END, begun OR e <> 'D'
  FROM (SELECT x.*, g.role, g.text, g.ini, CASE WHEN x.i = n + 1 THEN 'I' WHEN 3 + b1.v[s + 1] = b.v[s + 1] THEN 'D' WHEN 2 + b.v[CASE WHEN s = 2 THEN 4 ELSE 3 END] = b.v[s + 1] THEN 'I'
      WHEN (CASE s WHEN 0 THEN ini IN ('s', 'u') WHEN 2 THEN ini = 'a' ELSE ini = 'u' END) AND late + b1.v[CASE ini WHEN 's' THEN 2 WHEN 'u' THEN 3 ELSE 4 END] = b.v[s + 1] THEN 'K' ELSE 'R' END AS e
    FROM walk x JOIN n ON n.c IS NOT DISTINCT FROM x.c JOIN back b ON b.c IS NOT DISTINCT FROM x.c AND b.i = x.i
    LEFT JOIN g ON g.c IS NOT DISTINCT FROM x.c AND g.i = x.i LEFT JOIN back b1 ON b1.c IS NOT DISTINCT FROM x.c AND b1.i = x.i + 1 WHERE x.i <= n OR s IN (1, 2))),
done AS (SELECT x.c, audit, sha256(body) AS sha FROM walk x JOIN n ON n.c IS NOT DISTINCT FROM x.c AND x.i = n + 1 AND s IN (0, 3))
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(v[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN n ON n.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN ill ON ill.c IS NOT DISTINCT FROM o.conv_id
LEFT JOIN back b ON b.c IS NOT DISTINCT FROM o.conv_id AND b.i = 1 LEFT JOIN done d ON d.c IS NOT DISTINCT FROM o.conv_id
"""

_SQL12 = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
firsts AS (SELECT coalesce(text, '') AS t, min(doc_id) AS first FROM documents GROUP BY 1),
marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
  + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first THEN 16 ELSE 0 END AS mask
  FROM d JOIN firsts USING (t) LEFT JOIN marks USING (doc_id)),
cells AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
fil AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) x(l, b)),
orders AS (SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.b, b.b, c.b, d.b, e.b] AS bs FROM fil a JOIN fil b ON b.b <> a.b JOIN fil c ON c.b NOT IN (a.b, b.b) JOIN fil d ON d.b NOT IN (a.b, b.b, c.b) JOIN fil e ON e.b NOT IN (a.b, b.b, c.b, d.b)),
steps AS (SELECT filter_order, CAST(k AS INTEGER) AS step, bs[k] AS own, CAST(coalesce(list_sum(bs[1 : k - 1]), 0) AS INTEGER) AS before FROM orders, generate_series(1, 5) g(k)),
x AS (SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (mask & (own | before) = 0), 0) AS kept, coalesce(sum(n) FILTER (mask & own > 0 AND mask & before = 0), 0) AS removed,
  coalesce(sum(n) FILTER (mask & own > 0 AND mask & before > 0), 0) AS redundant, coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails,
  coalesce(sum(good) FILTER (mask & own > 0 AND mask & before = 0), 0) AS good_lost, coalesce(sum(toxic) FILTER (mask & own > 0 AND mask & before = 0), 0) AS toxic_lost
  FROM cells, steps GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
  CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM x
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the same rows. None for op6 (a fitted model), op8 and op13 (tokenizers) and op10 (a placement that hashes decide)."""
    return {"op1_decontamination": _SQL1, "op2_topk": _SQL2, "op3_lm_scores": _SQL3, "op4_substring_dedup": _SQL4, "op5_licenses": _sql5(), "op7_urls": _SQL7, "op9_jaccard": _SQL9, "op11_conversations": _SQL11, "op12_filter_audit": _SQL12}
