"""Queries over the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline

from . import bm25, bpe, collocations, fingerprint, language_id, merkle, mixing, ngram_join, pii, quality_pu, quality_rules, suffix_dedup, warc
from .common import documents


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    manifest = warc.write_archives(warc.mark_revisits(pages))
    back = warc.reassemble(warc.read_records(manifest, with_payload=False), with_payload=False)
    page = lambda c: F.substring_index(c, ":", -1).try_cast("long")
    return back.select(
        page("uri").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers").alias("refers_to"), "segments", "complete",
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs, path, public_tokenizers.PATTERN).drop("text")


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(documents(spark, sf_dir))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    # A null id belongs to no fold: it is not held out, and nothing is learned from it.
    docs = docs.withColumn("held_out", F.coalesce(language_id.fold(5) == 0, F.lit(False)))
    model = language_id.fit(docs.filter(language_id.fold(5) != 0))
    return language_id.predict(docs.select("doc_id", "text", "held_out"), model).drop("text")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(documents(spark, sf_dir))


def op6_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text").withColumn("held_out", F.coalesce(language_id.fold(3) == 1, F.lit(False)))
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(language_id.fold(3) != 1).filter("quality = 1")
    model = quality_pu.fit(docs.filter(language_id.fold(3) != 1), trusted)
    return quality_pu.score(docs, model).drop("text")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.counts(pii.find(documents(spark, sf_dir).select("doc_id", "text")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return quality_rules.clean_lines(docs).drop("text", "clean_text")


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return bm25.search(docs, docs.filter("doc_id % 50 = 0"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    leaf = lambda n_chars: merkle.row_digest("doc_id", "source", "lang", n_chars, "text")
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    rows = docs.select("doc_id", "lang", leaf("n_chars").alias("leaf"), F.when(changed, leaf(F.col("n_chars") + 1)).alias("tampered"))
    found = merkle.manifest(rows, "lang", "doc_id")
    found = found.withColumn("folded_root", merkle.folded(F.coalesce("tampered", "leaf")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(merkle.as_hex(F.col("path")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op12_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.against_edits(documents(spark, sf_dir))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(documents(spark, sf_dir))


def queries() -> dict:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return found | {"pipeline": corpus_pipeline.run}


OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
k AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p),
h AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to,
  CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN 1 ELSE CAST(ceil((87 + payload_bytes
    + 7 * (payload_bytes // 4096) + CASE WHEN payload_bytes % 4096 > 0 THEN 4 + length(printf('%x', payload_bytes % 4096)) ELSE 0 END + 5) / 16384.0) AS INTEGER) END AS segments,
  true AS complete
FROM h
"""

OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('17|' || CAST(doc_id AS VARCHAR)) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 3 AS cap FROM s),
l AS (SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM r),
t AS (SELECT *, least(weight * (SELECT max(level) FROM l WHERE level <= ratio), CAST(cap AS DOUBLE)) AS target FROM l),
b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
c AS (SELECT d.*, b.source_size, b.target, b.budget,
    CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS BIGINT) AS before
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
  CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
  + greatest(0, least(size, budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before)) AS taken
FROM c
"""

_LINE_PASS = """NOT (100 * length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) > 10 * chars)
   AND NOT (100 * len(regexp_extract_all(line || ' ', '!![\\x20\\x09-\\x0D]')) > 30 * n)
   AND NOT (n < 4 AND NOT contains('.!?:;"'')]…»”', last_char))
   AND NOT (length(regexp_replace(line, '[^|»›·>]', '', 'g')) >= 2 AND n <= 4 * (length(regexp_replace(line, '[^|»›·>]', '', 'g')) + 1))
   AND NOT regexp_matches(lower(line), 'all rights reserved|cookie policy|enable javascript|privacy policy|sign in to continue|subscribe to our newsletter|terms of service|terms of use')"""

OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c >= 2),
n3 AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l0 AS (SELECT doc_id, ls[k] AS line, k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM d))),
l AS (SELECT doc_id, line, k, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars,
    right(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g'), 1) AS last_char FROM l0),
v AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) > 1 AS dup, {_LINE_PASS} AS ok FROM l WHERE n > 0),
a AS (SELECT doc_id, count(*) FILTER (dup) AS n_dup_lines, coalesce(sum(chars), 0) AS total, coalesce(sum(chars) FILTER (ok), 0) AS good FROM v GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(total, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(good, 0) AS good
  FROM w LEFT JOIN n3 USING (doc_id) LEFT JOIN a USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * good >= 50 * word_chars AS kept
FROM f
"""


OP10_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(ws) AS w FROM d) GROUP BY doc_id, w),
l AS (SELECT doc_id, len(ws) AS words FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS docs, CAST(sum(words) AS DOUBLE) / count(*) AS mean FROM l),
f AS (SELECT w, ln(1 + (docs - df + CAST(0.5 AS DOUBLE)) / (df + CAST(0.5 AS DOUBLE))) AS idf FROM (SELECT w, count(*) AS df FROM p GROUP BY w), s),
i AS (SELECT doc_id, w, n * CAST(2.2 AS DOUBLE) / (n + CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) * words / mean)) AS impact FROM p JOIN l USING (doc_id), s),
q AS (SELECT doc_id AS query_id, w, idf FROM p JOIN f USING (w) WHERE doc_id % 50 = 0),
r AS (SELECT query_id, i.doc_id, CAST(sum(CAST(round(idf * impact * 1099511627776) AS HUGEINT)) AS DOUBLE) AS scaled FROM q JOIN i USING (w) GROUP BY query_id, i.doc_id),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY scaled DESC, doc_id) AS INTEGER) AS rank FROM r)
SELECT query_id, rank, doc_id, round(scaled / 1099511627776, 6) AS score FROM k WHERE rank <= 10
"""


_ENCODED = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
_LEAF = lambda n: "sha256(" + " || ".join(map(_ENCODED, ("doc_id", "source", "lang", n, "text"))) + ")"
_CRC32 = """xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""

OP11_SQL = f"""
WITH RECURSIVE l AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, CASE WHEN {_CRC32} % 7 = 0 THEN {_LEAF("n_chars + 1")} END AS tampered FROM documents),
v AS MATERIALIZED (SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM l),
n1 AS (SELECT lang, 0 AS lev, idx, n AS cnt, leaf AS digest FROM v
  UNION ALL SELECT lang, lev + 1, idx // 2, (cnt + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM n1 WHERE cnt > 1 GROUP BY lang, lev, idx // 2, cnt),
sub AS MATERIALIZED (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM n1 WHERE cnt = 1),
n2 AS (SELECT 0 AS lev, idx, n AS cnt, subroot AS digest FROM sub
  UNION ALL SELECT lev + 1, idx // 2, (cnt + 1) // 2, sha256(string_agg(digest, '' ORDER BY idx)) FROM n2 WHERE cnt > 1 GROUP BY lev, idx // 2, cnt),
f1 AS (SELECT rid, lang, 0 AS lev, idx, n AS cnt, coalesce(tampered, leaf) AS cur, '' AS proof FROM v
  UNION ALL SELECT f.rid, f.lang, f.lev + 1, f.idx // 2, (f.cnt + 1) // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.digest || f.cur ELSE f.cur || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
  FROM f1 f LEFT JOIN n1 s ON s.lang IS NOT DISTINCT FROM f.lang AND s.lev = f.lev AND s.idx = f.idx + 1 - 2 * (f.idx % 2) WHERE f.cnt > 1),
f2 AS (SELECT rid, 0 AS lev, sub.idx, sub.n AS cnt, cur, proof FROM f1 JOIN sub ON sub.lang IS NOT DISTINCT FROM f1.lang WHERE f1.cnt = 1
  UNION ALL SELECT f.rid, f.lev + 1, f.idx // 2, (f.cnt + 1) // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.digest || f.cur ELSE f.cur || coalesce(s.digest, '') END), f.proof || coalesce(s.digest, '')
  FROM f2 f LEFT JOIN n2 s ON s.lev = f.lev AND s.idx = f.idx + 1 - 2 * (f.idx % 2) WHERE f.cnt > 1),
top AS (SELECT digest AS root FROM n2 WHERE cnt = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified
FROM v JOIN f2 USING (rid) JOIN sub ON sub.lang IS NOT DISTINCT FROM v.lang, top WHERE f2.cnt = 1
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC NULLS LAST, text) - 1 AS p, count(*) OVER () AS c FROM documents),
e AS (SELECT a.doc_id, a.text, b.text AS next_text, left(a.text, length(a.text) - length(a.text) // 2) || left(b.text, length(a.text) // 2) AS edited FROM d a JOIN d b ON b.p = (a.p + 1) % a.c),
w AS (SELECT text, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS ws FROM (SELECT text FROM d UNION SELECT edited FROM e)),
h AS (SELECT text, CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: left(md5(array_to_string(ws[i : i + 4], ' ')), 16)) WHEN len(ws) > 0 THEN [left(md5(array_to_string(ws, ' ')), 16)] ELSE [] END AS hs FROM w),
s AS (SELECT text, CASE WHEN len(hs) = 0 OR len(list_filter(hs, lambda x: x < '4000000000000000')) > 0 THEN list_sort(list_distinct(list_filter(hs, lambda x: x < '4000000000000000'))) ELSE [list_min(hs)] END AS sk FROM h)
SELECT doc_id, CAST(length(e.text) AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, coalesce(array_to_string(a.sk, ''), '') AS fingerprint, coalesce(array_to_string(b.sk, ''), '') AS edited_fingerprint,
  CASE WHEN len(a.sk) + len(b.sk) = 0 THEN 1e0 ELSE len(list_intersect(a.sk, b.sk)) / CAST(len(a.sk) + len(b.sk) - len(list_intersect(a.sk, b.sk)) AS DOUBLE) END AS near_edited,
  CASE WHEN len(a.sk) + len(c.sk) = 0 THEN 1e0 ELSE len(list_intersect(a.sk, c.sk)) / CAST(len(a.sk) + len(c.sk) - len(list_intersect(a.sk, c.sk)) AS DOUBLE) END AS near_next
FROM e JOIN s a ON a.text = e.text JOIN s b ON b.text = e.edited JOIN s c ON c.text = e.next_text
"""

OP13_SQL = rf"""
WITH p AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (SELECT lang, ws[i : i + k - 1] AS g FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM p) q, range(1, 5) r(k) WHERE i + k - 1 <= len(ws)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS n FROM g GROUP BY lang, g HAVING count(*) >= 30),
c AS (SELECT * FROM f WHERE len(g) > 1),
x AS (SELECT c.lang, c.g, c.n AS a, k, l.n AS l, r.n AS r, CAST(2000000 AS HUGEINT) * c.n // (CAST(l.n AS HUGEINT) + r.n) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c JOIN f l ON l.lang = c.lang AND l.g = c.g[1 : k] JOIN f r ON r.lang = c.lang AND r.g = c.g[k + 1 :]),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
i AS (SELECT lang, g[i : i + k - 1] AS g, max(n) AS m FROM (SELECT *, unnest(range(1, len(g) + 1)) AS i FROM c) q, range(2, 4) r(k) WHERE i + k - 1 <= len(g) AND k < len(g) GROUP BY ALL),
z AS (SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM b LEFT JOIN i USING (lang, g) WHERE m IS NULL OR CAST(100 AS HUGEINT) * m < CAST(80 AS HUGEINT) * a),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM p GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM z JOIN t USING (lang) QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": OP1_SQL, "op8_mixing": OP8_SQL, "op9_quality_rules": OP9_SQL, "op10_topk_search": OP10_SQL,
        "op11_merkle": OP11_SQL, "op12_fingerprint": OP12_SQL, "op13_collocations": OP13_SQL,
    }
