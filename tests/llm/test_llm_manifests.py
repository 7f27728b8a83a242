"""Merkle manifest, fingerprints and collocations against brute-force versions."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from allelic.llm import collocations, fingerprint, merkle, queries, ranks

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 997} Item{i % 89}." for i in range(30_000))
    data = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, long, "en", "a", 5), (3, long, "en", "a", 5), (4, " \n\t ", "de", None, 1),
        (5, "One two three four five six seven", None, "b", 9), (None, "one two three four five six", "en", "b", 9), (None, None, "en", "b", None), (6, "one two", "en", "a", 7),
        (6, "two one", "en", "a", 7), (7, "???!!! 12345 \U0001f600 \x00 x", "en", "", 3), (8, "é ß İ", "", "b", None), (9, "a\tb c.d e\x0bf a b c", "en", "b", 1),
    ]
    clash = ["path", "root", "position", "rows", "block", "digest", "leaf", "top", "way", "whole", "sketch", "edited", "half", "head", "rank", "phrase", "n", "window", "key", "part"]
    return spark.createDataFrame(data, DOC).select("*", *(F.lit("clash").alias(c) for c in clash))


def given(monkeypatch, docs):
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: docs)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- Merkle manifest --------------------------------------------------------------------------------


def folds(leaves, arity):
    """Root and, for each leaf, its siblings from the bottom up."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        runs = [level[i : i + arity] for i in range(0, len(level), arity)]
        for leaf, place in enumerate(at):
            run = runs[place // arity]
            proofs[leaf] += run[: place % arity] + run[place % arity + 1 :]
            at[leaf] = place // arity
        level = [h(*run) for run in runs]
    return level[0], proofs


@pytest.mark.parametrize("arity, levels, sizes", [(2, 2, (1, 2, 21, 64)), (3, 1, (5, 28)), (2, 10, (3, 5, 33)), (4, 2, (67,))])
def test_tree_of_several_rounds(spark, arity, levels, sizes):
    rows = [(g or None, i, h(str(g), str(i))) for g, n in enumerate(sizes) for i in range(n)]
    df = spark.createDataFrame(rows, "g int, i int, leaf string").withColumn("g", F.col("g").cast("string")).repartition(7)
    found = merkle.manifest(df, "g", "i", arity, levels)
    found = found.select("g", "i", "leaf", "subroot", "root", merkle.as_hex(F.col("path")).alias("hexed"), merkle.folded("leaf", arity=arity).alias("folded"), merkle.folded(F.sha2("leaf", 256), arity=arity).alias("wrong"))
    want, tops = {}, []
    for g, n in enumerate(sizes):
        root, proofs = folds([h(str(g), str(i)) for i in range(n)], arity)
        tops.append(root)
        want |= {(str(g) if g else None, i): (root, proofs[i]) for i in range(n)}
    root, above = folds(tops, arity)
    got = found.collect()
    assert len(got) == sum(sizes)
    for r in got:
        subroot, proof = want[r.g, r.i]
        assert (r.subroot, r.root, r.hexed) == (subroot, root, "".join(proof + above[int(r.g or 0)]))
        assert r.folded == root != r.wrong


def test_manifest_of_odd_rows(spark, odd, monkeypatch):
    given(monkeypatch, odd)
    got = queries.op11_merkle(spark, "").collect()
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = defaultdict(list)
    for r in odd.collect():
        leaf = h(*(enc(r[c]) for c in ("doc_id", "source", "lang", "n_chars", "text")))
        groups[r.lang].append((r.doc_id is not None, r.doc_id or 0, leaf))
    tops, want = [], []
    for lang in sorted(groups, key=lambda x: (x is not None, (x or "").encode())):
        leaves = sorted(groups[lang])
        root, proofs = folds([x[2] for x in leaves], 2)
        tops.append(root)
        want.append((leaves, proofs, root))
    root, above = folds(tops, 2)
    flat = sorted((x[2], sub, root, h(*p, *above[k])) for k, (leaves, proofs, sub) in enumerate(want) for x, p in zip(leaves, proofs))
    assert sorted((r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == flat
    changed = lambda r: r.doc_id is not None and __import__("zlib").crc32(str(r.doc_id).encode()) % 7 == 0
    for r in got:
        assert r.verified == (r.folded_root == r.root)
        assert changed(r) or r.verified
    # A null n_chars stays null, so that row still verifies; any other changed row does not.
    known = {r.doc_id: r.n_chars for r in odd.collect()}
    assert all(r.verified == (known[r.doc_id] is None) for r in got if changed(r))


def test_manifest_of_no_rows(spark, odd, monkeypatch):
    given(monkeypatch, odd.limit(0))
    assert queries.op11_merkle(spark, "").count() == 0
    given(monkeypatch, odd.filter("doc_id = 7"))
    assert [r.subroot == r.root == r.leaf and r.proof_sha256 == h() for r in queries.op11_merkle(spark, "").collect()] == [True]


def test_positions_of_one_large_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("g"), (F.col("id") * 7919 % 5003).alias("x"))
    got = ranks.numbered(df.repartition(9), ["g"], [F.desc("x")]).collect()
    for g in ("small", "large"):
        xs = sorted((r.x for r in got if r.g == g), reverse=True)
        assert {r.x: r.position for r in got if r.g == g} == {x: i for i, x in enumerate(xs)}
        assert {r.rows for r in got if r.g == g} == {len(xs)}


# --- fingerprints -----------------------------------------------------------------------------------


def sketch(text, scale=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    runs = [words[i : i + 5] for i in range(len(words) - 4)] or ([words] if words else [])
    hashes = {hashlib.md5(" ".join(r).encode()).hexdigest()[:16] for r in runs}
    return sorted(x for x in hashes if int(x, 16) < 2**64 // scale) or sorted(hashes)[:1]


def like(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def test_fingerprints_of_odd_rows(spark, odd, monkeypatch):
    given(monkeypatch, odd)
    rows = [(r.doc_id, r.text or "") for r in odd.collect()]
    rows.sort(key=lambda r: (int.from_bytes(xxhash.xxh64_digest(r[1].encode(), 42), "big", signed=True), r[1]))
    rows.sort(key=lambda r: (r[0] is None, -(r[0] or 0)))
    want = []
    for (doc, text), (_, after) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = sketch(text), sketch(edited), sketch(after)
        want.append((doc, len(text), h(edited), "".join(a), "".join(b), like(a, b), like(a, c)))
    got = [tuple(r) for r in queries.op12_fingerprint(spark, "").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    given(monkeypatch, odd.limit(0))
    assert queries.op12_fingerprint(spark, "").count() == 0
    given(monkeypatch, odd.filter("doc_id = 5"))
    assert [(r.near_edited < 1, r.near_next) for r in queries.op12_fingerprint(spark, "").collect()] == [(True, 1.0)]


def test_sketches_merge_and_estimate_containment(spark):
    """A part of a text a hundred times longer: containment is near 1 one way and near 0.01 the other."""
    words = [f"w{i * 7919 % 100_003}" for i in range(60_000)]
    a, b, part = " ".join(words[:30_004]), " ".join(words[30_000:]), " ".join(words[1000:1604])
    df = spark.createDataFrame([(a, b, part, " ".join(words))], "a string, b string, part string, whole string")
    s = df.select(*(fingerprint.sketch(c).alias(c) for c in df.columns))
    got = s.select(
        fingerprint.merge("a", "b").alias("merged"), "whole", fingerprint.containment("part", "whole").alias("inside"), fingerprint.containment("whole", "part").alias("over"),
        fingerprint.containment("a", "whole").alias("half"), fingerprint.likeness("a", "whole").alias("like"), fingerprint.unpacked(fingerprint.packed("a")).alias("again"), "a",
    ).first()
    assert got.merged == got.whole and got.again == got.a
    assert got.inside == 1.0 and got.half == 1.0
    assert 0.006 < got.over < 0.014 and 0.47 < got.like < 0.53


def test_blocks_of_few_rows(spark):
    """Any number of blocks gives the same rows."""
    docs = spark.createDataFrame([(i // 3 if i % 7 else None, f"text {i % 11} of {i} and more words {i * i}") for i in range(200)], "doc_id long, text string")
    got = [sorted(map(tuple, fingerprint.against_edits(docs.repartition(3), block_bytes=b).collect()), key=repr) for b in (1 << 30, 64, 500)]
    assert got[0] == got[1] == got[2] and len(got[0]) == 200


def test_fingerprints_are_native(spark, odd):
    plan = fingerprint.against_edits(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|ArrowEval|MapInArrow|MapInPandas", plan)


# --- collocations -----------------------------------------------------------------------------------


def mined(docs, least, inside=80, first=2000):
    """All phrases of all texts in one table, straight from the definition."""
    f, total = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate({c: c + 32 for c in range(65, 91)})):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {k: n for k, n in f.items() if n >= least and len(k[1]) > 1}
    dropped = {(lang, g[i : i + k]) for (lang, g), m in found.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * m >= inside * f[lang, g[i : i + k]]}
    rows = defaultdict(list)
    for (lang, g), a in found.items():
        if (lang, g) not in dropped:
            cuts = [(2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return [(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, all_ in rows.items() for i, (s, a, p, left, right) in enumerate(sorted(all_)[:first], 1)]


@pytest.mark.parametrize("held", [1, 3, 7, 50])
def test_windows_of_cut_texts(held):
    """Texts cut anywhere have the windows of the whole text."""
    data = "  One two\tTHREE  four,five. six\x0bseven eight nine ten eleven twelve;; a ! é ß\n\n b c".encode() * 3
    want = Counter()
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", data.decode().translate({c: c + 32 for c in range(65, 91)})):
        words = re.findall(r"[^\x20\x09]+", piece)
        want.update(" ".join(words[i : i + 4]) + " " for i in range(len(words)))
    got = Counter()
    for part in collocations.cut(data, held):
        got.update(collocations.windows_of(*part).to_pylist())
    assert got == want


@pytest.mark.parametrize("parts", [1, 23])
def test_collocations_of_odd_rows(spark, odd, parts):
    """Few rows over many parts put most phrases across a border."""
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        settings = collocations.Settings(least=2, first=100)
        got = [tuple(r) for r in collocations.mine(odd.repartition(5), settings).collect()]
        assert sorted(got) == sorted(mined([(r.text, r.lang) for r in odd.collect()], 2, first=100))
        assert collocations.mine(odd.limit(0)).count() == 0
        assert collocations.mine(odd.filter("text IS NULL OR text = ''")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_collocations_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = [tuple(r) for r in queries.op13_collocations(spark, sf_dir).collect()]
    assert got and sorted(got) == sorted(mined([(r.text, r.lang) for r in docs.collect()], 30))


def test_scores_beyond_64_bits(spark):
    """Counts whose products with the scale pass 64 bits."""
    n = 9_000_000_000_000
    frame = spark.createDataFrame([(n, n + 1, n - 1)], "a long, l long, r long")
    got = frame.select(F.expr("(CAST(2000000 AS DECIMAL(7, 0)) * CAST(a AS DECIMAL(20, 0))) div (CAST(l AS DECIMAL(20, 0)) + CAST(r AS DECIMAL(20, 0)))")).first()[0]
    assert got == 2_000_000 * n // (2 * n)


# --- WARC query -------------------------------------------------------------------------------------


def test_warc_query_of_odd_pages(spark, tmp_path):
    """Null ids and payloads through the query itself: a null id revisits the largest id of its payload."""
    same = "x" * 1200
    data = [(None, "u", same), (3, None, same), (5, "u", same), (None, "u", None), (8, "u", "")]
    spark.createDataFrame(data, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in queries.op1_warc(spark, str(tmp_path)).collect()}
    assert got == {(None, 1200, "revisit", 5), (3, 1200, "revisit", 5), (5, 1200, "response", None), (None, 0, "response", None), (8, 0, "response", None)}
