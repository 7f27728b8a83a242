import hashlib
import time
import io
import json
import random
from collections import Counter, defaultdict

import brute
import duckdb
import numpy as np
import public_tokenizers as tokenizers
import pyarrow.fs as fs
import pytest
import tiktoken
from pyspark.sql import functions as F

from allelic.llm import bm25, bpe, language_id, mixing, ngram_join, pii, quality_pu, quality_rules, queries, suffix_dedup, warc
from allelic.llm.shingles import shingle_sets

DOC = "doc_id long, text string, lang string, source string, n_chars long"
PATH = tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def rows(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing extra columns."""
    long = " ".join(f"word{i % 997} item{i % 89}." for i in range(30_000))
    mail = "Write to a.b@mail.example.com or +1 (523) 555-1055 now, card 4111 1111 1111 1111 at 10.0.0.255."
    data = [
        (1, None, "en", "a", None), (2, "", None, None, 0), (3, long, "en", "a", 5), (3, long, "en", "a", 5),
        (4, " \n\t ", "de", None, 1), (5, mail, None, "b", 9), (None, mail, "en", "b", 9), (6, "one two", "en", "a", 7),
        (6, "two one", "en", "a", 7), (7, "???!!! 12345 \U0001f600", "en", "", 3), (8, mail + " more", "en", "b", None),
    ]
    clash = ["n_words", "kept", "size", "taken", "score", "rejected", "spans", "base", "node", "comp", "token", "k1", "ranges", "term", "rank", "tokens", "epoch", "key"]
    df = spark.createDataFrame(data, DOC)
    return df.select("*", *(F.lit("clash").alias(c) for c in clash))


def tuples(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


# --- WARC ---------------------------------------------------------------------------------------


def test_warc_null_ids_and_clashes(spark):
    """Null ids revisit the largest id; of null ids alone all stay; longest texts and clashing columns play no part."""
    same, other, long = "x" * 1000, "y" * 1000, "z" * 3_000_000
    data = [(None, same), (None, same), (5, same), (4, same), (None, other), (None, other), (7, long), (8, long), (9, "x" * 999), (10, "x" * 999), (None, None)]
    pages = spark.createDataFrame(data, "page_id long, html string").select("*", *(F.lit("clash").alias(c) for c in ("id", "payload", "digest", "holder", "uri")))
    got = Counter((r.page_id, len(r.html or ""), r.refers) for r in warc.mark_revisits(pages).collect())
    assert got == Counter({
        (None, 1000, "page:5"): 2, (5, 1000, None): 1, (4, 1000, "page:5"): 1, (None, 1000, None): 2, (7, 3_000_000, "page:8"): 1,
        (8, 3_000_000, None): 1, (9, 999, None): 1, (10, 999, None): 1, (None, 0, None): 1,
    })
    back = warc.reassemble(warc.read_records(warc.write_archives(warc.mark_revisits(pages)), with_payload=False), with_payload=False)
    assert Counter(r.payload_bytes for r in back.collect()) == Counter(len(h or "") for _, h in data)


def test_warc_round_trip(spark):
    big = "<p>Größe</p>" * 9000
    data = [(1, big), (2, "x" * 1000), (3, "x" * 1000), (4, "y" * 999), (5, "y" * 999), (6, None), (7, ""), (3, "x" * 1000), (8, "a\r\n0\r\n\r\nb\0" * 500)]
    pages = spark.createDataFrame(data, "page_id long, html string")
    manifest = warc.write_archives(warc.mark_revisits(pages), segment=5000, chunk=700)
    back = warc.reassemble(warc.read_records(manifest)).collect()
    assert all(r.complete for r in back)
    got = sorted((int(r.uri[5:]), r.payload_bytes, r.record_type, r.refers, r.payload_digest) for r in back)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    kinds = {2: ("revisit", "page:3")}
    assert got == sorted((i, len((t or "").encode()), *kinds.get(i, ("response", None)), sha(t)) for i, t in data)
    texts = Counter((int(r.uri[5:]), r.payload.decode()) for r in back if r.record_type == "response")
    assert texts == Counter((i, t or "") for i, t in data if i not in kinds)
    assert max(r.segments for r in back) == -(-len(warc.chunked(big.encode(), 700) + b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n") // 5000)


def test_warc_faults_are_marked(spark):
    payload = b"<html>" + b"z" * 9000
    records = list(warc.records_of("k", "page:1", payload, hashlib.sha1(payload).hexdigest(), None, 1000, 300))
    segments = [warc.parse(r) for r in records]
    shuffled = segments[::-1]
    assert warc.payload_of(shuffled)[4] == payload and warc.payload_of(shuffled)[-1]
    assert warc.payload_of([*segments, segments[2]])[-1]  # a repeated record
    assert not warc.payload_of(segments[:-1])[-1]  # the end is missing
    assert not warc.payload_of(segments[1:])[-1]  # the origin is missing
    assert not warc.payload_of([*segments[:3], *segments[4:]])[-1]
    for bad in (b"zz\r\nabc", b"5\r\nabc", b"3\r\nabcX", b""):
        assert not warc.unchunked(bad)[1]
    assert warc.unchunked(b"3;x=1\r\nabc\r\n0\r\n\r\n") == (b"abc", True)


def test_warc_members_stream():
    import gzip

    parts = [b"a" * 10, b"", b"b" * 5000]
    data = b"".join(gzip.compress(p) for p in parts)
    assert list(warc.members(io.BytesIO(data), 7)) == parts
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(data[:-3]), 100))


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, html string")
    assert warc.reassemble(warc.read_records(warc.write_archives(warc.mark_revisits(pages)))).count() == 0


# --- BPE ----------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoding():
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_bpe_equals_tiktoken(rows, encoding):
    codec = bpe.Codec(PATH, tokenizers.PATTERN, memo=500)
    rng = random.Random(4)
    alphabet = "abetnsionr  \n\t!*#1290éöñ日本語́\U0001f600\"'stre"
    texts = [t for _, t in rows[:60]] + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(2000)]
    texts += ["a" * 5000, "ab" * 3000, " " * 700, "\n" * 300 + "x", "é" * 900]
    for text in texts:
        ids = codec.encode(text)
        assert ids == encoding.encode_ordinary(text)
        assert "".join(codec.decode_stream([str(i) for i in ids], chunk=3)) == text


def test_bpe_bounded_states(encoding, rows):
    small = bpe.Transducer(bpe.read_ranks(PATH), max_states=40, max_pairs=30)
    for piece in {w for _, t in rows[:20] for w in t.split()}:
        assert small.encode(piece.encode()) == encoding._encode_single_piece(piece)
    assert len(small.hypotheses) <= 40 and len(small.pairs) <= 30


def test_utf8_stream_holds_incomplete_characters():
    data = "aé日\U0001f600z".encode()
    for cut in range(len(data) + 1):
        stream = bpe.Utf8Stream()
        first = stream.push(data[:cut])
        assert first == data[:cut].decode("utf-8", "ignore")
        assert first + stream.push(data[cut:]) + stream.close() == data.decode()
    stream = bpe.Utf8Stream()
    assert stream.push(b"\xe6\x97") == "" and stream.close() == "�"


def test_bpe_query(spark, odd, docs):
    for df in (odd, docs):
        for r in bpe.round_trip(df, PATH, tokenizers.PATTERN).limit(30).collect():
            assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.tokenize(odd, PATH, tokenizers.PATTERN).count() == 11
    assert bpe.round_trip(odd.limit(0), PATH, tokenizers.PATTERN).count() == 0


# --- n-gram join ----------------------------------------------------------------------------------


def test_join_equals_brute_force(docs, rows):
    assert tuples(ngram_join.join(docs)) == sorted(brute.near_components(rows), key=repr)


def made_copies():
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(words) for _ in range(60)]
    out = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([3, 5, 40, 120]))] + passage * (g % 2)
        for c in range(rng.choice([1, 2, 30])):
            own = list(base)
            for _ in range(rng.randrange(4) if c else 0):
                own[rng.randrange(len(own))] = rng.choice(words)
            out.append(" ".join(own))
    return [(i * 7 % 1009, t) for i, t in enumerate(out)]


@pytest.mark.parametrize("settings", [ngram_join.Settings(), ngram_join.Settings(star_rounds=0), ngram_join.Settings(chunk_shingles=300, hot_list=3, verify_cost=5000), ngram_join.Settings(max_match=1, star_rounds=1)])
def test_join_of_made_copies(spark, settings):
    data = made_copies()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    assert tuples(ngram_join.join(df, settings)) == sorted(brute.near_components(data), key=repr)


@pytest.mark.parametrize("star_rounds", [0, 3])
@pytest.mark.parametrize("size", [11, 12])
def test_join_of_short_texts_without_lone_shingles(spark, size, star_rounds):
    # Each text is a window on a ring of words: all its shingles occur elsewhere, equally often, and
    # only windows next to each other are linked, by all shingles but one.
    rings = [[f"{r}w{i}" for i in range(20 + 5 * r)] for r in range(4)]
    data = list(enumerate(" ".join((ring * 2)[i : i + size]) for ring in rings for i in range(len(ring))))
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert tuples(ngram_join.join(df, ngram_join.Settings(star_rounds=star_rounds))) == sorted(brute.near_components(data), key=repr)


def test_join_odd_rows(odd):
    got = tuples(ngram_join.join(odd))
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 59996, 3), (3, 59996, 3), (4, 0, 4), (5, 11, 5), (None, 11, 5), (6, 1, 6), (6, 1, 6), (7, 1, 7), (8, 12, 5)], key=repr)
    assert ngram_join.join(odd.limit(0)).count() == 0


def test_shingles_of_batches():
    texts = ["a b c d e f a b c d e", "A b  C\td E", "x", "", None, "é ß 日 本 語 x"]
    sets = shingle_sets(texts)
    assert [len(s) for s in sets] == [len(brute.shingles(t)) for t in texts]
    assert sets[1][0] in sets[0] and not set(sets[0]) & set(sets[5])
    assert [list(x) for x in sets] == [list(shingle_sets([t])[0]) for t in texts]


# --- language ID ----------------------------------------------------------------------------------


def test_language_held_out(spark):
    df = queries.op4_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rows = df.join(docs, "doc_id").filter("held_out").collect()
    assert len(rows) > 100
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    assert sum(r.rejected for r in rows) / len(rows) < 0.02
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_odd_rows(spark, odd, docs):
    model = language_id.fit(docs)
    got = {(r.doc_id, r.text): r for r in language_id.predict(odd, model).collect()}
    assert all(got[k].lang_pred == "und" and got[k].rejected for k in got if k[0] in (1, 2, 4, 7))
    assert got[(5, [k for k in got if k[0] == 5][0][1])].lang_pred in model.langs
    nothing = language_id.fit(odd.limit(0))
    assert {r.lang_pred for r in language_id.predict(odd, nothing).collect()} == {"und"}
    assert language_id.predict(odd.limit(0), model).count() == 0


def test_language_ignores_other_columns(docs):
    model = language_id.fit(docs)
    plain = language_id.predict(docs.select("doc_id", "text"), model)
    changed = language_id.predict(docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None)), model)
    assert tuples(plain, "doc_id", "lang_pred", "score") == tuples(changed, "doc_id", "lang_pred", "score")


def test_kmeans_separates_clusters():
    rng = np.random.default_rng(0)
    centers = np.eye(6)[:3]
    points = np.repeat(centers, 40, axis=0) + rng.normal(0, 0.05, (120, 6))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    _, near = language_id.spherical_kmeans(points, 3, 10)
    assert [len(set(near[i : i + 40])) for i in (0, 40, 80)] == [1, 1, 1] and len(set(near)) == 3


# --- suffix dedup ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(40))
def test_interval_expansion_equals_counting(seed):
    rng = random.Random(seed)
    length = rng.choice([3, 5, 12, 40])
    alphabet = rng.choice([b"ab", b"abcdefgh", bytes(range(256))])
    base = bytes(rng.choice(alphabet) for _ in range(rng.randrange(1, 300)))
    parts = []
    for _ in range(rng.randrange(1, 6)):
        part = bytearray(base[rng.randrange(len(base)) :])
        for _ in range(rng.randrange(3)):
            part[rng.randrange(len(part))] = rng.choice(alphabet)
        parts.append(bytes(part))
    count = Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    want = [[count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]
    assert [list(f) for f in suffix_dedup.repeated_windows(parts, length)] == want


def test_dedup_equals_brute_force(docs, rows):
    assert tuples(suffix_dedup.dedup(docs)) == sorted(brute.repeats(rows), key=repr)


@pytest.mark.parametrize("settings", [dict(), dict(hot=1), dict(hot=3, block_bytes=500), dict(piece=64), dict(steps=(5, 1), hot=2)])
def test_dedup_of_made_texts(spark, settings):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage = text(90)
    data = [(i, text(rng.randrange(60)) + passage[rng.randrange(20) :] + text(rng.randrange(40))) for i in range(25)]
    data += [(50, passage), (50, passage), (51, "ab" * 100), (52, "x" * 39), (53, "y" * 40), (54, "z" * 41), (55, None), (56, "")]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = suffix_dedup.dedup(df, suffix_dedup.Settings(length=40, gram=8, **settings))
    assert tuples(got) == sorted(brute.repeats(data, 40), key=repr)


def test_dedup_odd_rows(odd):
    got = tuples(suffix_dedup.dedup(odd))
    want = brute.repeats([(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()])
    assert got == sorted(want, key=repr)
    assert suffix_dedup.dedup(odd.limit(0)).count() == 0


# --- quality classifier ---------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_quality_pu(spark, sf).join(labels, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    order = np.argsort(np.argsort(np.array(good + bad)))
    auc = (order[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / (len(good) * len(bad))
    assert auc > 0.95
    hit = lambda q: np.mean([r.predicted == q for r in rows if r.quality == q])
    assert (hit(0) + hit(1)) / 2 > 0.85


def test_quality_odd_rows(spark, odd):
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (None, 1)], "doc_id long, quality int")
    model = quality_pu.fit(odd, labels)
    got = quality_pu.score(odd, model).collect()
    assert len(got) == 11 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    none = quality_pu.fit(odd.limit(0), labels)
    assert quality_pu.score(odd, none).select("score").distinct().count() == 1
    assert quality_pu.score(odd.limit(0), model).count() == 0


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.8])
def test_quality_prior_from_positives_and_unlabelled(prior):
    draw = np.random.default_rng(5)
    made = lambda n, good: np.where(good[:n, None], 1.5, -1.5) + draw.normal(size=(n, 4))
    positive, unlabelled = made(1500, np.ones(1500, bool)), made(2500, draw.random(2500) < prior)
    assert abs(quality_pu.class_prior(positive, unlabelled, quality_pu.Settings()) - prior) < 0.1


def test_quality_reads_no_negative_labels(spark, tmp_path):
    """The query's scores stay when labels of 0 are removed."""
    sf = "/root/testdata/sf0.001"
    spark.read.parquet(f"{sf}/documents.parquet").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").write.parquet(f"{tmp_path}/labels.parquet")
    assert tuples(queries.op6_quality_pu(spark, f"file://{tmp_path}")) == tuples(queries.op6_quality_pu(spark, sf))


def test_non_negative_risk_learns():
    rng = np.random.default_rng(1)
    positive = rng.normal(1, 1, (400, 5))
    unlabelled = np.vstack([rng.normal(1, 1, (300, 5)), rng.normal(-1, 1, (700, 5))])
    model = quality_pu.minimise(positive, unlabelled, 0.3, quality_pu.Settings())
    assert model.score(rng.normal(1, 1, (200, 5))).mean() > 0.8 > 0.2 > model.score(rng.normal(-1, 1, (200, 5))).mean()


# --- PII ------------------------------------------------------------------------------------------

TRICKY = [
    "a@b.c_d@e.f x@y z@w. q@r..s me@host-name.example.com.", "1.2.3.4.5 999.1.1.1 1.2.3 0001.02.003.255 1.2.3.4.5.6.7.8",
    "4111111111111111 4111-1111 1111-1111 4111 1111 1111 1112 1 2 3 4 5 6 7 8 9 0 1 2 3 4", "+1 (523) 555-1055. +49-30 +1 2 3 4 5 6 7 8 9) ++12345678901 +1234567890123456",
    "héé\U0001f600 a@b.co und +1 (200) 555-0100\n127.0.0.1", "", "@@@ ++++ ....", "1" * 3000, "1 " * 3000, "a" * 5000 + "@", "a@" * 2000, "1." * 3000, "+1" + "2" * 4000, "%" * 3000 + "@a.b",
]


def base_rows(df):
    return {(r.doc_id, r.text): [(s.start, s.end, s.kind) for s in r.base] for r in df.collect()}


def test_pii_base_equals_patterns(spark, docs, rows):
    data = [(10_000 + i, t) for i, t in enumerate(TRICKY)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(data, "doc_id long, text string"))
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.base] for r in pii.find(df).collect()}
    for doc, text in [*rows, *data]:
        assert got[doc] == brute.personal(text), doc


def test_pii_counts(docs, rows):
    by_id = dict(rows)
    for r in pii.counts(pii.find(docs)).collect():
        spans = brute.personal(by_id[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[2] == k for s in spans) for k in pii.KINDS]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


def test_pii_bootstraps_unseen(spark):
    known = [(i, f"please call customer line +1 (2{i:02}) 555-0{i:03} today") for i in range(20)]
    unseen = [(100, "please call customer line 0151-77712345 today"), (101, "it was 0151-77712345 metres long")]
    found = {r.doc_id: r.spans for r in pii.counts(pii.find(spark.createDataFrame(known + unseen, "doc_id long, text string"))).collect()}
    assert found[100] == "phone:26:39"
    assert found[101] == ""  # the same number, but not where the pattern stands


def test_pii_contexts_equal_brute_force(spark, docs):
    """Left and right contexts, tokens by their shape, mail addresses without digits, and chance neighbours."""
    hexes = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(12)]
    data = [(20_000 + i, f'set token = "{h}" here') for i, h in enumerate(hexes)]
    data += [(20_100 + i, f"reach me{i}@mail.example.com anytime or 10.0.{i}.7 (office) now") for i in range(9)]
    data += [
        (20_200, 'set token = "1234-ABCD-zz" here'), (20_201, f"commit {hexes[0]} merged"), (20_202, "reach bob@localhost anytime"),
        (20_203, "see 192-168-0-1 (office) now"), (20_204, "in 2024 and 12345"), (20_205, "a@b"), (20_206, f'"{hexes[1]}"'),
    ]
    df = docs.filter("doc_id % 5 = 0").select("doc_id", "text").union(spark.createDataFrame(data, "doc_id long, text string"))
    want = brute.bootstrapped([(r.doc_id, r.text) for r in df.collect()])
    got = {}
    for r in pii.find(df).collect():
        if new := {(s.start, s.end, s.kind) for s in r.spans} - {(s.start, s.end, s.kind) for s in r.base}:
            got[r.doc_id] = new
    assert got == want
    assert {20_000, 20_200, 20_202, 20_203} <= set(got) and not {20_201, 20_204, 20_205, 20_206} & set(got)


def test_pii_time_grows_with_mentions(spark):
    df = spark.createDataFrame([(1, " ".join(["x1234"] * 64_000))], "doc_id long, text string")
    pii.scan(df.limit(0)).count()
    began = time.time()
    assert pii.scan(df).select(F.size("mentions")).first()[0] == 64_000
    assert time.time() - began < 60


def test_pii_finds_short_digit_groups(spark):
    known = [(i, f"please call customer line +1 (2{i:02}) 555-0{i:03} today") for i in range(20)]
    unseen = [
        (100, "please call customer line 123-456 today"),
        (101, "please call customer line AB12-CD34 today"),
        (102, "please call customer line 123-457 in 2024"),
        (103, "please call customer line 12-3 or 4 today"),  # four digits, but not of one identifier
    ]
    found = {r.doc_id: r.spans for r in pii.counts(pii.find(spark.createDataFrame(known + unseen, "doc_id long, text string"))).collect()}
    assert [found[i] for i in range(100, 104)] == ["phone:26:33", "phone:26:35", "phone:26:33", ""]


def test_pii_odd_rows(odd):
    got = pii.find(odd).collect()
    assert len(got) == 11
    assert Counter(len(r.base) for r in got) == {0: 8, 4: 3}
    assert pii.find(odd.limit(0)).count() == 0
    red = {r.doc_id: r.text for r in pii.redact(odd).collect()}
    assert red[5] == "Write to [email] or [phone] now, card [card] at [ip]." and red[None] == red[5]
    assert red[1] is None and red[2] == "" and pii.redact(odd).columns == odd.columns


def test_running_sums(spark):
    lists = [[], [5], list(range(700)), [1] * 256, [2] * 257]
    df = spark.createDataFrame([(x,) for x in lists], "x array<long>").select(pii.running(F.col("x")).alias("y"))
    assert [r.y for r in df.collect()] == [[sum(x[:i]) for i in range(len(x))] for x in lists]


# --- mixing ---------------------------------------------------------------------------------------


def test_mix_reaches_targets(docs, rows):
    got = mixing.mix(docs, bucket_docs=3).collect()
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    size = {d: len(brute.WORDS(t)) for d, t in rows}
    sums, taken = Counter(), Counter()
    for r in got:
        assert r.size == size[r.doc_id] and 0 <= r.taken <= 3 * r.size
        sums[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    names = sorted(sums)
    target = brute.fill(sums, {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}, 3)
    for r in got:
        assert r.source_size == sums[source[r.doc_id]] and abs(r.target - target[source[r.doc_id]]) < 1e-6
    assert all(abs(taken[n] - target[n]) <= 0.5 for n in names)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))


def test_mix_caps_small_sources(spark):
    data = [(i, "w " * n, s) for i, (s, n) in enumerate([("a", 1), ("b", 500), ("c", 300), (None, 100), ("d", 0)])]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    target = brute.fill({0: 1, 1: 500, 2: 300, 4: 0, 3: 100}, {0: 5, 1: 2, 2: 1, 4: 5, 3: 2}, 3)
    assert {i: round(r.target, 6) for i, r in got.items()} == {i: round(t, 6) for i, t in target.items()}
    assert got[0].taken == 3 and got[4].taken == 0


def test_mix_odd_rows(odd):
    got = mixing.mix(odd).collect()
    assert len(got) == 11 and sum(r.size for r in got if r.doc_id in (1, 2, 4)) == 0
    assert mixing.mix(odd.limit(0)).count() == 0


# --- quality rules --------------------------------------------------------------------------------


def test_clean_counts():
    text = "Home | About | Contact | Help\nThis is a real sentence of the text, with words.\nThis is a real sentence of the text, with words.\n\nAll rights reserved by somebody in the world.\nshort line"
    n, chars, symbols, dups, repeated, failed, kept, cleaned = quality_rules.clean(text)
    words = brute.WORDS(text)
    assert (n, chars, symbols, dups) == (len(words), sum(map(len, words)), 3, 1) and failed and not kept
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    assert repeated == len(covered)
    assert cleaned == "This is a real sentence of the text, with words.\nThis is a real sentence of the text, with words.\n"


def test_clean_odd_rows(odd):
    got = quality_rules.clean_lines(odd).collect()
    assert len(got) == 11 and not any(r.kept for r in got if r.doc_id in (1, 2, 4, 6))
    assert quality_rules.clean_lines(odd.limit(0)).count() == 0


def test_clean_keeps_good_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("quality = 1")
    rows = queries.op9_quality_rules(spark, sf_dir).join(labels, "doc_id").filter("NOT base_failed").collect()
    assert np.mean([r.kept for r in rows]) > 0.97


# --- top-k search ---------------------------------------------------------------------------------


@pytest.mark.parametrize("settings", [bm25.Settings(), bm25.Settings(shard_docs=20, block_docs=2, dense_terms=20, flush_terms=50), bm25.Settings(k=3, shard_docs=70, block_docs=7)])
def test_search_equals_brute_force(docs, rows, settings):
    asked = [r for r in rows if r[0] % 10 == 0]
    got = bm25.search(docs, docs.filter("doc_id % 10 = 0"), settings).collect()
    want = brute.bm25(rows, asked, settings.k)
    key = lambda x: (x[0], x[1])
    assert [tuple(r)[:3] for r in sorted(got, key=key)] == [w[:3] for w in sorted(want, key=key)]
    assert all(abs(a[3] - b[3]) < 1e-5 for a, b in zip(sorted(got, key=key), sorted(want, key=key)))


def test_search_skips_blocks():
    texts = [f"common rare{i}" for i in range(500)] + ["common needle needle"]
    shard = bm25.Shard(list(range(501)), texts, 2.0, bm25.Settings(k=1, block_docs=4, dense_terms=1))
    q, ids, _ = shard.search([["common", "needle"]], [[0.1, 9.0]], [None], [None])
    assert list(q) == [0] and list(ids) == [500] and shard.blocks_read < 5


def test_search_ties_and_copies(spark):
    """Of equal documents the smallest ids are found, however many there are and wherever they lie."""
    data = [(i, "one two three four") for i in range(60)] + [(100 + i, f"one two rest{i}") for i in range(5)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = bm25.search(docs, docs.filter("doc_id = 50"), bm25.Settings(shard_docs=9, block_docs=2)).orderBy("rank").collect()
    assert [r.doc_id for r in got] == list(range(10)) and len({r.score for r in got}) == 1


def test_search_of_copies_is_made_once(spark, monkeypatch):
    """Queries of equal texts are searched once, and shards are as many as different texts need."""
    held, plain = {}, bm25.stored
    monkeypatch.setattr(bm25, "stored", lambda df, name, *more: held.setdefault(name, plain(df, name, *more)))
    data = [(i, f"one two rest{i % 8} rest{i % 8 + 1}") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    got = sorted(map(tuple, bm25.search(docs, docs.filter("doc_id < 24"), bm25.Settings(k=3, shard_docs=8)).collect()))
    assert held["bm25-queries"].count() == 8 and [r[1] for r in got] == [1, 2, 3] * 24
    assert [r[2] for r in got] == [i % 8 + 8 * j for i in range(24) for j in range(3)]


def test_search_odd_rows(odd):
    got = bm25.search(odd, odd.filter("doc_id IN (1, 5, 6)")).collect()
    assert {r.query_id for r in got} == {5, 6} and all(r.score > 0 for r in got)
    assert bm25.search(odd.limit(0), odd).count() == 0 and bm25.search(odd, odd.limit(0)).count() == 0
    # Rows of no id are not found; two queries of one id are answered each, equal ones once.
    assert None not in {r.doc_id for r in got}
    assert len([r for r in got if r.query_id == 6 and r.rank == 1]) == 2
    both = bm25.search(odd, odd.filter("doc_id = 3")).collect()
    assert [r.rank for r in both if r.doc_id == 3] == [1, 2]
