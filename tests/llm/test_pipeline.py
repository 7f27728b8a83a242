import hashlib
from collections import Counter

import brute
import corpus_pipeline as pipeline
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "ngram_join", "pii", "mixing", "bpe"]
    first = dict(pipeline.STAGES)["language_id"](spark, docs, sf_dir).cache()
    assert first.columns == COLUMNS and first.count() >= 0.97 * docs.count()
    one = dict(pipeline.STAGES)["ngram_join"](spark, first, sf_dir).cache()
    rows = [(r.doc_id, r.text) for r in first.collect()]
    assert sorted(r.doc_id for r in one.collect()) == sorted({c for d, _, c in brute.near_components(rows)})
    hidden = dict(pipeline.STAGES)["pii"](spark, one, sf_dir).cache()
    assert hidden.columns == COLUMNS and hidden.count() == one.count()
    before = {r.doc_id: r.text for r in one.collect()}
    for r in hidden.collect():
        assert not brute.personal(r.text) and r.n_chars == len(r.text)
        assert brute.personal(before[r.doc_id]) or r.text == before[r.doc_id] or "[" in r.text
    mixed = dict(pipeline.STAGES)["mixing"](spark, hidden, sf_dir).cache()
    assert mixed.columns == COLUMNS and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    last = dict(pipeline.STAGES)["bpe"](spark, mixed, sf_dir)
    text = {r.doc_id: r.text for r in hidden.collect()}
    out = last.collect()
    assert len(out) == mixed.count()
    assert all(r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest() for r in out)


def test_stages_take_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang = 'en'").limit(40)
    data = [(None, None, None, None, None), (1, "", None, None, 0), (2, "some words here", "en", "a", 15), (2, "some words here", "en", "a", 15)]
    odd = spark.createDataFrame(data, schema)
    for docs in (odd, odd.limit(0), known.select(*COLUMNS).unionByName(odd)):
        docs, count = docs.withColumn("score", F.lit(1)), docs.count()
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
            if name == "language_id":  # null texts and those without a letter go
                assert docs.filter("text IS NULL OR text = ''").count() == 0
            if name == "ngram_join":
                assert docs.count() == docs.select("doc_id", "text").distinct().count() <= count
        assert docs.columns[:2] == ["doc_id", "n_tokens"]
        assert (docs.count() > 0) == (count > 0)
