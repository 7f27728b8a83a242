"""A training-data pipeline over ``documents``: each stage calls one of the operators in
``allelic.llm``, is written as Parquet, and is read again as the next stage's input.

Every stage but the last returns the columns of ``documents``. Texts that are null or hold no
letter are rejected by the first stage; rows of null id pass through every stage, and those of
equal text stay apart in the second; an empty table gives empty stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from allelic.llm import bpe, language_id, mixing, ngram_join, pii
from allelic.llm.common import BATCH_KEY, BATCH_ROWS, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def small_batches(spark: SparkSession) -> None:
    """Texts may be long, so Python tasks take few at once; holds for the session from here on."""
    spark.conf.set(BATCH_KEY, BATCH_ROWS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go; the others keep their columns."""
    small_batches(spark)
    model = language_id.fit(docs.filter(language_id.fold(5) != 0))
    return language_id.predict(docs.select(*COLUMNS), model).filter("NOT rejected").select(*COLUMNS)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; of rows that share an
    id, those of equal text count once."""
    kept = ngram_join.join(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rest = docs.select(*COLUMNS).join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return rest.unionByName(docs.select(*COLUMNS).filter("doc_id IS NULL")).select(*COLUMNS)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars follows."""
    hidden = pii.redact(docs.select(*COLUMNS))
    return hidden.withColumn("n_chars", F.when(F.col("n_chars").isNull(), None).otherwise(F.length("text")).cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document occurs as often as the mix takes its words, a last part of it counting whole."""
    taken = mixing.mix(docs.select(*COLUMNS), carry=("text", "lang", "n_chars", "source"))
    times = F.when(F.col("size") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    return taken.withColumn("epoch", F.explode(F.when(times > 0, F.sequence(F.lit(1), times)))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the token ids and of the text decoded from them."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(docs.select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_join", keep_one_of_near_copies),
    ("pii", hide_personal_data),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Learned models and merges have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
