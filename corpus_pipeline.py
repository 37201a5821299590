"""A corpus pipeline of five stages; each works on all that the stage before it kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns of
documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm import curriculum_mix, piece_viterbi, quality_fm, simhash_bk, substring_rk
from scorelake.llm.common import drop_dir, fresh_dir, scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"))
    return quality_fm.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return simhash_bk.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller doc_id has go; a text that loses words is joined
    anew by single spaces, and a document that loses all of them goes."""
    found = substring_rk.remove_repeats(docs)
    made = F.col(found.columns[-1])
    cut = made["n_removed"] > 0
    text = F.when(cut, made["kept"]).otherwise(F.col("text"))
    out = found.where(~cut | (made["kept"] != "")).withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, each as many times as the mix of its source gives it."""
    return curriculum_mix.training_order(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token_ids, n_tokens and n_chars (code points of what the ids decode to)."""
    both = piece_viterbi.encode_and_decode(docs)
    n_tokens = F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("bigint")
    return both.select("doc_id", "token_ids", n_tokens.alias("n_tokens"), F.char_length("text").cast("bigint").alias("n_chars"))


STAGES = [
    ("quality classifier", quality),
    ("simhash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mixed),
    ("sentencepiece encoding and decoding", encoded),
]

#: The classifier's training and the piece search have no SQL form; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; tables of the stages before it, and all that they wrote, are deleted when they have been read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = fresh_dir(spark, f"stage-{k}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_dir(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
