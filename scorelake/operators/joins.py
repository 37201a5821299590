"""Joins that keep answers, questions and registries consistent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import quantiles


def answered(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """All questions, with their answers where there are any."""
    return questions.join(answers, key, "left")


def pending(questions: DataFrame, answers: DataFrame, key: str = "id") -> DataFrame:
    """Questions without an answer: what a resumed run still has to ask."""
    return questions.join(answers.select(key).distinct(), key, "left_anti")


def valid(answers: DataFrame, questions: DataFrame, key: str = "id") -> DataFrame:
    """Answers to known questions."""
    return answers.join(questions.select(key), key, "left_semi")


def verified(answers: DataFrame, expected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers whose (id, request_hash) is expected, and those whose is not."""
    keys = ["id", "request_hash"]
    return answers.join(expected, keys, "left_semi"), answers.join(expected, keys, "left_anti")


def carried(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers that a superseded condition may lend: its hash, its name, and not cut off.

    candidates: id, request_hash, condition (of all conditions allowed), current.
    """
    from ..functions.text import cut_off

    usable = answers.join(candidates, ["id", "request_hash"]).where(F.col("current") | (answers["condition"].eqNullSafe(candidates["condition"]) & ~cut_off(F.col("finish_reason"))))
    return usable.select(*[answers[c] for c in answers.columns]).distinct()


def coverage(answers: DataFrame, questions: DataFrame, by: str = "model_id", key: str = "id") -> DataFrame:
    """by, answers, distinct_questions, unknown, covered: every question exactly once."""
    n = questions.select(key).distinct().count()
    known = questions.select(key, F.lit(True).alias("_known")).distinct()
    out = answers.join(known, key, "left").groupBy(by).agg(F.count("*").alias("answers"), F.count_distinct(key).alias("distinct_questions"), F.count_if(F.col("_known").isNull()).alias("unknown"))
    return out.withColumn("covered", (F.col("answers") == n) & (F.col("distinct_questions") == n) & (F.col("unknown") == 0))


def missing_from(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of left that right lacks."""
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def by_position(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Items and requests of the same sample and question; positions are columns, never the order of rows."""
    return items.join(requests, ["task", "sample_index", "question_index"], "full").withColumn("matched", items["item"].isNotNull() & requests["request"].isNotNull())


def billed_clips(answers: DataFrame, shapes: DataFrame, text_tokens: int = 110, least: int = 20) -> DataFrame:
    """model_id, frames, width, height, n, billed: the median of prompt tokens without the text's, for shapes of at least ``least`` answers.

    answers: model_id, id, prompt_tokens.  shapes: id, frames, width, height.
    """
    rows = answers.join(shapes, "id").withColumn("tokens", F.col("prompt_tokens") - text_tokens)
    keys = ["model_id", "frames", "width", "height"]
    return quantiles(rows, keys, "tokens", {"billed": 0.5}).where(F.col("n") >= least).select(*keys, "n", "billed")


def priced(models: DataFrame, prices: DataFrame) -> DataFrame:
    """All models with the list prices of their provider model, null where it is not listed.  models: model_id, slug.  prices: slug and prices."""
    return models.join(F.broadcast(prices), "slug", "left")  # a row for each listed model
