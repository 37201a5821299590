"""Audit of references: buckets of questions that share an answer space, their labels, what is wrong with them, and constant-answer baselines."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions import text as T
from .exports import RELATION, SPEED_PAIR

_LIST = re.compile(r"\[([^\]]+)\]")


def literal_options(text: str | None) -> list[str] | None:
    """The distinct lower-cased entries, sorted, of the last bracketed list that is a Python list of strings; empty without one, null for null."""
    if text is None:
        return None
    for inner in reversed(_LIST.findall(text.split(";", 1)[-1])):
        try:
            found = ast.literal_eval(f"[{inner}]")
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            continue
        if found and all(isinstance(x, str) for x in found):
            return sorted({x.lower() for x in found})
    return []


def options(raw_question: Column) -> Column:
    """literal_options of questions; quotes and escapes are those of Python, which no SQL function reads, so it is an Arrow function."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(literal_options)

    return run(raw_question)


def labelled(rows: DataFrame) -> DataFrame:
    """Adds selector, options, norm (the reference as the family compares it), type, key of the bucket, and bad (what is wrong, null if nothing).

    rows: task, family, raw_question, reference (text of strings, numbers and booleans), reference_kind (text, number, boolean, list, object, null), reference_box.
    Norm is null for other references.  A box also needs four numbers.
    """
    raw, ref = F.col("raw_question"), F.col("reference")
    text_of = F.element_at(F.split(raw, ";", 2), -1)
    judged = F.col("family") == "judge"
    rows = rows.withColumn("options", options(raw)).withColumn("selector", T.selector(raw)).withColumn("norm", F.lower(F.when(judged, T.clean(ref)).otherwise(ref)))
    box = (F.col("family") == "grounding") & F.contains(F.lower(raw), F.lit(M.BOX_QUESTION))
    yes_no = F.coalesce(F.col("norm").isin("yes", "no"), F.lit(False))
    rows = rows.withColumn("type", F.when(box, "bounding_box").when(F.col("family") == "relation", "scene_local_relation_ids").when(F.col("family") == "speed", "speed_limit_pair").when(yes_no, "yes_no").otherwise("categorical"))
    many = F.size("options") > 0
    key = (
        F.when((F.col("type") == "yes_no") & F.startswith("selector", F.lit("[")), F.concat_ws(" ", "type", "selector"))
        .when((F.col("type") == "categorical") & many, F.concat(F.lit("categorical "), F.replace(F.to_json("options"), F.lit('","'), F.lit('", "'))))
        .when(F.col("type") == "categorical", F.concat(F.lit("categorical question "), text_of)).otherwise(F.col("type"))
    )
    string = F.when(F.col("reference_kind") == "text", ref)
    numbers = F.coalesce(F.size("reference_box") == 4, F.lit(False))
    bad = (
        F.when((F.col("type") == "scene_local_relation_ids") & ~F.coalesce(F.rlike(string, F.lit(RELATION)), F.lit(False)), "not slash-separated ids")
        .when((F.col("type") == "speed_limit_pair") & ~F.coalesce(F.rlike(string, F.lit(SPEED_PAIR)), F.lit(False)), "no pair of speeds")
        .when((F.col("type") == "bounding_box") & ~numbers, "no box")
        .when((F.col("type") == "categorical") & many & ~F.coalesce(F.array_contains("options", F.col("norm")), F.lit(False)), "not among the options")
    )
    return rows.withColumn("key", key).withColumn("bad", bad)


def distributions(labels: DataFrame, raw: str = "raw_reference") -> DataFrame:
    """task, key, form (raw or normalized), label, n, first (the least position): how often each label is there.

    labels: what ``labelled`` gives, with sample_index, question_index and the reference's JSON.  A reference that has no norm counts by its JSON.
    """
    forms = F.array(F.struct(F.lit("raw").alias("form"), F.col(raw).alias("label")), F.struct(F.lit("normalized").alias("form"), F.coalesce("norm", raw).alias("label")))
    rows = labels.select("task", "key", "sample_index", "question_index", F.explode(forms).alias("l"))
    return rows.groupBy("task", "key", "l.form", "l.label").agg(F.count("*").alias("n"), F.min(F.struct("sample_index", "question_index")).alias("first"))


def buckets(labels: DataFrame, raw: str = "raw_reference") -> DataFrame:
    """task, key, type, questions, samples, changed (references that differ from their norm), bad, answer, correct, accuracy.

    The last three are the most frequent label (of equals the one seen first) and how often it is right; null but for yes-no questions, and
    categories with options and without a bad reference.
    """
    per = labels.groupBy("task", "key", "sample_index").agg(
        F.first("type").alias("type"), F.first("options").alias("options"), F.count("*").alias("n"), F.count("bad").alias("bad"), F.count_if((F.col("reference_kind") == "text") & (F.col("norm") != F.col("reference"))).alias("changed")
    )
    sums = per.groupBy("task", "key").agg(F.first("type").alias("type"), F.first("options").alias("options"), F.sum("n").alias("questions"), F.count("*").alias("samples"), F.sum("changed").alias("changed"), F.sum("bad").alias("bad"))
    counts = distributions(labels, raw).where("form = 'normalized'")
    top = counts.groupBy("task", "key").agg(F.max(F.struct("n", F.struct((-F.col("first.sample_index")).alias("s"), (-F.col("first.question_index")).alias("q")), "label")).alias("top"))
    gate = (F.col("type") == "yes_no") | ((F.col("type") == "categorical") & (F.size("options") > 0) & (F.col("bad") == 0))
    return sums.join(top, ["task", "key"]).select(
        "task", "key", "type", "questions", "samples", "changed", "bad", F.when(gate, F.col("top.label")).alias("answer"), F.when(gate, F.col("top.n")).alias("correct"), F.when(gate, F.col("top.n") / F.col("questions")).alias("accuracy")
    )
