"""What-if questions, audits of labels, and shifts between cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import marking, ranges, scores


def with_partners(excluded: DataFrame, sizes: DataFrame) -> DataFrame:
    """Excluded questions and, in paired families, their partners half a sample away (none in a sample of odd size).

    excluded: task, sample, position (from 0).  sizes: task, family, sample, n.
    """
    rows = excluded.join(sizes, ["task", "sample"])
    half = F.floor(F.col("n") / 2)
    partner = F.when(F.col("family").isin(*marking.PAIRED) & (F.col("n") % 2 == 0), F.when(F.col("position") < half, F.col("position") + half).otherwise(F.col("position") - half))
    return rows.select("task", "sample", F.explode(F.array_compact(F.array(F.col("position"), partner.cast("bigint")))).alias("position")).distinct()


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(gone, keys, "left_anti")


def accuracy_by_label(rows: DataFrame, models: list, label: str = "gold") -> DataFrame:
    """A row for each kind and label with every model's accuracy, the best, and whether nobody is ever right; boxes are left out.

    ``models`` is given, so that the columns are known without another pass.
    """
    shown = rows.where("kind <> 'box'")
    n = shown.groupBy("kind", label).agg(F.count("*").alias("n"), F.max("accuracy").alias("top"))
    wide = shown.groupBy("kind", label).pivot("model", models).agg(F.avg("accuracy"))
    names = [str(m) for m in models]
    best = F.greatest(*names) if len(names) > 1 else F.col(names[0])
    return n.join(wide, ["kind", label]).select("kind", label, "n", *names, best.alias("best"), (F.col("top") < 1).alias("nobody"))


def difficulty(rows: DataFrame, keys: list[str], models: int) -> DataFrame:
    """keys, right, disagree, allwrong: how many models are right; without an answer one is wrong.

    rows: keys, model, accuracy.
    """
    out = rows.groupBy(*keys).agg(F.count_if(F.col("accuracy") >= 1).alias("right"))
    return out.withColumn("disagree", (F.col("right") > 0) & (F.col("right") < models)).withColumn("allwrong", F.col("right") == 0)


def saturation(stats: DataFrame, distrusted: list, task: str = "task") -> DataFrame:
    """Adds saturated (mean of 75 or more, or sd below 2.5) and quadrant."""
    full = (F.col("mean") >= 75) | (F.col("sd") < 2.5)
    doubt = F.col(task).isin(distrusted) if distrusted else F.lit(False)
    name = F.when(full & doubt, "saturated, distrusted").when(full, "saturated").when(doubt, "distrusted").otherwise("useful")
    return stats.withColumn("saturated", full).withColumn("quadrant", name)


def label_audit(rows: DataFrame, keys: list[str], label: str, norm: Column, sample: str) -> DataFrame:
    """keys, labels, questions, samples, distribution: how often each normalised label is there."""
    counts = rows.groupBy(*keys, norm.alias("_label")).agg(F.count("*").alias("_n"))
    dist = counts.groupBy(*keys).agg(F.count("*").alias("labels"), F.sum("_n").alias("questions"), F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("_label", F.lit("")), "_n")))).alias("distribution"))
    many = rows.groupBy(*keys).agg(F.count_distinct(sample).alias("samples"), F.count_if(F.col(label).isNull()).alias("bad"))
    return dist.join(many, keys)


def majority(rows: DataFrame, keys: list[str], label: str, order: str) -> DataFrame:
    """keys, majority, baseline: the most frequent label (of equals the one seen first) and its share."""
    counts = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return counts.groupBy(*keys).agg(F.max_by(label, F.struct("_n", -F.col("_first"))).alias("majority"), (F.max("_n") / F.sum("_n")).alias("baseline"))


def shift(new: DataFrame, old: DataFrame, key: str = "task") -> DataFrame:
    """key, new_mean, old_mean, shift: all keys of either side; without one of them the shift is 0."""
    a, b = new.select(key, F.col("mean").alias("new_mean")), old.select(key, F.col("mean").alias("old_mean"))
    return a.join(b, key, "full").withColumn("shift", F.coalesce(F.col("new_mean") - F.col("old_mean"), F.lit(0.0)))


def islands(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """by, run, value, n, first: stretches of equal values in an order."""
    marked = ranges.runs(rows, by, order, value)
    return marked.groupBy(*by, "run").agg(F.max(value).alias(value), F.count("*").alias("n"), F.min(order[0]).alias("first"))


def running_groups(rows: DataFrame, by: list[str], order: str, closes: Column) -> DataFrame:
    """Adds group: a row that closes a group is its last."""
    out = ranges.running(rows, by, [order], F.coalesce(closes.cast("int"), F.lit(0)), "group", until=-1)
    return out.withColumn("group", F.coalesce("group", F.lit(0)))


def published_check(rows: DataFrame, by: list[str], slack: float = 0.1) -> DataFrame:
    """by, group, published, recomputed, agrees.  rows: by, group, aggregate, score, n (rows of a group and its mean)."""
    out = rows.groupBy(*by, "group").agg(
        F.max(F.when(F.col("aggregate"), F.col("score"))).alias("published"),
        F.try_divide(F.sum(F.when(~F.col("aggregate"), F.col("score") * F.col("n"))), F.sum(F.when(~F.col("aggregate"), F.col("n")))).alias("recomputed"),
    )
    return out.where("published is not null and recomputed is not null").withColumn("agrees", F.round(F.abs(F.col("published") - F.col("recomputed")), 6) <= slack)


def first_seen(rows: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values with the least order that they are seen at."""
    return rows.groupBy(value).agg(F.min(order).alias("first"))


def what_if(marked: DataFrame, gone: DataFrame, weights: DataFrame) -> DataFrame:
    """model_id, task, score, n over the questions that stay: missing kinds and overlaps count 0, and n is the weight in a total.

    marked: model_id, task, family, sample, position and the marks.  gone: task, sample, position.
    """
    parts = marking.components(without(marked, gone, ["task", "sample", "position"]), ["model_id", "task"], lenient=True)
    parts = scores.with_weights(parts, weights)
    made = scores.composite(F.col("other"), F.col("accuracy"), F.col("instruction"), F.col("w_other"), F.col("w_accuracy"), F.col("w_instruction"))
    return parts.select("model_id", "task", made.alias("score"), F.col("questions").alias("n"))


def what_if_parts(marked: DataFrame, weights: DataFrame) -> DataFrame:
    """model_id, task, score and n over all questions, with kept_score and kept_n over those that stay (both null if none does), in one aggregation.

    marked: model_id, task, family, the marks, and gone (whether a question is left out, its partner's exclusion told already); the same rules as what_if.
    """
    stay = marking.parts(~F.col("gone"), lenient=True)
    both = marked.groupBy("model_id", "task", "family").agg(*[c.alias(k) for k, c in marking.parts().items()], *[c.alias(f"_{k}") for k, c in stay.items()])
    rows = marking.task_status(scores.with_weights(both, weights))
    made = scores.composite(F.col("_other"), F.col("_accuracy"), F.col("_instruction"), F.col("w_other"), F.col("w_accuracy"), F.col("w_instruction"))
    some = F.col("_questions") > 0
    return rows.select("model_id", "task", "score", F.col("questions").alias("n"), F.when(some, made).alias("kept_score"), F.when(some, F.col("_questions")).alias("kept_n"))


def totals_of_parts(parts: DataFrame) -> DataFrame:
    """As what_if_totals, from what_if_parts."""
    rows = parts.where("score is not null")
    return scores.totals(rows.select("model_id", "task", F.coalesce("kept_score", "score").alias("score"), F.coalesce("kept_n", "n").alias("n")))


def what_if_totals(task_scores: DataFrame, changed: DataFrame) -> DataFrame:
    """model_id, total, questions with score and weight of the changed tasks in place of their own; tasks that had no score stay out."""
    new = changed.select("model_id", "task", F.col("score").alias("_score"), F.col("n").alias("_n"))
    rows = task_scores.where("score is not null").join(new, ["model_id", "task"], "left")
    return scores.totals(rows.select("model_id", "task", F.coalesce("_score", "score").alias("score"), F.coalesce("_n", "n").alias("n")))
