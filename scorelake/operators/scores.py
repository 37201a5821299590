"""From components of tasks to totals, group means, ranks, wins and frontiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def composite(other: Column, accuracy: Column, instruction: Column, w_other: Column, w_accuracy: Column, w_instruction: Column) -> Column:
    """Sum in this order, so that the last bit is always the same."""
    return 100 * other * w_other + 100 * accuracy * w_accuracy + 100 * instruction * w_instruction


def with_weights(rows: DataFrame, weights: DataFrame, default: tuple[float, float, float] = (0.0, 0.8, 0.2)) -> DataFrame:
    """Adds w_other, w_accuracy, w_instruction by task; tasks without a row get the default."""
    out = rows.join(F.broadcast(weights), "task", "left")  # one row a task
    for name, d in zip(("w_other", "w_accuracy", "w_instruction"), default):
        out = out.withColumn(name, F.coalesce(name, F.lit(d)))
    return out


def weighted_mean(score: Column, n: Column) -> Column:
    """Mean by questions; null where there are none."""
    return F.try_divide(F.sum(score * n), F.sum(n))


def totals(task_scores: DataFrame, skip: list[str] | None = None, override: DataFrame | None = None, by: tuple[str, ...] = ("model_id",)) -> DataFrame:
    """by, total, questions.  task_scores: model_id, task, score, n.

    skip leaves tasks out; override (model_id, task, score) takes the place of scores.
    """
    rows = task_scores if not skip else task_scores.where(~F.col("task").isin(skip))
    if override is not None:
        other = override.select("model_id", "task", F.col("score").alias("_score"))
        rows = rows.join(other, ["model_id", "task"], "left").withColumn("score", F.coalesce("_score", "score")).drop("_score")
    return rows.groupBy(*by).agg(weighted_mean(F.col("score"), F.col("n")).alias("total"), F.sum("n").alias("questions"))


def table_rollup(task_scores: DataFrame) -> DataFrame:
    """Tasks, group means and totals in one result: model_id, group, task, level (0 task, 1 group, 3 total), score.

    task_scores: model_id, group, task, score, n.
    """
    sets = task_scores.groupingSets([[F.col("model_id"), F.col("group"), F.col("task")], [F.col("model_id"), F.col("group")], [F.col("model_id")]], "model_id", "group", "task")
    return sets.agg(F.grouping_id("model_id", "group", "task").cast("int").alias("level"), weighted_mean(F.col("score"), F.col("n")).alias("score"))


def leaders(task_scores: DataFrame, slack: float = 1e-9) -> DataFrame:
    """Rows that are within slack of the best of their task, with how many there are."""
    best = task_scores.groupBy("task").agg(F.max("score").alias("best"))
    lead = task_scores.join(best, "task").where(F.col("score") >= F.col("best") - slack)
    many = lead.groupBy("task").agg(F.count("*").alias("leaders"))
    return lead.join(many, "task")


def task_wins(task_scores: DataFrame, slack: float = 1e-9) -> DataFrame:
    """model_id, wins (tasks led alone), ties (led with others); models without either too."""
    lead = leaders(task_scores, slack)
    counts = lead.groupBy("model_id").agg(F.count_if(F.col("leaders") == 1).alias("wins"), F.count_if(F.col("leaders") > 1).alias("ties"))
    models = task_scores.select("model_id").distinct()
    return models.join(counts, "model_id", "left").select("model_id", F.coalesce("wins", F.lit(0)).alias("wins"), F.coalesce("ties", F.lit(0)).alias("ties"))


def ranked(rows: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Numbers rows in an order; for results of one row a model, which one task can sort."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)))


def frontier_pairs(points: DataFrame) -> DataFrame:
    """Points that none beats: no other of higher score costs as little.  By a theta anti-join; for few points."""
    a, b = points.where("cost is not null and score is not null").alias("a"), points.where("cost is not null and score is not null").alias("b")
    return a.join(b, (F.col("b.score") > F.col("a.score")) & (F.col("b.cost") <= F.col("a.cost")), "left_anti")


def frontier(points: DataFrame) -> DataFrame:
    """As frontier_pairs, by a running maximum (over ranges of cost) of the best score of each cost, so equal costs are peers."""
    known = points.where("cost is not null and score is not null")
    best = known.groupBy("cost").agg(F.max("score").alias("best"))
    upto = ranges.running(best, [], ["cost"], F.col("best"), "upto", how=F.max).select("cost", "upto")
    return known.join(upto, "cost").where(F.col("score") >= F.col("upto")).select(*points.columns)


def budget_ranges(points: DataFrame, *ties: str) -> DataFrame:
    """The frontier with next_cost: each point is the best for budgets from cost up to next_cost."""
    return ranges.following(frontier(points), ["cost", *ties], "cost", "next_cost")


def task_summary(task_scores: DataFrame) -> DataFrame:
    """Per model: unweighted mean and median, and the tasks of least and greatest score (first by ordinal on ties)."""
    return task_scores.groupBy("model_id").agg(
        F.avg("score").alias("mean"), F.median("score").alias("median"), F.min_by("task", F.struct("score", "ordinal")).alias("minimum"), F.max_by("task", F.struct("score", -F.col("ordinal"))).alias("maximum")
    )


def leaderboard(task_scores: DataFrame, models: DataFrame) -> DataFrame:
    """label, total, rank of featured models (featured where not said otherwise)."""
    shown = models.where(F.coalesce("featured", F.lit(True)))
    out = totals(task_scores.join(F.broadcast(shown.select("model_id")), "model_id", "left_semi")).join(F.broadcast(shown), "model_id")  # models: one row a model
    return ranked(out, [F.desc("total"), F.asc("model_id")])


def best_of_lab(models: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """Adds lab_best, and position: labs by their best mean, then name (in a collation's order, and where that finds names equal by their bytes), size rank and id."""
    best = models.withColumn("lab_best", F.max("mean").over(Window.partitionBy("lab")))
    return ranked(best, [F.desc("lab_best"), F.collate(F.col("lab"), collation).asc(), F.asc("lab"), F.asc(F.coalesce("size_rank", F.lit(99))), F.asc("model_id")], "position")
