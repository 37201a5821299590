"""The library's aggregates against published totals, wins, frontiers and costs.

The published payloads are not part of the repository.  They are read where PUBLISHED_PAYLOADS says,
else from a folder ``reference`` beside the repository; without them these tests are skipped.
"""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorelake.functions import metering
from scorelake.operators import analysis, scores
from scorelake.sources import readers

HOME = Path(os.environ.get("PUBLISHED_PAYLOADS") or Path(__file__).resolve().parents[2] / "reference")
FOUND = {name: f for f in sorted(HOME.glob("*.js")) for name in ("FULL_RESULTS", "VARIANTS", "PUBLISHED") if f.read_text()[:60].startswith(f"window.{name} =")}

pytestmark = pytest.mark.skipif(len(FOUND) < 3, reason="no published payloads at hand")

TASK = """struct<score: double, questions_scored: bigint, usage: struct<cost_usd: double, answers: bigint>,
components: struct<accuracy: double, instruction_following: double, other: double>,
weights: struct<other: double, accuracy: double, instruction_following: double>>"""
RULE = "struct<kind: string, patch: int, multiplier: double, tokens_per_pixel: double, tokens_per_frame: double>"
USAGE = f"""struct<cost_usd: double, cost_per_video_hour_usd: double,
metering: struct<rule: {RULE}, prompt_price: double, completion_price: double, output_tokens_per_query: double>>"""
SUMMARY = "struct<unweighted_mean_task_score: double, median_task_score: double, minimum: string, maximum: string, task_wins: bigint>"
RESULTS = f"models array<struct<id: string, featured: boolean, summary: {SUMMARY}, usage: {USAGE}, tasks: map<string, {TASK}>>>, task_order array<string>"
READING = "struct<pixels: double, grid: double, accuracy: double, mean_iou: double, native: boolean>"
VARIANTS = f"box_tasks array<string>, models map<string, struct<convention: string, total: struct<pixels: double, grid: double, none: double>, tasks: map<string, {READING}>>>"
PUBLISHED = "models array<struct<id: string, label: string>>, rows array<struct<task: string, source_label: string, source_row: int, aggregate: boolean, scores: map<string, double>>>"


@pytest.fixture(scope="module")
def models(spark):
    whole = readers.payload(spark, str(FOUND["FULL_RESULTS"]), RESULTS)
    return whole.select(F.explode("models").alias("m"), "task_order").select("m.*", "task_order").withColumnRenamed("id", "model_id").cache()


@pytest.fixture(scope="module")
def tasks(models):
    rows = models.select("model_id", "task_order", F.explode("tasks").alias("task", "t"))
    return rows.select("model_id", "task", F.array_position("task_order", F.col("task")).alias("ordinal"), F.col("t.score").alias("score"), F.col("t.questions_scored").alias("n"), "t").cache()


@pytest.fixture(scope="module")
def readings(spark):
    whole = readers.payload(spark, str(FOUND["VARIANTS"]), VARIANTS)
    return whole.select("box_tasks", F.explode("models").alias("model_id", "v")).select("box_tasks", "model_id", "v.*").cache()


def _totals(tasks, readings):
    box = readings.first()["box_tasks"]
    grid = readings.select("model_id", F.explode("tasks").alias("task", "r")).select("model_id", "task", F.col("r.grid").alias("score")).where("score is not null")
    return {"pixels": scores.totals(tasks), "grid": scores.totals(tasks, override=grid), "none": scores.totals(tasks, skip=box)}


def test_there_are_fifteen_models_and_all_their_questions(models, tasks):
    assert models.count() == 15 and tasks.count() == 15 * 28
    assert [tuple(r) for r in tasks.groupBy("model_id").agg(F.sum("n").alias("n")).select("n").distinct().collect()] == [(11193,)]


def test_composites_of_stored_components(tasks):
    part = lambda a, b: F.col(f"t.{a}.{b}")
    made = scores.composite(part("components", "other"), part("components", "accuracy"), part("components", "instruction_following"), part("weights", "other"), part("weights", "accuracy"), part("weights", "instruction_following"))
    assert tasks.where(made != F.col("score")).count() == 0


def test_composites_of_boxes_on_a_grid(tasks, readings):
    part = lambda a, b: F.col(f"t.{a}.{b}")
    boxes = readings.select("model_id", F.explode("tasks").alias("task", "r")).where("not coalesce(r.native, false) and r.mean_iou is not null and r.grid is not null")
    made = scores.composite(F.col("r.mean_iou"), F.col("r.accuracy"), part("components", "instruction_following"), part("weights", "other"), part("weights", "accuracy"), part("weights", "instruction_following"))
    both = boxes.join(tasks, ["model_id", "task"]).select((made - F.col("r.grid")).alias("off"))
    assert both.count() == 27 and both.where("abs(off) > 1e-9").count() == 0


def test_totals_in_three_readings(tasks, readings):
    for name, made in _totals(tasks, readings).items():
        both = made.join(readings.select("model_id", F.col(f"total.{name}").alias("published")), "model_id")
        assert both.count() == 15 and both.where("abs(total - published) > 1e-9").count() == 0, name


def test_wins_and_summaries(models, tasks):
    wins = scores.task_wins(tasks).join(models, "model_id")
    assert wins.count() == 15 and wins.where("wins != summary.task_wins or ties != 0").count() == 0
    said = scores.task_summary(tasks).join(models.select("model_id", "summary"), "model_id")
    off = "abs(mean - summary.unweighted_mean_task_score) > 1e-9 or abs(median - summary.median_task_score) > 1e-9 or minimum != summary.minimum or maximum != summary.maximum"
    assert said.count() == 15 and said.where(off).count() == 0


# expected frontiers, cheapest first: fixed values
FRONTIERS = {
    "pixels": ["gemma431", "qwen36or", "luna56", "gemini38", "opus55", "astra6"],
    "grid": ["gemma431", "qwen36or", "gemini38", "qwen38max", "opus55", "astra6"],
    "none": ["gemma431", "qwen36or", "minimax3", "gemini38", "opus55", "astra6"],
}


@pytest.mark.parametrize("by", [scores.frontier, scores.frontier_pairs])
def test_frontiers(models, tasks, readings, by):
    for name, made in _totals(tasks, readings).items():
        points = made.join(models.where("featured"), "model_id").select("model_id", F.col("usage.cost_usd").alias("cost"), F.col("total").alias("score"))
        assert [r["model_id"] for r in by(points).orderBy("cost").collect()] == FRONTIERS[name]


def test_costs(models, tasks):
    u, rule = "usage.metering", "usage.metering.rule"
    tokens = metering.clip_tokens(F.col(f"{rule}.kind"), F.lit(1280), F.lit(720), F.lit(8), F.col(f"{rule}.patch"), F.col(f"{rule}.multiplier"), F.col(f"{rule}.tokens_per_pixel"), F.col(f"{rule}.tokens_per_frame"))
    hour = metering.hourly_cost(tokens, F.col(f"{u}.prompt_price"), F.col(f"{u}.prompt_price"), F.col(f"{u}.completion_price"), F.col(f"{u}.output_tokens_per_query"), F.lit(8), F.lit(1))
    off = F.abs(hour["total_usd"] / F.col("usage.cost_per_video_hour_usd") - 1)
    assert models.select(F.count_distinct(f"{rule}.kind")).first()[0] == 4
    assert models.where(off.isNull() | (off > 1e-9)).select("model_id", hour["total_usd"], "usage.cost_per_video_hour_usd").collect() == []
    spent = tasks.groupBy("model_id").agg(F.sum("t.usage.cost_usd").alias("spent")).join(models, "model_id")
    assert spent.where("abs(spent - usage.cost_usd) <= 1e-9").count() == 15
    assert models.select(F.round(F.sum("usage.cost_usd"), 2)).first()[0] == 1167.67


def test_group_means_of_a_published_table(spark, tasks):
    """241 of 250 means by questions agree with the printed ones within 0.1."""
    whole = readers.payload(spark, str(FOUND["PUBLISHED"]), PUBLISHED)
    rows = whole.select("models", F.posexplode("rows").alias("at", "r")).where("not r.aggregate or r.source_label = 'MEAN'")
    rows = rows.select(F.explode("models.id").alias("column"), "at", F.col("r.task").alias("task"), F.col("r.aggregate").alias("aggregate"), F.col("r.scores").alias("scores"))
    rows = rows.withColumn("score", F.element_at("scores", F.col("column")))
    grouped = analysis.running_groups(rows, ["column"], "at", F.col("aggregate"))
    sizes = tasks.groupBy("task").agg(F.max("n").alias("n"))
    checked = analysis.published_check(grouped.join(sizes, "task", "left"), ["column"])
    assert (checked.count(), checked.where("agrees").count()) == (250, 241)
