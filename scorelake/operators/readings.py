"""Other readings of the same answers: boxes on a grid, or no boxes at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions.text import let
from .scores import weighted_mean


def grid_marks(boxes: DataFrame, dimensions: DataFrame | None = None) -> DataFrame:
    """Adds grid_iou: answers in their model's convention as pixels; an answer without one box has exactly 0.

    boxes: id, convention, reference (array of four), answer.  dimensions: id, width, height; without them boxes have both, as where
    they were joined before boxes and texts were made, which then are not sorted.
    """
    rows = boxes if dimensions is None else boxes.join(dimensions, "id")
    pixels = lambda b: M.to_pixels(b, F.col("convention"), F.col("width"), F.col("height"))
    iou = let(M.parse_box(F.col("answer")), lambda b: let(pixels(b), lambda p: F.when(p.isNotNull(), M.box_iou(F.col("reference"), p))))
    return rows.withColumn("grid_iou", F.coalesce(iou, F.lit(0.0)))


def grid_composite(marked: DataFrame, keys: list[str], weights: tuple[str, str, str] = ("w_other", "w_accuracy", "w_instruction")) -> DataFrame:
    """keys, accuracy, mean_iou, boxes, hits, score: choices keep their marks, boxes hit with a grid overlap above one half.

    marked: keys, kind, accuracy, instruction, grid_iou and the weights.
    """
    box = F.col("kind") == "box"
    out = marked.groupBy(*keys, *weights).agg(
        F.count("*").alias("n"), F.count_if(box).alias("boxes"), F.count_if(box & (F.col("grid_iou") > 0.5)).alias("hits"),
        F.sum(F.when(~box, F.col("accuracy")).otherwise(0.0)).alias("_right"), F.avg(F.when(box, F.col("grid_iou"))).alias("mean_iou"), F.avg("instruction").alias("instruction"),
    )
    out = out.withColumn("accuracy", (F.col("_right") + F.col("hits")) / F.col("n"))
    other, accuracy, instruction = (F.col(w) for w in weights)
    made = 100 * (F.coalesce("mean_iou", F.lit(0.0)) * other + F.col("accuracy") * accuracy + F.col("instruction") * instruction)
    return out.withColumn("score", made).select(*keys, "accuracy", "mean_iou", "boxes", "hits", "score")


def variants(task_scores: DataFrame, grid: DataFrame) -> DataFrame:
    """model_id and its total by each reading, in one aggregation: pixels, grid (grid scores where there are any), none (without box tasks).

    task_scores: model_id, task, score, n.  grid: model_id, task, score.
    """
    rows = task_scores.join(grid.select("model_id", "task", F.col("score").alias("_grid")), ["model_id", "task"], "left")
    plain = F.col("_grid").isNull()
    return rows.groupBy("model_id").agg(
        weighted_mean(F.col("score"), F.col("n")).alias("pixels"),
        weighted_mean(F.coalesce("_grid", "score"), F.col("n")).alias("grid"),
        weighted_mean(F.when(plain, F.col("score")), F.when(plain, F.col("n"))).alias("none"),
    )
