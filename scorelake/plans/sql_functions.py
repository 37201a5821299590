"""Temporary SQL functions for queries written in SQL; Spark puts their bodies into the plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

_SIDES = "least(floor(a[2]), floor(b[2])) - greatest(floor(a[0]), floor(b[0])) + 1", "least(floor(a[3]), floor(b[3])) - greatest(floor(a[1]), floor(b[1])) + 1"
_SHARED = f"greatest({_SIDES[0]}, 0) * greatest({_SIDES[1]}, 0)".replace("floor(", "int(")
_AREAS = "(int(a[2]) - int(a[0]) + 1) * (int(a[3]) - int(a[1]) + 1) + (int(b[2]) - int(b[0]) + 1) * (int(b[3]) - int(b[1]) + 1)"

FUNCTIONS = {
    "composite": (
        "other double, accuracy double, instruction double, w_other double, w_accuracy double, w_instruction double",
        "double",
        "100 * other * w_other + 100 * accuracy * w_accuracy + 100 * instruction * w_instruction",
    ),
    "box_iou": ("a array<double>, b array<double>", "double", f"try_divide(double({_SHARED}), double({_AREAS} - ({_SHARED})))"),
    "clip_tokens": (
        "kind string, w bigint, h bigint, frames bigint, patch int, multiplier double, per_pixel double, per_frame double",
        "double",
        "case kind when 'patch' then frames * ceil(w / patch) * ceil(h / patch) * multiplier when 'area' then frames * per_pixel * (w * h) when 'pair' then ceil(frames / 2) * per_pixel * (w * h) when 'flat' then frames * per_frame end",
    ),
}


def register(spark: SparkSession) -> None:
    """composite, box_iou and clip_tokens for this session."""
    for name, (takes, gives, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({takes}) returns {gives} return {body}")
