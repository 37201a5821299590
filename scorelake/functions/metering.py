"""Tokens of frames and costs of queries, as column expressions over a rule's columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_TOKENS = 110


def clip_tokens(kind: Column, w: Column, h: Column, frames: Column, patch: Column, multiplier: Column, per_pixel: Column, per_frame: Column) -> Column:
    """patch: whole patches a frame; area: by pixels; pair: by pixels of every two frames; flat: a number a frame."""
    area = w * h
    return (
        F.when(kind == "patch", frames * F.ceil(w / patch) * F.ceil(h / patch) * multiplier)
        .when(kind == "area", frames * per_pixel * area)
        .when(kind == "pair", F.ceil(frames / 2) * per_pixel * area)
        .when(kind == "flat", frames * per_frame)
        .cast("double")
    )


def input_price(rate: Column, prompt: Column, cache_write: Column) -> Column:
    """The price that a rule names, or the prompt's where it has none."""
    return F.coalesce(F.when(rate == "input_cache_write", cache_write), prompt)


def hourly_cost(tokens: Column, input_rate: Column, prompt: Column, completion: Column, output_tokens: Column, frames_per_query: Column, fps: Column) -> Column:
    """struct<frames_per_hour, queries_per_hour, input_usd, output_usd, total_usd>; tokens are those of one query's clip."""
    frames = (fps * 3600).cast("double")
    queries = frames / frames_per_query
    per_in = tokens * input_rate + TEXT_TOKENS * prompt
    per_out = output_tokens * completion
    return F.struct(
        frames.alias("frames_per_hour"), queries.alias("queries_per_hour"), (queries * per_in).alias("input_usd"), (queries * per_out).alias("output_usd"), (queries * (per_in + per_out)).alias("total_usd")
    )
