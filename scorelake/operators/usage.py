"""Cost, latency and completeness of recorded answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def nearest_rank(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """keys, n and a column for each share q: the sorted value at min(n - 1, floor(n * q))."""
    place = lambda q: lambda n: F.least(n - 1, F.floor(n * F.lit(q)))
    return ranges.order_statistics(rows, keys, value, {name: place(q) for name, q in shares.items()} | {"max": lambda n: n - 1})


def upper_median(rows: DataFrame, keys: list[str], value: str, name: str = "upper_median") -> DataFrame:
    """keys and the sorted value at n div 2."""
    return ranges.order_statistics(rows, keys, value, {name: lambda n: F.floor(n / 2)}).drop("n")


def spread(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, median, population sd, min, max, range."""
    v = F.col(value)
    out = rows.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), (F.max(v) - F.min(v)).alias("spread"))
    out = ranges.joined(out, ranges.quantiles(rows, keys, value, {"median": 0.5}).drop("n"), keys, "left")
    return out.select(*keys, "n", "mean", "median", "sd", "min", "max", "spread")


def quartiles(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Interpolated quartiles; null for keys without values."""
    found = ranges.quantiles(rows, keys, value, {"q1": 0.25, "q2": 0.5, "q3": 0.75}).drop("n")
    return ranges.joined(rows.select(*keys).distinct(), found, keys, "left")


def billed(rows: DataFrame, keys: list[str], cost: str = "cost") -> DataFrame:
    """Sum over receipts, null where there is none, and how many there are."""
    return rows.groupBy(*keys).agg(F.sum(cost).alias("cost"), F.count(cost).alias("receipts"), F.count("*").alias("answers"))


def effective_prices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Costs over tokens; completions without tokens divide by one.  Columns prompt_tokens, completion_tokens, prompt_cost, completion_cost."""
    return rows.groupBy(*keys).agg(
        F.try_divide(F.sum("prompt_cost"), F.sum("prompt_tokens")).alias("prompt"),
        (F.sum("completion_cost") / F.greatest(F.sum("completion_tokens"), F.lit(1))).alias("completion"),
    )


def complete_costs(rows: DataFrame, keys: list[str], detail: str) -> DataFrame:
    """keys, cost: the sum if every record has it, else null."""
    return rows.groupBy(*keys).agg(F.when(F.bool_and(F.col(detail).isNotNull()), F.sum(detail)).alias("cost"))


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last record of each key.  One aggregation: a struct maximum, pre-aggregated before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    ahead = order + [c for c in rest if c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*ahead)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def completeness(rows: DataFrame, keys: list[str], expected: int, scored_at: Column, id_column: str = "id", at: str = "timestamp") -> DataFrame:
    """keys, answered (distinct ids), newest, complete, fresh: all expected are there, and none is newer than the scores."""
    out = rows.groupBy(*keys).agg(F.count_distinct(id_column).alias("answered"), F.max(at).alias("newest"))
    return out.withColumn("complete", F.col("answered") >= expected).withColumn("fresh", F.col("newest") <= scored_at)


def require_complete(status: DataFrame) -> None:
    """Raises where a model is partial or has answers newer than its scores."""
    bad = status.where(~F.col("complete") | ~F.col("fresh")).limit(20).collect()
    if bad:
        raise ValueError(f"partial or stale runs: {bad}")


def run_totals(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of completed, cut-off, fallback and carried answers, and whether all are complete."""
    return rows.groupBy(*keys).agg(
        F.count_if("answered").alias("completed"), F.count("*").alias("total"), F.count_if("truncated").alias("truncated"), F.count_if("fallback").alias("fallbacks"),
        F.count_if("carried").alias("carried"), F.bool_and("answered").alias("all_complete"),
    )


def fit_residuals(rows: DataFrame, keys: list[str], billed_tokens: str, rule_tokens: str, least: int = 20) -> DataFrame:
    """Per shape with at least ``least`` rows: the median billed, the rule's figure, and the residual in percent."""
    big = rows.groupBy(*keys).agg(F.max(rule_tokens).alias("rule"), F.count("*").alias("n")).where(F.col("n") >= least)
    median = ranges.quantiles(rows, keys, billed_tokens, {"billed": 0.5}).drop("n")
    out = ranges.joined(big, median, keys, "left").select(*keys, "billed", "rule", "n")
    return out.withColumn("residual_pct", F.try_divide(100 * (F.col("billed") - F.col("rule")), F.col("rule")))


def top_per(rows: DataFrame, key: str, item: str, k: int = 5) -> DataFrame:
    """The k most frequent items of each key, ties by item.  Counts come first, so the window sees one row an item."""
    counts = rows.groupBy(key, item).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), item))).where(F.col("place") <= k)
