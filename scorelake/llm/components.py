"""Connected components of links between long ids, by alternating large-star and small-star rounds.

Every round is two aggregations and two joins.  The least neighbour of a node is
pre-aggregated before its shuffle, and both join sides are plain shuffled tables, so
that adaptive execution may split the rows of a node with very many links.  Nothing is
collected but a row count and a checksum a round, which tell when links stop changing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: u > v, distinct.  One star step; the result is again u > v, distinct."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = links.select("u", "v")
    with scratch(links.sparkSession):
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        joined = both.join(least, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").union(least.select("u", F.col("m").alias("v")))
        return written(out.where("u > v").distinct(), "star", outlives=True)


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Rows (node, component) for every node that has a link; component is the least id reachable.

    Links with a null end or from a node to itself are ignored.  No links: no rows.
    """
    now = written(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).alias("x"), F.col(b).alias("y"))
        .where("x is not null and y is not null and u > v").select("u", "v").distinct(),
        "links",
    )
    seen = None
    for _ in range(rounds):
        now = _star(_star(now, large=True), large=False)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
