"""Blocked self-comparison of the rows of a key.

A key with at most ``limit`` rows is one group.  A larger one is cut into shards of about
``limit`` rows, and each pair of shards (i <= j) is one group, so that no task ever
holds more than two shards, every pair of rows still meets, and nothing is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written


def shard_pairs(rows: DataFrame, key: str, spread: Column, limit: int) -> DataFrame:
    """Adds group_i, group_j, shard to the rows of keys that have two or more.

    A row appears once for each group that it takes part in.  ``spread`` is a hash that
    deals the rows of a large key into its shards.
    """
    counts = written(rows.groupBy(key).count().where("count > 1").withColumn("shards", F.ceil(F.col("count") / limit).cast("int")).drop("count"), "keys")
    dealt = rows.join(counts, key).withColumn("shard", F.pmod(spread, F.col("shards")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("shards") - 1),
        lambda o: F.struct(F.least(F.col("shard"), o).cast("int").alias("group_i"), F.greatest(F.col("shard"), o).cast("int").alias("group_j")),
    )
    return dealt.withColumn("g", F.explode(pairs)).select(*[c for c in dealt.columns if c != "shards"], "g.group_i", "g.group_j")


def runs(batches, keys: list[str]):
    """From batches of a partition sorted by keys, one frame for each run of equal keys.

    Holds one run at a time, besides the batch that it is read from.
    """
    import pandas as pd

    parts, at = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        edges = [0, *((k[1:] != k[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(batch)]
        for s, e in zip(edges, edges[1:]):
            here = tuple(k[s])
            if here != at and parts:
                yield pd.concat(parts) if len(parts) > 1 else parts[0]
                parts = []
            at = here
            parts.append(batch.iloc[s:e])
    if parts:
        yield pd.concat(parts) if len(parts) > 1 else parts[0]
