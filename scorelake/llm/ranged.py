"""Scans along the rows of a group in an order, for groups of any size.

Rows are dealt by ranges of (group, order), so a large group lies in several tasks.  Each task
scans its own part in numpy; what the parts before it hold of its first group is folded on the
driver from one row a part, and added afterwards.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import width, written

_M = 1 << 64


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**n modulo 2**64."""
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def power(base: int, n: np.ndarray) -> np.ndarray:
    """base**n modulo 2**64 for each n >= 0."""
    out, b, left = np.ones(len(n), np.uint64), np.uint64(base), n.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * b, out)
        with np.errstate(over="ignore"):
            b = b * b
        left = left >> np.uint64(1)
    return out


class Carry:
    """Places and polynomial sums along runs of equal groups, batch after batch."""

    def __init__(self, base: int) -> None:
        self.base, self.back = base, pow(base, -1, _M)
        self.group, self.n, self.h = None, 0, np.uint64(0)

    def step(self, group: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(group)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        on = self.group is not None and group[0] == self.group
        starts = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        up, down = powers(self.base, n), powers(self.back, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(value.view(np.uint64) * down[:n], out=sums[1:])
        at = np.arange(n)
        h = (sums[1:] - sums[starts][run]) * up[:n]
        place = at - starts[run]
        if on:
            first = run == 0
            h[first] += self.h * up[1:][first]
            place[first] += self.n
        self.group, self.n, self.h = group[-1], int(place[-1]) + 1, h[-1]
        return place, h


def scan(rows: DataFrame, group: str, order: list[Column], value: str, base: int, name: str) -> DataFrame:
    """Adds place (from 0 in the group's order) and h = sum of value(k) * base**(place - k) modulo 2**64 over k <= place.

    group: bigint, not null.  value: bigint, not null.  base: odd; 1 gives running sums.
    The result is a written table.  Rows equal in group and order lie in one task.
    """
    spark = rows.sparkSession
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", _part int, place bigint, h bigint"

    def run(batches):
        carry, part = Carry(base), TaskContext.get().partitionId()
        for b in batches:
            if len(b):
                place, h = carry.step(b.column(group).to_numpy(), b.column(value).to_numpy())
                more = [pa.array(np.full(len(b), part, np.int32)), pa.array(place), pa.array(h.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "_part", "place", "h"])

    dealt = rows.repartitionByRange(width(spark), F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    parts = written(dealt.mapInArrow(run, schema), name)
    last = F.max_by(F.struct((F.col("place") + 1).alias("n"), "h"), F.struct(group, "place"))
    edges = sorted(parts.groupBy("_part").agg(F.min(group).alias("a"), F.max(group).alias("b"), last.alias("c")).collect())  # a row a part
    bases, before = [], (None, 0, 0)
    for part, a, b, (n, h) in edges:
        g, n0, h0 = before
        on = g is not None and a == g
        if on:
            bases.append((part, a, n0, h0 - _M if h0 >= _M >> 1 else h0))
        h %= _M
        before = (b, n + n0, (h + h0 * pow(base, n, _M)) % _M) if on and a == b else (b, n, h)
    if not bases:
        return parts.drop("_part")

    @F.pandas_udf("bigint")
    def added(h: pd.Series, h0: pd.Series, place: pd.Series) -> pd.Series:
        return pd.Series((h.to_numpy().view(np.uint64) + h0.to_numpy().view(np.uint64) * power(base, place.to_numpy() + 1)).view(np.int64))

    known = spark.createDataFrame(bases, "_part int, _group bigint, _n bigint, _h bigint")
    joined = parts.join(F.broadcast(known), "_part", "left").withColumn("_on", F.coalesce(F.col(group) == F.col("_group"), F.lit(False)))  # a row a part
    h0 = F.when(F.col("_on"), F.col("_h")).otherwise(0)
    place = F.col("place") + F.when(F.col("_on"), F.col("_n")).otherwise(0)
    return joined.select(*rows.columns, place.alias("place"), added(F.col("h"), h0, F.col("place")).alias("h"))
