"""Ranks and running values along an order, by ranges of it: no task holds a whole key or table.

A column is cut at ``PARTS`` approximate quantiles, which are read first and written into the plan as numbers, so that a
row's range follows from its value alone.  Ranges are worked by themselves, and what those before add comes from a table
of one row for each key and range.  Cuts decide how even ranges are, never what results.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = 256
PART = "_part"


def _number(rows: DataFrame, column: str) -> Column:
    kind = dict(rows.dtypes)[column]
    if kind.startswith("timestamp"):
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.unix_date(column) if kind == "date" else F.col(column)


def with_parts(rows: DataFrame, column: str, parts: int | None = None) -> DataFrame:
    """Adds the number of the range that a row's value (number, date or time) lies in; nulls lie ahead of all."""
    n = parts or min(PARTS, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))
    v = _number(rows, column)
    found = rows.agg(F.percentile_approx(v, [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    cuts = sorted({x for x in found if not (isinstance(x, float) and math.isnan(x))})

    def at(lo: int, hi: int) -> Column:  # the number of cuts at most as large as v, by halves
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(v < F.lit(cuts[mid]), at(lo, mid)).otherwise(at(mid + 1, hi))

    return rows.withColumn(PART, F.when(v.isNull(), -1).otherwise(at(0, len(cuts))))


def same(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def joined(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys of which null equals null; the keys of a stay."""
    other = b.select(*[F.col(k).alias(f"_right_{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return a.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def ahead(keys: list[str]):
    """The ranges of a key before one's own; there are at most PARTS + 1 of them."""
    return Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)


def order_statistics(rows: DataFrame, keys: list[str], value: str, places: dict[str, Callable[[Column], Column]], parts: int | None = None) -> DataFrame:
    """keys, n (values that are not null), and for each name the value at a place (from 0) of the key's sorted values.

    places: from n to the place.  Rows are counted by key and range; only ranges that hold a place are counted by value.
    """
    known = with_parts(rows.where(F.col(value).isNotNull()).select(*keys, value), value, parts)
    counts = known.groupBy(*keys, PART).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    counts = counts.withColumn("_base", F.coalesce(F.sum("_c").over(ahead(keys)), F.lit(0))).withColumn("_n", F.sum("_c").over(whole))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("_n")).cast("bigint").alias("at")) for name, place in places.items()])
    here = F.filter(wanted, lambda w: (w["at"] >= F.col("_base")) & (w["at"] < F.col("_base") + F.col("_c")))
    spots = counts.select(*keys, PART, "_base", "_n", here.alias("_wanted")).where(F.size("_wanted") > 0)
    fine = joined(known, spots.select(*keys, PART), [*keys, PART], "left_semi").groupBy(*keys, PART, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(*keys, PART).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    fine = joined(fine.withColumn("_upto", F.sum("_c").over(upto)), spots, [*keys, PART])
    end = F.col("_base") + F.col("_upto")
    hit = lambda name: F.exists("_wanted", lambda w: (w["name"] == name) & (w["at"] < end) & (w["at"] >= end - F.col("_c")))
    return fine.groupBy(*keys).agg(F.max("_n").alias("n"), *[F.max(F.when(hit(name), F.col(value))).alias(name) for name in places])


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float], parts: int | None = None) -> DataFrame:
    """keys, n, and interpolated quantiles."""
    at = lambda n, q: (n - 1) * F.lit(q)
    ends = {f"_{side}_{name}": (lambda n, q=q, f=f: f(at(n, q))) for name, q in shares.items() for side, f in (("low", F.floor), ("high", F.ceil))}
    found = order_statistics(rows, keys, value, ends, parts)

    def between(name: str, q: float) -> Column:
        low, part = F.col(f"_low_{name}").cast("double"), at(F.col("n"), q) - F.floor(at(F.col("n"), q))
        return (low + (F.col(f"_high_{name}").cast("double") - low) * part).alias(name)

    return found.select(*keys, "n", *[between(name, q) for name, q in shares.items()])


def running(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str, how: Callable[[Column], Column] = F.sum, until: int = 0, parts: int | None = None) -> DataFrame:
    """Adds the sum (or F.max, F.min) of a value over the rows of a key up to each one (until=0) or before it (until=-1); null where there are none.

    Rows are cut by the first column of the order; equal values of it stay together.
    """
    cut = with_parts(rows.withColumn("_v", value), order[0], parts)
    inside = Window.partitionBy(PART, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
    totals = cut.groupBy(*keys, PART).agg(how("_v").alias("_t"))
    totals = totals.select(*keys, PART, how("_t").over(ahead(keys)).alias("_base"))
    out = joined(cut.withColumn("_own", how("_v").over(inside)), totals, [*keys, PART])
    both = F.coalesce("_own", F.lit(0)) + F.coalesce("_base", F.lit(0)) if how is F.sum else (F.greatest if how is F.max else F.least)("_own", "_base")
    made = F.when(F.col("_own").isNotNull() | F.col("_base").isNotNull(), both)
    return out.withColumn(name, made).drop("_v", "_own", "_base", PART)


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str = "run", parts: int | None = None) -> DataFrame:
    """Adds the number, from 1, of the stretch of equal values (null equals null) that a row lies in."""
    cut = with_parts(rows, order[0], parts)
    w = Window.partitionBy(PART, *keys).orderBy(*order)
    first = F.row_number().over(w) == 1
    differs = ~F.col(value).eqNullSafe(F.lag(value).over(w))
    cut = cut.withColumn("_new", F.when(first, 0).otherwise(differs.cast("int"))).withColumn("_own", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    edges = cut.groupBy(*keys, PART).agg(F.sum("_new").alias("_inner"), F.min_by(F.struct(value), at).alias("_a"), F.max_by(F.struct(value), at).alias("_b"))
    by = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(PART)
    before = F.lag("_b").over(by)
    edges = edges.withColumn("_start", F.when(before.isNull() | ~F.col("_a").eqNullSafe(before), 1).otherwise(0))
    edges = edges.select(*keys, PART, "_start", F.coalesce(F.sum(F.col("_inner") + F.col("_start")).over(ahead(keys)), F.lit(0)).alias("_base"))
    return joined(cut, edges, [*keys, PART]).withColumn(name, F.col("_base") + F.col("_start") + F.col("_own")).drop("_new", "_own", "_start", "_base", PART)


def following(rows: DataFrame, order: list[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """Adds the value of the next row in an order of the whole table; null for the last."""
    cut = with_parts(rows, order[0], parts)
    firsts = cut.groupBy(PART).agg(F.min_by(value, F.struct(*order)).alias("_first"))
    firsts = firsts.select(PART, F.lead("_first").over(Window.partitionBy(F.lit(0)).orderBy(PART)).alias("_next"))  # a row a range
    w = Window.partitionBy(PART).orderBy(*order)
    last = F.row_number().over(Window.partitionBy(PART).orderBy(*[F.desc(c) for c in order])) == 1
    out = joined(cut.withColumn("_lead", F.lead(value).over(w)).withColumn("_last", last), firsts, [PART])
    return out.withColumn(name, F.when(F.col("_last"), F.col("_next")).otherwise(F.col("_lead"))).drop("_lead", "_last", "_next", PART)
