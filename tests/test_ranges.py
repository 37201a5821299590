import random
import statistics

import pytest
from pyspark.sql import functions as F

from scorelake.operators import ranges as R


def rows(seed, n=400):
    """A hot key, null keys and values, ties, and a key without values."""
    rng = random.Random(seed)
    out = [(rng.choice(["hot"] * 6 + ["b", None]), rng.choice([None, 1.0, rng.random() * 10, float(rng.randint(0, 5))]), k, rng.choice(["x", "x", "y", None])) for k in range(n)]
    return [*out, ("none", None, n, "x"), ("one", 7.0, n + 1, None)]


SCHEMA = "k string, v double, at bigint, s string"


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_order_statistics(spark, parts):
    data = rows(parts)
    df = spark.createDataFrame(data, SCHEMA)
    got = {r["k"]: r for r in R.order_statistics(df, ["k"], "v", {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1}, parts).collect()}
    mid = {r["k"]: r["m"] for r in R.quantiles(df, ["k"], "v", {"m": 0.5}, parts).collect()}
    want = {}
    for k, v, *_ in data:
        if v is not None:
            want.setdefault(k, []).append(v)
    assert set(got) == set(want) == set(mid)
    for k, vs in want.items():
        vs.sort()
        assert (got[k]["n"], got[k]["first"], got[k]["mid"], got[k]["last"]) == (len(vs), vs[0], vs[len(vs) // 2], vs[-1])
        assert mid[k] == pytest.approx(statistics.median(vs))
    assert R.order_statistics(df, [], "v", {"last": lambda n: n - 1}, parts).first()["last"] == max(v for _, v, *_ in data if v is not None)
    assert R.order_statistics(df.limit(0), ["k"], "v", {"last": lambda n: n - 1}, parts).count() == 0


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_running_values_runs_and_followers(spark, parts):
    data = rows(parts + 50)
    df = spark.createDataFrame(data, SCHEMA)
    sums = {r["at"]: r["t"] for r in R.running(df, ["k"], ["at"], F.col("v"), "t", until=-1, parts=parts).collect()}
    tops = {r["at"]: r["t"] for r in R.running(df, [], ["at"], F.col("v"), "t", how=F.max, parts=parts).collect()}
    found = {r["at"]: r["run"] for r in R.runs(df, ["k"], ["at"], "s", parts=parts).collect()}
    after = {r["at"]: r["t"] for r in R.following(df, ["at"], "s", "t", parts=parts).collect()}
    upto, top, last, run = {}, None, {}, {}
    for n, (k, v, at, s) in enumerate(data):
        assert sums[at] == (None if not upto.get(k) else pytest.approx(sum(upto[k])))
        if v is not None:
            upto.setdefault(k, []).append(v)
            top = v if top is None else max(top, v)
        assert tops[at] == top
        run[k] = run.get(k, 0) + (k not in last or last[k] != s)
        last[k] = s
        assert found[at] == run[k]
        assert after[at] == (data[n + 1][3] if n + 1 < len(data) else None)


def test_plans_keep_ranges_apart(spark):
    """No window over a whole table, nor over a key without its ranges but for the table of ranges."""
    df = spark.createDataFrame(rows(9), SCHEMA)
    for out in (R.order_statistics(df, ["k"], "v", {"m": lambda n: F.floor(n / 2)}), R.runs(df, ["k"], ["at"], "s"), R.running(df, [], ["at"], F.col("v"), "t")):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line:
                assert R.PART in line or "sum(_c#" in line, line  # _c: rows of a key and range
