import random

import pytest
from pyspark.sql import functions as F

from scorelake.llm import curriculum_mix as C
from tests.llm.helpers import DOCS, WORD, awkward, doc


def brute_targets(sizes):
    """Share all words by weight; what is over three times a source goes round again."""
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    weight = {n: (5, 2, 1)[k % 3] for k, n in enumerate(names)}
    full, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [n for n in names if n not in full]
        level = left / sum(weight[n] for n in open_) if open_ else 0
        over = [n for n in open_ if level * weight[n] > 3 * sizes[n] + 1e-9]
        if not over:
            return full | {n: level * weight[n] for n in open_}
        for n in over:
            full[n] = 3.0 * sizes[n]
            left -= full[n]


@pytest.mark.parametrize("seed", range(4))
def test_against_resharing(spark, seed):
    rng = random.Random(seed)
    rows = [doc(k, " ".join("w" for _ in range(rng.randint(0, 300 if k % 7 else 3))), rng.choice(["a", "b", "é", "zz", "Z", None, "", "c"][: 3 + 2 * seed])) for k in range(300)]
    got = C.mix(spark.createDataFrame(rows, DOCS)).collect()
    source, sizes = {r[0]: r[3] for r in rows}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    want, taken = brute_targets(sizes), {}
    for r in got:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(want[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 + 1e-6 for s in sizes)
    assert sorted(map(tuple, got)) == sorted(map(tuple, C.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()))
    # range-sorted by position, and what a document gives is the demand from there on
    places = [r["first_position"] for r in got]
    known = [x for x in places if x is not None]
    assert known == sorted(known) == places[: len(known)] and all(0 <= x <= 1 for x in known)
    assert all((r["first_position"] is None) == (r["n_passes"] == 0) and (r["taken"] > 0 or r["size"] == 0 or r["n_passes"] == 0) for r in got)


def test_many_sources_are_ranked_and_filled_in_ranges(spark):
    rng = random.Random(5)
    sizes = {f"host{k}.example": rng.choice([0, 1, 5, 40, 300]) for k in range(500)}
    got = C.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
    want = brute_targets(sizes)
    assert len(got) == 500 and all(r["target"] == pytest.approx(want[r["source"]]) for r in got)
    assert [r["source"] for r in sorted(got, key=lambda r: r["rank"])] == sorted(sizes)


def test_positions_follow_the_schedule(spark):
    rows = [doc(k, "w " * 10, s) for k in range(600) for s in "ab"]
    rows = [(2 * r[0] + (r[3] == "b"), *r[1:]) for r in rows]
    out = C.training_order(spark.createDataFrame(rows, DOCS)).collect()
    half = len(out) // 2
    share = lambda part: sum(r["source"] == "a" for r in part) / len(part)
    # the first source's rate falls over time, the second's is even
    assert share(out[half:]) < share(out[:half]) and set(out[0].asDict()) == set(DOCS.replace(" bigint", "").replace(" string", "").split(", "))


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    assert C.mix(df).count() == len(awkward())
    assert C.training_order(df).columns == df.columns
    # documents without words have their place too, once
    few = spark.createDataFrame([*[doc(k, "w " * 10) for k in range(10)], doc(100, ""), doc(101, None)], DOCS)
    assert sorted(r["doc_id"] for r in C.training_order(few).collect()) == [*range(10), 100, 101]
    nothing = spark.createDataFrame([doc(1, ""), doc(2, None, None)], DOCS)
    assert sorted((r["size"], r["target"], r["taken"]) for r in C.mix(nothing).collect()) == [(0, 0.0, 0), (0, 0.0, 0)]
    assert C.training_order(nothing).count() == 2 and {r["first_position"] for r in C.mix(nothing).collect()} == {0.0}
    assert C.mix(spark.createDataFrame([], DOCS)).count() == 0 and C.training_order(spark.createDataFrame([], DOCS)).count() == 0


def test_rows_without_doc_id_spread_by_their_text(spark):
    rng = random.Random(11)
    rows = [(None, *doc(k, " ".join(f"w{rng.random()}" for _ in range(rng.randint(0, 40))), rng.choice(["a", "b"]))[1:]) for k in range(600)]
    df = spark.createDataFrame(rows, DOCS)
    buckets = df.select(F.substring(C.order_hash(), 1, 3)).distinct().count()
    assert buckets > 500
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(WORD.findall(r[1]))
    want, got = brute_targets(sizes), C.mix(df).collect()
    taken = {}
    for r in got:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    assert len(got) == 600 and len(set(sizes.values())) == 2 and all(abs(taken[n] - want[s]) <= 0.5 + 1e-6 for s, n in sizes.items())
    again = C.training_order(spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert sorted(map(str, again)) == sorted(map(str, C.training_order(df).collect())) and len(again) > 300
