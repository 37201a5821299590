import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorelake.functions import identity, metering
from scorelake.operators import analysis, joins, marking, scores, usage
from scorelake.plans import dims
from scorelake.plans.evaluation import Evaluation


def rows_of(df, *order):
    return sorted(tuple(r) for r in (df.select(*order) if order else df).collect())


def test_totals(spark):
    ts = spark.createDataFrame([("m", "A", 90.0, 300), ("m", "B", 50.0, 100)], "model_id string, task string, score double, n int")
    other = spark.createDataFrame([("m", "B", 90.0)], "model_id string, task string, score double")
    assert rows_of(scores.totals(ts), "total") == [(80.0,)]
    assert rows_of(scores.totals(ts, skip=["A"]), "total") == [(50.0,)]
    assert rows_of(scores.totals(ts, override=other), "total") == [(90.0,)]
    assert rows_of(scores.totals(ts, skip=["A", "B"])) == []


def test_wins_and_ties(spark):
    ts = spark.createDataFrame([("a", "T1", 90.0), ("a", "T2", 50.0), ("b", "T1", 80.0), ("b", "T2", 50.0), ("c", "T1", 1.0)], "model_id string, task string, score double")
    assert rows_of(scores.task_wins(ts)) == [("a", 1, 1), ("b", 0, 1), ("c", 0, 0)]


POINTS = [("cheap", 1.0, 60.0), ("dominated", 5.0, 55.0), ("mid", 10.0, 70.0), ("top", 100.0, 80.0), ("pricier_same", 200.0, 80.0)]


def test_frontier_forms_agree(spark):
    p = spark.createDataFrame([*POINTS, ("none", None, 99.0)], "model_id string, cost double, score double")
    want = ["cheap", "mid", "pricier_same", "top"]
    assert [r[0] for r in rows_of(scores.frontier(p))] == want == [r[0] for r in rows_of(scores.frontier_pairs(p))]
    rng = random.Random(1)
    many = spark.createDataFrame([(str(k), float(rng.randint(0, 9)), float(rng.randint(0, 9))) for k in range(60)], "model_id string, cost double, score double")
    assert rows_of(scores.frontier(many)) == rows_of(scores.frontier_pairs(many))
    assert [r["next_cost"] for r in scores.budget_ranges(p, "model_id").orderBy("cost").collect()] == [10.0, 100.0, 200.0, None]


def test_nearest_rank_differs_from_percentiles(spark):
    rng = random.Random(2)
    data = [("a", float(v)) for v in range(1, 101)] + [("b", float(rng.randint(0, 5))) for _ in range(37)] + [("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    got = {r["k"]: r for r in usage.nearest_rank(df, ["k"], "v", {"p25": 0.25, "p95": 0.95}).collect()}
    for k in "ab":
        values = [v for n, v in data if n == k]
        assert (got[k]["n"], got[k]["p25"], got[k]["p95"]) == (len(values), sorted(values)[len(values) // 4], sorted(values)[min(len(values) - 1, int(len(values) * 0.95))])
    assert got["a"]["p25"] == 26.0 and "c" not in got
    assert dict(rows_of(usage.upper_median(df, ["k"], "v")))["a"] == 51.0


def test_costs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", None)], "k string, cost double")
    assert rows_of(usage.billed(df, ["k"])) == [("a", 1.0, 1, 2), ("b", None, 0, 1)]
    assert rows_of(usage.complete_costs(df, ["k"], "cost")) == [("a", None), ("b", None)]


def test_latest_and_completeness(spark):
    t = dt.datetime
    df = spark.createDataFrame([("m", "q", 1, t(2024, 1, 1), "old"), ("m", "q", 2, t(2024, 1, 2), "new"), ("m", "r", 1, t(2024, 1, 3), "x")], "model string, id string, line int, timestamp timestamp, answer string")
    assert rows_of(usage.latest(df, ["model", "id"], ["line"]), "id", "answer") == [("q", "new"), ("r", "x")]
    ok = usage.completeness(df, ["model"], 2, F.lit(t(2024, 1, 4)))
    usage.require_complete(ok)
    for bad in (usage.completeness(df, ["model"], 3, F.lit(t(2024, 1, 4))), usage.completeness(df, ["model"], 2, F.lit(t(2024, 1, 2)))):
        with pytest.raises(ValueError):
            usage.require_complete(bad)


def test_metering(spark):
    df = spark.createDataFrame([("flat", None, None, None, 63.0), ("patch", 16, 2.0, None, None), ("pair", None, None, 0.5, None), ("area", None, None, 0.5, None)], "kind string, patch int, mult double, pp double, pf double")
    tokens = metering.clip_tokens(F.col("kind"), F.lit(33), F.lit(16), F.lit(3), F.col("patch"), F.col("mult"), F.col("pp"), F.col("pf"))
    assert rows_of(df.select("kind", tokens.alias("t"))) == [("area", 3 * 0.5 * 33 * 16), ("flat", 189.0), ("pair", 2 * 0.5 * 33 * 16), ("patch", 3 * 3 * 1 * 2.0)]
    c = df.where("kind = 'flat'").select(metering.hourly_cost(F.lit(504.0), F.lit(1e-6), F.lit(1e-6), F.lit(10e-6), F.lit(200.0), F.lit(8), F.lit(1)).alias("c")).first()["c"]
    assert (c["frames_per_hour"], c["queries_per_hour"]) == (3600.0, 450.0)
    assert c["input_usd"] == pytest.approx(450 * (504e-6 + 110e-6)) and c["output_usd"] == pytest.approx(450 * 200 * 10e-6)


def test_pairs_and_eligibility(spark):
    df = spark.createDataFrame([("s", 0, 1.0), ("s", 1, 0.0), ("s", 2, 1.0), ("s", 3, 1.0), ("t", 0, 0.0), ("t", 1, 1.0), ("t", 2, 1.0)], "s string, q int, a double")
    assert rows_of(marking.pair_halves(df, ["s"], "q", "a")) == [("s", 0, 1.0, None), ("s", 1, 0.0, None), ("s", 2, 1.0, 1), ("s", 3, 1.0, 1), ("t", 0, 0.0, None), ("t", 1, 1.0, 1), ("t", 2, 1.0, None)] 
    shifted = spark.createDataFrame([("s", 0, None), ("s", 1, 1.0)], "s string, q int, a double")
    assert rows_of(marking.released_pairs(shifted, ["s"], "q", "a")) == [("s", 0)]
    assert rows_of(marking.released_pairs(df, ["s"], "q", "a")) == [("s", 2), ("t", 1)]
    e = spark.createDataFrame([("a", "x", None), ("a", "y", None), ("b", "x", None), ("b", " ", None), ("c", "x", "bad")], "s string, answer string, error string")
    assert rows_of(marking.eligible_samples(e, ["s"])) == [("a", 2, True, None, None), ("b", 2, False, "incomplete_sample", None), ("c", 1, False, "invalid_sample", "bad")]
    assert rows_of(marking.with_eligible(e, ["s"]).select("s", "eligible").distinct()) == [("a", True), ("b", False), ("c", False)]


def test_evaluation_of_hand_made_answers(spark):
    schema = "model_id string, task string, sample_index int, question_index int, raw_question string, reference string, reference_box array<double>, answer string"
    rows = [
        ("m", "Sign_Sign_Relation", 0, 0, "image;which?", "1/2", None, "1"), ("m", "Sign_Sign_Relation", 0, 1, "image;which?", "1/2", None, "1/2"),
        ("m", "VRU_Cross", 0, 0, "image;is? ['yes', 'no', 'car']", "yes", None, "yes"), ("m", "VRU_Cross", 0, 1, "image;is? ['yes', 'no', 'car']", "no", None, "yes"), ("m", "VRU_Cross", 0, 2, "image;is? ['yes', 'no', 'car']", "car", None, "car"),
        ("m", "Weather", 0, 0, "image;what? ['sun', 'rain']", "sun", None, "sun"), ("m", "Weather", 1, 0, "image;what? ['sun', 'rain']", "sun", None, ""),
        ("m", "Risk_Prediction", 0, 0, "image;is? ['car']", "car", None, "car"),
        ("m", "VRU_Recognition", 0, 0, "image;where is it located in the image?", "", [1.0, 1.0, 9.0, 9.0], "[1.2.3, 2, 3, 4]"),
    ]
    got = {r["task"]: r for r in Evaluation(spark.createDataFrame(rows, schema)).task_scores().collect()}
    assert got["Sign_Sign_Relation"]["score"] == pytest.approx(87.5)
    assert (got["VRU_Cross"]["accuracy"], got["VRU_Cross"]["other"]) == (1.0, 0.5) and got["VRU_Cross"]["score"] == pytest.approx(65)
    assert got["Weather"]["score"] == pytest.approx(100) and got["Weather"]["questions"] == 1
    assert (got["Risk_Prediction"]["score"], got["Risk_Prediction"]["code"]) == (None, "undefined_component")
    assert (got["VRU_Recognition"]["score"], got["VRU_Recognition"]["code"]) == (None, "scorer_error")


def test_dims(spark):
    assert dims.task_families(spark).count() == 28
    assert rows_of(dims.task_weights(spark).where(F.abs(F.col("w_other") + F.col("w_accuracy") + F.col("w_instruction") - 1) > 1e-9)) == []


def test_first_of_kind(spark):
    df = spark.createDataFrame([("t", k, kind) for k, kind in enumerate(["plain", "plain", "box", "box", "judged"])], "task string, sample_index int, kind string")
    assert [r[0] for r in rows_of(marking.first_of_kind(df), "sample_index")] == [0, 2, 4]


def test_what_if_partners(spark):
    sizes = spark.createDataFrame([("T", "speed", "s", 4), ("T", "speed", "odd", 5), ("C", "choice", "s", 4)], "task string, family string, sample string, n int")
    gone = spark.createDataFrame([("T", "s", 0), ("T", "odd", 0), ("C", "s", 3)], "task string, sample string, position long")
    assert rows_of(analysis.with_partners(gone, sizes)) == [("C", "s", 3), ("T", "odd", 0), ("T", "s", 0), ("T", "s", 2)]


def test_what_if_in_one_pass(spark):
    """Partners go in paired families and samples of even size only; faults of one answer leave its sample out; tasks without a kept row keep their score."""
    schema = "model_id string, task string, sample_index int, question_index int, raw_question string, reference string, reference_box array<double>, answer string, excluded boolean"
    row = lambda task, s, q, ref, answer, gone=False: ("m", task, s, q, "image;Which? Options: ['a', 'b']", ref, None, answer, gone)
    rows = [
        row("Sign_Sign_Relation", 0, 0, "1", "1", True), row("Sign_Sign_Relation", 0, 1, "2", "9"), row("Sign_Sign_Relation", 0, 2, "1", "1"), row("Sign_Sign_Relation", 0, 3, "2", "2"),
        row("Sign_Sign_Relation", 1, 0, "1", "1", True), row("Sign_Sign_Relation", 1, 1, "2", "2"), row("Sign_Sign_Relation", 1, 2, "3", "3"),
        row("Weather", 0, 0, "a", "a", True), row("Weather", 0, 1, "a", "b"), row("Weather", 1, 0, "a", "a"), row("Weather", 1, 1, "a", " "), row("Light", 0, 0, "a", "a", True),
        row("Sign_Lane_Relation", 0, 0, "x", "1"), row("Sign_Lane_Relation", 0, 1, "1", "1"),
    ]
    run = Evaluation(spark.createDataFrame(rows, schema))
    got = {r["task"]: (r["n"], r["kept_n"]) for r in run.what_if().collect()}
    assert got == {"Sign_Sign_Relation": (7, 4), "Weather": (2, 1), "Light": (1, None)}
    kept = {r["task"]: r["kept_score"] for r in run.what_if().collect()}
    assert kept["Weather"] == pytest.approx(20.0) and kept["Sign_Sign_Relation"] == pytest.approx(30 * 2 * 2 / 4 + 50 * 0.75 + 20)
    assert rows_of(analysis.totals_of_parts(run.what_if()).select("questions")) == [(6,)]


def test_evaluation_shuffles_once_by_sample(spark):
    """Texts are not shuffled: a sample's rows meet as marks."""
    from scorelake.plans.whole import _what_if

    sf = "/root/testdata/sf0.001"
    plan = _what_if(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2 and plan.count("lineitem.parquet") == 1


def test_boxes_on_a_grid_are_made_after_their_join(spark):
    """Rows are sorted without boxes and texts; marks are those of the join inside."""
    from scorelake.operators import readings
    from scorelake.plans.queries import QUERIES

    plan = QUERIES["grid_overlaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "nowhere" not in plan[plan.index("Join Inner") :]
    boxes = spark.createDataFrame([(1, "grid", [0.0, 0.0, 9.0, 9.0], "[0, 0, 5, 10]"), (2, "grid", [0.0, 0.0, 9.0, 9.0], "none")], "id int, convention string, reference array<double>, answer string")
    sizes = spark.createDataFrame([(1, 2000, 1000), (2, 2000, 1000)], "id int, width int, height int")
    got = rows_of(readings.grid_marks(boxes, sizes).select("id", "grid_iou"))
    assert got == rows_of(readings.grid_marks(boxes.join(sizes, "id")).select("id", "grid_iou")) and got[0][1] > 0 and got[1][1] == 0


def test_what_if_scores_and_totals(spark):
    schema = "model_id string, task string, family string, sample int, position long, kind string, accuracy double, instruction int, other double, pair int"
    rows = [("m", "VRU_Cross", "judge", 0, 0, "judgment", 1.0, 1, 1.0, None), ("m", "VRU_Cross", "judge", 0, 1, "description", 0.0, 1, None, None), ("m", "Weather", "choice", 0, 0, "choice", 1.0, 0, None, None)]
    gone = spark.createDataFrame([("VRU_Cross", 0, 0), ("Weather", 0, 0)], "task string, sample int, position long")
    got = analysis.what_if(spark.createDataFrame(rows, schema), gone, dims.task_weights(spark))
    assert rows_of(got) == [("m", "VRU_Cross", pytest.approx(20.0), 1)]  # no judgment is left: that part is 0; nothing of the other task is
    before = spark.createDataFrame([("m", "VRU_Cross", 50.0, 2), ("m", "Weather", 80.0, 1), ("m", "Light", None, 5)], "model_id string, task string, score double, n int")
    assert rows_of(analysis.what_if_totals(before, got)) == [("m", pytest.approx(50.0), 2)]


def test_denominators(spark):
    rows = [("speed", 0, True, True, "choice")] * 3 + [("speed", 1, False, False, "choice")] * 2 + [("judge", 2, True, True, "judgment"), ("judge", 2, True, True, "description")]
    got = marking.denominators(spark.createDataFrame(rows, "family string, sample_index int, answered boolean, eligible boolean, kind string").withColumn("task", F.col("family")), ["task"])
    assert rows_of(got) == [("judge", 1, 2, 2, 1, 2, 0, 1, 1, 0), ("speed", 2, 5, 3, 1, 3, 0, 0, 0, 1)]


def test_invalid_samples_and_bad_references_are_left_out(spark):
    schema = "model_id string, task string, sample_index int, question_index int, raw_question string, reference string, reference_box array<double>, answer string, error string"
    q = "image;what? ['sun', 'rain']"
    rows = [("m", "Weather", 0, 0, q, "sun", None, "sun", None), ("m", "Weather", 1, 0, q, "sun", None, "rain", "bad"), ("m", "Weather", 2, 0, q, "sun", None, "rain", None), ("m", "Weather", 2, 1, q, "", None, "rain", None)]
    run = Evaluation(spark.createDataFrame(rows, schema))
    assert [(r["score"], r["n"]) for r in run.task_scores().collect()] == [(100.0, 1)]
    d = run.denominators().first()
    assert (d["samples_expected"], d["samples_scored"], d["questions_received"], d["questions_scored"]) == (3, 1, 4, 1)


def test_label_operators(spark):
    df = spark.createDataFrame([("k", "a", 3), ("k", "b", 1), ("k", "b", 2), ("k", "a", 4)], "k string, label string, at int")
    assert rows_of(analysis.majority(df, ["k"], "label", "at")) == [("k", "b", 0.5)]
    runs = spark.createDataFrame([("k", 1, "x"), ("k", 2, "x"), ("k", 3, None), ("k", 4, None), ("k", 5, "x")], "k string, at int, v string")
    assert rows_of(analysis.islands(runs, ["k"], ["at"], "v"), "run", "n") == [(1, 2), (2, 2), (3, 1)]
    a, b = (spark.createDataFrame(r, "task string, mean double") for r in ([("x", 2.0), ("y", 1.0)], [("x", 1.5), ("z", 1.0)]))
    assert rows_of(analysis.shift(a, b), "task", "shift") == [("x", 0.5), ("y", 0.0), ("z", 0.0)]


def test_joins(spark):
    q = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    a = spark.createDataFrame([("m", 1), ("m", 1), ("m", 9), ("n", 1), ("n", 2), ("n", 3)], "model_id string, id long")
    assert rows_of(joins.pending(q, a.where("model_id = 'm'"))) == [(2,), (3,)]
    assert rows_of(joins.valid(a, q)).count((1, "m")) + rows_of(joins.valid(a, q), "id", "model_id").count((9, "m")) == 2
    assert rows_of(joins.coverage(a, q), "model_id", "covered") == [("m", False), ("n", True)]
    mine = spark.createDataFrame([("a", "h1", "old", "stop"), ("b", "h1", "old", "length"), ("c", "h2", "new", None)], "id string, request_hash string, condition string, finish_reason string")
    may = spark.createDataFrame([("a", "h1", "old", False), ("b", "h1", "old", False), ("c", "h2", "new", True)], "id string, request_hash string, condition string, current boolean")
    assert [r[0] for r in rows_of(joins.carried(mine, may), "id")] == ["a", "c"]


def test_identity(spark):
    df = spark.createDataFrame([('{"b": 1, "a": [1.0, "é"]}',), (None,)], "j string")
    got = [r[0] for r in df.select(identity.canonical_digest(F.col("j"))).collect()]
    assert got == [identity.digest({"a": [1.0, "é"], "b": 1}), None]
    sample = '{"questions": ["a;b"], "reference": [1.50]}'
    listed = ["r", "T", 0, 1, identity.digest({"questions": ["a;b"], "reference": [1.5]})]
    assert spark.range(1).select(identity.question_id(F.lit("r"), F.lit("T"), F.lit(0), F.lit(1), F.lit(sample))).first()[0] == identity.digest(listed)[:24]
    payload = {"model": "m", "messages": [{"role": "user", "content": [{"type": "image_url", "image_url": {"url": "u/é", "detail": "low"}}, {"type": "text", "text": 'say "x"\n'}]}], "max_tokens": 9, "reasoning": {"effort": "high"}}
    made = identity.request_digest(F.lit("m"), F.lit('say "x"\n'), F.array(F.lit("u/é")), F.lit(9), F.lit("high"), F.lit("reasoning"), detail="low")
    assert spark.range(1).select(made).first()[0] == identity.digest(payload)
    pair = spark.createDataFrame([("ab", "c"), ("a", "bc")], "x string, y string").select(identity.short_id(F.col("x"), F.col("y")).alias("i")).distinct().count()
    assert pair == 2


def test_grid_composite(spark):
    from scorelake.operators import readings

    w = dict(w_other=0.3, w_accuracy=0.5, w_instruction=0.2)
    rows = [("all", "box", 0.0, 1, 1.0), ("mixed", "box", 1.0, 1, 0.0), ("mixed", "choice", 1.0, 1, None), ("mixed", "choice", 1.0, 1, None), ("mixed", "choice", 0.0, 1, None)]
    df = spark.createDataFrame(rows, "task string, kind string, accuracy double, instruction int, grid_iou double").select("*", *[F.lit(v).alias(k) for k, v in w.items()])
    got = {r["task"]: r for r in readings.grid_composite(df, ["task"]).collect()}
    assert got["all"]["score"] == pytest.approx(100) and got["mixed"]["accuracy"] == 0.5 and got["mixed"]["hits"] == 0


def test_reference_errors_and_order(spark):
    from scorelake.operators import exports

    df = spark.createDataFrame([("grounding", "", None), ("grounding", "", [1.0, 1.0, 2.0]), ("grounding", "", [1.0, 1.0, 2.0, 2.0]), ("grounding", "", [1.0, 1.0, 2.0, float("inf")]), ("relation", "1/2/3", None), ("relation", None, None), ("speed", "to [1, 2]", None), ("choice", "", None), ("choice", " ", None)], "f string, t string, b array<double>")
    got = [r[0] for r in df.select(exports.reference_errors(F.col("f"), F.col("f") == "grounding", F.col("t"), F.col("b"))).collect()]
    assert got == ["bad box", "bad box", None, "bad box", None, "bad relation", None, "empty reference", None]
    s = spark.createDataFrame([("g", 1, 2.0), ("g", 2, None), ("g", 3, 2.0), ("h", 4, 9.0)], "g string, at int, v double")
    assert [r["at"] for r in s.orderBy(*exports.by_statistic("v", "g", "at")).collect()] == [3, 1, 2, 4]
    assert [r["at"] for r in s.orderBy(*exports.by_statistic("v", "g", "at", descending=False)).collect()] == [2, 1, 3, 4]


def test_filters_and_orders_of_reports(spark):
    from scorelake.operators import exports

    df = spark.createDataFrame([("a", 1.0, None, True), ("b", None, 2.0, None), ("c", 0.5, 1.0, False)], "model_id string, p95 double, total double, featured boolean")
    with pytest.raises(ValueError):
        exports.of_models(df, [])
    assert [r[0] for r in exports.serving_order(df).collect()] == ["a"] and [r[0] for r in exports.by_cost(df, "p95").collect()] == ["c", "a"]
    assert [r[0] for r in exports.published_columns(df).collect()] == ["c", "b"] and exports.of_groups(df, [], "model_id").count() == 3
    paths = [("a/b", True), ("/a", False), ("a/../b", False), ("a\\b", False), ("", False), (".", False), ("..a/b", True), (None, False)]
    assert [r[0] for r in spark.createDataFrame([(p,) for p, _ in paths], "p string").select(identity.is_relative_path(F.col("p"))).collect()] == [w for _, w in paths]
    cell = spark.range(1).select(exports.mark_cell(F.lit(1 / 3), F.lit(2 / 3)).alias("c")).first()["c"]
    assert tuple(cell) == (0.333333, 0.6667)
