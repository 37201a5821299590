import hashlib
import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from scorelake.functions import identity, marks
from scorelake.functions import text as T
from scorelake.operators import exports
from scorelake.plans import dims
from scorelake.plans.scoring_run import Model, Spec, candidates, matched, run_stats, scoring_run
from scorelake.sources import annotations, lines


def written(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_lines_of_split_files(spark, tmp_path):
    """Lines keep their numbers however files are split; empty and broken ones count."""
    texts = {n: [f"{n} {k} " + "x" * (k % 50) if k % 9 else "" for k in range(900)] for n in ("a", "b")}
    for n, ls in texts.items():
        written(tmp_path / "f" / n, "\n".join(ls) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        df = lines.numbered(spark, str(tmp_path / "f"))
        assert df.select(F.spark_partition_id()).distinct().count() > 1
        got = {(r["file"][-1], r["line"]): r["value"] for r in df.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {(n, k): v for n, ls in texts.items() for k, v in enumerate(ls)}
    assert lines.numbered(spark, str(tmp_path / "none")).count() == 0


def test_last_line_wins(spark, tmp_path):
    rows = [json.dumps({"id": i, "answer": a}) for i, a in (("q1", "first"), ("q2", "only"), ("q1", "later"))]
    written(tmp_path / "m" / "T.jsonl", "\n".join([rows[0], '{"id": "q1", "answ', rows[1], "", "[1]", rows[2], '{"answer": "no id"}']))
    written(tmp_path / "m" / "U.jsonl", rows[0])
    found = lines.journal(spark, str(tmp_path / "*" / "*.jsonl"))
    got = {(r["model_id"], r["task"], r["id"]): (r["answer"], r["line"]) for r in lines.last_lines(found, ["model_id", "task", "id"]).collect()}
    assert got == {("m", "T", "q1"): ("later", 5), ("m", "T", "q2"): ("only", 2), ("m", "U", "q1"): ("first", 0)}


SAMPLE = {"country": "X", "sequence": "s 1", "front view": ["a.jpg", "b.jpg"], "questions": ["[front view];Which?", "c.png;So?"], "reference": ["A", "b"]}


def asked(spark, tmp_path, name, *samples, raw=None, model=""):
    written(tmp_path / name / f"{name}_E.json", raw or json.dumps(list(samples)))
    return [r.asDict() for r in annotations.questions(spark, str(tmp_path / name), dims.task_families(spark), "r", model).orderBy("sample_index", "question_index").collect()]


def test_questions_of_annotations(spark, tmp_path):
    got = asked(spark, tmp_path, "Weather", SAMPLE, {**SAMPLE, "id": 7})
    digest = lambda v: hashlib.sha256(json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    assert [r["id"] for r in got] == [digest(["r", "Weather", s, q, digest(x)])[:24] for s, x in enumerate([SAMPLE, {**SAMPLE, "id": 7}]) for q in (0, 1)]
    assert [r["sample_id"] for r in got] == ["s 1", "s 1", "7", "7"] and [r["frames"] for r in got[:2]] == [["a.jpg", "b.jpg"], None]
    assert got[0]["prompt"] == "The sequence is from X. Which?" and got[1]["prompt"] == "The image is from X. So?" and not any(r["error"] for r in got)


@pytest.mark.parametrize(
    ("raw", "want"),
    [('"a\\"b"', 'a"b'), ("1.50", "1.5"), ("1.0", "1.0"), ("7", "7"), ("-0", "0"), ("true", "True"), ("false", "False"), ("1e5", "100000.0"), ("1e16", "1e+16"), ("0.00001", "1e-05"), ("12345678901234567890123", "12345678901234567890123"), ("null", None), ("[1,2]", None)],
)
def test_references_as_texts(spark, raw, want):
    assert spark.range(1).select(annotations.token_text(F.parse_json(F.lit(raw)))).first()[0] == want


def test_boxes_are_lists_of_numbers(spark):
    of = lambda raw: spark.range(1).select(annotations.box_numbers(F.parse_json(F.lit(raw)))).first()[0]
    assert of("[1, 2.5, 3e0, 4]") == [1, 2.5, 3, 4] and of('[1, "2", 3, 4]') is None and of("[1, true, 3, 4]") is None and of('"[1]"') is None


def test_errors_of_samples_and_questions(spark, tmp_path):
    bad = [
        5, {**SAMPLE, "country": 3}, {**SAMPLE, "questions": []}, {**SAMPLE, "questions": ["no selector", "a;b"]}, {**SAMPLE, "reference": ["A"]}, {**SAMPLE, "sequence": ""},
        {**SAMPLE, "front view": []}, {**SAMPLE, "questions": [" ;x", "a;b"]}, {**SAMPLE, "reference": ["", " "]}, {**SAMPLE, "reference": [True, 2]},
    ]
    got = asked(spark, tmp_path, "Weather", *bad)
    errors = {}
    for r in got:
        errors.setdefault(r["sample_index"], []).append(r["error"])
    assert errors == {
        0: ["no object"], 1: ["no country"], 2: ["no questions with selectors"], 3: ["no questions with selectors"], 4: ["questions and references differ in number"], 5: ["missing sequence folder", None],
        6: ["invalid sequence selector", None], 7: ["empty selector or question", None], 8: ["empty reference", None], 9: [None, None],
    }
    assert [r["error"] for r in asked(spark, tmp_path, "Light", raw="{")] == ["no list of samples"]
    three = {**SAMPLE, "questions": ["a;1", "a;2", "a;3"], "reference": ["1/-2", "3", 4]}
    assert [r["error"] for r in asked(spark, tmp_path, "Sign_Sign_Relation", three)] == ["halves differ in number", "halves differ in number", "bad relation"]
    box = {**SAMPLE, "questions": ["a;Located in the image?", "a;no box"], "reference": [[1, 2, 3, 4], [5]]}
    assert [r["error"] for r in asked(spark, tmp_path, "VRU_Recognition", box)] == [None, None]
    assert [r["error"] for r in asked(spark, tmp_path, "VRU_Recognition", box, model="Qwen2")] == ["no dimension", None]
    assert [r["error"] for r in asked(spark, tmp_path, "VRU_Recognition", {**box, "dimension": [10, 20]}, model="Qwen2")] == [None, None]


def test_samples_are_read_as_they_come():
    """An element is out before much more than it has been read, however it is spread over lines."""
    read = 0

    def parts():
        nonlocal read
        yield "["
        for k in range(40_000):
            read += 1
            yield ("" if k == 0 else " ,\n") + '{"k":\n [%d, "]},{"]}\n' % k
        yield "]\n"

    found = annotations._elements(parts())
    assert next(found)[1] == {"k": [0, "]},{"]} and read < 5_000
    assert [v["k"][0] for _, v in found] == list(range(1, 40_000))


def test_samples_leave_in_small_batches():
    """A batch is bounded however small samples or files are (before: a million rows)."""
    tiny = pd.DataFrame({"file": "a", "value": ["[" + "5, " * 30_000 + "5", *[", 5"] * 9_999, "]"]})
    files = pd.DataFrame({"file": [f"f{k}" for k in range(10_000)], "value": "5"})
    out = list(annotations._cut(iter([tiny, files])))
    assert max(map(len, out)) < 5_000 and sum(map(len, out)) == 40_001 + 10_000
    made = pd.concat(out)
    assert made["sample_index"].dropna().tolist() == list(range(40_000)) and made["listed"].sum() == 1 and made["listed"].count() == 10_001


@pytest.mark.parametrize("raw", ["", "[]", "5", "[1", "[1,]", "[1 2]", "[1] x", '[{"a": 1, "a": 2}]', "[NaN]", '["\n"]', '{"a": []}'])
def test_files_without_a_list_of_samples(spark, tmp_path, raw):
    assert [(r["sample_index"], r["error"]) for r in asked(spark, tmp_path, "Light", raw=raw)] == [(None, "no list of samples")]


def test_lists_on_one_line_and_on_many(spark, tmp_path):
    one = asked(spark, tmp_path, "Weather", SAMPLE, {**SAMPLE, "id": 7}, 12)
    assert one == asked(spark, tmp_path, "Weather", raw=json.dumps([SAMPLE, {**SAMPLE, "id": 7}, 12], indent=1).replace(": ", "\r\n : ")) and len(one) == 5


LIVE = Spec("full", [Model("m", "lab/m", 1024)])
OLD = [Spec("half", [Model("m", "lab/m", 512)]), Spec("half", [Model("m", "lab/m", 99)]), Spec("other", [Model("n", "lab/n", 512)])]


def test_which_answers_match(spark):
    questions = spark.createDataFrame([("q", "p", ["u"])], "id string, prompt string, urls array<string>")
    known = candidates(questions, LIVE, OLD)
    hashes = {r["precedence"]: r["request_hash"] for r in known.collect()}
    assert set(hashes) == {0, 1, 2} and len(set(hashes.values())) == 3
    rows = [
        ("live", hashes[0], None, "stop"), ("live, cut", hashes[0], "half", "length"), ("carried", hashes[1], "half", "stop"), ("cut", hashes[1], "half", "LENGTH"), ("second of the name", hashes[2], "half", "stop"),
        ("no condition", hashes[1], None, "stop"), ("unknown", "x", "half", "stop"), ("no hash", None, None, None),
    ]
    df = spark.createDataFrame([("m", "q", *r) for r in rows] + [("m", "other", "unknown id", hashes[0], None, None)], "model_id string, id string, name string, protocol_sha256 string, condition string, finish_reason string")
    got = {r["name"]: r["matched"] for r in matched(df, known).collect()}
    assert got == {"live": "live", "live, cut": "live", "carried": "carried"} | dict.fromkeys(("cut", "second of the name", "no condition", "unknown", "no hash", "unknown id"))


def test_run_refuses_unmatched_and_leaves_incomplete_out(spark, tmp_path):
    plain = {"country": "X", "questions": ["a.png;Which? ['a', 'b']", "b.png;Which? ['a', 'b']"], "reference": ["a", "b"]}
    written(tmp_path / "ann" / "Weather_E.json", json.dumps([plain, plain]))
    questions = annotations.questions(spark, str(tmp_path / "ann"), dims.task_families(spark), "").withColumn("urls", F.array(T.frame_url("", F.col("task"), T.selector(F.col("raw_question")))))
    hashes = {r["id"]: r["request_hash"] for r in candidates(questions, LIVE).collect()}
    ids = [r["id"] for r in questions.orderBy("sample_index", "question_index").collect()]
    line = lambda i, a, h=None: json.dumps({"id": i, "answer": a, "protocol_sha256": h or hashes[i], "finish_reason": "stop"})
    at = tmp_path / "runs" / "m" / "Weather.jsonl"
    written(at, "\n".join([line(ids[0], "b"), line(ids[1], "b"), line(ids[0], "A."), line(ids[2], "a")]))
    run = scoring_run(spark, str(tmp_path / "ann"), str(tmp_path / "runs" / "*" / "*"), LIVE)
    score = run.evaluation.task_scores().first()
    assert (score["accuracy"], score["n"], score["score"]) == (1.0, 2, 100.0)
    assert run_stats(run.records).first()["records"] == 4
    written(at, line(ids[0], "a", "0"))
    with pytest.raises(ValueError, match="match no request"):
        scoring_run(spark, str(tmp_path / "ann"), str(tmp_path / "runs" / "*" / "*"), LIVE)


def test_checks_match_whole_values(spark):
    text = ["3/-4", "-1", "1/2\n", "1//2", "", " ", None]
    df = spark.createDataFrame([(t,) for t in text], "t string")
    none = F.lit(None).cast("array<double>")
    assert [r[0] for r in df.select(exports.reference_errors(F.lit("relation"), F.lit(False), F.col("t"), none)).collect()] == [None, None, *["bad relation"] * 5]
    assert [r[0] for r in df.select(exports.reference_errors(F.lit("choice"), F.lit(False), F.col("t"), none)).collect()] == [None] * 4 + ["empty reference", None, "empty reference"]
    assert {r[0] for r in df.select(exports.reference_errors(F.lit("grounding"), F.lit(False), F.col("t"), none)).collect()} == {None}
    sha = "a" * 40
    assert [r[0] for r in spark.createDataFrame([(sha,), (sha + "\n",), ("A" * 40,)], "s string").select(identity.is_revision(F.col("s"))).collect()] == [True, False, False]


def test_malformed_json_has_no_digest(spark):
    df = spark.createDataFrame([("{",), ("1e400",), (None,), ('{"b":1,"a":[1.50]}',)], "t string").withColumn("d", identity.canonical_digest(F.col("t")))
    got = [tuple(r) for r in df.select("d", identity.digest_error(F.col("t"), F.col("d"))).collect()]
    assert got == [(None, "no canonical JSON")] * 2 + [(None, None), (hashlib.sha256(b'{"a":[1.5],"b":1}').hexdigest(), None)]


def test_rounding_takes_the_exact_value(spark):
    values = [0.1234565, 0.5e-6, 1.5e-6, 2.5, -0.1234565, 1e300, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(T.rounded(F.col("v"), 6)).collect()]
    assert got[:6] == [round(v, 6) for v in values[:6]] and got[6] is None


def test_option_literals():
    from scorelake.operators.audit import literal_options

    assert literal_options("['x'];Which ['A', \"it's\", 'd\\'e', 'a']?") == ["a", "d'e", "it's"]
    assert literal_options("a;['ok'] then [not a list] and [1, 2]") == ["ok"]
    assert literal_options("no selector ['b' 'c']") == ["bc"] and literal_options("a;none") == [] and literal_options("a;[]") == [] and literal_options(None) is None


def test_sql_functions_equal_columns(spark):
    from scorelake.functions import metering
    from scorelake.plans import sql_functions

    sql_functions.register(spark)
    df = spark.createDataFrame([([1.0, 2.5, 30.9, 40.0], [5.0, 5.0, 25.5, 60.0], "patch"), ([9.0, 9.0, 1.0, 1.0], [0.0] * 4, "area"), ([1.0, 1.0, 2.0, 2.0], [50.0, 50.0, 60.0, 60.0], "pair"), ([0.0] * 4, [0.0] * 4, "none")], "a array<double>, b array<double>, kind string")
    tokens = metering.clip_tokens(F.col("kind"), F.lit(640), F.lit(480), F.lit(5), F.lit(16), F.lit(1.5), F.lit(0.001), F.lit(7.0))
    rows = df.select(marks.box_iou(F.col("a"), F.col("b")), F.expr("box_iou(a, b)"), tokens, F.expr("clip_tokens(kind, 640, 480, 5, 16, 1.5D, 0.001D, 7D)")).collect()
    assert all(r[0] == r[1] and r[2] == r[3] for r in rows)


def test_specifications_are_checked(spark):
    from scorelake.sources.specs import protocol_spec

    model = {
        "id": "m", "provider": "p", "endpoint": "e", "model": "x", "reasoning_effort": "low", "reasoning_parameter": "reasoning_effort", "input_transport": "ordered_image_urls", "single_frame_policy": "not_applicable",
        "oversize_fallback": "not_applicable", "video_options": {}, "credential": {"type": "environment"}, "backend_reproducibility": None,
    }
    good = {"schema_version": 2, "dataset_revision": "r", "tasks": "all", "protocol": {"temperature": None, "prompt": "original", "coordinate_convention": "native_pixels", "max_tokens": 5}, "models": [model]}
    text = json.dumps(good)
    assert protocol_spec(text, "r")["sha256"] == hashlib.sha256(text.encode()).hexdigest()
    video = {**model, "input_transport": "video_mp4", "single_frame_policy": "as_is", "oversize_fallback": "h264_crf18", "video_options": {"payload": {}}}
    assert protocol_spec(json.dumps({**good, "models": [video]}), "r")
    for change, why in (
        ({"schema_version": 1}, "schema_version"), ({"models": []}, "models"), ({"models": [model, model]}, "models"), ({"protocol": {**good["protocol"], "max_tokens": True}}, "max_tokens"),
        ({"models": [{**model, "reasoning_effort": "huge"}]}, "m: bad reasoning_effort"), ({"models": [{**model, "video_options": {"payload": 1}}]}, "video_options"), ({"models": [{**video, "oversize_fallback": "not_applicable"}]}, "oversize_fallback"),
        ({"models": [{k: v for k, v in model.items() if k != "endpoint"}]}, "missing"),
    ):
        with pytest.raises(ValueError, match=why):
            protocol_spec(json.dumps(good | change), "r")
    with pytest.raises(ValueError, match="dataset_revision"):
        protocol_spec(text, "other")


def test_boxes_on_a_grid_in_a_run(spark):
    from scorelake.plans.evaluation import Evaluation

    rows = [("m", "VRU_Recognition", 0, 0, "i;Located in the image?", None, [64.0, 48.0, 320.0, 240.0], [640.0, 480.0], "[100, 100, 500, 500]"), ("m", "VRU_Recognition", 0, 1, "i;Is it? ['a']", "a", None, [640.0, 480.0], "a")]
    df = spark.createDataFrame(rows, "model_id string, task string, sample_index int, question_index int, raw_question string, reference string, reference_box array<double>, dimension array<double>, answer string")
    assert Evaluation(df, scorer_model="Qwen2").task_scores().first()["other"] == 1.0
    assert Evaluation(df).task_scores().first()["other"] < 0.5
