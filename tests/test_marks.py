"""Marks against cases worked out by hand from the rules."""

import math

import pytest
from pyspark.sql import functions as F

from scorelake.functions import marks as M
from scorelake.functions import text as T


def answers_of(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


# question after the selector, reference, answer; accuracy, instruction, kind
TREES = "Which tree stands there? ['Oak', 'Elm', 'Ash']"
CHOICES = [
    (TREES, "Oak", "oak", 1.0, 1, "choice"),
    (TREES, "Oak", "I would say an oak!", 1.0, 0, "choice"),
    (TREES, "Oak", "an elm, not an oak", 0.0, 0, "choice"),  # another option is there too
    (TREES, "Fir", "it must be a fir", 0.0, 0, "choice"),  # holds the reference, which is no option
    (TREES, "Fir", "FIR", 1.0, 0, "choice"),  # equal, option or not
    (TREES, "Oak", "['Oak', 'Ash']", 0.0, 0, "choice"),  # two options quoted: no single answer
    ("Which? ['Oak', 'Oak', 'Elm']", "Oak", "an oak", 0.0, 0, "choice"),  # listed twice: the other one is in the answer
    ("Which? ['Oak', 'Red oak']", "Oak", "red oak", 0.0, 1, "choice"),
    ("Which? ['Oak', 'Red oak']", "Red oak", "red oak", 1.0, 1, "choice"),
    ("Which? ['', 'Oak']", "Oak", "an oak", 0.0, 0, "choice"),  # an empty option lies in every answer
    ("Which? [Oak, Elm]", "Elm", "an elm", 1.0, 0, "choice"),  # without quotes
    ("Not [a, b]; but ['Oak', 'Elm']", "Oak", "an oak", 1.0, 0, "choice"),  # the last list counts
    ("Which, of any?", "Oak", "an oak", 0.0, 0, "choice"),
    (TREES, "Oak", "", 0.0, 1, "choice"),  # nothing lies in every question
    (TREES, "Oak", "An elm? No, the correct answer is: *Oak*.\n", 1.0, 1, "choice"),
    (TREES, "Oak", "correct answer is: oak, correct answer is: elm", 0.0, 1, "choice"),  # the last marker counts
    (TREES, "Oak", '("Oak")', 1.0, 1, "choice"),
    ("Does it stand? ['True', 'False']", "True", "true", 1.0, 1, "boolean"),
    ("Does it stand? ['True', 'False']", "FALSE", "true", 0.0, 1, "boolean"),
]


def test_choices(spark):
    m = M.choice_mark(F.concat(F.lit("x.png;"), F.col("q")), F.col("ref"), F.col("answer"))
    got = answers_of(spark, [c[:3] for c in CHOICES], "q string, ref string, answer string", a=m["accuracy"], i=m["instruction"], k=m["kind"])
    assert got == [c[3:] for c in CHOICES]


# reference, answer; accuracy, instruction
RELATIONS = [
    ("3", "3", 1.0, 1), ("3", "4", 0.0, 1), ("1/2", "1", 0.5, 1), ("1/2", "2/1", 1.0, 1), ("1/2", "1/3", 0.0, 1), ("2", "2/2/2", 3.0, 1), ("1/1", "1", 0.5, 1),
    ("3", "sign 7 and then 3", 1.0, 1), ("3", "no number", 0.0, 0), ("-1", "-1", 1.0, 1), ("3", "-3", 0.0, 1),
    ("3", "It corresponds to No.3.", 1.0, 0), ("3/4", "corresponds to No.3/4", 0.5, 0), ("3", "it corresponds to 3", 0.0, 0), ("3", "corresponds to No 3", 1.0, 0),
    ("3/4", "The lane corresponding to it is 3/4 I think", 1.0, 0), ("3", "corresponding to that: 3", 0.0, 0), ("5", "corresponding to this is 4, and that is 5", 1.0, 0), ("3", "corresponding to it\nis 3", 0.0, 0),
]


def test_relations(spark):
    m = M.relation_mark(F.col("ref"), F.col("answer"))
    got = answers_of(spark, [c[:2] for c in RELATIONS], "ref string, answer string", a=m["accuracy"], i=m["instruction"])
    for (a, i), c in zip(got, RELATIONS):
        assert a == pytest.approx(c[2]) and i == c[3], c


# reference, answer; accuracy, instruction, overlap
BOXES = [
    ([10, 10, 109, 109], "[10, 10, 109, 109]", 1.0, 1, 1.0),
    ([0, 0, 9, 9], "at [0, 0, 9, 4].", 0.0, 1, 0.5),  # half is not more than half
    ([0, 0, 9, 9], "[0,0,9,5]", 1.0, 1, 0.6),
    ([0, 0, 9, 9], "[20, 20, 29, 29]", 0.0, 1, 0.0),
    ([0, 0, 9, 9], "[9, 9, 18, 18]", 0.0, 1, 1 / 199),  # both edges count
    ([0, 0, 9, 9], "[0, 0, 9, 9] and [1, 1, 2, 2]", 0.0, 0, 1 / 100),  # two boxes: four zeros, which cover one pixel
    ([5, 5, 9, 9], "none", 0.0, 0, 0.0),
    ([100, 200, 300, 400], "[0.1, 0.2, 0.3, 0.4]", 1.0, 1, 1.0),  # fractions of the grid
    ([0, 0, 9, 9], "[-0, 0, -9, 9]", 1.0, 1, 1.0),  # signs are lost
    ([0, 0, 9, 9], "[x=0, y=0, x=9, y=9.9]", 1.0, 1, 1.0),  # and what is behind the point
    ([0, 0, 19, 9], "[x1=0, 0, x1=9, 9]", 0.0, 1, 0.5),  # the digit of a name stays: 10 to 19
    ([0, 0, 9, 9], "[1.2.3, 0, 9, 9]", None, 1, None),
    ([9, 9, 0, 0], "[9, 9, 0, 0]", 0.0, 1, 0.0),
    ([1, 0, 0, 5], "[1, 0, 0, 5]", None, 1, None),  # no area at all
]


def test_boxes(spark):
    m = M.box_mark(F.col("ref"), F.col("answer"))
    got = answers_of(spark, [([float(v) for v in c[0]], c[1]) for c in BOXES], "ref array<double>, answer string", a=m["accuracy"], i=m["instruction"], o=m["other"])
    for (a, i, o), c in zip(got, BOXES):
        assert (a, i) == c[2:4] and (o is None if c[4] is None else math.isclose(o, c[4], abs_tol=1e-12)), c


def test_each_pattern_is_read_once(spark):
    df = spark.createDataFrame([([1.0] * 4, "[1, 1, 2, 2]")], "ref array<double>, answer string").withColumn("m", M.box_mark(F.col("ref"), F.col("answer")))
    plan = df.select("m.accuracy", "m.instruction", "m.other")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract") <= 3
    df = spark.createDataFrame([("1", "1")], "ref string, answer string").withColumn("m", M.relation_mark(F.col("ref"), F.col("answer")))
    assert df.select("m.accuracy", "m.instruction")._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract") <= 6


def test_speed(spark):
    s = M.speed_mark(F.col("ref"), F.col("answer"))
    rows = [("[0, 80]", "[0, 50]"), ("[0, 80]", "[0,80]"), ("[0, 80]", "[00, 80]"), ("[0, 80]", "[0, 80] [1, 2]"), ("[0, 80]", "none")]
    assert answers_of(spark, rows, "ref string, answer string", a=s["accuracy"], i=s["instruction"]) == [(0.5, 1), (1.0, 1), (0.5, 1), (0.0, 0), (0.0, 0)]


def test_judgments_and_descriptions(spark):
    j = M.judge_mark(F.lit("image;Is it? ['yes', 'no', 'car']"), F.col("ref"), F.col("answer"))
    rows = [("yes", "Yes."), ("No", "yes"), ("car", "A car"), ("(No.)", "no; "), ("yes", "maybe")]
    got = answers_of(spark, rows, "ref string, answer string", a=j["accuracy"], i=j["instruction"], o=j["other"], k=j["kind"])
    assert got == [(1.0, 1, 1.0, "judgment"), (0.0, 1, 0.0, "judgment"), (1.0, 0, None, "description"), (1.0, 1, 1.0, "judgment"), (0.0, 0, 0.0, "judgment")]


def test_a_box_question_is_known_by_its_text_and_not_by_its_selector(spark):
    rows = [("x.png;Where is it Located in the IMAGE?",), ("located in the image?;Which one?",), ("x.png;Which one?",)]
    assert [r[0] for r in answers_of(spark, rows, "raw string", b=M.is_box_question(F.col("raw")))] == [True, False, False]


def test_grid_reading(spark):
    rows = [([100.0, 200.0, 300.0, 400.0], "grid"), ([200.0, 100.0, 400.0, 300.0], "grid_yx"), ([0.1, 0.2, 0.3, 0.4], "grid"), ([1.0, 1.0, 1.0, 0.5], "pixels")]
    b = M.to_pixels(F.col("b"), F.col("c"), F.lit(2000), F.lit(1000))
    got = [r[0] for r in answers_of(spark, rows, "b array<double>, c string", b=b)]
    assert [[round(v, 6) for v in g] for g in got[:3]] == [[200.0, 200.0, 600.0, 400.0]] * 3 and got[3] == [1.0, 1.0, 1.0, 0.5]


def test_rescale_by_model(spark):
    df = spark.createDataFrame([([100.0, 100.0, 200.0, 200.0], [2000, 2000], "[50, 50, 100, 100]")], "ref array<double>, dim array<int>, answer string")
    got = df.select(M.box_mark(M.rescaled(F.col("ref"), F.col("dim"), "Qwen-7B"), F.col("answer"))["other"], M.box_mark(M.rescaled(F.col("ref"), F.col("dim"), "other"), F.col("answer"))["other"]).first()
    assert got[0] == 1.0 and got[1] < 0.5


def test_text_steps(spark):
    df = spark.createDataFrame([("  [key];Is it; so?", "  x \n", "a" * 64)], "raw string, padded string, long string")
    r = df.select(T.question_text(F.col("raw")), T.is_sequence(F.col("raw")), T.prompt(F.col("raw"), F.lit("Y")), T.squish(F.col("padded")), T.degenerate(F.col("long")), T.frame_url("http://h", F.lit("a b"), F.lit("c/é.jpg"))).first()
    assert tuple(r) == ("is it so?", True, "The sequence is from Y. Is it; so?", "x", True, "http://h/a%20b/c/%C3%A9.jpg")
    blanks = spark.createDataFrame([("",), (" \t",), (None,), ("x",)], "a string").select(T.blank(F.col("a"))).collect()
    assert [r[0] for r in blanks] == [True, True, True, False]
    assert spark.range(1).select(T.humanize(F.lit("Key_Obsturction_Bahavior"))).first()[0] == "Key Obstruction Behavior"


def test_numbers_as_text(spark):
    values = [0.0, 1.0, 0.1, 1e7, 123456789.125, 1e15, 1e16, 1.5e300, 1e-4, 0.00012345, 1e-5, -2.5e-7, 3e22]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(T.number_text(F.col("v"))).collect()
    assert [r[0] for r in got] == [repr(v) for v in values]
    tokens = [('"No. 3"', "No. 3"), ("3", "3"), ("007", "007"), ("2.50", "2.5"), ("1e3", "1000.0"), ("true", "True"), ("false", "False"), ('"a\\"b"', 'a"b')]
    got = spark.createDataFrame([(t,) for t, _ in tokens], "t string").select(T.answer_text(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in tokens]


def test_two_decimals_of_the_exact_value(spark):
    cases = [(59.125, "59.13"), (56.375, "56.38"), (1.005, "1.00"), (1.115, "1.11"), (0.125, "0.13"), (2.5, "2.50"), (99.995, "100.00"), (0.015, "0.01"), (1.255, "1.25"), (8.345, "8.35"), (0.0, "0.00"), (-0.125, "-0.13"), (71.0, "71.00"), (1e-9, "0.00"), (123456.789, "123456.79")]
    got = spark.createDataFrame([(v,) for v, _ in cases], "v double").select(T.two_decimals(F.col("v"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_text_of_chat_content(spark):
    cases = [('"plain"', "plain"), ('[{"type":"text","text":"a"},{"type":"image_url"},{"type":"text","text":"b"}]', "ab"), ("[]", ""), ("null", None), (None, None)]
    got = spark.createDataFrame([(c,) for c, _ in cases], "c string").select(T.message_text(F.col("c"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_marks_of_rows_equal_marks_of_columns(spark):
    """The staged forms give what the expressions give, for every family and awkward answers."""
    schema = "family string, raw_question string, reference string, reference_box array<double>, answer string"
    rows = [("choice", f"x.png;{q}", ref, None, a) for q, ref, a, *_ in CHOICES]
    rows += [("judge", "image;Is it? ['yes', 'no', 'car']", ref, None, a) for ref in ("yes", "No.", "car") for a in ("Yes.", "no", "a car", "", "['yes', 'no']", None)]
    rows += [("relation", "i;Which?", ref, None, a) for ref in ("1/2", "3/-4", "1") for a in ("1", "1/2", "corresponds to No.1/2", "corresponding to x is 3/-4", "none", "2/2", "", None)]
    rows += [("speed", "i;Which?", "[40, 80]", None, a) for a in ("[40, 80]", "[40,90]", "[1, 2] [3, 4]", "", None)]
    rows += [("grounding", "i;Located in the image?", None, [1.0, 1.0, 9.0, 9.0], a) for a in ("[1, 1, 9, 9]", "[0.1, 0.1, 0.2, 0.2]", "[a, 1, 2, 3]", "[1.2.3, 1, 9, 9]", "[1, 1, 9, 9] [2, 2, 3, 3]", "", None)]
    rows += [("grounding", "i;Which? ['a', 'b']", "a", None, "a"), ("lane_change", "i;Which? ['1', '2']", "1", None, "1"), (None, "i;Which? ['1', '2']", "1", None, "2")]
    df = spark.createDataFrame(rows, schema)
    q, ref, box, a = (F.col(c) for c in ("raw_question", "reference", "reference_box", "answer"))
    for one, made in ((M.with_choice_mark(df, q, ref, a), M.choice_mark(q, ref, a)), (M.with_judge_mark(df, q, ref, a), M.judge_mark(q, ref, a)), (M.with_relation_mark(df, ref, a), M.relation_mark(ref, a))):
        assert sorted(map(repr, one.collect())) == sorted(map(repr, df.select("*", made.alias("mark")).collect()))
    boxed = df.where("reference_box is not null")
    assert sorted(map(repr, M.with_box_mark(boxed, box, a).collect())) == sorted(map(repr, boxed.select("*", M.box_mark(box, a).alias("mark")).collect()))
