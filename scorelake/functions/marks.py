"""Marks of single answers, as column expressions: struct<accuracy, instruction, other, kind>.

accuracy is 0 to 1 (relations may pass 1), instruction whether the answer has the form asked
for, other the family's own part, kind what sort of question it is.  Malformed numbers give null accuracy, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T

# The patterns that marks are read by.
BOX = (
    r"(?U)\[\s*([^\],]*\d+[^\],]*)\s*,\s*([^\],]*\d+[^\],]*)\s*,\s*([^\],]*\d+[^\],]*)\s*,\s*([^\],]*\d+[^\],]*)\s*\]"
)
SPEED = r"(?U)\[\s*(-?\d+)\s*,\s*(-?\d+)\s*\]"
NUMBERS = r"(?U)(-?\d+(?:/\d+)*)"
CORRESPONDS = r"(?Ud)corresponds to No.([+-]?\d+|[+-]?\d+/\d+)"
CORRESPONDING = r"(?Ud)corresponding to.*is\s+(-?\d+(?:/\d+)*)"
BOX_QUESTION = "located in the image?"


def _mark(accuracy: Column, instruction: Column, other: Column | None, kind: Column | str) -> Column:
    return F.struct(
        accuracy.cast("double").alias("accuracy"), instruction.cast("int").alias("instruction"), (F.lit(None) if other is None else other).cast("double").alias("other"),
        (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
    )


def _chosen(cleaned: Column, ref: Column, tips: Column) -> Column:
    """Right: the reference itself, or text that holds it and, of the listed options, it alone (and listed once)."""
    only = (F.size(F.filter(tips, lambda t: t == ref)) == 1) & ~F.exists(tips, lambda t: (t != ref) & F.contains(cleaned, t))
    return T.single(cleaned) & ((cleaned == ref) | (F.contains(cleaned, ref) & only))


def choice_mark(raw_question: Column, reference: Column, answer: Column) -> Column:
    ref = F.lower(reference)

    def made(q: Column, cleaned: Column, tips: Column) -> Column:
        kind = F.when(ref.isin("true", "false"), "boolean").otherwise("choice")
        return _mark(_chosen(cleaned, ref, tips), T.single(cleaned) & F.contains(q, cleaned), None, kind)

    return _with_question(raw_question, answer, made)


def judge_mark(raw_question: Column, reference: Column, answer: Column) -> Column:
    ref, yes_no = T.clean(F.lower(reference)), is_judgment(reference)

    def made(q: Column, cleaned: Column, tips: Column) -> Column:
        told = T.single(cleaned) & F.contains(q, F.replace(cleaned, F.lit(";"), F.lit("")))
        mark = lambda right: _mark(right, told, F.when(yes_no, right.cast("double")), F.when(yes_no, "judgment").otherwise("description"))
        return T.let(_chosen(cleaned, ref, tips), mark)

    return _with_question(raw_question, answer, made)


def is_judgment(reference: Column) -> Column:
    """Whether a judging task's reference is yes or no; else it describes."""
    return T.clean(F.lower(reference)).isin("yes", "no")


def _with_question(raw_question: Column, answer: Column, made) -> Column:
    """made(question text, cleaned answer, options of the question), each of them computed once."""
    cleaned = T.clean(F.lower(T.remove_symbols(answer)))
    return T.let(T.question_text(raw_question), lambda q: T.let(cleaned, lambda c: T.let(T.options(q), lambda tips: made(q, c, tips))))


def boxes_in(answer: Column) -> Column:
    return F.regexp_extract_all(answer, F.lit(BOX), F.lit(0))


def _sides(box: Column) -> Column:
    """Four numbers of a box in brackets: of each part the digits and points, signs lost; null if malformed."""
    return F.transform(F.split(box, ","), lambda part: F.regexp_replace(part, "[^0-9.]", "").try_cast("double"))


def parse_box(answer: Column) -> Column:
    """[x1, y1, x2, y2] if the answer has exactly one box, else null."""
    return T.let(boxes_in(answer), lambda found: F.when(F.size(found) == 1, _sides(F.get(found, F.lit(0)))))


def box_iou(a: Column, b: Column) -> Column:
    """Overlap of boxes with whole, inclusive pixels; sides of reversed boxes count negative; null for an empty union."""
    x = [F.get(a, F.lit(k)).cast("bigint") for k in range(4)]
    y = [F.get(b, F.lit(k)).cast("bigint") for k in range(4)]
    area = lambda s: (s[2] - s[0] + 1) * (s[3] - s[1] + 1)
    wide = F.greatest(F.least(x[2], y[2]) - F.greatest(x[0], y[0]) + 1, F.lit(0))
    high = F.greatest(F.least(x[3], y[3]) - F.greatest(x[1], y[1]) + 1, F.lit(0))
    shared = wide * high
    return F.try_divide(shared.cast("double"), (area(x) + area(y) - shared).cast("double"))


def grown(box: Column, size: float = 1000.0) -> Column:
    """Boxes whose sides sum to less than 4 are fractions of the grid."""
    total = F.aggregate(box, F.lit(0.0), lambda z, v: z + v)
    return F.when(total < 4, F.transform(box, lambda v: v * size)).otherwise(box)


def box_mark(reference: Column, answer: Column) -> Column:
    """reference: array of four.  Without exactly one box the answer counts as four zeros."""

    def made(found: Column) -> Column:
        one = F.size(found) == 1
        box = F.when(one, _sides(F.get(found, F.lit(0)))).otherwise(F.array(*[F.lit(0.0)] * 4))
        iou = T.let(box, lambda b: T.let(grown(b), lambda g: box_iou(reference, g)))
        return T.let(iou, lambda v: _mark((v > 0.5).cast("double"), one, v, "box"))

    return T.let(boxes_in(answer), made)


def to_pixels(box: Column, convention: Column, w: Column, h: Column, size: float = 1000.0) -> Column:
    """A box in the convention of a model (pixels, grid or grid_yx) in the pixels of a frame."""
    g = grown(box, size)
    at = lambda k: F.get(g, F.lit(k))
    straight = F.array(at(0) * w / size, at(1) * h / size, at(2) * w / size, at(3) * h / size)
    turned = F.array(at(1) * w / size, at(0) * h / size, at(3) * w / size, at(2) * h / size)
    return F.when(convention == "pixels", box).when(convention == "grid_yx", turned).otherwise(straight)


def rescaled(reference: Column, dimension: Column, scorer_model: str) -> Column:
    """References on a 0..1000 grid for models that answer so; others keep pixels."""
    if not any(k in scorer_model.lower() for k in ("qwen", "internvl", "gemini", "drivemm", "ivl")):
        return reference
    side = lambda k: F.get(dimension, F.lit(k % 2)).cast("double")
    return F.array(*[F.get(reference, F.lit(k)) / side(k) * 1000 for k in range(4)])


def relation_mark(reference: Column, answer: Column) -> Column:
    """Numbers joined by slashes: none may be wrong, each right one earns its share, repeats again."""
    told, linked = F.contains(answer, F.lit("corresponds to")), F.contains(answer, F.lit("corresponding to"))
    last = T.let(F.regexp_extract_all(answer, F.lit(NUMBERS), F.lit(1)), lambda every: F.when(F.size(every) > 0, F.element_at(every, -1)).otherwise(""))
    raw = F.when(told, F.regexp_extract(answer, CORRESPONDS, 1)).when(linked, F.regexp_extract(answer, CORRESPONDING, 1)).otherwise(last)

    def made(found: Column, ref: Column) -> Column:
        given = F.when(found == "", F.array().cast("array<string>")).otherwise(F.split(found, "/"))
        wrong = F.exists(given, lambda n: ~F.array_contains(ref, n))
        credit = F.when(wrong, 0.0).otherwise(F.aggregate(given, F.lit(0.0), lambda z, n: z + F.lit(1.0) / F.size(ref)))
        return _mark(credit, ~told & ~linked & (found != ""), None, "relation")

    return T.let(raw, lambda found: T.let(F.split(reference, "/"), lambda ref: made(found, ref)))


def speed_mark(reference: Column, answer: Column) -> Column:
    """Two bounds in brackets, half for each that is equal as text."""
    one = F.size(F.regexp_extract_all(answer, F.lit(SPEED), F.lit(0))) == 1
    same = lambda k: (F.regexp_extract(reference, SPEED, k) == F.regexp_extract(answer, SPEED, k)).cast("double")
    return _mark(F.when(one, 0.5 * same(1) + 0.5 * same(2)).otherwise(0.0), one, None, "speed")


def is_box_question(raw_question: Column) -> Column:
    """Judged on the lower-cased text after the selector."""
    return F.contains(T.question_text(raw_question), F.lit(BOX_QUESTION))


def mark(family: Column, raw_question: Column, reference: Column, reference_box: Column, answer: Column) -> Column:
    """The mark of an answer by its task's family."""
    return (
        F.when((family == "grounding") & is_box_question(raw_question), box_mark(reference_box, answer))
        .when(family == "judge", judge_mark(raw_question, reference, answer))
        .when(family == "relation", relation_mark(reference, answer))
        .when(family == "speed", speed_mark(reference, answer))
        .otherwise(choice_mark(raw_question, reference, answer))
    )


# ---- the same marks added to rows -------------------------------------------------------------------
# What a mark uses more than once becomes a column of its own first.  Spark keeps such projections apart, so that each value is
# computed once and in generated code, where the lambda that binds it inside one expression is interpreted.  For rows of mixed
# families ``mark`` is the faster form: it works out only what a row's own family needs.


def _staged(rows: DataFrame, *stages: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    for stage in stages:
        rows = rows.withColumns(stage)
    return rows.drop(*drop)


_PARTS = ("_question", "_cleaned", "_list", "_tips", "_right", "_found", "_box", "_grown", "_iou", "_ids", "_given", "_wanted")


def _asked(rows: DataFrame, raw_question: Column, answer: Column) -> DataFrame:
    """Adds the question's text, the cleaned answer and the question's options."""
    last = F.regexp_extract_all("_question", F.lit(r"\[([^\]]+)\]"), F.lit(1))
    return _staged(
        rows, {"_question": T.question_text(raw_question), "_cleaned": T.clean(F.lower(T.remove_symbols(answer)))}, {"_list": F.try_element_at(last, F.lit(-1))}, {"_tips": T.parted(F.col("_list"))}, drop=("_list",)
    )


def _choice(reference: Column) -> Column:
    ref, cleaned = F.lower(reference), F.col("_cleaned")
    kind = F.when(ref.isin("true", "false"), "boolean").otherwise("choice")
    return _mark(_chosen(cleaned, ref, F.col("_tips")), T.single(cleaned) & F.contains(F.col("_question"), cleaned), None, kind)


def _judge(reference: Column) -> Column:
    yes_no, cleaned, right = is_judgment(reference), F.col("_cleaned"), F.col("_right")
    told = T.single(cleaned) & F.contains(F.col("_question"), F.replace(cleaned, F.lit(";"), F.lit("")))
    return _mark(right, told, F.when(yes_no, right.cast("double")), F.when(yes_no, "judgment").otherwise("description"))


def _is_right(reference: Column) -> Column:
    return _chosen(F.col("_cleaned"), T.clean(F.lower(reference)), F.col("_tips"))


def _four(text: Column) -> Column:
    """Four numbers of a box, each part's digits and points, written out."""
    parts = F.split(text, ",")
    return F.array(*[F.regexp_replace(F.get(parts, F.lit(k)), "[^0-9.]", "").try_cast("double") for k in range(4)])


def _grid(box: Column, size: float = 1000.0) -> Column:
    side = [F.get(box, F.lit(k)) for k in range(4)]
    return F.when(side[0] + side[1] + side[2] + side[3] < 4, F.array(*[v * size for v in side])).otherwise(box)


def _boxed(rows: DataFrame, reference: Column, answer: Column) -> DataFrame:
    """Adds _found (boxes of the answer) and _iou."""
    one = F.size("_found") == 1
    return _staged(
        rows, {"_found": boxes_in(answer)}, {"_box": F.when(one, _four(F.get("_found", F.lit(0)))).otherwise(F.array(*[F.lit(0.0)] * 4))}, {"_grown": _grid(F.col("_box"))},
        {"_iou": box_iou(reference, F.col("_grown"))}, drop=("_box", "_grown"),
    )


def _overlap() -> Column:
    return _mark((F.col("_iou") > 0.5).cast("double"), F.size("_found") == 1, F.col("_iou"), "box")


def _related(rows: DataFrame, reference: Column, answer: Column) -> DataFrame:
    """Adds _ids (what the answer names), _given and _wanted."""
    told, linked = F.contains(answer, F.lit("corresponds to")), F.contains(answer, F.lit("corresponding to"))
    last = F.coalesce(F.try_element_at(F.regexp_extract_all(answer, F.lit(NUMBERS), F.lit(1)), F.lit(-1)), F.lit(""))
    raw = F.when(told, F.regexp_extract(answer, CORRESPONDS, 1)).when(linked, F.regexp_extract(answer, CORRESPONDING, 1)).otherwise(last)
    given = F.when(F.col("_ids") == "", F.array().cast("array<string>")).otherwise(F.split("_ids", "/"))
    return _staged(rows, {"_ids": raw, "_wanted": F.split(reference, "/")}, {"_given": given})


def _relation(answer: Column) -> Column:
    told, linked = F.contains(answer, F.lit("corresponds to")), F.contains(answer, F.lit("corresponding to"))
    wrong = F.size(F.array_except("_given", "_wanted")) > 0
    credit = F.when(wrong, 0.0).otherwise(F.aggregate("_given", F.lit(0.0), lambda z, n: z + F.lit(1.0) / F.size("_wanted")))
    return _mark(credit, ~told & ~linked & (F.col("_ids") != ""), None, "relation")


def with_choice_mark(rows: DataFrame, raw_question: Column, reference: Column, answer: Column, name: str = "mark") -> DataFrame:
    return _asked(rows, raw_question, answer).withColumn(name, _choice(reference)).drop(*_PARTS)


def with_judge_mark(rows: DataFrame, raw_question: Column, reference: Column, answer: Column, name: str = "mark") -> DataFrame:
    return _staged(_asked(rows, raw_question, answer), {"_right": _is_right(reference)}, {name: _judge(reference)}, drop=_PARTS)


def with_box_mark(rows: DataFrame, reference: Column, answer: Column, name: str = "mark") -> DataFrame:
    return _boxed(rows, reference, answer).withColumn(name, _overlap()).drop(*_PARTS)


def with_relation_mark(rows: DataFrame, reference: Column, answer: Column, name: str = "mark") -> DataFrame:
    return _related(rows, reference, answer).withColumn(name, _relation(answer)).drop(*_PARTS)
