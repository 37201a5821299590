"""From answers to marks, eligibility and components of tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import marks as M
from ..functions import text as T

PAIRED = ("relation", "speed", "lane_change")


def flatten(samples: DataFrame) -> DataFrame:
    """A row for each question: sample_index, question_index, raw_question, reference, prompt, sequence.

    samples: task, sample_index, country, questions array<string>, reference array<string>.
    """
    q = samples.select("task", "sample_index", "country", F.posexplode(F.arrays_zip("questions", "reference")).alias("question_index", "q"))
    return q.select(
        "task", "sample_index", "question_index", F.col("q.questions").alias("raw_question"), F.col("q.reference").alias("reference"),
        T.prompt(F.col("q.questions"), F.col("country")).alias("prompt"), T.is_sequence(F.col("q.questions")).alias("sequence"),
    )


def mark_answers(answers: DataFrame, families: DataFrame) -> DataFrame:
    """answers: task, raw_question, reference, reference_box, answer and more.  Adds family and mark."""
    rows = answers.join(F.broadcast(families), "task", "left")  # one row a task
    return rows.withColumn("mark", M.mark(F.col("family"), F.col("raw_question"), F.col("reference"), F.col("reference_box"), F.col("answer")))


def pair_halves(rows: DataFrame, keys: list[str], position: str, accuracy: str, name: str = "pair", flag: str | None = None, whole: str | None = None) -> DataFrame:
    """Adds pair: on the second half of a sample, whether it is right with its first half or better than it.

    The partner is n div 2 positions before; an odd last row has none.  A sample's rows meet in one array, which its questions
    bound, so each row finds its partner by place.  Columns must be of types that have an order (no maps).
    ``flag`` names a boolean column: in paired families (column family) and samples of even size it then holds for both rows of a pair if for one.  ``whole`` names one
    that must hold for all rows of a sample; others are left out.  ``accuracy`` may be a field of a column (``mark.accuracy``).
    """
    rest = [c for c in rows.columns if c not in keys and c != whole]
    every = F.sort_array(F.collect_list(F.struct(F.col(position).alias("p"), F.struct(*rest).alias("r")))).alias("_all")
    sample = rows.groupBy(*keys).agg(every, F.bool_and(whole).alias("_whole")).where("_whole") if whole else rows.groupBy(*keys).agg(every)
    n = F.size("_all")
    half = F.floor(n / 2).cast("int")
    value = lambda x: reduce(lambda c, field: c[field], accuracy.split("."), x["r"])

    def paired(x: Column, i: Column) -> Column:
        first, second = value(F.get(F.col("_all"), i - half)), value(x)
        pair = ((second == 1) & (first == 1)) | (second > first)
        made = [x["r"].alias("r"), F.when((i >= half) & (i < 2 * half), pair.cast("int")).alias("pair")]
        if flag:
            partner = F.get(F.col("_all"), F.when(i < half, i + half).otherwise(i - half))["r"][flag]
            made.append((F.coalesce(x["r"][flag], F.lit(False)) | F.coalesce(x["r"]["family"].isin(*PAIRED) & (n % 2 == 0) & partner, F.lit(False))).alias("flag"))
        return F.struct(*made)

    out = sample.select(*keys, F.explode(F.transform("_all", paired)).alias("_one"))
    one = lambda c: F.col(c) if c in keys else F.col("_one.flag" if c == flag else f"_one.r.`{c}`").alias(c)
    return out.select(*[one(c) for c in rows.columns if c != whole], F.col("_one.pair").alias(name))


def released_pairs(rows: DataFrame, keys: list[str], position: str, accuracy: str) -> DataFrame:
    """keys, pairs: as the released scorer counts them, where marks that are null are left out before the halves are taken."""
    marks = F.transform(F.sort_array(F.collect_list(F.when(F.col(accuracy).isNotNull(), F.struct(position, accuracy)))), lambda s: s[accuracy])
    out = rows.groupBy(*keys).agg(marks.alias("a"))
    half = F.floor(F.size("a") / 2).cast("int")
    flags = F.zip_with(F.slice("a", F.lit(1), half), F.slice("a", half + 1, half), lambda x, y: (((y == 1) & (x == 1)) | (y > x)).cast("int"))
    return out.select(*keys, F.when(half > 0, F.aggregate(flags, F.lit(0), lambda z, v: z + v)).otherwise(0).alias("pairs"))


def parts(keep: Column | None = None, lenient: bool = False) -> dict[str, Column]:
    """The aggregates that components are made of, by name, over the rows of a family (with ``keep``, over those of them that it holds for).

    ``lenient`` takes missing kinds and missing overlaps as 0.
    """
    kept = lambda c: c if keep is None else F.when(keep, c)
    judge, paired = F.col("family") == "judge", F.col("family").isin(*PAIRED)
    of = lambda kind, c: F.avg(kept(F.when(F.col("kind") == kind, c)))
    n = F.count(kept(F.lit(1)))
    other = F.coalesce("other", F.lit(0.0)) if lenient else F.col("other")
    made = F.when(judge, of("judgment", F.col("accuracy"))).when(paired, F.try_divide(2 * F.sum(kept(F.coalesce("pair", F.lit(0)))), n)).when(F.col("family") == "grounding", of("box", other)).otherwise(0.0)
    return {
        "accuracy": F.when(judge, F.coalesce(of("description", F.col("accuracy")), F.lit(0.0))).otherwise(F.avg(kept(F.col("accuracy")))),
        "instruction": F.avg(kept(F.col("instruction"))),
        "other": F.coalesce(made, F.lit(0.0)) if lenient else made,
        "malformed": F.count(kept(F.when(F.col("accuracy").isNull(), 1))),
        "questions": n,
    }


def components(marked: DataFrame, keys: list[str], lenient: bool = False) -> DataFrame:
    """Mean accuracy, instruction and the family's other part, with malformed (marks without a number) and questions.

    marked: keys, family, accuracy, instruction, other, kind, pair.  Judging tasks take the
    accuracy of descriptions (0 without any) and as other that of judgments (null without
    any: undefined); paired families twice the share of pairs; grounding the mean overlap of boxes.
    ``lenient`` takes missing kinds and missing overlaps as 0.
    """
    return marked.groupBy(*keys, "family").agg(*[c.alias(k) for k, c in parts(lenient=lenient).items()])


def denominators(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Samples and questions expected, received and scored, questions of each kind, and pairs that are compared.

    rows: keys, sample_index, family, answered, eligible (alike in a sample), kind.  Samples are summed up first, so that nothing is counted by distinct values.
    """
    kinds = ("box", "judgment", "description")
    half = F.when(F.any_value("family").isin(*PAIRED), F.floor(F.count("*") / 2)).otherwise(0)
    sample = rows.groupBy(*keys, "sample_index").agg(
        F.count("*").alias("n"), F.count_if("answered").alias("received"), F.bool_and("eligible").alias("ok"), half.alias("pairs"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]
    )
    scored = lambda c: F.coalesce(F.sum(F.when(F.col("ok"), F.col(c))), F.lit(0))
    return sample.groupBy(*keys).agg(
        F.count("*").alias("samples_expected"), F.sum("n").alias("questions_expected"), F.sum("received").alias("questions_received"),
        F.count_if("ok").alias("samples_scored"), scored("n").alias("questions_scored"), *[scored(k).alias(k) for k in kinds], scored("pairs").alias("comparison_pairs"),
    )


def eligible_samples(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, questions, eligible, reason, errors: a sample counts only if all its questions are answered and it has no error.

    rows: keys, answer, error (null if valid).  errors: the distinct ones in the order of their text, joined by '; ' (null without any).
    """
    answered = F.bool_and(~T.blank(F.col("answer")))
    found = rows.groupBy(*keys).agg(answered.alias("_all"), F.sort_array(F.collect_set("error")).alias("_errors"), F.count("*").alias("questions"))
    bad = F.size("_errors") > 0
    return found.select(
        *keys, "questions", (F.col("_all") & ~bad).alias("eligible"), F.when(bad, "invalid_sample").when(~F.col("_all"), "incomplete_sample").alias("reason"), F.when(bad, F.concat_ws("; ", "_errors")).alias("errors")
    )


def with_eligible(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds eligible to the rows themselves, by one window of a sample; the same rule."""
    of = Window.partitionBy(*keys)
    return rows.withColumn("eligible", F.bool_and(~T.blank(F.col("answer"))).over(of) & (F.count("error").over(of) == 0))


def task_status(parts: DataFrame) -> DataFrame:
    """Adds score and code: null scores with undefined_component or scorer_error where a part is missing.

    parts: components with w_other, w_accuracy, w_instruction and malformed (count of marks without a number).
    """
    from .scores import composite

    made = composite(F.col("other"), F.col("accuracy"), F.col("instruction"), F.col("w_other"), F.col("w_accuracy"), F.col("w_instruction"))
    code = F.when(F.col("malformed") > 0, "scorer_error").when(F.col("other").isNull() | F.col("accuracy").isNull(), "undefined_component")
    return parts.withColumn("code", code).withColumn("score", F.when(code.isNull(), made))


def first_of_kind(rows: DataFrame) -> DataFrame:
    """Rows of each task's first sample, and of the first sample of each kind of question.

    rows: task, sample_index, kind.
    """
    least = rows.groupBy("task", "kind").agg(F.min("sample_index").alias("sample_index"))
    zero = rows.groupBy("task").agg(F.min("sample_index").alias("sample_index"))
    keep = least.select("task", "sample_index").union(zero).distinct()
    return rows.join(keep, ["task", "sample_index"], "left_semi")
