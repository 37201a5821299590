"""The whole way from answers to a leaderboard, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import marks, text
from ..operators import analysis, exports, marking, scores
from . import dims


class Evaluation:
    """answers: model_id, task, sample_index, question_index, raw_question, reference, reference_box, answer, and
    error (what is wrong with the sample) where that was found before; bad references are found here.
    ``excluded`` (boolean), where it is there, is what ``what_if`` leaves out.

    ``scorer_model`` names a model whose boxes may be on a grid: references then are marked on it by ``dimension`` (width, height)."""

    KEYS = ["sample_index", "model_id", "task"]

    def __init__(self, answers: DataFrame, weights: DataFrame | None = None, families: DataFrame | None = None, scorer_model: str = "") -> None:
        spark = answers.sparkSession
        self.answers, self.scorer_model = answers, scorer_model
        self.weights = weights if weights is not None else dims.task_weights(spark)
        self.families = families if families is not None else dims.task_families(spark)

    def _with_errors(self) -> DataFrame:
        rows = self.answers.join(F.broadcast(self.families), "task", "left")  # one row a task
        bad = exports.reference_errors(F.col("family"), marks.is_box_question(F.col("raw_question")), F.col("reference"), F.col("reference_box"))
        before = F.col("error") if "error" in self.answers.columns else F.lit(None).cast("string")
        return rows.withColumn("error", F.coalesce(before, bad))

    def checked(self) -> DataFrame:
        """Answers with family, error and eligible."""
        return marking.with_eligible(self._with_errors(), self.KEYS)

    def _mark(self) -> Column:
        box = F.col("reference_box")
        if self.scorer_model:
            box = marks.rescaled(box, F.col("dimension"), self.scorer_model)
        return marks.mark(F.col("family"), F.col("raw_question"), F.col("reference"), box, F.col("answer"))

    def marks(self) -> DataFrame:
        """Answers of complete, valid samples with their marks and pairs."""
        rows = self.checked().where("eligible").drop("eligible", "error")
        flat = rows.withColumn("mark", self._mark())
        if self.scorer_model:
            flat = flat.withColumn("reference_box", marks.rescaled(F.col("reference_box"), F.col("dimension"), self.scorer_model))
        flat = flat.select(*rows.columns, "mark.*")
        return marking.pair_halves(flat, self.KEYS, "question_index", "accuracy")

    def _numbers(self, *flags: str) -> DataFrame:
        """As marks, without the texts: each answer that has no fault of its own is marked where it is, and only marks meet in samples, where the faults of others count."""
        good = F.col("error").isNull() & ~text.blank(F.col("answer"))
        rows = self._with_errors().select(*self.KEYS, "question_index", "family", good.alias("good"), F.when(good, self._mark()).alias("mark"), *flags)
        paired = marking.pair_halves(rows, self.KEYS, "question_index", "mark.accuracy", flag=flags[0] if flags else None, whole="good")
        return paired.select(*[c for c in paired.columns if c != "mark"], "mark.*")

    def denominators(self) -> DataFrame:
        kind = F.when((F.col("family") == "grounding") & marks.is_box_question(F.col("raw_question")), "box").when(F.col("family") == "judge", F.when(marks.is_judgment(F.col("reference")), "judgment").otherwise("description"))
        return marking.denominators(self.checked().withColumn("answered", ~text.blank(F.col("answer"))).withColumn("kind", kind), ["model_id", "task"])

    def components(self) -> DataFrame:
        return marking.components(self._numbers(), ["model_id", "task"])

    def task_scores(self) -> DataFrame:
        return marking.task_status(scores.with_weights(self.components(), self.weights)).withColumn("n", F.col("questions"))

    def what_if(self) -> DataFrame:
        """model_id, task, score, n, kept_score, kept_n: scores of all questions, and without the excluded ones and, in paired families, their partners."""
        return analysis.what_if_parts(self._numbers("excluded").withColumnRenamed("excluded", "gone"), self.weights)

    def totals(self, **options) -> DataFrame:
        return scores.totals(self.task_scores().where("score is not null"), **options)
