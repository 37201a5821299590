"""A scoring run from files: annotation files and answer journals in, an evaluation out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity
from ..functions import text as T
from ..sources import annotations, lines
from . import dims
from .evaluation import Evaluation


@dataclass
class Model:
    """How a specification asks a model."""

    id: str
    model: str
    max_tokens: int
    effort: str | None = None
    effort_parameter: str = "reasoning"
    video: bool = False


@dataclass
class Spec:
    """A condition's name and its models."""

    name: str
    models: list[Model] = field(default_factory=list)


def _literal(models: list[tuple[int, str, Model]]) -> Column:
    fields = ("id", "model", "max_tokens", "effort", "effort_parameter", "video")
    return F.array(*[
        F.struct(F.lit(k).alias("precedence"), F.lit(name).alias("condition"), *[F.lit(getattr(m, f)).cast({"max_tokens": "int", "video": "boolean"}.get(f, "string")).alias(f) for f in fields]) for k, name, m in models
    ])


def candidates(questions: DataFrame, live: Spec, superseded: list[Spec] = ()) -> DataFrame:
    """model_id, id, precedence (0: live, then superseded specifications in their order), condition, request_hash: each request that an answer may be to.

    questions: id, prompt, urls.  Only models of the live specification count.
    """
    own = {m.id for m in live.models}
    entries = [(0, live.name, m) for m in live.models] + [(k, s.name, m) for k, s in enumerate(superseded, 1) for m in s.models if m.id in own]
    rows = questions.select("id", "prompt", "urls", F.explode(_literal(entries)).alias("m"))  # as many as there are requests
    made = identity.request_digest(F.col("m.model"), F.col("prompt"), F.col("urls"), F.col("m.max_tokens"), F.col("m.effort"), F.col("m.effort_parameter"), video=F.col("m.video"))
    return rows.select(F.col("m.id").alias("model_id"), "id", "m.precedence", "m.condition", made.alias("request_hash"))


def matched(records: DataFrame, candidates: DataFrame) -> DataFrame:
    """Adds matched to records: ``live`` if the hash is that of the live request, ``carried`` if it is that of the first superseded
    specification of the record's condition and the answer was not cut off, else null.

    records: model_id, id, protocol_sha256, condition, finish_reason.  All candidates of a request meet in one array, as long as there are specifications.
    """
    known = candidates.groupBy("model_id", "id").agg(F.sort_array(F.collect_list(F.struct("precedence", "condition", "request_hash"))).alias("_all"))
    rows = records.join(known, ["model_id", "id"], "left")
    hash_ = F.col("protocol_sha256")
    live = F.exists("_all", lambda c: (c["precedence"] == 0) & (c["request_hash"] == hash_))
    old = F.get(F.filter("_all", lambda c: (c["precedence"] > 0) & (c["condition"] == F.col("condition"))), F.lit(0))
    carried = (old["request_hash"] == hash_) & ~T.cut_off(F.col("finish_reason"))
    return rows.withColumn("matched", F.when(live, "live").when(carried, "carried")).drop("_all")


def refuse_unmatched(records: DataFrame) -> None:
    """Raises if an answer is to no request that counts."""
    bad = records.where("matched is null").select("model_id", "task", "id").limit(6).collect()
    if bad:
        raise ValueError(f"answers that match no request: {[tuple(r) for r in bad[:5]]}{' and more' if len(bad) > 5 else ''}")


def run_stats(records: DataFrame) -> DataFrame:
    """model_id, task, records, truncated, fallbacks, carried over all matched records, superseded lines too."""
    return records.groupBy("model_id", "task").agg(
        F.count("*").alias("records"), F.count_if(T.cut_off(F.col("finish_reason"))).alias("truncated"), F.count_if(F.coalesce("lossy_fallback", F.lit(False))).alias("fallbacks"), F.count_if(F.col("condition").isNotNull()).alias("carried")
    )


@dataclass
class ScoringRun:
    """Questions of annotation files, the matched records of their journals, and the evaluation of the last answer to each question."""

    questions: DataFrame
    records: DataFrame
    evaluation: Evaluation


def scoring_run(
    spark: SparkSession, annotation_path: str, journal_path: str, live: Spec, superseded: list[Spec] = (), revision: str = "", base: str = "", folders: DataFrame | None = None,
    families: DataFrame | None = None, scorer_model: str = "",
) -> ScoringRun:
    """From files to an evaluation; refuses journals with an answer that matches no request.

    folders: task, folder of its frames (the task's name without it).  Every question of a live model counts, answered or not.
    """
    families = families if families is not None else dims.task_families(spark)
    asked = annotations.questions(spark, annotation_path, families, revision, scorer_model)
    if folders is not None:
        asked = asked.join(F.broadcast(folders), "task", "left")  # a row a task
    folder = F.coalesce("folder", "task") if folders is not None else F.col("task")
    head = T.squish(T.selector(F.col("raw_question")))
    urls = F.when(F.col("frames").isNotNull(), F.transform("frames", lambda f: T.frame_url(base, F.concat_ws("/", folder, "sequence"), f))).otherwise(F.array(T.frame_url(base, folder, head)))
    asked = asked.withColumn("urls", urls)
    found = lines.journal(spark, journal_path)
    known = matched(found, candidates(asked.where("id is not null"), live, list(superseded)))
    refuse_unmatched(known)
    last = lines.last_lines(known.select("model_id", "task", "id", "answer", "file", "line"), ["model_id", "task", "id"])
    models = F.explode(F.array(*[F.lit(m.id) for m in live.models])).alias("model_id")
    rows = asked.select(models, "*").drop("family").join(last.select("model_id", "task", "id", "answer"), ["model_id", "task", "id"], "left")
    return ScoringRun(asked, known, Evaluation(rows, families=families, scorer_model=scorer_model))
