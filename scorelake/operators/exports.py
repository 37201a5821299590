"""The exported tables, and the rows and orders that reports show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def answers_table(journal: DataFrame) -> DataFrame:
    """A flat row for each journal record, with the defaults of old records."""
    u = F.col("usage")
    return journal.select(
        "model_id", F.col("id").alias("question_id"), "answer", F.coalesce(F.char_length("answer"), F.lit(0)).alias("answer_chars"), "finish_reason", F.coalesce("attempt", F.lit(1)).alias("attempt"),
        F.get_json_object("response", "$.provider").alias("served_provider"), F.get_json_object("response", "$.model").alias("served_model"), "elapsed_seconds",
        u["prompt_tokens"].alias("prompt_tokens"), u["completion_tokens"].alias("completion_tokens"), u["completion_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"), u["cost"].alias("cost_usd"),
        F.coalesce("condition", F.lit("full-original")).alias("condition"), F.coalesce("lossy_fallback", F.lit(False)).alias("lossy_fallback"), "protocol_sha256", "timestamp",
    )


def questions_table(questions: DataFrame) -> DataFrame:
    return questions.select("question_id", "task", "sample_id", "sample_index", "question_index", "sequence", "country", "prompt", "raw_question", F.col("reference").cast("string").alias("reference"), "image_urls", F.size("image_urls").alias("frames"))


def tasks_table(catalogue: DataFrame, weights: DataFrame, families: DataFrame, counts: DataFrame) -> DataFrame:
    """category and group of available tasks, with family, weights and counts."""
    from .scores import with_weights

    rows = catalogue.where("available").join(F.broadcast(families), "task", "left").join(counts, "task", "left")
    return with_weights(rows, weights).select("task", "category", "group", "family", "w_other", "w_accuracy", "w_instruction", "samples", "questions")


def models_table(models: DataFrame) -> DataFrame:
    """A flat row for each model, with the defaults of entries that leave fields out.

    models: model_id, label, provider_model, parameters, lab, featured, declared, completion_cap, truncated_answers,
    oversize_fallback_requests, protocol_complete, carried, usage (with latency_seconds) and summary, the last three structs.
    """
    flat = lambda struct, *names: [F.col(f"{struct}.{n}").alias(n) for n in names]
    return models.select(
        "model_id", "label", "provider_model", F.coalesce("parameters", F.lit("undisclosed")).alias("parameters"), "lab", F.coalesce("featured", F.lit(True)).alias("featured"),
        *flat("declared", "reasoning_effort", "input_transport", "single_frame_policy", "oversize_fallback"), "completion_cap", "truncated_answers", "oversize_fallback_requests",
        F.coalesce("protocol_complete", F.lit(False)).alias("protocol_complete"), F.coalesce("carried", F.lit(0)).alias("carried_from_512"),
        *flat("usage", "cost_usd"), F.lit("provider receipts summed per answer").alias("cost_basis"), *flat("usage", "input_cost_per_frame_usd", "output_cost_per_query_usd", "cost_per_video_hour_usd"),
        *[F.col(f"usage.latency_seconds.{q}").alias(f"latency_{q}") for q in ("p25", "p50", "p75", "p95")],
        F.col("summary.unweighted_mean_task_score").alias("mean_task_score"), *flat("summary", "median_task_score", "task_wins"),
    )


def task_scores_table(task_scores: DataFrame) -> DataFrame:
    """task_scores: what the evaluation gives, with samples_scored."""
    return task_scores.select(
        "model_id", "task", "score", "accuracy", F.col("instruction").alias("instruction_following"), "other", F.col("w_other").alias("weight_other"), F.col("w_accuracy").alias("weight_accuracy"),
        F.col("w_instruction").alias("weight_instruction"), "samples_scored", F.col("questions").alias("questions_scored"),
    )


def site_items(questions: DataFrame, base: str) -> DataFrame:
    """What a page shows of a question, numbered from 1: id, question, selector, prompt, gold, images (URLs of its frames).

    questions: id, sequence, sample_index, question_index, country, raw_question, reference, frames (map of a name to frames), folder.
    """
    raw = F.split("raw_question", ";", 2)
    head, text = T.squish(F.element_at(raw, 1)), T.squish(F.try_element_at(raw, F.lit(2)))
    many = F.startswith(head, F.lit("[")) & F.endswith(head, F.lit("]"))
    return questions.select(
        F.coalesce("id", "sequence", (F.col("sample_index") + 1).cast("string")).alias("id"), "sequence", (F.col("question_index") + 1).alias("question"), F.col("raw_question").alias("raw"),
        F.concat(F.lit("The "), F.when(many, "sequence").otherwise("image"), F.lit(" is from "), "country", F.lit(". "), text).alias("prompt"), head.alias("selector"), F.col("reference").alias("gold"),
        image_urls(base, F.col("folder"), F.col("raw_question"), F.col("sequence"), F.col("frames")).alias("images"),
    )


def image_urls(base: str, folder: Column, raw_question: Column, sequence: Column, frames: Column) -> Column:
    """URLs of a question's frames: those of the field that a bracketed selector names, in the sample's folder, or the one file it names."""
    head = T.squish(T.selector(raw_question))
    many = F.startswith(head, F.lit("[")) & F.endswith(head, F.lit("]"))
    named = F.try_element_at(frames, F.substring(head, F.lit(2), F.char_length(head) - 2))
    return F.when(many, F.transform(named, lambda f: T.frame_url(base, F.concat_ws("/", folder, sequence), f))).otherwise(F.array(T.frame_url(base, folder, head)))


def mark_cell(accuracy: Column, other: Column) -> Column:
    """The two numbers of an answer cell, to 6 and 4 decimals."""
    return F.struct(T.rounded(accuracy, 6).alias("accuracy"), T.rounded(other, 4).alias("other"))


def of_models(rows: DataFrame, chosen: list) -> DataFrame:
    """Rows of the chosen models; choosing none is refused."""
    if not chosen:
        raise ValueError("choose one model at least")
    return rows.where(F.col("model_id").isin(chosen))


def of_groups(tasks: DataFrame, groups: list[str], column: str = "group") -> DataFrame:
    """Tasks of the chosen groups or categories; none chosen means all."""
    return tasks.where(F.col(column).isin(groups)) if groups else tasks


def serving_order(models: DataFrame) -> DataFrame:
    """Featured models that have latencies, the fastest 95th percentile first."""
    return models.where(F.coalesce("featured", F.lit(True)) & F.col("p95").isNotNull()).orderBy("p95", "model_id")


def by_cost(rows: DataFrame, cost: str) -> DataFrame:
    """Rows that have a cost, the least first."""
    return rows.where(F.col(cost).isNotNull()).orderBy(cost, "model_id")


def published_columns(totals: DataFrame) -> DataFrame:
    """Models whose TOTAL was published, the least first."""
    return totals.where("total is not null").orderBy("total", "model_id")


def blocked_steps(needs: Column, asked: Column) -> Column:
    """Steps asked for that need records which are not there, in the order of their names."""
    return F.sort_array(F.array_intersect(needs, asked))


def reasoning_label(effort: Column) -> Column:
    return F.when(effort.isNull() | (effort == "none"), "off").otherwise(effort)


def condition_chips(*parts: Column) -> Column:
    """The parts that are there, between middle dots."""
    return F.concat_ws(" · ", *parts)


def component_rows(scores: DataFrame) -> DataFrame:
    """A row for each component that weighs something: model_id, task, component, value, weight, points."""
    parts = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value"), F.col(w).alias("weight")) for c, w in (("other", "w_other"), ("accuracy", "w_accuracy"), ("instruction", "w_instruction"))])
    rows = scores.select("model_id", "task", F.explode(parts).alias("p")).select("model_id", "task", "p.*")
    return rows.where((F.col("component") != "other") | (F.col("weight") != 0)).withColumn("points", 100 * F.col("value") * F.col("weight"))


def page(rows: DataFrame, order: list[Column], number: int, size: int = 60) -> DataFrame:
    """One page of a report."""
    return rows.orderBy(*order).offset(number * size).limit(size)


def by_statistic(statistic: str, group: str, ordinal: str, descending: bool = True) -> list[Column]:
    """Sort keys: groups in the order first seen (group_first), then the statistic, missing ones as the least; reversing reverses ties."""
    keys = [F.col(statistic).desc_nulls_last(), F.col(ordinal).desc()] if descending else [F.col(statistic).asc_nulls_first(), F.col(ordinal).asc()]
    return [F.col(group).asc(), *keys]


# What references of two families must look like; digits and blanks of any script.
RELATION = r"(?U)\A-?\d+(?:/-?\d+)*\z"
SPEED_PAIR = r"(?U)\[\s*-?\d+\s*,\s*-?\d+\s*\]"


def reference_errors(family: Column, is_box: Column, text: Column, box: Column) -> Column:
    """What is wrong with a reference of a family; null if nothing.  Grounding checks boxes only, and a blank is a reference."""
    bad_box = box.isNull() | (F.size(box) != 4) | F.exists(box, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) | (F.get(box, F.lit(0)) > F.get(box, F.lit(2))) | (F.get(box, F.lit(1)) > F.get(box, F.lit(3)))
    return (
        F.when((family == "grounding") & is_box, F.when(F.coalesce(bad_box, F.lit(True)), "bad box"))
        .when(family == "relation", F.when(~F.coalesce(F.rlike(text, F.lit(RELATION)), F.lit(False)), "bad relation"))
        .when(family == "speed", F.when(~F.coalesce(F.rlike(text, F.lit(SPEED_PAIR)), F.lit(False)), "bad speed pair"))
        .when(family == "grounding", None)
        .otherwise(F.when(F.coalesce(text, F.lit("")) == "", "empty reference"))
    )
