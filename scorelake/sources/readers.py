"""Readers: fixed schemas, malformed rows named or dropped by rule, and checks as columns."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import identity

JOURNAL = """
id string, task string, sample_index int, question_index int, protocol_sha256 string, answer string, finish_reason string,
usage struct<prompt_tokens: bigint, completion_tokens: bigint, cost: double,
  completion_tokens_details: struct<reasoning_tokens: bigint>,
  prompt_tokens_details: struct<cache_write_tokens: bigint, cached_tokens: bigint>,
  cost_details: struct<upstream_inference_cost: double, upstream_inference_prompt_cost: double, upstream_inference_completions_cost: double>>,
elapsed_seconds double, attempt int, video_sha256 string, lossy_fallback boolean, response string, timestamp timestamp, condition string
"""

SAMPLE = "id string, country string, questions array<string>, reference array<string>, sequence string, dimension array<int>"


def journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of <model>/<task>.jsonl: model_id is taken from the folder, task from the records; adds the file.

    Lines that are no JSON object are dropped; a path without files gives no rows.
    """
    try:
        rows = spark.read.schema(JOURNAL).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], JOURNAL + ", file string, model_id string")
    file = F.col("_metadata.file_path")
    rows = rows.select("*", file.alias("file"), F.element_at(F.split(file, "/"), -2).alias("model_id"))
    return rows.where("id is not null")


def samples(spark: SparkSession, path: str) -> DataFrame:
    """One file a task, an array of samples; adds sample_index, task and error (null if a sample is valid)."""
    whole = spark.read.text(path, wholetext=True).select("value", F.element_at(F.split(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\."), 1).alias("task"))
    rows = whole.select("task", F.posexplode(F.from_json("value", f"array<struct<{_colons(SAMPLE)}>>")).alias("sample_index", "s")).select("task", "sample_index", "s.*")
    return rows.withColumn("error", sample_errors())


def _colons(schema: str) -> str:
    return ", ".join(": ".join(part.split(" ", 1)) for part in schema.split(", "))


def sample_errors() -> Column:
    """Reasons against a sample, joined by '; '; null if there are none."""
    n, m = F.size("questions"), F.size("reference")
    checks = [
        F.when(F.col("country").isNull() | (F.trim("country") == ""), "no country"),
        F.when(F.col("questions").isNull() | (n == 0), "no questions"),
        F.when(n != m, "questions and references differ in number"),
        F.when(F.exists("questions", lambda q: ~F.contains(q, F.lit(";"))), "a question without a selector"),
        F.when(F.exists("questions", lambda q: F.startswith(F.trim(q), F.lit("["))) & F.col("sequence").isNull(), "a sequence without a folder"),
        F.when(F.col("dimension").isNotNull() & ((F.size("dimension") != 2) | F.exists("dimension", lambda d: d <= 0)), "bad dimension"),
    ]
    found = F.array_distinct(F.array_compact(F.array(*checks)))
    return F.when(F.size(found) > 0, F.concat_ws("; ", found))


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """category, group, task, ordinal, available from nested JSON objects, in document order."""
    whole = spark.read.text(path, wholetext=True)
    cats = whole.select(F.posexplode(F.from_json("value", "map<string, map<string, array<string>>>")).alias("c", "category", "groups"))
    groups = cats.select("c", "category", F.posexplode("groups").alias("g", "group", "tasks"))
    tasks = groups.select("c", "g", "category", "group", F.posexplode("tasks").alias("t", "task"))
    order = F.struct("c", "g", "t")
    return tasks.select("category", "group", "task", (F.row_number().over(Window.orderBy(order)) - 1).alias("ordinal"), (F.col("task") != "Trajectory").alias("available"))


def payload(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON of a script file that assigns one value: window.NAME = {...};"""
    whole = spark.read.text(path, wholetext=True)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)^\s*window\.\w+\s*=\s*", ""), r";\s*$", "")
    return whole.select(F.from_json(body, schema).alias("v")).select("v.*")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """name, expected, sha256 (null if the file is missing) of files that are not as expected.  found: path, sha256.  expected: name, sha256."""
    own = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return expected.select("name", F.col("sha256").alias("expected")).join(own, "name", "left").where(~F.col("expected").eqNullSafe(F.col("sha256")))


def spec(text: str, keys: set[str], checks: dict | None = None) -> dict:
    """A protocol spec with exactly the keys that are allowed, whose values pass the checks given for them."""
    found = json.loads(text)
    if set(found) != keys:
        raise ValueError(f"spec keys: missing {sorted(keys - set(found))}, unknown {sorted(set(found) - keys)}")
    if bad := sorted(k for k, check in (checks or {}).items() if not check(found[k])):
        raise ValueError(f"spec values: {bad}")
    return found


def record(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON document as a row; a missing file is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


REGISTRY = "map<string, map<string, string>>"
# What a registry entry must and may have.
REQUIRED = ("box_convention", "color", "featured", "lab", "label", "parameters", "size_rank")
OPTIONAL = ("not_featured_reason",)
CONVENTIONS = ("grid", "grid_yx", "pixels")


def registry(spark: SparkSession, path: str) -> DataFrame:
    """model_id, the fields of its entry, and error (null if valid), from a JSON object of entries by model id."""
    entries = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", REGISTRY)).alias("model_id", "entry"))
    e, keys = F.col("entry"), F.map_keys("entry")
    names = lambda found, what: F.when(F.size(found) > 0, F.concat(F.lit(f"{what} "), F.array_join(F.sort_array(found), ", ")))
    flag, whole = e["featured"].isin("true", "false"), F.rlike(e["size_rank"], F.lit(r"^-?\d+$"))
    checks = [
        names(F.array_except(F.array(*map(F.lit, REQUIRED)), keys), "missing"), names(F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL))), "unknown"),
        F.when(~e["box_convention"].isin(*CONVENTIONS), "bad box_convention"), F.when(~identity.is_colour(e["color"]), "bad color"), F.when(~(flag & whole), "bad size_rank or featured"),
        F.when((e["featured"] == "false") & (F.coalesce(e["not_featured_reason"], F.lit("")) == ""), "no not_featured_reason"),
    ]
    found = F.array_compact(F.array(*checks))
    return entries.select(
        "model_id", *[e[k].alias(k) for k in ("label", "lab", "parameters", "box_convention", "color", "not_featured_reason")], e["size_rank"].try_cast("int").alias("size_rank"), e["featured"].try_cast("boolean").alias("featured"),
        F.when(F.size(found) > 0, F.concat_ws("; ", found)).alias("error"),
    )


def prices(spark: SparkSession, path: str) -> DataFrame:
    """slug and list prices of one token from a saved price list; of a slug listed twice the later entry."""
    listed = "array<struct<id: string, pricing: struct<prompt: string, completion: string, input_cache_write: string, input_cache_read: string>>>"
    rows = spark.read.schema(f"data {listed}").option("multiLine", True).json(path).select(F.posexplode("data").alias("at", "m"))
    last = rows.groupBy(F.col("m.id").alias("slug")).agg(F.max_by("m.pricing", "at").alias("p"))
    return last.select("slug", *[F.col(f"p.{k}").cast("double").alias(k) for k in ("prompt", "completion", "input_cache_write", "input_cache_read")])


def task_answers(spark: SparkSession, path: str, task: str) -> DataFrame:
    """The answers of one task from a table partitioned by task: only its folder is read."""
    return spark.read.parquet(path).where(F.col("task") == task)


def frame_dimensions(spark: SparkSession, path: str) -> DataFrame:
    """url, width, height from receipts that list frames; of a url seen twice the later file's."""
    frames = "array<struct<url: string, width: int, height: int>>"
    rows = spark.read.schema(f"frames {frames}").option("multiLine", True).json(path)
    flat = rows.select(F.col("_metadata.file_path").alias("file"), F.posexplode("frames").alias("pos", "f"))
    return flat.groupBy(F.col("f.url").alias("url")).agg(F.max_by(F.struct("f.width", "f.height"), F.struct("file", "pos")).alias("d")).select("url", "d.width", "d.height")
