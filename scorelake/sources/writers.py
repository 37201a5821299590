"""Writers."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import two_decimals
from ..operators.scores import weighted_mean


def parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    """Parquet with zstd; a number of files only where a reader needs it."""
    out = df.coalesce(files) if files else df
    out.write.option("compression", "zstd").mode("overwrite").parquet(path)


def journal(df: DataFrame, path: str) -> None:
    """Appends JSON lines, a folder a task."""
    df.write.mode("append").partitionBy("task").json(path)


def guarded(df: DataFrame, path: str, force: bool = False) -> None:
    """Overwrites a score table, but not one that has more answers, unless forced."""
    spark = df.sparkSession
    try:
        before = spark.read.parquet(path).agg(F.sum("answers")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        before = 0
    now = df.agg(F.sum("answers")).first()[0] or 0
    if before > now and not force:
        raise ValueError(f"{path} has {before} answers, these scores {now}")
    parquet(df, path)


def record(spark: SparkSession, values: dict, path: str) -> None:
    """A small record as JSON, indented, without NaN, in any file system that Spark writes to."""
    text = json.dumps(values, indent=2, allow_nan=False, ensure_ascii=False) + "\n"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def answer_documents(marked: DataFrame) -> DataFrame:
    """A row for each question: task, sample_index, question_index, answers (map of model to cell).  Written by task."""
    cell = F.struct("answer", "accuracy", "instruction", "other", "pair")
    return marked.groupBy("task", "sample_index", "question_index").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("model_id"), cell)))).alias("answers"))


def by_task(df: DataFrame, path: str) -> None:
    """A folder a task; folders of tasks that df has are written anew, those of all others stay as they are."""
    df.repartition("task").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("task").parquet(path)


def text_table(scores: DataFrame, models: list, row: str = "task", form: str = "csv") -> DataFrame:
    """A line for each row with a score of two decimals for each model, as CSV or LaTeX."""
    wide = scores.groupBy(row).pivot("model_id", models).agg(F.max("score"))
    cells = [F.when(F.col(str(m)).isNotNull(), two_decimals(F.col(str(m)))).otherwise("") for m in models]
    line = F.concat_ws(",", row, *cells) if form == "csv" else F.concat(F.concat_ws(" & ", F.replace(F.col(row), F.lit("_"), F.lit("\\_")), *cells), F.lit(r" \\"))
    return wide.select(row, line.alias("line"))


def report_table(scores: DataFrame, models: list[tuple], groups: list[list[str]], form: str = "csv") -> DataFrame:
    """n, line of a whole report: header, sub-header, the tasks of each group with its MEAN, and TOTAL, as CSV or LaTeX.

    scores: model_id, task, score, n (the weight in means).  models: (model_id, label, parts of the sub-header), in their order.
    groups: tasks in their order.  A cell without a score is NaN.
    """
    spark = scores.sparkSession
    plan = [(k, t, t, False) for k, t in enumerate(t for g in groups for t in [*g, f"MEAN:{g[0]}"])]
    plan = [(k, key, "MEAN" if key.startswith("MEAN:") else label, key.startswith("MEAN:")) for k, key, label, _ in plan] + [(len(plan), "TOTAL", "TOTAL", True)]
    rows = spark.createDataFrame(plan, "k int, key string, label string, aggregate boolean")
    where = spark.createDataFrame([(t, f"MEAN:{g[0]}") for g in groups for t in g], "task string, mean string")
    own = scores.join(F.broadcast(where), "task")  # a row for each task
    mean = lambda key: own.groupBy("model_id", key.alias("key")).agg(weighted_mean(F.col("score"), F.col("n")).alias("score"))
    cells = own.select("model_id", F.col("task").alias("key"), "score").union(mean(F.col("mean"))).union(mean(F.lit("TOTAL")))
    ids = [m[0] for m in models]
    wide = rows.join(cells.groupBy("key").pivot("model_id", ids).agg(F.max("score")), "key", "left")
    values = [F.coalesce(two_decimals(F.col(str(i))), F.lit("NaN")) for i in ids]
    labels, subs = [m[1] for m in models], [m[2] for m in models]
    if form == "csv":
        head = [",".join(["Task", *labels]), ",".join(["", *(" / ".join(x) for x in subs)])]
        body = wide.select("k", F.lit(0).alias("part"), F.concat_ws(",", "label", *values).alias("line"))
        tail: list[str] = []
    else:
        head = [f"\\begin{{tabular}}{{l{'c' * len(ids)}}}", "\\toprule", f"Task & {' & '.join(labels)} \\\\", f" & {' & '.join(', '.join(x) for x in subs)} \\\\", "\\midrule"]
        name = F.when(F.col("aggregate"), F.concat(F.lit("\\textbf{"), "label", F.lit("}"))).otherwise(F.col("label"))
        body = wide.select("k", F.lit(0).alias("part"), F.concat(F.concat_ws(" & ", name, *values), F.lit(" \\\\")).alias("line"))
        body = body.union(wide.where("aggregate").select("k", F.lit(1).alias("part"), F.lit("\\midrule").alias("line")))
        tail = ["\\bottomrule", "\\end{tabular}"]
    fixed = [(k - len(head), 0, x) for k, x in enumerate(head)] + [(len(plan) + k, 0, x) for k, x in enumerate(tail)]
    lines = body.union(spark.createDataFrame(fixed, "k int, part int, line string"))
    at = F.sort_array(F.collect_list(F.struct("k", "part", "line")))  # as many lines as the report has
    return lines.agg(at.alias("all")).select(F.posexplode("all").alias("n", "x")).select("n", F.col("x.line").alias("line"))


def score_sheet(scores: DataFrame, models: list) -> DataFrame:
    """The sheet of weighted scores: a row for each task with its number of questions and a column a model (0 where it has no answers), then the totals.

    scores: model_id, task, score, n.
    """
    cell = lambda c: F.coalesce(c, F.lit(0.0))
    n = scores.groupBy("task").agg(F.max("n").alias("num"))
    wide = scores.groupBy("task").pivot("model_id", models).agg(F.max("score")).join(n, "task")
    tasks = wide.select("task", "num", *[cell(F.col(str(m))).alias(str(m)) for m in models])
    total = tasks.agg(F.sum("num").alias("num"), *[(F.sum(F.col(str(m)) * F.col("num")) / F.sum("num")).alias(str(m)) for m in models])
    return tasks.union(total.select(F.lit("TOTAL"), "num", *map(str, models)))
