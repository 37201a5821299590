"""The answer journal as a stream: an extension, as the journal is append-only files.

Files of JSON lines arrive in a folder.  However late a record arrives it is taken: no operator
here has a watermark that would drop it.  Ids seen before are keyed state, and the counts by task and
time window keep one row for each window, in a state that grows with time and tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.readers import JOURNAL


def read(spark: SparkSession, path: str, files: int = 1000) -> DataFrame:
    return spark.readStream.schema(JOURNAL).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", files).json(path).where("id is not null")


def progress(answers: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Answers, cost and cut-off answers by task and time window."""
    cut = F.lower(F.coalesce("finish_reason", F.lit(""))).isin("length", "max_tokens")
    return (
        answers.groupBy(F.window("timestamp", window), "task")
        .agg(F.count("*").alias("answers"), F.sum("usage.cost").alias("cost"), F.count_if(cut).alias("cut_off"))
        .select(F.col("window.start").alias("start"), "task", "answers", "cost", "cut_off")
    )


def known(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Answers to known questions; questions is a static table."""
    return answers.join(questions.select("id"), "id", "left_semi")


def to_parquet(answers: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there now, each id once ever, and stops.

    The ids are keyed state, so a batch costs what its own records cost, however many are stored; call
    ``completion.use_state_store`` before, which keeps that state in RocksDB.  Of the records that an id has in the first
    batch that it comes in, the last by timestamp and answer stays.  Each batch is a folder of its own (``batch=N``),
    overwritten if the batch runs again.
    """
    rest = [c for c in answers.columns if c not in ("id", "timestamp", "answer")]
    known_ids = answers.withColumn("_at", F.current_timestamp()).groupBy("id").agg(F.min("_at").alias("_first"), F.max(F.struct("timestamp", "answer", *rest)).alias("r"))
    fresh = known_ids.where(F.col("_first") == F.current_timestamp()).select("id", "r.*").select(*answers.columns)  # the batch's time

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").partitionBy("task").parquet(f"{path}/batch={number}")

    return fresh.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
