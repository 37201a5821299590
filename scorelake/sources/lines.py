"""Lines of text files with their place, and JSON records from them: what comes later in a file wins."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .readers import JOURNAL


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """file, line (from 0, in its file), value.  Empty and malformed lines count; a path without files gives no rows.

    Files may be split: lines are numbered within a split, as Spark reads each in order, and the lines of the splits ahead of it in
    its file are added.  So no window is wider than a split.
    """
    try:
        rows = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "file string, line bigint, value string")
    split = rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_seq"), "value")
    keys = ["file", "_start"]
    counts = split.groupBy(*keys).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    base = counts.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    here = F.row_number().over(Window.partitionBy(*keys).orderBy("_seq")) - 1
    return split.withColumn("_here", here).join(base, keys).select("file", (F.col("_base") + F.col("_here")).alias("line"), "value")


def records(spark: SparkSession, path: str, schema: str = JOURNAL) -> DataFrame:
    """The fields of each line that is a JSON object, with file and line; other lines are passed over."""
    rows = numbered(spark, path).withColumn("r", F.from_json("value", schema))
    return rows.where(F.startswith(F.ltrim("value"), F.lit("{")) & F.col("r").isNotNull()).select("r.*", "file", "line")


def journal(spark: SparkSession, path: str) -> DataFrame:
    """Records of <model>/<task>.jsonl, or of folders model_id=<model>/task=<task>, with both from the path, and their line.

    Records without an id are left out.
    """
    rows = records(spark, path).where("id is not null")
    folders = r"/model_id=([^/]*)/task=([^/]*)/[^/]*$"
    plain = r"(?:^|/)([^/]*)/([^/]*?)(?:\.jsonl)?$"
    of = lambda k: F.coalesce(F.nullif(F.regexp_extract("file", folders, k), F.lit("")), F.regexp_extract("file", plain, k))
    return rows.withColumn("model_id", of(1)).withColumn("task", of(2))


def last_lines(rows: DataFrame, keys: list[str], order: tuple[str, ...] = ("file", "line")) -> DataFrame:
    """The record of each key that comes last, by file name and line: one aggregation, pre-aggregated before its shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


def written_lines(rows: DataFrame, path: str, folders: list[str], order: list[str]) -> None:
    """rows: value and more.  Text files under path, one in a folder for each value of ``folders``, with lines in an order."""
    rows.repartition(*folders).sortWithinPartitions(*folders, *order).select(*folders, "value").write.mode("overwrite").partitionBy(*folders).text(path)
