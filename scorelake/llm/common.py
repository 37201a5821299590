"""Shared helpers: the folder all executors see, written tables, words, shuffle widths."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a run of characters other than space and the five ASCII controls 09-0D.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that goes to a Python worker, where the session sets no limit of its own.
BATCH_BYTES = "4m"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a local one only where unset, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/scorelake-shared"
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, uri: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_at_end(spark: SparkSession, uri: str) -> None:
    """Deletes a folder when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


_SCRATCH: ContextVar[tuple[list[str], ...]] = ContextVar("scratch", default=())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the tables that ``written`` made inside; what reads them must be stored before."""
    mine: list[str] = []
    token = _SCRATCH.set((*_SCRATCH.get(), mine))
    try:
        yield
    finally:
        _SCRATCH.reset(token)
        for uri in mine:
            drop_dir(spark, uri)


def free(df: DataFrame, name: str) -> str:
    """The name, or the first of name_1, name_2, ... that no column has (Spark does not tell upper from lower case)."""
    have = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}_{k}" for k in range(1, len(have) + 2))) if n.lower() not in have)


def written(df: DataFrame, name: str, outlives: bool = False, **options: str) -> DataFrame:
    """The rows as a table in the shared folder; one that outlives its scratch block goes with the block around that, and one that has no block with the application.

    This cuts the lineage so that a lost executor costs no earlier work, and gives
    later joins true sizes, from which Spark decides whether a side may be broadcast.
    """
    path = fresh_dir(df.sparkSession, name)
    open_blocks = _SCRATCH.get()
    if len(open_blocks) > outlives:
        open_blocks[-1 - outlives].append(path)
    df.write.options(**options).parquet(path)
    if len(open_blocks) <= outlives:
        drop_at_end(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[Column], name: str, **sums: Column) -> DataFrame:
    """Adds ``place`` (from 0) and, for each named column, its sum over all rows before in a total order.

    Rows are dealt by ranges of the order; sums inside a range come from a window of that
    range, and those of the ranges before it from a table with one row a range.
    """
    dealt = df.repartitionByRange(width(df.sparkSession), *order).withColumn("_part", F.spark_partition_id())
    part = written(dealt.withColumns({f"_v{k}": c for k, c in enumerate(sums.values())}), name)
    inside = Window.partitionBy("_part").orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(f"_v{k}").alias(f"_s{k}") for k in range(len(sums))])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"{c}_base") for c in totals.columns[1:]])
    out = part.withColumns(
        {"_place": F.row_number().over(inside) - 1} | {f"_r{k}": F.coalesce(F.sum(f"_v{k}").over(before), F.lit(0)) for k in range(len(sums))}
    ).join(F.broadcast(totals), "_part")  # as many rows as there are ranges
    return out.select(*df.columns, (F.col("_place") + F.col("_n_base")).alias("place"), *[(F.col(f"_r{k}") + F.col(f"_s{k}_base")).alias(c) for k, c in enumerate(sums)])


def words(text: Column) -> Column:
    """Words of a text in order; null has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lean(df: DataFrame, **types: str) -> DataFrame:
    """Only the named columns, cast; a column that the table lacks is null.

    Rows of any length may follow into Python, so batches get a limit in bytes, unless the session has one.
    """
    conf = df.sparkSession.conf
    conf.set(_BATCH, conf.get(_BATCH, BATCH_BYTES))
    have = {c: t for c, t in df.dtypes}
    return df.select(*[(df[c].cast(t) if c in have else F.lit(None).cast(t)).alias(c) for c, t in types.items()])


def slices(batches, column: str, chunk: int = 1 << 20):
    """Parts of Arrow batches in which the column has about chunk bytes (list: values), or one row that has more."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for b in batches:
        c = b.column(column)
        size = (pc.binary_length(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else pc.list_value_length(c)).fill_null(0).to_numpy(zero_copy_only=False)
        part = (np.cumsum(size) - size) // chunk
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(b)] if len(b) else [0]
        for s, e in zip(cuts, cuts[1:]):
            yield b.slice(s, e - s)
