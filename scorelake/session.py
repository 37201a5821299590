"""The session settings that the library's results rely on."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def session(name: str = "scorelake", master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC times, ANSI errors and adaptive execution; sizes are left to the cluster."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for key, value in (fixed | settings).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new folder in spark.checkpoint.dir, which driver and executors share; a local one only where that is unset, on a local master."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file:///tmp/scorelake-shared"
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str, at_end: bool = False) -> None:
    """Deletes a folder, now or when the driver's JVM ends."""
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.deleteOnExit(path) if at_end else system.delete(path, True)
