"""When a run is complete, as a stream: keyed state of the ids answered by each model and task.

A task's ids are kept until all are there, which its number of questions bounds.  A repeated id counts once, whatever batch it
comes in, and after a restart state goes on from the checkpoint.  There is no watermark: late records count.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, LongType, StringType, StructType, TimestampType

OUT = "model_id string, task string, event string, id string, answered bigint, newest timestamp"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ID, _AT = StructType().add("id", StringType()), StructType().add("at", TimestampType())
_SUMS = StructType().add("answered", LongType()).add("newest", TimestampType()).add("told", BooleanType())


class Completion(StatefulProcessor):
    """Emits ``complete`` once for a model and task, and ``refused`` for each answer that is newer than the model's scores."""

    def __init__(self, expected: dict[str, int], scored_at: dict[str, datetime]) -> None:
        self.expected, self.scored_at = expected, scored_at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", _ID, _AT)
        self.sums = handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        model, task = key
        answered, newest, told = self.sums.get() if self.sums.exists() else (0, None, False)
        limit, out = self.scored_at.get(model), []
        for batch in rows:
            for i, at in zip(batch["id"], batch["timestamp"]):
                at = None if pd.isna(at) else at.to_pydatetime()
                if limit is not None and at is not None and at > limit:
                    out.append((model, task, "refused", i, answered, at))
                elif not self.seen.containsKey((i,)):
                    self.seen.updateValue((i,), (at,))
                    answered += 1
                    newest = at if newest is None or (at is not None and at > newest) else newest
        if not told and answered >= self.expected.get(task, float("inf")):
            told = True
            out.append((model, task, "complete", None, answered, newest))
        self.sums.update((answered, newest, told))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def use_state_store(spark: SparkSession) -> None:
    """Keyed state of this kind lives in RocksDB; set it before a query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def completions(answers: DataFrame, expected: dict[str, int], scored_at: dict[str, datetime] | None = None) -> DataFrame:
    """Rows of OUT.  answers: a stream with model_id, task, id, timestamp.  expected: questions of each task.  scored_at: of models that have scores, in the session's time zone."""
    rows = answers.select("model_id", "task", "id", "timestamp").where("id is not null")
    return rows.groupBy("model_id", "task").transformWithStateInPandas(Completion(expected, scored_at or {}), outputStructType=OUT, outputMode="Append", timeMode="None")
