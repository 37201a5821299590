from pathlib import Path

import pytest
from pyspark.sql import functions as F

from scorelake.llm.common import lean, running, scratch, shared_dir, words, written


def test_written_tables_go_with_their_scope(spark):
    outer = written(spark.range(3), "other")
    with scratch(spark):
        df = written(spark.range(5), "some")
        path = Path(df.inputFiles()[0].removeprefix("file://")).parent
        assert df.count() == 5 and path.exists()
        with scratch(spark):
            inner = written(spark.range(7), "inner", outlives=True)
        assert inner.count() == 7
        at = Path(inner.inputFiles()[0].removeprefix("file://")).parent
    assert not path.exists() and not at.exists() and outer.count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        conf: dict = {}

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError):
        shared_dir(Cluster)


def test_running_places_and_sums(spark):
    rows = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k"), (F.col("id") % 7).alias("v"))
    got = sorted(running(rows, [F.col("k")], "run", ahead=F.col("v")).collect())
    before = 0
    for n, r in enumerate(got):
        assert (r["place"], r["ahead"]) == (n, before)
        before += r["v"]
    assert running(rows.limit(0), [F.col("k")], "run", ahead=F.col("v")).count() == 0


def test_words_and_missing_columns(spark):
    df = spark.createDataFrame([(" a\tb\u00a0c \v",), (None,), ("",)], "text string")
    assert [r[0] for r in df.select(words(df["text"])).collect()] == [["a", "b\u00a0c"], [], []]
    assert [tuple(r) for r in lean(df, doc_id="bigint", text="string").collect()][0] == (None, " a\tb\u00a0c \v")
