import hashlib
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from scorelake.sources import readers, specs, writers
from scorelake.streaming import journal as stream


def test_journal_drops_broken_lines_and_missing_paths(spark, tmp_path):
    d = tmp_path / "runs" / "m1"
    d.mkdir(parents=True)
    (d / "Weather.jsonl").write_text('{"id": "a", "task": "Weather", "usage": {"cost": 0.5}}\n{"id": "b"')
    got = readers.journal(spark, str(tmp_path / "runs" / "*"))
    assert [(r["id"], r["usage"]["cost"], r["model_id"]) for r in got.collect()] == [("a", 0.5, "m1")]
    assert readers.journal(spark, str(tmp_path / "nothing")).count() == 0


def test_samples_and_catalogue(spark, tmp_path):
    good = {"country": "X", "questions": ["image;a", "[k];b"], "reference": ["1", "2"], "sequence": "f"}
    (tmp_path / "Task.json").write_text(json.dumps([good, {**good, "reference": ["1"]}, {"country": "", "questions": ["no selector"], "reference": ["1"]}]))
    got = [(r["task"], r["sample_index"], r["error"]) for r in readers.samples(spark, str(tmp_path / "Task.json")).orderBy("sample_index").collect()]
    assert got == [("Task", 0, None), ("Task", 1, "questions and references differ in number"), ("Task", 2, "no country; a question without a selector")]
    (tmp_path / "all.txt").write_text(json.dumps({"C": {"G": ["B", "A"], "H": ["Trajectory"]}}))
    got = [tuple(r) for r in readers.catalogue(spark, str(tmp_path / "all.txt")).orderBy("ordinal").collect()]
    assert got == [("C", "G", "B", 0, True), ("C", "G", "A", 1, True), ("C", "H", "Trajectory", 2, False)]


def test_payload_and_spec(spark, tmp_path):
    (tmp_path / "p.js").write_text('window.DATA = {"a": 1, "b": ["x;", "y"]};\n')
    assert tuple(readers.payload(spark, str(tmp_path / "p.js"), "a int, b array<string>").first()) == (1, ["x;", "y"])
    assert readers.spec('{"a": 1}', {"a"}) == {"a": 1}
    with pytest.raises(ValueError):
        readers.spec('{"a": 1, "c": 2}', {"a", "b"})


def test_guarded_overwrite_and_record(spark, tmp_path):
    path = str(tmp_path / "scores")
    table = lambda n: spark.createDataFrame([("t", n)], "task string, answers int")
    writers.guarded(table(5), path)
    with pytest.raises(ValueError):
        writers.guarded(table(4), path)
    writers.guarded(table(4), path, force=True)
    assert spark.read.parquet(path).first()["answers"] == 4
    with pytest.raises(ValueError):
        writers.record(spark, {"a": float("nan")}, str(tmp_path / "r.json"))
    writers.record(spark, {"a": 1, "b": "é"}, str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text()) == {"a": 1, "b": "é"}
    assert readers.record(spark, str(tmp_path / "r.json"), "a int, b string").first()["b"] == "é"
    with pytest.raises(AnalysisException):
        readers.record(spark, str(tmp_path / "none.json"), "a int")


def test_registry_prices_and_checksums(spark, tmp_path):
    good = {"label": "M", "lab": "L", "parameters": "1B", "size_rank": 1, "featured": True, "box_convention": "grid", "color": "#00ff00"}
    bad = {**good, "featured": False, "color": "#0F0", "box_convention": "yards", "more": 1}
    del bad["label"]
    (tmp_path / "models.json").write_text(json.dumps({"m": good, "n": bad}))
    got = {r["model_id"]: r for r in readers.registry(spark, str(tmp_path / "models.json")).collect()}
    assert got["m"]["error"] is None and (got["m"]["size_rank"], got["m"]["featured"], got["m"]["not_featured_reason"]) == (1, True, None)
    assert got["n"]["error"] == "missing label; unknown more; bad box_convention; bad color; no not_featured_reason"
    (tmp_path / "prices.json").write_text(json.dumps({"data": [{"id": "a/b", "pricing": {"prompt": "0.1", "completion": "0.2"}}, {"id": "a/b", "pricing": {"prompt": "0.3", "completion": "0.2", "input_cache_read": "0"}}]}))
    assert tuple(readers.prices(spark, str(tmp_path / "prices.json")).first()) == ("a/b", 0.3, 0.2, None, 0.0)
    expected = spark.createDataFrame([("prices.json", "0"), ("models.json", hashlib.sha256((tmp_path / "models.json").read_bytes()).hexdigest()), ("gone", "1")], "name string, sha256 string")
    assert sorted(r["name"] for r in readers.mismatches(readers.checksums(spark, str(tmp_path / "*.json")), expected).collect()) == ["gone", "prices.json"]
    found = spark.createDataFrame([("{",), ("[]",), ('{"schema_version": 2}',), (None,)], "t string").select(specs.spec_errors(F.col("t"), "0" * 40)).collect()
    assert all(r[0] for r in found) and "bad models" in found[2][0]
    with pytest.raises(ValueError):
        readers.spec('{"a": 0}', {"a"}, {"a": lambda v: v > 0})


def test_task_answers_read_one_folder(spark, tmp_path):
    spark.createDataFrame([("A", 1), ("B", 2)], "task string, x int").write.partitionBy("task").parquet(str(tmp_path / "t"))
    got = readers.task_answers(spark, str(tmp_path / "t"), "B")
    assert [r["x"] for r in got.collect()] == [2] and "PartitionFilters: [isnotnull(task" in got._jdf.queryExecution().toString()


def test_tables_and_documents(spark):
    df = spark.createDataFrame([("A_b", "m", 1.234), ("A_b", "n", None)], "task string, model_id string, score double")
    assert writers.text_table(df, ["m", "n"]).first()["line"] == "A_b,1.23,"
    assert writers.text_table(df, ["m", "n"], form="latex").first()["line"] == r"A\_b & 1.23 &  \\"


def test_stream_of_the_journal(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    line = lambda i, t: json.dumps({"id": i, "task": "T", "answer": "x", "timestamp": t, "usage": {"cost": 1.0}})
    (d / "a.jsonl").write_text("\n".join([line("a", "2024-01-01T00:00:00Z"), line("a", "2024-01-01T00:00:00Z"), "{broken", line("zz", "2024-01-01T00:01:00Z")]))
    questions = spark.createDataFrame([("a",), ("b",)], "id string")

    def once():
        rows = stream.known(stream.read(spark, str(d)), questions)
        q = stream.to_parquet(rows, str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination(120)
        return sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert once() == ["a"]
    # records that arrive years late are taken, and ids that are stored are not taken again
    (d / "b.jsonl").write_text(line("b", "2019-01-01T00:02:00Z") + "\n" + line("a", "2024-01-01T00:00:00Z"))
    assert once() == ["a", "b"]


def test_stream_keeps_the_last_record_of_a_first_batch(spark, tmp_path):
    """Within the batch that an id first comes in the last by time stays; what comes in later batches does not replace it, and a restart goes on."""
    d = tmp_path / "in3"
    d.mkdir()
    line = lambda i, answer, t: json.dumps({"id": i, "task": "T", "answer": answer, "timestamp": t})

    def once(name, *lines_):
        (d / name).write_text("\n".join(lines_))
        q = stream.to_parquet(stream.read(spark, str(d)), str(tmp_path / "out3"), str(tmp_path / "cp3"))
        q.awaitTermination(120)
        return sorted((r["id"], r["answer"], r["batch"]) for r in spark.read.parquet(str(tmp_path / "out3")).collect())

    assert once("a.jsonl", line("a", "old", "2024-01-01T00:00:00Z"), line("a", "new", "2024-01-02T00:00:00Z"), line("b", "x", None)) == [("a", "new", 0), ("b", "x", 0)]
    assert once("b.jsonl", line("a", "newer", "2024-01-03T00:00:00Z"), line("c", "z", "2024-01-01T00:00:00Z")) == [("a", "new", 0), ("b", "x", 0), ("c", "z", 1)]


def test_progress_windows(spark, tmp_path):
    d = tmp_path / "in2"
    d.mkdir()
    rows = [("a", "2024-01-01T00:00:10Z", "stop"), ("b", "2024-01-01T00:01:00Z", "length"), ("c", "2024-01-01T01:00:00Z", "stop")]
    (d / "a.jsonl").write_text("\n".join(json.dumps({"id": i, "task": "T", "timestamp": t, "finish_reason": f, "usage": {"cost": 0.5}}) for i, t, f in rows))
    q = stream.progress(stream.read(spark, str(d))).writeStream.format("memory").queryName("progress").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = spark.table("progress").orderBy("start").select("answers", "cost", "cut_off").collect()
    assert [tuple(r) for r in got] == [(2, 1.0, 1), (1, 0.5, 0)]
    assert F is not None
