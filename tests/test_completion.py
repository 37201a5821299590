import json
from datetime import datetime

from scorelake.streaming import completion


def test_complete_once_across_restarts(spark, tmp_path):
    """Ids repeat within and across batches and runs; a run is told of once, and newer answers than the scores are refused."""
    completion.use_state_store(spark)
    at = tmp_path / "in"
    at.mkdir()
    schema = "model_id string, task string, id string, timestamp timestamp"

    def run(number, *rows):
        (at / f"{number}.json").write_text("".join(json.dumps(dict(zip(("model_id", "task", "id", "timestamp"), r))) + "\n" for r in rows))
        answers = spark.readStream.schema(schema).json(str(at))
        out = completion.completions(answers, {"T": 3, "U": 1}, {"m": datetime(2026, 1, 2)})
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        assert query.awaitTermination(120)
        return sorted((r["model_id"], r["task"], r["event"], r["id"], r["answered"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    early, late = "2026-01-01T00:00:00", "2026-01-03T00:00:00"
    assert run(0, ("m", "T", "a", early), ("m", "T", "a", early), ("m", "T", "b", early), ("n", "U", "x", late)) == [("n", "U", "complete", None, 1)]
    refused = ("m", "T", "refused", "c", 2)
    assert run(1, ("m", "T", "b", early), ("m", "T", "c", late)) == [refused, ("n", "U", "complete", None, 1)]
    done = [("m", "T", "complete", None, 3), refused, ("n", "U", "complete", None, 1)]
    assert run(2, ("m", "T", "c", early), ("n", "U", "x", early), ("n", "U", "y", early)) == done
    assert run(3, ("m", "T", "c", early), ("m", "T", "d", None)) == done
