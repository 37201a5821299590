import random
import zlib

import numpy as np

from scorelake.llm import quality_fm as Q
from tests.llm.helpers import DOCS, awkward, doc

LABELS = "doc_id bigint, quality int, toxic int, text string"


def corpus(n=400):
    rng = random.Random(8)
    rows, labels = [], []
    for k in range(n):
        ws = ["".join(rng.choice("abcdeghilmnoprstu") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(5, 80))]
        bad = k % 4 == 0
        rows.append(doc(k, " | ".join(w.upper() + "!!" for w in ws) if bad else " ".join(ws).capitalize() + "."))
        labels.append((k, int(not bad), 0, None))
    return rows, labels


def test_linear_time_identity():
    rng = np.random.default_rng(0)
    m = Q.FM(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    rows = [(rng.choice(50, 6, replace=False), rng.normal(size=6)) for _ in range(20)]
    want = [m.w0 + sum(m.w[i] * a for i, a in zip(*r)) + sum(m.v[r[0][p]] @ m.v[r[0][q]] * r[1][p] * r[1][q] for p in range(6) for q in range(p + 1, 6)) for r in rows]
    assert np.allclose(m.margins(*Q.pack(rows)), want)


def test_held_out_accuracy_and_inputs(spark):
    rows, labels = corpus()
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    model = Q.train(docs, lab)
    got = Q.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == labels[r["doc_id"]][1] for r in got if r["held_out"])
    # no label of a held-out row is learned from, and lang, source and doc_id change no score
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t, x) for i, q, t, x in labels]
    again = Q.train(docs, spark.createDataFrame(flipped, LABELS))
    assert np.array_equal(again.w, model.w)
    moved = spark.createDataFrame([(r[0] + 10**6, r[1], "zz", "other", *r[4:]) for r in rows], DOCS)
    assert sorted(r["score"] for r in Q.score(moved, model).collect()) == sorted(r["score"] for r in got)


def test_awkward_rows(spark):
    rows, labels = corpus(60)
    model = Q.train(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS))
    df = spark.createDataFrame(awkward(), DOCS)
    got = Q.score(df, model).collect()
    assert len(got) == len(awkward()) and all(r["score"] == r["score"] for r in got)
    assert Q.accepted(df, model).columns == df.columns
    assert Q.accepted(df, model).count() == sum(r["predicted"] for r in got)
    empty = Q.train(df, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in Q.score(df, empty).collect()} == {0.5}
    assert Q.score(spark.createDataFrame([], DOCS), model).count() == 0
