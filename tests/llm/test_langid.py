import math

import numpy as np
import pytest

from scorelake.llm import piece_langid as L
from scorelake.llm.common import table
from scorelake.llm.pieces import SPACE, load
from tests.llm.helpers import DOCS, awkward, doc


@pytest.fixture(scope="module")
def pieces():
    return load()


@pytest.fixture(scope="module")
def names(pieces):
    """Piece text to its place among the sorted keys."""
    import sentencepiece

    from scorelake.llm.pieces import default_model

    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    place = {int(i): k for k, i in enumerate(pieces.ids)}
    return {sp.id_to_piece(i): place[i] for i in range(sp.get_piece_size()) if i in place}


def ways(word, names, n_keys):
    """Every segmentation, as a list of piece numbers."""
    if not word:
        yield []
        return
    for k in range(1, len(word) + 1):
        head = word[:k].replace(" ", SPACE)
        ids = [names[head]] if head in names and SPACE not in word[:k] else None
        if ids is None and k == 1:
            ids = [n_keys + b for b in word[0].encode()]
        if ids:
            for rest in ways(word[k:], names, n_keys):
                yield ids + rest


WORDS = [" the", "the", " tion", " é", " 😀a", " x1", "\n", "  a", " ▁", " zq一", " and"]


def test_forward_sums_every_segmentation(pieces, names):
    rng = np.random.default_rng(1)
    logs = np.log(rng.dirichlet(np.ones(len(pieces.keys) + 256), 3).T)
    got = L.word_scores(WORDS, logs, pieces)
    for w, g in zip(WORDS, got):
        every = list(ways(w, names, len(pieces.keys)))
        want = [math.log(sum(math.exp(sum(logs[i, m] for i in x)) for x in every)) for m in range(3)]
        assert np.allclose(g, want, rtol=1e-9)


def test_expected_uses(pieces, names):
    logs = L.start(pieces)
    weights = np.arange(1, len(WORDS) + 1)[:, None] * np.array([[1, 3]])
    got, want = L.piece_uses(WORDS, weights, logs, pieces), np.zeros((len(logs), 2))
    for w, c in zip(WORDS, weights):
        every = list(ways(w, names, len(pieces.keys)))
        p = np.array([math.exp(sum(logs[i] for i in x)) for x in every])
        for x, q in zip(every, p / p.sum()):
            for i in x:
                want[i] += q * c
    assert np.allclose(got, want, rtol=1e-9)


def test_held_out_accuracy(spark, pieces):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = {r["doc_id"]: r for r in L.predict(docs, L.learn(docs, pieces), pieces).collect()}
    rows = docs.collect()
    held = [r for r in rows if got[r["doc_id"]]["held_out"]]
    right = [got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]
    assert len(got) == len(rows) and 150 < len(held) < 350 and sum(right) >= 0.99 * len(right)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_held_out_rows_teach_nothing(spark, pieces):
    import zlib

    docs = [doc(k, f"word number {k} of a text") for k in range(40)]
    held = [d for d in docs if zlib.crc32(str(d[0]).encode()) % 4 == 2]
    other = [(d[0], "völlig anderer Text", "de", *d[3:]) if d in held else d for d in docs]
    a, b = (L.learn(spark.createDataFrame(x, DOCS), pieces) for x in (docs, other))
    assert held and a.languages == b.languages == ["en"] and np.array_equal(a.logs, b.logs)
    nameless = [(None, "völlig anderer Text", "de", *d[3:]) for d in docs]
    assert L.learn(spark.createDataFrame(nameless, DOCS), pieces).languages == []


def test_awkward_rows(spark, pieces):
    rows = [*awkward(), doc(100, "12 34 !?"), doc(101, "é"), doc(102, "Ⅷ ½ 3"), (103, "ohne Sprache hier", None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DOCS)
    model = L.learn(df, pieces)
    got = [tuple(r) for r in L.predict(df, model, pieces).collect()]
    assert len(got) == len(rows)
    none = {1, 2, 3, 100, 102}
    assert all((lang == "und" and score == 0) == (i in none) for i, _, lang, score in got)
    assert all(not held for i, held, *_ in got if i is None)
    empty = spark.createDataFrame([], DOCS)
    assert L.predict(empty, model, pieces).count() == 0 and L.learn(empty, pieces).languages == []
    assert {r["lang_pred"] for r in L.predict(df, L.learn(empty, pieces), pieces).collect()} == {"und"}


def test_words_forgotten_change_nothing(spark, pieces, monkeypatch):
    texts = [f"word{k % 50} text{k} und das" for k in range(300)]
    model = L.Model(["a", "b"], np.log([0.5, 0.5]), np.stack([L.start(pieces), L.start(pieces)[::-1]], axis=1))
    whole = L.predict_texts(texts, model, L.Scores(model.logs, pieces))
    monkeypatch.setattr(L, "WORDS", 20)
    scores = L.Scores(model.logs, pieces)
    parts = [L.predict_texts(texts[k : k + 40], model, scores) for k in range(0, 300, 40)]
    assert [x for p in parts for x in p[0]] == whole[0] and np.allclose(np.concatenate([p[1] for p in parts]), whole[1])
