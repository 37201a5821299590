import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from scorelake.llm import piece_viterbi as V
from scorelake.llm import token_trie as T
from scorelake.llm.pieces import default_model, load
from tests.llm.helpers import DOCS, awkward

P = load()
rng = random.Random(6)
ODD = ["", "▁a ▁ b", " x  y\n\n z ", "𝔸😀日本語 テスト", "\x00\x01\t", "é" * 3000, "a" * 50_000, "x" * 33 + " " + "y" * 200, "\n", "   ", "a b\r\nc"]
TEXTS = ODD + ["".join(rng.choice("abcdetnéß 日\n▁.,") for _ in range(rng.randint(1, 80))) for _ in range(400)]


def unigram_library():
    """The library on the same pieces and scores, told that they are a unigram model."""
    raw = bytearray(open(default_model(), "rb").read())
    at = raw.rfind(b"tok_v0\x18\x02")
    raw[at + 7] = 1
    return sentencepiece.SentencePieceProcessor(model_proto=bytes(raw))


def brute_score(text):
    """Best score sum by plain dynamic programming over the whole text."""
    score = {p: s for p, s in zip((P.raw[i].decode() for i in P.ids), P.scores)}
    t = " " + text
    best = [0.0] + [float("-inf")] * len(t)
    for e in range(1, len(t) + 1):
        for k in range(1, min(e, P.longest) + 1):
            w = t[e - k : e]
            s = P.unknown if "▁" in w and k == 1 else score.get(w, P.unknown if k == 1 else None) if "▁" not in w else None
            if s is not None:
                best[e] = max(best[e], best[e - k] + s)
    return best[-1]


def own_score(ids):
    by_id = dict(zip(P.ids.tolist(), P.scores.tolist()))
    total, raw = 0.0, b""
    for i in ids:
        if i in by_id:
            total += by_id[i]
        else:
            raw += P.raw[i]
            try:
                raw.decode()
                total, raw = total + P.unknown, b""
            except UnicodeDecodeError:
                pass
    return total


def test_exact_round_trip():
    for text, ids in zip(TEXTS, V.encode_texts(TEXTS, P)):
        assert V.decode_ids(ids, P) == text


def test_best_score_by_plain_search():
    some = [t for t in TEXTS if len(t) < 90][:150]
    for text, ids in zip(some, V.encode_texts(some, P)):
        assert own_score(ids.tolist()) == pytest.approx(brute_score(text)), text


def test_words_equal_the_library():
    lib = unigram_library()
    words = ["".join(rng.choice("abcdefghilmnoprstuéü") for _ in range(rng.randint(1, 12))) for _ in range(500)]
    assert [x.tolist() for x in V.encode_texts(words, P)] == [lib.encode(w) for w in words]


def test_trie_counts_equal_encoding():
    words, tokens = T.count_texts([*TEXTS, None], P)
    assert tokens == [*[len(x) for x in V.encode_texts(TEXTS, P)], None] and words[-1] is None
    assert T.count_texts(TEXTS, P, cells=300)[1] == tokens[:-1]


def test_operators_on_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    tokens = V.encode(df)
    both = V.decode(tokens).join(T.token_counts(df).withColumnRenamed("doc_id", "id").distinct(), F.col("doc_id").eqNullSafe(F.col("id"))).collect()
    assert len(both) == len(awkward())
    texts = {r[0]: r[1] for r in awkward()}
    assert sorted(map(str, V.encode_and_decode(df).collect())) == sorted(map(str, V.decode(tokens).collect()))
    assert all(r["text"] == texts[r["doc_id"]] and (r["n_tokens"] is None if r["text"] is None else r["n_tokens"] == len(r["token_ids"])) for r in both)
    empty = spark.createDataFrame([], DOCS)
    assert V.decode(V.encode(empty)).count() == T.token_counts(empty).count() == 0
