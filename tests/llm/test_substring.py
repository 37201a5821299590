import random

import pytest

from scorelake.llm import substring_rk as S
from tests.llm.helpers import DOCS, WORD, awkward, doc


def brute(rows, size):
    docs = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, ws in docs:
        if i is not None:
            for k in range(len(ws) - size + 1):
                w = tuple(ws[k : k + size])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, ws in docs:
        gone = set()
        for k in range(len(ws) - size + 1):
            if i is not None and first[tuple(ws[k : k + size])] < i:
                gone |= set(range(k, k + size))
        out.append((-1 if i is None else i, len(ws), len(gone), " ".join(w for k, w in enumerate(ws) if k not in gone)))
    return sorted(out)


def found(df, **options):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["cut"]["n_words"], r["cut"]["n_removed"], r["cut"]["kept"]) for r in S.remove_repeats(df, **options).collect())


@pytest.mark.parametrize(("size", "gram"), [(13, 5), (4, 2), (3, 3), (5, 1)])
def test_against_brute_force(spark, size, gram):
    rng = random.Random(size)
    words = [f"w{k}" for k in range(40)] + ["é", "the", "THE", "the."]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(size - 1, 3 * size))) for _ in range(8)]
    rows = []
    for k in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 6))]
        rows.append((k * 7 % 127, rng.choice([" ", "\n", " \t\v"]).join(parts)))
    rows += [(3, rows[0][1]), (200, rows[5][1]), (201, rows[5][1]), (202, " ".join(["a"] * 60)), (203, " ".join(["a"] * 30))]
    assert found(spark.createDataFrame([doc(*r) for r in rows], DOCS), size=size, gram=gram) == brute(rows, size)


def test_awkward_rows(spark):
    rows = awkward() + [doc(50, awkward()[5][1]), doc(None, awkward()[5][1])]
    df = spark.createDataFrame(rows, DOCS)
    assert found(df) == brute([r[:2] for r in rows], 13)
    assert S.remove_repeats(df).columns == [*df.columns, "cut"]
    assert S.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_hashes_of_unlike_words(spark, monkeypatch):
    """Windows whose hashes are forced to be equal are told apart by their checks."""
    import numpy as np

    one, other = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(20))
    rows = [doc(1, one), doc(2, other), doc(3, other), doc(4, f"x {one}")]
    plain = S._ranges

    def few(values, starts, ends, base):
        return plain(values, starts, ends, base) if base != S._WORD else np.full(len(starts), 7, np.uint64)

    texts = [r[1] for r in rows]
    monkeypatch.setattr(S, "_ranges", few)
    gone, first = [], {}
    for k, t in enumerate(texts):
        h, c, d = S.word_hashes([t])
        s = S.windows(d, 13)
        keys = [{"h": int(a), "c": int(b)} for a, b in zip(few(h, s, s + 13, S._WORD).view(np.int64), S._checks(c, s, s + 13, S._WORD31))]
        gone.append([x for x in keys if first.setdefault((x["h"], x["c"]), k) < k])
    got = [(n, r, kept) for n, r, kept in S._cut(texts, gone, 13)]
    assert got == [x[1:] for x in brute([r[:2] for r in rows], 13)]


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "a b", "u", "v", "w", 3)], "doc_id bigint, text string, CUT string, cut_1 string, h string, c int")
    out = S.remove_repeats(df)
    assert out.columns == [*df.columns, "cut_2"] and out.first()["cut_2"]["kept"] == "a b"
