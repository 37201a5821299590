import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from scorelake.llm import suffix_sigma as S
from tests.llm.helpers import DOCS, awkward, doc

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, most=3, least=10, top=2000, share=50):
    f, n = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for i in range(len(ws)):
                for k in range(1, min(most, len(ws) - i) + 1):
                    f.setdefault(lang, Counter())[tuple(ws[i : i + k])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            score, k = min((1_000_000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in S.collocations(df, **options).collect())


def texts(seed, docs=160):
    rng = random.Random(seed)
    words = ["the", "The", "of", "é", "x y", "tion", "a", "\x01", "zz", "\x1f"] + [f"w{k}" for k in range(12)]
    langs = ["en", "en", "en", None, "und", "a b", "t\tb", "back\\s", ""]
    passage = " ".join(rng.choice(words) for _ in range(9))
    for k in range(docs):
        parts = [rng.choice(words) for _ in range(rng.randint(0, 60))] + ([passage] if rng.random() < 0.5 else [])
        rng.shuffle(parts)
        yield doc(k, "".join(p + rng.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for p in parts)), rng.choice(langs)


@pytest.mark.parametrize("options", [{}, {"chunk": 200}, {"most": 2, "chunk": 1000}, {"most": 4, "least": 5, "share": 80, "chunk": 500}, {"least": 2, "top": 7}], ids=str)
def test_against_brute_force(spark, options):
    rows = [(d[0], d[1], lang, *d[3:]) for d, lang in texts(len(str(options)))]
    want = brute([(r[1], r[2]) for r in rows], **{k: v for k, v in options.items() if k != "chunk"})
    assert found(spark.createDataFrame(rows, DOCS), **options) == want and want


def test_hot_words_and_passages(spark):
    """One word, and one passage, that fill several parts."""
    rows = [doc(k, "the " * 300 + f"w{k % 11}. " + "one same passage of eight words right here, " * 5) for k in range(40)]
    assert found(spark.createDataFrame(rows, DOCS).repartition(7), chunk=2000) == brute([(r[1], r[2]) for r in rows])


def test_awkward_rows(spark):
    rows = awkward() * 3 + [doc(200, "A b c")] * 5 + [(201, "a b c", None, None, None, None, None, None, None)] * 4
    want = brute([(r[1], r[2]) for r in rows], least=4)
    assert found(spark.createDataFrame(rows, DOCS), least=4) == want and {r[0] for r in want} == {"en", "und"}
    assert found(spark.createDataFrame([], DOCS)) == []


def test_stack_over_any_batches():
    rng = random.Random(5)
    keys = sorted({"en\t" + "".join(rng.choice("abc") + " " for _ in range(rng.randint(1, 3))) for _ in range(60)} | {"de\ta ", "en\t "}, reverse=True)
    want = Counter()
    for n, k in enumerate(keys):
        head, _, rest = k.partition("\t")
        ws = rest.split(" ")[:-1]
        for i in range(len(ws)):
            want[head + "\t" + "".join(w + " " for w in ws[: i + 1])] += n + 1
    for size in (1, 2, 7, 100):
        stack, got = S.Stack(3, 1), Counter()
        import numpy as np

        for s in range(0, len(keys), size):
            for k, c, _ in stack.add(pa.array(keys[s : s + size]), np.arange(s + 1, min(len(keys), s + size) + 1)):
                got[k] += c
        for k, c, edge in stack.close():
            got[k] += c
            assert edge
        assert got == want
