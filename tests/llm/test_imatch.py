import hashlib
import math
import re

from scorelake.llm import imatch as I
from scorelake.llm.common import SPACE
from tests.llm.helpers import DOCS, awkward, doc


def md5(s):
    return hashlib.md5(s.encode()).hexdigest()


def brute(rows, low=I.LOW, high=I.HIGH):
    texts = [(i, t or "") for i, t in rows]
    terms = lambda t: {w for w in re.split(SPACE, t) if w}
    df = {}
    for _, t in texts:
        for w in terms(t):
            df[w] = df.get(w, 0) + 1
    known = {w for w, c in df.items() if max(2, low * len(texts)) <= c <= high * len(texts)}

    def prints(t):
        """The whole, then parts by leading bits of the hash: 64 of 64, the first 32 of 512 and of 4096."""
        m = sorted(md5(w) for w in (terms(t) & known or terms(t)))
        short = lambda s, n: md5("".join(s))[:n] if s else "0" * n
        return [short(m, 16)] + [short([x for x in m if int(x[:8], 16) >> 32 - bits == k], 3) for bits, many in ((6, 64), (9, 32), (12, 32)) for k in range(many)]

    def near(a, b):
        for lo, hi in ((97, 129), (65, 97), (1, 65)):
            pairs = [(x, y) for x, y in zip(a[lo:hi], b[lo:hi]) if x != "000" or y != "000"]
            if len(pairs) >= 8:
                break
        return sum(x == y for x, y in pairs) / len(pairs) if pairs else 1.0

    texts.sort()
    out = []
    for k, (i, t) in enumerate(texts):
        after = texts[(k + 1) % len(texts)][1]
        cut = len(t) // 4
        new = t[: len(t) - cut] + after[:cut]
        a, b, c = prints(t), prints(new), prints(after)
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), "".join(a), "".join(b), near(a, b), near(a, c), texts[(k + 1) % len(texts)][0]))
    return out


def test_against_brute_force(spark):
    rows = [(3 * k + (k > 40), " ".join(f"t{(k * j) % (17 + j)}" for j in range(1, 400 if k % 20 == 3 else 12 + k % 30)) + ("  é\n😀" if k % 7 == 0 else "")) for k in range(120)] + [(5000, ""), (5001, None), (5002, "a")]
    df = spark.createDataFrame([doc(i, t) for i, t in rows], DOCS)
    got = sorted(tuple(r) for r in I.compared(df).collect())
    want = brute(rows)
    for g, w in zip(got, want):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5]) and math.isclose(g[6], w[6]) and g[7] == w[7]
    assert len(got) == len(want)
    assert I.lexicon(df, buckets=4) == I.lexicon(df)  # too few buckets to leave any out
    alone = {r["doc_id"]: r["fingerprint"] for r in I.fingerprints(df).collect()}
    assert alone == {w[0]: w[3] for w in want}


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    got = I.compared(df).collect()
    assert len(got) == len(awkward())
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (4, 9)}) == 1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    one = I.compared(spark.createDataFrame([doc(1, "abcd efgh")], DOCS)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0 and one[0]["edited_sha256"] == hashlib.sha256(b"abcd efab").hexdigest()
    assert I.compared(spark.createDataFrame([], DOCS)).count() == 0
