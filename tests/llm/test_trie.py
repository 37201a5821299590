import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelake.llm import prefix_trie as P
from scorelake.llm import ranged as R
from tests.llm.helpers import WORD

TURNS = "conv_id bigint, turn bigint, role string, text string, place bigint, h string, f string, depth string, s string"


def row(c, turn, role, text):
    """With extra columns whose names clash with ones that the operator uses inside."""
    return (c, turn, role, text, 7, "x", "y", "z", "w")


def brute(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        first = int(np.fmod(c, 20))
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = tuple(own.get(c - first, [])[:h] + own[c][h:])
    nodes = {}
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for p in nodes:
        if p:
            kids[p[:-1]] += 1
    for p, cs in nodes.items():
        cost = (len(cs) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += cost
            leaves[p[:d]] += kids[p] == 0
    return sorted(
        (min(cs), len(p), min(nodes[p[:-1]]) if p else -1, len(cs), kids[p], leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(c for c in cs if len(built[c]) == len(p)))).encode()).hexdigest())
        for p, cs in nodes.items()
    )


def found(df, **options):
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in P.trie(df, **options).collect())


def talk(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(200), n):
        for k in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append(row(c, k if rng.random() < 0.9 else None, rng.choice(["user", "user", "system", None]), rng.choice(["a b", "a", "c d e", "", None, f"u{rng.randint(0, 9)} v"])))
    return rows


@pytest.mark.parametrize("options", [{}, {"mask": 1}, {"mask": 3, "base": 1, "block": 2}], ids=str)
def test_against_brute_force(spark, options):
    """Few bits of hashes, and plain sums of them, make unlike prefixes meet; they are split again."""
    rows = talk(len(str(options)))
    assert found(spark.createDataFrame(rows, TURNS), **options) == brute(rows)


def test_awkward_rows(spark):
    long = " ".join(f"w{k}" for k in range(20_000))
    rows = [row(None, 0, "user", "no id"), row(-3, 0, None, None), row(-23, 1, "user", "é ▁ 😀"), row(0, 0, "user", long), row(0, 0, "user", long), row(1, None, "user", long), row(1, None, "a", "b")]
    rows += [row(5, k, "user", f"turn {k % 7}") for k in range(120)] + [row(25, k, "user", f"turn {k % 7}") for k in range(120)] + [(41, None, None, None, None, None, None, None, None)]
    assert found(spark.createDataFrame(rows, TURNS)) == brute(rows)
    assert found(spark.createDataFrame([], TURNS)) == []
    assert found(spark.createDataFrame([row(None, 1, "a", "b")], TURNS)) == []


def test_copies_share_every_node(spark):
    rows = [row(20 * c, k, "user", f"t{k}") for c in range(400) for k in range(4)]
    got = found(spark.createDataFrame(rows, TURNS), block=64)
    assert got == brute(rows) and [g[3] for g in got] == [400] * 5


@pytest.mark.parametrize("base", [1, P.BASE])
def test_scan_crosses_parts(spark, base):
    """A group that fills several parts, small ones, and one row."""
    rng = random.Random(base)
    rows = [(g, k, rng.getrandbits(63)) for g, n in ((3, 900), (-1, 5), (4, 1), (9, 60)) for k in range(n)]
    got = sorted(R.scan(spark.createDataFrame(rows, "g bigint, k bigint, v bigint"), "g", [F.col("k")], "v", base, "test-scan").select("g", "k", "place", "h").collect())
    sums, want = {}, []
    for g, k, v in sorted(rows):
        sums[g] = (sums.get(g, 0) * base + v) % (1 << 64)
        want.append((g, k, k, sums[g] - (1 << 64) if sums[g] >> 63 else sums[g]))
    assert [tuple(r) for r in got] == want
