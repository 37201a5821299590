import numpy as np
import pytest

from scorelake.llm import embed_forest as E

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, rep bigint, copies int"


def usable(r):
    return r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])


def brute(rows):
    ok = [(r[0], np.asarray(r[1], float), r[2]) for r in rows if usable(r)]
    links = {k: [] for k in range(len(rows))}
    at = [k for k, r in enumerate(rows) if usable(r)]
    for x, (i, v, lab) in zip(at, ok):
        for y, (j, w, lab2) in zip(at, ok):
            if x != y and lab == lab2 and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.93:
                links[x].append(y)
    own = {k: rows[k][0] for k in range(len(rows))}
    change = True
    while change:
        change = False
        for a, bs in links.items():
            for b in bs:
                if own[b] < own[a]:
                    own[a], change = own[b], True
    return sorted((rows[k][0] if rows[k][0] is not None else -1, len(links[k]), own[k] if own[k] is not None else -1) for k in range(len(rows)))


def found(spark, rows, **options):
    got = E.near_duplicates(spark.createDataFrame([(*r, "k", 1, 2) for r in rows], SCHEMA), **options).collect()
    assert all(r["kept"] == (r["vec_id"] is None or r["vec_id"] == r["component_id"]) for r in got)
    return sorted((r["vec_id"] if r["vec_id"] is not None else -1, r["n_links"], r["component_id"] if r["component_id"] is not None else -1) for r in got)


def planted(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, dim))
    near = base[: n // 4] + rng.normal(size=(n // 4, dim)) * 0.15 * rng.random((n // 4, 1))
    hot = base[0] + rng.normal(size=(n // 3, dim)) * 0.05
    every = np.concatenate([base, near, base[: n // 10], base[:5] * 3, hot]).astype(np.float32)
    return [(int(k * 37 % 10007), v.tolist(), int(k % 2) if k % 5 else 1) for k, v in enumerate(every)]


@pytest.mark.parametrize("options", [{}, {"leaf": 32, "block": 20}])
def test_against_brute_force(spark, options):
    rows = planted(240)
    got, want = found(spark, rows, **options), brute(rows)
    same = sum(a == b for a, b in zip(got, want))
    assert [g[0] for g in got] == [w[0] for w in want] and same >= (len(want) if not options else 0.97 * len(want))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 0.5]
    rows = [(1, v, 1), (2, v, 1), (2, v, 1), (3, [2.0, 4.0, 1.0], 1), (4, v, 2), (5, v, None), (None, v, 1), (6, None, 1), (7, [], 1), (8, [0.0] * 3, 1), (9, [1.0, None, 2.0], 1), (10, [nan, 1.0, 1.0], 1), (11, [inf, 1.0, 1.0], 1), (12, [1.0, 2.0], 1), (13, [1.0, 2.0], 1), (14, [1e-30] * 3, 1), (15, [1e-30] * 3, 1)]
    assert found(spark, rows) == brute(rows)
    assert E.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    # one vec_id, unlike vectors: each has its own links
    twice = [(1, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [1.0, 0.1], 1), (3, [0.1, 1.0], 1), (4, [0.0, 1.1], 1)]
    assert found(spark, twice) == brute(twice) == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (4, 2, 1)]
    assert found(spark, [(1, None, 1)]) == [(1, 0, 1)]


def close_pairs(rng, n, dim, spread, cosine):
    """n unit vectors around one direction, and for each a neighbour at the cosine."""
    base = np.eye(dim)[0] + rng.normal(size=(n, dim)) * spread / np.sqrt(dim)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    off = rng.normal(size=(n, dim))
    off -= (off * base).sum(axis=1, keepdims=True) * base
    return np.stack([base, cosine * base + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off, axis=1, keepdims=True)], axis=1).reshape(2 * n, dim)


def test_a_small_label_stays_exact_beside_a_large_one(spark):
    rng = np.random.default_rng(3)
    small, large = close_pairs(rng, 16, 32, 20, 0.932), rng.normal(size=(4200, 32))
    rows = [(k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(small)] + [(100 + k, v.astype(np.float32).tolist(), 2) for k, v in enumerate(large)]
    assert [g for g in found(spark, rows, leaf=32, trees=1) if g[0] < 100] == brute(rows[:32])


def test_recall_in_a_large_tight_label(spark):
    e = close_pairs(np.random.default_rng(4), 2000, 32, 0.35, 0.932).astype(np.float32)
    u = e / np.linalg.norm(e.astype(float), axis=1, keepdims=True)
    links = (u @ u.T >= 0.93).sum() - len(u)
    got = found(spark, [(k, v.tolist(), 1) for k, v in enumerate(e)], leaf=32)
    assert 0.985 * links <= sum(g[1] for g in got) <= links
