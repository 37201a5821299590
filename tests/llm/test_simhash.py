import random

import xxhash

from scorelake.llm import simhash_bk as S
from scorelake.llm.components import connected
from tests.llm.helpers import DOCS, WORD, awkward, doc


def brute_fingerprint(text):
    ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    """By fingerprint: the least doc_id reachable, over pairs of at most two differing bits."""
    own = {}
    for i, f in rows:
        own[f] = min((x for x in (own.get(f), i) if x is not None), default=None)
    change = True
    while change:
        change = False
        for a in own:
            for b in own:
                if (a ^ b).bit_count() <= 2 and own[a] is not None and (own[b] is None or own[a] < own[b]):
                    own[b], change = own[a], True
    return own


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(3)
    keys = [rng.getrandbits(64) for _ in range(300)]
    keys += [k ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in keys[:100]]
    tree = S.BKTree()
    for k in keys:
        tree.add(k)
    for x in keys[:80] + [0]:
        for radius in (0, 2, 9):
            assert {keys[i] for i in tree.within(x, radius)} == {k for k in keys if (k ^ x).bit_count() <= radius}


def test_against_brute_force(spark):
    rng = random.Random(1)
    base = [" ".join(rng.choice("alpha beta gamma delta eps zeta eta theta iota".split()) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    texts = base + [t + " tail" for t in base[:20]] + base[:10] + [t.upper() for t in base[10:14]]
    rows = [doc(7 * k % 1009, t) for k, t in enumerate(texts)] + [r for r in awkward() if r[0]]
    rows = [(100_000 + k if r[0] is None else r[0], *r[1:]) for k, r in enumerate(rows)]
    got = S.near_duplicates(spark.createDataFrame(rows, DOCS), shard=8).collect()
    prints = sorted((r["doc_id"], r["fp"] & (2**64 - 1)) for r in got)
    assert prints == sorted((r[0], brute_fingerprint(r[1])) for r in rows)
    own = brute_components(prints)
    assert all(r["component_id"] == own[r["fp"] & (2**64 - 1)] for r in got)


def test_planted_bits_link_in_shards(spark):
    """One large bucket, cut into many shards, gives the components of a scan."""
    rng = random.Random(9)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(43, 64)) ^ (1 << rng.randrange(43, 64)) ^ (1 << rng.randrange(0, 64)) for _ in range(150)})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    links = S.bk_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), shard=16)
    got = {r["node"]: r["component"] for r in connected(links).collect()}
    want = brute_components(zip(signed, fps))
    assert {f: got.get(s, s) for f, s in zip(fps, signed)} == want


def test_components_of_a_chain_and_a_star(spark):
    links = [(k, k + 1) for k in range(40)] + [(500, 600 + k) for k in range(300)] + [(None, 3), (7, 7), (41, None)]
    got = {r["node"]: r["component"] for r in connected(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {500: 500} | {600 + k: 500 for k in range(300)}
    assert connected(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_rows_without_id_join_others_and_one_id_may_have_unlike_texts(spark):
    marked = spark.createDataFrame([(9, 1), (None, 7), (5, 31), (5, 960), (6, 960), (None, 61440 << 20)], "doc_id bigint, fp bigint")
    owners = {r["fp"]: r["owner"]["doc_id"] for r in S._owners(marked, 2, 8).collect()}
    assert owners == {1: 5, 7: 5, 31: 5, 960: 5, 61440 << 20: None}
    base = "one two three four five six seven eight nine ten eleven"
    rows = [doc(1, base), doc(1, base), doc(1, "wholly other words stand here, none of them alike"), doc(2, base.upper()), doc(None, base)]
    kept = sorted((r["doc_id"], r["text"]) for r in S.one_of_each(spark.createDataFrame(rows, DOCS)).collect())
    assert kept == [(1, base), (1, rows[2][1])]


def test_awkward_rows(spark):
    df = spark.createDataFrame(awkward(), DOCS)
    assert S.near_duplicates(df).count() == len(awkward())
    kept = S.one_of_each(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 6, 7, 10] and ids.count(None) == 1
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
