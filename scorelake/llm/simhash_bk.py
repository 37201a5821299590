"""SimHash near-duplicates by BK-trees.

Fingerprints are 64 bits by majority over the XXH64 hashes (seed 42) of word shingles.
Two documents link if their fingerprints differ in at most ``radius`` bits.  Distinct
fingerprints are dealt into shards by radius + 1 bit blocks (two that differ in at most
radius bits agree in one block at least), shards of a size limit each get a BK-tree whose
children are keyed by their integer Hamming distance to the parent, and a search follows
only the edges within the radius.  Shard trees meet their queries in a shuffle: their
total size grows with the corpus, so that a driver-side broadcast would not be bounded.

A shard task returns one link a fingerprint at most, to the root of its local group, and
never all pairs within a group.  Equal fingerprints are one node, so that any number of
exact copies costs nothing more.

Null text counts as empty: no words, fingerprint zero, which links like any other.  Links
run between fingerprints, so rows with a null doc_id join others as well and get the component
of their fingerprint (null if no row of it has a doc_id), and rows that share a doc_id each get
the component of their own.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import runs, shard_pairs
from .common import SPACE, free, lean, width, written
from .components import connected

RADIUS = 2
SHINGLE = 3
SHARD = 2048

_SPACE = re.compile(SPACE)
_LOWER = {c: c + 32 for c in range(65, 91)}


def fingerprint(text: str | None, k: int = SHINGLE, step: int = 65536) -> int:
    """As unsigned 64 bits.  Bits are counted ``step`` shingles at a time, so memory stays bounded by the text."""
    ws = _SPACE.split((text or "").translate(_LOWER))
    if not ws[0]:
        ws = ws[1:]
    if ws and not ws[-1]:
        ws = ws[:-1]
    n = len(ws)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    m = max(1, n - k + 1)
    bits = np.zeros(64, np.int64)
    for s in range(0, m, step):
        grams = map(" ".join, zip(*(ws[s + i : min(s + step, m) + i] for i in range(k)))) if n >= k else [" ".join(ws)]
        h = np.fromiter((h64(g, 42) for g in grams), np.uint64)
        bits += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > m).tobytes(), "big")


class BKTree:
    """Children are keyed by integer Hamming distance to the parent."""

    def __init__(self) -> None:
        self.keys: list[int] = []
        self.kids: list[dict[int, int]] = []

    def add(self, x: int) -> None:
        if self.keys:
            at = 0
            while True:
                d = (x ^ self.keys[at]).bit_count()
                down = self.kids[at].get(d)
                if down is None:
                    self.kids[at][d] = len(self.keys)
                    break
                at = down
        self.keys.append(x)
        self.kids.append({})

    def within(self, x: int, radius: int):
        """Positions of keys at most radius away, by the edges whose distance is within radius of x's own."""
        todo = [0] if self.keys else []
        while todo:
            at = todo.pop()
            d = (x ^ self.keys[at]).bit_count()
            if d <= radius:
                yield at
            kids = self.kids[at]
            for e in range(d - radius, d + radius + 1):
                if (down := kids.get(e)) is not None:
                    todo.append(down)


def _local_links(fp: np.ndarray, shard: np.ndarray, i: int, j: int, radius: int) -> list[tuple[int, int]]:
    """Links from each member to the root of its group, within shard i or between shards i and j."""
    tree, roots = BKTree(), list(range(len(fp)))

    def root(x: int) -> int:
        while roots[x] != x:
            roots[x] = x = roots[roots[x]]
        return x

    values = fp.view(np.uint64).tolist()
    stored = [x for x in range(len(values)) if shard[x] == i]
    asking = stored if i == j else [x for x in range(len(values)) if shard[x] == j]
    if i != j:
        for x in stored:
            tree.add(values[x])
    for n, x in enumerate(asking):
        mine = root(x)
        for hit in tree.within(values[x], radius):
            theirs = root(stored[hit])
            if theirs != mine:
                mine, theirs = min(mine, theirs), max(mine, theirs)
                roots[theirs] = mine
        if i == j:
            tree.add(values[x])
    return [(fp[x], fp[root(x)]) for x in range(len(values)) if root(x) != x]


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, k) for t in b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return lean(docs, doc_id="bigint", text="string").mapInPandas(run, "doc_id bigint, fp bigint")


def bk_links(nodes: DataFrame, radius: int = RADIUS, shard: int = SHARD) -> DataFrame:
    """nodes: fp (distinct).  Links (a, b) that join all fingerprints within the radius."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    keys = F.array(*[
        F.concat_ws(":", F.lit(i), F.expr(f"shiftrightunsigned(shiftleft(fp, {lo}), {64 - (hi - lo)})").cast("string")) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))
    ])
    keyed = nodes.select(F.explode(keys).alias("block"), "fp")
    dealt = shard_pairs(keyed, "block", F.xxhash64("fp"), shard)
    by = ["block", "group_i", "group_j"]

    def run(batches):
        for g in runs(batches, by):
            fp = g["fp"].to_numpy(np.int64)
            order = np.argsort(fp)
            found = _local_links(fp[order], g["shard"].to_numpy()[order], int(g["group_i"].iloc[0]), int(g["group_j"].iloc[0]), radius)
            if found:
                yield pd.DataFrame(found, columns=["a", "b"])

    # by number: tasks of few bytes but much comparing must not be merged
    return dealt.repartition(width(nodes.sparkSession), *by).sortWithinPartitions(*by).mapInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """One row per document: doc_id, fp (long), component_id (least doc_id reachable by links)."""
    marked = written(fingerprints(docs, k), "fingerprints")
    return marked.join(_owners(marked, radius, shard), "fp").select("doc_id", "fp", F.col("owner.doc_id").alias("component_id"))


def _owners(marked: DataFrame, radius: int, shard: int) -> DataFrame:
    """marked: doc_id, fp and more.  For each fingerprint, the least row of its component as ``owner``: by doc_id, null last, then by the other columns."""
    whole = F.struct(F.col("doc_id").isNull().alias("none"), *marked.columns)
    nodes = written(marked.groupBy("fp").agg(F.min(whole).alias("least")), "nodes")
    joined = connected(bk_links(nodes.select("fp"), radius, shard))
    known = written(nodes.join(joined, nodes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("root")), "roots")
    owner = known.groupBy("root").agg(F.min("least").alias("owner"))
    return written(known.join(owner, "root").select("fp", "owner"), "owners")


def one_of_each(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE, shard: int = SHARD) -> DataFrame:
    """The rows of docs, with all their columns, that stay: one of each component, that of the
    least doc_id (null last), then of the least fingerprint and hash of the row.

    The hash takes columns of plain types; of rows alike in all of these one stays.
    """
    plain = [c for c, t in docs.dtypes if "<" not in t and t not in ("variant", "void")]
    row = free(docs, "row")
    rows = docs.withColumn(row, F.xxhash64(*plain))

    def run(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t, k) for t in b["text"]), np.uint64, len(b)).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp, "row": b[row]})

    marked = written(lean(rows, doc_id="bigint", text="string", **{row: "bigint"}).mapInPandas(run, "doc_id bigint, fp bigint, row bigint"), "fingerprints")
    owners = _owners(marked, radius, shard).select(F.col("owner.doc_id").alias("_id"), F.col("owner.row").alias("_keep")).distinct()
    same = lambda df, one: df["doc_id"].cast("bigint").eqNullSafe(one["_id"])
    kept = written(marked.join(owners, same(marked, owners) & (marked["row"] == owners["_keep"])).groupBy("_id", "_keep").count(), "kept")
    once, more = (rows.join(one := kept.where(x), same(rows, one) & (rows[row] == one["_keep"]), "left_semi") for x in ("count = 1", "count > 1"))
    # only rows that repeat exactly are gathered again, to leave one of them
    return once.unionByName(more.dropDuplicates(["doc_id", row])).drop(row)
