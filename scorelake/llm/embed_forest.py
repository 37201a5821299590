"""Near-duplicate embeddings by a forest of random-projection trees.

A tree splits recursively at the median of a random projection, one direction a level, and
sends vectors near a split to both sides (spill).  Medians come from a bounded sample of
``SAMPLE`` vectors, by node while a node has 16 of them and by level below that, so the
model stays small at any depth.  Depth follows from the label's own count, so that a label
that fits one leaf is compared whole and exactly.  A label that is split gets as many trees
(``TREES`` to ``MOST``) as join at least ``RECALL`` of trial pairs, made ones at cosine ``CUT``
and links among a sample of the label, routed through these very trees.  Where ``MOST`` trees do
not reach it, the label is split less deep.  Leaves of a label are compared whole (in blocks
when large), and pairs with cosine >= ``CUT`` in double precision are links.

A pair that shares several leaves counts once: in the least leaf of both.  A task returns
counts and one link to its local root for each vector, never pairs.  Equal vectors of a label
(by two 64-bit hashes) are one node with a number of its own and a count, so that components
and counts hang on vectors and not on vec_ids, which may repeat.

Links join vectors of equal labels that are not null.  Vectors that are null, empty, zero or hold null or
non-finite components, and rows with a null vec_id or label, link with nothing: n_links 0, their own
component, kept.  Vectors of other lengths than the sample's most common one are compared
within their own length by one leaf.  Repeated rows count as links of each other; rows that share a
vec_id with unlike vectors are each vectors of their own.  An empty table gives no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, width, written
from .components import connected

CUT = 0.93
TREES = 6
MOST = 24
RECALL = 0.99
#: Vectors of a label, and made pairs for each, that its number of trees is measured with.
TRIALS, NEIGHBOURS = 256, 4
LEAF = 48
SAMPLE = 4096
SPILL = 0.35
BLOCK = 1024


class Forest:
    """Directions (trees, depth, dim); thresholds by node for the first levels, by level below."""

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, cut: float = CUT, seed: int = 11) -> None:
        self.dim, self.depth, self.trees = sample.shape[1], depth, trees
        rng = np.random.default_rng(seed)
        d = rng.normal(size=(trees, max(1, depth), self.dim))
        self.directions = d / np.linalg.norm(d, axis=2, keepdims=True)
        self.spill = SPILL * np.sqrt(2 - 2 * cut) / np.sqrt(self.dim)
        self.level = np.zeros((trees, depth))
        self.node: list[list[dict[int, float]]] = [[{} for _ in range(depth)] for _ in range(trees)]
        for t in range(trees):
            at = np.zeros(len(sample), np.int64)
            for k in range(depth):
                p = sample @ self.directions[t, k]
                self.level[t, k] = np.median(p)
                names, many = np.unique(at, return_counts=True)
                for x in names[many >= 16]:
                    self.node[t][k][int(x)] = float(np.median(p[at == x]))
                at = at * 2 + (p > self._cuts(t, k, at))

    def _cuts(self, t: int, k: int, at: np.ndarray) -> np.ndarray:
        names, back = np.unique(at, return_inverse=True)
        return np.array([self.node[t][k].get(int(x), self.level[t, k]) for x in names])[back] if len(at) else np.zeros(0)

    def walk(self, t: int, units: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, node) for every node of a tree's level that a row reaches."""
        row, at = np.arange(len(units)), np.zeros(len(units), np.int64)
        p = units @ self.directions[t, :depth].T
        for k in range(depth):
            d = p[row, k] - self._cuts(t, k, at)
            left, right = d <= self.spill, d > -self.spill
            row, at = np.concatenate([row[left], row[right]]), np.concatenate([2 * at[left], 2 * at[right] + 1])
        return row, at

    def leaves(self, units: np.ndarray, depth: int | None = None, trees: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf of every row in the first trees; a leaf's number starts with its tree's."""
        found = [self.walk(t, units, self.depth if depth is None else depth) for t in range(self.trees if trees is None else trees)]
        return np.concatenate([r for r, _ in found]), np.concatenate([x + (t << 48) for t, (_, x) in enumerate(found)])

    def needed(self, units: np.ndarray, depth: int, least: int, cut: float, recall: float = RECALL) -> tuple[int, int]:
        """Depth and number of trees in which recall of trial pairs share a leaf, both of made pairs and of the links among units.

        Made pairs are at the cut, around points that lie as close together as the middles of
        pairs of a label do.  Of the links, those of least cosine are taken.
        """
        rng, many = np.random.default_rng(13), len(units) * NEIGHBOURS
        middle = units.mean(axis=0)
        m = np.repeat(middle + (units - middle) / np.sqrt(2), NEIGHBOURS, axis=0)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        off = rng.normal(size=m.shape)
        off -= (off * m).sum(axis=1, keepdims=True) * m
        off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-12)
        m, off = m * np.sqrt((1 + cut) / 2), off * np.sqrt((1 - cut) / 2)
        cosine = np.triu(units @ units.T, 1)
        i, j = np.nonzero(cosine >= cut)
        hard = np.argsort(cosine[i, j], kind="stable")[:many]
        a, b = np.concatenate([m + off, units[i[hard]]]), np.concatenate([m - off, units[j[hard]]])
        n = len(a)
        for d in range(depth, 0, -1):
            joined = np.zeros(n, bool)
            for t in range(self.trees):
                row, at = self.walk(t, np.concatenate([a, b]), d)
                pair = at * n + row % n
                joined[np.intersect1d(pair[row < n], pair[row >= n]) % n] = True
                if t + 1 >= least and joined[:many].mean() >= recall and (n == many or joined[many:].mean() >= recall):
                    return d, t + 1
        return 0, 1


def units(v: np.ndarray) -> np.ndarray:
    """Rows, none of them zero or non-finite, at length one in double precision."""
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _usable(vector: Column) -> Column:
    """Whether a vector may link: it has components, none null or non-finite, and one that is not zero."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column one after another, and where each row starts (one more than rows)."""
    sizes = np.diff(column.offsets.to_numpy())
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def _first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least leaf in both rows; -1 pads."""
    out = np.empty(len(a), np.int64)
    step = max(1, (1 << 24) // max(1, a.shape[1] ** 2))
    for s in range(0, len(a), step):
        x, y = a[s : s + step], b[s : s + step]
        same = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0)
        out[s : s + step] = np.where(same, x, np.iinfo(np.int64).max).min(axis=1)
    return out


def _compare(group: tuple, node: np.ndarray, copies: np.ndarray, shard: np.ndarray, u: np.ndarray, leaves: list[np.ndarray], cut: float):
    """One leaf, or a pair of its shards: node, n (links counted here, with copies), root; only rows with links."""
    *_, leaf, i, j = group
    order = np.argsort(node)
    node, copies, shard, u = node[order], copies[order], shard[order], u[order]
    a = np.flatnonzero(shard == i)
    b = a if i == j else np.flatnonzero(shard == j)
    n, roots, own = np.zeros(len(node), np.int64), np.arange(len(node)), None
    for s in range(0, len(a), 512):
        p, q = np.nonzero(u[a[s : s + 512]] @ u[b].T >= cut)
        p, q = a[s : s + 512][p], b[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        if not len(p):
            continue
        if own is None:
            own = np.full((len(node), max(map(len, leaves))), -1, np.int64)
            for k, x in enumerate(order.tolist()):
                own[k, : len(leaves[x])] = leaves[x]
        mine = _first_common(own[p], own[q]) == leaf
        n += np.bincount(p[mine], copies[q[mine]], len(node)).astype(np.int64) + np.bincount(q[mine], copies[p[mine]], len(node)).astype(np.int64)
        while True:  # least root over links, until nothing changes
            least = np.minimum(roots[p], roots[q])
            new = roots.copy()
            np.minimum.at(new, roots[p], least)
            np.minimum.at(new, roots[q], least)
            while (new != new[new]).any():
                new = new[new]
            if (new == roots).all():
                break
            roots = new
    some = (n > 0) | (roots != np.arange(len(node)))
    return node[some], n[some], node[roots[some]]


GROUP = ["label_a", "label_b", "leaf", "group_i", "group_j"]


def _groups(batches):
    """From batches of a partition sorted by GROUP: group, node, copies, shard, unit vectors, leaves of each run; holds one run besides a batch."""
    at, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.stack([b.column(c).to_numpy() for c in GROUP], axis=1)
        vector, vs = _lists(b.column("embedding"))
        leaf, ls = _lists(b.column("leaves"))
        node, copies, shard = (b.column(c).to_numpy() for c in ("node", "copies", "shard"))
        edges = [0, *((keys[1:] != keys[:-1]).any(axis=1).nonzero()[0] + 1).tolist(), len(keys)]
        for s, e in zip(edges, edges[1:]):
            here = tuple(keys[s].tolist())
            if here != at and held:
                yield at, *_joined(held)
                held = []
            at = here
            # a leaf holds vectors of one length
            held.append((node[s:e], copies[s:e], shard[s:e], units(vector[vs[s] : vs[e]].reshape(e - s, -1)), [leaf[x:y] for x, y in zip(ls[s:e], ls[s + 1 : e + 1])]))
    if held:
        yield at, *_joined(held)


def _joined(held: list[tuple]) -> tuple:
    return held[0] if len(held) == 1 else (*[np.concatenate([h[k] for h in held]) for k in range(4)], [x for h in held for x in h[4]])


def _depth(count: int, leaf: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, count) / leaf))))


def _forest(first: DataFrame, large: DataFrame, leaf: int, trees: int, cut: float) -> tuple[Forest, int]:
    """Fitted on a bounded sample, the SAMPLE vectors of least hash; the dimension is the most common one in it."""
    most = large.agg(F.max("count")).first()[0] or 0
    sample = [np.array(r["embedding"], np.float64) for r in first.orderBy("key_a", "key_b").limit(SAMPLE).select("embedding").collect()]
    dim = int(pd.Series([len(x) for x in sample]).mode()[0]) if sample else 1
    fixed = units(np.stack([x for x in sample if len(x) == dim])) if sample else np.zeros((1, 1))
    return Forest(fixed, _depth(most, leaf), trees, cut), dim


def _measured(first: DataFrame, large: DataFrame, sent, dim: int, leaf: int, trees: int, cut: float) -> DataFrame:
    """label, depth, trees of labels that are split, from about TRIALS vectors of each."""

    def measure(g: pd.DataFrame) -> pd.DataFrame:
        some = [x for x in g["embedding"] if len(x) == dim]
        depth, n = sent.value.needed(units(np.stack(some)), _depth(int(g["count"].iloc[0]), leaf), trees, cut) if some else (0, 1)
        return pd.DataFrame({"label": [g["label"].iloc[0]], "depth": [depth], "trees": [n]})

    tried = first.join(large, "label").where(F.pmod("key_a", F.ceil(F.col("count") / TRIALS)) == 0).select("label", "count", "embedding")
    return written(tried.groupBy("label").applyInPandas(measure, "label string, depth int, trees int"), "split")


def _routed(first: DataFrame, split: DataFrame, sent, dim: int) -> DataFrame:
    """node and its leaves; a label without a row in split is one leaf of one tree."""
    known = first.join(split, "label", "left").select("node", "embedding", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("trees", F.lit(1)).alias("trees"))

    def route(batches):
        for b in batches:
            vector, vs = _lists(b.column("embedding"))
            size, depth, trees = np.diff(vs), b.column("depth").to_numpy(), b.column("trees").to_numpy()
            odd = np.flatnonzero(size != dim)
            rows, names = [odd], [(size[odd].astype(np.int64) << 32) | (1 << 62)]
            for d, n in {(int(d), int(n)) for d, n in zip(depth, trees)}:
                at = np.flatnonzero((size == dim) & (depth == d) & (trees == n))
                if len(at):
                    row, name = sent.value.leaves(units(vector[(vs[at, None] + np.arange(dim)).ravel()].reshape(-1, dim)), d, n)
                    rows.append(at[row])
                    names.append(name)
            row, name = np.concatenate(rows), np.concatenate(names)
            order = np.lexsort((name, row))
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))])
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(name[order], pa.int64()))], ["node", "leaves"])

    return known.mapInArrow(route, "node bigint, leaves array<bigint>")


def _found(first: DataFrame, routed: DataFrame, cut: float, block: int) -> DataFrame:
    """node, n, root over all leaves; a leaf of more than ``block`` vectors is compared in pairs of its shards."""
    label = [F.xxhash64("label").alias("label_a"), F.hash("label").cast("bigint").alias("label_b")]
    rows = first.select("node", "copies", "embedding", *label).join(routed, "node")
    placed = rows.withColumn("leaf", F.explode("leaves")).withColumn("leaves", F.expr("filter(leaves, x -> x <= leaf)"))
    place = ["label_a", "label_b", "leaf"]
    slim = first.select("node", *label).join(routed, "node").select(*place[:2], F.explode("leaves").alias("leaf"))
    big = written(slim.groupBy(*place).count().where(F.col("count") > block).select(*place, F.ceil(F.col("count") / block).cast("int").alias("shards")), "big")
    dealt = placed.join(big, place, "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")))
    pair = F.transform(F.sequence(F.lit(0), F.col("shards") - 1), lambda o: F.struct(F.least("shard", o).alias("i"), F.greatest("shard", o).alias("j")))
    dealt = dealt.withColumn("pair", F.explode(pair)).select("node", "copies", "embedding", "leaves", *place, "shard", F.col("pair.i").alias("group_i"), F.col("pair.j").alias("group_j"))

    def compare(batches):
        parts: list[tuple] = []
        for group, *members in _groups(batches):
            parts.append(_compare(group, *members, cut))
            if sum(len(p[0]) for p in parts) > 1 << 16:
                yield _batch(parts)
                parts = []
        if parts:
            yield _batch(parts)

    by = dealt.repartition(width(first.sparkSession), *GROUP).sortWithinPartitions(*GROUP)
    return written(by.mapInArrow(compare, "node bigint, n bigint, root bigint"), "found")


def _batch(parts: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), pa.int64()) for k in range(3)], ["node", "n", "root"])


def near_duplicates(embeddings: DataFrame, cut: float = CUT, trees: int = TREES, leaf: int = LEAF, block: int = BLOCK) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    kind = dict(embeddings.dtypes).get("embedding")
    rows = lean(embeddings, vec_id="bigint", embedding="array<float>" if kind == "array<float>" else "array<double>", label="string")
    links = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("embedding"))
    rows = rows.withColumn("key_a", F.when(links, F.xxhash64("label", "embedding"))).withColumn("key_b", F.when(links, F.xxhash64("embedding", F.lit(1), "label")))
    same = rows.where("key_a is not null").groupBy("key_a", "key_b").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    first = written(same.withColumn("node", F.monotonically_increasing_id()), "distinct")
    large = written(first.groupBy("label").count().where(F.col("count") > leaf), "large")
    forest, dim = _forest(first, large, leaf, max(trees, MOST), cut)
    sent = rows.sparkSession.sparkContext.broadcast(forest)  # at most SAMPLE / 16 thresholds a tree and level
    routed = written(_routed(first, _measured(first, large, sent, dim, leaf, trees, cut), sent, dim), "routed")
    found = _found(first, routed, cut, block)
    joined = connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a != b"))
    slim = first.select("key_a", "key_b", "rep", "copies", "node")
    known = slim.join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(joined, "node", "left")
    known = written(known.select("key_a", "key_b", "rep", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("rep").alias("component_id"))
    known = known.join(least, "component").select("key_a", "key_b", "n_links", "component_id")
    out = rows.select("vec_id", "key_a", "key_b").join(known, ["key_a", "key_b"], "left")
    component = F.when(F.col("key_a").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
