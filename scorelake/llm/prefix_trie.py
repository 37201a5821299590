"""A trie of conversations by polynomial rolling prefix fingerprints.

1. Turns get a place in their conversation and the fingerprint of the prefix that ends in them,
   sum of t(k) * BASE**(d - k) modulo 2**64 over the hashes t of its turns, by a numpy scan over
   ranges of (conv_id, turn), so that a conversation of any length is split among tasks.
2. A conversation begins with the first turns of another one.  Fingerprints of its prefixes follow
   from those of both by the polynomial; turns of the other one are never copied.
3. Equal (depth, fingerprint) make a candidate node.  Where turns of several conversations meet in
   one, each distinct turn is compared with the turn of the representative (the smallest member).
   BASE is odd, so equal fingerprints and equal last turns mean equal fingerprints before: a group whose last
   turns are equal at each depth is one prefix.  Turns that differ from the representative's split the
   group: they are numbered, and the numbers met on the way down join the node's key.
4. Rollup: each node belongs to its smallest member, and what a member owns is the tail of its path.
   So what lies below a node is the sum, over its members, of what they own, less what its owner
   owns above it.  Copies and common turns are summed before each shuffle.
5. Ids of conversations that end in a node are joined in blocks of ``BLOCK`` along ranges, and a node's hash
   takes its blocks in order, so no task collects them.

Rows with a null conv_id belong to no conversation and are left out.  Null turns come first; turns of
equal number follow by role and text, and repeats count each.  Null role or text is empty.
No conversations: no nodes.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lean, scratch, width, written
from .ranged import power, scan

BASE = 0x9E3779B97F4A7C15 | 1
FAMILY = 20
HEADS = 3
BLOCK = 1 << 14
KEY = ["depth", "f", "s"]


def _turns(conversations: DataFrame, base: int, mask: int, name: str = "turns") -> DataFrame:
    rows = lean(conversations, conv_id="bigint", turn="bigint", role="string", text="string").where("conv_id is not null")
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("t", F.xxhash64("role", "text").bitwiseAND(F.lit(mask))).withColumn("words", F.regexp_count("text", F.lit(WORD)).cast("bigint"))
    return scan(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], "t", base, name)


def _moved(base: int):
    """Fingerprints with the head before them exchanged: h + (new - old) * base**n, and the one before, (that - t) / base."""
    back = np.uint64(pow(base, -1, 1 << 64))

    @F.pandas_udf("f bigint, pf bigint")
    def run(h: pd.Series, new: pd.Series, old: pd.Series, n: pd.Series, t: pd.Series) -> pd.DataFrame:
        h, new, old, t = (x.to_numpy(np.int64).view(np.uint64) for x in (h, new, old, t))
        f = h + (new - old) * power(base, n.to_numpy(np.int64))
        return pd.DataFrame({"f": f.view(np.int64), "pf": ((f - t) * back).view(np.int64)})

    return run


def _of(prefix: str, k: Column) -> Column:
    """Column prefix1 .. prefix3 by number; 0 for none."""
    out = F.lit(0).cast("bigint")
    for i in range(1, HEADS + 1):
        out = F.when(k == i, F.col(f"{prefix}{i}")).otherwise(out)
    return F.coalesce(out, F.lit(0))


def _plans(turns: DataFrame) -> DataFrame:
    """For each conversation: h (own turns left out), m (turns of the other one ahead), new and old (fingerprints of these), size when rebuilt."""
    per = turns.groupBy("conv_id").agg(
        F.count("*").alias("own"), F.max_by("h", "place").alias("end"), *[F.max(F.when(F.col("place") == k, F.col("h"))).alias(f"p{k + 1}") for k in range(HEADS)]
    )
    per = written(per, "conversations")
    first = F.col("conv_id") % FAMILY == 0
    heads = per.where(first).select(F.col("conv_id").alias("head"), F.col("own").alias("head_size"), *[F.col(f"p{k}").alias(f"q{k}") for k in range(1, HEADS + 1)])
    skip = F.when(first, 0).otherwise(F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("bigint")  # one that begins with itself stays as it is
    per = per.withColumn("skip", skip).join(heads, F.col("conv_id") - F.col("conv_id") % FAMILY == F.col("head"), "left")
    per = per.withColumn("m", F.least("skip", F.coalesce("head_size", F.lit(0))))
    left = F.greatest(F.col("own") - F.col("skip"), F.lit(0))
    return per.select("conv_id", "skip", "m", "end", F.col("head"), *[f"q{k}" for k in range(1, HEADS + 1)], left.alias("left"), (F.col("m") + left).alias("size"), _of("q", F.col("m")).alias("new"), _of("p", F.col("skip")).alias("old"))


def _collisions(own: DataFrame, turns: DataFrame, plans: DataFrame) -> DataFrame | None:
    """conv_id, path: for conversations with turns that differ from the representative's, the (depth, number) of each; None if there are none.

    own: conv_id, place, depth, f of the conversations' own turns.
    """
    many = own.groupBy("depth", "f").agg(F.count("*").alias("n")).where("n > 1").select("depth", "f")
    met = own.select("conv_id", "place", "depth", "f").join(many, ["depth", "f"])
    texts = met.join(turns.select("conv_id", "place", "role", "text"), ["conv_id", "place"])
    kinds = texts.groupBy("depth", "f", "role", "text").agg(F.min("conv_id").alias("least"))  # copies become one before the shuffle
    best = kinds.groupBy("depth", "f").agg(F.min(F.struct("least", "role", "text")).alias("best"))
    odd = written(kinds.join(best, ["depth", "f"]).where((F.col("role") != F.col("best.role")) | (F.col("text") != F.col("best.text"))).drop("best"), "odd")
    if odd.isEmpty():
        return None
    odd = odd.withColumn("v", F.row_number().over(Window.partitionBy("depth", "f").orderBy("least"))).drop("least")
    mine = written(texts.join(odd, ["depth", "f", "role", "text"]).select("conv_id", "depth", "v"), "flags")
    lent = plans.where("m > 0").select(F.col("conv_id").alias("_id"), "head", "m").join(mine, F.col("head") == mine["conv_id"]).where("depth <= m").select(F.col("_id").alias("conv_id"), "depth", "v")
    return written(mine.union(lent).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "v"))).alias("path")), "paths")  # as long as a conversation's collisions


def _marked(rows: DataFrame, paths: DataFrame | None, parents: bool = True) -> DataFrame:
    """Adds s (the collisions on the way to a node) and ps (those on the way to its parent)."""
    if paths is None:
        return rows.withColumns({"s": F.lit("")} | ({"ps": F.lit("")} if parents else {}))
    upto = lambda d: F.coalesce(F.array_join(F.transform(F.filter("path", lambda x: x["depth"] <= d), lambda x: F.concat_ws(":", x["depth"], x["v"])), ","), F.lit(""))
    out = rows.join(paths, "conv_id", "left").withColumn("s", upto(F.col("depth")))
    return (out.withColumn("ps", upto(F.col("depth") - 1)) if parents else out).drop("path")


def _blocks(batches, block: int):
    """From (depth, f, s, conv_id) in order, a row for each node and up to ``block`` ids: the first, and all joined by commas."""
    names = ["depth", "f", "s", "at", "ids"]
    key, ids, out = None, [], []

    def close():
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))

    for b in batches:
        cols = [b.column(c).to_pylist() for c in (*KEY, "conv_id")]
        for d, f, s, i in zip(*cols):
            if (d, f, s) != key or len(ids) >= block:
                close()
                key, ids = (d, f, s), []
            ids.append(i)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
            out = []
    close()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)


def _digests(batches):
    """From blocks of nodes in order, the hash of each node's blocks joined by commas."""
    names, key, state = [*KEY, "ends_sha256"], None, None
    for b in batches:
        out = []
        for d, f, s, ids in zip(*(b.column(c).to_pylist() for c in (*KEY, "ids"))):
            if (d, f, s) != key:
                if key:
                    out.append((*key, state.hexdigest()))
                key, state = (d, f, s), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names)
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, state.hexdigest())], names)


def _ends(ends: DataFrame, block: int) -> DataFrame:
    """depth, f, s, ends_sha256 of nodes in which a conversation ends.  ends: conv_id, depth, f, s."""
    wide = width(ends.sparkSession)
    order = [*KEY, "conv_id"]
    ends = written(ends.select(*order), "ends")
    blocks = ends.repartitionByRange(wide, *order).sortWithinPartitions(*order).mapInArrow(lambda b: _blocks(b, block), "depth bigint, f bigint, s string, at bigint, ids string")
    return blocks.repartition(*KEY).sortWithinPartitions(*KEY, "at").mapInArrow(_digests, "depth bigint, f bigint, s string, ends_sha256 string")


def trie(conversations: DataFrame, base: int = BASE, mask: int = -1, block: int = BLOCK) -> DataFrame:
    """A row for each node: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``mask`` keeps bits of the turns' hashes; few of them force collisions.
    """
    with scratch(conversations.sparkSession):
        turns = _turns(conversations, base, mask)
        plans = written(_plans(turns), "plans")
        moved, none = _moved(base), F.lit(None).cast("bigint")
        rows = turns.select("conv_id", "place", "h", "t", "words").join(plans.select("conv_id", "skip", "m", "size", "new", "old"), "conv_id").where("place >= skip")
        rows = rows.withColumn("x", moved("h", "new", "old", F.col("place") - F.col("skip") + 1, "t"))
        own = written(rows.select("conv_id", "place", (F.col("place") - F.col("skip") + F.col("m") + 1).alias("depth"), "x.f", "x.pf", "words", "size"), "own")
        paths = _collisions(own, turns, plans)
        lent = plans.where("m > 0").withColumn("depth", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("m"))))
        lent = lent.select("conv_id", "depth", _of("q", F.col("depth")).alias("f"), _of("q", F.col("depth") - 1).alias("pf"), none.alias("words"), "size")
        root = plans.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("f"), none.alias("pf"), F.lit(0).cast("bigint").alias("words"), "size")
        members = written(_marked(own.drop("place").union(lent).union(root), paths), "members")
        nodes = members.groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"), F.max("pf").alias("pf"), F.max("ps").alias("ps"), (F.max("size") == F.col("depth")).cast("bigint").alias("leaf")
        )
        nodes = written(nodes.withColumn("cost", (F.col("n_convs") - 1) * F.col("words")), "nodes")
        owned = nodes.groupBy("conv_id").agg(F.sum("cost").alias("total"), F.sum("leaf").alias("leaves")).where("total > 0 or leaves > 0")
        below = members.select("conv_id", *KEY).join(owned, "conv_id").groupBy(*KEY).agg(F.sum("total").alias("total"), F.sum("leaves").alias("n_leaves"))
        kids = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pf").alias("f"), F.col("ps").alias("s")).agg(F.count("*").alias("n_children"))
        last = moved("end", "new", "old", "left", F.lit(0).cast("bigint"))["f"]
        ends = plans.select("conv_id", F.col("size").alias("depth"), F.when(F.col("left") > 0, last).otherwise(F.col("new")).alias("f"))
        hashes = _ends(_marked(ends, paths, parents=False), block)
        whole = nodes.join(below, KEY, "left").join(kids, KEY, "left").join(hashes, KEY, "left")
        above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f").alias("pf"), F.col("s").alias("ps"), F.col("conv_id").alias("parent_conv_id"))
        whole = whole.join(above, ["depth", "pf", "ps"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "total", "cost", "ends_sha256")
        along = scan(written(whole, "whole"), "conv_id", [F.col("depth")], "cost", 1, "along")  # what its owner owns down to a node
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
        return written(along.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", zero("n_children").alias("n_children"), zero("n_leaves").alias("n_leaves"),
            (zero("total") - (F.col("h") - F.col("cost"))).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        ), "trie", outlives=True)
