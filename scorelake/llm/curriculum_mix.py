"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Sources in order of their code points, null last, weigh 5, 2, 1, repeating, and share all
words; a target stops at ``MOST`` times its source's size, and what it leaves is shared
again by weight.  That is water filling: target = min(cap, level * weight) with one level.

A source gives its documents in the order of a hash of doc_id, again and again until training
ends.  Its rate over training time t in [0, 1] is target * (1 + tilt * (2t - 1)), whose integral is the
cumulative demand target * ((1 - tilt) * t + tilt * t^2); a document's position in each pass is the time
at which that demand reaches the words given before it, the root of a quadratic.  What it gives from
there is the demand between its position and the end of training, its own size at most.

Word counts before a document come from two levels: totals by hash bucket of a source, at
most ``BUCKETS`` rows a source, and a running sum inside a bucket, so that no source, however
large, is ever summed in one task.  Sources, of which there may be very many, are ranked and
filled by range-partitioned running sums.

Rows without doc_id go by a hash of their text instead, so that they spread over buckets as others do.

Null text has size 0.  A document of size 0 has its position in the first pass, if the demand
reaches it, and gives no words.  Rows with null or repeated doc_ids are rows of their own; those equal in
doc_id (without one: in text) share a bucket.
Sources of size 0 get target 0, and their documents position 0.  An empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, lean, running, width, written

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKETS = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """sources: source, source_size.  Adds rank, weight and target; one row a source."""
    ranked = running(sources, [F.col("source").isNull(), F.col("source")], "by-name").withColumnRenamed("place", "rank")
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    need = F.col("cap") / F.col("weight")
    filled = written(running(ranked, [need, F.col("rank")], "by-need", capped=F.col("cap"), passed=F.col("weight")), "sources")
    # the level if all sources of lesser need are full; the first that it does not fill sets it
    whole = filled.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(whole[0] or 0) - F.col("capped")) / (F.lit(whole[1] or 0.0) - F.col("passed"))
    tried = filled.withColumn("level", level).where(F.col("level") * F.col("weight") <= F.col("cap"))
    first = tried.agg(F.min(F.struct(need, "rank", "level"))["level"]).first()[0]
    goal = F.col("cap") if first is None else F.least("cap", F.lit(first) * F.col("weight"))
    return filled.select(*sources.columns, "rank", "weight", goal.alias("target"))


def order_hash() -> Column:
    """What documents of a source are ordered by: a hash of doc_id, without one of the text."""
    return F.when(F.col("doc_id").isNotNull(), F.md5(F.col("doc_id").cast("string"))).otherwise(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def _ordered(docs: DataFrame) -> DataFrame:
    """Adds to each row: before (words of its source ahead of it), source_size, target, rank; takes h."""
    named = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    rows = docs.withColumn("s", named).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int") % BUCKETS)
    sums = written(rows.groupBy("s", "bucket").agg(F.sum("size").alias("n"), F.first("source", True).alias("source")), "sums")
    goal = targets(sums.groupBy("s").agg(F.first("source", True).alias("source"), F.sum("n").alias("source_size")))
    ahead = Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = written(
        sums.select("s", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base")).join(goal.drop("source"), "s"), "bases"
    )
    inside = Window.partitionBy("s", "bucket").orderBy("h", "size", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(base, ["s", "bucket"])
        .withColumn("before", F.col("base") + F.col("within"))
        .drop("base", "within", "s", "bucket", "h")
    )


def schedule(docs: DataFrame) -> DataFrame:
    """docs: doc_id, source, size, h (``order_hash``) and more.  A row for each document: those columns but h, and
    source_size, target, taken (words, repeats counted), passes (array of (words, position), one for each time it is given)."""
    rows = _ordered(docs)
    goal, target = F.round("target").cast("bigint"), F.col("target")
    tilt = F.element_at(F.array(F.lit(-0.5), F.lit(0.0), F.lit(0.5)), (F.col("rank") % 3 + 1).cast("int"))

    def position(k: Column) -> Column:
        """The time at which the demand reaches the words given before the document's k-th pass; over 1: never."""
        reach = (k * F.col("source_size") + F.col("before")) / target
        root = F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * reach)
        inverse = F.when(tilt == 0, reach).otherwise((root - (1 - tilt)) / (2 * tilt))
        return F.when(target == 0, 0.0).when(reach <= 1, inverse)

    def words(at: Column) -> Column:
        demand = F.round(target * ((1 - tilt) * at + tilt * at * at)).cast("bigint")  # whole words were given before
        return F.greatest(F.lit(0), F.least(F.col("size"), goal - demand)).cast("bigint")

    times = F.transform(F.sequence(F.lit(0), F.lit(MOST - 1)), lambda k: F.struct(k.alias("k"), position(k).alias("position")))
    times = F.filter(times, lambda p: p["position"].isNotNull())
    given = F.transform(times, lambda p: F.struct(words(p["position"]).alias("words"), p["position"].alias("position"), p["k"].alias("k")))
    given = F.filter(given, lambda p: (p["words"] > 0) | ((F.col("size") == 0) & (p["k"] == 0)))
    out = rows.withColumn("passes", F.transform(given, lambda p: F.struct(p["words"].alias("words"), p["position"].alias("position"))))
    return out.withColumn("taken", F.aggregate("passes", F.lit(0).cast("bigint"), lambda a, p: a + p["words"])).drop("before", "rank", "weight")


def _range_sorted(df: DataFrame, *order: Column) -> DataFrame:
    return df.repartitionByRange(width(df.sparkSession), *order).sortWithinPartitions(*order)


def mix(docs: DataFrame) -> DataFrame:
    """One row per document, range-sorted by first position: doc_id, size, source_size, target, taken, n_passes, first_position (null if never given)."""
    sized = lean(docs, doc_id="bigint", source="string", text="string").select("doc_id", "source", size_of(F.col("text")).alias("size"), order_hash().alias("h"))
    own = schedule(sized).select("doc_id", "size", "source_size", "target", "taken", F.size("passes").cast("bigint").alias("n_passes"), F.get("passes", F.lit(0))["position"].alias("first_position"))
    return _range_sorted(own, F.col("first_position").asc_nulls_last(), F.col("doc_id"))


def training_order(docs: DataFrame) -> DataFrame:
    """The documents in training order, with all their columns: a row for each time that one
    is given at least half, range-sorted by position."""
    extra = [c for c in docs.columns if c not in ("doc_id", "source")]
    sized = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), order_hash().alias("h"), F.struct(*extra).alias("rest"))
    given = schedule(sized).select("doc_id", "source", "rest", "size", F.explode("passes").alias("p")).where(F.col("p.words") * 2 >= F.col("size"))
    ranged = _range_sorted(given, F.col("p.position"), F.col("doc_id"))
    return ranged.select(*[F.col(c) if c in ("doc_id", "source") else F.col(f"rest.{c}").alias(c) for c in docs.columns])
