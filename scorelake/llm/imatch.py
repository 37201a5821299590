"""I-Match document fingerprints over randomised lexicon subsets, with DataFrame functions only.

The lexicon is the terms (words) whose document frequency lies within a band of shares of
all documents: at least ``LOW`` and two documents, at most ``HIGH``.  Since documents have D distinct terms on
average, at most D / LOW terms reach the band, whatever the number of documents: the set has
a proven bound and travels as a literal.  Terms are counted in two passes: by ``BUCKETS`` hashes of
terms first, since a term of the band lies in a bucket that reaches it, then those in such buckets
alone, so that rare terms are never shuffled.

A text's distinct lexicon terms are sorted (by MD5) and hashed once over the whole lexicon and
once for each of 128 random subsets of it: 64 of 64 parts, 32 of 512 and 32 of 4096.  A text without a
lexicon term uses all its terms.  The likeness of two fingerprints is the share of equal hashes
among the subsets that either text has a term in, at the finest of the three sizes that has ``ENOUGH`` such
subsets (else the coarsest), where a subset holds about one term; 1 if neither text has any.

The edited text is the text with its last floor(n/4) code points replaced by the first as many
(or all) of the next document by doc_id (after the last: the first).  Next documents are found
on ids alone: range-partitioned, then a window in each range and one over the ranges' ends.
Texts with their fingerprints are shuffled once, by id, and of each the head that the document
before it needs once more.

Null text counts as empty.  Null doc_ids sort first.  Rows with one doc_id are in the order
of a hash of their text; rows alike in doc_id and text are one document with that many result
rows.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, lean, width, written

LOW, HIGH = 1 / 200, 1 / 20
BUCKETS = 1 << 18
HEX = "0123456789abcdef"
#: Hex digits of the whole lexicon's hash and of a subset's; subsets of each size; a subset without a term.
WHOLE, EACH = 16, 3
LEVELS = (64, 32, 32)
NONE = "0" * EACH
ENOUGH = 8


def distinct_terms(text: Column) -> Column:
    """Of a text that is not null; may hold one empty string."""
    return F.array_distinct(F.split(text, SPACE))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH, buckets: int = BUCKETS) -> list[str]:
    """Terms in the band, counted over all documents; a bounded list (see above)."""
    n = docs.count()
    least = max(2.0, low * n)
    terms = docs.select(F.explode(distinct_terms(F.coalesce("text", F.lit("")))).alias("t")).where("t != ''")
    bucket = F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int")
    full = [r[0] for r in terms.groupBy(bucket.alias("b")).count().where(F.col("count") >= least).select("b").collect()]  # numbers below buckets
    if 2 * len(full) < buckets:  # else most terms would stay, and counting all of them gives the same
        listed = ", ".join(map(str, sorted(full))) or "-1"
        terms = terms.withColumn("b", bucket).where(F.expr(f"b in ({listed})"))
    df = terms.groupBy("t").count()
    return sorted(r["t"] for r in df.where((F.col("count") >= least) & (F.col("count") <= high * n)).select("t").collect())


def _hash(part: Column, digits: int = EACH) -> Column:
    return F.when(F.size(part) == 0, "0" * digits).otherwise(F.substring(F.md5(F.array_join(part, "").cast("binary")), 1, digits))


def _parts(terms: Column, at: int, firsts: str, seconds: list[str]) -> Column:
    """Hashes of the terms with each digit of firsts at a place and, after it, a digit of each of seconds."""
    digit = lambda x, k: F.substring(x, k, 1)
    inner = lambda few: F.transform(F.array(*map(F.lit, seconds)), lambda g: _hash(F.filter(few, lambda x: F.contains(g, digit(x, at + 1)))))
    outer = lambda c: F.transform(F.array(F.filter(terms, lambda x: digit(x, at) == c)), inner)
    return F.array_join(F.flatten(F.flatten(F.transform(F.array(*map(F.lit, firsts)), outer))), "")


def _with_fingerprint(df: DataFrame, text: Column, known: list[str], name: str) -> DataFrame:
    """Adds the column ``name``: WHOLE hex digits for the whole lexicon and EACH for each subset."""
    # one SQL text: a literal object for each of thousands of terms would take the driver seconds to make
    listed = ", ".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in known) or "null"
    df = df.withColumn("_t", F.filter(distinct_terms(text), lambda w: w != "")).withColumn("_b", F.expr(f"filter(_t, w -> w in ({listed}))"))
    df = df.withColumn("_m", F.sort_array(F.transform(F.when(F.size("_b") > 0, F.col("_b")).otherwise(F.col("_t")), lambda w: F.md5(w.cast("binary")))))
    df = df.withColumn("_m0", F.filter("_m", lambda x: F.startswith(x, F.lit("0"))))
    prints = F.concat(
        _hash(F.col("_m"), WHOLE), _parts(F.col("_m"), 1, HEX, [HEX[k : k + 4] for k in range(0, 16, 4)]),
        _parts(F.col("_m0"), 2, HEX, [HEX[:8], HEX[8:]]), _parts(F.col("_m0"), 2, HEX[:2], list(HEX)),
    )
    return df.withColumn(name, prints).drop("_t", "_b", "_m", "_m0")


def likeness(a: Column, b: Column) -> Column:
    one = lambda c, i: F.substring(c, i * EACH + (WHOLE + 1), F.lit(EACH))
    out, start = None, 0
    for many in LEVELS:
        at = F.sequence(F.lit(start), F.lit(start + many - 1))
        either = F.size(F.filter(at, lambda i: (one(a, i) != NONE) | (one(b, i) != NONE)))
        equal = F.size(F.filter(at, lambda i: (one(a, i) == one(b, i)) & (one(a, i) != NONE)))
        share = equal / F.greatest(either, F.lit(1))
        out = F.when(either == 0, 1.0).otherwise(share) if out is None else F.when(either >= ENOUGH, share).otherwise(out)
        start += many
    return out


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, fingerprint: of the texts alone."""
    rows = lean(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return _with_fingerprint(rows, F.col("text"), lexicon(rows, low, high), "fingerprint").select("doc_id", "fingerprint")


def previous(ids: DataFrame) -> DataFrame:
    """ids: id0, tk, n and more, distinct.  Adds prev, the struct of these before each in order; the first follows the last."""
    whole = F.struct("id0", "tk", "n")
    order = [F.col("doc_id").asc_nulls_first(), F.col("tk")]
    part = written(ids.repartitionByRange(width(ids.sparkSession), *order).withColumn("part", F.spark_partition_id()), "ranges")
    ends = part.groupBy("part").agg(F.max_by(whole, F.struct(F.col("doc_id").isNotNull(), "doc_id", "tk")).alias("last"))  # a row for each range
    by = Window.orderBy("part")
    all_ends = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(by), F.last("last").over(all_ends)).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order)
    return part.withColumn("prev", F.lag(whole).over(inside)).join(ends, "part").withColumn("prev", F.coalesce("prev", "before")).drop("before", "part")


def _with_next(rows: DataFrame, prints: str | None = None) -> DataFrame:
    """rows: doc_id, text (not null) and more.  Adds n, head (what the next document gives to the edited text), next_id and, of the column ``prints``, next_print."""
    keyed = rows.withColumn("id0", F.coalesce("doc_id", F.lit(0))).withColumn("tk", F.xxhash64("text", F.col("doc_id").isNull()))
    ids = written(keyed.select("doc_id", "id0", "tk", F.char_length("text").alias("n")).distinct(), "ids")
    chain = written(previous(ids).select(F.col("id0").alias("_i"), F.col("tk").alias("_k"), "n", "prev"), "chain")
    placed = keyed.join(chain, (keyed["id0"] == chain["_i"]) & (keyed["tk"] == chain["_k"])).drop("_i", "_k")
    given = F.struct(F.substring("text", F.lit(1), F.floor(F.col("prev.n") / 4).cast("int")).alias("head"), F.col("doc_id").alias("next_id"), (F.col(prints) if prints else F.lit(None)).alias("next_print"))
    heads = placed.select(F.col("prev.id0").alias("_i"), F.col("prev.tk").alias("_k"), given.alias("_g")).groupBy("_i", "_k").agg(F.max("_g").alias("_g"))
    out = placed.join(heads, (placed["id0"] == heads["_i"]) & (placed["tk"] == heads["_k"]))
    return out.select(*rows.columns, "n", "_g.head", "_g.next_id", "_g.next_print")


def _edited_text() -> Column:
    return F.concat(F.substring("text", F.lit(1), (F.col("n") - F.floor(F.col("n") / 4)).cast("int")), "head")


def edited(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text (not null).  Adds n, next_id and edited_text."""
    return _with_next(docs).withColumn("edited_text", _edited_text()).drop("head", "next_print")


def compared(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, next_id."""
    rows = lean(docs, doc_id="bigint", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    known = lexicon(rows, low, high)
    both = _with_next(_with_fingerprint(rows, F.col("text"), known, "fingerprint"), "fingerprint").withColumn("edited_text", _edited_text())
    both = _with_fingerprint(both, F.col("edited_text"), known, "edited_fingerprint")
    return both.select(
        "doc_id", F.col("n").cast("bigint").alias("n_chars"), F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_print")).alias("near_next"), "next_id",
    )
