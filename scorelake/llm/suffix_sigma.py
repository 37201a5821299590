"""Collocations by suffix-sigma: sorted suffixes, whose prefixes one stack counts.

1. Every word of a piece starts a suffix of at most ``most`` words.  A task counts equal suffixes
   of a part of its texts (about ``CHUNK`` characters) in numpy, so that copies, and what a hot word or passage repeats, become one row.
2. Suffixes, each led by its language, are dealt and sorted by ranges of language, first word and
   what follows; a hot first word spreads over several tasks.
3. A stack holds the prefixes of the suffix at hand, a level for each number of words.  A prefix that the next suffix does not share is
   popped with its count, which its parent takes over.  Prefixes of a task's first and last suffix may go on in
   the tasks beside it: their parts are summed afterwards, and all others are whole.
4. Phrases of ``least`` occurrences or more are kept (parts of such phrases have as many), and joined with the
   counts of their parts.

A suffix is a text: the language (its blanks and backslashes escaped), a tab, and each word with a space after it; all words of
a language together are written as one empty word.
Null text has no words, null lang counts as ``und``.  doc_id is not read; repeated rows count again.  An
empty table gives no rows.  Extra columns are ignored.  Counts and products are exact (products as decimals of 38
digits: for counts below 10**15; larger ones raise an error).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, scratch, slices, width, written

MOST = 3
LEAST = 10
TOP = 2000
SHARE = 50
CHUNK = 1 << 22

_LINE, _BLANK = 10, 32
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = _LINE
_MAP[9] = _BLANK


def escaped(lang: str | None) -> str:
    return "und" if lang is None else lang.replace("\\", "\\\\").replace("\t", "\\t").replace(" ", "\\s")


def _plain(lang: Column) -> Column:
    back = F.replace(lang, F.lit("\\\\"), F.lit("\\\n"))
    for mark, c in (("\\t", "\t"), ("\\s", " "), ("\\\n", "\\")):
        back = F.replace(back, F.lit(mark), F.lit(c))
    return back


def words_of(texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in byte order, each with a space after it; the number of every word in order; and the piece that it is in."""
    raw = _MAP[np.frombuffer("\n".join(["", *texts, ""]).encode(), np.uint8)]
    inside = (raw != _LINE) & (raw != _BLANK)
    starts = np.flatnonzero(~inside[:-1] & inside[1:]) + 1
    ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    piece = np.searchsorted(np.flatnonzero(raw == _LINE), starts)
    keep = inside.copy()
    keep[ends] = True  # the first separator after a word stays
    kept = raw[keep]
    kept[np.cumsum(ends - starts + 1) - 1] = _BLANK
    offsets = np.concatenate([[0], np.cumsum(ends - starts + 1)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    order = pc.sort_indices(found.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return found.dictionary.take(pa.array(order)), rank[found.indices.to_numpy()], piece


def suffix_counts(texts: list[str], most: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct suffixes of at most ``most`` words, and how often each is there."""
    names, word, piece = words_of(texts)
    n, wide = len(word), len(names) + 1
    if not n:
        return pa.array([], pa.large_string()), np.zeros(0, np.int64)
    columns, code = [word], word.copy()
    for k in range(1, most):
        after = np.full(n, -1)
        if n > k:
            same = piece[k:] == piece[:-k]
            after[:-k][same] = word[k:][same]
        columns.append(after)
        _, code = np.unique(code, return_inverse=True)
        code = code * wide + after + 1
    _, first, many = np.unique(code, return_index=True, return_counts=True)
    names = pa.concat_arrays([names, pa.array([""], pa.large_string())])
    parts = [names.take(pa.array(np.where(c[first] < 0, wide - 1, c[first]))) for c in columns]
    return pc.binary_join_element_wise(*parts, pa.scalar("", pa.large_string())), many


def _suffixes(docs: DataFrame, most: int, chunk: int) -> DataFrame:
    def run(batches):
        for b in slices(batches, "text", chunk):
            langs, texts = b.column("lang").to_pylist(), b.column("text").to_pylist()
            by: dict[str, list[str]] = {}
            for lang, t in zip(langs, texts):
                if t:
                    by.setdefault(escaped(lang), []).append(t)
            for lang, own in by.items():
                k, c = suffix_counts(own, most)
                if len(c):
                    k = pc.binary_join_element_wise(pa.scalar(lang, pa.large_string()), k, pa.scalar("\t", pa.large_string()))
                    k, c = pa.concat_arrays([k, pa.array([f"{lang}\t "], pa.large_string())]), np.append(c, c.sum())
                    for s in range(0, len(c), 1 << 16):
                        yield pa.RecordBatch.from_arrays([k[s : s + (1 << 16)].cast(pa.string()), pa.array(c[s : s + (1 << 16)])], ["k", "c"])

    return lean(docs, lang="string", text="string").mapInArrow(run, "k string, c bigint")


class Stack:
    """Counts the prefixes of sorted suffixes: a level for each number of words, which holds the prefix at hand and its count.

    A batch is worked level by level in numpy: where the prefix of a level changes, those before are popped.
    """

    def __init__(self, most: int, least: int) -> None:
        self.least = least
        self.last: list[str] | None = None  # words of the suffix at hand
        self.counts = [0] * most
        self.fresh = [True] * most  # whether the prefix at hand is the task's first of its level

    def add(self, keys: pa.Array, c: np.ndarray) -> list[tuple[str, int, bool]]:
        """The prefixes that are done, with their counts, and whether a task before may have more of them."""
        parts = pc.split_pattern(keys, " ")
        at = parts.offsets.to_numpy()[:-1]
        size = parts.value_lengths().to_numpy() - 1  # nothing follows the last space
        words, out = parts.values, []
        changed = np.zeros(len(c), bool)
        for level in range(len(self.counts)):
            own = words.take(pa.array(at + np.minimum(level, size)))
            changed[1:] |= pc.not_equal(own[1:], own[:-1]).to_numpy(zero_copy_only=False)
            changed[0] |= self.last is None or self.last[level] != own[0].as_py()
            starts = np.flatnonzero(changed)
            if changed[0] and self.last is not None:
                out += self._pop(self.last, level, False)
            sums = np.add.reduceat(c, np.concatenate([[0], starts[starts > 0]]))
            heads = np.concatenate([[0], starts[starts > 0]])
            carried = 0 if changed[0] else self.counts[level]
            sums[0] += carried
            done = (size[heads[:-1]] > level) & (sums[:-1] >= self.least)
            if self.fresh[level] and len(heads) > 1:
                done[0] = size[heads[0]] > level
            out += [(self._key(keys[int(heads[i])].as_py().split(" "), level), int(sums[i]), i == 0 and self.fresh[level]) for i in np.flatnonzero(done).tolist()]
            self.counts[level] = int(sums[-1])
            self.fresh[level] &= len(heads) == 1
        end = keys[len(c) - 1].as_py().split(" ")
        self.last = [end[min(level, len(end) - 1)] for level in range(len(self.counts))]
        return out

    @staticmethod
    def _key(words: list[str], level: int) -> str:
        return "".join(w + " " for w in words[: level + 1])

    def _pop(self, words: list[str], level: int, edge: bool) -> list[tuple[str, int, bool]]:
        edge, count = edge or self.fresh[level], self.counts[level]
        self.fresh[level] = False
        return [(self._key(words, level), count, edge)] if words[level] and (edge or count >= self.least) else []

    def close(self) -> list[tuple[str, int, bool]]:
        """What is still open, which tasks after this one may have more of."""
        return [x for level in range(len(self.counts)) for x in self._pop(self.last, level, True)] if self.last else []


def _prefixes(batches, most: int, least: int):
    stack = Stack(most, least)

    def rows(found):
        if found:
            k, c, edge = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.string()), pa.array(c, pa.int64()), pa.array(edge, pa.bool_())], ["k", "f", "edge"])

    for b in batches:
        if len(b):
            yield from rows(stack.add(b.column("k"), b.column("c").to_numpy()))
    yield from rows(stack.close())


def phrase_counts(docs: DataFrame, most: int = MOST, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """k, f: every phrase of at most ``most`` words and ``least`` occurrences, as suffixes are written."""
    spark = docs.sparkSession
    with scratch(spark):
        rows = written(_suffixes(docs, most, chunk), "suffixes", compression="zstd")
        # from the last to the first, so that longer suffixes come before their prefixes
        dealt = rows.repartitionByRange(width(spark), F.desc("k")).sortWithinPartitions(F.desc("k"))
        found = written(dealt.mapInArrow(lambda b: _prefixes(b, most, least), "k string, f bigint, edge boolean"), "prefixes", outlives=True)
    at_edges = found.where("edge").groupBy("k").agg(F.sum("f").alias("f"))
    return found.where("not edge").select("k", "f").union(at_edges.where(F.col("f") >= least))


def collocations(docs: DataFrame, most: int = MOST, least: int = LEAST, top: int = TOP, share: int = SHARE, chunk: int = CHUNK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` phrases of each language by score."""
    with scratch(docs.sparkSession):
        counts = written(phrase_counts(docs, most, least, chunk), "counts")
        split = counts.withColumns({"lang": F.split_part("k", F.lit("\t"), F.lit(1)), "words": F.split(F.regexp_replace(F.split_part("k", F.lit("\t"), F.lit(2)), " $", ""), " ")})
        whole = F.endswith("k", F.lit("\t "))
        totals = split.where(whole).select("lang", F.col("f").alias("n"))
        phrases = split.where(~whole)
        made = lambda words: F.concat("lang", F.lit("\t"), F.array_join(words, " "), F.lit(" "))
        size = F.size("words")
        cand = phrases.where(size > 1).withColumnRenamed("f", "a")
        cuts = cand.withColumn("cut", F.explode(F.sequence(F.lit(1), size - 1)))
        cuts = cuts.select("k", "lang", "words", "a", "cut", made(F.slice("words", F.lit(1), F.col("cut"))).alias("left"), made(F.slice("words", F.col("cut") + 1, size)).alias("right"))
        side = lambda name, f: counts.select(F.col("k").alias(name), F.col("f").alias(f))
        cuts = cuts.join(side("left", "l"), "left").join(side("right", "r"), "right")
        score = F.expr("1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
        scored = cuts.withColumn("score", score).groupBy("k", "lang", "words", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
        spans = F.flatten(F.transform(F.sequence(F.lit(2), size - 1), lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: made(F.slice("words", i, n)))))
        inner = cand.where(size > 2).select(F.explode(spans).alias("k"), F.col("a").alias("longer")).groupBy("k").agg(F.max("longer").alias("longer"))
        kept = scored.join(inner, "k", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
        shown = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "best.l", "best.r", "best.score")
        order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
        ranked = shown.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(F.broadcast(totals), "lang")  # a row a language
        out = ranked.select(_plain(F.col("lang")).alias("lang"), F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
        return written(out, "collocations", outlives=True)
