"""Substring removal by Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A word goes if it lies in a window of ``WINDOW`` words whose word sequence also starts in a
document of smaller doc_id; windows are judged on the input.

1. Every window has an anchor, the least Rabin-Karp hash of the ``ANCHOR``-word grams inside
   it.  Equal windows have equal anchors, and a run of windows shares one, so counting
   anchors (once a document) takes a fraction of the rows that counting windows would.
   A window whose anchor occurs in one document occurs in one document.
2. Windows with an anchor of two or more documents give (hash, check, doc_id); Spark takes the
   least doc_id of each (hash, check), and a document gets back the hashes that a smaller one has.
3. Documents recompute their windows; those with a returned hash merge into maximal
   intervals, whose words are removed.

Counts and minima are pre-aggregated before their shuffles; the joins back are plain
shuffled joins which adaptive execution may split.  A window is known by 95 bits: a hash
modulo 2**64 and a check modulo the prime 2**31 - 1 (which strings made to collide modulo a
power of two do not share), as words are.  Bytes are hashed in blocks of ``CHUNK``, cut between words.

Null text has no words.  A row with a null doc_id is kept whole and removes nothing
elsewhere.  Rows that share a doc_id do not remove each other.  Shorter texts than a window
are kept.  An empty table gives no rows.  Extra columns, of any name, are ignored.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, free, lean, scratch, written

WINDOW = 13
ANCHOR = 5
CHUNK = 1 << 18

_SPACE = re.compile(SPACE)
_BASE, _WORD = (0x9E3779B97F4A7C15 | 1), (0xD6E8FEB86659FD93 | 1)
_PRIME, _BASE31, _WORD31 = (1 << 31) - 1, 1_103_515_245, 1_812_433_253
_KEY = np.dtype([("h", np.int64), ("c", np.int32)])
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _made_powers(base: int, n: int, prime: int) -> np.ndarray:
    if not prime:
        out = np.full(n + 1, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)
    out = np.ones(1, np.int64)
    while len(out) <= n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[: n + 1]


@functools.lru_cache(8)
def _short_powers(base: int, prime: int) -> np.ndarray:
    return _made_powers(base, CHUNK, prime)


def _powers(base: int, n: int, prime: int = 0) -> np.ndarray:
    """base**0 .. base**n modulo 2**64 or a prime; those of a chunk are kept, longer ones are not."""
    return _short_powers(base, prime)[: n + 1] if n <= CHUNK else _made_powers(base, n, prime)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _ranges(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash of values[s:e] for each range, alike wherever the range lies."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values.astype(np.uint64, copy=False) * _powers(base, n)[:n], out=sums[1:])
    back = _powers(pow(base, -1, 1 << 64), n)
    return _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def _checks(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """The same modulo the prime, for values below it."""
    n = len(values)
    sums = np.zeros(n + 1, np.int64)
    np.cumsum(values.astype(np.int64, copy=False) * _powers(base, n, _PRIME)[:n] % _PRIME, out=sums[1:])
    return (sums[ends] - sums[starts]) % _PRIME * _powers(pow(base, -1, _PRIME), n, _PRIME)[starts] % _PRIME


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and check of every word of all texts in order, and the number of the text that it is in."""
    raw = [(t or "").encode() for t in texts]
    b = np.frombuffer(b"\n".join([b"", *raw, b""]), np.uint8)
    blank = _BLANK[b]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
    firsts = np.cumsum([1, *(len(r) + 1 for r in raw)])
    h, c = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.int64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
        at = starts[i]
        v, s, e = b[at : ends[j - 1]] + np.uint16(1), starts[i:j] - at, ends[i:j] - at
        c[i:j] = _checks(v, s, e, _BASE31)
        h[i:j] = _mix(_ranges(v, s, e, _BASE) ^ (c[i:j].astype(np.uint64) << np.uint64(33)))
        i = j
    return h, c, np.searchsorted(firsts, starts, "right") - 1


def windows(doc: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows that lie in one document."""
    if len(doc) < size:
        return np.zeros(0, np.int64)
    return np.flatnonzero(doc[: len(doc) - size + 1] == doc[size - 1 :])


def anchors(h: np.ndarray, doc: np.ndarray, starts: np.ndarray, size: int, gram: int) -> np.ndarray:
    """The anchor of each window: the least hash of the grams in it."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    at = np.arange(len(h) - gram + 1)
    g = _ranges(h, at, at + gram, _WORD)
    least, reach = g, 1
    while reach < size - gram + 1:  # doubling: least over reach grams, then over more
        step = min(reach, size - gram + 1 - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least[starts]


def _chunks(batches, columns: list[str]):
    """Parts of batches with about CHUNK characters, or one longer text."""
    for b in batches:
        sizes = b["text"].str.len().fillna(0).to_numpy(np.int64)
        part = (np.cumsum(sizes) - sizes) // CHUNK
        for _, piece in b.groupby(part, sort=True):
            yield [piece[c].tolist() for c in columns]


def _pairs(doc: np.ndarray, value: np.ndarray, ids: list, check: np.ndarray | None = None) -> pd.DataFrame:
    """Distinct (doc_id, value), with a check of the value."""
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    more = {} if check is None else {"c": check[order][new].astype(np.int32)}
    return pd.DataFrame({"doc_id": np.array(ids, np.int64)[doc[new]], "h": value[new].view(np.int64)} | more)


def _anchor_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    def run(batches):
        for ids, texts in _chunks(batches, ["doc_id", "text"]):
            h, _, doc = word_hashes(texts)
            s = windows(doc, size)
            yield _pairs(doc[s], anchors(h, doc, s, size, gram), ids)

    return docs.mapInPandas(run, "doc_id bigint, h bigint")


def _window_rows(docs: DataFrame, size: int, gram: int) -> DataFrame:
    """docs: doc_id, text, found (anchors of two or more documents)."""

    def run(batches):
        for ids, texts, found in _chunks(batches, ["doc_id", "text", "found"]):
            h, c, doc = word_hashes(texts)
            s = windows(doc, size)
            s = s[np.isin(anchors(h, doc, s, size, gram), np.concatenate(found).view(np.uint64))]
            yield _pairs(doc[s], _ranges(h, s, s + size, _WORD), ids, _checks(c, s, s + size, _WORD31))

    return docs.mapInPandas(run, "doc_id bigint, h bigint, c int")


def _listed(keys: list[dict] | np.ndarray | None) -> np.ndarray:
    """Hashes and checks of windows, in order of both."""
    return np.sort(np.array([(x["h"], x["c"]) for x in keys], _KEY))


def _cut(texts: list, gone: list, size: int):
    """For each text: words, removed words, kept text.  gone: hashes and checks of its windows that go."""
    h, c, doc = word_hashes(texts)
    s = windows(doc, size)
    w = np.empty(len(s), _KEY)
    w["h"], w["c"] = _ranges(h, s, s + size, _WORD).view(np.int64), _checks(c, s, s + size, _WORD31)
    out = np.zeros(len(h) + 1, np.int64)
    have = [(k, _listed(g)) for k, g in enumerate(gone) if g is not None and len(g)]
    if have:
        first, last = np.searchsorted(doc[s], [k for k, _ in have]), np.searchsorted(doc[s], [k for k, _ in have], "right")
        for (_, g), a, b in zip(have, first, last):
            hit = np.isin(w["h"][a:b], g["h"])
            hit[hit] = g[np.minimum(np.searchsorted(g, w[a:b][hit]), len(g) - 1)] == w[a:b][hit]
            np.add.at(out, s[a:b][hit], 1)
            np.add.at(out, s[a:b][hit] + size, -1)
    covered = np.cumsum(out[:-1]) > 0  # overlapping and touching windows have merged
    total = np.bincount(doc, minlength=len(texts))
    removed = np.bincount(doc[covered], minlength=len(texts))
    ends = np.cumsum(total)
    for k, t in enumerate(texts):
        ws = [x for x in _SPACE.split(t or "") if x]
        if removed[k]:
            ws = [x for x, c in zip(ws, covered[ends[k] - total[k] : ends[k]].tolist()) if not c]
        yield int(total[k]), int(removed[k]), " ".join(ws)


def remove_repeats(docs: DataFrame, size: int = WINDOW, gram: int = ANCHOR, name: str = "cut") -> DataFrame:
    """The rows and columns of docs, and last a struct: n_words, n_removed, kept (the words left, joined by one space).

    The struct is called ``name``, or by ``common.free`` if docs has such a column.
    """
    named = lean(docs, doc_id="bigint", text="string").where("doc_id is not null")
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            grams = _anchor_rows(named, size, gram)
            shared = written(grams.groupBy("h").count().where("count > 1").select("h"), "anchors")
            flagged = written(grams.join(shared, "h").groupBy("doc_id").agg(F.collect_set("h").alias("found")), "flagged")
            seen = written(_window_rows(named.join(flagged, "doc_id"), size, gram), "windows", outlives=True)
        # a row for each document and window: counted, a window of several rows may be one of several documents
        first = seen.groupBy("h", "c").agg(F.min("doc_id").alias("first"), F.count("*").cast("int").alias("n")).where("n > 1")
        first = written(first.select("h", "c", "first"), "firsts")
        again = seen.join(first, ["h", "c"]).where("doc_id > first")
        gone = written(again.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("h", "c")).alias("_gone")), "gone", outlives=True)

    @F.pandas_udf("n_words bigint, n_removed bigint, kept string")
    def cut(text: pd.Series, keys: pd.Series) -> pd.DataFrame:
        got = [x for t, g in _chunks([pd.DataFrame({"text": text, "gone": keys})], ["text", "gone"]) for x in _cut(t, g, size)]
        return pd.DataFrame(got, columns=["n_words", "n_removed", "kept"])

    cut = cut.asNondeterministic()  # else a filter on what it returns would run it a second time
    joined = docs.join(gone, docs["doc_id"].cast("bigint") == gone["_id"], "left")
    return joined.select(*[docs[c] for c in docs.columns], cut(docs["text"].cast("string"), gone["_gone"]).alias(free(docs, name)))
