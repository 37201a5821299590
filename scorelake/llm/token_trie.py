"""Token counts by dynamic programming over a trie of distinct pre-tokens.

The distinct pre-tokens of a chunk of texts go into a trie, level by level: sorted, a word
shares the node of the word before it as far as their common prefix goes.  A node's forward
score (the best sum over segmentations of its prefix) and the token count of that way are
computed once, from its ancestors, and words read the counts stored at their last node.
A text's count is the sum over its pre-tokens.  Pieces, scores and ties are those of
``piece_viterbi``, so a count equals the number of ids that encoding gives.

Null text has null counts; the empty text has one token.  Rows with null or repeated
doc_ids are each counted.  An empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, slices
from .pieces import Pieces, distinct, load, mix, points_of, powers, prefix_hashes, segments, utf8_sizes

#: Words up to each length share a trie; the pad of shorter words costs memory only.
CLASSES = (12, 32, 128)
CELLS = 1 << 20


def _trie_counts(found: list[str], p: Pieces) -> np.ndarray:
    """Token counts of sorted distinct words."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    deep, rows = int(size.max()), len(found)
    points = points_of([w.ljust(deep, "\0") for w in found], deep)
    inside = np.arange(deep) < size[:, None]
    same = (points[1:] == points[:-1]) & inside[1:] & inside[:-1]
    shared = np.concatenate([[0], np.where(same.all(axis=1), deep, (~same).argmax(axis=1))])
    hashes, pw = prefix_hashes(points), powers(p.longest)
    node = np.zeros((deep + 1, rows), np.int32)  # a word's node at each depth
    best, count, out = [np.zeros(1)], [np.zeros(1, np.int64)], np.zeros(rows, np.int64)
    for d in range(1, deep + 1):
        word = np.flatnonzero(size >= d)
        fresh = shared[word] < d
        node[d, word] = np.cumsum(fresh) - 1
        first = word[fresh]  # one word for each node of this depth
        way, many = np.full(len(first), -np.inf), np.zeros(len(first), np.int64)
        for k in p.lengths[(p.lengths <= d)][::-1].tolist():
            at, place = p.find(mix(hashes[first, d] - hashes[first, d - k] * pw[k] + np.uint64(k)))
            before = node[d - k, first[at]]
            here = best[d - k][before] + p.scores[place]
            up = here > way[at]
            way[at[up]], many[at[up]] = here[up], count[d - k][before[up]] + 1
            if k == 1:
                odd = np.ones(len(first), bool)
                odd[at] = False
                odd = np.flatnonzero(odd)
                before = node[d - 1, first[odd]]
                here = best[d - 1][before] + p.unknown
                up = here > way[odd]
                way[odd[up]], many[odd[up]] = here[up], (count[d - 1][before] + utf8_sizes(points[first[odd], d - 1]))[up]
        best.append(way)
        count.append(many)
        ends = np.flatnonzero(size == d)
        out[ends] = many[node[d, ends]]
    return out


def pre_token_counts(found: list[str], p: Pieces, cells: int = CELLS) -> np.ndarray:
    """Token counts of distinct pre-tokens, in their order."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    out = np.zeros(len(found), np.int64)
    kind = np.searchsorted(CLASSES, size)
    for c in range(len(CLASSES) + 1):
        pick = np.flatnonzero(kind == c).tolist()
        pick.sort(key=found.__getitem__)
        while pick:
            # as many as fit; words of the last class are of any length and may go alone
            most = max(1, cells // (CLASSES[c] if c < len(CLASSES) else max(len(found[i]) for i in pick[:64])))
            now, pick = pick[: min(most, 64) if c == len(CLASSES) else most], pick[min(most, 64) if c == len(CLASSES) else most :]
            out[now] = _trie_counts([found[i] for i in now], p)
    return out


def count_texts(texts: list[str | None], p: Pieces, cells: int = CELLS) -> tuple[list, list]:
    """Pre-tokens and tokens of each text."""
    cut = [segments(t) if t is not None else [] for t in texts]
    codes, found = distinct(cut)
    per = pre_token_counts(found, p, cells)
    doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    total = np.bincount(doc, per[codes], len(cut)) if len(codes) else np.zeros(len(cut))
    return [None if t is None else len(x) for x, t in zip(cut, texts)], [None if t is None else int(n) for n, t in zip(total, texts)]


def token_counts(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces or load())  # as large as the vocabulary

    def run(batches):
        for b in slices(batches, "text"):
            words, tokens = count_texts(b.column("text").to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_pretokens", "n_tokens"])

    return lean(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, n_pretokens bigint, n_tokens bigint")
