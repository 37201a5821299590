"""Language identification by unigram pieces, marginalised over segmentations.

The pieces are those of a fixed public vocabulary.  A language's model is a probability for each piece (and for
each byte, which a character that is no piece falls back to).  It is learned in one expectation
step: under a common start, where a piece's probability falls with its rank in the vocabulary, a backward and
a forward pass over each distinct word give the expected number of times that each piece is used, over
all its segmentations; these are summed for each language over all texts that may be learned from, in whole numbers, so
that no order of rows changes the sums.  The common start smooths each language by ``PRIOR`` pieces.

A text's score in a language is the product, over its words, of the sum over all segmentations of a word of the product
of its pieces' probabilities, by the forward algorithm in logarithms, times the language's share of documents.
The language of the largest score is predicted (of equals the first by name); ``score`` is its part of the sum of all.

Texts are worked whole, about ``CHUNK`` bytes at a time; words are cut where no piece crosses, and a task works a distinct word
once as long as it remembers it (``WORDS`` of them, then it starts anew), equal lengths together.  Null texts and texts without a letter are ``und`` with score 0, as are
all if there is nothing to learn from.  A null doc_id is not held out and not learned from.
Repeated rows count and are predicted each.  An empty table gives no rows.  Extra columns are ignored.  A model has a number
for each language and piece; more than ``LANGUAGES`` languages are refused.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, slices
from .pieces import MARK, Pieces, load, mix, points_of, powers, prefix_hashes, segments

CHUNK = 1 << 22
CELLS = 1 << 18
WORDS = 300_000
PRIOR = 1000.0
LANGUAGES = 1000
UNIT = 1 << 16
FOLDS, HELD = 4, 2


@dataclass
class Model:
    languages: list[str]
    share: np.ndarray  # by language: log of its share of documents
    logs: np.ndarray  # (pieces in the order of their keys, then 256 bytes; language)


def start(p: Pieces) -> np.ndarray:
    """Log probabilities of the common start: pieces fall with their rank by score, bytes share the place of the last."""
    rank = np.empty(len(p.scores), np.int64)
    rank[np.argsort(-p.scores, kind="stable")] = np.arange(len(rank))
    w = np.concatenate([1.0 / (rank + 10.0), np.full(256, 1.0 / (len(rank) + 10.0))])
    return np.log(w / w.sum())


def _bytes_of(points: np.ndarray) -> list[list[int]]:
    return [list(chr(0x2581 if c == MARK else c).encode("utf-8", "surrogatepass")) for c in points.tolist()]


class Lattice:
    """All pieces in words of one length: for each end and length, the rows and the pieces' numbers."""

    def __init__(self, points: np.ndarray, p: Pieces) -> None:
        self.rows, self.n = points.shape
        hashes, pw = prefix_hashes(points), powers(p.longest)
        self.hits: list[list[tuple[int, np.ndarray, np.ndarray]]] = [[] for _ in range(self.n + 1)]
        single = np.zeros((self.rows, self.n), bool)
        for k in p.lengths[p.lengths <= self.n].tolist():
            ends = self.n - k + 1
            at, place = p.find(mix(hashes[:, k:] - hashes[:, :ends] * pw[k] + np.uint64(k)).T.ravel())
            e, row = at // self.rows, at % self.rows
            if k == 1:
                single[row, e] = True
            cuts = np.searchsorted(e, np.arange(ends + 1))
            for x in np.flatnonzero(np.diff(cuts)).tolist():
                self.hits[x + k].append((k, row[cuts[x] : cuts[x + 1]], place[cuts[x] : cuts[x + 1]]))
        row, at = np.nonzero(~single)
        self.odd: list[list[tuple[int, list[int]]]] = [[] for _ in range(self.n + 1)]
        for r, x, b in zip(row.tolist(), at.tolist(), _bytes_of(points[row, at])):
            self.odd[x + 1].append((r, [len(p.keys) + v for v in b]))

    def forward(self, logs: np.ndarray) -> np.ndarray:
        """logs: (pieces, models).  (n + 1, rows, models): the log of the summed ways to each place."""
        out = np.full((self.n + 1, self.rows, logs.shape[1]), -np.inf)
        out[0] = 0
        for e in range(1, self.n + 1):
            for k, row, place in self.hits[e]:
                out[e, row] = np.logaddexp(out[e, row], out[e - k, row] + logs[place])
            for r, ids in self.odd[e]:
                out[e, r] = np.logaddexp(out[e, r], out[e - 1, r] + logs[ids].sum(axis=0))
        return out

    def expected(self, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, piece, expected uses) under one model, for words whose ways all end at their last place."""
        ahead = self.forward(logs[:, None])[:, :, 0]
        back = np.full((self.n + 1, self.rows), -np.inf)
        back[self.n] = 0
        rows, pieces, uses = [], [], []
        for e in range(self.n, 0, -1):
            for k, row, place in self.hits[e]:
                way = back[e, row] + logs[place]
                back[e - k, row] = np.logaddexp(back[e - k, row], way)
                rows.append(row)
                pieces.append(place)
                uses.append(way + ahead[e - k, row])
            for r, ids in self.odd[e]:
                way = back[e, r] + logs[ids].sum()
                back[e - 1, r] = np.logaddexp(back[e - 1, r], way)
                rows.append(np.full(len(ids), r))
                pieces.append(np.array(ids))
                uses.append(np.full(len(ids), way + ahead[e - 1, r]))
        rows, pieces, uses = map(np.concatenate, (rows, pieces, uses))
        return rows, pieces, np.exp(uses - ahead[self.n][rows])


def _by_length(found: list[str], p: Pieces):
    """Numbers of words of one length, and their lattice."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for s, e in zip(cuts, cuts[1:]):
        n = int(size[order[s]])
        most = max(1, CELLS // n)
        for at in range(s, e, most):
            pick = order[at : min(e, at + most)]
            yield pick, Lattice(points_of([found[i] for i in pick], n), p)


def word_scores(found: list[str], logs: np.ndarray, p: Pieces) -> np.ndarray:
    """(words, models): the log of each word's probability, all segmentations summed."""
    out = np.zeros((len(found), logs.shape[1]))
    for pick, lattice in _by_length(found, p):
        out[pick] = lattice.forward(logs)[-1]
    return out


def numbered(cut: list[list[str]], index: dict[str, int]) -> np.ndarray:
    """Numbers of all words in order; new words are added to the index."""
    return np.fromiter((index.setdefault(s, len(index)) for x in cut for s in x), np.int64, sum(map(len, cut)))


class Scores:
    """Scores of words, kept from chunk to chunk."""

    def __init__(self, logs: np.ndarray, p: Pieces) -> None:
        self.logs, self.p, self.index, self.known = logs, p, {}, np.zeros((0, logs.shape[1]))

    def of(self, cut: list[list[str]]) -> np.ndarray:
        """(words in order, models)."""
        if len(self.index) > WORDS:
            self.index, self.known = {}, self.known[:0]
        codes = numbered(cut, self.index)
        fresh = list(islice(self.index, len(self.known), None))
        if fresh:
            self.known = np.concatenate([self.known, word_scores(fresh, self.logs, self.p)])
        return self.known[codes]


def piece_uses(found: list[str], weights: np.ndarray, logs: np.ndarray, p: Pieces) -> np.ndarray:
    """weights: (words, models), how often each word is there.  (pieces, models): the expected uses."""
    out = np.zeros((len(logs), weights.shape[1]))
    for pick, lattice in _by_length(found, p):
        row, piece, uses = lattice.expected(logs)
        for m in range(weights.shape[1]):
            out[:, m] += np.bincount(piece, uses * weights[pick[row], m], len(logs))
    return out


def _held(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == HELD, F.lit(False))


def learn(docs: DataFrame, pieces: Pieces | None = None, chunk: int = CHUNK) -> Model:
    """From text and lang of the documents that are not held out: all of them, whole."""
    pieces = pieces or load()
    sent = docs.sparkSession.sparkContext.broadcast((pieces, start(pieces)))  # as large as the vocabulary
    rows = lean(docs, doc_id="bigint", text="string", lang="string").where("doc_id is not null and lang is not null").where(~_held(F.col("doc_id")))

    def run(batches):
        p, logs = sent.value
        names: dict[str, int] = {}
        index: dict[str, int] = {}
        total, many, weights = np.zeros((len(logs), 0)), np.zeros(0, np.int64), np.zeros((0, 0), np.int64)

        def settle():
            if index:
                total[:] += np.rint(piece_uses(list(index), weights, logs, p) * UNIT)
                index.clear()
            return np.zeros((0, len(names)), np.int64)

        for b in slices(batches, "text", chunk):
            langs = np.array([names.setdefault(x, len(names)) for x in b.column("lang").to_pylist()], np.int64)
            if len(names) > LANGUAGES:
                raise ValueError(f"more than {LANGUAGES} languages")
            if len(names) > total.shape[1]:
                more = len(names) - total.shape[1]
                total, many, weights = np.pad(total, ((0, 0), (0, more))), np.pad(many, (0, more)), np.pad(weights, ((0, 0), (0, more)))
            many += np.bincount(langs, minlength=len(names))
            cut = [segments(t) if t else [] for t in b.column("text").to_pylist()]
            codes = numbered(cut, index)
            weights = np.pad(weights, ((0, len(index) - len(weights)), (0, 0)))
            lang = np.repeat(langs, [len(x) for x in cut])
            for m in np.unique(lang):
                weights[:, m] += np.bincount(codes[lang == m], minlength=len(weights))
            if len(index) > WORDS:
                weights = settle()
        settle()
        for name, m in names.items():
            used = np.flatnonzero(total[:, m])
            keys = np.append(used, -1)  # -1: documents
            values = np.append(total[used, m].astype(np.int64), many[m])
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys)), pa.array(keys), pa.array(values)], ["lang", "piece", "uses"])

    sums = rows.mapInArrow(run, "lang string, piece bigint, uses bigint").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    found = sums.toPandas()  # a row for each language and piece at most
    languages = sorted(found["lang"].unique())
    if len(languages) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    place = {x: m for m, x in enumerate(languages)}
    m, piece, uses = found["lang"].map(place).to_numpy(np.int64), found["piece"].to_numpy(np.int64), found["uses"].to_numpy(np.int64)
    counts, share = np.zeros((len(sent.value[1]), len(languages))), np.zeros(len(languages))
    counts[piece[piece >= 0], m[piece >= 0]] = uses[piece >= 0] / UNIT
    share[m[piece < 0]] = uses[piece < 0]
    logs = np.log((counts + PRIOR * np.exp(sent.value[1])[:, None]) / (counts.sum(axis=0) + PRIOR))
    return Model(languages, np.log(share / share.sum()), logs)


def _letters(text: str | None) -> bool:
    return text is not None and (any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text)))


def predict_texts(texts: list[str | None], model: Model, scores: Scores) -> tuple[list[str], np.ndarray]:
    cut = [segments(t) if _letters(t) else [] for t in texts]
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    doc = np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    per = scores.of(cut)
    total = np.stack([np.bincount(doc, per[:, m], len(cut)) for m in range(len(model.languages))], axis=1) + model.share
    best = total.argmax(axis=1)
    part = 1 / np.exp(total - total.max(axis=1)[:, None]).sum(axis=1)
    told = np.array([bool(x) for x in cut])
    return [model.languages[m] if t else "und" for m, t in zip(best, told)], np.where(told, part, 0.0)


def predict(docs: DataFrame, model: Model, pieces: Pieces | None = None, chunk: int = CHUNK) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    sent = docs.sparkSession.sparkContext.broadcast((pieces or load(), model))  # as large as the vocabulary, for each language

    def run(batches):
        p, m = sent.value
        scores = Scores(m.logs, p)
        for b in slices(batches, "text", chunk):
            langs, score = predict_texts(b.column("text").to_pylist(), m, scores)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    out = lean(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
    return out.select("doc_id", _held(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
