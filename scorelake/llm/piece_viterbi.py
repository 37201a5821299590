"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

Texts are cut into segments where no piece crosses.  Distinct segments of equal length
advance together, one character a step: hashes of all substrings that end there probe the
sorted piece keys, and a vectorised maximum stores the backpointers.  Ties go to the longer
last piece.  The result is the segmentation of the largest score sum, as of a unigram model
over the pieces and scores of the file.

Texts are worked whole, about a megabyte of them at a time.  Null text encodes as null and
decodes as null; the empty text is one token (the space that every text starts with).
Rows with null or repeated doc_ids are each encoded.  An empty table gives no rows.  Extra
columns are ignored.  Decoding gives back every text exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import free, lean, slices
from .pieces import MARK, Pieces, distinct, load, mix, points_of, powers, prefix_hashes, segments, utf8_sizes

CELLS = 1 << 17


def _advance(points: np.ndarray, p: Pieces) -> np.ndarray:
    """points (rows, n): back[row, e], the length of the last piece of the best way to e."""
    rows, n = points.shape
    hashes, pw, top = prefix_hashes(points), powers(p.longest), p.longest
    best, back = np.full((rows, n + 1), -np.inf), np.ones((rows, n + 1), np.int8)
    best[:, 0] = 0
    step = max(1, CELLS // rows)
    for c0 in range(0, n, step):
        c1 = min(n, c0 + step)
        score = np.full((min(top, c1), rows, c1 - c0), -np.inf)
        for k in p.lengths[p.lengths <= c1].tolist():
            lo = max(c0, k - 1)  # the first end, less one, of a substring of k characters
            h = mix(hashes[:, lo + 1 : c1 + 1] - hashes[:, lo + 1 - k : c1 + 1 - k] * pw[k] + np.uint64(k))
            at, place = p.find(h.ravel())
            score[k - 1][at // (c1 - lo), at % (c1 - lo) + lo - c0] = p.scores[place]
        one = score[0]
        one[np.isneginf(one)] = p.unknown
        for e in range(c0 + 1, c1 + 1):
            m = min(top, e)
            ways = best[:, e - m : e] + score[m - 1 :: -1, :, e - 1 - c0].T  # the longest first
            k = ways.argmax(axis=1)
            best[:, e] = ways[np.arange(rows), k]
            back[:, e] = m - k
    return back


def _tokens(points: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids row after row, and how many each row has."""
    rows, n = points.shape
    back = _advance(points, p)
    hashes, pw = prefix_hashes(points), powers(p.longest)
    row, end = np.arange(rows), np.full(rows, n)
    rr, ss, kk = [], [], []
    while len(row):
        k = back[row, end].astype(np.int64)
        end = end - k
        rr.append(row)
        ss.append(end)
        kk.append(k)
        on = end > 0
        row, end = row[on], end[on]
    rr, ss, kk = map(np.concatenate, (rr, ss, kk))
    order = np.lexsort((ss, rr))
    rr, ss, kk = rr[order], ss[order], kk[order]
    h = mix(hashes[rr, ss + kk] - hashes[rr, ss] * pw[kk] + kk.astype(np.uint64))
    ids = np.full(len(h), -1, np.int64)
    at, place = p.find(h)
    ids[at] = p.ids[place]
    point = points[rr, ss]
    many = np.where(ids >= 0, 1, utf8_sizes(point))
    if (ids < 0).any():
        src = np.repeat(np.arange(len(ids)), many)
        nth = np.arange(len(src)) - np.repeat(np.cumsum(many) - many, many)
        c, size = np.where(point[src] == MARK, 0x2581, point[src]).astype(np.int64), many[src]
        byte = np.where(size == 1, c, np.where(nth == 0, (0xF00 >> size & 0xFF) | (c >> 6 * (size - 1)), 0x80 | (c >> 6 * (size - 1 - nth) & 0x3F)))
        ids, rr = np.where(ids[src] >= 0, ids[src], p.byte0 + byte), rr[src]
    return ids.astype(np.int32), np.bincount(rr, minlength=rows)


def encode_segments(found: list[str], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct segments one after another, and offsets (one more than segments)."""
    size = np.fromiter(map(len, found), np.int64, len(found))
    counts, parts = np.zeros(len(found), np.int64), [None] * len(found)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for s, e in zip(cuts, cuts[1:]):
        n = int(size[order[s]])
        most = max(1, CELLS // n)
        for at in range(s, e, most):
            pick = order[at : min(e, at + most)]
            ids, many = _tokens(points_of([found[i] for i in pick], n), p)
            counts[pick] = many
            for i, part in zip(pick.tolist(), np.split(ids, np.cumsum(many)[:-1])):
                parts[i] = part
    return (np.concatenate(parts) if parts else np.zeros(0, np.int32)), np.concatenate([[0], np.cumsum(counts)])


def spread(codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places in a flat array of the slices that codes name, one slice after another."""
    many = np.diff(offsets)[codes]
    return np.repeat(offsets[codes] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))


def encode_flat(texts: list[str | None], p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and offsets; null has none."""
    cut = [segments(t) if t is not None else [] for t in texts]
    codes, found = distinct(cut)
    flat, offsets = encode_segments(found, p)
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets)[codes])])
    return flat[spread(codes, offsets)], ends[np.concatenate([[0], np.cumsum([len(x) for x in cut])]).astype(np.int64)]


def encode_texts(texts: list[str | None], p: Pieces) -> list[np.ndarray | None]:
    ids, ends = encode_flat(texts, p)
    return [None if t is None else ids[a:b] for t, a, b in zip(texts, ends, ends[1:])]


def decode_ids(ids: np.ndarray, p: Pieces) -> str:
    """The text: bytes of all pieces, without the space that encoding put in front."""
    return b"".join(p.raw[ids].tolist()).decode("utf-8", "replace")[1:]


def _listed(ids: np.ndarray, ends: np.ndarray, texts: list[str | None]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array([t is None for t in texts]))


def encode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, token_ids."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces or load())  # as large as the vocabulary

    def run(batches):
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _listed(*encode_flat(texts, sent.value), texts)], ["doc_id", "token_ids"])

    return lean(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, token_ids array<int>")


def decode(tokens: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """The columns of tokens and last the text that token_ids decode to, called text or by ``common.free`` if there is such a column."""
    name = free(tokens, "text")
    sent = tokens.sparkSession.sparkContext.broadcast(pieces or load())
    schema = ", ".join(f"`{c}` {t}" for c, t in tokens.dtypes) + f", {name} string"

    def run(batches):
        for b in slices(batches, "token_ids"):
            ids = b.column("token_ids")
            texts = [decode_ids(x.values.to_numpy(), sent.value) if x.is_valid else None for x in ids]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, name])

    return tokens.mapInArrow(run, schema)


def encode_and_decode(docs: DataFrame, pieces: Pieces | None = None) -> DataFrame:
    """doc_id, token_ids, and text, decoded from these ids in the same task."""
    sent = docs.sparkSession.sparkContext.broadcast(pieces or load())

    def run(batches):
        for b in slices(batches, "text"):
            texts = b.column("text").to_pylist()
            ids, ends = encode_flat(texts, sent.value)
            again = [None if t is None else decode_ids(ids[s:e], sent.value) for t, s, e in zip(texts, ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _listed(ids, ends, texts), pa.array(again, pa.string())], ["doc_id", "token_ids", "text"])

    return lean(docs, doc_id="bigint", text="string").mapInArrow(run, "doc_id bigint, token_ids array<int>, text string")
