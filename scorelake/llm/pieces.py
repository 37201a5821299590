"""A SentencePiece vocabulary as sorted keys of substring hashes, and texts as code points.

Pieces take their scores from the model file and segment by the largest sum (the unigram
rule).  A character that is no piece costs ``unknown`` and falls back to its UTF-8 bytes.
Spaces become U+2581 and a text starts with one more; a U+2581 of the text itself is kept
apart as code point MARK, which no piece holds, so that decoding gives every text back.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import numpy as np

SPACE = "▁"
MARK = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PROBE = 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    out = np.full(n + 1, _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def prefix_hashes(points: np.ndarray) -> np.ndarray:
    """points (rows, n) -> (rows, n + 1): H[k+1] = H[k] * base + mixed code point, modulo 2**64."""
    rows, n = points.shape
    out = np.zeros((rows, n + 1), np.uint64)
    c = mix(points.astype(np.uint64) + np.uint64(1))
    for k in range(n):
        out[:, k + 1] = out[:, k] * _BASE + c[:, k]
    return out


@dataclass
class Pieces:
    keys: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    probe: np.ndarray
    lengths: np.ndarray
    longest: int
    unknown: float
    byte0: int
    raw: np.ndarray  # by id: what a piece decodes to, as bytes

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in h that are a piece, and their places among the sorted keys."""
        at = np.flatnonzero(self.probe[(h >> np.uint64(64 - _PROBE)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[place] == h[at]
        return at[ok], place[ok]


def default_model() -> str:
    return os.environ.get("SCORELAKE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")


def load(path: str | None = None) -> Pieces:
    """Read on the driver; tasks get the arrays, whose size is that of the vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or default_model())
    raw, text, ids, scores, byte0 = [], [], [], [], -1
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte0 = i if byte0 < 0 else byte0
            raw.append(bytes([int(p[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            raw.append(b"")
        else:
            raw.append(p.replace(SPACE, " ").encode())
            text.append(p)
            ids.append(i)
            scores.append(sp.get_score(i))
    if byte0 < 0 or any("\n" in p or SPACE in p.lstrip(SPACE) for p in text):
        raise ValueError("the vocabulary needs byte pieces, and none that crosses a line end or the start of a word")
    wide = max(map(len, text))
    floor = min(s for s in scores if s > -1e8)  # blanks-only pieces may be marked as never used by a huge negative score
    points = np.zeros((len(text), wide), np.uint32)
    sizes = np.array([len(p) for p in text])
    for k, p in enumerate(text):
        points[k, : len(p)] = np.frombuffer(p.encode("utf-32-le"), np.uint32)
    h = mix(prefix_hashes(points)[np.arange(len(text)), sizes] + sizes.astype(np.uint64))
    order = np.argsort(h)
    if (np.diff(h[order].view(np.int64)) == 0).any():
        raise ValueError("two pieces share a hash")
    probe = np.zeros(1 << _PROBE, bool)
    probe[(h >> np.uint64(64 - _PROBE)).astype(np.int64)] = True
    return Pieces(h[order], np.array(ids)[order], np.array(scores)[order], probe, np.unique(sizes), wide, floor - 10.0, byte0, np.array(raw, object))


#: No piece holds a line end, and none has a space after another character, so texts may be cut there.
_CUT = re.compile(r"\n| *[^ \n]+| +")


def segments(text: str) -> list[str]:
    """The text, after one more space, cut where no piece crosses; runs of spaces stay before the word they lead."""
    return _CUT.findall(" " + text)


def distinct(cut: list[list[str]]) -> tuple[np.ndarray, list[str]]:
    """Codes of all segments in order, and the distinct segments."""
    index: dict[str, int] = {}
    codes = np.fromiter((index.setdefault(s, len(index)) for x in cut for s in x), np.int64, sum(map(len, cut)))
    return codes, list(index)


def points_of(segments: list[str], n: int) -> np.ndarray:
    """Code points of segments of n characters, a row each: spaces as U+2581, a U+2581 of the text as MARK."""
    p = np.frombuffer("".join(segments).encode("utf-32-le"), np.uint32).reshape(-1, n).copy()
    p[p == 0x2581] = MARK
    p[p == 32] = 0x2581
    return p


def utf8_sizes(points: np.ndarray) -> np.ndarray:
    """Bytes that each code point falls back to."""
    return np.where(points == MARK, 3, 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF))
