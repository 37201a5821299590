"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum (v_if x_i)^2)), the
pairwise part in linear time by the sum-of-squares identity.  Features come from the text and
n_chars only; labels, lang, source and doc_id are never inputs.

The model is fitted on the driver on at most ``max_rows`` labelled documents whose hashed
features take at most ``max_bytes`` (documented bounds: those with the least hash of doc_id);
features of these are computed by tasks.  A small set is passed over more often, so that every
fit takes at least ``LEAST_STEPS`` steps.

Every text is read whole.  Null or empty texts have the features of an empty text.  Rows
with a null doc_id are scored, with held_out false.  Repeated rows are all scored; of rows
that share a labelled doc_id one is learned from (the least features), and of labels that
disagree the lower.  With no usable labelled row the score is 0.5 for all.  Extra columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean

BITS = 16
RANK = 8
MAX_ROWS = 8000
MAX_BYTES = 64 << 20
LEAST_STEPS = 750
STEP = 128
CUT = 0.3

_UPPER, _LOWER, _DIGIT, _BLANK, _MARK = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = _LOWER[97:123] = _DIGIT[48:58] = True
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_MARK[33:127] = True
_MARK &= ~(_UPPER | _LOWER | _DIGIT)


def _bin(x: float, steps: int = 20) -> int:
    return min(steps, int(x * steps))


def _log(x: float) -> int:
    return int(2 * math.log2(1 + max(0.0, x)))


def structure(text: str, ws: list[str], count: Counter, n_chars: float | None) -> list[str]:
    """Bucketed statistics as names; each is a feature of value one."""
    raw = np.frombuffer(text.encode(), np.uint8)
    b = sum((np.bincount(raw[s : s + (1 << 20)], minlength=256) for s in range(0, len(raw), 1 << 20)), np.zeros(256, np.int64))
    n, m = max(1, int(b.sum())), max(1, len(ws))
    up, low = int(b[_UPPER].sum()), int(b[_LOWER].sum())
    lines = [x for x in text.split("\n") if x]
    plain = sum(c for w, c in count.items() if w.isalpha())
    ends = sum(c for w, c in count.items() if len(w) > 1 and not w[-1].isalnum() and not w[-2].isalnum())
    bare = sum(c for w, c in count.items() if not any(map(str.isalnum, w)))
    return [
        f"chars:{_log(len(text))}", f"words:{_log(len(ws))}", f"upper:{_bin(up / max(1, up + low))}", f"digit:{_bin(b[_DIGIT].sum() / n)}",
        f"mark:{_bin(b[_MARK].sum() / n, 40)}", f"blank:{_bin(b[_BLANK].sum() / n, 40)}", f"wide:{_bin(b[128:].sum() / n)}",
        f"long:{_log(n / m)}", f"fresh:{_bin(len(count) / m)}", f"top:{_bin(max(count.values(), default=0) / m)}",
        f"plain:{_bin(plain / m)}", f"ends:{_bin(ends / m)}", f"bare:{_bin(bare / m)}",
        f"lines:{_log(len(lines))}", f"again:{_bin(1 - len(set(lines)) / max(1, len(lines)))}", f"line:{_log(len(ws) / max(1, len(lines)))}",
        "meta:" + ("none" if n_chars is None or n_chars != n_chars else str(_log(n_chars))),
    ]


def features(text: str | None, n_chars: float | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct indices and values: words by count, of unit length together; structure and metadata, one each."""
    text = text or ""
    mask = (1 << bits) - 1
    ws = text.split()
    count = Counter(ws)
    i = np.fromiter((zlib.crc32(w.encode()) & mask for w in count), np.int64, len(count))
    x = np.log1p(np.fromiter(count.values(), np.float64, len(count)))
    x /= max(1e-12, math.sqrt(float(x @ x)))
    names = structure(text, ws, count, n_chars)
    j = np.fromiter((zlib.crc32(f"\t{s}".encode()) & mask for s in names), np.int64, len(names))
    i, where = np.unique(np.concatenate([i, j]), return_inverse=True)
    return i, np.bincount(where, np.concatenate([x, np.full(len(j), 0.5)]), len(i))


@dataclass
class FM:
    w0: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, indptr: np.ndarray, idx: np.ndarray, val: np.ndarray) -> np.ndarray:
        n = len(indptr) - 1
        row = np.repeat(np.arange(n), np.diff(indptr))
        out = self.w0 + np.bincount(row, self.w[idx] * val, n)
        for f in range(self.v.shape[1]):
            s = self.v[idx, f] * val
            out += 0.5 * (np.bincount(row, s, n) ** 2 - np.bincount(row, s * s, n))
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def pack(rows: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    sizes = [len(i) for i, _ in rows]
    return (
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64),
        np.concatenate([i for i, _ in rows]) if rows else np.zeros(0, np.int64),
        np.concatenate([x for _, x in rows]) if rows else np.zeros(0),
    )


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, bits: int = BITS, rank: int = RANK, epochs: int = 12, rate: float = 0.1, l2: float = 1e-5, seed: int = 7) -> FM:
    """Adagrad on log loss, in mini-batches of a fixed order."""
    rng = np.random.default_rng(seed)
    size = 1 << bits
    m = FM(0.0, np.zeros(size), rng.normal(0, 0.05, (size, rank)))
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2) if len(y) else 0.5
        return FM(float(np.log(p / (1 - p))), m.w, np.zeros_like(m.v))
    p = y.mean()
    m.w0 = float(np.log(p / (1 - p)))
    g0, gw, gv = 1e-8, np.full(size, 1e-8), np.full((size, rank), 1e-8)
    for _ in range(max(epochs, -(-LEAST_STEPS * STEP // len(y)))):
        order = rng.permutation(len(y))
        for s in range(0, len(order), STEP):
            pick = order[s : s + STEP]
            indptr, idx, val = pack([rows[k] for k in pick])
            n = len(pick)
            row = np.repeat(np.arange(n), np.diff(indptr))
            err = (sigmoid(m.margins(indptr, idx, val)) - y[pick]) / n
            at, back = np.unique(idx, return_inverse=True)
            e = err[row] * val
            g0 += err.sum() ** 2
            m.w0 -= rate * err.sum() / math.sqrt(g0)
            d = np.bincount(back, e, len(at)) + l2 * m.w[at]
            gw[at] += d * d
            m.w[at] -= rate * d / np.sqrt(gw[at])
            for f in range(rank):
                vx = m.v[idx, f] * val
                d = np.bincount(back, e * (np.bincount(row, vx, n)[row] - vx), len(at)) + l2 * m.v[at, f]
                gv[at, f] += d * d
                m.v[at, f] -= 0.3 * rate * d / np.sqrt(gv[at, f])
    return m


def held_out(doc_id: Column) -> Column:
    """Rows that no label may be learned from."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS, rank: int = RANK, max_bytes: int = MAX_BYTES) -> FM:
    """A machine fitted on at most max_rows labelled documents, none of them held out."""
    known = (
        lean(labels, doc_id="bigint", quality="int")
        .where("doc_id is not null and quality in (0, 1)")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )  # at most max_rows rows of two numbers: a bounded side to broadcast
    texts = lean(docs, doc_id="bigint", text="string", n_chars="bigint").join(F.broadcast(known), "doc_id")

    def run(batches):
        for b in batches:
            got = [features(t, n, bits) for t, n in zip(b["text"], b["n_chars"])]
            yield pd.DataFrame({"doc_id": b["doc_id"], "y": b["quality"], "i": [i.astype(np.int32).tobytes() for i, _ in got], "x": [x.astype(np.float32).tobytes() for _, x in got]})

    one = texts.mapInPandas(run, "doc_id bigint, y int, i binary, x binary").groupBy("doc_id").agg(F.min(F.struct("i", "x", "y")).alias("d"))
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # over max_rows rows at most
    size = F.sum(F.octet_length("d.i") + F.octet_length("d.x")).over(order)
    got = one.withColumn("so_far", size).where(F.col("so_far") <= max_bytes).select("d.i", "d.x", "d.y").collect()
    rows = [(np.frombuffer(r["i"], np.int32).astype(np.int64), np.frombuffer(r["x"], np.float32).astype(float)) for r in got]
    return fit(rows, np.array([r["y"] for r in got], float), bits, rank)


def scores(spark: SparkSession, model: FM, bits: int = BITS, step: int = 256):
    """A column function of (text, n_chars): the score."""
    small = FM(model.w0, model.w.astype(np.float32), model.v.astype(np.float32))
    sent = spark.sparkContext.broadcast(small)  # 2**bits rows of rank + 1 floats, whatever the input

    @F.pandas_udf("double")
    def run(text: pd.Series, n_chars: pd.Series) -> pd.Series:
        texts, chars, out = text.tolist(), n_chars.tolist(), [np.zeros(0)]
        for s in range(0, len(texts), step):
            out.append(sent.value.margins(*pack([features(t, n, bits) for t, n in zip(texts[s : s + step], chars[s : s + step])])))
        return pd.Series(sigmoid(np.concatenate(out)))

    return run


def score(docs: DataFrame, model: FM, bits: int = BITS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    run = scores(docs.sparkSession, model, bits)
    rows = lean(docs, doc_id="bigint", text="string", n_chars="bigint").withColumn("score", run("text", "n_chars"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def accepted(docs: DataFrame, model: FM, bits: int = BITS, cut: float = CUT) -> DataFrame:
    """The rows of docs, with all their columns, that score at least cut."""
    run = scores(docs.sparkSession, model, bits)
    chars = F.col("n_chars").cast("bigint") if "n_chars" in docs.columns else F.lit(None).cast("bigint")
    return docs.where(run(F.col("text").cast("string"), chars) >= cut)
