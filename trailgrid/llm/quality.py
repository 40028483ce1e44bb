"""Quality classifier: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Tokens are runs of letters and digits and runs of other marks, in their own
case; a word equal to the word before it becomes the token ``=`` and a word in
capitals is preceded by the token ``^``.  Uni- and bigrams are hashed into
``2 ** BITS`` weights; a text is the vector of 1 + log(count), scaled to
length 1.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bounded_sample, map_batches, typed

BITS = 20
#: Training rows of each label at most.
SAMPLE = 4000
EPOCHS, ALPHA, BETA, L1, L2 = 8, 0.3, 1.0, 1e-4, 1e-4
#: Words whose hashes a process remembers at most, and their longest.
MEMO, MEMO_CHARS = 200_000, 40
_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+")
_SAME, _CAPS = zlib.crc32(b"="), zlib.crc32(b"^")


class _Tokens(dict):
    """Token -> its hash, with bit 32 set if it is a word in capitals."""

    def __missing__(self, token: str) -> int:
        h = zlib.crc32(token.encode("utf-8", "surrogatepass")) | (len(token) > 1 and token.isupper()) << 32
        if len(token) <= MEMO_CHARS:
            self[token] = h
        return h


class Hasher:
    """Feature indices and values of texts; remembers the hashes of words."""

    def __init__(self) -> None:
        self.memo = _Tokens()

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.empty(0, np.int64), np.empty(0)
        if len(self.memo) > MEMO:
            self.memo.clear()
        h = np.fromiter(map(self.memo.__getitem__, tokens), np.int64, len(tokens))
        caps = (h >> 32).astype(bool)
        h &= 0xFFFFFFFF
        same = np.r_[False, h[1:] == h[:-1]]
        h[same] = _SAME
        one = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (one[1:] >> np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        more = np.full(int(caps.sum()), _CAPS, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        index, count = np.unique(np.concatenate([one, two, more]) >> np.uint64(64 - BITS), return_counts=True)
        value = 1 + np.log(count)
        return index.astype(np.int64), value / np.sqrt(value @ value)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes in an order fixed by a seed; both labels weigh alike in sum."""
    ones = sum(y for y, _, _ in rows)
    share = [len(rows) / (2 * max(1, k)) for k in (len(rows) - ones, ones)]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    turn = np.random.default_rng(8)
    for _ in range(epochs):
        for k in turn.permutation(len(rows)):
            y, index, value = rows[k]
            index, value = np.append(index, 1 << BITS), np.append(value, 1.0)
            w = _weights(z[index], n[index])
            p = 1 / (1 + np.exp(-np.clip(w @ value, -35, 35)))
            g = (p - y) * share[y] * value
            sigma = (np.sqrt(n[index] + g * g) - np.sqrt(n[index])) / ALPHA
            z[index] += g - sigma * w
            n[index] += g * g
    w = _weights(z, n)
    return w[:-1], float(w[-1])


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> tuple[np.ndarray, np.ndarray, float]:
    """``indices, weights, bias``, trained on about ``most`` rows of each label, in one task of bounded size.

    Labels join documents by ``id_col``; rows without a label, an id or a
    document are left out, and so are labels other than 0 and 1 and ids with
    different labels.  Repeated labels of an id count once, repeated documents
    as often as they occur; null and empty texts are rows without features.
    Without any row the weights are empty and every score is 0.5.
    """
    label = F.col(label_col).cast("double")
    rows = labels.where(label.isin(0.0, 1.0)).select(F.col(id_col).alias("id"), label.cast("int").alias("y")).where("id is not null")
    rows = rows.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").select("id", "y")
    chosen = bounded_sample(rows, "id", "y", most)  # 2 * most rows of two numbers, about: broadcast
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id")

    def features(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hasher, found = Hasher(), [[], []]
        for t in batch.column(1).to_pylist():
            index, value = hasher(t)
            found[0].append(index.astype("<i4").tobytes())
            found[1].append(value.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(x, pa.binary()) for x in found)], ["id", "y", "i", "v"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["id"], r["y"], r["i"], r["v"]) for b in batches for r in b.to_pylist())
        if not rows:
            return
        w, bias = ftrl([(y, np.frombuffer(i, "<i4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for _, y, i, v in rows])
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at].astype(np.int32)), pa.array(np.r_[bias, w[at]].astype(np.float32))], ["i", "w"])

    hashed = map_batches(sample.select("id", "text", "y"), features, "id long, y int, i binary, v binary")
    got = arrow_map(hashed.repartition(1), learn, "i int, w float").toArrow()  # 2 ** BITS weights at most
    index, w = got.column("i").to_numpy(), got.column("w").to_numpy()
    return index[index >= 0], w[index >= 0], float(w[index < 0].sum())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], keep: bool = False, least: float | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every row, or all columns and ``score`` if ``keep``; only rows of score ``least`` or more if given.

    The score is the probability of label 1.  A null or empty text scores the
    bias alone, a very long one is scored whole.  Repeated rows give repeated
    rows, an empty table an empty result; an input column ``score`` is
    replaced, others may have any name.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights at most
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != "score"]) if keep else docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs if keep else docs.select("doc_id")
    names, text_at = out.columns, docs.columns.index(text_col if keep else "text")
    kept = range(len(names)) if keep else [0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, w, bias = sent.value
        weights = np.zeros(1 << BITS)
        weights[index] = w
        hasher = Hasher()
        for batch in batches:
            scores = np.full(batch.num_rows, bias)
            for k, t in enumerate(batch.column(text_at).to_pylist()):
                i, v = hasher(t)
                scores[k] += weights[i] @ v
            done = pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(1 / (1 + np.exp(-np.clip(scores, -35, 35))))], [*names, "score"])
            yield done if least is None else done.filter(pa.array(done.column(len(names)).to_numpy() >= least))

    return arrow_map(docs, run, f"{typed(out)}, score double")
