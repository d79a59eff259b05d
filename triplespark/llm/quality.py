"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader.

Words are runs of letters and digits or runs of marks; a word in capitals, and one that repeats the
word before it, are each written as a marker, since such words are new in every document. Unigrams and
bigrams of words are hashed into 2^BITS features valued 1 + log(count), scaled to unit length; a score
is the logistic of a sparse dot product.

Fit: at most `SAMPLE` labelled documents, the smallest by hash, whole texts (that is the documented
bound), in one task; FTRL-proximal with per-coordinate rates (McMahan et al., "Ad click prediction",
2013) over `EPOCHS` passes. Labels, lang, source and doc_id are never inputs of a score.

Edge cases: null and empty texts are scored by the bias alone; a null doc_id is never held out;
repeated rows are kept; without any label every score is 0.5; empty tables give empty results; a text
of any length is hashed whole; other columns are ignored.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import labelled_sample, remainder, text_or_empty
from triplespark.llm.encoding import release

SAMPLE = 8_000
BITS = 18
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.05, 0.05
THRESHOLD = 0.7
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+").findall
_CAPITALS, _REPEAT, _PAIR = np.uint32(0x51ED270B), np.uint32(0xA3B19535), np.uint32(0x9E3779B1)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers, ascending, and values of one text."""
    found = _WORDS((text or "").encode())
    n = len(found)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    h = np.fromiter(map(crc32, found), np.uint32, n)
    capitals = np.fromiter((w.isupper() and len(w) > 1 for w in found), bool, n)
    repeat = np.r_[False, h[1:] == h[:-1]]
    h[capitals] = _CAPITALS
    h[repeat] = _REPEAT
    pairs = (h[:-1] * _PAIR) ^ (h[1:] + (h[1:] >> np.uint32(7)))
    codes = np.concatenate([h * _PAIR, pairs * _PAIR]) >> np.uint32(32 - BITS)
    codes, counts = np.unique(codes, return_counts=True)
    values = 1 + np.log(counts)
    return codes.astype(np.int64), values / np.sqrt((values ** 2).sum())


def _logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def train(rows: list[tuple[str, int]]) -> np.ndarray:
    """Weights by FTRL-proximal; the last is the bias."""
    size = 1 << BITS
    z, n, w = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    rows = [(*features(t), y) for t, y in rows]
    rows = [(np.r_[i, size], np.r_[x, 1.0], y) for i, x, y in rows]
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            i, x, y = rows[k]
            g = (_logistic(x @ w[i]) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w[i]
            n[i] += g * g
            shrunk = np.maximum(np.abs(z[i]) - np.where(i == size, 0.0, L1), 0)
            w[i] = -np.sign(z[i]) * shrunk / ((BETA + np.sqrt(n[i])) / ALPHA + L2)
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample: int = SAMPLE) -> np.ndarray:
    """Weights from at most `sample` labelled documents that `learn` admits."""
    rows = labelled_sample(docs, labels, "quality", learn, sample)

    def run(batches):
        data = sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([train(data).astype(np.float32).tobytes()], pa.binary())], ["w"])

    found = rows.select("text", "label").coalesce(1).mapInArrow(run, "w binary").first()
    return np.frombuffer(found["w"], dtype=np.float32).astype(float) if found else train([])


def score(docs: DataFrame, weights: np.ndarray, *keep: str | Column, text: str | None = None) -> DataFrame:
    """The kept columns, score and predicted; `text` names the kept column that holds the text, if one does."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    rows = docs.select(*keep) if text else docs.select(*keep, text_or_empty().alias("__text"))
    kept = rows if text else rows.drop("__text")
    names, at = kept.columns, rows.columns.index(text or "__text")

    def run(batches):
        release()
        w = shared.value
        for batch in batches:
            scores = []
            for t in batch.column(at):  # one at a time: the texts of a batch are not all copied at once
                i, x = features(t.as_py())
                scores.append(float(_logistic(x @ w[i] + w[-1])))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())],
                [*names, "score", "predicted"])

    return rows.mapInArrow(run, kept.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    """Scores for all documents, learnt from labels that are not held out."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = remainder("doc_id", 4) == 2
    return score(docs, fit(docs, labels, ~held_out), "doc_id", held_out.alias("held_out"))
