"""Language identification by language-bitmask n-gram filters.

A bit-sliced Bloom filter is an array of slots, each a bitmask over the languages; an n-gram sets its
languages' bits in the `HASHES` slots it hashes to. One look-up, the AND of those slots, thus returns
all languages that contain the n-gram. A text's n-grams are looked up at once; the popcount of each
language's bit over the text, less the count that the filter's false-positive rate for that language
explains, is the evidence, and the language with the most corrected evidence wins.

N-grams are the byte sequences of lengths 2 to 4 of the words, lower-cased in A-Z, with a blank at
either end of a word; only letters (and non-ASCII bytes) count, the rest reads as blanks. A language
contains an n-gram if that is at least `RATE` of the language's n-grams in the sample, and there twice,
whatever the other languages hold: an n-gram of several languages has the bits of all of them.

Fit: at most `PER_LANGUAGE` different labelled documents of each language (fewer where there are many languages:
`SAMPLE` over all, but `FEWEST` each), the smallest by hash, whole texts; that is the documented bound,
and a hot source or language doesn't crowd out the others. Equal rows are sent once, with their number.
More than 64 languages take further bitmask words; more than `LANGUAGES` are refused, which bounds what is
broadcast.

Edge cases: null text, or one without a letter, is `und` with score 0; a text that no language claims
is the language most frequent in the sample, with score 1 / languages; without any labelled document
everything is `und`; ties go to the language first by name; a null doc_id is never held out; repeated
rows are kept; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplespark.llm.common import remainder
from triplespark.llm.encoding import slices

PER_LANGUAGE, SAMPLE, FEWEST, LANGUAGES = 600, 9_600, 16, 1_000
LENGTHS = (2, 3, 4)
HASHES = 3
RATE = 1e-5
SLOT_BITS = 20
#: Characters of text to look up at a time: few enough that their n-grams stay in the processor's cache.
SLICE = 100_000
#: Lower-cases A-Z and blanks what is neither letter nor non-ASCII.
_TABLE = np.array([c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256)], dtype=np.uint32)
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the texts, and the text of each."""
    raw = [b" " + t.encode() + b" " for t in texts]
    size = np.array([len(r) for r in raw])
    b = _TABLE[np.frombuffer(b"".join(raw), dtype=np.uint8)]
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), size)
    keep = np.ones(len(b), dtype=bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (owner[1:] != owner[:-1])  # runs of blanks in a text count as one
    b, owner = b[keep], owner[keep]
    out, who = [], []
    for n in LENGTHS:
        if len(b) < n:
            continue
        code = np.zeros(len(b) - n + 1, dtype=np.uint32)
        for k in range(n):
            code = (code << np.uint32(8)) | b[k:len(b) - n + 1 + k]
        inner = owner[:len(code)] == owner[n - 1:]
        for k in range(1, n - 1):
            inner &= b[k:len(b) - n + 1 + k] != 32  # a blank only at the ends
        code = (code[inner] + np.uint32(n)) * np.uint32(2654435761)
        out.append(code ^ (code >> np.uint32(15)))
        who.append(owner[:len(inner)][inner])
    return (np.concatenate(out), np.concatenate(who)) if out else (np.zeros(0, np.uint32), np.zeros(0, np.int32))


def _slots(codes: np.ndarray) -> list[np.ndarray]:
    return [(codes * m) >> np.uint32(32 - SLOT_BITS) for m in _MIX[:HASHES]]


class Filters:
    """The bit-sliced Bloom filter and each language's false-positive rate."""

    def __init__(self, languages: list[str], prior: int, slots: np.ndarray, rates: np.ndarray):
        self.languages, self.prior, self.slots, self.rates = languages, prior, slots, rates

    @classmethod
    def fit(cls, rows: list[tuple]) -> Filters:
        """Of (text, language) or (text, language, how often it is there)."""
        languages = sorted({r[1] for r in rows})
        size, codes, counts = np.zeros(len(languages), dtype=np.int64), [], []
        for i, x in enumerate(languages):
            own = [r for r in rows if r[1] == x]
            many = np.array([r[2] if len(r) > 2 else 1 for r in own], dtype=np.int64)
            c, owner = grams([r[0] for r in own])
            c, place = np.unique(c, return_inverse=True)
            codes.append(c)
            counts.append(np.bincount(place, weights=many[owner], minlength=len(c)).astype(np.int64))
            size[i] = many.sum()
        seen = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.uint32)
        rates = np.zeros((len(languages), len(seen)))
        many = np.zeros((len(languages), len(seen)), dtype=np.int64)
        for i, (c, n) in enumerate(zip(codes, counts)):
            at = np.searchsorted(seen, c)
            rates[i, at], many[i, at] = n / max(1, n.sum()), n
        contains = (rates >= RATE) & (many >= 2)
        slots = np.zeros(((len(languages) + 63) // 64 or 1, 1 << SLOT_BITS), dtype=np.uint64)
        for i in range(len(languages)):
            for s in _slots(seen[contains[i]]):
                slots[i // 64][s] |= np.uint64(1 << i % 64)
        fill = np.array([((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(languages))])
        return cls(languages, int(size.argmax()) if len(size) else -1, slots, fill ** HASHES)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Corrected evidence, a row for each text and a column for each language."""
        codes, who = grams(texts)
        total = np.bincount(who, minlength=len(texts)).astype(float)
        where = _slots(codes)
        out = np.zeros((len(texts), len(self.languages)))
        for w, bits in enumerate(self.slots):
            mask = bits[where[0]]
            for s in where[1:]:
                mask &= bits[s]
            hit = np.flatnonzero(mask)
            mask, owner = mask[hit], who[hit]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                count = np.bincount(owner[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=len(texts))
                out[:, i] = np.maximum(0, (count - total * self.rates[i]) / (1 - self.rates[i]))
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        known = [t or "" for t in texts]
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        evidence = self.scores(known)
        best, total = evidence.argmax(axis=1), evidence.sum(axis=1)
        best = np.where(total > 0, best, self.prior)
        score = np.where(total > 0, evidence[np.arange(len(known)), best] / np.maximum(total, 1e-12), 1 / len(self.languages))
        letter = np.array([any(map(str.isalpha, t)) for t in known], dtype=bool)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letter)], np.where(letter, score, 0.0)


def fit(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> Filters:
    """Filters from at most `per_language` documents of each language among those that `learn` admits."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sizes.count()
    if languages > LANGUAGES:
        raise ValueError(f"{languages} languages, more than {LANGUAGES}")
    per_language = max(FEWEST, min(per_language, SAMPLE // max(1, languages)))
    known = known.withColumn("__mark", F.xxhash64("text"))
    # a hash threshold leaves about twice the wanted texts of each language before any ranking
    spread = F.pmod(F.xxhash64("doc_id", "__mark", F.lit(7)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    near = (known.select("doc_id", "lang", "__mark").join(F.broadcast(sizes), "lang")
            .withColumn("h", spread).filter(F.col("h") * F.col("n") <= 2.0 * per_language + 50)
            .groupBy("lang", "h", "doc_id", "__mark").agg(F.count(F.lit(1)).alias("times")))
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id")))
    chosen = ranked.filter(F.col("rank") <= per_language).select("doc_id", "lang", "__mark", "times")
    rows = (known.join(F.broadcast(chosen), ["doc_id", "lang", "__mark"]).groupBy("doc_id", "lang", "__mark")
            .agg(F.min("text").alias("text"), F.first("times").alias("times")).select("text", "lang", "times"))

    def train(batches):
        data = [r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(3)))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Filters.fit(data))], pa.binary())], ["model"])

    model = rows.coalesce(1).mapInArrow(train, "model binary").first()
    return pickle.loads(model["model"]) if model else Filters.fit([])


def identify(docs: DataFrame, model: Filters, *keep: str | Column) -> DataFrame:
    """The kept columns, lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    names = rows.columns[:-1]

    def run(batches):
        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            langs, scores = [], []
            for a, b in slices([len(t or "") for t in texts], SLICE):
                x, y = shared.value.predict(texts[a:b])
                langs += x
                scores.append(y)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                [*names, "lang_pred", "score"])

    out = rows.drop("__text").withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    return rows.mapInArrow(run, out)


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    """Predictions for all documents, learnt from those that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = remainder("doc_id", 4) == 2
    return identify(docs, fit(docs, ~held_out), "doc_id", held_out.alias("held_out"))
