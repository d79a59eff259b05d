"""Token counts through a digest cache.

Contents are keyed by the SHA-256 of the normalised text (null counts as empty; nothing else may be
normalised, as it would change counts) and the SHA-256 of the tokenizer's file. Counts that the
cache holds are joined; only distinct contents it lacks are encoded, and appended to it.

Copies: each task first drops repeats of a content it has seen (a bounded memory, which only saves
shuffle), so a content that makes up a third of all rows reaches its partition once per task. There
contents are sorted by digest, which spills where it must, and only the first of equal ones is encoded.

Edge cases: null or empty text counts 0 bytes and 0 tokens; a null doc_id and repeated rows are kept
as they are; empty tables give empty results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import new_path, stored, text_or_empty
from triplespark.llm.encoding import SLICE, encoder, slices, tokenizer_path

CACHE = "version string, digest binary, n_tokens long"
#: Contents that a task remembers while it drops local repeats.
REMEMBERED = 400_000


def version_of(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _cache(spark, path: str, version: str) -> DataFrame | None:
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return rows.filter(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _local_distinct(batches):
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for i, d in enumerate(batch.column(0).to_pylist()):
            if d not in seen:
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(d)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def _encoded(path: str):
    def run(batches):
        encode, last = encoder(path, False), None  # a content's copies share a partition and stand together in it
        for batch in batches:
            digests, texts = batch.column(0).to_pylist(), batch.column(1)
            new = [i for i, d in enumerate(digests) if d != (digests[i - 1] if i else last)]
            last = digests[-1] if digests else last
            counts, picked = [], texts.take(pa.array(new, pa.int64()))
            for a, b in slices(pc.binary_length(picked).to_pylist(), SLICE):
                counts += encode(picked.slice(a, b - a).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([digests[i] for i in new], pa.binary()), pa.array(counts, pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, cache_path: str, tokenizer: str | None = None, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, cached (whether the cache knew the content before).

    Fills the cache under `cache_path`, a folder that all executors see, and then reads counts from it.
    """
    spark, path = docs.sparkSession, tokenizer or tokenizer_path("byte_bpe_50k.json")
    version = version_of(path)
    keyed = docs.select("doc_id", text_or_empty().alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    known = _cache(spark, cache_path, version)
    contents = (keyed.select("digest", "text").mapInArrow(_local_distinct, "digest binary, text string")
                .repartition("digest"))
    if known is not None:
        before = known.select("digest")
        contents = contents.join(before, "digest", "left_anti")
    new = contents.sortWithinPartitions("digest").mapInArrow(_encoded(path), "digest binary, n_tokens long")
    run = F.lit(new_path(spark, "run").rsplit("-", 1)[1])
    (new.select(F.lit(version).alias("version"), "digest", "n_tokens", run.alias("run"))
     .write.mode("append").parquet(cache_path))
    rows = spark.read.schema(CACHE + ", run string").parquet(cache_path).filter(F.col("version") == version)
    counts = rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"), F.min(F.col("run") == run).alias("new"))
    counts = stored(counts, "counts")  # a plain scan on this side lets Spark split a hot digest's partition of the join
    return (keyed.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
            .join(counts, "digest")
            .select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), (~F.col("new")).alias("cached")))


def op8_token_counts(spark, sf_dir: str) -> DataFrame:
    """Counts for all documents, from an empty cache of this run's own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, new_path(spark, "token-counts"))
