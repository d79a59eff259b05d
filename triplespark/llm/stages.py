"""Operators as steps over a documents table: what each keeps or changes, all columns preserved.

Edge cases, for all steps: null and empty texts are scored, fingerprinted, searched and packed as empty
ones (they make one class of near-duplicates, so one such row stays); a null doc_id is a row like any
other; repeated rows are one class, of which one stays; an empty table stays empty; labels or benchmark
may be empty (then no document is rejected for contamination, and all have a score of 0.5, which is
below the threshold); columns of any other names pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespark.llm import decontamination, pii, quality, simhash
from triplespark.llm.common import remainder


def keep_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that the classifier predicts as good, learnt from labels that are not held out."""
    weights = quality.fit(docs, labels, remainder("doc_id", 4) != 2)
    held = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]  # any names of theirs may clash with ours
    kept = quality.score(docs.select(held), weights, *[f"__{i}" for i in range(len(held))], text=f"__{docs.columns.index('text')}").filter(F.col("predicted") == 1)
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """Of each class of near-duplicates one row: the one with the smallest doc_id (rows without one come
    last), of several with that id the one whose text's hash is least."""
    chosen = simhash.representatives(docs)
    own = [F.col(f"`{c}`").alias(f"__{i}") for i, c in enumerate(docs.columns)]  # any names of theirs may clash with ours
    keyed = docs.select(*own, F.col("doc_id").cast("long").alias("doc_id"), simhash.text_mark().alias("mark"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])
    # the representatives grow with the documents, so the texts are shuffled to them at every size; hashed, not sorted
    kept = keyed.join(found := chosen.hint("shuffle_hash"), same(keyed, found), "left_semi")
    twice = chosen.filter("n > 1")
    if not twice.isEmpty():  # equal rows: any one of them
        kept = kept.join(twice, same(kept, twice), "left_anti").unionAll(
            kept.join(twice, same(kept, twice), "left_semi").dropDuplicates(["doc_id", "mark"]))
    return kept.select(*[F.col(f"__{i}").alias(c) for i, c in enumerate(docs.columns)])


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows without a benchmark phrase, and without the greater part of an item in other words or order."""
    return decontamination.clean(docs, benchmark)


def without_pii(docs: DataFrame) -> DataFrame:
    """The same documents with personal data replaced by its kind."""
    return pii.redact(docs)
