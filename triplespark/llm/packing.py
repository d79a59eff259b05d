"""Bulk-synchronous best-fit packing of documents into sequences of fixed length.

Lengths are integers from 1 to the capacity, so the range-sorted list of documents, and that of
gaps, fall into at most `capacity` classes each. A superstep takes the longest class that is not
placed, sweeps the gap classes from its successor (the smallest gap that fits) upwards, pairs
documents and gaps by rank within their classes (which resolves all conflicts at once), updates the
gaps, and repeats; what fits no gap opens sequences. The result is that of sequential best-fit by
descending length.

Distribution: texts are encoded once and stored as pieces with their rank among the equal lengths of
their task. Counts by (task, length) are added up over the cluster; only the histogram, of at most
`capacity` numbers whatever the input, reaches the driver, where the supersteps run on it. They
return runs (a range of ranks of a class, a range of sequences, an offset), which every task then
applies to its own pieces. The number of runs depends on the classes, not on how many pieces they hold;
they are broadcast in blocks of at most `BLOCK_RUNS`, each applied to the pieces in its range. A length
that a third of all pieces share is spread over all tasks that made them.

Edge cases: null or empty text is the end id alone; a null doc_id and repeated rows are packed like
any other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triplespark.llm.common import stored, text_or_empty
from triplespark.llm.encoding import SLICE, encoder, release, slices, tokenizer_path

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, local_rank long"
#: Runs of a plan that are broadcast at a time (40 bytes each).
BLOCK_RUNS = 1_000_000
#: A length and a rank make one key, the rank below so many bits.
_RANK_BITS = 48


def _pieces(path: str, end: bytes, capacity: int):
    width = capacity * 4

    def run(batches):
        encode, task, seen = encoder(path, True), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            out = [[] for _ in range(6)]
            for a, b in slices(pc.binary_length(texts).to_pylist(), SLICE):
                for key, ids in zip(keys[a:b], encode(texts.slice(a, b - a).to_pylist())):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), width)):
                        part = ids[at:at + width]
                        n = len(part) // 4
                        for column, x in zip(out, (key, piece, at // 4, n, zlib.crc32(part), seen[n])):
                            column.append(x)
                        seen[n] += 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(x, t) for x, t in zip(out, types)]
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array([task] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "task", "local_rank"])

    return run


def plan(counts, capacity: int) -> tuple[np.ndarray, int]:
    """Best-fit over classes: counts[n] pieces of length n. Returns runs and the number of sequences.

    A run is (length, first rank, first sequence, offset, per): the piece of rank first + i lies in
    sequence first + i // per, at offset + (i % per) * length. Runs are in order of (length, rank).
    """
    gaps: dict[int, deque] = defaultdict(deque)  # gap -> runs of sequences (first, how many)
    there = np.zeros(capacity + 1, dtype=bool)
    runs, opened = [], 0

    def fill(length: int, rank: int, left: int, gap: int, first: int, n: int) -> int:
        """Put pieces of one class into the n sequences from `first`; how many it placed."""
        per = gap // length
        placed = min(left, n * per)
        runs.append((length, rank, first, capacity - gap, per))
        full, rest = divmod(placed, per)
        for at, many, now in ((first, full, gap - per * length), (first + full, int(rest > 0), gap - rest * length), (first + full + (rest > 0), n - full - (rest > 0), gap)):
            if many and now:
                gaps[now].append((at, many))
                there[now] = True
        return placed

    for length in range(capacity, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            fits = there[length:]
            gap = length + int(fits.argmax())
            if not there[gap]:
                n = -(-left // (capacity // length))
                placed = fill(length, rank, left, capacity, opened, n)
                opened += n
            else:
                first, n = gaps[gap].popleft()
                there[gap] = bool(gaps[gap])
                need = -(-left // (gap // length))
                if n > need:  # the rest of the run keeps its gap
                    gaps[gap].appendleft((first + need, n - need))
                    there[gap] = True
                placed = fill(length, rank, left, gap, first, min(n, need))
            rank, left = rank + placed, left - placed
    runs.sort()
    return np.array(runs, dtype=np.int64).reshape(-1, 5), opened


def _placed(shared):
    def run(batches):
        release()  # the texts are encoded by now
        runs = shared.value
        keys = (runs[:, 0] << _RANK_BITS) + runs[:, 1]
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            at = np.searchsorted(keys, (length << _RANK_BITS) + rank, "right") - 1
            _, first, sequence, offset, per = runs[at].T
            i = rank - first
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence + i // np.maximum(per, 1)), pa.array(offset + i % np.maximum(per, 1) * length)],
                [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece."""
    spark, path = docs.sparkSession, tokenizer or tokenizer_path("word_bpe_49k.json")
    made = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(
        _pieces(path, int(end_id).to_bytes(4, "little"), capacity), PIECES)
    pieces = stored(made, "pieces")
    by_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = by_task.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).drop("n")
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    runs, _ = plan(histogram, capacity)
    ranked = pieces.join(before, ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("local_rank")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if len(runs) <= BLOCK_RUNS:
        return ranked.mapInArrow(_placed(spark.sparkContext.broadcast(runs)), schema)
    key, first, parts = F.shiftleft("length", _RANK_BITS) + F.col("rank"), (runs[:, 0] << _RANK_BITS) + runs[:, 1], []
    for at in range(0, len(runs), BLOCK_RUNS):
        own = ranked.filter(key >= int(first[at]))
        if at + BLOCK_RUNS < len(runs):
            own = own.filter(key < int(first[at + BLOCK_RUNS]))
        parts.append(own.mapInArrow(_placed(spark.sparkContext.broadcast(runs[at:at + BLOCK_RUNS])), schema))
    return reduce(DataFrame.unionAll, parts)


def op4_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
