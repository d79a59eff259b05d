"""New numbers for the terms of a dictionary. They never show in results; they decide what lies together.

Each takes the triples as ids and a dictionary (id, term, kind) and returns old id -> new id for all ids
of the dictionary, a permutation of 1..n within it (spread: an injection into larger numbers).
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespark.operators.statistics import degrees, ranked, running

METHODS = ("none", "rand", "bfs", "pca", "degree", "spread")


def random(dictionary: DataFrame, seed: int = 42) -> DataFrame:
    return ranked(dictionary.select("id"), F.xxhash64(F.lit(seed), "id"), F.col("id")).select("id", "new_id")


def by_degree(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    found = dictionary.select("id").join(degrees(triples).withColumnRenamed("node", "id"), "id", "left")
    return ranked(found, F.desc(F.coalesce("degree", F.lit(0))), F.col("id")).select("id", "new_id")


#: Ids up to here are also kept as a bit each: 32 MB. Levels, and components with edges, that are found that way at most.
MOST_BITS, SWEPT_LEVELS, SWEPT_COMPONENTS = 1 << 28, 64, 8


def _bits(packed: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return (packed[ids >> 3] >> (ids & 7).astype(np.uint8)) & 1 == 1


def _without(rows: DataFrame, column: str, seen: Broadcast) -> DataFrame:
    """The rows whose id is not among the bits."""
    def kept(batches):
        for x in batches:
            yield x.filter(pa.array(~_bits(seen.value, x.column(column).to_numpy())))

    return rows.mapInArrow(kept, rows.schema)


def _next_level(edges: DataFrame, size: int, frontier: Broadcast, seen: Broadcast) -> DataFrame:
    """word, bits: the ids beside the frontier that have not been seen, 64 to a word."""
    def found(batches):
        new = np.zeros(size * 8, dtype=bool)
        for x in batches:
            a, b = x.column("a").to_numpy(), x.column("b").to_numpy()
            near_a, near_b = _bits(frontier.value, a), _bits(frontier.value, b)
            new[b[near_a & ~near_b]] = True
            new[a[near_b & ~near_a]] = True
        words = (np.packbits(new, bitorder="little") & ~seen.value).view(np.int64)
        at = np.flatnonzero(words)
        for i in range(0, len(at), 100_000):
            own = at[i:i + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(words[own], pa.int64())], ["word", "bits"])

    return edges.mapInArrow(found, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))


def _swept(edges: DataFrame, ids: DataFrame, checkpoint, max_levels: int) -> tuple[DataFrame | None, DataFrame, DataFrame]:
    """id, root, level of the components that bits find, and the edges and ids of the others.

    The least id that has an edge is the root of its component. From there each level is one scan of the
    edges, stored once for each statement, without a shuffle of them: frontier and ids seen are sent as bits.
    """
    sc = edges.sparkSession.sparkContext
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    if low is None or low < 0 or high >= MOST_BITS:
        return None, edges, ids
    size = (high // 64 + 1) * 8
    seen, parts, budget = np.zeros(size, np.uint8), [], SWEPT_LEVELS
    for _ in range(SWEPT_COMPONENTS):
        root = edges.agg(F.min(F.least("a", "b"))).first()[0]
        if root is None:
            break
        frontier = np.zeros(size, np.uint8)
        frontier[root >> 3] = 1 << (root & 7)
        now, own, ended = seen | frontier, [edges.sparkSession.range(root, root + 1).select("id", F.lit(root).alias("root"), F.lit(0).alias("level"))], False
        for level in range(1, max_levels):
            if level > budget:
                break
            sent = [sc.broadcast(x) for x in (frontier, now)]
            words = checkpoint(_next_level(edges, size, *sent))
            for x in sent:
                x.destroy()
            got = words.toArrow()
            if not got.num_rows:
                ended = True
                break
            frontier = np.zeros(size, np.uint8)
            frontier.view(np.int64)[got.column("word").to_numpy()] = got.column("bits").to_numpy()
            now |= frontier
            bit = words.select("word", "bits", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i")).filter(F.expr("(shiftrightunsigned(bits, i) & 1) = 1"))
            own.append(bit.select((F.col("word") * 64 + F.col("i")).alias("id"), F.lit(root).cast("long").alias("root"), F.lit(level).alias("level")))
        else:
            raise RuntimeError(f"terms are left after {max_levels} levels")
        if not ended:  # so deep a component is left to the joins
            break
        seen, budget = now, budget - len(own) + 1
        parts += own
        edges = checkpoint(_without(edges, "a", sc.broadcast(seen)))
    return reduce(DataFrame.unionAll, parts) if parts else None, edges, _without(ids, "id", sc.broadcast(seen))


def breadth_first(triples: DataFrame, dictionary: DataFrame, checkpoint, max_levels: int = 100_000) -> DataFrame:
    """By (component, level, id): levels count from each component's smallest id.

    Large and shallow components are found by bits, level by level (`_swept`); what they leave, by frontier joins.
    `checkpoint` stores a table and reads it again; every round's is needed by the next two only.
    """
    edges = checkpoint(triples.select(F.col("s").alias("a"), F.col("o").alias("b")).filter("a != b"))
    found, edges, ids = _swept(edges, dictionary.select("id"), checkpoint, max_levels)
    if edges.isEmpty():
        placed = ids.select("id", F.col("id").alias("root"), F.lit(0).alias("level"))
    else:
        placed = _by_joins(edges, checkpoint(ids), checkpoint, max_levels)
    return ranked(found.unionAll(placed) if found else placed, F.col("root"), F.col("level"), F.col("id")).select("id", "new_id")


def _by_joins(edges: DataFrame, ids: DataFrame, checkpoint, max_levels: int) -> DataFrame:
    """id, root, level by joins of the edges with labels, then with frontiers."""
    edges = checkpoint(edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    # labels spread until each node knows the smallest id of its component
    labels = checkpoint(ids.withColumn("root", F.col("id")))
    while True:
        offered = edges.join(labels, edges["a"] == labels["id"]).groupBy("b").agg(F.min("root").alias("offer"))
        grown = labels.join(offered, labels["id"] == offered["b"], "left").select("id", F.least("root", F.coalesce("offer", "root")).alias("root"), (F.col("offer") < F.col("root")).alias("moved"))
        # pointer jumping: take over the root of one's root
        grown = checkpoint(grown)
        roots = grown.select(F.col("id").alias("root"), F.col("root").alias("further"))
        labels = checkpoint(grown.join(roots, "root", "left").select("id", F.coalesce("further", "root").alias("root")))
        if grown.filter("moved").isEmpty():
            break
    frontier = checkpoint(labels.filter("id = root").select("id", F.lit(0).alias("level")))
    reached = frontier
    for level in range(1, max_levels):
        step = edges.join(frontier, edges["a"] == frontier["id"]).select(F.col("b").alias("id")).distinct()
        frontier = checkpoint(step.join(reached.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")))
        if frontier.isEmpty():
            break
        reached = checkpoint(reached.unionAll(frontier))
    else:
        raise RuntimeError(f"terms are left after {max_levels} levels")
    return labels.join(reached, "id").select("id", "root", "level")


def by_component(triples: DataFrame, dictionary: DataFrame, checkpoint) -> DataFrame:
    """By the first principal component of the 0/1 matrix of terms by the predicates they occur with.

    Terms with the same predicates have the same score: sets of predicates are counted, how often two
    predicates stand together comes from these counts, and each set is scored once.
    """
    literals = dictionary.filter("kind = 'literal'").select("id")
    subject = triples.select(F.col("s").alias("id"), "p").distinct()
    obj = triples.select(F.col("o").alias("id"), "p").distinct().join(literals, "id", "left_anti")
    columns = checkpoint(ranked(triples.select("p").distinct(), F.col("p"), name="k"))
    n = columns.count()  # the driver holds a matrix of predicates by predicates
    if not n:
        return ranked(dictionary.select("id"), F.col("id")).select("id", "new_id")
    rows = checkpoint(subject.unionAll(obj).join(columns, "p").groupBy("id").agg(F.array_sort(F.collect_set("k")).alias("ks")))
    sets = checkpoint(rows.groupBy("ks").agg(F.count(F.lit(1)).alias("m")))
    both = sets.select("m", "ks", F.explode("ks").alias("i")).select("m", "i", F.explode("ks").alias("j")).groupBy("i", "j").agg(F.sum("m").alias("m")).toArrow()
    together = np.zeros((n, n))
    together[both.column("i").to_numpy() - 1, both.column("j").to_numpy() - 1] = both.column("m").to_numpy()
    total = sets.agg(F.sum("m")).first()[0]
    mean = together.diagonal() / total
    axis = np.linalg.eigh(together / total - np.outer(mean, mean))[1][:, -1]
    weights = triples.sparkSession.createDataFrame([(k + 1, float(x)) for k, x in enumerate(axis)], "k long, w double")
    scores = checkpoint(sets.select("ks", F.explode("ks").alias("k")).join(weights, "k").groupBy("ks").agg(F.sum("w").alias("score")))
    found = dictionary.select("id").join(rows.join(scores, "ks").select("id", "score"), "id", "left")
    return ranked(found, F.asc_nulls_last("score"), F.col("id")).select("id", "new_id")


def spread(dictionary: DataFrame, seed: int = 100) -> DataFrame:
    """Running sums of random widths from 2 to 10, so that different ids stay different."""
    width = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(9)) + 2
    return running(dictionary.select("id", width.alias("w")), "id", "w").select("id", (F.col("before") + F.col("w")).alias("new_id"))


def renumber(method: str, triples: DataFrame, dictionary: DataFrame, checkpoint) -> DataFrame | None:
    """The mapping of a method; none leaves the numbers as they are."""
    if method == "none":
        return None
    if method == "rand":
        return random(dictionary)
    if method == "bfs":
        return breadth_first(triples, dictionary, checkpoint)
    if method == "pca":
        return by_component(triples, dictionary, checkpoint)
    if method == "degree":
        return by_degree(triples, dictionary)
    if method == "spread":
        return spread(dictionary)
    raise ValueError(f"unknown method {method!r}: one of {', '.join(METHODS)}")
