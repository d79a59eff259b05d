"""Approximate nearest neighbours by largest inner product: adaptive dimension scan in probed lists.

Index: an inverted file. Centroids are fitted on at most `SAMPLE` vectors (the smallest by hash, the
documented bound), `FIT` sampled vectors or more a list; every vector is put into the list of its nearest
centroid. A query probes the lists with the largest inner products with their centroids, as many as
`FITTED_QUERIES` vectors that are held out from the fit need for `COVERAGE` of their neighbours among all
rows, which one pass over the lists finds. How few lists that is depends on the vectors: those without any
structure, such as random directions, need about half of them.

Scan: one random orthogonal matrix rotates queries and vectors, whose columns are read in blocks of
`COLUMNS`. A query comes with a bar, the (k + 1)-th best inner product in the sample, which its k-th
neighbour reaches; in its first lists, which hold more than k vectors, there is none. After a block of columns the inner product s so far is known (with the norms it is the
partial distance: |q|^2 + |x|^2 - 2s). Under the hypothesis that the whole one is at the bar, s has over
random rotations the mean bar * Q/|q|^2 and the variance (|x|^2 - bar^2/|q|^2) Q (1 - Q/|q|^2) / (D - 1),
Q being the query's squared length in these columns; a candidate that lies `EPSILON` deviations below is
abandoned (in the way of Gao and Long, "High-dimensional approximate nearest neighbor search: with reliable
and efficient distance comparison operations", 2023, with the test for inner products). While more than
`DENSE` of a part's pairs of query and candidate are alive, a block is multiplied for all of them at once,
then for each living pair by itself. Survivors get their exact inner product, in double precision on the
original vectors.

Copies: equal vectors are searched once, under the smallest vec_id, with the smallest k + 1 of their
ids; more can never be among the k nearest, ties going to the smaller id. A vector that a third of all
rows share is thus one candidate and one query. Lists and their queries are cut into parts of at most
about `PART` vectors and `QUERIES` queries by hash, and meet part by part, so no group is unbounded.

Edge cases: vectors null, empty, zero, or holding null or non-finite components, and rows with a null
vec_id, take no part, neither as queries; of vectors of several lengths only the most frequent length
takes part (the longest, at a tie); a vec_id with several rows counts once, with its smallest vector;
fewer than k candidates give fewer rows; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplespark.llm.common import stored

SAMPLE, FITTED_QUERIES, COVERAGE = 16_384, 256, 0.95
#: At least so many lists; of about so many vectors each, as far as the sample fits them.
LISTS, LIST, FIT = 64, 256, 32
#: Vectors and queries that meet in a task at a time.
PART, QUERIES = 8_192, 4_096
COLUMNS, EPSILON, DENSE = 16, 2.0, 0.25


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else column.values
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v: what takes part, each vec_id once, stored; v as it is, in single or double precision."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kind = vectors.schema["embedding"].dataType.elementType.typeName()
    v = F.col("embedding").cast("array<float>" if kind == "float" else "array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    rows = stored(rows.withColumn("n", F.size("v")), "vectors")
    size = rows.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).limit(1).first()
    rows = rows.filter(F.col("n") == (size["n"] if size else 0)).drop("n")
    if rows.groupBy("vec_id").count().filter("count > 1").isEmpty():
        return rows
    return stored(rows.groupBy("vec_id").agg(F.min("v").alias("v")), "vectors")


class Index:
    """Centroids, rotation, the sample for the bars, and the number of lists to probe, all until calibrated; the lists' sizes."""

    def __init__(self, sample: np.ndarray, n_lists: int):
        rng = np.random.default_rng(7)
        d = sample.shape[1]
        self.rotation = np.linalg.qr(rng.standard_normal((d, d)))[0]
        n_lists = max(1, min(n_lists, len(sample) // FIT))
        centroids = sample[rng.choice(len(sample), n_lists, replace=False)]
        for _ in range(12):
            near = self._nearest(sample, centroids)
            sums = np.zeros_like(centroids)
            np.add.at(sums, near, sample)
            many = np.bincount(near, minlength=n_lists)
            centroids = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], centroids)
        self.centroids, self.sample = centroids, sample
        self.probes, self.sizes = n_lists, np.zeros(n_lists, dtype=np.int64)

    def hold(self, sizes: np.ndarray, k: int) -> None:
        """Take the lists' sizes; any choice of so many lists holds more than k vectors, if all lists do."""
        self.sizes = sizes
        self.probes = max(self.probes, min(len(sizes), int(np.searchsorted(np.cumsum(np.sort(sizes)), k, "right")) + 1))

    def bars(self, q: np.ndarray, k: int) -> np.ndarray:
        """An inner product that each query's k-th neighbour reaches: its (k + 1)-th best in the sample, which may hold the query."""
        if len(self.sample) <= k:
            return np.full(len(q), -np.inf)
        scores = q @ self.sample.T
        return np.partition(scores, len(self.sample) - 1 - k, axis=1)[:, len(self.sample) - 1 - k]

    def calibrate(self, queries: np.ndarray, owner: np.ndarray, lists: np.ndarray) -> None:
        """Probes for COVERAGE of the neighbours, each given by its query's place and its list."""
        if len(owner):
            rank = np.argsort(np.argsort(-(queries @ self.centroids.T), axis=1), axis=1)
            needed = np.sort(rank[owner, lists])
            self.probes = int(needed[min(len(needed) - 1, int(np.ceil(COVERAGE * len(needed))))]) + 1

    @staticmethod
    def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        return np.argmin((centroids ** 2).sum(axis=1) - 2 * (x @ centroids.T), axis=1)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        return self._nearest(x, self.centroids)

    def probed(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Each query's lists, best first, and its bar in each: none in the first ones, which hold more than k
        vectors together, so that every query finds k however its bar turns out."""
        lists = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :self.probes]
        sizes = self.sizes[lists]
        return lists, np.where(np.cumsum(sizes, axis=1) - sizes <= k, -np.inf, self.bars(q, k)[:, None])


def _neighbours(listed: DataFrame, reps: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k exact neighbours among all listed rows of a few queries: each one's query, by place, and its list."""
    shared = listed.sparkSession.sparkContext.broadcast((reps, queries))

    def run(batches):
        own, q = shared.value
        scores, lists = np.full((len(q), k), -np.inf), np.zeros((len(q), k), dtype=np.int32)
        for batch in batches:
            for a in range(0, batch.num_rows, 4_096):
                part = batch.slice(a, 4_096)
                now = q @ _matrix(part.column(1)).T
                now[own[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                scores = np.concatenate([scores, now], axis=1)
                lists = np.concatenate([lists, np.broadcast_to(part.column(2).to_numpy(), now.shape)], axis=1)
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
                scores, lists = np.take_along_axis(scores, top, axis=1), np.take_along_axis(lists, top, axis=1)
        row, column = np.nonzero(scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(scores[row, column]), pa.array(lists[row, column])], ["q", "score", "list"])

    found = listed.select("rep", "v", "list").mapInArrow(run, "q int, score double, list int")
    found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "list"))).filter(F.col("place") <= k)
    rows = found.select("q", "list").collect()  # at most FITTED_QUERIES * k
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def scan(queries: np.ndarray, bars: np.ndarray, ids: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, k: int):
    """The k best of a part for each query among those that reach its bar: (how many, ids, scores), query
    after query, best first, ties to the smaller id; and the pairs alive before each block and at the end.
    `ids` are ascending."""
    d = vectors.shape[1]
    q, x = queries @ rotation, vectors @ rotation
    length, bar = (queries ** 2).sum(axis=1), np.where(np.isfinite(bars), bars, 0.0)
    norm = np.sqrt((vectors ** 2).sum(axis=1))
    rest = np.sqrt(np.maximum(norm.max() ** 2 - bar ** 2 / length, 0))  # what is not along the query, at most this and the norm
    seen, dense = np.zeros(len(q)), np.zeros((len(q), len(x)))
    row = column = partial = None
    alive = [dense.size]
    for at in range(0, d, COLUMNS):
        block = slice(at, min(at + COLUMNS, d))
        seen += (q[:, block] ** 2).sum(axis=1)
        share = np.minimum(seen / length, 1)
        cut = np.where(np.isfinite(bars), bar * share - 1e-9 * np.abs(bar), -np.inf)
        deviation = EPSILON * np.sqrt(seen * (1 - share) / max(1, d - 1))
        if row is None:
            dense += q[:, block] @ x[:, block].T
            living = dense + deviation[:, None] * np.minimum(norm[None, :], rest[:, None]) >= cut[:, None]
            alive.append(int(np.count_nonzero(living)))
            if alive[-1] <= DENSE * dense.size or block.stop >= d:
                row, column = np.nonzero(living)
                partial = dense[row, column]
            continue
        for a in range(0, len(row), 100_000):  # only what is alive is read
            r, c = row[a:a + 100_000], column[a:a + 100_000]
            partial[a:a + 100_000] += np.einsum("ij,ij->i", q[r, block], x[c, block])
        keep = partial + deviation[row] * np.minimum(norm[column], rest[row]) >= cut[row]
        row, column, partial = row[keep], column[keep], partial[keep]
        alive.append(len(row))
    score = np.concatenate([(vectors[column[a:a + 100_000]] * queries[row[a:a + 100_000]]).sum(axis=1) for a in range(0, max(1, len(row)), 100_000)])  # row by row: equal vectors get equal scores
    order = np.lexsort((column, -score, row))
    many = np.bincount(row, minlength=len(q))
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    order = order[place < k]
    return (np.minimum(many, k), ids[column[order]], score[order]), alive


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each query row of `vectors`."""
    spark = vectors.sparkSession
    marked = usable(vectors).withColumn("mark", F.xxhash64("v"))  # sorts by the mark rarely compare the vectors themselves
    ids = marked.withColumn("place", F.row_number().over(Window.partitionBy("mark", "v").orderBy("vec_id"))).filter(F.col("place") <= k + 1)
    copies = stored(ids.groupBy("mark", "v").agg(F.min("vec_id").alias("rep"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "copies")
    asked = marked.filter(is_query).join(copies.select("mark", "v", "rep"), ["mark", "v"]).select("vec_id", "rep")
    asked = stored(asked, "queries")
    n = copies.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chosen = copies.select("v", "rep").orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).toArrow().combine_chunks()
    sample, reps = _matrix(chosen.column(0).combine_chunks()), chosen.column(1).to_numpy()
    held = min(FITTED_QUERIES, len(sample) // 4)
    index = Index(sample[held:], max(LISTS, n // LIST))
    fitted = spark.sparkContext.broadcast(index)

    def assign(batches):
        for batch in batches:
            lists = fitted.value.lists_of(_matrix(batch.column(1))) if batch.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists.astype(np.int32))], ["rep", "v", "list"])

    def probe(batches):
        for batch in batches:
            if batch.num_rows:
                q = _matrix(batch.column(1))
                for a in range(0, len(q), 256):
                    lists, bars = shared.value.probed(q[a:a + 256], k)
                    own = batch.slice(a, 256).take(pa.array(np.repeat(np.arange(len(lists)), lists.shape[1])))
                    yield own.append_column("bar", pa.array(bars.ravel())).append_column("list", pa.array(lists.ravel().astype(np.int32)))

    kind = copies.schema["v"].dataType.simpleString()
    listed = stored(copies.select("rep", "v").mapInArrow(assign, f"rep long, v {kind}, list int"), "lists")
    index.calibrate(sample[:held], *_neighbours(listed, reps[:held], sample[:held], k))
    sizes = np.zeros(len(index.centroids), dtype=np.int64)
    for place, many in listed.groupBy("list").count().collect():  # a row a list
        sizes[place] = many
    index.hold(sizes, k)
    shared = spark.sparkContext.broadcast(index)
    wanted = asked.select("rep").distinct().join(copies.select("rep", "v"), "rep")
    probes = stored(wanted.mapInArrow(probe, f"rep long, v {kind}, bar double, list int"), "probes")
    # the parts of each list, and of its queries: a number a list, few lists
    asking = np.zeros(len(sizes), dtype=np.int64)
    for place, many in probes.groupBy("list").count().collect():
        asking[place] = many
    parts = lambda counts, most: F.get(F.array(*[F.lit(int(-(-n // most))) for n in counts]), F.col("list"))
    x_parts, q_parts = parts(sizes, PART), parts(asking, QUERIES)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = listed.filter(q_parts > 0).select("list", F.pmod(F.xxhash64("rep"), x_parts).cast("int").alias("x"), every(q_parts).alias("q"), "rep", "v")
    right = probes.filter(x_parts > 0).select("list", F.pmod(F.xxhash64("rep"), q_parts).cast("int").alias("q"), every(x_parts).alias("x"), "rep", "v", "bar")

    def meet(key, a: pa.Table, b: pa.Table):
        if not a.num_rows or not b.num_rows:
            return pa.table({"rep": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.int64())), "scores": pa.array([], pa.list_(pa.float64()))})
        col = lambda t, n: t.column(n).combine_chunks()
        x, xi = _matrix(col(a, "v")), col(a, "rep").to_numpy()
        order = np.argsort(xi)
        xi, x = xi[order], x[order]
        q, qi, bars = _matrix(col(b, "v")), col(b, "rep").to_numpy(), col(b, "bar").to_numpy()
        found = [scan(q[s:s + 256], bars[s:s + 256], xi, x, shared.value.rotation, k + 1)[0] for s in range(0, len(q), 256)]
        many, near, score = (np.concatenate(z) for z in zip(*found))
        ends = pa.array(np.r_[0, np.cumsum(many)], pa.int32())
        return pa.table({"rep": pa.array(qi), "found": pa.ListArray.from_arrays(ends, pa.array(near)), "scores": pa.ListArray.from_arrays(ends, pa.array(score))})

    met = left.groupBy("list", "x", "q").cogroup(right.groupBy("list", "x", "q")).applyInArrow(meet, "rep long, found array<long>, scores array<double>")
    pairs = met.select("rep", F.explode(F.arrays_zip("found", "scores")).alias("p")).select("rep", F.col("p.found").alias("near"), F.col("p.scores").alias("score"))
    best = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
    nearest = pairs.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= k + 1)
    members = nearest.join(copies.select(F.col("rep").alias("near"), "ids"), "near").select("rep", "score", F.explode("ids").alias("vec_id"))
    top = members.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    answers = top.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("all"))
    answers = stored(answers, "answers")  # a plain scan: a vector that many queries share can be split among tasks
    own = asked.join(answers, "rep").select(F.col("vec_id").alias("query_id"), F.posexplode(
        F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)).alias("rank", "x"))
    return own.select("query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", "x.score")


def op2_nearest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every row whose vec_id is divisible by 20, against all rows."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
