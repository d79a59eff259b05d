"""Statistics over ids: histograms, range cardinalities, predicate spread and boundary compactness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triplespark.sources.shared import stored


def equal_width(df: DataFrame, column: str, width: int) -> DataFrame:
    """lower, upper, freq of buckets of equal width from the minimum on; empty ones count 0.

    The two ends pass the driver; the buckets are a distributed range, however many there are.
    """
    spark = df.sparkSession
    x = df.select(F.col(column).cast("long").alias("x")).filter("x is not null")
    low, high = x.agg(F.min("x"), F.max("x")).first()
    if low is None:
        return spark.createDataFrame([], "lower long, upper long, freq long")
    first, last = F.lit(low).cast("long"), F.lit(high).cast("long")
    spine = spark.range((high - low) // width + 1).withColumnRenamed("id", "i")
    counts = x.groupBy(F.call_function("div", F.col("x") - first, F.lit(width).cast("long")).alias("i")).agg(F.count(F.lit(1)).alias("n"))
    lower = first + F.col("i") * width
    return spine.join(counts, "i", "left").select(
        lower.alias("lower"), F.least(lower + (width - 1), last).alias("upper"), F.coalesce("n", F.lit(0)).cast("long").alias("freq"))


#: monotonically_increasing_id holds the partition above these bits, the row within it below.
_ROW_BITS = 33


def _sorted(df: DataFrame, *order: Column | str) -> DataFrame:
    """The rows range-sorted by an order and stored, with `__slice` (ascending) and `__row` (from 0 in it).

    Stored, because what is counted by slice and what is numbered within it must see the same slices: a
    range exchange that two branches of a plan each plan for themselves samples its bounds twice.
    """
    at = F.monotonically_increasing_id()
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at), "sorted")
    return rows.withColumns({"__slice": F.shiftright("__at", _ROW_BITS), "__row": F.col("__at").bitwiseAND((1 << _ROW_BITS) - 1)}).drop("__at")


def _ahead(rows: DataFrame, n: Column) -> DataFrame:
    """__slice, __ahead: the sum of n over the slices before; one row for each slice."""
    before = Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__slice").agg(F.sum(n).alias("__n"))
    return sums.select("__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__ahead"))


def running(df: DataFrame, value: str, n: str) -> DataFrame:
    """The rows with `before`, the sum of n over smaller values (all different), by range slices, so that
    no task sees all values."""
    rows = _sorted(df, value)
    own = F.sum(n).over(Window.partitionBy("__slice").orderBy("__row")) - F.col(n)
    found = rows.withColumn("__own", own).join(F.broadcast(_ahead(rows, F.col(n))), "__slice")
    return found.withColumn("before", F.col("__own") + F.col("__ahead")).drop("__slice", "__row", "__own", "__ahead")


def ranked(df: DataFrame, *order: Column | str, name: str = "new_id") -> DataFrame:
    """Dense numbers from 1 in an order, by range slices rather than in a single task: one shuffle."""
    rows = _sorted(df, *order)
    found = rows.join(F.broadcast(_ahead(rows, F.lit(1))), "__slice")
    return found.withColumn(name, F.col("__row") + F.col("__ahead") + 1).drop("__slice", "__row", "__ahead")


def largest_gap(df: DataFrame, column: str) -> DataFrame:
    """lower, upper, gap: the neighbouring different values that lie farthest apart (ties: the lowest);
    no row for fewer than two values."""
    values = df.select(F.col(column).cast("long").alias("x")).filter("x is not null").distinct()
    rows = _sorted(values, "x")
    ends = rows.groupBy("__slice").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    within = rows.select(F.lag("x").over(Window.partitionBy("__slice").orderBy("__row")).alias("lower"), F.col("x").alias("upper"))
    between = ends.select(F.lag("last").over(Window.orderBy("__slice")).alias("lower"), F.col("first").alias("upper"))
    gaps = within.unionAll(between).filter("lower is not null")
    best = gaps.agg(F.max(F.struct((F.col("upper") - F.col("lower")).alias("gap"), (-F.col("lower")).alias("back"))).alias("b")).filter("b is not null")
    return best.select((-F.col("b.back")).alias("lower"), (F.col("b.gap") - F.col("b.back")).alias("upper"), F.col("b.gap").alias("gap"))


def equal_depth(df: DataFrame, column: str, depth: int) -> DataFrame:
    """lower, upper, freq of buckets of about equal depth; equal values stay together."""
    counts = df.select(F.col(column).cast("long").alias("x")).filter("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    placed = running(counts, "x", "n").withColumn("bucket", F.floor(F.col("before") / depth))
    return placed.groupBy("bucket").agg(F.min("x").alias("lower"), F.max("x").alias("upper"), F.sum("n").cast("long").alias("freq")).drop("bucket")


def range_cardinality(histogram: DataFrame, start: int, end: int) -> DataFrame:
    """estimate: rows in [start, end], each bucket contributing the share of it that overlaps."""
    overlap = F.greatest(F.lit(0), F.least(F.col("upper"), F.lit(end)) - F.greatest(F.col("lower"), F.lit(start)) + 1)
    return histogram.agg(F.coalesce(F.sum(F.col("freq") * overlap / (F.col("upper") - F.col("lower") + 1)), F.lit(0.0)).alias("estimate"))


def range_min(histogram: DataFrame, start: int, end: int) -> DataFrame:
    """lower, upper, freq, buckets: the least frequent bucket that touches [start, end] (ties: the lowest; null
    if there is none), and how many do."""
    inside = histogram.filter((F.col("upper") >= start) & (F.col("lower") <= end))
    best = inside.agg(F.min(F.struct("freq", "lower", "upper")).alias("b"), F.count(F.lit(1)).alias("buckets"))
    return best.select("b.lower", "b.upper", "b.freq", "buckets")


def cut_point(histogram: DataFrame, start: int, end: int) -> DataFrame:
    """cut: the middle of the least frequent bucket between the two ends; the middle of the ends if one bucket
    holds both."""
    middle = F.floor((F.col("lower") + F.col("upper")) / 2)
    return range_min(histogram, start, end).select(F.when(F.col("buckets") <= 1, F.lit((start + end) // 2)).otherwise(middle).cast("long").alias("cut"))


def _ranges(df: DataFrame, predicate: str, column: str) -> DataFrame:
    x = F.col(column).cast("long")
    return df.groupBy(F.col(predicate).alias("p")).agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count(x).alias("n"))


def predicate_spread(df: DataFrame, predicate: str, column: str) -> DataFrame:
    """dist_mean, dist_var over predicates of (max - min) / rows."""
    return _ranges(df, predicate, column).select(((F.col("high") - F.col("low")) / F.col("n")).alias("d")).agg(
        F.avg("d").alias("dist_mean"), F.var_pop("d").alias("dist_var"))


def boundary_compactness(df: DataFrame, predicate: str, column: str) -> DataFrame:
    """compactness: over ordered pairs of different predicates, the mean of both sides' rows whose id lies
    in the overlap of their ranges, summed, by the number of predicates.

    Both sides' halves, over all ordered pairs, add up to each row once for every other predicate whose
    range holds its id. That number is a running sum over the ranges' ends, so nothing meets pairwise.
    """
    ranges = _ranges(df, predicate, column).filter("low is not null")
    zero = F.lit(0).cast("long")
    ends = ranges.select(F.col("low").alias("x"), (zero + 1).alias("w"), zero.alias("n")).unionAll(
        ranges.select((F.col("high") + 1).alias("x"), (zero - 1).alias("w"), zero.alias("n")))
    rows = df.select(F.col(column).cast("long").alias("x"), zero.alias("w"), (zero + 1).alias("n")).filter("x is not null")
    by_id = ends.unionAll(rows).groupBy("x").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
    total = running(by_id, "x", "w").agg(F.coalesce(F.sum(F.col("n") * (F.col("before") + F.col("w") - 1)), zero).alias("rows"))
    return total.crossJoin(ranges.agg(F.count(F.lit(1)).alias("predicates"))).select(
        F.when(F.col("predicates") > 0, F.col("rows") / F.col("predicates")).otherwise(0.0).alias("compactness"))


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def predicate_sizes(triples: DataFrame) -> DataFrame:
    """p, n, subjects, objects: statements and different subjects and objects of each predicate, counted
    from pairs, so that a predicate of most statements is spread over tasks."""
    counts = predicate_counts(triples)
    for c, name in (("s", "subjects"), ("o", "objects")):
        counts = counts.join(triples.select("p", c).distinct().groupBy("p").agg(F.count(F.lit(1)).alias(name)), "p")
    return counts.select("p", "n", "subjects", "objects")


def store_counts(triples: DataFrame) -> DataFrame:
    """Statements, and different subjects, predicates and objects."""
    return triples.agg(
        F.count(F.lit(1)).alias("triples"), F.count_distinct("s").alias("subjects"),
        F.count_distinct("p").alias("predicates"), F.count_distinct("o").alias("objects"))


def degrees(triples: DataFrame) -> DataFrame:
    """node, degree in the undirected graph; a loop counts twice."""
    return triples.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def degree_rank(found: DataFrame) -> DataFrame:
    """node, degree, new_id: numbers from 1 by falling degree, then by term, of what `degrees` gives."""
    return ranked(found, F.desc("degree"), F.col("node"))
