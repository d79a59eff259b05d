"""What the operators of this subpackage share: stored tables, splits, samples, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespark.sources.shared import discard, new_path, stored, temporary

__all__ = ["components", "discard", "labelled_sample", "new_path", "remainder", "stored", "temporary", "text_or_empty"]


def remainder(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; -1 for a null key, which is in no held-out part."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod, F.lit(-1))


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, size: int) -> DataFrame:
    """(text, label) of at most `size` labelled documents that `keep` admits.

    The ids are the smallest by hash, chosen from `labels` alone, so a hot source or group has no
    say in it. At most `size` ids are broadcast: that is the documented bound of the fit. A doc_id
    with several rows contributes its first text only.
    """
    ids = (
        labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & keep)
        .groupBy("doc_id").agg(F.max(label).alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    found = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, over undirected edges (a, b).

    Alternating large-star and small-star rounds (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014): each links neighbours to the smallest among them, so a chain
    of any length takes logarithmically many rounds. Each round is written to the shared folder,
    and what it was made from is deleted. Nodes without an edge come back as their own component.
    """
    def star(e: DataFrame, large: bool) -> DataFrame:
        # hub u of (u, v): large-star takes all neighbours of u, small-star the smaller ones
        if large:
            both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        # stored, so that the join has plain scans on both sides and Spark can split a hub that many nodes link to
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "least")
        linked = both.join(least, "a")
        if large:
            moved = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = linked.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(
                least.select("a", F.col("m").alias("b")))
        after = stored(moved.filter(F.col("a") != F.col("b")).distinct(), "edges")
        discard(least, e)
        return after

    now = stored(edges.select("a", "b").filter(F.col("a") != F.col("b"))
                 .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before, seen = None, 0
    while seen != before:  # every round but the last moves a link to a smaller node, so this ends
        before, now = seen, star(star(now, True), False)
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    found = now.groupBy("a").agg(F.min("b").alias("component"))
    return nodes.join(found, nodes["node"] == found["a"], "left").select(
        "node", F.coalesce("component", "node").alias("component"))
