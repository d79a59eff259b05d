"""Benchmark decontamination over a distributed positional inverted index.

Index: documents are dealt to shards of about `SHARD_BYTES` of text; each shard stores, as one row of
a Parquet table, its terms and for every term the ascending positions at which it stands (its posting
list). Positions run through the shard's documents with a gap between any two, so that no phrase and
no neighbourhood spans documents. The table can be searched for any number of test sets.

Search: every shard takes each window's terms from the rarest in the shard to the most frequent,
starts with the positions of the rarest one, less its offset in the window, and keeps those that the
other lists, each less its own offset, share. What remains are exact phrase matches. A document has a
proximity match of an item where the three rarest different terms of one of its windows stand within
`slop` words in any order, and no phrase of the item. Rare is what the test set holds seldom (at a tie
what comes first in the window), so that a match depends on the document and the test set only, not on
the shard or the other documents; the window's other terms may be missing, and a window of fewer than three different
terms has no proximity match. In a shard the least frequent of the three is the centre, each of whose
positions is tried with the nearest of the other two on either side, `CENTRES` positions at a time,
however many there are. Nothing is shuffled for a test set that fits one broadcast
block; larger test sets are searched block by block (each ends with the item with which it reaches
`BLOCK_WINDOWS` windows, the stated bound of a broadcast), one broadcast at a time, and the matches of a
document are joined over the blocks.

Words: text lower-cased in A-Z, runs of digits, letters a-z and non-ASCII characters. A window is
`width` (10) consecutive words of an item; an item of fewer, but not none, is one window.

Edge cases: null or empty text has no words and no hits; items without words have no windows; repeated
items count as separate ids, a repeated item_id once; a null item_id can hit words but is not listed;
a null doc_id and repeated rows are kept, each row by itself; empty tables give empty results or
results without hits; other columns are ignored; a document of any length stays in one shard.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import discard, stored, text_or_empty
from triplespark.llm.encoding import release, slices

SHARD_BYTES = 8_000_000
BLOCK_WINDOWS = 200_000
#: Positions that the proximity search holds at a time.
CENTRES = 1 << 18
#: Share of an item's different triples that a document must hold nearby to have the item in other words.
COVER = 0.5
#: Words between the positions of two documents; more than any slop.
GAP = 64
#: Lower-cases A-Z and blanks what separates words, byte by byte.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))

INDEX = ("task int, shard int, doc_ids array<bigint>, starts array<int>, n_words array<int>, "
         "terms array<binary>, counts array<int>, positions array<int>")
HITS = "task int, shard int, place int, doc_id long, n_words long, spans array<int>, items array<string>, near array<string>"


def words(text: str | bytes | None) -> list[bytes]:
    if text is None:
        return []
    return (text.encode() if isinstance(text, str) else text).translate(_TABLE).split()


def _index_of(texts: list[bytes | None]) -> dict:
    """The inverted index of a shard: terms, their counts and positions, and where each text starts."""
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    ids, starts, n_words, at = [], [], [], 0
    for t in texts:
        found = words(t)
        ids.append(np.fromiter((number(w, len(numbers)) for w in found), np.int32, len(found)))
        starts.append(at)
        n_words.append(len(found))
        at += len(found) + GAP
    term, n = np.concatenate(ids), np.array(n_words)
    where = np.arange(len(term), dtype=np.int32) + np.repeat(np.array(starts, dtype=np.int32) - (np.cumsum(n) - n).astype(np.int32), n)
    return {"terms": list(numbers), "counts": np.bincount(term, minlength=len(numbers)).astype(np.int32),
            "positions": where[np.argsort(term, kind="stable")].astype(np.int32), "starts": starts, "n_words": n_words}


def _shards(batches):
    task, shard = TaskContext.get().partitionId(), 0
    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        keys = batch.column(0).to_pylist()
        for a, b in slices(pc.binary_length(texts).to_pylist(), SHARD_BYTES):
            x = _index_of(texts.slice(a, b - a).to_pylist())
            row = [pa.array([task], pa.int32()), pa.array([shard], pa.int32()), pa.array([keys[a:b]], pa.list_(pa.int64())),
                   pa.array([x["starts"]], pa.list_(pa.int32())), pa.array([x["n_words"]], pa.list_(pa.int32())),
                   pa.array([x["terms"]], pa.list_(pa.binary())), _one_list(x["counts"]), _one_list(x["positions"])]
            yield pa.RecordBatch.from_arrays(row, [c.split()[0] for c in INDEX.split(", ")])
            shard += 1


def _one_list(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))


def build_index(docs: DataFrame) -> DataFrame:
    """The stored index: a row for each shard."""
    return stored(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInArrow(_shards, INDEX), "postings")


def windows_of(items: Iterable[tuple], width: int) -> Iterator[list[tuple]]:
    """(item, words) of all windows, in blocks that end with the item with which they reach BLOCK_WINDOWS
    windows; at least one block."""
    now, any_block = [], False
    for item, text in items:
        found = words(text)
        now += [(item, found[i:i + width]) for i in range(max(1, len(found) - width + 1) if found else 0)]
        if len(now) >= BLOCK_WINDOWS:
            yield now
            now, any_block = [], True
    if now or not any_block:
        yield now


def _encode_block(windows: list[tuple], width: int, rarity: Counter | None = None) -> dict:
    """A block's windows as terms; with the test set's word counts also their different rare triples, and the items of each."""
    terms: dict[bytes, int] = {}
    table = np.full((len(windows), width), -1, dtype=np.int32)
    for row, (_, found) in zip(table, windows):
        row[:len(found)] = [terms.setdefault(w, len(terms)) for w in found]
    block = {"terms": list(terms), "table": table, "items": [i for i, _ in windows]}
    if rarity is not None:
        triples: dict[tuple, set] = {}
        for item, found in windows:
            if item is not None and len(rare := sorted(dict.fromkeys(found), key=rarity.__getitem__)[:3]) == 3:
                triples.setdefault(tuple(sorted(terms[w] for w in rare)), set()).add(str(item))
        block["triples"] = np.array(list(triples), dtype=np.int32).reshape(-1, 3)
        block["triple_items"] = [tuple(x) for x in triples.values()]
    return block


def _ranges(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the slices (start, count), laid end to end, and the slice of each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts), owner


def _near(terms: np.ndarray, counts: np.ndarray, offsets: np.ndarray, positions: np.ndarray, keyed: np.ndarray, starts: np.ndarray, slop: int) -> tuple:
    """(triple, document) of each pair with a place where the triple's terms stand within slop words."""
    live = np.flatnonzero((terms >= 0).all(axis=1))
    terms = np.take_along_axis(terms[live], np.argsort(counts[terms[live]], axis=1, kind="stable"), axis=1)
    ends = np.cumsum(counts[terms[:, 0]])
    found = []
    for a in range(0, int(ends[-1]) if len(ends) else 0, CENTRES):
        flat = np.arange(a, min(a + CENTRES, int(ends[-1])))
        owner = np.searchsorted(ends, flat, "right")
        centre = positions[flat - (ends - counts[terms[:, 0]])[owner] + offsets[terms[owner, 0]]]
        sides = []
        for k in (1, 2):  # words to the nearest of a term after the centre, and before it
            term = terms[owner, k].astype(np.int64)
            right = np.searchsorted(keyed, (term << 32) + centre)
            after = keyed[np.minimum(right, len(keyed) - 1)] - (term << 32) - centre
            before = centre - keyed[np.maximum(right - 1, 0)] + (term << 32)
            up, down = np.where((after > 0) & (after <= slop), after, slop + 1), np.where((before > 0) & (before <= slop), before, slop + 1)
            ok = np.minimum(up, down) <= slop
            owner, centre = owner[ok], centre[ok]
            sides = [x[ok] for x in (*sides, up, down)]
        up, down, up2, down2 = sides
        ok = np.minimum(np.minimum(np.maximum(up, up2), np.maximum(down, down2)), np.minimum(up + down2, down + up2)) <= slop
        document = np.searchsorted(starts, centre[ok], "right") - 1
        found.append(np.unique((live[owner[ok]].astype(np.int64) << 32) + document))
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs >> 32, pairs & 0xFFFFFFFF


def search_shard(row: dict, block: dict, slop: int) -> tuple[tuple, tuple]:
    """Phrase matches in a shard, (window, first position, end) of each, and unless slop is 0 its
    proximity matches, (triple, document) of each."""
    none, no_pairs = (np.zeros(0, np.int64),) * 3, (np.zeros(0, np.int64),) * 2
    table = block["table"]
    if not len(table) or not len(row["positions"]):
        return none, no_pairs
    place = {t: i for i, t in enumerate(row["terms"])}
    local = np.array([*(place.get(t, -1) for t in block["terms"]), -2], dtype=np.int64)
    # one pseudo term at the end for what a short window lacks
    counts = np.r_[row["counts"].astype(np.int64), 0]
    offsets = np.cumsum(counts) - counts
    positions = row["positions"].astype(np.int64)
    keyed = (np.repeat(np.arange(len(counts) - 1), counts[:-1]) << 32) + positions  # ascending: the lists one after another
    near = _near(local[block["triples"]], counts, offsets, positions, keyed, np.asarray(row["starts"]), slop) if slop else no_pairs
    terms = local[table]  # -1 there reads the pseudo term
    live = np.flatnonzero((terms != -1).all(axis=1))
    if not len(live):
        return none, near
    terms = terms[live]
    many = np.where(terms == -2, np.iinfo(np.int64).max, counts[np.maximum(terms, 0)])
    order = np.argsort(many, axis=1, kind="stable")
    length = (terms != -2).sum(axis=1)

    def has(term, position):
        key = (term << 32) + position
        at = np.minimum(np.searchsorted(keyed, key), len(keyed) - 1)
        return keyed[at] == key

    rows = np.arange(len(live))
    rarest = terms[rows, order[:, 0]]
    at, owner = _ranges(offsets[rarest], counts[rarest])
    first = positions[at] - order[owner, 0]
    for k in range(1, terms.shape[1]):
        term = terms[owner, order[owner, k]]
        keep = (term == -2) | has(np.maximum(term, 0), first + order[owner, k])
        owner, first = owner[keep], first[keep]
    return (live[owner], first, first + length[owner]), near


def _union(lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Disjoint spans [low, high) that cover the same words, flat."""
    order = np.argsort(lows, kind="stable")
    lows, highs = lows[order], np.maximum.accumulate(highs[order])
    new = np.r_[True, lows[1:] > highs[:-1]]
    return np.stack([lows[new], highs[np.r_[new[1:], True]]], axis=1).ravel().astype(np.int32)


def _search(shared, slop: int, everything: bool):
    def run(batches):
        block = shared.value
        names = np.array(["" if i is None else str(i) for i in block["items"]] or [""], dtype=object)
        listed = np.array([i is not None for i in block["items"]] or [False])
        for batch in batches:
            for i in range(batch.num_rows):
                get = lambda k: batch.column(k)[i].values
                row = {"terms": get(5).to_pylist(), "counts": get(6).to_numpy(), "positions": get(7).to_numpy(), "starts": get(3).to_numpy()}
                starts, n_words = get(3).to_numpy().astype(np.int64), get(4).to_numpy()
                ids = get(2).to_pylist()
                (window, low, high), (near, near_doc) = search_shard(row, block, slop)
                doc = np.searchsorted(starts, low, "right") - 1
                spans, items, close = {}, {}, {}
                order = np.argsort(doc, kind="stable")
                doc, window, low, high = doc[order], window[order], low[order], high[order]
                for part in np.split(np.arange(len(doc)), np.flatnonzero(np.diff(doc)) + 1) if len(doc) else []:
                    d = int(doc[part[0]])
                    spans[d] = _union(low[part] - starts[d], high[part] - starts[d]).tolist()
                    own = np.unique(window[part])
                    items[d] = sorted(set(names[own[listed[own]]]))
                for d, w in zip(near_doc.tolist(), near.tolist()):
                    close.setdefault(d, set()).update(block["triple_items"][w])
                for d in close.keys() & items.keys():
                    close[d].difference_update(items[d])
                which = range(len(ids)) if everything else sorted({*spans, *close})
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0)[i].as_py()] * len(which), pa.int32()), pa.array([batch.column(1)[i].as_py()] * len(which), pa.int32()),
                    pa.array(which, pa.int32()), pa.array([ids[d] for d in which], pa.int64()), pa.array([int(n_words[d]) for d in which], pa.int64()),
                    pa.array([spans.get(d, []) for d in which], pa.list_(pa.int32())),
                    pa.array([items.get(d, []) for d in which], pa.list_(pa.string())),
                    pa.array([sorted(close.get(d, ())) for d in which], pa.list_(pa.string()))], [x.split()[0] for x in HITS.split(", ")])

    return run


def _cover(spans) -> F.Column:
    """Spans of several blocks, each flat and disjoint, as one flat disjoint list."""
    pairs = F.array_sort(F.flatten(F.transform(spans, lambda s: F.transform(
        F.sequence(F.lit(0), (F.size(s) / 2).cast("int") - 1), lambda i: F.struct(s[2 * i].alias("a"), s[2 * i + 1].alias("b"))))))
    start = F.array().cast("array<struct<a:int,b:int>>")
    merged = F.aggregate(pairs, start, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.element_at(acc, -1)["b"] >= x["a"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["a"].alias("a"), F.greatest(F.element_at(acc, -1)["b"], x["b"]).alias("b")))))
        .otherwise(F.concat(acc, F.array(x))))
    return F.flatten(F.transform(merged, lambda x: F.array(x["a"], x["b"])))


def _blocks(benchmark: DataFrame, width: int, slop: int) -> Iterator[tuple[dict, bool]]:
    """The test set's windows block by block, and whether a block is the only one. This is the stated query
    side: it passes the driver item by item, for proximity twice, as its words are counted before."""
    items = lambda: ((r[0], r[1]) for r in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator())
    rarity = Counter(w for _, t in items() for w in words(t)) if slop else None
    found = windows_of(items(), width)
    now, ahead = next(found), next(found, None)
    only = ahead is None
    while now is not None:
        yield _encode_block(now, width, rarity), only
        now, ahead = ahead, next(found, None)


def matches(index: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 20) -> DataFrame:
    """doc_id, n_words, spans, items, near: for each document of the index its hit spans, word positions
    [start, end) laid flat, the items with phrase matches, and those with proximity matches only.

    Of several blocks one is broadcast at a time, and its hits are stored before the next."""
    if slop >= GAP:
        raise ValueError(f"slop must be below {GAP}")
    found = []
    for block, only in _blocks(benchmark, width, slop):
        shared = index.sparkSession.sparkContext.broadcast(block)
        hits = index.mapInArrow(_search(shared, slop, not found), HITS)
        if only:
            return hits.drop("task", "shard", "place")
        found.append(stored(hits, "hits"))
        shared.destroy()
    kept = lambda c: F.filter(F.collect_list(c), lambda s: F.size(s) > 0)
    one = reduce(DataFrame.unionAll, found).groupBy("task", "shard", "place").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), kept("spans").alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))
    return one.select("doc_id", "n_words", _cover(F.col("spans")).alias("spans"), "items", F.array_except("near", "items").alias("near"))


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, items, near: one row for each document row."""
    found = matches(build_index(docs), benchmark, width)
    n_hit = F.aggregate(F.transform("spans", lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), "items", "near")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, slop: int = 20, cover: float = COVER) -> DataFrame:
    """The rows without a phrase match and without a covered item, with all their columns. An item is covered
    if a document has proximity matches of `cover` of its different triples of rare terms.

    Each shard's index is built and searched where its rows are, as `matches` does, and not stored: the rows
    need no join with a list of hits, which would shuffle all texts once the hits outgrow a broadcast. Of
    several blocks one is broadcast at a time, and what it leaves is stored for the next.
    """
    at = docs.columns.index("text")

    def left(shared):
        def run(batches):
            release()
            block = shared.value
            whole = Counter(i for items in block["triple_items"] for i in items)
            for batch in batches:
                texts = batch.column(at).cast(pa.binary())
                for a, b in slices([n or 0 for n in pc.binary_length(texts).to_pylist()], SHARD_BYTES):
                    row = _index_of(texts.slice(a, b - a).to_pylist())
                    keep = np.ones(b - a, dtype=bool)
                    (_, low, _), (near, doc) = search_shard(row, block, slop)
                    keep[np.searchsorted(np.array(row["starts"]), low, "right") - 1] = False
                    close = Counter((d, i) for d, w in zip(doc.tolist(), near.tolist()) for i in block["triple_items"][w])
                    keep[[d for (d, item), n in close.items() if n >= cover * whole[item]]] = False
                    yield batch.slice(a, b - a).filter(pa.array(keep))

        return run

    before = None
    for block, only in _blocks(benchmark, width, slop):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        after = docs.mapInArrow(left(shared), docs.schema)
        if only:
            return after
        docs = stored(after, "uncontaminated")
        shared.destroy()
        if before is not None:
            discard(before)
        before = docs
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near").cast("long").alias("n_near"))
