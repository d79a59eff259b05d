"""SimHash near-duplicates by a byte-position inverted index with count filtering.

Fingerprint: 64 bits over the 3-word shingles (repeats included) of the text lower-cased in A-Z, a bit
being 1 if set in over half of the shingles' XXH64 (seed 42); fewer than three words are one shingle,
none give zero. Fingerprints link at `distance` (3) or fewer differing bits.

Index: three differing bits touch at most three of the eight bytes, so linked fingerprints share at
least five positional bytes, and at least four of the first seven. A posting list of a single (position,
byte) holds a 256th of all fingerprints, and the pairs met there grow with the square of the corpus; the
posting lists are therefore those of four bytes at four of the first seven positions, 35 a fingerprint.
Count filtering: in a list the tally of shared positional bytes (of all eight) is taken for each pair of
members; pairs whose tally reaches the guaranteed minimum of five are retained, those of them in the first
of their common lists, and verified by their differing bits.

A list of more than `PAIRWISE` fingerprints is cut by one more shared byte, which every pair with a tally
of five has, so a part fixes 40 bits and holds at most 2^24 different fingerprints however large the
corpus. In a part that is still longer, the pairs come from looking up the 2,324 changes of three or fewer
of the other 24 bits of each member, so the work for a member is bounded; they are tallied and verified
like any other.

Only different fingerprints are indexed. Documents with equal fingerprints, copies among them, join
their fingerprint's class through a join on the fingerprint, never as pairs.

Edge cases: null, empty and blank texts have fingerprint zero and link like any other; a null doc_id
gets a fingerprint and its class; the class id is the smallest non-null doc_id in it (null if there
is none); repeated rows are kept; empty tables give empty results; other columns are ignored. Of a class
`representatives` names the row with the smallest doc_id (a null one last), then the smallest text hash.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triplespark.llm.common import components, discard, stored, text_or_empty
from triplespark.llm.encoding import release

BITS, BYTES, SHARED = 64, 8, 5
#: A list's bytes stand at so many of the first INDEXED positions.
INDEXED, KEY = 7, 4
#: Lists up to this length compare all pairs, so many rows at a time.
PAIRWISE, ROWS = 4_096, 128
#: Shingles whose bits are added up at once.
CHUNK = 1 << 16


def fingerprint(text: str) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # bytes: only A-Z change, and white space is \x20 and \x09-\x0d
    n = len(words) - 2
    if n <= 1:
        return xxh64_intdigest(b" ".join(words), 42) if words else 0
    joined = b" ".join(words)
    ends = list(accumulate([len(w) + 1 for w in words]))
    starts = [0, *ends[:n - 1]]
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([xxh64_intdigest(joined[a:b - 1], 42) for a, b in zip(starts[at:at + CHUNK], ends[at + 2:at + 2 + CHUNK])], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    release()
    for batch in batches:
        prints = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints.view(np.int64))], ["doc_id", "mark", "fp"])


def text_mark() -> Column:
    """A hash of the text, to tell rows with the same or no doc_id apart."""
    return F.xxhash64(text_or_empty())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, mark, fp: the text's mark, and the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long"), text_mark().alias("mark"), text_or_empty().alias("text"))
    return rows.mapInArrow(_fingerprints, "doc_id long, mark long, fp long")


@lru_cache(maxsize=1)
def _combinations() -> list[tuple[int, int]]:
    """(mask of the four positions' bits, mask of the positions) in the order of the lists."""
    return [(sum(0xFF << 8 * p for p in c), sum(1 << p for p in c)) for c in combinations(range(INDEXED), KEY)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def postings(prints: DataFrame) -> DataFrame:
    """combination, shared, fp: a row for each fingerprint and combination; a list has the first two in common."""
    masks = F.array(*[F.lit(_signed(m)) for m, _ in _combinations()])
    each = prints.select("fp", F.posexplode(masks).alias("combination", "mask"))
    return each.select("combination", F.col("fp").bitwiseAND(F.col("mask")).alias("shared"), "fp")


@lru_cache(maxsize=1)
def _neighbours(distance: int) -> np.ndarray:
    """All changes of 1 to `distance` of 24 bits."""
    return np.array([sum(1 << b for b in c) for d in range(1, distance + 1) for c in combinations(range(24), d)], dtype=np.uint32)


def _equal(diff: np.ndarray) -> np.ndarray:
    """For pairs given by their XOR: the set of equal positions."""
    equal = np.zeros(diff.shape, dtype=np.uint8)
    for p in range(BYTES):
        equal |= ((diff >> np.uint64(8 * p)) & np.uint64(0xFF) == 0).astype(np.uint8) << p
    return equal


@lru_cache(maxsize=1)
def _first_table() -> np.ndarray:
    """By the set of equal positions: the first list that two fingerprints have in common; 255 if none."""
    table = np.full(256, 255, dtype=np.uint8)
    for equal in range(256):
        for i, (_, positions) in enumerate(_combinations()):
            if equal & positions == positions:
                table[equal] = i
                break
    return table


def verified(combination: int | np.ndarray, diff: np.ndarray, distance: int, extra: int = 0) -> np.ndarray:
    """Which pairs of a list, given by their XOR, are linked and counted there: tallied, filtered by the
    tally, then verified. `extra` are positions, as a set, of parts of the list that come before this one."""
    equal = _equal(diff)
    kept = np.flatnonzero((np.bitwise_count(equal) >= SHARED) & (_first_table()[equal] == combination) & (equal & np.uint8(extra) == 0))
    return kept[np.bitwise_count(diff[kept]) <= distance]


def _by_change(combination: int, members: np.ndarray, fixed: int, distance: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a part in which five positions are fixed, by looking changes of the other bits up."""
    rest = [p for p in range(BYTES) if not fixed >> p & 1]
    low = sum(((members >> np.uint64(8 * p)) & np.uint64(0xFF)) << np.uint64(8 * i) for i, p in enumerate(rest)).astype(np.uint32)
    place = np.argsort(low)
    low, members = low[place], members[place]
    there = np.zeros(1 << 24, dtype=bool)
    there[low] = True
    found = [(low[hit], other[hit]) for change in _neighbours(distance) for other in [low ^ change] for hit in [there[other] & (low < other)] if hit.any()]
    if not found:
        return members[:0], members[:0]
    a, b = (members[np.searchsorted(low, np.concatenate(x))] for x in zip(*found))
    keep = verified(combination, a ^ b, distance, extra)
    return a[keep], b[keep]


def _pairwise(combination: int, members: np.ndarray, distance: int, extra: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a list or part, each with each, some rows at a time."""
    out = []
    for at in range(0, len(members) - 1, ROWS):
        i, j = np.triu_indices(min(ROWS, len(members) - at), 1, len(members) - at)
        a, b = members[at + i], members[at + j]
        keep = verified(combination, a ^ b, distance, extra)
        out.append((a[keep], b[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (members[:0], members[:0])


def links_within(combination: int, members: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """The linked pairs of one list that have it as their first common list."""
    members = members.astype(np.uint64)
    if len(members) <= PAIRWISE:
        return _pairwise(combination, members, distance)
    fixed, out, before = _combinations()[combination][1], [], 0
    for p in range(BYTES):  # parts by one more shared byte; a pair counts at the first that it shares
        if fixed >> p & 1:
            continue
        byte = (members >> np.uint64(8 * p)) & np.uint64(0xFF)
        order = np.argsort(byte, kind="stable")
        for part in np.split(members[order], np.flatnonzero(np.diff(byte[order])) + 1):
            if len(part) <= PAIRWISE:
                out.append(_pairwise(combination, part, distance, before))
            else:
                out.append(_by_change(combination, part, fixed | 1 << p, distance, before))
        before |= 1 << p
    return tuple(np.concatenate(x) for x in zip(*out))


def _links(distance: int):
    def close(pieces):
        c, s, f = (np.concatenate(x) for x in zip(*pieces))
        edge = np.flatnonzero((c[1:] != c[:-1]) | (s[1:] != s[:-1])) + 1
        starts, ends = np.r_[0, edge], np.r_[edge, len(c)]
        size = ends - starts
        out_a, out_b = [], []
        two = starts[size == 2]  # most lists that are no singletons: all at once
        ok = verified(c[two], (f[two] ^ f[two + 1]).view(np.uint64), distance)
        out_a.append(f[two][ok])
        out_b.append(f[two + 1][ok])
        for i in np.flatnonzero(size > 2):
            a, b = links_within(int(c[starts[i]]), f[starts[i]:ends[i]].view(np.uint64), distance)
            out_a.append(a.view(np.int64))
            out_b.append(b.view(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], ["a", "b"])

    def run(batches):
        held: list = []  # the list that the last batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            c, s, f = (x.to_numpy() for x in batch.columns)
            cut = np.flatnonzero((c[1:] != c[:-1]) | (s[1:] != s[:-1]))
            if held and (c[0] != held[-1][0][-1] or s[0] != held[-1][1][-1]):
                yield close(held)
                held = []
            if len(cut):
                last = cut[-1] + 1
                yield close([*held, (c[:last], s[:last], f[:last])])
                held = [(c[last:], s[last:], f[last:])]
            else:
                held.append((c, s, f))
        if held:
            yield close(held)

    return run


def links(prints: DataFrame, distance: int = 3) -> DataFrame:
    """a, b: all pairs of different fingerprints within the distance, each once."""
    if distance > BYTES - SHARED:
        raise ValueError(f"five shared positional bytes are only guaranteed up to distance {BYTES - SHARED}")
    lists = postings(prints).repartition("combination", "shared").sortWithinPartitions("combination", "shared")
    return lists.mapInArrow(_links(distance), "a long, b long")


def _classes(marked: DataFrame, least: Column, distance: int) -> DataFrame:
    """fp, least (the smallest of the fingerprint's rows), component: a row for each different fingerprint."""
    prints = stored(marked.groupBy("fp").agg(F.min(least).alias("least")), "prints")
    linked = components(prints.select(F.col("fp").alias("node")), links(prints.select("fp"), distance))
    return stored(prints.join(linked, prints["fp"] == linked["node"]).select("fp", "least", "component"), "classes")


def near_duplicates(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that links reach."""
    marked = stored(fingerprints(docs).drop("mark"), "fingerprints")
    named = _classes(marked, F.col("doc_id"), distance)
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    by_print = stored(named.join(least, "component").select("fp", "component_id"), "classes")  # plain scans: hot classes and fingerprints can be split
    discard(named, least)
    return marked.join(by_print, "fp").select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, distance: int = 3) -> DataFrame:
    """doc_id, mark, n: the row that stands for each class, and how many rows have its doc_id and text."""
    marked = stored(fingerprints(docs).groupBy("fp", "doc_id", "mark").agg(F.count(F.lit(1)).alias("n")), "fingerprints")
    named = _classes(marked, F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "mark", "n"), distance)
    chosen = stored(named.groupBy("component").agg(F.min("least").alias("r")).select("r.doc_id", "r.mark", "r.n"), "representatives")
    discard(marked, named)
    return chosen


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    """All documents with fingerprint and class."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
