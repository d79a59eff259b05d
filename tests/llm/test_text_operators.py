"""Packing, token counts, decontamination and SimHash against the plain way."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import helpers as h
from triplespark.llm import decontamination, packing, simhash, token_counts
from triplespark.llm.common import components, new_path
from triplespark.llm.encoding import Encoder, tokenizer_path

PIECES = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "é", "9", "12", "!", "<|endoftext|>", "<|", "\x1c", "İ", "Σ", "漢字", "don't", "\r\n", "|", "The", "the,"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_ids_are_the_librarys(name):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path(name))
    ids, counts = Encoder(tokenizer_path(name), True), Encoder(tokenizer_path(name), False)

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=4))
    def same(texts):
        expected = [e.ids for e in whole.encode_batch(texts, add_special_tokens=False)]
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(texts)] == expected
        assert list(counts(texts)) == [len(x) for x in expected]

    same()


def test_packing(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    out = h.rows(packing.pack(h.docs(spark)))
    expected = []
    for key, text, _ in h.AWKWARD:
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 1]
        expected += [(key, i, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 4096))]
    assert sorted((r[:5] for r in out), key=repr) == sorted(expected, key=repr)
    by = defaultdict(list)
    for r in out:
        by[r[5]].append((r[6], r[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(h.docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_is_best_fit(sizes):
    capacity = 40
    counts = np.bincount(sizes, minlength=capacity + 1) if sizes else np.zeros(capacity + 1, int)
    runs, opened = packing.plan(counts, capacity)
    gaps = []  # one document at a time, longest first, into the smallest gap that fits
    for n in sorted(sizes, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    assert opened == len(gaps)
    fill, seen = defaultdict(list), defaultdict(int)
    for n in sizes:
        own = runs[(runs[:, 0] == n) & (runs[:, 1] <= seen[n])][-1]
        i = seen[n] - own[1]
        fill[own[2] + i // own[4]].append((own[3] + i % own[4] * n, n))
        seen[n] += 1
    for parts in fill.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity


def test_token_counts_and_cache(spark):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    cache = new_path(spark, "cache")
    first = h.rows(token_counts.count_tokens(h.docs(spark, h.AWKWARD[:6]), cache))
    out = h.rows(token_counts.count_tokens(h.docs(spark), cache))
    expected = [(k, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t, _ in h.AWKWARD]
    assert sorted((r[:4] for r in out), key=repr) == sorted(expected, key=repr)
    assert not any(r[4] for r in first)
    known = {t or "" for _, t, _ in h.AWKWARD[:6]}
    assert sorted((r[0], r[4]) for r in out if r[0]) == sorted((k, (t or "") in known) for k, t, _ in h.AWKWARD if k)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("digest").distinct().count() == len({t or "" for _, t, _ in h.AWKWARD})
    assert token_counts.count_tokens(h.docs(spark, []), cache).count() == 0


def words(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().translate(lower))


def contaminated(texts, items, width=10):
    windows = defaultdict(set)
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows[tuple(w[k:k + width])].add(i)
    out = []
    for key, t in texts:
        w, hit, found = words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    found |= windows[tuple(w[k:k + n])]
                    hit |= set(range(k, k + n))
        out.append((key, len(w), len(hit), sorted({str(i) for i in found if i is not None})))
    return out


@pytest.mark.parametrize("block", [200_000, 7])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    rng = random.Random(3)
    vocabulary = ["ab", "cd", "ef", "É", "9"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, text(14)), (2, text(3)), (3, None), (4, ""), (5, "the lazy dog"), (5, "the lazy dog"), (None, text(4)), (10, "fox JUMPS over"), (11, text(30))]
    rows = [*h.AWKWARD, *((100 + i, text(rng.randint(0, 60))) for i in range(60)), (200, (items[0][1] + " - ") * 3), (201, items[8][1])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    out = h.rows(decontamination.contamination(h.docs(spark, rows), benchmark))
    expected = contaminated([r[:2] for r in rows], items)
    assert sorted(((*r[:3], list(r[3])) for r in out), key=repr) == sorted(expected, key=repr)
    assert all(not set(r[3]) & set(r[4]) for r in out)
    kept = decontamination.clean(h.docs(spark, rows), benchmark, cover=2.0)
    assert kept.columns == h.docs(spark, rows).columns
    assert sorted(h.rows(kept.select("doc_id", "text")), key=repr) == sorted((r[:2] for r, e in zip(rows, expected) if not e[2]), key=repr)
    none = benchmark.filter("false")
    assert {r[2] for r in h.rows(decontamination.contamination(h.docs(spark, rows), none))} == {0}
    assert decontamination.contamination(h.docs(spark, []), benchmark).count() == 0


def test_proximity(spark):
    benchmark = spark.createDataFrame([("p", "one two three four five six seven eight nine ten")], "item_id string, text string")
    near = "ten nine x eight seven six y five four z three two one"
    far = " ".join(["ten", *["x"] * 30, "nine", *["x"] * 30, "eight seven six five four three two", *["x"] * 30, "one"])
    out = {r[0]: r for r in h.rows(decontamination.contamination(h.docs(spark, [(1, near), (2, far), (3, "nothing")]), benchmark))}
    assert out[1][4] == ["p"] and out[1][2] == 0
    assert out[2][4] == [] and out[3][4] == []


@pytest.mark.parametrize("block", [200_000, 7])
def test_clean_takes_items_in_other_words(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", block)
    rng = random.Random(9)
    item = [f"word{i}" for i in range(24)]
    benchmark = spark.createDataFrame([("p", " ".join(item)), ("q", " ".join(f"other{i}" for i in range(24)))], "item_id string, text string")
    edited = [w if i % 8 != 3 else "changed" for i, w in enumerate(item)]  # no ten words in a row are left
    parts = [item[i:i + 4] for i in range(0, 24, 4)]
    rng.shuffle(parts)
    rows = [(1, " ".join(item)), (2, " ".join(edited)), (3, " ".join(item[:9])), (4, "nothing of the kind"), (None, None), (5, " ".join(item[::6]))]
    near = {r[0]: (r[2], r[4]) for r in h.rows(decontamination.contamination(h.docs(spark, rows), benchmark))}
    assert near[2] == (0, ["p"]) and near[4] == (0, [])
    assert sorted(r["doc_id"] or 0 for r in decontamination.clean(h.docs(spark, rows), benchmark).collect()) == [0, 3, 4, 5]


def plain_near(text, rare, slop=20):
    at = [[i for i, w in enumerate(words(text)) if w == r] for r in rare]
    return any(max(x) - min(x) <= slop for x in itertools.product(*at))


@pytest.mark.parametrize("centres", [1 << 18, 5])
def test_proximity_of_frequent_terms_in_any_shard(spark, monkeypatch, centres):
    monkeypatch.setattr(decontamination, "CENTRES", centres)
    benchmark = spark.createDataFrame([("p", "one two threeee four fiveeee six seveeen eight nine ten"), ("q", "a a a b a b b a b a"), ("r", "one two four six eight nine ten")], "item_id string, text string")
    rare = [b"fiveeee", b"seveeen", b"threeee"]  # once in the test set, the others twice
    rng = random.Random(5)
    hot = "seveeen x six threeee y nine fiveeee"
    assert plain_near(hot, rare)
    rows = [(i, hot) for i in range(100)] + [(100, "one two threeee changed fiveeee six seveeen eight nine ten")]
    rows += [(200 + i, " ".join(rng.choice(["threeee", "fiveeee", "seveeen", *["z"] * 30]) for _ in range(rng.randint(0, 120)))) for i in range(100)]
    rows.append((400, " ".join(["threeee", *["z"] * 12, "fiveeee", *["z"] * 6, "seveeen", *["z"] * 11, "threeee"])))  # the nearest ones are too far apart
    rows.append((401, " ".join(["seveeen", *["z"] * 11, "fiveeee", *["z"] * 12, "threeee", "z", "seveeen"])))
    found = {r[0]: r[4] for r in h.rows(decontamination.contamination(h.docs(spark, rows), benchmark))}
    assert found == {k: ["p"] if plain_near(t, rare) else [] for k, t in rows}
    assert all(found[i] == ["p"] for i in [*range(101), 400, 401])
    alone = h.rows(decontamination.contamination(h.docs(spark, [rows[100]]), benchmark))
    assert alone[0][4] == ["p"]


def plain_fingerprint(text):
    import xxhash

    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(lower))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_components(keys, prints, distance=3):
    parent = list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= distance:
                parent[root(i)] = root(j)
    least = {}
    for i, k in enumerate(keys):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return [least.get(root(i)) for i in range(len(keys))]


def test_simhash(spark):
    rng = random.Random(5)
    base = [f"t{rng.randint(0, 10**6)}" for _ in range(300)]
    rows = list(h.AWKWARD)
    for i in range(80):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(300)] = "other"
        rows.append((1000 + i, " ".join(w)))
    prints = [plain_fingerprint(r[1]) for r in rows]
    out = h.rows(simhash.near_duplicates(h.docs(spark, rows)))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    expected = [(r[0], signed(p), c) for r, p, c in zip(rows, prints, plain_components([r[0] for r in rows], prints))]
    assert sorted(out, key=repr) == sorted(expected, key=repr)
    assert simhash.near_duplicates(h.docs(spark, [])).count() == 0


@pytest.mark.parametrize("spread,pairwise", [(13, 4_096), (20, 700), (30, 4_096)])
def test_links_in_long_lists(monkeypatch, spread, pairwise):
    monkeypatch.setattr(simhash, "PAIRWISE", pairwise)
    rng = np.random.default_rng(0)
    low = np.unique(rng.integers(0, 1 << spread, 6_000, dtype=np.uint64))  # four bytes equal, the others dense or less so
    low = np.unique(np.concatenate([low, *(low[:500] ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 32, (3, 2)))]))
    # the four positions of a list are fixed, here the last of the indexed ones
    for combination in (0, len(simhash._combinations()) - 1):
        rest = [p for p in range(8) if not simhash._combinations()[combination][1] >> p & 1]
        members = sum(((low >> np.uint64(8 * i)) & np.uint64(0xFF)) << np.uint64(8 * p) for i, p in enumerate(rest))
        a, b = simhash.links_within(combination, members, 3)
        assert len(members) > pairwise
        expected = set()
        for i in range(len(members)):
            diff = members[i] ^ members[i + 1:]
            for j in np.flatnonzero(np.bitwise_count(diff) <= 3):
                if first_common(int(diff[j])) == combination:
                    expected.add(frozenset((int(members[i]), int(members[i + 1 + j]))))
        found = [frozenset(x) for x in zip(a.tolist(), b.tolist())]
        assert len(found) == len(set(found)) and set(found) == expected


def first_common(diff):
    """The number of the first choice of four of the first seven positions at which two fingerprints are equal."""
    same = [p for p in range(8) if not diff >> 8 * p & 0xFF]
    return next((i for i, c in enumerate(itertools.combinations(range(7), 4)) if set(c) <= set(same)), None)


def test_the_tally_filters_before_the_bits_are_counted():
    diff = np.array([0x07, 0x010101, 0x01010101, 0x0F, 0x0101010101010101], dtype=np.uint64)
    tally = np.bitwise_count(simhash._equal(diff))
    assert tally.tolist() == [7, 5, 4, 7, 0]
    for d, t in zip(diff, tally):
        lists = [i for i in range(len(simhash._combinations())) if len(simhash.verified(i, np.array([d]), 3))]
        assert lists == ([first_common(int(d))] if t >= 5 and bin(int(d)).count("1") <= 3 else [])


def test_every_linked_pair_meets_in_a_list():
    for c in itertools.combinations(range(64), 3):
        diff = sum(1 << b for b in c)
        if (first := first_common(diff)) is None or c[0] % 8 or c[1] % 8 or c[2] % 8:
            assert first is not None
            continue
        assert len(simhash.verified(first, np.array([diff], dtype=np.uint64), 3)) == 1


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (500, 502), (7, 7)]
    nodes = [*range(201), 500, 501, 502, 900]
    out = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(edges, "a long, b long"))
    assert dict(h.rows(out)) == {n: 0 if n <= 200 else 500 if n < 900 else 900 for n in nodes}


def test_queries_on_the_tables(spark):
    """The registered queries against brute force over the smallest driver tables."""
    from triplespark.llm.queries import QUERIES

    texts = h.rows(spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text"))
    items = h.rows(spark.read.parquet(f"{h.SF}/benchmark.parquet").select("item_id", "text"))
    out = QUERIES["op6_decontamination"](spark, h.SF)
    digest = lambda found: hashlib.sha256(",".join(found).encode()).hexdigest()
    assert sorted(tuple(r)[:6] for r in out.collect()) == sorted((k, n, hit, len(f), digest(f), hit > 0) for k, n, hit, f in contaminated(texts, items))
    prints = [plain_fingerprint(t) for _, t in texts]
    classes = plain_components([k for k, _ in texts], prints)
    assert sorted(h.rows(QUERIES["op9_simhash"](spark, h.SF))) == sorted((k, f"{p:016x}", c) for (k, _), p, c in zip(texts, prints, classes))


def test_token_queries_on_the_tables(spark):
    """The registered packing and counting against the tokenizers' own ids, text by text."""
    from tokenizers import Tokenizer
    from triplespark.llm.queries import QUERIES

    texts = h.rows(spark.read.parquet(f"{h.SF}/documents.parquet").select("doc_id", "text"))
    count, pack = (Tokenizer.from_file(tokenizer_path(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    expected = [(k, len((t or "").encode()), n := len(count.encode(t or "", add_special_tokens=False).ids), n > 1024) for k, t in texts]
    assert sorted(tuple(r)[:4] for r in QUERIES["op8_token_counts"](spark, h.SF).collect()) == sorted(expected)
    pieces = [p for k, t in texts for p in plain_pieces(pack, k, t)]
    out = h.rows(QUERIES["op4_best_fit_packing"](spark, h.SF))
    assert sorted(r[:5] for r in out) == sorted(pieces)
    assert_gapless(out)
    gaps = []  # sequential best-fit, longest first
    for n in sorted((p[3] for p in pieces), reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
        gaps.append((min(fit) if fit else 4096) - n)
    assert len({r[5] for r in out}) == len(gaps)


def plain_pieces(tokenizer, key, text):
    ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
    return [(key, i, at, len(ids[at:at + 4096]), zlib.crc32(np.array(ids[at:at + 4096], "<u4").tobytes())) for i, at in enumerate(range(0, len(ids), 4096))]


def assert_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[5]].append((r[6], r[3]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_plans_of_many_runs_are_applied_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_RUNS", 3)
    rng = random.Random(1)
    rows = [(i, " ".join(["word"] * rng.randint(0, 3_000))) for i in range(60)]
    out = h.rows(packing.pack(h.docs(spark, rows)))
    assert_gapless(out)
    monkeypatch.setattr(packing, "BLOCK_RUNS", 1_000_000)
    whole = h.rows(packing.pack(h.docs(spark, rows)))
    assert sorted(r[:5] for r in out) == sorted(r[:5] for r in whole) and len({r[5] for r in out}) == len({r[5] for r in whole})
