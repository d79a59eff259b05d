"""Quality, language and toxicity: held-out accuracy on the driver's tables, and awkward rows."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F
from tests.llm import helpers as h
from triplespark.llm import language_id, quality, toxicity
from triplespark.llm.queries import QUERIES

SF = os.environ.get("TEST_MODEL_SF_DIR", "/root/testdata/sf0.1")


def held_out(key, mod, rest):
    return zlib.crc32(str(key).encode()) % mod == rest


def accuracy(spark, name, label, mod, rest):
    out = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    known = h.rows(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label))
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r["held_out"] == held_out(k, mod, rest) for k, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out.values())
    test = [(out[k]["predicted"], y) for k, y in known if held_out(k, mod, rest)]
    return {y: np.mean([p == y for p, t in test if t == y]) for y in (0, 1)}


def test_quality_held_out(spark):
    right = accuracy(spark, "op5_quality", "quality", 4, 2)
    assert right[1] >= 0.99 and right[0] >= 0.95


def test_toxicity_held_out(spark):
    right = accuracy(spark, "op10_toxicity", "toxic", 3, 1)
    assert right[0] >= 0.99 and right[1] >= 0.85  # some labels mark texts without any insult


def test_language_held_out(spark):
    out = {r["doc_id"]: r for r in QUERIES["op7_language_id"](spark, SF).collect()}
    known = h.rows(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"))
    assert len(out) == len(known)
    test = [out[k]["lang_pred"] == lang for k, lang in known if lang and held_out(k, 4, 2)]
    assert np.mean(test) >= 0.99
    assert all(r["held_out"] == held_out(k, 4, 2) and 0 <= r["score"] <= 1 for k, r in out.items())


def test_awkward_rows(spark):
    d = h.docs(spark)
    y = h.labels(spark, [(1, 1, 0), (5, 0, 1), (5, 0, 1), (7, None, None), (None, 1, 1), (99, 1, 1)])
    always = F.lit(True)
    weights = quality.fit(d, y, always)
    assert quality.score(d, weights, "doc_id").count() == len(h.AWKWARD)
    bias = [r[1] for r in h.rows(quality.score(d, weights, "doc_id")) if r[0] in (2, 3, 4)]
    assert len(set(bias)) == 1
    assert {r[1] for r in h.rows(quality.score(d, quality.fit(d, y.filter("false"), always), "doc_id"))} == {0.5}
    assert quality.score(h.docs(spark, []), weights, "doc_id").count() == 0
    model = toxicity.fit(d, y, always)
    assert toxicity.score(d, model, "doc_id").count() == len(h.AWKWARD)
    assert toxicity.score(d, toxicity.fit(d, y.filter("false"), always), "doc_id").filter("predicted = 1").count() == 0
    found = language_id.fit(d, always)
    out = {r[0]: r for r in h.rows(language_id.identify(d, found, "doc_id"))}
    assert out[2][1:] == ("und", 0.0) and out[3][1:] == ("und", 0.0) and out[4][1:] == ("und", 0.0) and out[9][1:] == ("und", 0.0)
    assert out[7][1] == "de" and out[1][1] == "en"
    nothing = language_id.fit(d.filter("false"), always)
    assert {r[1] for r in h.rows(language_id.identify(d, nothing, "doc_id"))} == {"und"}


def distance(a, b):
    """Letters more, less or other, and neighbours swapped."""
    table = [list(range(len(b) + 1))]
    for i, x in enumerate(a, 1):
        row, last = [i], table[-1]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], table[-2][j - 2] + 1)
        table.append(row)
    return table[-1][-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abcx", max_size=8), st.lists(st.text("abc", min_size=3, max_size=7), min_size=1, max_size=4), st.lists(st.text("abc", min_size=4, max_size=5), max_size=1))
def test_automaton_is_the_edit_distance(word, whole, stems):
    found = (toxicity.Automaton([(w, False, 1.0) for w in whole] + [(s, True, 1.0) for s in stems]).find(word) or ("",))[0]
    if any(word.startswith(s) for s in stems):
        expected = {"stem"}
    elif word in whole:
        expected = {"exact"}
    elif any(len(w) >= toxicity.FUZZY and distance(word, w) == 1 for w in whole):
        expected = {"fuzzy"}
    else:
        expected = {""}
    assert found in expected


@settings(max_examples=400, deadline=None)
@given(st.text("abcx", max_size=9), st.lists(st.text("abc", min_size=3, max_size=7), max_size=3), st.lists(st.text("abc", min_size=4, max_size=7), min_size=1, max_size=2))
def test_stems_admit_an_edit(word, whole, stems):
    found = (toxicity.Model([(w, False, 1.0) for w in whole] + [(s, True, 1.0) for s in stems], toxicity.PRIOR).automaton.find(word) or ("",))[0]
    fuzzy = any(len(w) >= toxicity.FUZZY and distance(word, w) == 1 for w in whole)
    fuzzy |= any(len(s) >= toxicity.FUZZY and distance(word[:k], s) == 1 for s in stems for k in range(len(word) + 1))
    expected = "stem" if any(word.startswith(s) for s in stems) else "exact" if word in whole else "fuzzy" if fuzzy else ""
    assert found == expected


def test_misspelled_stems_and_words_under_stems():
    rows = [(f"nice day bomeraz{e} told", 1) for e in ("a", "eb", "ic", "od", "uf", "yg")] * 3 + [("bome" + e + " night", 1) for e in ("lla", "lla x", "lla y", "lla z", "lla q", "rr", "tt", "vv", "ww", "nn", "ss")]
    rows = [(f"{t} {i}", y) for i, (t, y) in enumerate(rows)] + [(f"nice day told night {i}", 0) for i in range(200)]
    terms = toxicity.learn_terms(rows)
    assert ("bome", True) in {t[:2] for t in terms} and ("bomella", False) in {t[:2] for t in terms}
    model = toxicity.Model(terms, toxicity.PRIOR)
    assert model.automaton.find("bomella")[0] == "stem" and model.automaton.find("bxmella")[0] == "fuzzy"
    stem = toxicity.Model([("achke", True, 2.0)], toxicity.PRIOR)
    assert [stem.automaton.find(w) for w in ("achkelund", "axhkelund", "ahkelund", "acxhkelund", "axxkelund")] == [("stem", 2.0), *[("fuzzy", 2.0)] * 3, None]
    assert stem.counts(["a axhkelund"])[0, 2] == 2.0


def test_quotation_scores_below_abuse():
    model = toxicity.Model([("idiot", False, 4.0), ("moron", False, 4.0)], toxicity.PRIOR)
    assert model.automaton.find("idoit") == ("fuzzy", 4.0) and model.automaton.find("idito") == ("fuzzy", 4.0) and model.automaton.find("iditoo") is None
    direct, quoted, spelt, clean = model.scores(model.counts([
        "you are an idiot and a moron and an idiot, you", 'the paper said "what an idiot" and "moron" and "idiot" yesterday', "you idiott, you mor0n and idoit, moronn", "a fine day"]))
    assert direct > spelt > quoted > clean


def test_long_texts_keep_their_density():
    model = toxicity.Model([("idiot", False, 4.0)], toxicity.PRIOR, rate=0.02)
    text = lambda every, n: " ".join("idiot" if i % every == 0 else "calm" for i in range(n))
    few, many = model.scores(model.counts([text(2_000, 60_000), text(20, 60_000)]))
    assert few < 0.01 and many > 0.99
    features = model.features(model.counts([text(20, 60_000)]))[0]
    assert features[0] == toxicity.MOST and features[5] == toxicity.MOST * 60_000 * 0.02 / (3_000 * 4.0)


def plain_hits(text, find):
    """Weights of direct, quoted, misspelled and misspelled quoted hits, and addressed hits, word by word."""
    strip = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w)
    found, out = text.lower().split(), [0.0] * 5
    for i, w in enumerate(found):
        kind = find(strip(w))
        if not kind:
            continue
        before, after = found[max(0, i - 8):i], found[i + 1:i + 9]
        opened = w[0] in "\"'“‘«„‚" or any(x[0] in "\"'“‘«„‚" and x[-1] not in "\"'”’»“‘" for x in before)
        closes = lambda x: (x.rstrip(".,;:!?") or " ")[-1] in "\"'”’»“‘"
        closed = closes(w) or any(closes(x) and x[0] not in "\"'“‘«„‚" for x in after)
        around = {strip(x) for x in before + after}
        quoted = opened and closed or bool(around & toxicity.REPORTING)
        out[2 * (kind[0] == "fuzzy") + quoted] += kind[1]
        out[4] += not quoted and bool(around & toxicity.SECOND)
    return out, len(found)


def test_toxicity_scores_are_what_they_are_said_to_be():
    rng = random.Random(3)
    bits = ["idiot", "idoit", "mor0n", "moron", '"moron"', "you", "said", "'what", "an", "end'", "fine", "day", "achkeln", "axhkeln", "…", "word."]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "idiot " * 400]
    model = toxicity.Model([("idiot", False, 4.0), ("moron", False, 3.0), ("achke", True, 2.0)], np.array([1.0, 0.1, 0.6, 0.05, 0.3, -1.0, -4.0]), rate=0.01)

    def find(word):
        for term, weight in (("idiot", 4.0), ("moron", 3.0)):
            if word == term:
                return "exact", weight
        if word.startswith("achke"):
            return "stem", 2.0
        near = [(4.0, "idiot"), (3.0, "moron")]
        hits = [w for w, term in near if distance(word, term) == 1] + [2.0 for k in range(len(word) + 1) if distance(word[:k], "achke") == 1]
        return ("fuzzy", max(hits)) if hits else None

    expected = []
    for t in texts:
        evidence, n = plain_hits(t, find)
        evidence = [*evidence, n * 0.01]
        scale = 40 / max(40, *evidence)
        expected.append(1 / (1 + math.exp(-sum(x * scale * w for x, w in zip(evidence, [1.0, 0.1, 0.6, 0.05, 0.3, -1.0])) + 4.0)))
    assert np.allclose(model.scores(model.counts(texts)), expected, atol=1e-9)


def plain_quality(rows):
    """The classifier again, with dictionaries: FTRL-proximal over hashed words and pairs of words."""
    size, z, n, w = 1 << quality.BITS, {}, {}, {}

    def features(text):
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[^\s0-9A-Za-z\x80-\xff]+", text.encode())
        raw = [zlib.crc32(t) for t in tokens]
        codes = [0xA3B19535 if i and raw[i - 1] == c else 0x51ED270B if t.isupper() and len(t) > 1 else c for i, (t, c) in enumerate(zip(tokens, raw))]
        counts = Counter((c * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BITS for c in codes)
        for a, b in zip(codes, codes[1:]):
            pair = (a * 0x9E3779B1 & 0xFFFFFFFF) ^ (b + (b >> 7) & 0xFFFFFFFF)
            counts[(pair * 0x9E3779B1 & 0xFFFFFFFF) >> 32 - quality.BITS] += 1
        values = {c: 1 + math.log(k) for c, k in counts.items()}
        norm = math.sqrt(sum(v * v for v in values.values())) or 1
        return {**{c: v / norm for c, v in values.items()}, size: 1.0}

    for epoch in range(quality.EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = features(rows[k][0]), rows[k][1]
            p = 1 / (1 + math.exp(-sum(v * w.get(c, 0.0) for c, v in x.items())))
            for c, v in x.items():
                g, old = (p - y) * v, n.get(c, 0.0)
                z[c] = z.get(c, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / quality.ALPHA * w.get(c, 0.0)
                n[c] = old + g * g
                shrunk = max(abs(z[c]) - (0 if c == size else quality.L1), 0)
                w[c] = -math.copysign(shrunk, z[c]) / ((quality.BETA + math.sqrt(n[c])) / quality.ALPHA + quality.L2)
    return lambda text: 1 / (1 + math.exp(-sum(v * w.get(c, 0.0) for c, v in features(text).items())))


def test_quality_equals_plain_ftrl(spark):
    rng = random.Random(8)
    word = lambda y: rng.choice(["good", "fine", "The", "sea", "été"] if y else ["BUY", "NOW", "!!", "click", "click", "spam"])
    rows = sorted((" ".join(word(y) if rng.random() < 0.8 else word(1 - y) for _ in range(rng.randint(0, 25))), y) for y in [0, 1] * 60)
    plain, weights = plain_quality(rows), quality.train(rows)
    texts = [t for t, _ in rows[:40]] + ["", "the good sea", "CLICK CLICK now"]
    df = h.docs(spark, list(enumerate(texts)))
    out = {r["doc_id"]: r for r in quality.score(df, weights, "doc_id").collect()}
    assert all(abs(out[i]["score"] - plain(t)) < 1e-6 and out[i]["predicted"] == (plain(t) >= 0.7) for i, t in enumerate(texts))


def plain_grams(text):
    """N-grams of 2 to 4 bytes of the words, lower-cased, with a blank at either end."""
    lower = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
    out = []
    for w in (text or "").encode().translate(lower).split():
        padded = b" " + w + b" "
        out += [padded[i:i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)]
    return out


def test_language_filters_return_all_languages_of_each_gram(spark):
    rows = h.rows(spark.read.parquet(f"{h.SF}/documents.parquet").filter("lang is not null and text is not null").select("text", "lang"))
    model = language_id.Filters.fit(rows)
    counts = {x: Counter(g for t, lang in rows if lang == x for g in plain_grams(t)) for x in model.languages}
    holds = {x: {g for g, n in c.items() if n >= 2 and n / c.total() >= language_id.RATE} for x, c in counts.items()}
    every = sorted(set().union(*counts.values()))
    code = lambda g: ((v := (int.from_bytes(g) + len(g)) * 2654435761 & 0xFFFFFFFF) ^ v >> 15)
    where = language_id._slots(np.array([code(g) for g in every], dtype=np.uint32))
    masks = model.slots[0][where[0]] & model.slots[0][where[1]] & model.slots[0][where[2]]
    for i, x in enumerate(model.languages):
        bit = (masks >> np.uint64(i)) & np.uint64(1) == 1
        member = np.array([g in holds[x] for g in every])
        assert bit[member].all()  # none is missing
        wrong = bit[~member].mean()
        assert wrong < 0.02 and abs(wrong - model.rates[i]) < 0.01  # others are, as often as the correction assumes
    assert max(sum(g in s for s in holds.values()) for g in every) >= 3  # and many belong to several
    texts = [t for t, _ in rows[:60]]
    exact = [[sum(g in holds[x] for g in plain_grams(t)) for x in model.languages] for t in texts]
    found = model.scores(texts)
    total = np.array([len(plain_grams(t)) for t in texts])
    assert (np.abs(found - exact) <= 0.02 * total[:, None] + 3).all()
    assert [model.languages[int(np.argmax(e))] for e in exact] == model.predict(texts)[0]


def test_language_ties_and_a_doc_id_of_many_rows(spark):
    rows = [("same words here " * 4, "b"), ("same words here " * 4, "a")]
    assert language_id.Filters.fit(rows).predict(["same words"])[0] == ["a"]
    many = [(1, f"le chat noir {i // 100}", "fr") for i in range(300)] + [(2, "the black cat is here", "en"), (2, "the black cat is here", "en"), (3, "the dog is here", "en")]
    taken, plain = language_id.fit(h.docs(spark, many), F.lit(True)), language_id.Filters.fit([r[1:] for r in many])
    assert taken.languages == ["en", "fr"] and taken.prior == 1 and (taken.slots == plain.slots).all()  # equal rows count as often as they are there


def test_language_masks_hold_all_languages_of_a_gram():
    common, other = "brovnik staldet grimosk ", "zuqqa yjxxi qwzzo "
    rows = [(common * 9 + "aaa " * 3, "a"), (common * 9 + "bbb " * 3, "b")] + [(other * 9, "c")] * 5
    model = language_id.Filters.fit(rows)
    evidence = model.scores([common])[0]
    assert min(evidence[:2]) > 0.9 * len(language_id.grams([common])[0]) and evidence[2] < 1
    assert model.predict([common, common + "aaa", common + "bbb", other])[0] == ["a", "a", "b", "c"]


def test_language_masks_cover_many_languages():
    rows = [(f"{chr(97 + i // 26)}{chr(97 + i % 26)}zq " * 5 + f"{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 5, f"l{i:02}") for i in range(70)]
    model = language_id.Filters.fit(rows)
    assert model.slots.shape[0] == 2
    assert np.mean([p == lang for p, (_, lang) in zip(model.predict([t for t, _ in rows])[0], rows)]) > 0.9
