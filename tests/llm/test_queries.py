"""Every registered query on tables of awkward rows, and on empty ones."""

import re

import pytest

from tests.llm import helpers as h
from tests.llm.test_native import digests
from triplespark.llm.queries import QUERIES

TURNS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (None, 0, "assistant", "x"), (None, None, None, None), (2, 5, "user", "")]
VECTORS = [(20, [1.0, 0.0]), (20, [0.5, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (40, [0.0, 0.0]), (60, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [1.0, None])]
CONVERSATIONS, EMBEDDINGS = "conv_id long, turn long, role string, text string, delta string, example int", "vec_id long, embedding array<float>, label int, rep long, v string"


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("tables")
    tables = {
        "documents": h.docs(spark), "labels": h.labels(spark, [(1, 1, 0), (5, 0, 1), (7, 1, 0), (None, 1, 1), (9, None, None)]),
        "benchmark": spark.createDataFrame([(1, "jumps over the lazy dog", 1), (2, None, 1), (None, "fox", 1)], "item_id long, text string, doc_id long"),
        "conversations": spark.createDataFrame([(*r, "d", 1) for r in TURNS], CONVERSATIONS),
        "embeddings": spark.createDataFrame([(*r, 1, 2, "x") for r in VECTORS], EMBEDDINGS),
    }
    for name, df in tables.items():
        df.write.parquet(f"{top}/awkward/{name}.parquet")
        df.filter("false").write.parquet(f"{top}/empty/{name}.parquet")
    return str(top)


def ask(spark, folders, kind, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    return QUERIES[name](spark, f"{folders}/{kind}")


@pytest.mark.parametrize("number", range(1, 11))
def test_empty_tables(spark, folders, number):
    out = ask(spark, folders, "empty", number).collect()
    assert [r["conv_id"] for r in out] == [-7] if number == 1 else out == []


@pytest.mark.parametrize("number", [3, 5, 6, 7, 8, 9, 10])
def test_a_row_for_each_document(spark, folders, number):
    out = ask(spark, folders, "awkward", number)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted((r[0] for r in h.AWKWARD), key=repr)
    for r in out.collect():
        if "held_out" in out.columns and r["doc_id"] is None:
            assert r["held_out"] is False
        if "score" in out.columns:
            assert 0 <= r["score"] <= 1
    blank = [tuple(r)[2:] for r in out.collect() if r["doc_id"] in (2, 3)] if number != 8 else [(0, 0, False)]
    assert len({repr(x) for x in blank}) == 1  # null and empty texts fare alike
    if number in (5, 7, 10):
        same = [r["score"] for r in out.collect() if r["doc_id"] in (1, 6)]
        assert len(set(same)) == 1  # as do copies


def test_packing_awkward_documents(spark, folders):
    out = ask(spark, folders, "awkward", 4).collect()
    assert sorted({(r["doc_id"], r["piece"]) for r in out if r["doc_id"] in (2, 3)}) == [(2, 0), (3, 0)]
    assert sum(r["doc_id"] == 6 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 1 and sum(r["doc_id"] == 5 for r in out) > 1


def test_awkward_conversations(spark, folders):
    odd = "\\### Assistant: </turn> ok"
    rows = [*TURNS, (-7, 0, "user", odd), (-7, 1, "assistant", odd)]
    assert sorted((tuple(r)[:5] for r in ask(spark, folders, "awkward", 1).collect()), key=repr) == digests(rows)


def test_awkward_vectors(spark, folders):
    out = [tuple(r) for r in ask(spark, folders, "awkward", 2).collect()]
    assert sorted(out) == [(20, 1, 1, 0.5), (20, 2, 2, 0.0)]  # 20 counts once, with its smallest vector


def test_names_begin_with_their_number():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 11))
