"""Patterns, joins and results: goldens, a naive evaluator, all orders, and DuckDB over the driver's tables."""

import itertools
import os
import random
import re

import duckdb
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.fixtures import GRAPH
from triplespark import catalog
from triplespark.operators import bgp
from triplespark.operators.bgp import evaluate
from triplespark.plans import planner
from triplespark.plans.ast import Pattern, Query, Var
from triplespark.plans.sparql import parse
from triplespark.sources.relations import Mapped, Relation, Triples
from triplespark.sources.store import Dataset

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def v(x):
    return Var(x[1:]) if x.startswith("?") else x


def query(text, select=None):
    patterns = tuple(Pattern(*map(v, t.split())) for t in text.split(" . "))
    names = tuple(dict.fromkeys(n for t in patterns for n in t.variables))
    return Query(tuple(select.split()) if select else names, patterns)


def naive(triples, q):
    """Every binding by trying every triple for every pattern."""
    found = [{}]
    for t in q.patterns:
        grown = []
        for b in found:
            for triple in set(triples):
                new = dict(b)
                for x, value in zip(t.places, triple):
                    if (new.setdefault(x.name, value) if isinstance(x, Var) else x) != value:
                        break
                else:
                    grown.append(new)
        found = [dict(x) for x in {tuple(sorted(b.items())) for b in grown}]
    return sorted({tuple(b[n] for n in q.select) for b in found})


@pytest.fixture(scope="module")
def graph(spark):
    return Triples(spark.createDataFrame(GRAPH + GRAPH[:3], "s string, p string, o string").cache())


def run(graph, q):
    return sorted(tuple(r) for r in evaluate(q, graph).collect())


@pytest.mark.parametrize("text,select,count", [
    ("3 7 ?o", None, 3), ("3 ?p 20", None, 2), ("3 ?p ?o", None, 8), ("?s 7 20", None, 2), ("?s 6 ?o", None, 7), ("?s ?p 20", None, 3), ("?s ?p ?o", None, 23),
    ("?x 6 ?a . ?x 7 ?b", None, 13), ("?x 6 ?a . ?x 7 ?b", "x", 2), ("?x 6 ?a . ?x 7 ?b . ?x 8 ?c", None, 4), ("?x 6 ?y . ?y 7 ?z", None, 3), ("?x 6 ?y . ?y 25 ?z", None, 2),
    ("?x 6 ?y . ?z 7 ?y", None, 2), ("?x 6 ?y . ?x 7 ?y", None, 1), ("?x 8 ?y . ?x 9 ?y", None, 0), ("?x 6 ?x", None, 1), ("?x ?p ?x", None, 2), ("?s ?p ?o . ?p ?q ?r", None, 23),
    ("3 7 20 . ?s 8 ?o", None, 2), ("3 7 21 . ?s 8 ?o", None, 0), ("?a 8 ?b . ?c 9 ?d", None, 4), ("?a 8 ?b . ?c 9 ?d", "a", 2), ("?s nothing ?o", None, 0), ("?a 4 ?b . ?c nothing ?d", "a", 0),
    ("?a 6 ?b . ?b 7 ?c . ?d 6 ?b . ?d 7 ?c", None, None), ("?a ?p ?b . ?b ?p ?c . ?c ?p ?a", None, None),
])
def test_goldens(graph, text, select, count):
    q = query(text, select)
    rows = run(graph, q)
    assert rows == naive(GRAPH, q)
    assert count is None or len(rows) == count


def test_columns_follow_the_select(graph):
    assert evaluate(query("?x 6 ?a . ?x 7 ?b", "b x"), graph).columns == ["b", "x"]


def test_many_columns(graph):
    q = query(" . ".join(f"?v{i} 6 ?v{i + 1}" for i in range(11)))
    assert run(graph, q) == naive(GRAPH, q) != []


TERM = st.sampled_from(["1", "2", "3", "6"])
PLACE = st.one_of(TERM, st.sampled_from(["?a", "?b", "?c", "?d"]))


def test_random_patterns_in_any_order(spark):
    rng = random.Random(11)
    triples = list({tuple(rng.choice("1236") for _ in range(3)) for _ in range(18)})
    relation = Triples(spark.createDataFrame(triples, "s string, p string, o string").cache())

    @settings(max_examples=25, deadline=None, suppress_health_check=list(HealthCheck))
    @given(st.lists(st.tuples(PLACE, PLACE, PLACE), min_size=1, max_size=3), st.randoms())
    def same(places, r):
        q = query(" . ".join(" ".join(t) for t in places))
        if not q.select:
            return
        select = tuple(n for n in q.select if r.random() < 0.6) or q.select
        expected = naive(triples, Query(select, q.patterns))
        shuffled = list(q.patterns)
        r.shuffle(shuffled)
        assert run(relation, Query(select, tuple(shuffled))) == expected

    same()


def test_every_order_of_a_chain(graph):
    q = query("?x 6 ?y . ?y 7 ?z . ?x 8 ?w", "x z")
    expected = naive(GRAPH, q)
    for patterns in itertools.permutations(q.patterns):
        assert run(graph, Query(q.select, patterns)) == expected


@pytest.mark.parametrize("text,kind", [
    ("?a p ?b . ?b p ?c", "linear"), ("?a p ?b . ?a q ?c . ?a r ?d", "star"), ("?a p ?b . ?a q ?c . ?a r ?d . ?d s ?e", "star-based"),
    ("?o p ?a . ?o q ?b . ?o r ?c . ?c s ?d . ?c t ?e", "snowflake"), ("?a p ?b . ?a p ?c . ?a p ?d . ?b p ?c . ?b p ?d . ?c p ?d", "other"),
])
def test_shapes(text, kind):
    assert planner.shape(query(text)) == kind


def test_plan_uses_sizes_and_semi_joins():
    q = query("?a big ?b . ?a small ?c . ?a mid ?d", "a")
    steps = planner.plan(q, {"big": 10**6, "small": 10, "mid": 1000})[0]
    assert [s.pattern.p for s in steps] == ["small", "mid", "big"] and [s.op for s in steps] == ["scan", "semi", "semi"]
    assert "star" in planner.explain(q, {}) and planner.dot(q, {}).startswith("digraph")
    assert len(planner.components(list(query("?a p ?b . ?c p ?d . ?b p ?e").patterns))) == 2


def test_constants_reach_the_scan(spark):
    plan = evaluate(parse(catalog.PREFIX + "SELECT ?n { customer:7 :c_nation ?n }"), Mapped(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(c_custkey,7)" in plan and plan.count("FileScan") == 1 and "c_name" not in plan


@pytest.mark.parametrize("term", ['"BUILDING"@en', "<http://ex/customer/07>", "<http://ex/customer/x>", "<http://other/7>", '"7', '"01"', '"12345678901234567890123"'])
def test_constants_that_no_row_can_have(spark, term):
    relation = Mapped(spark, SF)
    for name in ("c_mktsegment", "p_size", "c_nation"):
        assert relation.match(None, f"<http://ex/{name}>", term).count() == 0
    assert relation.match(term, "<http://ex/c_nation>", None).count() == 0


@pytest.mark.parametrize("name", ["star_on_chain", "cycle", "object_object", "chain4", "snowflake"])
def test_joins_compare_keys_not_terms(spark, name):
    plan = catalog.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if " Join " in line or "+- Join" in line or ":- Join" in line]
    assert joins and not any("concat" in line for line in joins)
    below = plan[plan.index("Join"):]
    assert "concat(<http" not in below  # terms are written above all joins only


def test_runtime_filters_reach_key_columns(spark):
    """Where a table is large, Spark filters its scan by the keys that the other side of a join has."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.optimizer.runtime.bloomFilter.enabled": "true", "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        found = Dataset(Mapped(spark, SF)).sparql(catalog.PREFIX + 'SELECT ?o ?c { ?o :o_cust ?c . ?c :c_mktsegment "BUILDING" }')
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"might_contain\([^\n]*xxhash64\(o_custkey", plan), plan
        assert found.count() > 0
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_many_rows_of_two_patterns_are_made_once(spark, monkeypatch):
    """Values that many rows share: dealt out in blocks, and compared only where both sides have several values."""
    rng = random.Random(5)
    triples = [(f"a{i}", "p", f"n{x}") for i in range(60) for x in ([0] if i % 3 else rng.sample(range(4), 2))]
    triples += [(f"b{i}", "q", f"n{x}") for i in range(40) for x in ([1] if i % 4 == 1 else [0] if i % 4 == 2 else rng.sample(range(5), 3))]
    relation = Triples(spark.createDataFrame(triples + triples[:7], "s string, p string, o string").cache())
    q = query("?x p ?n . ?y q ?n", "y x")
    monkeypatch.setattr(bgp, "BLOCK", 7)
    for least in (1, 10**9):
        monkeypatch.setattr(bgp, "MANY", least)
        assert run(relation, q) == naive(triples, q) != []
        assert run(relation, query("?x p ?n . ?y nothing ?n", "y x")) == []
    monkeypatch.setattr(bgp, "MANY", 1)
    out = catalog.QUERIES["object_object"](spark, SF)
    assert out._jdf.queryExecution().optimizedPlan().toString().startswith("Union")  # no distinct above all rows
    single = Triples(spark.createDataFrame([(f"{p}{i}", p, "hub") for p in "pq" for i in range(200)], "s string, p string, o string").cache())
    by_task = evaluate(q, single).rdd.glom().map(len).collect()
    assert sum(by_task) == 200 * 200 and max(by_task) < 200 * 200 / 2  # one value, several tasks


def test_unlike_keys_never_meet(spark):
    """Forms differ: compared as terms, whatever the keys are."""
    data = Dataset(Mapped(spark, SF))
    ask = lambda text: data.sparql(catalog.PREFIX + text).count()
    assert ask("SELECT ?x { ?x :c_nation ?n . ?y :o_cust ?z . ?z :c_nation ?n . ?x :c_name ?m }") > 0
    assert ask("SELECT ?x { ?x :c_nation ?n . ?n :c_name ?m }") == 0  # nations are no customers
    assert ask("SELECT ?v { ?x :p_size ?v . ?d :d_quality ?v }") <= 2  # integers as literals, equal as terms
    assert ask("SELECT ?p ?n { nation:3 ?p ?n . ?n :r_name ?m }") == 1  # terms from a variable predicate meet keys


def test_join_sizes():
    sizes = {"a": planner.Size(1_000, 100, 500), "b": planner.Size(2_000, 50, 2_000)}
    steps = planner.plan(query("?x a ?y . ?x b ?z"), sizes)[0]
    assert steps[-1].rows == 1_000 * 2_000 // 100
    assert planner.estimate(query("k a ?y").patterns[0], sizes) == 10 and planner.estimate(query("?x a k").patterns[0], sizes) == 2
    t = query("k a ?y").patterns[0]
    assert planner.estimate(t, sizes | {t: 7}) == 7


SNOWFLAKE = "?o p ?a . ?o q ?b . ?o r ?c . ?c s ?d . ?c t ?e"


def test_stars_of_a_snowflake_are_joined_each_by_itself():
    steps = planner.plan(query(SNOWFLAKE), {})[0]
    star = [s for s in steps if s.op == "star"]
    assert len(star) == 1 and len(star[0].branch) >= 2 and star[0].on in (("c",), ("o",))
    assert "STAR" in planner.explain(query(SNOWFLAKE), {}) and planner.dot(query(SNOWFLAKE), {}).count("STAR") == 1


def test_snowflakes_equal_the_naive_evaluator(spark):
    rng = random.Random(4)
    triples = list({(rng.choice("123456"), rng.choice("pqrst"), rng.choice("123456")) for _ in range(60)})
    relation = Triples(spark.createDataFrame(triples, "s string, p string, o string").cache())
    for select in (None, "a e", "o", "c", "d b"):
        q = query(SNOWFLAKE, select)
        assert run(relation, q) == naive(triples, q) != []


def test_interface():
    with pytest.raises(NotImplementedError):
        Relation().match(None, None, None)
    assert Relation().sizes() == {}


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_queries_equal_their_sql(spark, con, name):
    out = catalog.QUERIES[name](spark, SF)
    expected = con.sql(catalog.ORACLES[name])
    assert sorted(out.columns) == sorted(expected.columns)
    order = [expected.columns.index(c) for c in out.columns]
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r[i] for i in order) for r in expected.fetchall())
