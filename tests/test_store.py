"""N-Triples, the store on disk, statistics, renumbering, streams and the command line."""

import json
import re

import numpy as np
import pytest

from tests.fixtures import GRAPH, NTRIPLES, STATEMENTS, P
from tests.test_engine import naive, query
from triplespark import cli
from triplespark.operators import renumber, statistics
from triplespark.operators.bgp import evaluate
from triplespark.plans import planner
from triplespark.plans.ast import Query
from triplespark.sources import ntriples
from triplespark.sources.relations import Triples
from triplespark.sources.shared import discard, shared_dir, stored
from triplespark.sources.store import FULL, LITERAL_START, Store, decode, dictionary_of, encode, read_histogram
from triplespark.streaming import append


@pytest.fixture(scope="module")
def nt(tmp_path_factory):
    path = tmp_path_factory.mktemp("nt") / "in.nt"
    path.write_text(NTRIPLES, encoding="utf-8")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def lines(spark, path):
    return sorted(r[0] for r in spark.read.text(path).collect())


def test_read(spark, nt):
    assert rows(ntriples.read(spark, nt)) == sorted(STATEMENTS)


def test_strict(spark, nt, tmp_path):
    with pytest.raises(Exception, match="not a statement"):
        ntriples.read(spark, nt, strict=True).collect()
    good = tmp_path / "good.nt"
    good.write_text("\n".join(NTRIPLES.split("\n")[:-4]) + "\n", encoding="utf-8")
    assert rows(ntriples.read(spark, str(good), strict=True)) == sorted(STATEMENTS)


def test_round_trip(spark, nt, tmp_path):
    ntriples.write(ntriples.read(spark, nt), str(tmp_path / "out"))
    assert rows(ntriples.read(spark, str(tmp_path / "out"))) == sorted(STATEMENTS)


def test_clean(spark, nt, tmp_path):
    ntriples.clean(spark, nt, str(tmp_path / "out"))
    out = lines(spark, str(tmp_path / "out"))
    assert len(out) == len(STATEMENTS) - 3 and not any("esc/1>" in x or "esc/2>" in x or "esc/4>" in x for x in out)
    assert '<http://a/tight> <http://a/p> _:house .' in out


def test_graph_exports(spark, tmp_path):
    triples = spark.createDataFrame(GRAPH, "s string, p string, o string")
    ntriples.write_graph(triples, str(tmp_path / "g"))
    assert lines(spark, str(tmp_path / "g/nodes")) == sorted({x for s, _, o in GRAPH for x in (s, o)})
    assert lines(spark, str(tmp_path / "g/edges")) == sorted(f"{s}\t{o}" for s, _, o in GRAPH)
    ntriples.write_graphml(triples, str(tmp_path / "x"))
    import xml.etree.ElementTree as ET

    text = "\n".join("\n".join(r[0] for r in spark.read.text(str(tmp_path / f"x/{part}")).collect()) for part in ("0-head", "1-nodes", "2-edges", "3-foot"))
    tree = ET.fromstring(text.encode())
    assert len(tree[1]) == 19 + 23


@pytest.mark.parametrize("options", [{}, {"full_index": True, "literal_dict": True, "method": "degree"}, {"method": "rand", "spread": True}, {"method": "bfs"}, {"method": "pca"}])
def test_store(spark, nt, tmp_path, options):
    store = Store.build(spark, nt, str(tmp_path / "db"), **options)
    store = Store.open(spark, str(tmp_path / "db"), preload=True)
    assert rows(store.triples()) == sorted(STATEMENTS)
    assert store.counts().first().asDict() == {"triples": 18, "subjects": 15, "predicates": 1, "objects": 13}
    assert set(store.copies) == set(FULL if options.get("full_index") else FULL[:2])
    ids = store.dictionary.collect()
    assert len({r["id"] for r in ids}) == len(ids) == len({x for t in STATEMENTS for x in t})
    if options.get("literal_dict") and not options.get("method"):
        assert all((r["id"] >= LITERAL_START) == (r["kind"] == "literal") for r in ids)
    one = lambda text: rows(store.sparql(text))
    assert one("SELECT ?s { ?s <http://a/p> <http://a/sea> }") == [("<http://a/book/moby>",), ("<http://a/person/olé>",), ("_:house",)]
    assert one('SELECT ?s { ?s <http://a/p> "Emma" }') == [("<http://a/book/emma>",), ("<http://a/str>",)]
    assert one('SELECT ?s { ?s ?p "farbe"@De }') == [("<http://a/tag/2>",)]
    assert one('SELECT ?s { ?s <http://a/p> "missing" }') == []
    assert one("SELECT ?s { ?s <http://a/nosuch> ?o . ?s <http://a/p> ?x }") == []
    assert one("SELECT ?a ?c { ?a <http://a/p> ?b . ?b <http://a/p> ?c }") == sorted(
        {(a, c) for a, _, b in STATEMENTS for b2, _, c in STATEMENTS if b == b2})
    assert one('SELECT ?s { ?s <http://a/p> "no escape: \\\\u00E9" }') == [("<http://a/esc/4>",)]
    assert store.show("SELECT * { ?s ?p ?o }") == 17
    assert store.shape("SELECT * { ?s ?p ?o . ?o ?q ?r }") == "linear"
    assert "SCAN" in store.explain("SELECT * { ?s ?p ?o }") and "digraph" in store.dot("SELECT * { ?s ?p ?o }")


def test_encoded_queries_equal_the_naive_evaluator(spark, tmp_path):
    iri = lambda x: f"<http://g/{x}>"
    triples = [tuple(map(iri, t)) for t in GRAPH]
    store = Store.build(spark, spark.createDataFrame(triples, "s string, p string, o string"), str(tmp_path / "db"), full_index=True)
    for text in ("3 7 ?o", "?s ?p 20", "?x 6 ?a . ?x 7 ?b", "?x 6 ?y . ?y 25 ?z", "?x ?p ?x", "?s ?p ?o . ?p ?q ?r", "3 7 20 . ?s 8 ?o", "99 7 20 . ?s 8 ?o"):
        q = query(text)
        q = Query(q.select, tuple(type(t)(*[iri(x) if isinstance(x, str) else x for x in t.places]) for t in q.patterns))
        assert rows(store.sparql(q)) == naive(triples, q)
    store.write_ids(str(tmp_path / "ids"))
    assert all(len(x.split()) == 3 for x in lines(spark, str(tmp_path / "ids")))
    store.write_histograms(str(tmp_path / "hist"), (3,))
    hist = spark.read.parquet(str(tmp_path / "hist"))
    assert {tuple(r) for r in hist.groupBy("place", "kind").sum("freq").collect()} == {(c, k, 23) for c in "so" for k in ("width", "depth")}
    one = read_histogram(spark, str(tmp_path / "hist"), "s", "width", 3)
    ends = one.agg({"lower": "min", "upper": "max"}).first()
    assert statistics.range_cardinality(one, ends[0], ends[1]).first()[0] == pytest.approx(23)
    known = store.sizes(query(" . ".join(f"?s {iri(7)} ?o" for _ in range(1))))
    assert known[iri(7)] == planner.Size(7, 5, 6) and known[""].rows == 16
    lines_ = store.index("pos", 100).split("\n")
    assert len(lines_) == 23 and lines_ == sorted(lines_, key=lambda x: tuple(map(int, x.split("\t"))))
    seen = store.profile("SELECT ?x ?a ?b { ?x <http://g/6> ?a . ?x <http://g/7> ?b }")
    assert seen["rows"] == 13 and {"analysis", "optimization", "execution"} <= seen["phases"].keys()
    joins = [x for x in seen["operators"] if "Join" in x[1]]
    assert joins and any(n == 13 for _, _, _, n, _ in seen["operators"]) and all(x[4] is None or 0 <= x[4] <= 1 for x in joins)


def test_prescan_counts_and_bounds(spark, tmp_path):
    iri = lambda x: f"<http://g/{x}>"
    triples = [tuple(map(iri, t)) for t in GRAPH]
    store = Store.build(spark, spark.createDataFrame(triples, "s string, p string, o string"), str(tmp_path / "db"))
    ids = store.ids_of([iri(x) for x in range(1, 26)])
    place = lambda x: x if x[0] == "?" else ids[iri(x)]
    q = query("?s 7 20 . ?s 6 ?o . 3 ?p ?o")
    encoded = tuple(type(t)(*[x if not isinstance(x, str) else place(x) for x in t.places]) for t in q.patterns)
    counts, bounds = store._prescan(encoded)
    assert counts == {encoded[0]: 2, encoded[2]: 8}
    subjects, objects = [ids[iri(x)] for x in (1, 3)], [ids[iri(o)] for s, _, o in GRAPH if s == "3"]
    assert bounds["s"] == (min(subjects), max(subjects)) and bounds["o"] == (min(objects), max(objects))
    assert rows(store.sparql(Query(("s", "o"), tuple(type(t)(*[iri(x) if isinstance(x, str) else x for x in t.places]) for t in q.patterns)))) == naive(
        triples, Query(("s", "o"), tuple(type(t)(*[iri(x) if isinstance(x, str) else x for x in t.places]) for t in q.patterns)))
    plan = evaluate(Query(("o",), encoded), Triples(store.copies["pso"], store.copies, {}, bounds))._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(rf"s#\d+L >= {bounds['s'][0]}\)", plan) and re.search(rf"s#\d+L <= {bounds['s'][1]}\)", plan)


def test_ids_are_dense_over_many_partitions(spark, tmp_path):
    settings = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, x in settings.items():
            spark.conf.set(k, x)
        triples = spark.range(6_000).selectExpr("concat('<http://a/', id, '>') s", "'<http://a/p>' p", "concat('\"', id % 1000, '\"') o")
        store = Store.build(spark, triples, str(tmp_path / "db"))
        assert store.dictionary.agg({"id": "max"}).first()[0] == 7_001 == store.dictionary.select("id").distinct().count()
        store.write_histograms(str(tmp_path / "hist"), (100,))
        hist = spark.read.parquet(str(tmp_path / "hist"))
        assert {tuple(r) for r in hist.groupBy("place", "kind").sum("freq").collect()} == {(c, k, 6_000) for c in "so" for k in ("width", "depth")}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)


def test_numbers_and_running_sums_of_more_rows_than_a_sample_holds(spark):
    n, mod = 1_000_000, 1_000_003
    df = spark.range(n, numPartitions=8).selectExpr("id * 7919 % 1000003 x", "concat('payload ', id) y", "concat('p', cast(sqrt(id % 2500) as int)) p", "id % 10 w").coalesce(6)
    ranked = statistics.ranked(df, "x")
    assert ranked.columns == ["x", "y", "p", "w", "new_id"]
    assert ranked.selectExpr("count(distinct new_id)", "min(new_id)", "max(new_id)").first() == (n, 1, n)
    xs = np.sort(np.arange(n, dtype=np.int64) * 7919 % mod)
    sample = ranked.filter("x % 1000 = 0").collect()
    assert all(xs[r["new_id"] - 1] == r["x"] for r in sample) and len(sample) > 900
    placed = statistics.running(df, "x", "w").filter("x % 1000 = 0").collect()
    x, w = (np.array(z) for z in zip(*df.select("x", "w").collect()))
    before = dict(zip(x[np.argsort(x)].tolist(), (np.cumsum(w[np.argsort(x)]) - w[np.argsort(x)]).tolist()))
    assert all(r["before"] == before[r["x"]] for r in placed)
    table = df.select("x", "p").toPandas()
    ends = table.groupby("p")["x"].agg(["min", "max"])
    inside = sum(((table["x"] >= lo) & (table["x"] <= hi)).sum() - ((table["p"] == p) & (table["x"] >= lo) & (table["x"] <= hi)).sum() for p, (lo, hi) in zip(ends.index, ends.values))
    for _ in range(2):
        assert statistics.boundary_compactness(df, "p", "x").first()[0] == pytest.approx(inside / len(ends), rel=1e-12)
    gap = statistics.largest_gap(df.filter("x not between 5000 and 7000 or x = 6000"), "x").first()
    kept = xs[(xs < 5000) | (xs > 7000) | (xs == 6000)]
    at = int(np.argmax(np.diff(kept)))
    assert tuple(gap) == (kept[at], kept[at + 1], kept[at + 1] - kept[at])
    assert statistics.largest_gap(df.filter("x = 1"), "x").count() == 0


def test_wide_ids_make_many_buckets(spark):
    df = spark.createDataFrame([(1,), (4 * 8_589_934_593,), (None,)], "x long")
    wide = statistics.equal_width(df, "x", 10_000)
    assert wide.count() == (4 * 8_589_934_593 - 1) // 10_000 + 1
    assert rows(wide.filter("freq > 0"))[0] == (1, 10_000, 1) and wide.agg({"upper": "max"}).first()[0] == 4 * 8_589_934_593


def test_shared_tables(spark, tmp_path):
    t = stored(spark.range(3), "three")
    assert t.stored_at.startswith(shared_dir(spark)) and t.count() == 3
    discard(t)
    with pytest.raises(Exception):
        spark.read.parquet(t.stored_at)

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://h:7077", "_jsc": spark.sparkContext._jsc})

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            shared_dir(Cluster)


@pytest.mark.parametrize("method", renumber.METHODS)
def test_renumbering_is_a_bijection(spark, tmp_path, method):
    triples = spark.createDataFrame(GRAPH, "s string, p string, o string")
    n = [0]

    def stage(df):
        n[0] += 1
        df.write.parquet(f"{tmp_path}/{n[0]}")
        return spark.read.parquet(f"{tmp_path}/{n[0]}")

    dictionary = stage(dictionary_of(triples))
    ids = stage(encode(triples, dictionary))
    assert rows(decode(ids, dictionary)) == sorted(GRAPH)
    mapping = renumber.renumber(method, ids, dictionary, stage)
    if method == "none":
        assert mapping is None
        return
    found = rows(mapping)
    size = dictionary.count()
    assert [a for a, _ in found] == sorted(r[0] for r in dictionary.select("id").collect())
    assert len({b for _, b in found}) == size
    if method != "spread":
        assert {b for _, b in found} == set(range(1, size + 1))
    with pytest.raises(ValueError):
        renumber.renumber("nmf", ids, dictionary, stage)


def test_breadth_first_says_when_levels_run_out(spark):
    from triplespark.operators.renumber import breadth_first

    triples = spark.createDataFrame([(i, 9, i + 1) for i in range(1, 5)], "s long, p long, o long")
    ids = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    stage = stored
    assert breadth_first(triples, ids, stage, 6).count() == 5
    with pytest.raises(RuntimeError):
        breadth_first(triples, ids, stage, 3).count()


@pytest.mark.parametrize("setting", [{}, {"MOST_BITS": 10}, {"SWEPT_LEVELS": 2}, {"SWEPT_COMPONENTS": 1}])
def test_breadth_first_by_bits_and_by_joins(spark, monkeypatch, setting):
    """Several components, a loop, ids without edges and a hub: by hand, whichever way a component is found."""
    for name, x in setting.items():
        monkeypatch.setattr(renumber, name, x)
    pairs = [(1, 64), (64, 3), (3, 1), (2, 70), (70, 5), (5, 128), (128, 6), (6, 7), (9, 9)] + [(i, 100) for i in range(80, 99)]
    ids = sorted({x for p in pairs for x in p} | {4, 127})
    near = {i: {a for a, b in pairs if b == i} | {b for a, b in pairs if a == i} for i in ids}
    place = {}
    for root in ids:
        front, level = {root} - set(place), 0
        while front:
            place.update({i: (root, level, i) for i in front})
            front, level = {b for i in front for b in near[i]} - set(place), level + 1
    expected = sorted((i, n + 1) for n, i in enumerate(sorted(ids, key=place.get)))
    triples = spark.createDataFrame([(a, 8, b) for a, b in pairs + pairs[:3]], "s long, p long, o long")
    seen = []

    def stage(df):
        seen.append(df._jdf.queryExecution().optimizedPlan().toString())
        return stored(df)

    assert rows(renumber.breadth_first(triples, spark.createDataFrame([(i,) for i in ids], "id long"), stage)) == expected
    assert any("Join" in plan for plan in seen) == bool(setting)  # by bits alone, edges are never shuffled


def test_component_orders_like_a_dense_decomposition(spark):
    import numpy as np

    triples = [(int(a), int(p) + 100, int(b)) for a, p, b in GRAPH]
    ids = sorted({x for a, _, b in triples for x in (a, b)})
    columns = sorted({p for _, p, _ in triples})
    x = np.array([[float(any(p == q and i in (a, b) for a, q, b in triples)) for p in columns] for i in ids])
    score = dict(zip(ids, x @ np.linalg.svd(x - x.mean(0))[2][0]))
    seen = []

    def stage(df):
        seen.append(df.columns)
        return stored(df)

    dictionary = spark.createDataFrame([(i, str(i), "iri") for i in ids], "id long, term string, kind string")
    found = rows(renumber.by_component(spark.createDataFrame(triples, "s long, p long, o long"), dictionary, stage))
    order = [round(score[i], 6) for i, _ in sorted(found, key=lambda r: r[1])]
    assert order in (sorted(order), sorted(order, reverse=True)) and len(set(order)) > 3
    assert ["ks", "m"] in seen and ["ks", "score"] in seen  # sets of predicates are counted and scored, not terms


def test_histograms(spark):
    values = [1, 1, 1, 2, 3, 10, 10, 25, 25, 26]
    df = spark.createDataFrame([(x, "ab"[x % 2]) for x in values] + [(None, "a")], "x long, p string")
    wide = statistics.equal_width(df, "x", 5)
    assert rows(wide) == [(1, 5, 5), (6, 10, 2), (11, 15, 0), (16, 20, 0), (21, 25, 2), (26, 26, 1)]
    assert rows(statistics.equal_depth(df, "x", 4)) == [(1, 3, 5), (10, 10, 2), (25, 26, 3)] or sum(r[2] for r in rows(statistics.equal_depth(df, "x", 4))) == 10
    assert statistics.range_cardinality(wide, 3, 8).first()[0] == pytest.approx(5 * 3 / 5 + 2 * 3 / 5)
    assert statistics.cut_point(wide, 1, 26).first()[0] == 13
    assert rows(statistics.range_min(wide, 1, 26)) == [(11, 15, 0, 6)] and rows(statistics.range_min(wide, 22, 25)) == [(21, 25, 2, 1)]
    assert rows(statistics.range_min(wide, 40, 50)) == [(None, None, None, 0)]
    assert statistics.cut_point(wide, 2, 4).first()[0] == 3
    spread = statistics.predicate_spread(df, "p", "x").first()
    parts = [(26 - 2) / 4, (25 - 1) / 6]
    assert spread[0] == pytest.approx(sum(parts) / 2)
    ranges = {"a": (2, 26), "b": (1, 25)}
    inside = sum(1 for x in values for q, (lo, hi) in ranges.items() if q != "ab"[x % 2] and lo <= x <= hi)
    assert statistics.boundary_compactness(df, "p", "x").first()[0] == pytest.approx(inside / 2)
    none = df.filter("false")
    assert statistics.equal_width(none, "x", 5).count() == 0 and statistics.equal_depth(none, "x", 5).count() == 0


def test_stream(spark, nt, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.nt").write_text(NTRIPLES, encoding="utf-8")
    go = lambda: append.append(append.read_stream(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    go()
    (folder / "2.nt").write_text(f"<http://a/new> {P} <http://a/sea> .\n", encoding="utf-8")
    go()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == sorted([*STATEMENTS, ("<http://a/new>", P, "<http://a/sea>")])


def test_command_line(spark, nt, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "_session", lambda cores: spark)
    db, q = str(tmp_path / "db"), tmp_path / "q.sparql"
    q.write_text("SELECT ?s { ?s <http://a/p> ?o }", encoding="utf-8")
    assert cli.main(["build", db, nt]) == 0
    assert json.loads(capsys.readouterr().out)["triples"] == 18
    cli.main(["query", db, "--sparql", str(q)])
    out = capsys.readouterr().out
    assert "Total : 15 rows" in out and "...." in out and len(out.splitlines()) == 9
    cli.main(["query", db, "--sparql", str(q), "--no-prescan"])
    assert "Total : 15 rows" in capsys.readouterr().out
    cli.main(["query", db, "--sparql", str(q), "--explain"])
    cli.main(["query", db, "--sparql", str(q), "--dot"])
    capsys.readouterr()
    cli.main(["query", db, "--sparql", str(q), "--profile"])
    assert json.loads(capsys.readouterr().out)["rows"] == 15
    cli.main(["query", db, "--sparql", str(q), "--out", str(tmp_path / "result")])
    assert spark.read.parquet(str(tmp_path / "result")).count() == 15
    cli.main(["bench", db, str(tmp_path), "--warm-up", "0", "--timed", "2", "--log", str(tmp_path / "log")])
    assert json.loads((tmp_path / "log").read_text())["rows"] == 15
    cli.main(["bench", db, str(tmp_path), "--show-stat"])
    cli.main(["index", db, "pso", "--limit", "3"])
    assert len(capsys.readouterr().out.splitlines()) >= 4
    cli.main(["clean", nt, str(tmp_path / "clean")])
    for kind in ("ntriples", "graph", "graphml", "ids", "histograms"):
        cli.main(["export", db, str(tmp_path / kind), "--format", kind])
    capsys.readouterr()
    said = iter([f"sparql {q}", "nonsense", "sparql /nowhere", "", "exit"])
    cli.repl(Store.open(spark, db), lambda _: next(said))
    out = capsys.readouterr().out
    assert "Total : 15 rows" in out and "Not supported command" in out and "No such file" in out


def test_server():
    import threading
    import urllib.error
    import urllib.request

    with cli.server(0) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        url = f"http://127.0.0.1:{server.server_address[1]}"
        with urllib.request.urlopen(url + "/") as r:
            assert json.load(r) == {"statusCode": 200, "message": "Hello World!"}
        with pytest.raises(urllib.error.HTTPError):
            urllib.request.urlopen(url + "/query")
        server.shutdown()
