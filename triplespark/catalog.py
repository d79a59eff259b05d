"""The queries over the driver's tables, as SPARQL or statistics, each with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespark.operators import statistics
from triplespark.operators.renumber import METHODS, renumber
from triplespark.sources import ntriples
from triplespark.sources.relations import TABLES, Mapped
from triplespark.sources.shared import new_path, stored, temporary
from triplespark.sources.store import Dataset, Store, decode, dictionary_of, encode, predicates_of

PREFIX = "PREFIX : <http://ex/> PREFIX region: <http://ex/region/> PREFIX nation: <http://ex/nation/> PREFIX customer: <http://ex/customer/>\n"


def _iri(kind: str, column: str) -> str:
    return f"'<http://ex/{kind}/' || {column} || '>'"


def _lit(column: str) -> str:
    return f"'\"' || {column} || '\"'"


def _distinct(columns: dict[str, str], rest: str) -> str:
    return "SELECT DISTINCT " + ", ".join(f'{x} AS "{n}"' for n, x in columns.items()) + " " + rest


#: All triples of some tables, for patterns with a variable predicate.
def _triples_sql(*tables: str) -> str:
    from triplespark.sources.relations import VOCABULARY

    def term(place) -> str:
        return _lit(place.columns[0]) if place.kind is None else _iri(place.kind, " || '-' || ".join(place.columns))

    parts = [f"SELECT {term(x.subject)} AS s, '<http://ex/{n}>' AS p, {term(x.object)} AS o FROM {x.table}" for n, x in VOCABULARY.items() if x.table in tables]
    return "(SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE s IS NOT NULL AND o IS NOT NULL)"


_ALL = _triples_sql(*TABLES)

#: name: (SPARQL, SQL)
BGPS: dict[str, tuple[str, str]] = {
    "tp_s_p_var": ("SELECT ?n { customer:7 :c_nation ?n }", _distinct({"n": _iri("nation", "c_nationkey")}, "FROM customer WHERE c_custkey = 7")),
    "tp_s_var_o": ("SELECT ?p { nation:3 ?p region:3 }", f"SELECT DISTINCT p FROM {_ALL} WHERE s = '<http://ex/nation/3>' AND o = '<http://ex/region/3>'"),
    "tp_s_var_var": ("SELECT ?p ?o { nation:3 ?p ?o }", f"SELECT DISTINCT p, o FROM {_ALL} WHERE s = '<http://ex/nation/3>'"),
    "tp_var_p_o": ('SELECT ?c { ?c :c_mktsegment "BUILDING" }', _distinct({"c": _iri("customer", "c_custkey")}, "FROM customer WHERE c_mktsegment = 'BUILDING'")),
    "tp_var_p_var": ("SELECT ?o ?c { ?o :o_cust ?c }", _distinct({"o": _iri("order", "o_orderkey"), "c": _iri("customer", "o_custkey")}, "FROM orders")),
    "tp_var_var_o": ("SELECT ?s ?p { ?s ?p nation:3 }", f"SELECT DISTINCT s, p FROM {_ALL} WHERE o = '<http://ex/nation/3>'"),
    "tp_var_var_var": ("SELECT ?s ?p ?o { ?s ?p ?o }", f"SELECT DISTINCT s, p, o FROM {_ALL}"),
    "tp_const": ("SELECT ?c { nation:3 :n_region region:4 . ?c :c_nation nation:3 }",
                 _distinct({"c": _iri("customer", "c_custkey")}, "FROM customer WHERE c_nationkey = 3 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 4)")),
    "star3": ('SELECT ?o ?c { ?o :o_orderstatus "F"; :o_orderpriority "1-URGENT"; :o_cust ?c }',
              _distinct({"o": _iri("order", "o_orderkey"), "c": _iri("customer", "o_custkey")}, "FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")),
    "chain4": ('SELECT ?o ?c { ?o :o_cust ?c . ?c :c_nation ?n . ?n :n_region ?r . ?r :r_name "ASIA" }',
               _distinct({"o": _iri("order", "o_orderkey"), "c": _iri("customer", "o_custkey")}, "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")),
    "snowflake": ('SELECT ?o ?c ?m ?n { ?o :o_orderstatus "P"; :o_orderpriority "2-HIGH"; :o_cust ?c . ?c :c_mktsegment ?m; :c_nation ?n }',
                  _distinct({"o": _iri("order", "o_orderkey"), "c": _iri("customer", "o_custkey"), "m": _lit("c_mktsegment"), "n": _iri("nation", "c_nationkey")}, "FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '2-HIGH'")),
    "object_object": ("SELECT ?c ?s { ?c :c_nation ?n . ?s :s_nation ?n }",
                      _distinct({"c": _iri("customer", "c_custkey"), "s": _iri("supplier", "s_suppkey")}, "FROM customer JOIN supplier ON c_nationkey = s_nationkey")),
    "star_on_chain": ("SELECT ?c ?x ?y { ?o :o_cust ?c . ?e :e_user ?c . ?o :hasPart ?x; :hasSupp ?y }",
                      _distinct({"c": _iri("customer", "o_custkey"), "x": _iri("part", "a.l_partkey"), "y": _iri("supplier", "b.l_suppkey")}, "FROM orders JOIN lineitem a ON a.l_orderkey = o_orderkey JOIN lineitem b ON b.l_orderkey = o_orderkey WHERE o_custkey IN (SELECT user_id FROM events)")),
    "cycle": ("SELECT ?o ?c ?s { ?o :o_cust ?c . ?c :c_nation ?n . ?o :hasSupp ?s . ?s :s_nation ?n }",
              _distinct({"o": _iri("order", "o_orderkey"), "c": _iri("customer", "o_custkey"), "s": _iri("supplier", "s_suppkey")}, "FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey")),
    "project_dedup": ("SELECT ?m { ?o :o_cust ?c . ?c :c_mktsegment ?m }", _distinct({"m": _lit("c_mktsegment")}, "FROM orders JOIN customer ON o_custkey = c_custkey")),
    "missing_const": ('SELECT ?c ?n { ?c :c_mktsegment "NOPE"; :c_nation ?n }', _distinct({"c": _iri("customer", "c_custkey"), "n": _iri("nation", "c_nationkey")}, "FROM customer WHERE c_mktsegment = 'NOPE'")),
    "missing_pred": ("SELECT ?c ?n { ?c :nosuch ?x; :c_nation ?n }", _distinct({"c": _iri("customer", "c_custkey"), "n": _iri("nation", "c_nationkey")}, "FROM customer WHERE false")),
    "all_const_guard": ("SELECT ?c { nation:3 :n_region region:3 . ?c :c_nation nation:3 }",
                        _distinct({"c": _iri("customer", "c_custkey")}, "FROM customer WHERE c_nationkey = 3 AND EXISTS (SELECT 1 FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3)")),
    "cartesian": ("SELECT ?r ?n { ?r :r_name ?x . ?n :n_region region:1 }", _distinct({"r": _iri("region", "r_regionkey"), "n": _iri("nation", "n_nationkey")}, "FROM region CROSS JOIN nation WHERE n_regionkey = 1")),
    "self_loop": ("SELECT ?x { ?x :o_cust ?x }", _distinct({"x": _iri("order", "o_orderkey")}, "FROM orders WHERE false")),
    "pred_var_join": ("SELECT ?a ?b ?p { ?a ?p region:1 . ?b ?p region:2 }",
                      f"SELECT DISTINCT x.s AS a, y.s AS b, x.p AS p FROM {_ALL} x JOIN {_ALL} y ON x.p = y.p WHERE x.o = '<http://ex/region/1>' AND y.o = '<http://ex/region/2>'"),
    "pred_var_star": ("SELECT ?p ?o ?q { nation:3 ?p ?o . nation:4 ?p ?q }",
                      f"SELECT DISTINCT x.p AS p, x.o AS o, y.o AS q FROM {_ALL} x JOIN {_ALL} y ON x.p = y.p WHERE x.s = '<http://ex/nation/3>' AND y.s = '<http://ex/nation/4>'"),
    "sel_all": ("SELECT * { ?c :c_nation ?n . ?n :n_region region:2 }", _distinct({"c": _iri("customer", "c_custkey"), "n": _iri("nation", "c_nationkey")}, "FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2")),
    "blank_nodes": ('SELECT ?n { [] :c_nation ?n; :c_mktsegment "MACHINERY" . _:s :s_nation ?n }',
                    _distinct({"n": _iri("nation", "c_nationkey")}, "FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_nationkey IN (SELECT s_nationkey FROM supplier)")),
}
#: Patterns over the tables of texts.
TEXTS: dict[str, tuple[str, str]] = {
    "documents_star": ('SELECT ?d ?g { ?d :d_quality "1"; :d_toxic "0"; :d_lang ?l; :d_source ?g }',
                       _distinct({"d": _iri("document", "d.doc_id"), "g": _lit("source")}, "FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE quality = 1 AND toxic = 0 AND lang IS NOT NULL AND source IS NOT NULL")),
    "turn_roles": ("SELECT ?r { ?t :t_role ?r }", _distinct({"r": _lit("role")}, "FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL")),
}


def _bgp(text: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Dataset(Mapped(spark, sf_dir)).sparql(PREFIX + text)


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


_orders = _table("orders")
_EW = """SELECT lo + i * {w} AS lower, least(lo + i * {w} + {w} - 1, hi) AS upper, coalesce(n, 0)::BIGINT AS freq
FROM (SELECT min(o_custkey) AS lo, max(o_custkey) AS hi, unnest(range(0, ((max(o_custkey) - min(o_custkey)) // {w}) + 1)) AS i FROM orders)
LEFT JOIN (SELECT (o_custkey - (SELECT min(o_custkey) FROM orders)) // {w} AS i, count(*) AS n FROM orders GROUP BY 1) USING (i)"""
_ED = """SELECT min(x) AS lower, max(x) AS upper, sum(n)::BIGINT AS freq FROM (
  SELECT x, n, (sum(n) OVER (ORDER BY x) - n) // {d} AS b FROM (SELECT o_custkey AS x, count(*) AS n FROM orders GROUP BY 1)) GROUP BY b"""
_RANGES = "SELECT o_orderpriority AS p, min(o_custkey) AS lo, max(o_custkey) AS hi, count(*) AS n FROM orders GROUP BY 1"
_EDGES = f"SELECT s, o FROM {_ALL}"


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scrubber over statements written from customers; names with an escape in every 3rd row's object."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    name = F.when(F.col("c_custkey") % 3 == 0, F.concat("c_name", F.lit("\\u00e9"))).otherwise(F.col("c_name"))
    lines = c.select(F.concat(F.lit("<http://ex/customer/"), "c_custkey", F.lit(">  <http://ex/c_name>\t\""), name, F.lit('". # note')).alias("value"))
    return ntriples.cleaned(lines).select(F.col("value").alias("line"))


def _work(spark: SparkSession) -> str:
    """A new folder that all executors see, until the JVM ends."""
    path = new_path(spark, "work")
    temporary(spark, path)
    return path


def _store(text: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    """A query over a store on disk, built from all tables' triples."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Store.build(spark, Mapped(spark, sf_dir).table(), _work(spark), **options).sparql(PREFIX + text)

    return run


def _from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples written as N-Triples and read again."""
    path = _work(spark) + "/triples"
    ntriples.write(Mapped(spark, sf_dir).table(), path)
    return ntriples.read(spark, path)


def _coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples to ids and back."""
    triples = stored(Mapped(spark, sf_dir).table())
    dictionary = stored(dictionary_of(triples))
    ids = stored(encode(triples, dictionary))
    return decode(ids, dictionary, predicates_of(ids, dictionary, "id"))


def _numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each renumbering: ids, new ids, and how far the new ones reach where they are dense."""
    triples = stored(Mapped(spark, sf_dir).table())
    dictionary = stored(dictionary_of(triples))
    ids = stored(encode(triples, dictionary))
    parts = [
        renumber(m, ids, dictionary, stored).agg(
            F.count(F.lit(1)).alias("ids"), F.count_distinct("new_id").alias("new_ids"),
            F.when(F.lit(m == "spread"), F.lit(0).cast("long")).otherwise(F.max("new_id")).cast("long").alias("largest"),
        ).select(F.lit(m).alias("method"), "ids", "new_ids", "largest")
        for m in METHODS if m != "none"
    ]
    return reduce(DataFrame.unionAll, parts)


_TERMS = f"SELECT count(DISTINCT t) AS n FROM (SELECT unnest([s, p, o]) AS t FROM {_ALL})"
STORES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_chain": (_store('SELECT ?c ?n { ?c :c_nation ?n . ?n :n_region ?r . ?r :r_name "EUROPE" }'),
                    _distinct({"c": _iri("customer", "c_custkey"), "n": _iri("nation", "c_nationkey")}, "FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'")),
    "store_full_index": (_store("SELECT ?s ?p { ?s ?p nation:5 }", full_index=True, literal_dict=True, method="degree"),
                         f"SELECT DISTINCT s, p FROM {_ALL} WHERE o = '<http://ex/nation/5>'"),
    "ntriples_files": (_from_files, f"SELECT s, p, o FROM {_ALL}"),
    "dictionary_codes": (_coded, f"SELECT s, p, o FROM {_ALL}"),
    "renumberings": (_numbers, " UNION ALL ".join(f"SELECT '{m}' AS method, n AS ids, n AS new_ids, {'0::BIGINT' if m == 'spread' else 'n'} AS largest FROM ({_TERMS})" for m in METHODS if m != "none")),
}

STATISTICS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "store_counts": (lambda s, d: statistics.store_counts(Mapped(s, d).table()),
                     f"SELECT count(*) AS triples, count(DISTINCT s) AS subjects, count(DISTINCT p) AS predicates, count(DISTINCT o) AS objects FROM {_ALL}"),
    "pred_counts": (lambda s, d: Mapped(s, d).predicate_counts(), f"SELECT p, count(*) AS n FROM {_ALL} GROUP BY p"),
    "eq_width_hist": (lambda s, d: statistics.equal_width(_orders(s, d), "o_custkey", 100), _EW.format(w=100)),
    "eq_depth_hist": (lambda s, d: statistics.equal_depth(_orders(s, d), "o_custkey", 1000), _ED.format(d=1000)),
    "range_cardinality": (lambda s, d: statistics.range_cardinality(statistics.equal_width(_orders(s, d), "o_custkey", 100), 150, 420).select(F.round("estimate", 6).alias("estimate")),
                          f"SELECT round(coalesce(sum(freq * greatest(0, least(upper, 420) - greatest(lower, 150) + 1) / (upper - lower + 1)), 0), 6) AS estimate FROM ({_EW.format(w=100)})"),
    "cut_point": (lambda s, d: statistics.cut_point(statistics.equal_width(_orders(s, d), "o_custkey", 100), 0, 900),
                  f"SELECT CASE WHEN count(*) <= 1 THEN 450 ELSE min_by((lower + upper) // 2, freq * 1000000000 + lower) END::BIGINT AS cut FROM ({_EW.format(w=100)}) WHERE upper >= 0 AND lower <= 900"),
    "pred_spread": (lambda s, d: statistics.predicate_spread(_orders(s, d), "o_orderpriority", "o_custkey").select(F.round("dist_mean", 9).alias("dist_mean"), F.round("dist_var", 9).alias("dist_var")),
                    f"SELECT round(avg((hi - lo) / n), 9) AS dist_mean, round(var_pop((hi - lo) / n), 9) AS dist_var FROM ({_RANGES})"),
    "compactness": (lambda s, d: statistics.boundary_compactness(_orders(s, d), "o_orderpriority", "o_custkey").select(F.round("compactness", 6).alias("compactness")),
                    f"""WITH r AS ({_RANGES}), pairs AS (SELECT a.p AS p, b.p AS q, greatest(a.lo, b.lo) AS lo, least(a.hi, b.hi) AS hi FROM r a JOIN r b ON a.p <> b.p)
                    SELECT round((SELECT coalesce(sum((SELECT count(*) FROM orders WHERE o_orderpriority IN (p, q) AND o_custkey BETWEEN lo AND hi) / 2), 0) FROM pairs) / (SELECT count(*) FROM r), 6) AS compactness"""),
    "largest_gap": (lambda s, d: statistics.largest_gap(_orders(s, d), "o_custkey"),
                    "SELECT lower, upper, upper - lower AS gap FROM (SELECT lag(o_custkey) OVER (ORDER BY o_custkey) AS lower, o_custkey AS upper FROM orders) WHERE lower IS NOT NULL ORDER BY gap DESC, lower LIMIT 1"),
    "degree_rank": (lambda s, d: statistics.degree_rank(Mapped(s, d).degrees()),
                    f"SELECT node, degree, row_number() OVER (ORDER BY degree DESC, node) AS new_id FROM (SELECT node, count(*) AS degree FROM (SELECT s AS node FROM ({_EDGES}) UNION ALL SELECT o FROM ({_EDGES})) GROUP BY node)"),
    "clean_ntriples": (_cleaned, """SELECT '<http://ex/customer/' || c_custkey || '> <http://ex/c_name> "' || c_name || '" .' AS line FROM customer WHERE c_custkey % 3 <> 0"""),
    "graph_nodes": (lambda s, d: ntriples.graph(Mapped(s, d).table())[0],
                    f"SELECT s AS node FROM {_ALL} UNION SELECT o FROM {_ALL}"),
    "graph_edges": (lambda s, d: ntriples.graph(Mapped(s, d).table())[1], _EDGES),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = (
    {n: _bgp(text) for n, (text, _) in (BGPS | TEXTS).items()}
    | {n: f for n, (f, _) in (STATISTICS | STORES).items()}
)
ORACLES: dict[str, str] = {n: sql for n, (_, sql) in (BGPS | TEXTS | STATISTICS | STORES).items()}
FLAGSHIP = "chain4"
