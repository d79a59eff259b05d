"""The store on disk: dictionary, sorted copies of the triples as ids, statistics, all Parquet.

    dict/        id, term, kind (iri, bnode, literal), one id space for all positions
    pso/ pos/    s, p, o as ids, range-partitioned and sorted in that order
    spo/ sop/ osp/ ops/   the same with full_index
    stats/       p (as a term), n, subjects, objects: statements and different subjects and objects
    meta.json is a row of Parquet: format, full_index, literal_dict, method

Row groups of a sorted copy have narrow bounds, so a constant place skips all others. Ids are longs;
terms appear only when constants are looked up and when results are decoded.
"""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespark.functions.terms import kind_column
from triplespark.operators import statistics
from triplespark.operators.bgp import evaluate
from triplespark.operators.renumber import renumber
from triplespark.plans import planner
from triplespark.plans.ast import Pattern, Query, Var
from triplespark.plans.observe import observed
from triplespark.plans.sparql import parse
from triplespark.sources import ntriples
from triplespark.sources.relations import Relation, Triples
from triplespark.sources.shared import delete, stored

BASIC, FULL = ("pso", "pos"), ("pso", "pos", "spo", "sop", "osp", "ops")
#: With a separate dictionary of literals their ids start here.
LITERAL_START = 1 << 40


#: Most rows of the dictionary's predicates that are broadcast (a term and an id each).
FEW_PREDICATES = 200_000


def dictionary_of(triples: DataFrame, literal_dict: bool = False) -> DataFrame:
    """id, term, kind: dense ids from 1 that rise with terms."""
    terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct().withColumn("kind", kind_column(F.col("term")))
    if not literal_dict:
        return statistics.ranked(terms, "term", name="id").select("id", "term", "kind")
    literal = F.col("kind") == "literal"
    dense = statistics.ranked(terms, literal, F.col("term"), name="id")
    before = dense.filter(~literal).count()
    return dense.select(F.when(literal, F.col("id") - before + LITERAL_START).otherwise(F.col("id")).alias("id"), "term", "kind")


def predicates_of(triples: DataFrame, dictionary: DataFrame, column: str) -> DataFrame:
    """The dictionary's rows for the predicates of triples that hold `column` (term or id) there. Each
    predicate has many statements, so that side is broadcast if it has been counted and is small."""
    names = stored(triples.select(F.col("p").alias(column)).distinct(), "predicates")
    few = names.count() <= FEW_PREDICATES
    found = dictionary.join(F.broadcast(names) if few else names, column, "left_semi")
    return F.broadcast(found) if few else found


def encode(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """s, p, o as ids: a join with the dictionary for each place; predicates' rows are broadcast if few,
    elsewhere adaptive execution splits hot terms."""
    for c in "pso":
        known = predicates_of(triples, dictionary, "term") if c == "p" else dictionary
        triples = triples.join(known.select(F.col("term").alias(c), F.col("id").alias(f"{c}_id")), c)
    return triples.select(*[F.col(f"{c}_id").alias(c) for c in "spo"])


def decode(rows: DataFrame, dictionary: DataFrame, predicates: DataFrame | None = None) -> DataFrame:
    """Each column's ids as terms; the dictionary joins once for each column, for p its predicates alone if given."""
    names = rows.columns
    out = rows.select(*[F.col(f"`{c}`").alias(f"v{i}") for i, c in enumerate(names)])
    for i in range(len(names)):
        known = predicates if names[i] == "p" and predicates is not None else dictionary
        out = out.join(known.select(F.col("id").alias(f"v{i}"), F.col("term").alias(f"t{i}")), f"v{i}")
    return out.select(*[F.col(f"t{i}").alias(c) for i, c in enumerate(names)])


class Dataset:
    """Something to ask: SPARQL over a relation of terms."""

    def __init__(self, relation: Relation):
        self.relation = relation

    def parse(self, text: str) -> Query:
        return parse(text)

    def sparql(self, text: str | Query) -> DataFrame:
        """The distinct bindings as a lazy DataFrame, a string column for each selected variable."""
        return evaluate(parse(text) if isinstance(text, str) else text, self.relation)

    def sparql_file(self, path: str) -> DataFrame:
        with open(path, encoding="utf-8") as f:
            return self.sparql(f.read())

    def sizes(self, query: Query) -> dict:
        """What is known of the sizes of a query's patterns."""
        return self.relation.sizes()

    def explain(self, text: str) -> str:
        query = parse(text)
        return planner.explain(query, self.sizes(query))

    def dot(self, text: str) -> str:
        query = parse(text)
        return planner.dot(query, self.sizes(query))

    def shape(self, text: str) -> str:
        return planner.shape(parse(text))

    def profile(self, text: str) -> dict:
        """Seconds of parsing, ordering and Spark's phases, the rows, the steps with their estimates, and the
        operators with the rows they made and their selectivity."""
        marks = [time.perf_counter()]
        query = parse(text)
        marks.append(time.perf_counter())
        rows = self.sparql(query)
        marks.append(time.perf_counter())
        seen = observed(rows)
        parse_s, plan_s = (round(b - a, 6) for a, b in zip(marks, marks[1:]))
        sizes = self.sizes(query)
        steps = [f"{s.op} {s.pattern} (~{s.rows})" for g in planner.plan(query, sizes) for s in planner.flat(g)]
        return {"parse_s": parse_s, "plan_s": plan_s, "run_s": seen["phases"]["execution"], "rows": seen["rows"], "shape": planner.shape(query),
                "steps": steps, "phases": seen["phases"], "operators": seen["operators"]}

    def show(self, text: str, limit: int = 7) -> int:
        """Print the first rows and the total, and return it."""
        rows = self.sparql(text).cache()
        try:
            first, total = rows.limit(limit).collect(), rows.count()
        finally:
            rows.unpersist()
        for r in first:
            print("\t".join(r))
        if total > len(first):
            print("....")
        print(f"Total : {total} rows")
        return total


class Store(Dataset):
    """A store on disk, opened."""

    def __init__(self, spark: SparkSession, path: str, preload: bool = False):
        self.spark, self.path = spark, path
        self.meta = spark.read.parquet(f"{path}/meta").first().asDict()
        self.dictionary = spark.read.parquet(f"{path}/dict")
        self.copies = {n: spark.read.parquet(f"{path}/{n}") for n in (FULL if self.meta["full_index"] else BASIC)}
        if preload:
            self.dictionary = self.dictionary.cache()
            self.copies = {n: t.cache() for n, t in self.copies.items()}
        self.stats = spark.read.parquet(f"{path}/stats")
        self.prescan = True
        super().__init__(Triples(self.copies["pso"], self.copies))

    @classmethod
    def build(cls, spark: SparkSession, source: str | DataFrame, path: str, full_index: bool = False,
              literal_dict: bool = False, method: str = "none", spread: bool = False) -> Store:
        """Write a store from N-Triples files, or a table of triples, and open it."""
        triples = ntriples.read(spark, source) if isinstance(source, str) else source.select("s", "p", "o")
        staged, n = f"{path}/_staged", [0]

        def stage(df: DataFrame) -> DataFrame:
            n[0] += 1
            df.write.mode("overwrite").parquet(f"{staged}/{n[0]}")
            return spark.read.schema(df.schema).parquet(f"{staged}/{n[0]}")

        triples = stage(triples)
        dictionary = stage(dictionary_of(triples, literal_dict))
        ids = stage(encode(triples, dictionary))
        for m in [method] + ["spread"] * (spread and method != "spread"):
            mapping = renumber(m, ids, dictionary, stage)
            if mapping is not None:
                mapping = stage(mapping)
                dictionary = stage(dictionary.join(mapping, "id").select(F.col("new_id").alias("id"), "term", "kind"))
                ids = stage(encode(triples, dictionary))
        dictionary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/dict")
        for name in FULL if full_index else BASIC:
            order = list(name)
            ids.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{path}/{name}")
        stats = stage(statistics.predicate_sizes(ids))
        names = predicates_of(ids, dictionary, "id").select(F.col("id").alias("p"), "term")
        stats.join(names, "p").select(F.col("term").alias("p"), "n", "subjects", "objects").write.mode("overwrite").parquet(f"{path}/stats")
        spark.createDataFrame([(2, full_index, literal_dict, method, stats.agg(F.sum("n")).first()[0] or 0)], "format int, full_index boolean, literal_dict boolean, method string, triples long").write.mode("overwrite").parquet(f"{path}/meta")
        delete(spark, staged)
        return cls(spark, path)

    @classmethod
    def open(cls, spark: SparkSession, path: str, preload: bool = False) -> Store:
        return cls(spark, path, preload)

    def ids_of(self, terms: list[str]) -> dict[str, int]:
        """Ids of a query's constants; terms that the store lacks are missing."""
        return {r["term"]: r["id"] for r in self.dictionary.filter(F.col("term").isin(terms)).collect()} if terms else {}

    def sizes(self, query: Query) -> dict:
        """Statements, different subjects and objects of the query's predicates, by term; the rest under ''."""
        known = {r["p"]: planner.Size(r["n"], r["subjects"], r["objects"]) for r in self.stats.filter(F.col("p").isin(planner.constants(query))).collect()}
        rest = self.meta["triples"] - sum(x.rows for x in known.values())
        return known | {"": planner.Size.of(rest)}

    def _prescan(self, patterns: tuple[Pattern, ...]) -> tuple[dict, dict]:
        """Of patterns with a constant subject or object, which a sorted copy finds at once: their exact rows,
        and for each variable the least and largest id that all of them admit. One job."""
        bound = [t for t in dict.fromkeys(patterns) if t.variables and not (isinstance(t.s, Var) and isinstance(t.o, Var))]
        if len(patterns) < 2 or not bound:
            return {}, {}
        parts = []
        for i, t in enumerate(bound):
            rows, _ = self.relation.bindings(t, t.variables)
            ends = [F.array(F.min(v), F.max(v)) for v in t.variables]
            parts.append(rows.agg(F.count(F.lit(1)).alias("n"), F.array(*ends).alias("ends")).select(F.lit(i).alias("i"), "n", "ends"))
        counts, bounds = {}, {}
        for i, n, ends in reduce(DataFrame.unionAll, parts).collect():  # a row for each pattern
            counts[bound[i]] = n
            for v, (low, high) in zip(bound[i].variables, ends):
                low, high = (low, high) if n else (1, 0)  # nothing matches
                before = bounds.get(v, (low, high))
                bounds[v] = (max(low, before[0]), min(high, before[1]))
        return counts, bounds

    def sparql(self, text: str | Query) -> DataFrame:
        """As the dataset's; with `prescan`, the default, selective patterns are counted first, and their
        variables' bounds filter every other scan, so that sorted copies skip row groups."""
        query = parse(text) if isinstance(text, str) else text
        ids = self.ids_of(planner.constants(query))
        sizes = {ids[p] if p else -1: x for p, x in self.sizes(query).items() if not p or p in ids}
        place = lambda x: x if isinstance(x, Var) else ids.get(x, -1)
        encoded = Query(query.select, tuple(Pattern(*map(place, t.places)) for t in query.patterns))
        counts, bounds = self._prescan(encoded.patterns) if self.prescan else ({}, {})
        return decode(evaluate(encoded, Triples(self.copies["pso"], self.copies, sizes | counts, bounds)), self.dictionary)

    def predicates(self) -> DataFrame:
        """The dictionary's rows for predicates, broadcast if few."""
        few = self.stats.count() <= FEW_PREDICATES
        names = self.stats.select(F.col("p").alias("term"))
        found = self.dictionary.join(F.broadcast(names) if few else names, "term", "left_semi")
        return F.broadcast(found) if few else found

    def triples(self) -> DataFrame:
        """All statements as terms, repeated ones as often as they were loaded."""
        return decode(self.copies["pso"].select("s", "p", "o"), self.dictionary, self.predicates())

    def index(self, name: str, limit: int = 20) -> str:
        """The first rows of a sorted copy, one a line, in its order and with its columns in that order."""
        order = list(name)
        return "\n".join("\t".join(map(str, r)) for r in self.copies[name].select(*order).orderBy(*order).limit(limit).collect())

    def counts(self) -> DataFrame:
        return statistics.store_counts(self.copies["pso"])

    def write_ids(self, path: str) -> None:
        """Statements as ids, separated by blanks."""
        self.copies["pso"].select(F.concat_ws(" ", "s", "p", "o").alias("value")).write.mode("overwrite").text(path)

    def write_histograms(self, path: str, sizes: tuple[int, ...] = (100, 1_000, 10_000)) -> None:
        """Equal-width and equal-depth histograms of subject and object ids; literals of a separate
        dictionary lie beyond LITERAL_START and are left out."""
        parts = []
        for c in "so":
            rows = self.copies["pso"].filter(F.col(c) < LITERAL_START).select(c)
            for n in sizes:
                for kind, made in (("width", statistics.equal_width(rows, c, n)), ("depth", statistics.equal_depth(rows, c, n))):
                    parts.append(made.select(F.lit(c).alias("place"), F.lit(kind).alias("kind"), F.lit(n).alias("size"), "lower", "upper", "freq"))
        reduce(DataFrame.unionAll, parts).write.mode("overwrite").partitionBy("place", "kind", "size").parquet(path)


def read_histogram(spark: SparkSession, path: str, place: str, kind: str, size: int) -> DataFrame:
    """lower, upper, freq of one histogram that `write_histograms` wrote, for `range_cardinality` and `cut_point`."""
    found = spark.read.parquet(path).filter((F.col("place") == place) & (F.col("kind") == kind) & (F.col("size") == size))
    return found.select("lower", "upper", "freq")
