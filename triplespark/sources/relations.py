"""Where triple patterns find their rows: something that scans a pattern, lazily, as a DataFrame.

`Triples` is a table of s, p, o (with PSO/POS and, optionally, four more sorted copies). `Mapped` reads
relational tables as triples: one source per predicate, so that a constant predicate touches one table
and two of its columns, and constant subjects and objects turn into filters on the key columns, which
reach the Parquet scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triplespark.functions.terms import literal_column
from triplespark.plans.ast import Pattern, Var

EX = "http://ex/"


@dataclass(frozen=True)
class Form:
    """How the values of a column stand for terms: as the keys of IRIs of a class, or the text of plain
    literals, by SQL type. Columns of one form can be compared and joined as they are."""

    kind: str | None
    type: str

    def term(self, value: Column) -> Column:
        return literal_column(value) if self.kind is None else F.concat(F.lit(f"<{EX}{self.kind}/"), value.cast("string"), F.lit(">"))


class Relation:
    """The interface: rows s, p, o that match the constants (None: any)."""

    def match(self, s: str | None, p: str | None, o: str | None) -> DataFrame:
        raise NotImplementedError

    def bindings(self, t: Pattern, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Form]]:
        """A pattern's matches, a column for each named variable, and the forms of those that don't hold
        terms; a variable that stands twice filters for equality."""
        rows = self.match(*[None if isinstance(x, Var) else x for x in t.places])
        first: dict[str, str] = {}
        for column, x in zip("spo", t.places):
            if isinstance(x, Var):
                if x.name in first:
                    rows = rows.filter(F.col(column) == F.col(first[x.name]))
                else:
                    first[x.name] = column
        return rows.select(*[F.col(first[v]).alias(v) for v in names]), {}

    def sizes(self) -> dict[str, int]:
        """Statements by predicate as far as they are known without a job."""
        return {}

    def prepare(self, patterns: Iterable[Pattern]) -> None:
        """Open what the patterns need."""


class Triples(Relation):
    """A table of triples; `copies` has the same rows in other sort orders, by name such as pso; `bounds`
    are the least and largest value that a variable can take, known beforehand."""

    def __init__(self, table: DataFrame, copies: dict[str, DataFrame] | None = None, sizes: dict | None = None, bounds: dict[str, tuple] | None = None):
        self.table, self.copies, self._sizes, self.bounds = table, copies or {}, sizes or {}, bounds or {}

    def copy_for(self, s, p, o) -> DataFrame:
        """The copy whose sort order begins with the constant places, so row groups are skipped by their bounds."""
        fixed = {n for n, x in zip("spo", (s, p, o)) if x is not None}
        for name, table in self.copies.items():
            if set(name[:len(fixed)]) == fixed:
                return table
        for name, table in self.copies.items():
            if name[0] in fixed:
                return table
        return self.table

    def match(self, s, p, o) -> DataFrame:
        rows = self.copy_for(s, p, o)
        for name, x in zip("spo", (s, p, o)):
            if x is not None:
                rows = rows.filter(F.col(name) == x)
        return rows.select("s", "p", "o")

    def bindings(self, t: Pattern, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Form]]:
        rows, forms = super().bindings(t, names)
        for v in names:
            if v in self.bounds:  # below the projection, so that they reach the scan and skip row groups
                rows = rows.filter(F.col(v).between(*self.bounds[v]))
        return rows, forms

    def sizes(self) -> dict:
        return self._sizes


@dataclass(frozen=True)
class Place:
    """A column as terms: IRIs of a class, or plain literals. Several columns make a key joined by '-'."""

    columns: tuple[str, ...]
    kind: str | None = None

    def term(self) -> Column:
        if self.kind is None:
            return literal_column(F.col(self.columns[0]))
        return F.concat(F.lit(f"<{EX}{self.kind}/"), F.concat_ws("-", *[F.col(c).cast("string") for c in self.columns]), F.lit(">"))

    def raw(self, types: dict[str, str]) -> tuple[Column, Form | None]:
        """The values, as a single column of a form where there is one, else as terms."""
        column = self.columns[0]
        if len(self.columns) == 1 and types[column] in ("tinyint", "smallint", "int", "bigint"):
            return F.col(column).cast("bigint"), Form(self.kind, "bigint")
        if len(self.columns) == 1 and types[column] == "string":
            return F.col(column), Form(self.kind, "string")
        return self.term(), None

    def present(self) -> Column:
        return reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in self.columns))

    def equals(self, term: str, types: dict[str, str]) -> Column | None:
        """A filter on the columns for a constant term; None if no row can have it."""
        if self.kind is None:
            m = re.fullmatch(r'"(.*)"', term, re.S)
            if not m:
                return None
            if types[self.columns[0]] == "string":
                return self.term() == term if "\\" in term else F.col(self.columns[0]) == m[1]
            return self._number(self.columns[0], m[1])
        m = re.fullmatch(rf"<{re.escape(EX)}{self.kind}/(.*)>", term, re.S)
        if not m:
            return None
        if len(self.columns) > 1 or types[self.columns[0]] == "string":
            return self.term() == term
        return self._number(self.columns[0], m[1])

    @staticmethod
    def _number(column: str, text: str) -> Column | None:
        if not re.fullmatch(r"0|-?[1-9][0-9]{0,17}", text):  # only the way it is written
            return None
        return F.col(column) == F.lit(int(text))


@dataclass(frozen=True)
class Source:
    table: str
    subject: Place
    object: Place


def _iri(kind: str, *columns: str) -> Place:
    return Place(columns, kind)


def _lit(column: str) -> Place:
    return Place((column,))


#: The driver's tables as triples: by predicate. Only strings and integers become literals, as other
#: engines may write doubles differently.
VOCABULARY: dict[str, Source] = {
    name: Source(table, subject, obj)
    for table, subject, predicates in (
        ("region", _iri("region", "r_regionkey"), {"r_name": _lit("r_name")}),
        ("nation", _iri("nation", "n_nationkey"), {"n_name": _lit("n_name"), "n_region": _iri("region", "n_regionkey")}),
        ("customer", _iri("customer", "c_custkey"), {"c_nation": _iri("nation", "c_nationkey"), "c_mktsegment": _lit("c_mktsegment"), "c_name": _lit("c_name")}),
        ("supplier", _iri("supplier", "s_suppkey"), {"s_nation": _iri("nation", "s_nationkey"), "s_name": _lit("s_name")}),
        ("part", _iri("part", "p_partkey"), {"p_brand": _lit("p_brand"), "p_type": _lit("p_type"), "p_size": _lit("p_size")}),
        ("orders", _iri("order", "o_orderkey"), {"o_cust": _iri("customer", "o_custkey"), "o_orderstatus": _lit("o_orderstatus"), "o_orderpriority": _lit("o_orderpriority")}),
        ("lineitem", _iri("order", "l_orderkey"), {"hasPart": _iri("part", "l_partkey"), "hasSupp": _iri("supplier", "l_suppkey")}),
        ("events", _iri("event", "event_id"), {"e_user": _iri("customer", "user_id"), "e_type": _lit("event_type")}),
        ("documents", _iri("document", "doc_id"), {"d_lang": _lit("lang"), "d_source": _lit("source")}),
        ("labels", _iri("document", "doc_id"), {"d_quality": _lit("quality"), "d_toxic": _lit("toxic")}),
        ("conversations", _iri("turn", "conv_id", "turn"), {"t_role": _lit("role")}),
    )
    for name, obj in predicates.items()
}
#: All tables of the vocabulary.
TABLES = tuple(dict.fromkeys(source.table for source in VOCABULARY.values()))


class Mapped(Relation):
    """The tables of a folder of Parquet files as triples."""

    def __init__(self, spark: SparkSession, folder: str, tables: tuple[str, ...] = TABLES, vocabulary: dict[str, Source] = VOCABULARY):
        self.spark = spark
        self.sources = {f"<{EX}{name}>": source for name, source in vocabulary.items() if source.table in tables}
        self.folder, self.names = folder, tables
        self._read: dict[str, DataFrame] = {}

    def frame(self, name: str) -> DataFrame:
        """A table, opened when a pattern first needs it."""
        if name not in self._read:
            self._read[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._read[name]

    def open(self, names: Iterable[str]) -> None:
        """Open tables at once: finding a table's schema is a job that waits more than it works."""
        new = [n for n in dict.fromkeys(names) if n not in self._read]
        if len(new) > 1:
            with ThreadPoolExecutor(len(new)) as pool:
                list(pool.map(self.frame, new))

    def prepare(self, patterns: Iterable[Pattern]) -> None:
        every = [x.table for x in self.sources.values()]
        self.open(n for t in patterns for n in ([self.sources[t.p].table] if t.p in self.sources else every if isinstance(t.p, Var) else []))

    def match(self, s, p, o) -> DataFrame:
        if s is None and p is None and o is None:
            return self.table()
        wanted = self.sources if p is None else {p: self.sources[p]} if p in self.sources else {}
        parts = [x for name, source in wanted.items() if (x := self._match_one(name, source, s, o)) is not None]
        if not parts:
            return self.spark.createDataFrame([], "s string, p string, o string")
        return reduce(DataFrame.unionAll, parts)

    def _filtered(self, source: Source, s, o) -> DataFrame | None:
        """A source's rows with the constants, None if no row can have them."""
        rows = self.frame(source.table)
        types = dict(rows.dtypes)
        for place, x in ((source.subject, s), (source.object, o)):
            condition = place.present() if x is None else place.equals(x, types)
            if condition is None:
                return None
            rows = rows.filter(condition)
        return rows

    def _match_one(self, name: str, source: Source, s, o) -> DataFrame | None:
        rows = self._filtered(source, s, o)
        return None if rows is None else rows.select(source.subject.term().alias("s"), F.lit(name).alias("p"), source.object.term().alias("o"))

    def bindings(self, t: Pattern, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, Form]]:
        """With a constant predicate the key columns themselves: joins compare keys, and terms are written
        for the result only."""
        source = self.sources.get(t.p) if isinstance(t.p, str) else None
        s, o = (None if isinstance(x, Var) else x for x in (t.s, t.o))
        rows = None if source is None or t.s == t.o else self._filtered(source, s, o)
        if rows is None:
            return super().bindings(t, names)
        types, columns, forms = dict(rows.dtypes), [], {}
        places = {x.name: place for x, place in ((t.s, source.subject), (t.o, source.object)) if isinstance(x, Var)}
        for v in names:
            value, form = places[v].raw(types)
            columns.append(value.alias(v))
            if form:
                forms[v] = form
        return rows.select(*columns), forms

    def predicate_counts(self) -> DataFrame:
        """p, n: statements by predicate, each table scanned once for what is null in it, no term written."""
        self.open(self.names)
        parts = []
        for t in self.names:
            own = {n: x for n, x in self.sources.items() if x.table == t}
            if own:
                counts = self.frame(t).agg(*[F.count(F.when(x.subject.present() & x.object.present(), 1)).alias(f"n{i}") for i, x in enumerate(own.values())])
                parts.append(counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("p"), F.col(f"n{i}").alias("n")) for i, n in enumerate(own)]))))
        return reduce(DataFrame.unionAll, parts).filter("n > 0")

    def degrees(self) -> DataFrame:
        """node, degree: how often each term is a subject or an object, counted by key; a term is written once."""
        self.open(self.names)
        frames: dict[tuple[bool, str], list[DataFrame]] = {}
        for t in self.names:
            df, own = self.frame(t), [x for x in self.sources.values() if x.table == t]
            types, by_type, subjects, uses = dict(df.dtypes), {}, {}, []
            for x in own:
                there = (x.subject.present() & x.object.present()).cast("bigint")
                subjects[x.subject] = subjects[x.subject] + there if x.subject in subjects else there
                uses.append((x.object, there))
            for place, many in [*subjects.items(), *uses]:
                value, form = place.raw(types)  # without a form it is a term, under no kind
                kind = (form.kind is None, form.type) if form else (False, "string")
                by_type.setdefault(kind, []).append((form.kind or "" if form else None, value, many))
            for kind, parts in by_type.items():
                each = F.array(*[F.struct(F.lit(name).alias("kind"), value.alias("value"), many.alias("n")) for name, value, many in parts])
                frames.setdefault(kind, []).append(df.select(F.inline(each)).filter("n > 0"))
        found, literals = [], []
        for (literal, _), same in frames.items():
            counted = reduce(DataFrame.unionAll, same).groupBy("kind", "value").agg(F.sum("n").alias("degree"))
            iri = F.concat(F.lit(f"<{EX}"), "kind", F.lit("/"), F.col("value").cast("string"), F.lit(">"))
            term = literal_column(F.col("value")) if literal else F.when(F.col("kind").isNull(), F.col("value").cast("string")).otherwise(iri)
            (literals if literal else found).append(counted.select(term.alias("node"), "degree"))
        if literals:  # numbers and strings may be the same literal
            found.append(reduce(DataFrame.unionAll, literals).groupBy("node").agg(F.sum("degree").alias("degree")))
        return reduce(DataFrame.unionAll, found)

    def table(self) -> DataFrame:
        """All triples, each table read once: its predicates are exploded together."""
        self.open(self.names)
        parts = []
        for t in self.names:
            own = {n: x for n, x in self.sources.items() if x.table == t}
            if own:
                df = self.frame(t)
                each = F.array(*[F.struct(x.subject.term().alias("s"), F.lit(n).alias("p"), x.object.term().alias("o")) for n, x in own.items()])
                rows = df.select(F.inline(each))
                parts.append(rows.filter("s is not null and o is not null"))
        return reduce(DataFrame.unionAll, parts)
