"""A basic graph pattern as one lazy DataFrame: scans, joins on shared variables, distinct projection.

Columns hold terms or, where the relation says so, the keys that stand for them (`Form`). Two columns of
one form are joined as they are; of different forms, as terms. What is selected becomes terms at the end.

Two patterns that meet in variables nobody selects may make far more rows than they have. From MANY on these
are dealt out in blocks, and made once each instead of being compared with all others (`_meeting`).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triplespark.plans.ast import Query
from triplespark.plans.planner import Step, plan
from triplespark.sources.relations import Form, Relation

Bindings = tuple[DataFrame, dict[str, Form]]

#: From so many rows on, two patterns that meet in unselected variables are joined by blocks.
MANY = 4_000_000
#: Rows of either side in a block, about; rows made by a task, and tasks at most.
BLOCK, TASK_ROWS, MOST_TASKS = 2_000, 8_000_000, 20_000


def _as_terms(found: Bindings, names) -> Bindings:
    rows, forms = found
    written = {v: forms[v].term(F.col(v)) for v in names if v in forms}
    return (rows.withColumns(written) if written else rows), {v: f for v, f in forms.items() if v not in written}


def _joined(left: Bindings, right: Bindings, on: tuple[str, ...], how: str) -> Bindings:
    unlike = [v for v in on if left[1].get(v) != right[1].get(v)]
    (a, forms), (b, others) = _as_terms(left, unlike), _as_terms(right, unlike)
    return a.join(b, list(on), how), forms if how == "left_semi" else others | forms


def _steps(relation: Relation, steps: list[Step], guards: list[DataFrame]) -> Bindings | None:
    """One component of a plan; its constant patterns go to the guards."""
    found: Bindings | None = None
    for step in steps:
        if step.op == "guard":
            guards.append(relation.match(*step.pattern.places).select().limit(1))
            continue
        if step.op == "scan":
            found = relation.bindings(step.pattern, step.keep)
        elif step.op == "star":
            found = _joined(found, _steps(relation, list(step.branch), guards), step.on, "inner")
        else:
            names = step.on if step.op == "semi" else tuple(v for v in step.pattern.variables if v in step.on or v in step.keep)
            found = _joined(found, relation.bindings(step.pattern, names), step.on, "left_semi" if step.op == "semi" else "inner")
        rows, forms = found
        if set(rows.columns) != set(step.keep):
            found = rows.select(*step.keep), {v: f for v, f in forms.items() if v in step.keep}
    return found


def _split(rows: DataFrame, own: list[str], lost: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows whose own columns stand with one value of the lost ones, and the others."""
    met = F.struct(*lost)
    ends = rows.groupBy(*own).agg(F.min(met).alias("__low"), F.max(met).alias("__high"))
    one = ends.filter("__low = __high").select(*own, *[F.col(f"__low.{v}").alias(v) for v in lost])
    more = ends.filter("__low <> __high").select(*own)
    same = reduce(lambda a, b: a & b, (F.col(f"m.{v}") == F.col(f"r.{v}") for v in own), F.lit(True))
    return one, rows.alias("r").join(more.alias("m"), same, "left_semi")


def _in_blocks(left: DataFrame, right: DataFrame, on: list[str], tasks: int) -> DataFrame:
    """An inner join of which each task makes about as many rows, however often a value occurs: each value's
    rows meet block by block, and each block's in one place."""
    count = lambda rows, name: rows.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias(name))
    blocks = count(left, "__n").join(count(right, "__m"), on)
    dealt = []
    for rows, mine, theirs, k in ((left, "__n", "__m", "__i"), (right, "__m", "__n", "__j")):
        other = "__j" if k == "__i" else "__i"
        own = F.pmod(F.xxhash64(*[v for v in rows.columns if v not in on]), F.col(mine)).alias(k)
        placed = rows.join(blocks, on).select(*rows.columns, own, F.explode(F.sequence(F.lit(0).cast("long"), F.col(theirs) - 1)).alias(other))
        dealt.append(placed.repartition(tasks, *on, "__i", "__j"))
    return dealt[0].join(dealt[1], [*on, "__i", "__j"])


def _meeting(steps: list[Step], relation: Relation) -> Bindings | None:
    """The distinct rows of two patterns that meet in variables which are not selected, if they are many.

    A pair of rows can come up twice only if both its sides stand with several values of these variables: only
    those pairs are compared with each other. How many rows there are takes a job that counts both sides by value.
    """
    if [s.op for s in steps] != ["scan", "join"] or not (lost := [v for v in steps[1].on if v not in steps[1].keep]):
        return None
    scan, join = steps
    on, keep = list(join.on), list(join.keep)
    names = tuple(v for v in join.pattern.variables if v in join.on or v in keep)
    found = relation.bindings(scan.pattern, scan.keep), relation.bindings(join.pattern, names)
    unlike = [v for v in on if found[0][1].get(v) != found[1][1].get(v)]
    (left, forms), (right, others) = (_as_terms(x, unlike) for x in found)
    count = lambda rows, name: rows.groupBy(*on).agg(F.count(F.lit(1)).cast("double").alias(name))
    made = count(left, "__n").join(count(right, "__m"), on).agg(F.sum(F.col("__n") * F.col("__m"))).first()[0] or 0
    if made < MANY:
        return None
    written = {v: f for v, f in (others | forms).items() if v not in on}  # each term once, not in every row made
    left, right = (_as_terms((rows, written), [v for v in written if v in rows.columns])[0].distinct() for rows in (left, right))
    tasks = int(min(MOST_TASKS, max(made / TASK_ROWS, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))))
    one, more = _split(left, [v for v in left.columns if v not in lost], lost)
    right_one, right_more = _split(right, [v for v in right.columns if v not in lost], lost)
    parts = [(one, right), (more, right_one), (more, right_more)]
    once, again, repeated = (_in_blocks(a, b, on, tasks).select(*keep) for a, b in parts)
    return once.unionAll(again).unionAll(repeated.distinct()), {v: f for v, f in (others | forms).items() if v in keep and v not in written}


def evaluate(query: Query, relation: Relation) -> DataFrame:
    """The distinct bindings of the selected variables, as terms, in the order of the SELECT."""
    parts: list[DataFrame] = []
    guards: list[DataFrame] = []
    forms: dict[str, Form] = {}
    relation.prepare(query.patterns)
    for steps in plan(query, relation.sizes()):
        if many := _meeting(steps, relation):
            parts.append(many[0])
            forms |= many[1]
            continue
        found = _steps(relation, steps, guards)
        if found is not None:
            # a component of which nothing is selected only has to exist
            rows, own = found
            parts.append(rows.distinct() if rows.columns else rows.limit(1))
            forms |= own
    out = reduce(lambda a, b: a.crossJoin(b), [*parts, *guards])
    return out.select(*[(forms[v].term(F.col(v)) if v in forms else F.col(v)).alias(v) for v in query.select])
