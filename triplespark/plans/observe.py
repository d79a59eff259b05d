"""What a query has done: the rows that each operator of its executed plan made, and the phases' seconds."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame


def _nodes(plan, depth: int = 0):
    """(depth, name, description, rows made) of a physical plan's operators, from the result down."""
    name = plan.nodeName()
    inner = {"AdaptiveSparkPlan": "executedPlan", "ResultQueryStage": "plan", "ShuffleQueryStage": "plan", "BroadcastQueryStage": "plan", "ReusedExchange": "child"}.get(name)
    if inner:
        yield from _nodes(getattr(plan, inner)(), depth)
        return
    metrics = plan.metrics()
    rows = metrics.get("numOutputRows")
    if rows.isDefined():
        yield depth, name, plan.simpleString(6), rows.get().value()
        depth += 1
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i), depth)


def observed(df: DataFrame) -> dict:
    """Run a DataFrame without fetching it. `rows`; `phases`: seconds of analysis, optimization, planning and
    execution; `operators`: (depth, name, description, rows, selectivity), a join's selectivity being its rows
    by the product of those that came in, any other's its rows by those below, null where that is unknown."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    rows = execution.toRdd().count()
    seconds = time.perf_counter() - began
    found = list(_nodes(execution.executedPlan()))
    operators = []
    for i, (depth, name, what, n) in enumerate(found):
        below = []
        for d, _, _, m in found[i + 1:]:
            if d <= depth:
                break
            if d == depth + 1:
                below.append(m)
        came = 1
        for m in below:
            came *= m
        operators.append((depth, name, what, n, n / came if below and came else None))
    phases, each = {}, execution.tracker().phases().iterator()
    while each.hasNext():
        pair = each.next()
        phases[pair._1()] = pair._2().durationMs() / 1000
    return {"rows": rows, "phases": phases | {"execution": round(seconds, 6)}, "operators": operators}
