"""What a query did: counts from the metrics of the plan that ran."""

from __future__ import annotations

import time
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame


def _nodes(plan: Any) -> Iterator[Any]:
    """The nodes of an executed plan from the top, into the stages of adaptive execution."""
    yield plan
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
    elif name.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
    else:
        children = plan.children()
        for i in range(children.size()):
            yield from _nodes(children.apply(i))


def _metric(node: Any, name: str) -> int:
    metrics = node.metrics()
    return metrics.apply(name).value() if metrics.contains(name) else 0


def run(df: DataFrame) -> dict:
    """Run a plan and count: documents read from files, those that met the filter, rows returned, files
    and bytes read, groups made, and seconds.  Rows are counted where they are made, not collected."""
    execution = df._jdf.queryExecution()
    began = time.perf_counter()
    returned = execution.toRdd().count()
    elapsed = time.perf_counter() - began
    out = {"documents_examined": 0, "documents_matched": None, "documents_returned": returned, "files_read": 0, "bytes_read": 0, "groups": 0, "elapsed": elapsed}
    for node in _nodes(execution.executedPlan()):
        name = node.getClass().getSimpleName()
        rows = _metric(node, "numOutputRows")
        if name == "FileSourceScanExec":
            out["documents_examined"] += rows
            out["files_read"] += _metric(node, "numFiles")
            out["bytes_read"] += _metric(node, "filesSize")
        elif name == "FilterExec":
            # the last one from the top is the one on the scan
            out["documents_matched"] = rows
        elif name.endswith("AggregateExec") and not out["groups"]:
            out["groups"] = rows
    if out["documents_matched"] is None:
        out["documents_matched"] = out["documents_examined"]
    return out
