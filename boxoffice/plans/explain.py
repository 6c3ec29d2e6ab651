"""Checks on physical plans: what must not occur at scale, counted from the plan text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

MARKS = {
    "cartesian": r"CartesianProduct",
    "nested_loop": r"BroadcastNestedLoopJoin",
    "python": r"ArrowEvalPython|BatchEvalPython|MapInPandas|FlatMapGroupsInPandas",
    "single_partition": r"Exchange SinglePartition",
    "shuffles": r"Exchange (?:hash|range|Round)",
    "broadcast_joins": r"BroadcastHashJoin",
    "merge_joins": r"SortMergeJoin|ShuffledHashJoin",
    "windows": r"\+- Window |^Window ",
    "group_limits": r"WindowGroupLimit",
}


def plan_text(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def plan_counts(frame: DataFrame) -> dict[str, int]:
    text = plan_text(frame)
    return {name: len(re.findall(pattern, text, re.M)) for name, pattern in MARKS.items()}


def pushed_filters(frame: DataFrame) -> list[str]:
    """The filter lists that reached file scans."""
    return re.findall(r"PushedFilters: \[([^\]]*)\]", plan_text(frame))


def read_columns(frame: DataFrame) -> list[str]:
    """The column lists that file scans read."""
    return re.findall(r"ReadSchema: struct<([^>]*)>", plan_text(frame))
