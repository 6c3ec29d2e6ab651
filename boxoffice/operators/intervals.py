"""Joining moments with the spans that hold them, per key, without making the pairs that fail.

Time is cut in days, days in a binary tree. A span covers the days strictly between its first and last one by at most two nodes
a level, and its two edge days by leaves of their own; a moment asks for its day and every node above it. Both meet in an equi-join on
key and node: a moment inside the covered days meets the span once and belongs to it, so only pairs on
a span's edge days are tested in vain.

A key with more than ``HEAVY`` spans has them dealt over as many parts as it takes, and its moments go to every part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_DAY = "0001-01-01"
LEVELS = 22  # 2^22 days: every date that Spark can write
HEAVY = 100_000


def _day(moment: Column) -> Column:
    return F.datediff(moment, F.lit(FIRST_DAY).cast("date")).cast("long")


def _node(level: int, number: Column, edge: bool = False) -> Column:
    return F.struct(F.lit(level).alias("level"), number.alias("number"), F.lit(edge).alias("edge"))


def span_nodes(start: Column, end: Column) -> Column:
    """The nodes of a span from ``start`` up to before ``end`` (NULL: without end)."""
    first, last = _day(start), F.coalesce(_day(end), F.lit(1 << LEVELS))
    low, high = first + 1, last
    nodes = [_node(0, first, True), F.when(end.isNotNull() & (last > first), _node(0, last, True))]
    for k in range(LEVELS + 1):
        left, right = F.shiftright(low + ((1 << k) - 1), k), F.shiftright(high, k)  # whole nodes of the level
        nodes.append(F.when((left < right) & (left % 2 == 1), _node(k, left)))
        nodes.append(F.when((left < right) & (right % 2 == 1), _node(k, right - 1)))
    return F.array_compact(F.array(*nodes))


def moment_nodes(moment: Column) -> Column:
    day = _day(moment)
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(day, k).alias("number")) for k in range(LEVELS + 1)))


def interval_candidates(moments: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, spread_by: str, heavy: int = HEAVY) -> DataFrame:
    """The pairs whose nodes meet, with the columns of both sides and ``_edge``: whether the times must still be compared."""
    spans = spans.filter(F.col(start).isNotNull() & (F.col(end).isNull() | (F.col(end) > F.col(start))))
    parts = spans.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > heavy).select(
        key, F.ceil(F.col("_n") / heavy).cast("int").alias("_parts"))
    of = F.coalesce("_parts", F.lit(1))
    dealt = spans.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(spread_by), of).cast("int")).drop("_parts")
    asked = moments.filter(F.col(at).isNotNull()).join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), of - 1))).drop("_parts")
    left = asked.select("*", F.inline(moment_nodes(F.col(at))).alias("_level", "_number"))
    right = dealt.select("*", F.inline(span_nodes(F.col(start), F.col(end))).alias("_level", "_number", "_edge"))
    return left.join(right, [key, "_part", "_level", "_number"]).drop("_part", "_level", "_number")


def interval_join(moments: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, spread_by: str, heavy: int = HEAVY) -> DataFrame:
    """Every moment with every span of its key that holds it: ``start`` <= ``at`` < ``end``. ``moments`` may be a stream.

    Spans that end where they start, or before, hold nothing; ``spread_by`` is a column of ``spans`` that tells a key's spans apart.
    """
    pairs = interval_candidates(moments, spans, key, at, start, end, spread_by, heavy)
    inside = (F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return pairs.filter(~F.col("_edge") | inside).drop("_edge")
