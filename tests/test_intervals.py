"""The interval join against all pairs, and how few pairs it makes."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import intervals
from tests.conftest import rows

SPANS = "k long, who long, a timestamp_ntz, b timestamp_ntz"
MOMENTS = "k long, event long, ts timestamp_ntz"
START = datetime(2024, 2, 27)


def some(seed, spans=400, moments=150):
    rng = random.Random(seed)
    moment = lambda: START + timedelta(hours=rng.randrange(24 * 300))
    key = lambda: 1 if rng.random() < 0.5 else rng.randrange(2, 9)
    held = [(key(), i, a, None if rng.random() < 0.3 else a + timedelta(hours=rng.choice([0, 1, 23, 24, 25, 48, 700, 5000, -3])))
            for i, a in ((i, moment()) for i in range(spans))]
    odd = [(1, 900, None, START), (1, 901, datetime(1, 1, 1), datetime(9999, 12, 31, 23)), (1, 902, datetime(1, 1, 1), None), (2, 903, datetime(9999, 12, 31), None),
           (None, 904, START, None)]
    asked = [(key(), i, moment()) for i in range(moments)]
    return held + odd, asked + [(1, 990, datetime(1, 1, 1)), (2, 991, datetime(9999, 12, 31, 23)), (1, 992, None), (None, 993, START), (7, 994, START)]


@pytest.mark.parametrize("heavy", [20, 100_000])
def test_equals_all_pairs(spark, heavy):
    spans, asked = some(heavy)
    got = intervals.interval_join(spark.createDataFrame(asked, MOMENTS), spark.createDataFrame(spans, SPANS), "k", "ts", "a", "b", "who", heavy)
    want = sorted((k, e, w) for k, e, ts in asked for k2, w, a, b in spans
                  if k is not None and k == k2 and ts is not None and a is not None and a <= ts and (b is None or ts < b))
    assert rows(got, "k", "event", "who") == want


def test_pairs_that_fail_are_only_made_on_edge_days(spark):
    """Spans of a week in five years: all pairs of a key would be a hundred times as many as those that hold."""
    rng = random.Random(1)
    day = lambda: START + timedelta(minutes=rng.randrange(1440 * 1800))
    spans = [(i % 3, i, a, a + timedelta(days=7, minutes=11)) for i, a in ((i, day()) for i in range(1500))]
    asked = [(i % 3, i, day()) for i in range(900)]
    sides = (spark.createDataFrame(asked, MOMENTS), spark.createDataFrame(spans, SPANS), "k", "ts", "a", "b", "who")
    made, held = intervals.interval_candidates(*sides).count(), intervals.interval_join(*sides).count()
    assert held <= made <= 1.3 * held < 0.02 * 500 * 300 * 3


def test_a_span_is_cut_in_few_nodes(spark):
    one = spark.createDataFrame([(1, 1, START, None), (1, 2, START, START + timedelta(days=3000)), (1, 3, START, START + timedelta(hours=1))], SPANS)
    sizes = [r[0] for r in one.orderBy("who").select(F.size(intervals.span_nodes(F.col("a"), F.col("b")))).collect()]
    assert sizes[2] == 1 and sizes[1] <= 2 + 2 * 12 and sizes[0] <= 1 + 22
