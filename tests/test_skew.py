"""One listing, one attendee or one code owns half of all rows: the raw-row joins must split it."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import attendees, engagement, lifecycle, search, tickets
from boxoffice.schema import SCHEMAS
from boxoffice.sources.tables import Tables

AS_OF = datetime(2026, 5, 1)
ROWS = 200_000


def _native(spark, name, frame):
    have = set(frame.columns)
    fields = [F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields]
    return frame.select(*fields)


@pytest.fixture(scope="module")
def hot(spark):
    """Half of the registrations are for listing 7, and half of them by attendee 7."""
    keys = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB", "spark.sql.shuffle.partitions": "16",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "50KB",
    }
    before = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    i = F.col("id")
    moment = F.lit("2026-01-01").cast("timestamp_ntz")
    regs = spark.range(0, ROWS, 1, 8).select(
        i, F.when(i % 4 < 2, 7).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("user_id"),
        F.when(i % 2 == 0, 7).otherwise(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2000))).alias("listing_id"),
        F.concat(F.lit("C"), i.cast("string")).alias("ticket_code"), F.lit("confirmed").alias("status"), F.lit(False).alias("checked_in"),
        moment.alias("created_at"))
    shows = spark.range(2000).select(
        i, (F.lit(900_000) + i % 50).alias("creator_id"), F.lit("t").alias("title"), F.lit("concert").alias("type"), moment.alias("created_at"),
        F.lit("2026-06-01").cast("timestamp_ntz").alias("date_start"), F.lit(500).alias("capacity"), F.lit(1).alias("price"), F.lit("published").alias("status"))
    people = spark.range(5000).select(i, F.lit("n").alias("name"), F.lit("user").alias("role"), F.lit(False).alias("is_banned"), moment.alias("created_at"))
    t = Tables.of(spark, **{n: _native(spark, n, f) for n, f in (("registrations", regs), ("listings", shows), ("users", people))},
                  payments=spark.createDataFrame([], SCHEMAS["payments"]))
    yield t
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _final_plan(frame):
    """The plan as it ran, with every column in use."""
    digest = frame.agg(F.bit_xor(F.xxhash64(*frame.columns)))
    digest.collect()
    return digest._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,build", [
    ("ticket_book", lambda t: attendees.ticket_book(t, as_of=AS_OF)),
    ("user_summary", lambda t: attendees.user_summary(t, as_of=AS_OF)),
    ("user_type_history", attendees.user_type_history),
    ("registration_ledger", search.registration_ledger),
    ("attendee_export", tickets.attendee_export),
    ("settlement", tickets.settlement),
])
def test_raw_joins_split_the_hot_key(hot, name, build):
    assert "skew=true" in _final_plan(build(hot))


def test_admission_of_a_hot_listing(hot):
    requests = hot.registrations.select("id", "user_id", "listing_id", F.col("created_at"))
    got = tickets.admission(requests, hot.listings, hot.users)
    assert "skew=true" in _final_plan(got)
    seats = got.filter("verdict = 'admitted'").groupBy("listing_id").count()
    assert seats.agg(F.max("count")).collect()[0][0] <= 500
    assert seats.filter("listing_id = 7").collect()[0]["count"] == 500
    assert got.count() == ROWS


def test_hot_listing_positions_use_many_slices(hot):
    from boxoffice.operators import base
    placed = base.positions(hot.registrations.select("id", "listing_id"), ["listing_id"], [F.asc("id")], "n")
    assert placed.filter("listing_id = 7").agg(F.max("n"), F.count("*"), F.count_distinct("n")).collect()[0][:2] == (
        hot.registrations.filter("listing_id = 7").count(),) * 2


def test_toggles_of_one_attendee(hot, spark):
    log = spark.range(50_000).select(
        F.col("id").alias("event_id"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id") % 5000).alias("user_id"),
        F.lit("toggle").alias("action"), F.lit("2026-01-01").cast("timestamp_ntz").alias("ts"))
    got = {r.user_id: r.is_banned for r in lifecycle.ban_state(hot, log).filter("user_id in (7, 9)").collect()}
    flips = {u: log.filter(f"user_id = {u}").count() for u in (7, 9)}
    assert got == {u: n % 2 == 1 for u, n in flips.items()}
    toggles = log.select("event_id", F.col("user_id").alias("follower_id"), F.lit(900_000).alias("creator_id"), "ts")
    assert engagement.follow_spans(toggles).filter("follower_id = 7").count() == (flips[7] + 1) // 2
