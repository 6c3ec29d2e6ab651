"""Streams over several small files give what one batch over all of them gives."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import engagement, tickets
from boxoffice.schema import ACTIVITY_SCHEMA
from boxoffice.session import new_folder
from boxoffice.sources import derived
from boxoffice.streaming import activity
from tests.conftest import SF, listing, reg, rows, user


@pytest.fixture
def events(spark):
    """The activity stream cut into six files, read two files at a time."""
    path = new_folder(spark, "events")
    spark.read.parquet(f"{SF}/events.parquet").repartitionByRange(6, "ts").write.parquet(path)
    return activity.read_stream(spark, path, ACTIVITY_SCHEMA, files_per_trigger=2)


def _versions(spark, frame, keys):
    path = new_folder(spark, "versions")
    activity.version_stream(frame, f"{path}/rows", f"{path}/progress", keys, compact_every=2).awaitTermination()
    return activity.latest_versions(spark, f"{path}/rows", frame.schema, keys)


def test_toggles_over_many_batches(spark, events):
    pair = ["user_id", "listing_id"]
    got = _versions(spark, activity.toggle_state(derived.save_toggles(events), pair), pair)
    batch = engagement.save_state(derived.save_toggles(spark.read.parquet(f"{SF}/events.parquet")))
    assert rows(got.filter("is_on"), *pair) == rows(batch, *pair)


def test_counters_over_many_batches(spark, events):
    got = _versions(spark, activity.activity_counts(events), ["event_type"])
    assert rows(got, "event_type", "events") == rows(
        spark.read.parquet(f"{SF}/events.parquet").groupBy("event_type").agg(F.count("*").alias("events")), "event_type", "events")


def test_a_restarted_stream_goes_on_where_it_stopped(spark):
    source, path = new_folder(spark, "source"), new_folder(spark, "restart")
    schema = "user_id long, listing_id long, ts timestamp_ntz"
    for part in ([(1, 1), (2, 1)], [(1, 1), (3, 1)]):
        spark.createDataFrame([(*p, datetime(2026, 1, 1)) for p in part], schema).coalesce(1).write.mode("append").parquet(source)
        stream = activity.toggle_state(activity.read_stream(spark, source, spark.read.parquet(source).schema), ["user_id", "listing_id"])
        activity.version_stream(stream, f"{path}/rows", f"{path}/progress", ["user_id", "listing_id"]).awaitTermination()
    got = activity.latest_versions(spark, f"{path}/rows", stream.schema, ["user_id", "listing_id"])
    assert rows(got, "user_id", "is_on") == [(1, False), (2, True), (3, True)]


def test_every_view_counts_however_late(spark):
    source, path = new_folder(spark, "views"), new_folder(spark, "daily")
    batches = [["2026-01-01 10:00", "2026-01-02 09:00"], ["2026-01-01 23:00", "2026-01-04 12:00"], ["2026-01-01 11:00", "2026-01-08 00:00"]]
    for batch in batches:
        frame = spark.createDataFrame([(i, 7, datetime.fromisoformat(x)) for i, x in enumerate(batch)], "event_id long, listing_id long, ts timestamp_ntz")
        frame.coalesce(1).write.mode("append").parquet(source)
        stream = engagement.daily_views(activity.read_stream(spark, source, frame.schema))
        activity.version_stream(stream, f"{path}/rows", f"{path}/progress", ["listing_id", "day"], compact_every=2).awaitTermination()
    got = activity.latest_versions(spark, f"{path}/rows", stream.schema, ["listing_id", "day"])
    assert rows(got, "day", "views") == [("2026-01-01", 3), ("2026-01-02", 1), ("2026-01-04", 1), ("2026-01-08", 1)]


def _cut(spark, frame, by, files=4):
    path = new_folder(spark, "cut")
    frame.repartitionByRange(files, by).write.parquet(path)
    return activity.read_stream(spark, path, frame.schema, files_per_trigger=1)


def test_headline_numbers_over_many_batches(spark):
    from boxoffice.operators.platform import platform_kpis
    from boxoffice.plans.catalog import AS_OF
    t = derived.from_trade_tables(spark, SF)
    new = {n: _cut(spark, getattr(t, n), "created_at") for n in ("users", "listings", "registrations", "payments")}
    got = activity.kpi_row(_versions(spark, activity.kpi_totals(**new, as_of=AS_OF), ["kpi"]))
    assert got.collect() == platform_kpis(t, as_of=AS_OF).select(*got.columns).collect()


def test_unread_messages_over_many_batches(spark):
    t = derived.from_trade_tables(spark, SF)
    got = _versions(spark, activity.unread_messages(_cut(spark, t.messages, "sent_at"), t.threads), ["user_id"])
    assert rows(got.filter("unread > 0"), "user_id", "unread") == rows(engagement.unread_messages(t).filter("unread > 0"), "user_id", "unread")


def test_publish_notices_go_to_the_followers_of_the_moment(spark):
    t, path = derived.from_trade_tables(spark, SF), new_folder(spark, "notices")
    spans = engagement.follow_spans(t.follow_toggles)
    stream = engagement.publish_fanout(t, _cut(spark, t.status_log, "ts"), spans)
    activity.append_stream(stream, f"{path}/rows", f"{path}/progress").awaitTermination()
    batch = engagement.publish_fanout(t, t.status_log, spans)
    assert batch.count() > 0
    assert rows(spark.read.parquet(f"{path}/rows"), *batch.columns) == rows(batch, *batch.columns)


def test_the_sweep_ends_a_listing_after_later_ticks(spark, tables):
    path = new_folder(spark, "sweep")
    t = tables(listings=[listing(1, date_end=datetime(2026, 6, 2)), listing(2, date_end=datetime(2026, 6, 9)), listing(3, date_end=datetime(2026, 7, 1))])
    seen = []
    for tick in (datetime(2026, 6, 3), datetime(2026, 6, 10)):
        spark.createDataFrame([(tick,)], "tick timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/ticks")
        ticks = activity.read_stream(spark, f"{path}/ticks", spark.read.parquet(f"{path}/ticks").schema)
        activity.lifecycle_sweep(ticks, lambda: t.listings, f"{path}/rows", f"{path}/progress").awaitTermination()
        schema = "listing_id long, old_status string, new_status string"
        got = activity.latest_versions(spark, f"{path}/rows", spark.createDataFrame([], schema).schema, ["listing_id"])
        seen.append(rows(got, "listing_id", "new_status"))
    assert seen == [[(1, "ended")], [(1, "ended"), (2, "ended")]]


def test_compaction_leaves_few_versions_to_read(spark, events):
    path, pair = new_folder(spark, "compact"), ["user_id", "listing_id"]
    frame = activity.toggle_state(derived.save_toggles(events), pair)
    activity.version_stream(frame, f"{path}/rows", f"{path}/progress", pair, compact_every=2).awaitTermination()
    newest = spark.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows").select("base", "version").distinct().collect()
    assert {(r["base"], r["version"]) for r in newest} == {(0, 0), (0, 1), (2, 2)}


def test_first_scans_equal_the_batch_successes(spark, tables):
    t = tables(users=[user(900, "creator"), user(1)], listings=[listing(1)], registrations=[reg(1, 1, 1), reg(2, 1, 1, "pending"), reg(3, 1, 1)])
    source = new_folder(spark, "scans")
    schema = "scan_id string, scanner_id long, ticket_code string, listing_id long, ts timestamp_ntz"
    log = [("b", 900, "C1", 1, 2), ("a", 900, "C1", 1, 1), ("c", 900, "C2", 1, 1), ("d", 900, None, 1, 1), ("e", 901, "C3", 1, 1), ("f", 900, "C3", 1, 9)]
    for part in (log[:2], log[2:]):
        spark.createDataFrame([(*x[:4], datetime(2026, 5, 1, 0, x[4])) for x in part], schema).coalesce(1).write.mode("append").parquet(source)
    static = spark.read.parquet(source)
    stream = activity.first_scans(activity.valid_scans(activity.read_stream(spark, source, static.schema, files_per_trigger=1), t.listings, t.registrations))
    got = _versions(spark, stream, ["registration_id"])
    batch = tickets.checkin_verdicts(t, static).filter("verdict = 'success'")
    assert rows(got, "scan_id") == rows(batch, "scan_id") == [("a",), ("f",)]
