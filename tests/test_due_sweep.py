"""The sweep from the calendar: over many ticks, edits and restarts every change comes once, and a tick reads few days."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boxoffice.operators.lifecycle import lifecycle_update
from boxoffice.session import new_folder
from boxoffice.streaming import activity, due
from tests.conftest import listing, rows

DAY = datetime(2026, 6, 1)


def test_every_change_comes_once(spark, tables):
    path, start = new_folder(spark, "due"), [
        listing(1, date_end=DAY + timedelta(hours=5)), listing(2, date_end=DAY + timedelta(days=3)), listing(3, date_end=None),
        listing(4, status="draft", date_start=DAY + timedelta(days=1)), listing(5, status="cancelled", date_end=DAY), listing(6, date_end=DAY + timedelta(days=2)),
        listing(7, date_end=DAY + timedelta(days=2)), listing(8, date_end=DAY + timedelta(days=1))]
    current = {r["id"]: r for r in start}
    # before the tick of that number: listings edited (6 put off, 7 withdrawn, 9 new and overdue, 4 published late, 8 put on again)
    edits = {2: [listing(6, date_end=DAY + timedelta(days=5)), listing(7, status="cancelled", date_end=DAY + timedelta(days=2)),
                 listing(9, date_end=DAY - timedelta(days=9)), listing(8, date_end=DAY + timedelta(days=4))]}
    ticks = [DAY, DAY + timedelta(hours=5), DAY + timedelta(days=1, hours=1), DAY + timedelta(days=3, hours=2), DAY + timedelta(days=3, hours=2), DAY + timedelta(days=9)]
    frame = lambda given: tables(listings=given).listings
    due.enter(frame(start), f"{path}/calendar", known_at=DAY - timedelta(days=30))
    seen = {}
    for n, tick in enumerate(ticks):
        if n in edits:
            due.enter(frame(edits[n]), f"{path}/calendar", known_at=ticks[n - 1])
            current |= {r["id"]: r for r in edits[n]}
        spark.createDataFrame([(tick,)], "tick timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/clock")
        clock = activity.read_stream(spark, f"{path}/clock", spark.read.parquet(f"{path}/clock").schema)
        now = lambda: due.with_changes(frame(list(current.values())), due.emitted(spark, f"{path}/out"))
        expected = {(r["listing_id"], r["new_status"]) for r in lifecycle_update(now(), as_of=tick).collect()}
        due.due_sweep(clock, f"{path}/calendar", now, f"{path}/out", f"{path}/progress").awaitTermination()
        got = rows(due.emitted(spark, f"{path}/out"), "listing_id", "new_status", "tick")
        fresh = [x for x in got if x not in seen]
        assert {x[:2] for x in fresh} == expected and len(fresh) == len(expected), (n, fresh, expected)
        seen |= dict.fromkeys(got)
    assert sorted(x[:2] for x in seen) == [(1, "ended"), (2, "ended"), (4, "cancelled"), (6, "ended"), (8, "ended"), (9, "ended")]


def test_a_tick_reads_only_the_days_since_the_last(spark, tables):
    calendar = new_folder(spark, "calendar")
    shows = tables(listings=[listing(i, date_end=DAY + timedelta(days=i)) for i in range(60)]).listings
    due.enter(shows, calendar, known_at=DAY - timedelta(days=1))
    found = due.fallen_due(spark, calendar, shows, DAY + timedelta(days=20), DAY + timedelta(days=22))
    assert rows(found, "listing_id") == [(20,), (21,)]
    entries = spark.read.schema(f"{due.CHANGE}, falls timestamp_ntz, day date").parquet(calendar)
    wanted = entries.filter((F.col("day") >= "2026-06-21") & (F.col("day") <= "2026-06-23"))
    assert "PartitionFilters: [isnotnull(day" in wanted._jdf.queryExecution().executedPlan().toString() and len({r["day"] for r in wanted.collect()}) == 3
