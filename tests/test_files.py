"""Sinks and the native table layout."""

import csv
import json
from datetime import datetime
from pathlib import Path

from boxoffice.operators import charts, integrity, lifecycle, platform, tickets
from boxoffice.plans.catalog import AS_OF, TYPES, YEAR
from boxoffice.sources import derived, files, layout
from boxoffice.sources.tables import Tables
from boxoffice.session import new_folder
from tests.conftest import SF, listing, pay, reg, rows, user


def _local(path):
    return Path(path.removeprefix("file:"))


def test_attendee_csv(spark, tables):
    t = tables(users=[user(1), user(2)], listings=[listing(1), listing(2)], registrations=[reg(1, 1, 1), reg(2, 2, 1), reg(3, 1, 2, "cancelled")],
               payments=[pay(1, "5.50")])
    path = new_folder(spark, "csv")
    files.write_attendee_csv(tickets.attendee_export(t), path)
    found = [line for f in _local(path).glob("listing_id=1/*.csv") for line in list(csv.reader(f.open()))[1:]]
    assert sorted(found) == [["C1", "n1", "e1@x.y", "confirmed", "2026-03-01", "5.50"], ["C2", "n2", "e2@x.y", "confirmed", "2026-03-01", ""]]
    header = next(csv.reader(next(_local(path).glob("listing_id=2/*.csv")).open()))
    assert header == ["Ticket Code", "Name", "Email", "Status", "Date", "Amount Paid"]


def test_chart_json(spark):
    t = derived.from_trade_tables(spark, SF)
    path = new_folder(spark, "charts")
    files.write_charts(charts.platform_charts(t, year=YEAR, types=TYPES), path)
    payloads = {f.parent.name: json.loads(f.read_text()) for f in _local(path).glob("chart=*/*.txt")}
    assert len(payloads) == 7
    assert payloads["chart=regs_monthly"]["labels"][:2] == ["Jan", "Feb"] and len(payloads["chart=regs_monthly"]["data"]) == 12
    want = [r.revenue for r in platform.revenue_by_month(t, year=YEAR).orderBy("month").collect()]
    assert payloads["chart=revenue_monthly"]["data"] == want


def test_native_layout_gives_the_same_reports(spark):
    t = derived.from_trade_tables(spark, SF)
    path = new_folder(spark, "native")
    layout.write_tables(t, path, ["users", "listings", "registrations", "payments"])
    native = Tables.from_parquet(spark, path)
    assert rows(platform.top_listings(native), "listing_id", "registrations", "revenue") == rows(platform.top_listings(t), "listing_id", "registrations", "revenue")
    assert platform.platform_kpis(native, as_of=AS_OF).collect() == platform.platform_kpis(t, as_of=AS_OF).collect()


def test_defaults_never_overwrite(spark):
    have = spark.createDataFrame([(1, "a", "x")], "scope_id long, setting_key string, setting_value string")
    defaults = spark.createDataFrame([(1, "a", "d"), (1, "b", "d")], have.schema)
    assert rows(lifecycle.fill_missing(have, defaults, ["scope_id", "setting_key"]), "setting_key", "setting_value") == [("a", "x"), ("b", "d")]


def test_audit_finds_each_kind_of_violation(tables):
    t = tables(users=[user(1), user(2, "guest", email="É1@x.y "), user(3, email=None), user(4, email=None)],
               listings=[listing(1, creator_id=77, title=None, type="rodeo")],
               registrations=[reg(1, 1, 1), {**reg(2, 8, 9, "odd"), "ticket_code": "C1"}], payments=[pay(5, "1.00", "lost")],
               reviews=[{"listing_id": 1, "user_id": 1, "rating": 9}], saves=[{"user_id": 1, "listing_id": 1}] * 2, waitlist=[{"listing_id": 6}],
               listing_details=[{"listing_id": 5, "field_key": "k"}], notifications=[{"user_id": 71, "message": "m"}],
               threads=[{"id": 1, "user_id": 1, "creator_id": 1, "listing_id": 3}], messages=[{"id": 1, "thread_id": 4, "message_text": "m"}],
               listing_views=[{"listing_id": None, "views": 1}], reply_log=[{"user_id": None, "prompt": None}])
    found = {r.rule: r.violations for r in integrity.integrity_audit(t).collect() if r.violations}
    assert found == dict.fromkeys([
        "users.email unique", "registrations.ticket_code unique", "saves pair unique", "users.role domain", "listings.type domain",
        "listings.title required", "registrations.status domain", "payments.status domain", "reviews.rating range", "listings.creator_id reference",
        "listing_details.listing_id reference", "registrations.user_id reference", "registrations.listing_id reference",
        "payments.registration_id reference", "waitlist.listing_id reference", "threads.listing_id reference", "messages.thread_id reference",
        "messages.sender_id required", "notifications.user_id reference", "waitlist.email required", "listing_views.listing_id required",
        "listing_views.date required", "reply_log.user_id required", "reply_log.prompt required"], 1) | {"users.email required": 2}


def test_cascade(tables, spark):
    t = tables(users=[user(1), user(2), user(900, "creator"), user(901, "creator")], listings=[listing(1), listing(2, creator_id=901)],
               registrations=[reg(1, 1, 1), reg(2, 1, 2), reg(3, 2, 2)], payments=[pay(1, "1.00"), pay(2, "1.00"), pay(3, "1.00")],
               threads=[{"id": 1, "user_id": 1, "creator_id": 901, "listing_id": 1}, {"id": 2, "user_id": 2, "creator_id": 901, "listing_id": 2}],
               messages=[{"id": 1, "thread_id": 1}, {"id": 2, "thread_id": 2}], saves=[{"user_id": 1, "listing_id": 1}, {"user_id": 1, "listing_id": 2}],
               follows=[{"follower_id": 1, "creator_id": 900}, {"follower_id": 1, "creator_id": 901}], notifications=[{"user_id": 2}, {"user_id": 1}],
               waitlist=[{"id": "a", "listing_id": 1}, {"id": "b", "listing_id": 2}], listing_details=[{"id": 1, "listing_id": 1}, {"id": 2, "listing_id": 2}],
               listing_views=[{"listing_id": 1, "views": 3}], reply_log=[{"user_id": 2}, {"user_id": 900}, {"user_id": 1}])
    left = integrity.cascade_prune(t, spark.createDataFrame([(900,), (2,)], "id long"))
    assert rows(left["registrations"], "id") == [("2",)] and rows(left["payments"], "registration_id") == [("2",)]
    assert [(r.id, r.listing_id) for r in left["threads"].collect()] == [(1, None)] and rows(left["messages"], "id") == [(1,)]
    assert rows(left["saves"], "listing_id") == [(2,)] and rows(left["follows"], "creator_id") == [(901,)] and rows(left["notifications"], "user_id") == [(1,)]
    assert rows(left["waitlist"], "id") == [("b",)] and rows(left["listing_details"], "id") == [(2,)] and rows(left["listing_views"], "views") == []
    assert rows(left["reply_log"], "user_id") == [(1,)]


def test_derived_tables_have_the_declared_columns(spark):
    from boxoffice.schema import SCHEMAS
    t = derived.from_trade_tables(spark, SF)
    for name in SCHEMAS:
        if name in t:
            assert set(getattr(t, name).columns) <= set(SCHEMAS[name].names), name
    assert t.users.filter("created_at is null").count() == 0 and datetime(1995, 1, 1) <= t.users.agg({"created_at": "min"}).collect()[0][0]
