"""Hand-written fixtures with hand-written answers for each behaviour that is easy to get wrong."""

from datetime import datetime
from decimal import Decimal

import pytest

from boxoffice.operators import attendees, creators, engagement, intake, lifecycle, platform, recommend, search, tickets
from boxoffice.operators.base import key_value_map
from boxoffice.operators.search import ListingFilter
from tests.conftest import frame, listing, pay, reg, rows, ts, user

NOW = datetime(2026, 5, 1, 12, 0, 0)
CREATOR = user(900, "creator")


def test_one_registration_with_two_payments_counts_twice(tables):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1)], registrations=[reg(1, 1, 1)], payments=[pay(1, "5.00"), pay(1, "7.50")])
    got = platform.top_listings(t).collect()[0]
    assert (got.registrations, got.revenue, got.fill_pct) == (2, 12.5, 20)
    assert rows(creators.creator_summary(t), "creator_id", "total_attendees", "total_revenue") == [(900, 1, 12.5)]


def test_revenue_of_cancelled_registrations(tables):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1)], registrations=[reg(1, 1, 1, "cancelled")], payments=[pay(1, "5.00")])
    assert platform.platform_kpis(t, as_of=NOW).collect()[0].total_revenue == 5.0
    top = platform.top_listings(t).collect()[0]
    assert (top.registrations, top.revenue) == (0, None)
    assert rows(platform.revenue_by_type(t), "type", "revenue") == [("concert", 5.0)]


def test_indicators_of_an_empty_platform_are_zero(tables):
    assert list(platform.platform_kpis(tables(), as_of=NOW).collect()[0]) == [0, 0, 0, 0, 0.0, 0, 0]


def test_week_starts_at_midnight(tables):
    t = tables(users=[user(1, created_at=ts("2026-04-24T00:00")), user(2, created_at=ts("2026-04-23T23:59")), CREATOR])
    assert platform.platform_kpis(t, as_of=NOW).collect()[0].new_users_this_week == 1


def test_city_spellings_merge(tables):
    t = tables(listings=[listing(i, city=c) for i, c in enumerate(["Mumbai", "mumbai", "Múmbai ", "", "  ", None, "Pune"])])
    assert rows(platform.city_breakdown(t), "label", "listings") == [("Mumbai", 3), ("Pune", 1)]


def test_search_ignores_case_and_accents_and_takes_wildcards_literally(tables):
    t = tables(users=[CREATOR], listings=[listing(1, city="Múmbai"), listing(2, title="50% off"), listing(3, title="500 off"), listing(4, description="In MUMBAI")])

    def hit(**k):
        return [i for (i,) in rows(search.matching(t, ListingFilter(**k)), "listing_id")]
    assert hit(city="mumb") == [1]
    assert hit(search="mumbai") == [1, 4]
    assert hit(search="0% o") == [2]
    assert hit(search="50% off", wildcards=True) == [2, 3]


def test_date_to_means_midnight(tables):
    t = tables(users=[CREATOR], listings=[listing(1, date_start=ts("2026-05-01T18:00")), listing(2, date_start=ts("2026-05-01T00:00"))])
    assert rows(search.matching(t, ListingFilter(date_to="2026-05-01")), "listing_id") == [(2,)]


def test_unknown_sort_is_newest_and_pages_never_drop_below_one(tables):
    t = tables(users=[CREATOR], listings=[listing(1, created_at=ts("2026-01-01")), listing(2, created_at=ts("2026-02-01"))])
    assert [r.listing_id for r in search.catalogue_search(t, ListingFilter(sort="odd")).collect()] == [2, 1]
    assert search.search_page_counts(t, ListingFilter(city="nowhere")).collect()[0] == (0, 1)
    assert [r.listing_id for r in search.catalogue_search(t, ListingFilter(), page=2, per_page=1).collect()] == [1]


def test_trend_drops_the_thirtieth_day_back(tables):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1)], registrations=[
        reg(1, 1, 1, created_at=ts("2026-04-01T10:00")), reg(2, 1, 1, created_at=ts("2026-04-02T00:00")), reg(3, 1, 1, created_at=ts("2026-05-01T23:00"))])
    got = creators.creator_trend(t, as_of=NOW).orderBy("ordinal").collect()
    assert len(got) == 30 and sum(r.registrations for r in got) == 2
    assert (got[0].label, got[0].registrations, got[29].label, got[29].registrations) == ("04-02", 1, "05-01", 1)


def test_spend_axis_repeats_and_skips_months(tables):
    t = tables(users=[user(1)], listings=[listing(1)], registrations=[reg(1, 1, 1)], payments=[
        pay(1, "4.00", created_at=ts("2025-12-15")), pay(1, "2.00", created_at=ts("2026-02-10")), pay(1, "1.00", created_at=ts("2026-03-10"))])
    got = attendees.user_spend_6m(t, as_of=datetime(2026, 3, 31)).orderBy("ordinal").collect()
    assert [r.label for r in got] == ["Nov", "Dec", "Dec", "Jan", "Mar", "Mar"]
    assert [r.spent for r in got] == [0.0, 4.0, 4.0, 0.0, 1.0, 1.0]


def test_fixed_axes(tables):
    t = tables(listings=[listing(1, status="upcoming"), listing(2, type="comedy"), listing(3, type="rodeo")])
    kinds = platform.listings_by_type(t).orderBy("ordinal").collect()
    assert len(kinds) == 10 and [r.listings for r in kinds] == [1, 0, 0, 0, 0, 0, 0, 0, 0, 1]
    assert rows(platform.listings_by_status(t), "ordinal", "label", "listings") == [
        (0, "Published", 2), (1, "Draft", 0), (2, "Cancelled", 0), (3, "Ended", 0)]


def test_fill_rate_pools_and_keeps_attendees_of_cancelled_listings(tables):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1, capacity=8), listing(2, capacity=50, status="cancelled")],
               registrations=[reg(1, 1, 1), reg(2, 1, 2), reg(3, 1, 2, "cancelled")])
    got = creators.creator_summary(t).collect()[0]
    assert (got.total_listings, got.total_attendees, got.avg_fill_rate) == (1, 2, 25.0)


def test_zero_capacity_is_unlimited(tables):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1, capacity=0), listing(2, capacity=1)],
               registrations=[reg(i, 1, 1) for i in range(3)] + [reg(9, 1, 2, "pending")])
    assert rows(search.seat_availability(t), "listing_id", "registered", "sold_out") == [(1, 3, False), (2, 1, True)]
    assert {r.listing_id: r.spots_left for r in search.seat_availability(t).collect()} == {1: None, 2: 0}


def test_fee_and_single_charge(tables):
    t = tables(users=[user(1)], listings=[listing(1, price=Decimal("90.00")), listing(2)], registrations=[
        reg(1, 1, 1, "pending"), reg(2, 1, 1, "pending"), reg(3, 1, 2, "pending"), reg(4, 1, 1, "confirmed")],
        payments=[pay(1, "1.00", created_at=ts("2026-03-05")), pay(1, "2.00", created_at=ts("2026-03-04"), method="upi"), pay(4, "3.00")])
    got = {int(r.registration_id): r for r in tickets.settlement(t).collect()}
    assert (got[1].outcome, got[1].charged, got[1].method, got[1].paid_at) == ("paid", 100.0, "upi", ts("2026-03-04"))
    assert (got[2].outcome, got[2].new_status, got[2].amount_due) == ("awaiting_payment", "pending", 100.0)
    assert (got[3].outcome, got[3].new_status, got[3].charged) == ("free", "confirmed", 0.0)
    assert (got[4].outcome, got[4].charged) == ("already_confirmed", 0.0)


def test_check_in_verdicts(tables, spark):
    t = tables(users=[CREATOR, user(1)], listings=[listing(1), listing(2), listing(3, creator_id=901)], registrations=[
        reg(1, 1, 1), reg(2, 1, 1, "pending"), reg(3, 1, 1, checked_in=True)])
    log = [("a", 900, None, 1, 1), ("b", 901, "C1", 1, 2), ("c", 900, "C1", 2, 3), ("d", 900, "C2", 1, 4), ("e", 900, "C3", 1, 5),
           ("f", 900, "C1", 1, 7), ("g", 900, "C1", 1, 6), ("h", 900, "", 1, 8), ("i", 900, "C1", 99, 9), ("j", 900, "C1", None, 10)]
    scans = spark.createDataFrame([(i, s, c, e, datetime(2026, 5, 1, 0, m)) for i, s, c, e, m in log],
                                  "scan_id string, scanner_id long, ticket_code string, listing_id long, ts timestamp_ntz")
    assert rows(tickets.checkin_verdicts(t, scans), "scan_id", "verdict") == [
        ("a", "missing"), ("b", "unauthorized"), ("c", "invalid"), ("d", "status"), ("e", "already"), ("f", "already"), ("g", "success"),
        ("h", "missing"), ("i", "unauthorized"), ("j", "missing")]


def test_cancelled_future_ticket_is_past_in_the_book_and_absent_from_indicators(tables):
    t = tables(users=[user(1)], listings=[listing(1), listing(2, date_start=None), listing(3, date_start=ts("2026-01-01"))], registrations=[
        reg(1, 1, 1, "cancelled"), reg(2, 1, 1), reg(3, 1, 2), reg(4, 1, 3)])
    book = {int(r.registration_id): r.bucket for r in attendees.ticket_book(t, as_of=NOW).collect()}
    assert book == {1: "past", 2: "upcoming", 3: None, 4: "past"}
    got = attendees.user_summary(t, as_of=NOW).collect()[0]
    assert (got.tickets_total, got.upcoming_listings, got.past_listings) == (3, 1, 2)


def test_lifecycle_is_idempotent_and_needs_an_end(tables):
    t = tables(listings=[listing(1, date_end=None, date_start=ts("2026-01-01")), listing(2, date_end=ts("2026-04-30")),
                         listing(3, status="draft", date_start=ts("2026-01-01")), listing(4, status="draft")])
    assert rows(lifecycle.lifecycle_update(t.listings, as_of=NOW), "listing_id", "new_status") == [(2, "ended"), (3, "cancelled")]
    after = t.listings.withColumn("status", lifecycle.status_after(NOW))
    assert lifecycle.lifecycle_update(after, as_of=NOW).count() == 0


def test_mean_rating_rounds_like_binary_floats(tables):
    stars = {1: [4, 4, 4, 5], 2: [4] * 13 + [5] * 7, 3: [4] * 11 + [5] * 9, 4: [1, 2, 2]}
    t = tables(listings=[listing(i) for i in (*stars, 5)], reviews=[{"listing_id": i, "user_id": 1, "rating": s} for i, v in stars.items() for s in v])
    got = {r.listing_id: r.avg_rating for r in engagement.listing_ratings(t).collect()}
    assert got == {**{i: round(sum(v) / len(v), 1) for i, v in stars.items()}, 5: 0.0}
    assert (got[1], got[2], got[3]) == (4.2, 4.3, 4.5)


@pytest.mark.parametrize("count", [20, 40])
def test_every_mean_of_whole_stars_rounds_like_python(spark, count):
    from pyspark.sql import functions as F
    sums = spark.range(count, 5 * count + 1)
    got = sums.select("id", engagement.rounded_mean(F.col("id"), F.lit(count)).alias("m")).collect()
    assert all(r.m == round(r.id / count, 1) for r in got)


def test_last_answer_wins(tables):
    t = tables(registration_answers=[
        {"id": 1, "registration_id": 7, "question_key": "qty", "answer": "1"}, {"id": 3, "registration_id": 7, "question_key": "qty", "answer": "3"},
        {"id": 2, "registration_id": 7, "question_key": "qty", "answer": "9"}, {"id": 4, "registration_id": 7, "question_key": "meal", "answer": "veg"}])
    got = key_value_map(t.registration_answers, "registration_id", "question_key", "answer", "id").collect()
    assert got[0].fields == {"qty": "3", "meal": "veg"}


def test_recommendations_fall_back_only_when_the_type_is_exhausted(tables):
    t = tables(users=[user(1), user(2), user(3), CREATOR],
               listings=[listing(1, type="comedy"), listing(2, type="comedy", status="ended"), listing(3), listing(4),
                         listing(5, date_start=ts("2026-01-01")), listing(6, created_at=ts("2026-02-01"))],
               registrations=[reg(1, 1, 1), reg(2, 1, 2), reg(3, 2, 3), reg(4, 2, 5, "cancelled")])
    got = recommend.recommendations(t, as_of=NOW).orderBy("user_id", "ordinal").collect()
    by = {u: [(r.listing_id, r.fallback) for r in got if r.user_id == u] for u in (1, 2, 3)}
    assert sorted(by[1]) == [(3, True), (4, True), (6, True)]  # comedy has no open listing left
    assert by[2] == [(6, False), (4, False)]  # own type, newest first, not the one held
    assert by[3] == [(6, False), (1, False), (3, False), (4, False)]  # no history


def test_request_without_listing_reuses_any_thread(spark):
    threads = spark.createDataFrame([(1, 5, 900, 7), (2, 5, 900, 8)], "id long, user_id long, creator_id long, listing_id long")
    asked = [(10, 5, 900, None, 1), (11, 5, 900, 8, 2), (12, 5, 900, 9, 3), (13, 5, 900, 9, 4), (14, 6, 900, None, 5), (15, 6, 900, 3, 6),
             (16, 6, 900, None, 7), (17, 900, 900, None, 8)]
    requests = spark.createDataFrame([(i, u, c, e, datetime(2026, 1, 1, 0, m)) for i, u, c, e, m in asked],
                                     "request_id long, user_id long, creator_id long, listing_id long, ts timestamp_ntz")
    assert rows(engagement.thread_upsert(threads, requests), "request_id", "thread_key", "created") == [
        (10, "T1", False), (11, "T2", False), (12, "N12", True), (13, "N12", False), (14, "N14", True), (15, "N15", True), (16, "N14", False)]


def test_intake_rules(spark):
    forms = spark.createDataFrame([(1, " 5 "), (2, "0"), (3, "six"), (4, None), (5, "3.5"), (6, "1")], "user_id long, rating string")
    forms = forms.selectExpr("user_id listing_id", "user_id", "rating", "'  hi ' review_text", "timestamp_ntz'2026-01-01' created_at")
    assert rows(intake.review_intake(forms).filter("accepted"), "user_id", "rating", "review_text") == [(1, 5, "hi"), (6, 1, "hi")]
    booking = spark.createDataFrame([(1, "0123456789", "1"), (2, "012345678", "5"), (3, "01234567890", "6"), (4, None, None)],
                                    "registration_id long, phone string, qty string")
    assert rows(intake.booking_checks(booking), "registration_id", "errors") == [(1, ""), (2, "phone"), (3, "phone,qty"), (4, "phone,qty")]
    listings = spark.createDataFrame([(1, " a ", "x", "2026-01-02T03:04", "d"), (2, " ", None, "", "d" * 2001)],
                                     "form_id long, title string, type string, date_start string, description string")
    got = intake.listing_intake(listings).orderBy("form_id").collect()
    assert (got[0].title, got[0].date_start, got[0].accepted) == ("a", ts("2026-01-02T03:04"), True)
    assert got[1].errors == "title,type,date_start,description"


def test_required_details(tables):
    t = tables(listings=[listing(1), listing(2, type="comedy"), listing(3, type="sports")], listing_details=[
        {"id": 1, "listing_id": 1, "field_key": "artist_name", "field_value": " x "}, {"id": 2, "listing_id": 3, "field_key": "sport_name", "field_value": " "}])
    assert rows(intake.missing_details(t), "listing_id", "field_key") == [(1, "seating_type"), (3, "sport_name")]


def test_edits_keep_the_banner_and_replace_details(tables, spark):
    t = tables(listings=[listing(1), listing(2)], listing_details=[
        {"id": i, "listing_id": i, "field_key": "k", "field_value": "old"} for i in (1, 2)])
    day = datetime(2026, 7, 1)
    edits = spark.createDataFrame([
        (1, 1, datetime(2026, 1, 1), "a", "comedy", "d", day, day, "v", "c", 5, Decimal("1.00"), "b1"),
        (2, 1, datetime(2026, 1, 2), "b", "sports", None, day, None, "w", None, 6, Decimal("2.00"), None)],
        "edit_id long, listing_id long, ts timestamp_ntz, title string, type string, description string, date_start timestamp_ntz, "
        "date_end timestamp_ntz, venue string, city string, capacity int, price decimal(10,2), banner string")
    details = spark.createDataFrame([(1, 1, "x", "1"), (2, 1, "y", " 2 "), (2, 1, "z", " ")], "edit_id long, listing_id long, field_key string, field_value string")
    assert rows(lifecycle.listing_latest(t, edits).filter("listing_id = 1"), "title", "type", "description", "date_start", "date_end", "venue", "city",
                "capacity", "price", "banner") == [("b", "sports", None, day, None, "w", None, 6, 2.0, "b1")]
    assert rows(lifecycle.details_latest(t, edits, details), "listing_id", "field_key", "field_value") == [(1, "y", "2"), (2, "k", "old")]


def test_admins_are_never_banned(tables, spark):
    t = tables(users=[user(1), user(2, "admin"), user(3, is_banned=True), user(4)])
    log = spark.createDataFrame([(1, 1, "toggle"), (2, 2, "toggle"), (3, 3, "toggle"), (4, 4, "toggle"), (5, 4, "delete"), (6, 4, "toggle"), (7, 4, "ban")],
                                "event_id long, user_id long, action string").selectExpr("*", "timestamp_ntz'2026-01-01' ts")
    assert rows(lifecycle.ban_state(t, log), "user_id", "is_banned") == [(1, True), (3, False), (4, True)]


def test_deleting_and_reading_messages(tables, spark):
    sent = [(1, 5, ts("2026-01-01")), (2, 900, ts("2026-01-02")), (3, 900, ts("2026-01-04"))]
    t = tables(threads=[{"id": 1, "user_id": 5, "creator_id": 900}], messages=[
        {"id": i, "thread_id": 1, "sender_id": s, "message_text": f"m{i}", "is_read": False, "sent_at": at} for i, s, at in sent])
    reads = spark.createDataFrame([(1, 5, ts("2026-01-03")), (1, 77, ts("2026-02-01"))], "thread_id long, reader_id long, read_at timestamp_ntz")
    deletions = spark.createDataFrame([(1, 900), (2, 900)], "message_id long, requester_id long")
    assert rows(engagement.message_state(t, reads, deletions), "message_id", "message_text", "is_read") == [
        (1, "m1", False), (2, "This message was deleted", True), (3, "m3", False)]


def test_listing_card(tables):
    t = tables(listings=[listing(1, title="A very long title indeed", type="food_festival", city="", venue="Hall", date_start=ts("2026-05-04T15:07"),
                                 price=Decimal("12.50")), listing(2, date_start=ts("2026-05-01T11:59")), listing(3, date_start=ts("2026-05-01T13:01"))])
    got = {r.listing_id: r for r in search.listing_card(t, as_of=NOW).collect()}
    assert (got[1].short_title, got[1].type_label, got[1].place, got[1].price_text) == ("A very long tit...", "Food Festival", "Hall", "₹12")
    assert (got[1].starts, got[1].countdown) == ("May 04, 2026 03:07 PM", "3d 3h 7m")
    assert (got[2].countdown, got[2].price_text, got[2].place, got[3].countdown) == ("Event Started", "FREE", "Online", "1h 1m")


def test_top_type_placeholder(tables):
    t = tables(users=[user(1), user(2)], listings=[listing(1), listing(2, type="comedy")], registrations=[reg(1, 1, 1), reg(2, 1, 2), reg(3, 1, 2, "cancelled")])
    got = [(r.user_id, r.ordinal, r.label, r.registrations, r.top_type) for r in attendees.user_type_history(t).orderBy("user_id", "ordinal").collect()]
    assert got == [(1, 1, "Comedy", 1, "comedy"), (1, 2, "Concert", 1, None), (2, 1, "No Events", 1, None)]


def test_ids_filter_equals_the_filtered_whole(tables, spark):
    t = tables(users=[user(i) for i in range(6)] + [CREATOR, user(901, "creator")], listings=[listing(1), listing(2, creator_id=901)],
               registrations=[reg(i, i % 5, 1 + i % 2) for i in range(12)], payments=[pay(i, "2.00") for i in range(12)])
    whole = attendees.user_summary(t, as_of=NOW)
    some = attendees.user_summary(t, as_of=NOW, ids=[1, 3])
    as_frame = attendees.user_summary(t, as_of=NOW, ids=frame(spark, t.users.select("id").schema, [{"id": 1}, {"id": 3}]))
    assert sorted(whole.filter("user_id in (1, 3)").collect()) == sorted(some.collect()) == sorted(as_frame.collect())
    assert sorted(creators.creator_performance(t).filter("creator_id = 901").collect()) == sorted(creators.creator_performance(t, ids=[901]).collect())
