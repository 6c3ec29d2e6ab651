"""Every registered query: a name and a function of (spark, folder of the given tables)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.operators import (
    attendees, charts, creators, engagement, intake, integrity, lifecycle, platform, recommend, replies, search, seats, tickets,
)
from boxoffice.operators.search import ListingFilter
from boxoffice.schema import ACTIVITY_SCHEMA, CHAT_SCHEMA, LINEITEM_SCHEMA, SETTING_DEFAULTS
from boxoffice.session import materialize, new_folder
from boxoffice.sources import derived, files, layout
from boxoffice.sources.tables import Tables
from boxoffice.sources.textindex import TextIndex
from boxoffice.streaming import activity, due, kpis

AS_OF = datetime(2001, 8, 1, 12, 0, 0)
TREND_AS_OF = datetime(2001, 7, 31, 12, 0, 0)
YEAR = 2000
# The listing types that occur in the given tables.
TYPES = tuple((t, t.capitalize()) for t in ("economy", "large", "medium", "promo", "small", "standard"))
DETAIL_RULES = [("economy", "seating"), ("promo", "brand"), ("large", "size"), ("large", "platform")]

FILTERS = {
    "search_type_in": ListingFilter(types=("economy", "promo")),
    "search_city": ListingFilter(city="nation_1"),
    "search_text": ListingFilter(search="GEAR"),
    "search_dates": ListingFilter(date_from="2001-06-01", date_to="2001-09-02"),
    "search_price": ListingFilter(price="free"),
}
SORTED = ListingFilter(price="paid", sort="price_high")
PAGED = ListingFilter(types=("economy", "small", "large"), city="nation", sort="soonest")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def _register(name: str, build: Callable[[Tables], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: build(derived.from_trade_tables(spark, sf_dir))


def _query(build: Callable) -> Callable:
    _register(build.__name__, build)
    return build


# Reports that need no more than the tables and fixed parameters.
for _name, _build in {
    "platform_kpis": lambda t: platform.platform_kpis(t, as_of=AS_OF),
    "revenue_by_month": lambda t: platform.revenue_by_month(t, year=YEAR),
    "registrations_by_month": lambda t: platform.registrations_by_month(t, year=YEAR),
    "signups_by_month": lambda t: platform.signups_by_month(t, year=YEAR),
    "monthly_summary": lambda t: platform.monthly_summary(t, year=YEAR),
    "listings_by_type": lambda t: platform.listings_by_type(t, axis=TYPES),
    "listings_by_status": platform.listings_by_status,
    "revenue_by_type": platform.revenue_by_type,
    "top_listings": platform.top_listings,
    "top_creators": platform.top_creators,
    "recent_activity": platform.recent_activity,
    "city_breakdown": platform.city_breakdown,
    "payment_mix": platform.payment_mix,
    "users_by_role": platform.users_by_role,
    "listing_admin_report": lambda t: platform.listing_admin_report(t, search="bolt", status="published"),
    "chart_json": lambda t: charts.platform_charts(t, year=YEAR, types=TYPES),
    "creator_chart_json": lambda t: charts.creator_charts(t, as_of=TREND_AS_OF),
    "creator_summary": creators.creator_summary,
    "creator_revenue_top8": creators.creator_revenue_top8,
    "creator_trend": lambda t: creators.creator_trend(t, as_of=TREND_AS_OF),
    "creator_performance": creators.creator_performance,
    "creator_top_listing": creators.creator_top_listing,
    "creator_public_stats": creators.creator_public_stats,
    "creator_manage_stats": creators.creator_manage_stats,
    "creator_published": creators.creator_published,
    "creator_listings": creators.creator_listings,
    "user_summary": lambda t: attendees.user_summary(t, as_of=AS_OF),
    "user_spend_6m": lambda t: attendees.user_spend_6m(t, as_of=AS_OF),
    "user_type_history": attendees.user_type_history,
    "user_upcoming": lambda t: attendees.user_upcoming(t, as_of=AS_OF),
    "ticket_book": lambda t: attendees.ticket_book(t, as_of=AS_OF),
    "recommendations": lambda t: recommend.recommendations(t, as_of=AS_OF),
    "search_sorted": lambda t: search.catalogue_search(t, SORTED),
    "catalogue_search": lambda t: search.catalogue_search(t, PAGED, page=2),
    "search_page_counts": lambda t: search.search_page_counts(t, PAGED),
    "user_search": lambda t: search.user_search(t, search="CUSTOMER#00000", role="users", page=2),
    "user_search_counts": lambda t: search.user_search_counts(t, search="00001", role="banned"),
    "registration_search": lambda t: search.registration_search(t, search="ee-1", status="confirmed", page=3),
    "registration_search_counts": lambda t: search.registration_search_counts(t, search="ee-1", status="confirmed"),
    "registration_ledger": search.registration_ledger,
    "similar_listings": search.similar_listings,
    "user_directory": search.user_directory,
    "listing_card": lambda t: search.listing_card(t, as_of=AS_OF),
    "seat_availability": search.seat_availability,
    "registration_counts": tickets.registration_counts,
    "ticket_detail": lambda t: tickets.flat_answers(tickets.ticket_detail(t)),
    "attendee_list": lambda t: tickets.flat_answers(tickets.attendee_list(t)),
    "attendee_export": tickets.attendee_export,
    "attendee_stats": tickets.attendee_stats,
    "recent_checkins": tickets.recent_checkins,
    "ticket_payload": tickets.ticket_payload,
    "settlement": tickets.settlement,
    "checkin_verdicts": lambda t: tickets.checkin_verdicts(t, t.scans),
    "waitlist_promotion": tickets.waitlist_promotion,
    "save_state": lambda t: engagement.save_state(t.save_toggles),
    "follow_state": lambda t: engagement.follow_state(t.follow_toggles),
    "follow_notices": lambda t: engagement.follow_notices(t, t.follow_toggles),
    "publish_fanout": lambda t: engagement.publish_fanout(t, t.status_log, engagement.follow_spans(t.follow_toggles)),
    "notification_feed": engagement.notification_feed,
    "unread_notifications": engagement.unread_notifications,
    "saved_feed": lambda t: engagement.saved_feed(t, t.saves),
    "listing_ratings": engagement.listing_ratings,
    "review_list": engagement.review_list,
    "daily_views": lambda t: engagement.daily_views(t.view_hits),
    "unread_messages": engagement.unread_messages,
    "inbox": engagement.inbox,
    "thread_upsert": lambda t: engagement.thread_upsert(t.threads, t.thread_requests),
    "message_state": lambda t: engagement.message_state(t, t.read_log, t.delete_log),
    "thread_activity": engagement.thread_activity,
    "lifecycle_update": lambda t: lifecycle.lifecycle_update(t.listings, as_of=AS_OF),
    "listing_status_latest": lambda t: lifecycle.listing_status_latest(t, t.status_log),
    "ban_state": lambda t: lifecycle.ban_state(t, t.ban_log),
    "listing_latest": lambda t: lifecycle.listing_latest(t, t.listing_edits),
    "details_latest": lambda t: lifecycle.details_latest(t, t.listing_edits, t.listing_edit_details),
    "profile_latest": lambda t: lifecycle.profile_latest(t, t.profile_edits),
    "settings_latest": lambda t: lifecycle.settings_latest(t.setting_log),
    "review_intake": lambda t: intake.review_intake(t.review_forms),
    "listing_intake": lambda t: intake.listing_intake(t.listing_forms),
    "answer_quality": lambda t: intake.booking_checks(t.booking_forms),
    "missing_details": lambda t: intake.missing_details(t, DETAIL_RULES),
    "verdict_parse": lambda t: replies.verdict_parse(t.model_replies),
    "price_parse": lambda t: replies.price_parse(t.model_replies),
    "filter_parse": lambda t: search.parsed_requests(t.search_replies, [k for k, _ in TYPES]),
    "integrity_audit": lambda t: integrity.integrity_audit(t, types=TYPES),
}.items():
    _register(_name, _build)

for _name, _wanted in FILTERS.items():
    _register(_name, lambda t, wanted=_wanted: search.catalogue_matches(t, wanted))


@_query
def admission(t: Tables) -> DataFrame:
    requests = t.registrations.filter(F.col("status") != "cancelled").select("id", "user_id", "listing_id", "created_at")
    requests = materialize(requests, "requests")  # read twice, and long to derive
    return tickets.admission(requests, t.listings, t.users)


@_query
def batch_search(t: Tables) -> DataFrame:
    return search.batch_search(t, search.parsed_requests(t.search_replies, [k for k, _ in TYPES]))


# ---- searches through a stored index of grams, built over the whole tables first ----

def _index(t: Tables, name: str, fields: tuple[str, ...]) -> TextIndex:
    return TextIndex(t.spark, new_folder(t.spark, f"grams-{name}")).add(getattr(t, name), "id", fields)


INDEXED = {
    "indexed_search_text": ListingFilter(search="HOT gear"),
    "indexed_search_short": ListingFilter(search="#9", city="NATION_2"),
    "indexed_search_scan": ListingFilter(search="nation_", price="paid"),
}
for _name, _wanted in INDEXED.items():
    _register(_name, lambda t, wanted=_wanted: search.catalogue_matches(t, wanted, _index(t, "listings", search.LISTING_TEXTS)))


@_query
def indexed_user_search(t: Tables) -> DataFrame:
    return search.user_search(t, search="MER#00000001", index=_index(t, "users", search.USER_TEXTS))


@_query
def indexed_registration_search(t: Tables) -> DataFrame:
    indexes = _index(t, "registrations", ("ticket_code",)), _index(t, "users", search.USER_TEXTS)
    return search.registration_search(t, search="0012", status="confirmed", indexes=indexes)


# ---- reports over registrations, payments and answers stored in buckets of their common key ----

def _bucketed(t: Tables) -> Tables:
    folder, buckets = new_folder(t.spark, "bucketed"), layout.buckets_for(t)
    layout.write_bucketed(t, folder, buckets)
    return layout.open_bucketed(t, folder, buckets, folder.rsplit("/", 1)[1].replace("-", "_"))


for _name, _build in {
    "bucketed_ticket_detail": lambda t: tickets.flat_answers(tickets.ticket_detail(t)),
    "bucketed_attendee_list": lambda t: tickets.flat_answers(tickets.attendee_list(t)),
    "bucketed_settlement": tickets.settlement,
    "bucketed_top_listings": lambda t: platform.top_listings(t, limit=50),
}.items():
    _register(_name, lambda t, build=_build: build(_bucketed(t)))


def _seat_moves(t: Tables) -> DataFrame:
    """Every fourth listing keeps no waiting list, the others three to nine places."""
    shows = t.listings.select(F.col("id").alias("listing_id"), "capacity", (F.col("id") % 4 * 3).alias("waiting_places"))
    return seats.seat_moves(t.seat_events, shows)


@_query
def seat_history(t: Tables) -> DataFrame:
    return seats.seat_history(_seat_moves(t))


@_query
def seat_state(t: Tables) -> DataFrame:
    return seats.seat_state(_seat_moves(t))


@_query
def keyed_lookup(t: Tables) -> DataFrame:
    """People on a waitlist, looked up by an email typed in capitals."""
    found = search.keyed_lookup(t.users, "email", t.waitlist.select(F.upper("email")), tolerant=True)
    return found.select(F.col("id").alias("user_id"), "name", "email", "role", "created_at", "is_banned")


@_query
def listing_lookup(t: Tables) -> DataFrame:
    """Saved listings by id."""
    return search.keyed_lookup(t.listings, "id", t.saves.select("listing_id")).select("id", "title", "status", "created_at")


@_query
def registration_lookup(t: Tables) -> DataFrame:
    """Registrations on a waitlist by id."""
    return search.keyed_lookup(t.registrations, "id", t.waitlist.select("id")).select("id", "user_id", "listing_id", "status")


@_query
def ticket_lookup(t: Tables) -> DataFrame:
    """Registrations by scanned ticket code."""
    return search.keyed_lookup(t.registrations, "ticket_code", t.scans.select("ticket_code")).select("ticket_code", "id", "user_id", "listing_id", "status")


@_query
def thread_lookup(t: Tables) -> DataFrame:
    """Opened threads by id."""
    return search.keyed_lookup(t.threads, "id", t.read_log.select("thread_id")).select("id", "user_id", "creator_id", "listing_id")


@_query
def registered_already(t: Tables) -> DataFrame:
    """Do the people who saved a listing hold a registration for it?"""
    return search.registered_already(t, t.saves.select("user_id", "listing_id"))


@_query
def saved_flags(t: Tables) -> DataFrame:
    return engagement.saved_flags(t.save_toggles.select("user_id", "listing_id").distinct(), t.saves)


@_query
def following_flags(t: Tables) -> DataFrame:
    return engagement.following_flags(t.follow_toggles.select("follower_id", "creator_id").distinct(), t.follows)


@_query
def thread_since(t: Tables) -> DataFrame:
    cursors = t.read_log.select("thread_id", derived.message_id(F.col("thread_id"), 2).alias("last_id"))
    return engagement.thread_since(t, cursors)


@_query
def answers_map(t: Tables) -> DataFrame:
    return tickets.answers_map(t).select("registration_id", F.explode("fields").alias("question_key", "answer"))


@_query
def listing_detail(t: Tables) -> DataFrame:
    from boxoffice.operators.base import fields_text
    return tickets.listing_detail(t).withColumn("details", fields_text(F.col("details")))


def _gone(t: Tables) -> DataFrame:
    return t.users.filter(F.col("is_banned") | ((F.col("role") == "creator") & (F.col("id") % 7 == 0))).select("id")


@_query
def cascade_prune(t: Tables) -> DataFrame:
    return integrity.prune_counts(t, _gone(t))


# What the cascade leaves of each table, with the columns that tell its rows apart.
PRUNED = {
    "users": ("id", "email"), "listings": ("id", "creator_id"), "listing_details": ("id", "listing_id", "field_key"),
    "registrations": ("id", "user_id", "listing_id"), "registration_answers": ("registration_id", "question_key", "answer"),
    "payments": ("registration_id", "method", "created_at"), "listing_views": ("listing_id", "views"), "reply_log": ("user_id", "prompt"),
    "waitlist": ("id", "listing_id", "email"), "threads": ("id", "user_id", "creator_id", "listing_id"), "messages": ("id", "thread_id", "sender_id"),
    "reviews": ("listing_id", "user_id", "created_at"), "saves": ("user_id", "listing_id"), "follows": ("follower_id", "creator_id"),
    "notifications": ("id", "user_id", "message"),
}
for _name, _columns in PRUNED.items():
    _register(f"pruned_{_name}", lambda t, name=_name, columns=_columns: integrity.cascade_prune(t, _gone(t), only=name)[name].select(*columns))


@_query
def settings_defaults(t: Tables) -> DataFrame:
    existing = lifecycle.settings_latest(t.setting_log)
    rows = F.array(*[F.struct(F.lit(k).alias("setting_key"), F.lit(v).alias("setting_value")) for k, v in SETTING_DEFAULTS])
    defaults = t.setting_log.select("scope_id").distinct().select("scope_id", F.inline(rows))
    return lifecycle.fill_missing(existing, defaults, ["scope_id", "setting_key"])


@_query
def answers_append(t: Tables) -> DataFrame:
    """Two bulk appends, read back with the declared schema."""
    path = new_folder(t.spark, "answers")
    clean = intake.clean_pairs(t.registration_answers, "answer")
    for question in ("qty", "flag"):
        files.append_rows(clean.filter(F.col("question_key") == question), path)
    return files.read_table(t.spark, path, clean.schema)


@_query
def ai_log_append(t: Tables) -> DataFrame:
    path = new_folder(t.spark, "replies")
    rows = t.model_replies.select(
        (F.col("doc_id") % 150).alias("user_id"), F.concat(F.lit("review "), F.col("doc_id").cast("string")).alias("prompt"),
        F.col("reply").alias("response"), F.lit("text-model").alias("model_used"), F.lit(str(AS_OF)).cast("timestamp_ntz").alias("created_at"))
    files.interaction_log(rows, path)
    return files.read_table(t.spark, path, rows.schema)


# ---- streams, drained once over the given files ----

def _appended(spark: SparkSession, frame: DataFrame, name: str) -> DataFrame:
    path = new_folder(spark, name)
    activity.append_stream(frame, f"{path}/rows", f"{path}/progress").awaitTermination()
    return spark.read.schema(frame.schema).parquet(f"{path}/rows")


def _versioned(spark: SparkSession, frame: DataFrame, name: str, keys: list[str]) -> DataFrame:
    path = new_folder(spark, name)
    activity.version_stream(frame, f"{path}/rows", f"{path}/progress", keys).awaitTermination()
    return activity.latest_versions(spark, f"{path}/rows", frame.schema, keys)


def _stored(t: Tables, *names: str) -> Tables:
    """The named tables written to the shared folder: what streams join, or read, again and again."""
    return Tables.of(t.spark, **{n: materialize(getattr(t, n), n) for n in names})


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return activity.read_stream(spark, f"{sf_dir}/events.parquet", ACTIVITY_SCHEMA)


def stream_daily_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, engagement.daily_views(derived.view_hits(_events(spark, sf_dir))), "views", ["listing_id", "day"])


def stream_first_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _stored(derived.from_trade_tables(spark, sf_dir), "listings", "registrations")
    lines = activity.read_stream(spark, f"{sf_dir}/lineitem.parquet", LINEITEM_SCHEMA)
    valid = activity.valid_scans(derived.scan_rows(lines, t.listings), t.listings, t.registrations)
    return _versioned(spark, activity.first_scans(valid), "scans", ["registration_id"])


def stream_activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, activity.activity_counts(_events(spark, sf_dir)), "activity", ["event_type"])


def stream_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline numbers over streams of the four marketplace tables."""
    t, new = derived.from_trade_tables(spark, sf_dir), {}
    for name in ("users", "listings", "registrations", "payments"):
        frame, path = getattr(t, name), new_folder(spark, name)
        frame.write.parquet(path)
        new[name] = activity.read_stream(spark, path, frame.schema)
    return activity.kpi_row(_versioned(spark, activity.kpi_totals(**new, as_of=AS_OF), "kpis", ["kpi"]))


def stream_kpi_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The headline numbers over streams of changes: publications withdrawn, registrations cancelled, payments refunded."""
    t = derived.from_trade_tables(spark, sf_dir)
    stored = lambda column: (F.lit("1900-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).alias("seq"), "id", *column)
    logs = {
        "users": t.users.select(*stored(("role", "created_at"))),
        "listings": t.listings.select(*stored(("status", "date_start"))),
        "listing_log": t.status_log.join(t.listings.select(F.col("id").alias("listing_id"), "date_start"), "listing_id").select(
            "ts", F.col("event_id").alias("seq"), F.col("listing_id").alias("id"), "status", "date_start"),
        "registrations": t.registration_log, "payments": t.payment_log}
    read = {}
    for name, frame in logs.items():
        path = new_folder(spark, name)
        frame.write.parquet(path)
        read[name] = activity.read_stream(spark, path, frame.schema)
    changes = kpis.user_changes(read["users"])
    for more in (kpis.listing_changes(read["listings"]), kpis.listing_changes(read["listing_log"]),
                 kpis.registration_changes(read["registrations"]), kpis.payment_changes(read["payments"])):
        changes = changes.unionByName(more)
    path = new_folder(spark, "kpi-changes")
    kpis.kpi_stream(changes, f"{path}/rows", f"{path}/progress").awaitTermination()
    return kpis.kpi_report(kpis.stored_deltas(spark, f"{path}/rows"), as_of=AS_OF)


def stream_unread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned(spark, activity.unread_counts(derived.notifications(_events(spark, sf_dir))), "unread", ["user_id"])


def stream_unread_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _stored(derived.from_trade_tables(spark, sf_dir), "threads")
    return _versioned(spark, activity.unread_messages(_messages(spark, sf_dir), t.threads), "unread-messages", ["user_id"])


def stream_publish_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notices to whoever follows at the moment of publishing: the batch operator on a stream."""
    t = derived.from_trade_tables(spark, sf_dir)
    spans = materialize(engagement.follow_spans(t.follow_toggles), "spans")
    log = derived.status_log(_events(spark, sf_dir), derived.sizes(spark, sf_dir))
    return _appended(spark, engagement.publish_fanout(_stored(t, "listings", "users"), log, spans), "notices")


def stream_saves(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = ["user_id", "listing_id"]
    return _versioned(spark, activity.toggle_state(derived.save_toggles(_events(spark, sf_dir)), pair), "saves", pair)


def stream_follows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = ["follower_id", "creator_id"]
    toggles = derived.follow_toggles(_events(spark, sf_dir), derived.sizes(spark, sf_dir)).filter("follower_id <> creator_id")
    return _versioned(spark, activity.toggle_state(toggles, pair), "follows", pair)


def stream_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tick of the sweep over all stored listings."""
    path, t = new_folder(spark, "sweep"), _stored(derived.from_trade_tables(spark, sf_dir), "listings")
    spark.createDataFrame([(AS_OF,)], "tick timestamp_ntz").write.parquet(f"{path}/ticks")
    ticks = activity.read_stream(spark, f"{path}/ticks", spark.read.parquet(f"{path}/ticks").schema)
    activity.lifecycle_sweep(ticks, lambda: t.listings, f"{path}/rows", f"{path}/progress").awaitTermination()
    schema = lifecycle.lifecycle_update(t.listings, as_of=AS_OF).schema
    return activity.latest_versions(spark, f"{path}/rows", schema, ["listing_id"])


TICKS = (datetime(1997, 3, 1), datetime(1999, 6, 15, 20, 30), AS_OF)


def stream_due_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ticks of the sweep over the calendar, the stream being started anew for each."""
    t, path = _stored(derived.from_trade_tables(spark, sf_dir), "listings"), new_folder(spark, "due")
    due.enter(t.listings, f"{path}/calendar", known_at=datetime(1995, 1, 1))
    for tick in TICKS:
        spark.createDataFrame([(tick,)], "tick timestamp_ntz").coalesce(1).write.mode("append").parquet(f"{path}/clock")
        ticks = activity.read_stream(spark, f"{path}/clock", spark.read.parquet(f"{path}/clock").schema)
        now = lambda: due.with_changes(t.listings, due.emitted(spark, f"{path}/out"))
        due.due_sweep(ticks, f"{path}/calendar", now, f"{path}/out", f"{path}/progress").awaitTermination()
    return due.emitted(spark, f"{path}/out").drop("due")


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = activity.read_stream(spark, f"{sf_dir}/conversations.parquet", CHAT_SCHEMA)
    return derived.messages(talk, derived.sizes(spark, sf_dir))


def stream_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _appended(spark, _messages(spark, sf_dir).select("thread_id", "id", "sender_id", "message_text", "sent_at"), "messages")


for _stream in (stream_daily_views, stream_first_scans, stream_activity_counts, stream_kpis, stream_kpi_changes, stream_unread, stream_unread_messages,
                stream_publish_notices, stream_saves, stream_follows, stream_lifecycle, stream_due_sweep, stream_messages):
    QUERIES[_stream.__name__] = _stream
