"""Platform reports: indicators, monthly series, mixes and boards."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.ratios import money, whole_percent
from boxoffice.functions.text import folded, label
from boxoffice.functions.times import days_before, ntz, on_day, within_year
from boxoffice.operators.base import full_ledger, joined_ledger, live, payment_totals, registration_rows, successful, zero_filled
from boxoffice.schema import LISTING_TYPES, STATUS_AXIS
from boxoffice.sources.tables import Tables


def platform_kpis(t: Tables, *, as_of: datetime) -> DataFrame:
    """One row of headline numbers; every table is read once."""
    attendee = F.col("role") == "user"
    people = t.users.agg(
        F.count_if(attendee).alias("total_users"), F.count_if(F.col("role") == "creator").alias("total_creators"),
        F.count_if(attendee & (F.col("created_at") >= ntz(days_before(as_of, 7)))).alias("new_users_this_week"))
    shows = t.listings.filter(F.col("status") == "published").agg(
        F.count("*").alias("total_listings"), F.count_if(on_day(F.col("date_start"), as_of)).alias("listings_today"))
    seats = live(t.registrations).agg(F.count("*").alias("total_registrations"))
    income = successful(t.payments).agg(F.sum("amount").alias("total_revenue"))
    parts = people
    for part in (shows, seats, income):
        parts = parts.unionByName(part, allowMissingColumns=True)
    return parts.agg(
        *[F.max(c).alias(c) for c in ("total_users", "total_creators", "total_listings", "total_registrations")],
        money(F.coalesce(F.max("total_revenue"), F.lit(0))).alias("total_revenue"),
        F.max("listings_today").alias("listings_today"), F.max("new_users_this_week").alias("new_users_this_week"))


def _month_axis(t: Tables) -> DataFrame:
    return t.spark.range(1, 13).select(F.col("id").alias("month"))


def _month(column: Column) -> Column:
    return F.month(column).cast("bigint").alias("month")


def _month_label() -> Column:
    return F.date_format(F.make_date(F.lit(2000), F.col("month").cast("int"), F.lit(1)), "MMM").alias("label")


def _revenue_facts(t: Tables, year: int) -> DataFrame:
    rows = successful(t.payments).filter(within_year(F.col("created_at"), year))
    return rows.select(_month(F.col("created_at")), F.col("amount").cast("decimal(20,2)").alias("revenue"))


def _registration_facts(t: Tables, year: int) -> DataFrame:
    rows = live(t.registrations).filter(within_year(F.col("created_at"), year))
    return rows.select(_month(F.col("created_at")), F.lit(1).cast("bigint").alias("registrations"))


def _signup_facts(t: Tables, year: int) -> DataFrame:
    rows = t.users.filter((F.col("role") == "user") & within_year(F.col("created_at"), year))
    return rows.select(_month(F.col("created_at")), F.lit(1).cast("bigint").alias("new_users"))


def revenue_by_month(t: Tables, *, year: int) -> DataFrame:
    series = zero_filled(_revenue_facts(t, year), _month_axis(t), ["month"], ["revenue"])
    return series.select("month", _month_label(), money(F.col("revenue")).alias("revenue"))


def registrations_by_month(t: Tables, *, year: int) -> DataFrame:
    series = zero_filled(_registration_facts(t, year), _month_axis(t), ["month"], ["registrations"])
    return series.select("month", _month_label(), "registrations")


def signups_by_month(t: Tables, *, year: int) -> DataFrame:
    series = zero_filled(_signup_facts(t, year), _month_axis(t), ["month"], ["new_users"])
    return series.select("month", _month_label(), "new_users")


def monthly_summary(t: Tables, *, year: int) -> DataFrame:
    """The three series side by side, from one aggregation over their union."""
    facts = (
        _revenue_facts(t, year)
        .unionByName(_registration_facts(t, year), allowMissingColumns=True)
        .unionByName(_signup_facts(t, year), allowMissingColumns=True)
    )
    table = zero_filled(facts, _month_axis(t), ["month"], ["revenue", "registrations", "new_users"])
    return table.select("month", _month_label(), money(F.col("revenue")).alias("revenue"), "registrations", "new_users")


def _axis_counts(t: Tables, column: str, axis: Sequence[tuple[str, str]]) -> DataFrame:
    """Listing counts over a fixed axis of (value, label); values off the axis are left out."""
    frame = t.spark.createDataFrame([(i, v, lb) for i, (v, lb) in enumerate(axis)], "ordinal long, value string, label string")
    facts = t.listings.filter(F.col(column).isin(*[v for v, _ in axis])).select(
        F.col(column).alias("value"), F.lit(1).cast("bigint").alias("listings"))
    counts = zero_filled(facts, frame, ["value"], ["listings"])
    # The axis is a handful of rows, written in the call.
    return counts.join(F.broadcast(frame), "value").select("ordinal", "value", "label", "listings")


def listings_by_type(t: Tables, *, axis: Sequence[tuple[str, str]] = LISTING_TYPES) -> DataFrame:
    return _axis_counts(t, "type", axis)


def listings_by_status(t: Tables) -> DataFrame:
    return _axis_counts(t, "status", [(s, s.capitalize()) for s in STATUS_AXIS])


def revenue_by_type(t: Tables) -> DataFrame:
    """Successful payments by listing type, cancelled registrations included, largest first."""
    regs = registration_rows(t, "listing_id")
    per_listing = (
        payment_totals(t).join(regs, list(t.key)).groupBy("listing_id").agg(F.sum("paid").alias("paid"))
    )
    kinds = t.listings.select(F.col("id").alias("listing_id"), "type")
    total = per_listing.join(kinds, "listing_id").groupBy("type").agg(F.sum("paid").alias("paid"))
    return total.select("type", label(F.col("type")).alias("label"), money(F.col("paid")).alias("revenue")).orderBy(
        F.desc("revenue"), "type")


def top_listings(t: Tables, *, limit: int = 5) -> DataFrame:
    """Published listings with most registrations; revenue stays NULL where nothing was paid."""
    shows = t.listings.filter(F.col("status") == "published").select(
        F.col("id").alias("listing_id"), "title", "capacity")
    registered = F.coalesce("registered", F.lit(0))
    return (
        shows.join(joined_ledger(t), "listing_id", "left")
        .select(
            "listing_id", "title", registered.alias("registrations"), money(F.col("revenue")).alias("revenue"),
            F.col("capacity").cast("bigint").alias("capacity"),
            whole_percent(registered, F.col("capacity")).alias("fill_pct"))
        .orderBy(F.desc("registrations"), "listing_id").limit(limit)
    )


def top_creators(t: Tables, *, limit: int = 5) -> DataFrame:
    """Creators by revenue. Listings are unique in the ledger join, so a plain count replaces a
    distinct one."""
    rows = t.listings.select(F.col("id").alias("listing_id"), "creator_id").join(joined_ledger(t), "listing_id", "left")
    per_creator = rows.groupBy("creator_id").agg(
        F.count("*").alias("listings"), F.coalesce(F.sum("registered"), F.lit(0)).alias("attendees"),
        F.sum("revenue").alias("revenue"))
    names = t.users.filter(F.col("role") == "creator").select(F.col("id").alias("creator_id"), "name")
    return (
        per_creator.join(names, "creator_id")
        .select("creator_id", "name", "listings", "attendees", money(F.col("revenue")).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "creator_id").limit(limit)
    )


def recent_activity(t: Tables, *, limit: int = 10) -> DataFrame:
    """Newest registrations with names. Every registration has its user and listing (see the
    integrity audit), so the cut comes before the name joins and their other sides stay small."""
    newest = t.registrations.select("id", "user_id", "listing_id", "created_at").orderBy(F.desc("created_at"), "id").limit(limit)
    people = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    shows = t.listings.select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title"))
    newest = F.broadcast(newest)  # at most ``limit`` rows
    with_names = people.join(newest, "user_id")
    # Still at most ``limit`` rows: user ids are unique.
    return shows.join(F.broadcast(with_names), "listing_id").select(
        F.col("id").alias("registration_id"), "created_at", "user_name", "listing_title").orderBy(F.desc("created_at"), "registration_id")


def city_breakdown(t: Tables, *, limit: int = 10) -> DataFrame:
    """Cities with most listings; spellings that differ in case, accents or trailing spaces are one.

    Counting exact spellings first leaves only a few rows for the slower tolerant grouping.
    """
    spelled = t.listings.filter(F.col("city").isNotNull() & (F.rtrim("city") != "")).groupBy("city").agg(F.count("*").alias("n"))
    merged = spelled.groupBy(folded(F.col("city")).alias("city_key")).agg(
        F.min("city").alias("label"), F.sum("n").alias("listings"))
    return merged.select("label", "listings").orderBy(F.desc("listings"), "label").limit(limit)


def payment_mix(t: Tables) -> DataFrame:
    return successful(t.payments).groupBy(F.upper("method").alias("label")).agg(F.count("*").alias("payments"))


def users_by_role(t: Tables) -> DataFrame:
    return t.users.groupBy("role").agg(F.count("*").alias("users"))


def listing_admin_report(t: Tables, *, search: str = "", status: str = "all") -> DataFrame:
    """Listings with creator, live registrations and revenue (NULL where nothing was paid)."""
    from boxoffice.functions.text import has_text

    shows = t.listings
    if search:
        shows = shows.filter(has_text(F.col("title"), search))
    if status != "all":
        shows = shows.filter(F.col("status") == status)
    names = t.users.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    shows = shows.select(F.col("id").alias("listing_id"), "creator_id", "title", "status", "created_at")
    return (
        shows.join(full_ledger(t), "listing_id", "left").join(names, "creator_id")
        .select(
            "listing_id", "title", "status", "creator_name", F.coalesce("registered", F.lit(0)).alias("registered"),
            money(F.col("revenue")).alias("revenue"), "created_at")
        .orderBy(F.desc("created_at"), "listing_id")
    )
