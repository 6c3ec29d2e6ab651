"""Reports per attendee, for all attendees in one pass."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.functions.ratios import money
from boxoffice.functions.text import label
from boxoffice.functions.times import ntz
from boxoffice.operators.base import Ids, live, of_registrations, payment_totals, restrict, successful, top_per_key
from boxoffice.sources.tables import Tables


def _attendees(t: Tables, ids: Ids) -> DataFrame:
    people = t.users.filter(F.col("role") == "user").select(F.col("id").alias("user_id"))
    return restrict(people, "user_id", ids)


def _own(t: Tables, ids: Ids) -> DataFrame:
    return restrict(t.registrations.withColumnRenamed("id", "registration_id"), "user_id", ids)


def user_summary(t: Tables, *, as_of: datetime, ids: Ids = None) -> DataFrame:
    """Tickets, upcoming, past and money spent. Past is everything live that is not upcoming;
    spending takes cancelled registrations too."""
    ahead = t.listings.filter(F.col("date_start") > ntz(as_of)).select(
        F.col("id").alias("listing_id"), F.lit(True).alias("ahead"))
    kept = F.col("status") != "cancelled"
    own = _own(t, ids).select("registration_id", *(k for k in t.key if k != "registration_id"), "user_id", "listing_id", "status")
    rows = (
        own.join(payment_totals(t, None if ids is None else own), list(t.key), "left").join(ahead, "listing_id", "left")
    )
    totals = rows.groupBy("user_id").agg(
        F.count_if(kept).alias("tickets"), F.count_if(kept & F.col("ahead")).alias("upcoming"), F.sum("paid").alias("paid"))
    tickets, upcoming = F.coalesce("tickets", F.lit(0)), F.coalesce("upcoming", F.lit(0))
    return _attendees(t, ids).join(totals, "user_id", "left").select(
        "user_id", tickets.alias("tickets_total"), upcoming.alias("upcoming_listings"),
        (tickets - upcoming).alias("past_listings"), money(F.coalesce("paid", F.lit(0))).alias("total_spent"))


def spend_axis(as_of: datetime) -> list[datetime]:
    """Six points 30 days apart, oldest first: a month may occur twice or not at all."""
    return [as_of - timedelta(days=30 * step) for step in range(5, -1, -1)]


def user_spend_6m(t: Tables, *, as_of: datetime, ids: Ids = None) -> DataFrame:
    """Spending per attendee over the six axis points, one conditional sum each.

    Payments count from the first of the month 180 days back.
    """
    oldest = (as_of - timedelta(days=180)).replace(day=1, hour=0, minute=0, second=0, microsecond=0)
    points = spend_axis(as_of)
    own = _own(t, ids).select("registration_id", "user_id")
    recent = of_registrations(successful(t.payments).filter(F.col("created_at") >= ntz(oldest)), None if ids is None else own)
    month = F.date_format("created_at", "yyyy-MM")
    per_registration = recent.groupBy("registration_id", month.alias("month")).agg(F.sum("amount").alias("paid"))
    rows = per_registration.join(own, "registration_id")
    sums = rows.groupBy("user_id").agg(*[
        F.sum(F.when(F.col("month") == p.strftime("%Y-%m"), F.col("paid"))).alias(f"p{i}") for i, p in enumerate(points)])
    series = F.array(*[
        F.struct(F.lit(i).cast("bigint").alias("ordinal"), F.lit(p.strftime("%b")).alias("label"),
                 money(F.coalesce(f"p{i}", F.lit(0))).alias("spent")) for i, p in enumerate(points)])
    return _attendees(t, ids).join(sums, "user_id", "left").select("user_id", F.inline(series))


def _type_counts(t: Tables, ids: Ids) -> DataFrame:
    kinds = t.listings.select(F.col("id").alias("listing_id"), "type")
    rows = live(_own(t, ids)).select("user_id", "listing_id").join(kinds, "listing_id")
    return rows.groupBy("user_id", "type").agg(F.count("*").alias("n"))


def top_types(t: Tables, *, ids: Ids = None) -> DataFrame:
    """The type each attendee registered for most often (first by name among equals)."""
    return top_per_key(_type_counts(t, ids), ["user_id"], [F.desc("n"), F.asc("type")], 1, "ordinal").select(
        "user_id", F.col("type").alias("top_type"))


def user_type_history(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Types per attendee, most frequent first; one placeholder row when there are none."""
    # At most one row per listing type in each window.
    window = Window.partitionBy("user_id").orderBy(F.desc("n"), "type")
    ranked = _type_counts(t, ids).withColumn("ordinal", F.row_number().over(window).cast("bigint"))
    return _attendees(t, ids).join(ranked, "user_id", "left").select(
        "user_id", F.coalesce("ordinal", F.lit(1)).alias("ordinal"),
        F.coalesce(label(F.col("type")), F.lit("No Events")).alias("label"), F.coalesce("n", F.lit(1)).alias("registrations"),
        F.when(F.col("ordinal") == 1, F.col("type")).alias("top_type"))


def user_upcoming(t: Tables, *, as_of: datetime, limit: int = 3, ids: Ids = None) -> DataFrame:
    ahead = t.listings.filter(F.col("date_start") > ntz(as_of)).select(
        F.col("id").alias("listing_id"), "title", "type", "date_start", "city", "venue")
    rows = live(_own(t, ids)).select("registration_id", "user_id", "listing_id", "ticket_code").join(ahead, "listing_id")
    best = top_per_key(rows, ["user_id"], [F.asc("date_start"), F.asc("registration_id")], limit, "ordinal")
    return best.select(
        "user_id", F.col("ordinal").cast("bigint").alias("ordinal"), "listing_id", "title", "type", "date_start",
        "city", "venue", "ticket_code")


def ticket_book(t: Tables, *, as_of: datetime, ids: Ids = None) -> DataFrame:
    """All tickets, newest start first. Cancelled tickets are past; a live ticket without a start
    date belongs to neither half."""
    shows = t.listings.select(F.col("id").alias("listing_id"), "title", "type", "date_start", "city", "venue")
    cancelled = F.col("status") == "cancelled"
    bucket: Column = F.when((F.col("date_start") > ntz(as_of)) & ~cancelled, "upcoming").when(
        (F.col("date_start") <= ntz(as_of)) | cancelled, "past")
    return _own(t, ids).select("registration_id", "user_id", "listing_id", "ticket_code", "status").join(shows, "listing_id").select(
        "user_id", "registration_id", "ticket_code", "status", "title", "type", "date_start", "city", "venue",
        bucket.alias("bucket")).orderBy("user_id", F.desc_nulls_last("date_start"), "registration_id")
