"""Reports per creator, for all creators in one pass."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.ratios import band, money, percent, whole_percent
from boxoffice.functions.text import comma_list, first_filled, label, shortened
from boxoffice.functions.times import midnight, ntz
from boxoffice.operators.base import (
    Ids, full_ledger, joined_ledger, live, restrict, seat_counts, top_per_key, zero_filled,
)
from boxoffice.sources.tables import Tables


def _creators(t: Tables, ids: Ids) -> DataFrame:
    people = t.users.filter(F.col("role") == "creator").withColumnRenamed("id", "creator_id")
    return restrict(people, "creator_id", ids)


def _own_listings(t: Tables, ids: Ids) -> DataFrame:
    return restrict(t.listings.withColumnRenamed("id", "listing_id"), "creator_id", ids)


def _their_ids(t: Tables, ids: Ids) -> DataFrame | None:
    """The listings of the wanted creators, for the facts to be restricted by before they are folded."""
    return None if ids is None else _own_listings(t, ids).select("listing_id")


def creator_summary(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Listings, attendees, revenue and pooled fill rate. Capacity leaves cancelled listings out,
    attendees do not; revenue takes payments of all registrations."""
    kept = F.col("status") != "cancelled"
    rows = _own_listings(t, ids).select("listing_id", "creator_id", "status", "capacity").join(full_ledger(t, _their_ids(t, ids)), "listing_id", "left")
    totals = rows.groupBy("creator_id").agg(
        F.count_if(kept).alias("listings"), F.sum(F.when(kept, F.col("capacity"))).alias("seats"),
        F.sum("registered").alias("attendees"), F.sum("revenue").alias("revenue"))
    return _creators(t, ids).select("creator_id").join(totals, "creator_id", "left").select(
        "creator_id", F.coalesce("listings", F.lit(0)).alias("total_listings"),
        F.coalesce("attendees", F.lit(0)).alias("total_attendees"),
        money(F.coalesce("revenue", F.lit(0))).alias("total_revenue"),
        percent(F.coalesce("attendees", F.lit(0)), F.coalesce("seats", F.lit(0))).alias("avg_fill_rate"))


def _performance(t: Tables, ids: Ids) -> DataFrame:
    shows = _own_listings(t, ids).filter(F.col("status") != "cancelled")
    return shows.join(joined_ledger(t, _their_ids(t, ids)), "listing_id", "left").withColumn("registered", F.coalesce("registered", F.lit(0)))


def creator_revenue_top8(t: Tables, *, limit: int = 8, ids: Ids = None) -> DataFrame:
    """Each creator's best earning listings with short labels."""
    rows = _performance(t, ids).select("creator_id", "listing_id", "title", "revenue")
    best = top_per_key(rows, ["creator_id"], [F.desc_nulls_last("revenue"), F.asc("listing_id")], limit, "ordinal")
    return best.select(
        "creator_id", F.col("ordinal").cast("bigint").alias("ordinal"), "listing_id",
        shortened(F.col("title"), 15).alias("label"), money(F.coalesce("revenue", F.lit(0))).alias("revenue"))


def creator_trend(t: Tables, *, as_of: datetime, days: int = 30, ids: Ids = None) -> DataFrame:
    """Live registrations per creator and day; the axis ends on the as_of day."""
    first = midnight(as_of) - timedelta(days=days - 1)
    after = midnight(as_of) + timedelta(days=1)
    recent = restrict(live(t.registrations), "listing_id", _their_ids(t, ids)).filter((F.col("created_at") >= ntz(first)) & (F.col("created_at") < ntz(after)))
    offset = F.datediff(F.to_date("created_at"), F.lit(first.date())).cast("bigint")
    per_listing = recent.groupBy("listing_id", offset.alias("ordinal")).agg(F.count("*").alias("registrations"))
    owners = _own_listings(t, ids).select("listing_id", "creator_id")
    facts = per_listing.join(owners, "listing_id")
    axis = _creators(t, ids).select("creator_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(days - 1).cast("bigint"))).alias("ordinal"))
    day = F.date_add(F.lit(first.date()), F.col("ordinal").cast("int"))
    return zero_filled(facts, axis, ["creator_id", "ordinal"], ["registrations"]).select(
        "creator_id", "ordinal", F.date_format(day, "MM-dd").alias("label"), "registrations")


def creator_performance(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Every listing that is not cancelled, with registrations, revenue, fill rate and colour band."""
    fill = whole_percent(F.col("registered"), F.col("capacity"))
    return (
        _performance(t, ids).select(
            "creator_id", "listing_id", "title", F.col("capacity").cast("bigint").alias("capacity"), "status", "type",
            "registered", money(F.col("revenue")).alias("revenue"), fill.alias("fill_pct"), band(fill).alias("band"))
        .orderBy("creator_id", F.desc("registered"), "listing_id")
    )


def creator_top_listing(t: Tables, *, ids: Ids = None) -> DataFrame:
    rows = _performance(t, ids).select(
        "creator_id", "listing_id", "title", "registered", money(F.col("revenue")).alias("revenue"))
    return top_per_key(rows, ["creator_id"], [F.desc("registered"), F.asc("listing_id")], 1, "ordinal").drop("ordinal")


def creator_public_stats(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Public profile: name, interests, shown listings, attendees, followers, member since."""
    shown = F.col("status").isin("published", "ended")
    rows = _own_listings(t, ids).select("listing_id", "creator_id", "status").join(seat_counts(t, _their_ids(t, ids)), "listing_id", "left")
    totals = rows.groupBy("creator_id").agg(F.count_if(shown).alias("listings"), F.sum("registered").alias("attendees"))
    fans = restrict(t.follows, "creator_id", ids).groupBy("creator_id").agg(F.count("*").alias("followers"))
    interests = F.array_join(F.transform(comma_list(F.col("preferences")), label), ", ")
    return (
        _creators(t, ids).join(totals, "creator_id", "left").join(fans, "creator_id", "left").select(
            "creator_id", first_filled(F.col("organization_name"), F.col("name")).alias("display_name"),
            interests.alias("interests"), F.coalesce("listings", F.lit(0)).alias("total_listings"),
            F.coalesce("attendees", F.lit(0)).alias("total_attendees"),
            F.coalesce("followers", F.lit(0)).alias("followers"),
            F.date_format("created_at", "MMMM yyyy").alias("member_since"))
    )


def creator_manage_stats(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Totals above a creator's own list; the price sum counts each listing's price once."""
    rows = _own_listings(t, ids).select("listing_id", "creator_id", "status", "price").join(seat_counts(t, _their_ids(t, ids)), "listing_id", "left")
    totals = rows.groupBy("creator_id").agg(
        F.count("*").alias("listings"), F.count_if(F.col("status") == "published").alias("published"),
        F.sum("registered").alias("registered"), F.sum("price").alias("price"))
    return _creators(t, ids).select("creator_id").join(totals, "creator_id", "left").select(
        "creator_id", F.coalesce("listings", F.lit(0)).alias("listings"),
        F.coalesce("published", F.lit(0)).alias("published"), F.coalesce("registered", F.lit(0)).alias("registered"),
        money(F.coalesce("price", F.lit(0))).alias("list_price_sum"))


def creator_published(t: Tables, *, ids: Ids = None) -> DataFrame:
    rows = _own_listings(t, ids).filter(F.col("status") == "published")
    return rows.select("creator_id", "listing_id", "title", "type", "date_start").orderBy("creator_id", "date_start", "listing_id")


def creator_listings(t: Tables, *, ids: Ids = None) -> DataFrame:
    rows = _own_listings(t, ids).select("creator_id", "listing_id", "title", "status", "created_at")
    return rows.join(seat_counts(t, _their_ids(t, ids)), "listing_id", "left").select(
        "creator_id", "listing_id", "title", "status", "created_at", F.coalesce("registered", F.lit(0)).alias("registered"),
    ).orderBy("creator_id", F.desc("created_at"), "listing_id")
