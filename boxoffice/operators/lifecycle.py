"""State folded from change logs: listing status, bans, edits, profiles, settings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.times import ntz
from boxoffice.operators.base import salted_left_join
from boxoffice.sources.tables import Tables


def status_after(as_of: datetime) -> Column:
    """Published listings end once their end has passed; drafts are cancelled once their start has.
    A listing without an end never ends by itself."""
    now = ntz(as_of)
    return (
        F.when((F.col("status") == "published") & (F.col("date_end") < now), "ended")
        .when((F.col("status") == "draft") & (F.col("date_start") < now), "cancelled").otherwise(F.col("status")))


def lifecycle_update(listings: DataFrame, *, as_of: datetime) -> DataFrame:
    """The listings whose status changes, batch or streaming."""
    changed = listings.withColumn("new_status", status_after(as_of))
    return changed.filter(F.col("new_status") != F.col("status")).select(
        F.col("id").alias("listing_id"), F.col("status").alias("old_status"), "new_status")


def listing_status_latest(t: Tables, log: DataFrame) -> DataFrame:
    """Stored status overridden by the latest entry of the change log."""
    last = log.groupBy("listing_id").agg(F.max_by("status", F.struct("ts", "event_id")).alias("last"))
    return t.listings.select(F.col("id").alias("listing_id"), "status").join(last, "listing_id", "left").select(
        "listing_id", F.coalesce("last", "status").alias("status"), F.col("last").isNotNull().alias("changed"))


def ban_state(t: Tables, log: DataFrame) -> DataFrame:
    """Ban flag after the log (user_id, action, ts, event_id); admins are never banned.

    The last ban, unban or account deletion sets the flag; each toggle after it flips it.
    """
    moment = F.struct("ts", "event_id")
    explicit = log.filter(F.col("action") != "toggle").groupBy("user_id").agg(
        F.max(moment).alias("set_at"), F.max_by(F.col("action") != "unban", moment).alias("set_to"))
    toggles = salted_left_join(
        log.filter(F.col("action") == "toggle"), explicit.select("user_id", "set_at"), "user_id", "event_id")
    later = toggles.filter(F.col("set_at").isNull() | (moment > F.col("set_at"))).groupBy("user_id").agg(F.count("*").alias("flips"))
    people = t.users.filter(F.col("role") != "admin").select(F.col("id").alias("user_id"), "is_banned")
    base = F.coalesce("set_to", "is_banned")
    flipped = F.coalesce("flips", F.lit(0)) % 2 == 1
    return people.join(explicit, "user_id", "left").join(later, "user_id", "left").select(
        "user_id", (base != flipped).alias("is_banned"))


EDITED = ("title", "type", "description", "date_start", "date_end", "venue", "city", "capacity", "price")


def listing_latest(t: Tables, edits: DataFrame) -> DataFrame:
    """Listings after their edits: all fields of the last edit, also where it empties them; a missing banner keeps the
    one before.

    The last moments per listing come first, from two numbers a listing that no sort holds; only the edits of these moments
    are then folded whole. The edits stream past the moments, and a shuffle of their own keeps that join splittable.
    """
    moment = F.struct("ts", "edit_id")
    kept = F.col("banner").isNotNull()
    heads = edits.groupBy("listing_id").agg(F.max("ts").alias("_last"), F.max(F.when(kept, F.col("ts"))).alias("_banner"))
    ending = edits.join(heads.hint("shuffle_hash"), "listing_id").filter(
        F.col("ts").eqNullSafe(F.col("_last")) | (kept & F.col("ts").eqNullSafe(F.col("_banner")))).drop("_last", "_banner")
    last = ending.repartition("listing_id").groupBy("listing_id").agg(
        F.max_by(F.struct(*EDITED, "edit_id"), moment).alias("e"),
        F.max_by("banner", F.when(F.col("banner").isNotNull(), moment)).alias("banner"))
    rows = t.listings.select(F.col("id").alias("listing_id"), *EDITED).join(last, "listing_id", "left")
    types = {"capacity": "bigint", "price": "double"}

    def value(name: str) -> Column:
        edited = F.when(F.col("e").isNotNull(), F.col(f"e.{name}")).otherwise(F.col(name))
        return (edited.cast(types[name]) if name in types else edited).alias(name)

    return rows.select("listing_id", *map(value, EDITED), "banner", F.col("e.edit_id").alias("edit_id"))


def details_latest(t: Tables, edits: DataFrame, edit_details: DataFrame) -> DataFrame:
    """Details are replaced as a set: those of the last edit, or the original ones if never edited."""
    last = edits.groupBy("listing_id").agg(F.max_by("edit_id", F.struct("ts", "edit_id")).alias("edit_id"))
    kept = t.listing_details.join(last, "listing_id", "left_anti").select("listing_id", "field_key", "field_value")
    fresh = edit_details.filter(F.trim("field_value") != "").join(last.drop("listing_id"), "edit_id", "left_semi").select(
        "listing_id", "field_key", F.trim("field_value").alias("field_value"))
    return kept.unionByName(fresh)


def profile_latest(t: Tables, edits: DataFrame) -> DataFrame:
    """Profiles after their edits. Creators set organization, website and interests, attendees city and
    interests; a missing avatar keeps the one before."""
    moment = F.struct("ts", "edit_id")
    last = edits.groupBy("user_id").agg(
        F.max_by(F.struct("name", "phone", "bio", "organization_name", "website_url", "city", "preferences"), moment).alias("e"),
        F.max_by("avatar", F.when(F.col("avatar").isNotNull(), moment)).alias("avatar"))
    people = t.users.select(F.col("id").alias("user_id"), "role", "name", "city", "preferences", "organization_name")
    edited = F.col("e").isNotNull()
    return people.join(last, "user_id", "left").select(
        "user_id", F.when(edited, F.trim("e.name")).otherwise(F.col("name")).alias("name"), F.trim("e.phone").alias("phone"),
        F.trim("e.bio").alias("bio"),
        F.when(edited & (F.col("role") == "creator"), F.trim("e.organization_name")).otherwise(F.col("organization_name")).alias("organization_name"),
        F.when(edited & (F.col("role") == "creator"), F.trim("e.website_url")).alias("website_url"),
        F.when(edited & (F.col("role") == "user"), F.trim("e.city")).otherwise(F.col("city")).alias("city"),
        F.when(edited & F.col("role").isin("creator", "user"), F.col("e.preferences")).otherwise(F.col("preferences")).alias("preferences"),
        "avatar")


def settings_latest(log: DataFrame) -> DataFrame:
    """The last value of each setting in each scope."""
    return log.groupBy("scope_id", "setting_key").agg(F.max_by("setting_value", F.struct("ts", "event_id")).alias("setting_value"))


def fill_missing(existing: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Add defaults for absent keys; what exists is never overwritten."""
    return existing.unionByName(defaults.join(existing, keys, "left_anti"))
