"""Recommendations per attendee without ever pairing all attendees with all listings."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.functions.times import micros, ntz
from boxoffice.operators.attendees import top_types
from boxoffice.operators.base import Ids, live, positions, restrict
from boxoffice.session import materialize
from boxoffice.sources.tables import Tables

NEWEST, SHUFFLED, OF_TYPE = "newest", "shuffled", "type:"
# Positions up to this one are looked up in a table of list heads.
HEAD = 500


def _open_lists(t: Tables, as_of: datetime, seed: str) -> DataFrame:
    """Open listings, each at its position in three lists: all by age, its type by age, all shuffled."""
    shows = t.listings.filter((F.col("status") == "published") & (F.col("date_start") > ntz(as_of)))
    age = -micros(F.col("created_at"))
    shuffle = F.sha2(F.concat(F.col("id").cast("string"), F.lit(":" + seed)), 256)
    entry = F.array(
        F.struct(F.lit(NEWEST).alias("list"), age.alias("age"), F.lit("").alias("mix")),
        F.struct(F.concat(F.lit(OF_TYPE), "type").alias("list"), age.alias("age"), F.lit("").alias("mix")),
        F.struct(F.lit(SHUFFLED).alias("list"), F.lit(0).cast("bigint").alias("age"), shuffle.alias("mix")))
    rows = shows.select(F.col("id").alias("listing_id"), F.inline(entry))
    placed = positions(rows, ["list"], [F.asc("age"), F.asc("mix"), F.asc("listing_id")], "position")
    # Small (three rows per open listing) and read several times below.
    return materialize(placed.select("list", "listing_id", F.col("position").cast("bigint").alias("position")), "open-lists")


def _wanted_lists(t: Tables, lists: DataFrame, ids: Ids) -> DataFrame:
    """Each attendee's list, and for those with a history the shuffled one to fall back on, with the
    position just behind its end."""
    people = restrict(t.users.filter(F.col("role") == "user").select(F.col("id").alias("user_id")), "user_id", ids)
    liked = people.join(top_types(t, ids=ids), "user_id", "left")
    names = F.when(F.col("top_type").isNull(), F.array(F.lit(NEWEST))).otherwise(
        F.array(F.concat(F.lit(OF_TYPE), "top_type"), F.lit(SHUFFLED)))
    # One row per list: the enumerated listing types plus two.
    ends = lists.groupBy("list").agg((F.count("*") + 1).alias("position"))
    return liked.select("user_id", F.explode(names).alias("list")).join(ends, "list").select("user_id", "list", "position")


def _free_positions(wanted: DataFrame, taken: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` positions of each wanted list that the attendee has not registered for.

    The k-th taken position p has p - k free ones before it. Only those with fewer than ``limit`` matter, and of
    several with equally many only the last, so at most ``limit`` are left per list however much an attendee holds.
    The n-th free position is n plus the number of taken ones before it.
    """
    relevant = taken.join(wanted.select("user_id", "list"), ["user_id", "list"], "left_semi")
    numbered = positions(relevant, ["user_id", "list"], ["position"], "k")
    free_before = F.col("position") - F.col("k")
    last = numbered.filter(free_before < limit).groupBy("user_id", "list", free_before.alias("free")).agg(F.max("k").alias("k"))
    marks = last.groupBy("user_id", "list").agg(F.collect_list(F.struct("free", "k")).alias("marks"))
    ordinals = wanted.select("user_id", "list", F.col("position").alias("end"), F.explode(
        F.sequence(F.lit(1).cast("bigint"), F.lit(limit).cast("bigint"))).alias("ordinal"))
    before = F.array_max(F.transform(F.filter("marks", lambda m: m["free"] < F.col("ordinal")), lambda m: m["k"]))
    return ordinals.join(marks, ["user_id", "list"], "left").withColumn(
        "position", (F.col("ordinal") + F.coalesce(before, F.lit(0))).cast("bigint")).filter("position < end").select(
        "user_id", "list", "position", "ordinal")


def _at_positions(picked: DataFrame, lists: DataFrame) -> DataFrame:
    """Look positions up. Nearly all are near the top, so the heads (HEAD rows of each list) are a table of their own,
    which Spark broadcasts if its size allows; only deeper positions need the whole lists."""
    head = materialize(lists.filter(F.col("position") <= HEAD), "list-heads")
    near = picked.filter(F.col("position") <= HEAD).join(head, ["list", "position"])
    far = picked.filter(F.col("position") > HEAD).join(lists.filter(F.col("position") > HEAD), ["list", "position"])
    return near.unionByName(far)


def recommendations(t: Tables, *, as_of: datetime, limit: int = 6, seed: str = "0", ids: Ids = None) -> DataFrame:
    """Newest open listings of the attendee's top type that they do not hold; when that yields none,
    any open ones in shuffled order; without history, the newest of any type."""
    lists = _open_lists(t, as_of, seed)
    # Attendees who get the unfiltered list hold nothing, so it needs no taken positions. Joining first
    # leaves only registrations for open listings to be made distinct.
    held = restrict(live(t.registrations), "user_id", ids).select("user_id", "listing_id").join(
        lists.filter(F.col("list") != NEWEST), "listing_id").select("user_id", "list", "position").distinct()
    free = _free_positions(_wanted_lists(t, lists, ids), held, limit)
    # At most two lists of ``limit`` rows in each window: keep the fallback only where it stands alone.
    has_first = F.max(F.col("list") != SHUFFLED).over(Window.partitionBy("user_id"))
    chosen = free.withColumn("has_first", has_first).filter((F.col("list") != SHUFFLED) | ~F.col("has_first"))
    picked = _at_positions(chosen.select("user_id", "list", "position", "ordinal"), lists)
    shows = t.listings.select(F.col("id").alias("listing_id"), "title", "type", "city", "date_start", "price")
    return picked.join(shows, "listing_id").select(
        "user_id", "ordinal", "listing_id", "title", "type", "city", "date_start", F.col("price").cast("double").alias("price"),
        (F.col("list") == SHUFFLED).alias("fallback"))
