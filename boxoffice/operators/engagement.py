"""Engagement: saves, follows, notices, inboxes, reviews, views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.text import shortened
from boxoffice.operators.base import Ids, positions, restrict, top_per_key
from boxoffice.operators.intervals import interval_join
from boxoffice.schema import DELETED_MESSAGE
from boxoffice.sources.tables import Tables


def _switched_on(toggles: DataFrame, pair: list[str], moment: str) -> DataFrame:
    """Pairs toggled an odd number of times; the last toggle is the moment they came on."""
    return toggles.groupBy(*pair).agg(F.count("*").alias("n"), F.max("ts").alias(moment)).filter(F.col("n") % 2 == 1).drop("n")


def save_state(toggles: DataFrame) -> DataFrame:
    return _switched_on(toggles, ["user_id", "listing_id"], "saved_at")


def follow_state(toggles: DataFrame) -> DataFrame:
    """Current follows; nobody follows themselves."""
    return _switched_on(toggles.filter(F.col("follower_id") != F.col("creator_id")), ["follower_id", "creator_id"], "followed_at")


def follow_spans(toggles: DataFrame) -> DataFrame:
    """From when to when each follow held: every odd toggle opens a span, the next one closes it."""
    rows = toggles.filter(F.col("follower_id") != F.col("creator_id")).select("event_id", "follower_id", "creator_id", "ts")
    turn = positions(rows, ["follower_id", "creator_id"], [F.asc("ts"), F.asc("event_id")], "n")
    span = F.floor((F.col("n") + 1) / 2).alias("span")
    return turn.groupBy("follower_id", "creator_id", span).agg(
        F.max(F.when(F.col("n") % 2 == 1, F.col("ts"))).alias("followed_at"),
        F.max(F.when(F.col("n") % 2 == 0, F.col("ts"))).alias("unfollowed_at"))


def follow_notices(t: Tables, toggles: DataFrame) -> DataFrame:
    """One notification to the creator each time somebody starts following."""
    names = t.users.select(F.col("id").alias("follower_id"), "name")
    return follow_spans(toggles).join(names, "follower_id").select(
        F.col("creator_id").alias("user_id"), F.concat("name", F.lit(" started following you!")).alias("message"),
        F.col("followed_at").alias("created_at"))


def publish_message(name: Column, title: Column) -> Column:
    return F.concat(name, F.lit(" has published a new event: "), title)


def publish_fanout(t: Tables, log: DataFrame, spans: DataFrame) -> DataFrame:
    """A notification for each person following the creator at the moment a listing is published."""
    names = t.users.select(F.col("id").alias("creator_id"), "name")
    shows = t.listings.select(F.col("id").alias("listing_id"), "creator_id", "title").join(names, "creator_id")
    published = log.filter(F.col("status") == "published").select("event_id", "listing_id", "ts").join(shows, "listing_id")
    told = interval_join(published, spans, "creator_id", "ts", "followed_at", "unfollowed_at", "follower_id")
    return told.select(
        "event_id", F.col("follower_id").alias("user_id"), publish_message(F.col("name"), F.col("title")).alias("message"),
        F.concat(F.lit("/events/"), F.col("listing_id").cast("string")).alias("link"), F.col("ts").alias("created_at"))


def notification_feed(t: Tables, *, limit: int = 10, ids: Ids = None) -> DataFrame:
    rows = restrict(t.notifications, "user_id", ids).select("id", "user_id", "message", "is_read", "created_at")
    newest = top_per_key(rows, ["user_id"], [F.desc("created_at"), F.asc("id")], limit, "ordinal")
    return newest.select(
        "user_id", F.col("ordinal").cast("bigint").alias("ordinal"), F.col("id").alias("notification_id"), "message", "is_read",
        F.date_format("created_at", "MMM dd, HH:mm").alias("date_str"))


def unread_notifications(t: Tables, *, ids: Ids = None) -> DataFrame:
    return restrict(t.notifications, "user_id", ids).groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def saved_feed(t: Tables, saves: DataFrame, *, limit: int = 4, ids: Ids = None) -> DataFrame:
    last = top_per_key(restrict(saves, "user_id", ids), ["user_id"], [F.desc("saved_at"), F.asc("listing_id")], limit, "ordinal")
    shows = t.listings.select(F.col("id").alias("listing_id"), "title", "type", "city", "date_start", "price")
    return last.join(shows, "listing_id").select(
        "user_id", F.col("ordinal").cast("bigint").alias("ordinal"), "listing_id", "title", "type", "city", "date_start",
        F.col("price").cast("double").alias("price"))


def saved_flags(pairs: DataFrame, saves: DataFrame) -> DataFrame:
    """For (user_id, listing_id) pairs: is the listing saved?"""
    return pairs.join(saves.select("user_id", "listing_id", F.lit(True).alias("on")), ["user_id", "listing_id"], "left").select(
        "user_id", "listing_id", F.coalesce("on", F.lit(False)).alias("is_saved"))


def following_flags(pairs: DataFrame, follows: DataFrame) -> DataFrame:
    """For (follower_id, creator_id) pairs: is the creator followed?"""
    return pairs.join(follows.select("follower_id", "creator_id", F.lit(True).alias("on")), ["follower_id", "creator_id"], "left").select(
        "follower_id", "creator_id", F.coalesce("on", F.lit(False)).alias("is_following"))


def rounded_mean(total: Column, count: Column) -> Column:
    """Mean to one decimal as binary floating point rounds it.

    Between midpoints ordinary rounding is right. At a midpoint (4.25, 4.35...) the outcome hangs on
    the stored binary value, so those forty values are taken from Python's own ``round``.
    """
    mean = total / count
    midpoints = F.create_map(*[x for m in range(21, 100, 2) for x in (F.lit(m / 20), F.lit(round(m / 20, 1)))])
    return F.coalesce(midpoints[mean], F.round(mean, 1))


def listing_ratings(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Review count and mean rating of every listing (0 without reviews)."""
    per = restrict(t.reviews, "listing_id", ids).groupBy("listing_id").agg(
        F.count("*").alias("reviews"), F.sum(F.col("rating").cast("bigint")).alias("stars"))
    shows = restrict(t.listings.select(F.col("id").alias("listing_id")), "listing_id", ids)
    return shows.join(per, "listing_id", "left").select(
        "listing_id", F.coalesce("reviews", F.lit(0)).alias("reviews"),
        F.coalesce(rounded_mean(F.col("stars"), F.col("reviews")), F.lit(0.0)).alias("avg_rating"))


def review_list(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Reviews per listing, newest first."""
    people = t.users.select(F.col("id").alias("user_id"), "name")
    return restrict(t.reviews, "listing_id", ids).join(people, "user_id").select(
        "listing_id", "name", F.col("rating").cast("bigint").alias("rating"), "review_text", "created_at").orderBy(
        "listing_id", F.desc("created_at"), "name", "review_text")


def daily_views(hits: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    return hits.groupBy("listing_id", day.alias("day")).agg(F.count("*").alias("views"))


# ---- messages ----

def _viewers(t: Tables) -> DataFrame:
    """Every thread twice: as its attendee and as its creator sees it."""
    sides = F.array(
        F.struct(F.col("user_id").alias("viewer_id"), F.col("creator_id").alias("other_id")),
        F.struct(F.col("creator_id").alias("viewer_id"), F.col("user_id").alias("other_id")))
    return t.threads.select(F.col("id").alias("thread_id"), "listing_id", "last_message_at", F.inline(sides))


def _per_sender(t: Tables) -> DataFrame:
    """Messages folded to one row per thread and sender."""
    return t.messages.groupBy("thread_id", "sender_id").agg(
        F.count_if(~F.col("is_read")).alias("unread"), F.max(F.struct("sent_at", "id")).alias("at"),
        F.max_by("message_text", F.struct("sent_at", "id")).alias("text"))


def unread_messages(t: Tables, *, ids: Ids = None) -> DataFrame:
    sent = t.messages.groupBy("thread_id", "sender_id").agg(F.count_if(~F.col("is_read")).alias("unread"))
    seen = restrict(_viewers(t), "viewer_id", ids).join(sent, "thread_id", "left")
    return seen.groupBy(F.col("viewer_id").alias("user_id")).agg(
        F.coalesce(F.sum(F.when(F.col("sender_id") != F.col("viewer_id"), F.col("unread"))), F.lit(0)).alias("unread"))


def inbox(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Threads per participant: the other party, the listing, a preview and the unread count."""
    rows = restrict(_viewers(t), "viewer_id", ids).join(_per_sender(t), "thread_id", "left")
    folded = rows.groupBy("thread_id", "viewer_id", "other_id", "listing_id", "last_message_at").agg(
        F.coalesce(F.sum(F.when(F.col("sender_id") != F.col("viewer_id"), F.col("unread"))), F.lit(0)).alias("unread"),
        F.max_by("text", "at").alias("text"))
    names = t.users.select(F.col("id").alias("other_id"), F.col("name").alias("other_name"))
    shows = t.listings.select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title"))
    return (
        folded.join(names, "other_id").join(shows, "listing_id", "left").select(
            "viewer_id", "thread_id", "other_name", "listing_title",
            F.coalesce(shortened(F.col("text"), 40), F.lit("No messages yet")).alias("preview"), "unread", "last_message_at")
        .orderBy("viewer_id", F.desc("last_message_at"), "thread_id")
    )


def thread_since(t: Tables, cursors: DataFrame | None = None, *, ids: Ids = None) -> DataFrame:
    """Transcripts in order, from after each thread's cursor (thread_id, last_id) if it has one."""
    rows = restrict(t.messages, "thread_id", ids)
    if cursors is not None:
        rows = rows.join(cursors, "thread_id", "left").filter(F.col("id") > F.coalesce("last_id", F.lit(0)))
    return rows.select("thread_id", F.col("id").alias("message_id"), "sender_id", "message_text", "sent_at").orderBy(
        "thread_id", "sent_at", "message_id")


def thread_upsert(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """The thread each request (request_id, user_id, creator_id, listing_id?, ts) ends up in.

    With a listing the exact triple is reused; without one any thread of the pair is. Otherwise the
    request opens a thread, named after itself. Requests to oneself are dropped.
    """
    pair = ["user_id", "creator_id"]
    asked = requests.filter(F.col("user_id") != F.col("creator_id"))
    moment = F.struct("ts", "request_id")
    old_pair = existing.groupBy(*pair).agg(F.min("id").alias("pair_thread"))
    old_triple = existing.filter(F.col("listing_id").isNotNull()).groupBy(*pair, "listing_id").agg(F.min("id").alias("triple_thread"))
    new_pair = asked.groupBy(*pair).agg(F.min(moment).alias("m")).select(*pair, F.col("m.request_id").alias("pair_first"))
    new_triple = asked.filter(F.col("listing_id").isNotNull()).groupBy(*pair, "listing_id").agg(F.min(moment).alias("m")).select(
        *pair, "listing_id", F.col("m.request_id").alias("triple_first"))

    def old(column: str) -> Column:
        return F.concat(F.lit("T"), F.col(column).cast("string"))

    def new(column: str) -> Column:
        return F.concat(F.lit("N"), F.col(column).cast("string"))

    with_listing = asked.filter(F.col("listing_id").isNotNull()).join(
        new_triple.join(old_triple, [*pair, "listing_id"], "left"), [*pair, "listing_id"]).select(
        "request_id", F.coalesce(old("triple_thread"), new("triple_first")).alias("thread_key"))
    without = asked.filter(F.col("listing_id").isNull()).join(new_pair.join(old_pair, pair, "left"), pair).select(
        "request_id", F.coalesce(old("pair_thread"), new("pair_first")).alias("thread_key"))
    return with_listing.unionByName(without).select(
        "request_id", "thread_key", (F.col("thread_key") == new("request_id")).alias("created"))


def message_state(t: Tables, reads: DataFrame, deletions: DataFrame) -> DataFrame:
    """Messages after openings of threads (thread_id, reader_id, read_at) and deletion requests
    (message_id, requester_id). Opening marks what the other party sent before; only the sender
    can delete."""
    sides = _viewers(t).select("thread_id", F.col("viewer_id").alias("reader_id"))
    # Only the two participants of a thread can open it, so each thread gathers at most two rows.
    last = reads.groupBy("thread_id", "reader_id").agg(F.max("read_at").alias("read_at")).join(
        sides, ["thread_id", "reader_id"], "left_semi")
    readers = last.groupBy("thread_id").agg(F.collect_list(F.struct("reader_id", "read_at")).alias("readers"))
    gone = deletions.select(F.col("message_id").alias("id"), F.col("requester_id").alias("sender_id")).distinct().withColumn("gone", F.lit(True))
    seen = F.exists(F.coalesce(F.col("readers"), F.array().cast("array<struct<reader_id:bigint,read_at:timestamp_ntz>>")),
                    lambda r: (r["reader_id"] != F.col("sender_id")) & (r["read_at"] >= F.col("sent_at")))
    return t.messages.join(gone, ["id", "sender_id"], "left").join(readers, "thread_id", "left").select(
        F.col("id").alias("message_id"), "thread_id", "sender_id",
        F.when(F.col("gone"), F.lit(DELETED_MESSAGE)).otherwise(F.col("message_text")).alias("message_text"),
        (F.col("is_read") | seen).alias("is_read"), "sent_at")


def thread_activity(t: Tables) -> DataFrame:
    """Each thread's last message time after all sends."""
    last = t.messages.groupBy("thread_id").agg(F.max("sent_at").alias("sent_at"))
    return t.threads.select(F.col("id").alias("thread_id"), "last_message_at").join(last, "thread_id", "left").select(
        "thread_id", F.coalesce(F.greatest("last_message_at", "sent_at"), F.col("last_message_at")).alias("last_message_at"))
