"""Ticketing: details, attendee lists, admission, settlement, check-in, waitlist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.ratios import money, whole_percent
from boxoffice.functions.replies import ticket_code
from boxoffice.operators.base import (
    Ids, fields_text, first_payments, key_value_map, of_registrations, positions, registration_rows, restrict, seat_counts, successful, top_per_key,
)
from boxoffice.schema import BOOKING_FEE, TICKET_PREFIX
from boxoffice.session import materialize
from boxoffice.sources.tables import Tables


def registration_counts(t: Tables, *, ids: Ids = None) -> DataFrame:
    return seat_counts(t, ids)


def answers_map(t: Tables, registrations: DataFrame | None = None) -> DataFrame:
    """Answers per registration as a map; of repeated questions the last answer wins. Of all registrations: looks up the questions (a job)."""
    answers = of_registrations(t.registration_answers, registrations, t.key)
    return key_value_map(answers, t.key, "question_key", "answer", "id", ask_fields=registrations is None)


def details_map(t: Tables) -> DataFrame:
    return key_value_map(t.listing_details, "listing_id", "field_key", "field_value", "id")


def _with_answers_and_amount(t: Tables, rows: DataFrame, all_rows: bool) -> DataFrame:
    wanted = None if all_rows else rows
    return rows.join(answers_map(t, wanted), list(t.key), "left").join(first_payments(t, wanted), list(t.key), "left")


def ticket_detail(t: Tables, *, codes: DataFrame | None = None) -> DataFrame:
    """Registration, listing, attendee, answers and the amount paid (0 when nothing was)."""
    rows = registration_rows(t, "user_id", "listing_id", "ticket_code", "status")
    rows = rows if codes is None else rows.join(codes.toDF("ticket_code").distinct(), "ticket_code", "left_semi")
    people = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"), F.col("email").alias("user_email"))
    shows = t.listings.select(F.col("id").alias("listing_id"), "title", F.col("type").alias("listing_type"), "date_start", "date_end", "venue", "city")
    return (
        _with_answers_and_amount(t, rows, codes is None).join(people, "user_id").join(shows, "listing_id").select(
            "ticket_code", "registration_id", "status", "title", "listing_type", "date_start", "date_end", "venue", "city", "user_name",
            "user_email", F.col("fields").alias("answers"), money(F.coalesce("paid_amount", F.lit(0))).alias("paid_amount"))
    )


def attendee_list(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Attendees per listing with answers and the first successful payment (NULL when none).

    Those of the given listings come newest registration first. All listings' come in no order: a global sort would
    compute everything twice, and whoever writes them sorts within listings (``files.write_attendee_csv``).
    """
    people = t.users.select(F.col("id").alias("user_id"), "name", "email")
    rows = registration_rows(t, "user_id", "listing_id", "ticket_code", "status", "created_at", ids=ids)
    found = _with_answers_and_amount(t, rows, ids is None).join(people, "user_id").select(
        "listing_id", "registration_id", "ticket_code", "status", "created_at", "user_id", "name", "email",
        F.col("fields").alias("answers"), money(F.col("paid_amount")).alias("paid_amount"))
    return found if ids is None else found.orderBy("listing_id", F.desc("created_at"), "registration_id")


def flat_answers(frame: DataFrame) -> DataFrame:
    """Answers as text, for sinks that hold no maps."""
    return frame.withColumn("answers", fields_text(F.col("answers")))


def attendee_export(t: Tables, *, ids: Ids = None) -> DataFrame:
    """The frame behind the attendee CSV: listing plus the six exported columns."""
    people = t.users.select(F.col("id").alias("user_id"), "name", "email")
    regs = registration_rows(t, "user_id", "listing_id", "ticket_code", "status", "created_at", ids=ids)
    return regs.join(first_payments(t, None if ids is None else regs), list(t.key), "left").join(people, "user_id").select(
        "listing_id", F.col("ticket_code").alias("Ticket Code"), F.col("name").alias("Name"), F.col("email").alias("Email"),
        F.col("status").alias("Status"), F.date_format("created_at", "yyyy-MM-dd").alias("Date"),
        F.col("paid_amount").cast("string").alias("Amount Paid"))


def attendee_stats(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Totals above the attendee list; every registration counts, revenue takes first payments."""
    regs = registration_rows(t, "listing_id", "status", ids=ids)
    totals = regs.join(first_payments(t, None if ids is None else regs), list(t.key), "left").groupBy("listing_id").agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "confirmed").alias("confirmed"), F.sum("paid_amount").alias("paid"))
    confirmed = F.coalesce("confirmed", F.lit(0))
    shows = restrict(t.listings.select(F.col("id").alias("listing_id"), "capacity"), "listing_id", ids)
    return shows.join(totals, "listing_id", "left").select(
        "listing_id", F.coalesce("total", F.lit(0)).alias("total"), confirmed.alias("confirmed"),
        money(F.coalesce("paid", F.lit(0))).alias("revenue"), whole_percent(confirmed, F.col("capacity")).alias("cap_pct"))


def listing_detail(t: Tables, *, ids: Ids = None) -> DataFrame:
    """Listing with creator, live registrations and its details as a map."""
    names = t.users.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    shows = restrict(t.listings.withColumnRenamed("id", "listing_id"), "listing_id", ids).select(
        "listing_id", "creator_id", "title", "type", "status", "date_start", "city")
    return (
        shows.join(seat_counts(t, ids), "listing_id", "left").join(details_map(t), "listing_id", "left").join(names, "creator_id")
        .select("listing_id", "title", "type", "status", "date_start", "city", "creator_name",
                F.coalesce("registered", F.lit(0)).alias("registered"), F.col("fields").alias("details"))
    )


def recent_checkins(t: Tables, *, limit: int = 10, ids: Ids = None) -> DataFrame:
    rows = restrict(t.registrations.filter(F.col("checked_in")), "listing_id", ids).select(
        F.col("id").alias("registration_id"), "listing_id", "user_id", "ticket_code", "checked_in_at")
    last = top_per_key(rows, ["listing_id"], [F.desc("checked_in_at"), F.asc("registration_id")], limit, "ordinal")
    people = t.users.select(F.col("id").alias("user_id"), "name")
    return last.join(people, "user_id").select(
        "listing_id", F.col("ordinal").cast("bigint").alias("ordinal"), "ticket_code", "checked_in_at", "name")


def ticket_payload(t: Tables) -> DataFrame:
    """The JSON a ticket's code carries, and a code derived from the registration id."""
    people = t.users.select(F.col("id").alias("user_id"), "name")
    shows = t.listings.select(F.col("id").alias("listing_id"), "title", "date_start")
    rows = t.registrations.select(F.col("id").alias("registration_id"), "user_id", "listing_id", "ticket_code")
    payload = F.to_json(F.struct(
        F.col("ticket_code").alias("code"), F.col("title").alias("event"), F.col("name").alias("user"),
        F.coalesce(F.date_format("date_start", "yyyy-MM-dd"), F.lit("TBD")).alias("date")))
    return rows.join(people, "user_id").join(shows, "listing_id").select(
        "registration_id", payload.alias("payload"),
        ticket_code(F.col("listing_id"), F.col("registration_id"), TICKET_PREFIX).alias("short_code"))


def admission(requests: DataFrame, listings: DataFrame, users: DataFrame, registered: DataFrame | None = None) -> DataFrame:
    """Verdict per request (id, user_id, listing_id, created_at), in order of (created_at, id).

    not_allowed: no attendee; not_found: listing not published; sold_out: seats gone before this
    request (asked before the duplicate question); duplicate: already in; else admitted.

    Only the first request of an attendee per listing can take a seat, so the listing fills with
    its n-th such request, n being its free seats. Everything after that moment is sold out.
    ``registered`` holds live registrations from before. Runs jobs while it is built.
    """
    people = users.filter(F.col("role") == "user").select(F.col("id").alias("user_id"), F.lit(True).alias("attendee"))
    shows = listings.filter(F.col("status") == "published").select(F.col("id").alias("listing_id"), "capacity")
    # Cut per pair before any join: each task sends a pair's first request only.
    pairs = requests.select("user_id", "listing_id", "created_at", "id")
    first = top_per_key(pairs, ["user_id", "listing_id"], [F.asc("created_at"), F.asc("id")], 1, "_n").drop("_n").join(
        people, "user_id", "left_semi")
    if registered is not None:
        first = first.join(registered.select("user_id", "listing_id").distinct(), ["user_id", "listing_id"], "left_anti")
        taken = registered.groupBy("listing_id").agg(F.count("*").alias("taken"))
        shows = shows.join(taken, "listing_id", "left")
    else:
        shows = shows.withColumn("taken", F.lit(0).cast("bigint"))
    # Stored, for the places and the final verdicts read them.
    first = materialize(first.select("id", "listing_id", "created_at"), "first-requests")
    limited = shows.filter(F.col("capacity") > 0).select(
        "listing_id", (F.col("capacity") - F.coalesce("taken", F.lit(0))).alias("free"))
    ranked = positions(first.join(limited, "listing_id"), ["listing_id"], [F.asc("created_at"), F.asc("id")], "place")
    filled = ranked.filter(F.col("place") == F.col("free")).select(
        "listing_id", F.col("created_at").alias("full_at"), F.col("id").alias("full_id"))
    # One row per listing, so the requests meet the listing side in a single join.
    state = shows.join(filled, "listing_id", "left").select(
        "listing_id", "full_at", "full_id",
        ((F.col("capacity") > 0) & (F.coalesce("taken", F.lit(0)) >= F.col("capacity"))).alias("full_before"))
    starters = first.select("id", F.lit(True).alias("starter"))
    out = (
        requests.select("id", "user_id", "listing_id", "created_at").join(people, "user_id", "left")
        .join(state, "listing_id", "left").join(starters, "id", "left")
    )
    after = F.struct("created_at", "id") > F.struct(F.col("full_at").alias("created_at"), F.col("full_id").alias("id"))
    gone = F.col("full_before") | (F.col("full_at").isNotNull() & after)
    verdict = (
        F.when(F.col("attendee").isNull(), "not_allowed").when(F.col("full_before").isNull(), "not_found")
        .when(gone, "sold_out").when(F.col("starter").isNull(), "duplicate").otherwise("admitted"))
    return out.select("id", "user_id", "listing_id", "created_at", verdict.alias("verdict"))


def settlement(t: Tables, attempts: DataFrame | None = None) -> DataFrame:
    """Outcome per registration. Free ones are confirmed at once; of the payment attempts the first
    is charged price plus fee, once, unless the registration was confirmed before."""
    tries = successful(t.payments) if attempts is None else attempts
    key = list(t.key) if attempts is None else ["registration_id"]
    first = tries.groupBy(*key).agg(
        F.min(F.struct("created_at", "amount", "method")).alias("f"), F.count("*").alias("attempts"))
    prices = t.listings.select(F.col("id").alias("listing_id"), "price")
    rows = registration_rows(t, "listing_id", "status", "created_at")
    rows = rows.join(first, key, "left").join(prices, "listing_id")
    due = F.col("price") + F.when(F.col("price") > 0, F.lit(BOOKING_FEE)).otherwise(F.lit(0))
    outcome = (
        F.when(F.col("status") == "confirmed", "already_confirmed").when(F.col("price") == 0, "free")
        .when(F.col("f").isNotNull(), "paid").otherwise("awaiting_payment"))
    rows = rows.withColumn("outcome", outcome)
    paid = F.col("outcome") == "paid"
    return rows.select(
        "registration_id", "outcome", money(due).alias("amount_due"),
        F.when(F.col("outcome") == "awaiting_payment", F.col("status")).otherwise("confirmed").alias("new_status"),
        money(F.when(paid, due).otherwise(F.lit(0))).alias("charged"), F.when(paid, F.col("f.method")).alias("method"),
        F.when(paid, F.col("f.created_at")).when(F.col("outcome") == "free", F.col("created_at")).alias("paid_at"))


def checkin_verdicts(t: Tables, scans: DataFrame) -> DataFrame:
    """Verdict per door scan (scan_id, scanner_id, ticket_code, listing_id, ts); the first valid scan
    of a ticket that is not yet checked in succeeds. Runs a job while it is built."""
    blank = F.col("ticket_code").isNull() | (F.col("ticket_code") == "") | F.col("listing_id").isNull()
    # Scans without a code are answered here: they would all meet in one join partition.
    missing = scans.filter(blank).select("scan_id", F.lit("missing").alias("verdict"))
    owners = t.listings.select(F.col("id").alias("listing_id"), "creator_id")
    regs = t.registrations.select(
        "ticket_code", "listing_id", F.col("id").alias("registration_id"), "status", F.col("checked_in").alias("before"))
    barred = F.coalesce(F.col("creator_id").isNull() | (F.col("creator_id") != F.col("scanner_id")), F.lit(False))
    tried = scans.filter(~blank).join(owners, "listing_id", "left").select("scan_id", "ticket_code", "listing_id", "ts", barred.alias("barred"))
    read = (
        tried.join(regs, ["ticket_code", "listing_id"], "left")
        .withColumn("verdict", F.when(F.col("barred"), "unauthorized").when(F.col("registration_id").isNull(), "invalid")
                    .when(F.col("status") != "confirmed", "status").when(F.col("before"), "already").otherwise("success"))
    )
    # Stored, for three readers would each scan, shuffle and join everything anew; only what may win is judged further.
    valid = F.col("verdict") == "success"
    read = materialize(read.select(
        "scan_id", "verdict", F.when(valid, F.col("registration_id")).alias("registration_id"), F.when(valid, F.col("ts")).alias("ts")), "scans-read")
    good = read.filter(valid)
    winners = good.groupBy("registration_id").agg(F.min(F.struct("ts", "scan_id")).alias("w")).select(
        F.col("w.scan_id").alias("scan_id"), F.lit(True).alias("wins"))
    judged = good.select("scan_id").join(winners, "scan_id", "left").select(
        "scan_id", F.when(F.col("wins"), "success").otherwise("already").alias("verdict"))
    judged = read.filter(~valid).select("scan_id", "verdict").unionByName(judged)
    return missing.unionByName(judged)


def waitlist_promotion(t: Tables) -> DataFrame:
    """Waiting people per listing in order of arrival; those within the free seats are promoted.

    This rule is this library's own: the source material promises promotion but defines none.
    Blank emails are dropped and a repeated email keeps its first place.
    """
    queue = t.waitlist.filter(F.trim("email") != "").groupBy("listing_id", F.trim("email").alias("email")).agg(
        F.min(F.struct("created_at", "id")).alias("m")).select("listing_id", "email", F.col("m.created_at").alias("created_at"), F.col("m.id").alias("id"))
    placed = positions(queue, ["listing_id"], [F.asc("created_at"), F.asc("id")], "place")
    shows = t.listings.select(F.col("id").alias("listing_id"), "capacity").join(seat_counts(t), "listing_id", "left")
    free = F.col("capacity") - F.coalesce("registered", F.lit(0))
    return placed.join(shows, "listing_id").select(
        "listing_id", "email", F.col("place").cast("bigint").alias("place"),
        ((F.col("capacity") == 0) | (F.col("place") <= free)).alias("promoted"))

