"""Marketplace tables derived from the trade and activity Parquet tables.

Customers are attendees, suppliers are creators, parts are listings, order lines are
registrations and payments, and the activity stream holds views, saves, follows and changes.
Everything is a plain projection, join or aggregate, so Catalyst prunes and pushes through it.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.schema import TICKET_PREFIX
from boxoffice.operators import engagement
from boxoffice.sources.tables import Tables

# Creator ids start here, beyond any customer key.
CREATOR_BASE = 1_000_000_000_000_000
# Message ids: room for so many turns in a conversation.
TURNS = 1 << 24
# Conversations start on one of so many ten-day steps, so that no date leaves the calendar.
START_STEPS = 300


@dataclass(frozen=True)
class Sizes:
    """How many attendees, creators and listings there are; their keys count from 0. What the activity and chat tables
    refer to is spread over all of them, so no key's share of the rows stays fixed as the data grows."""

    attendees: int
    creators: int
    listings: int


def sizes(spark: SparkSession, sf_dir: str) -> Sizes:
    """Row counts of the three tables, from the file footers."""
    return Sizes(*(max(1, spark.read.parquet(f"{sf_dir}/{n}.parquet").count()) for n in ("customer", "supplier", "part")))


def _day(start: str, days: Column) -> Column:
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(days.cast("int"))


def _plus_days(moment: Column, days: int) -> Column:
    return moment + F.make_dt_interval(F.lit(days))


def _money(column: Column) -> Column:
    return column.cast("decimal(10,2)")


def _registration_id() -> Column:
    """Order and part as text. At full scale the two keys no longer fit into one BIGINT, and a hash
    of them would collide."""
    return F.concat_ws("-", "l_orderkey", "l_partkey")


def _mix() -> Column:
    """A number per (order, part), for the rules that vary rows."""
    return F.col("l_orderkey") * 7 + F.col("l_partkey")


def _ticket_code() -> Column:
    return F.concat(F.lit(TICKET_PREFIX), F.concat_ws("-", "l_partkey", "l_orderkey"))


def _creator_of(key: Column, n: Sizes) -> Column:
    return key % n.creators + CREATOR_BASE


def _chat_day(turn: Column) -> Column:
    return _day("2001-01-01 00:00:00", F.col("conv_id") % START_STEPS * 10 + turn)


def _chat_attendee(n: Sizes) -> Column:
    return F.expr("conv_id div 3") % n.attendees


def _chat_creator(n: Sizes) -> Column:
    return _creator_of(F.expr("conv_id div 2"), n)


def activity_key(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def users(customer: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    attendees = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("id"), F.col("c_name").alias("name"),
        F.concat(F.lower("c_name"), F.lit("@example.com")).alias("email"),
        F.lit("user").alias("role"),
        _day("1995-01-01 00:00:00", key * 13 % 2404).alias("created_at"),
        (F.col("c_acctbal") < 0).alias("is_banned"), F.col("n_name").alias("city"),
        F.lower("c_mktsegment").alias("preferences"), F.lit(None).cast("string").alias("organization_name"),
    )
    key = F.col("s_suppkey")
    creators = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        (key + CREATOR_BASE).alias("id"), F.col("s_name").alias("name"),
        F.concat(F.lower("s_name"), F.lit("@example.com")).alias("email"),
        F.lit("creator").alias("role"),
        _day("1995-01-01 00:00:00", key * 37 % 2404).alias("created_at"),
        F.lit(False).alias("is_banned"), F.col("n_name").alias("city"),
        F.when(key % 3 > 0, F.lit("promo,large")).alias("preferences"),
        F.when(key % 4 == 0, F.lit("")).when(key % 4 > 1, F.concat("s_name", F.lit(" Org"))).alias("organization_name"),
    )
    return attendees.unionByName(creators)


def listings(part: DataFrame, supplier: DataFrame, nation: DataFrame) -> DataFrame:
    key = F.col("p_partkey")
    owner = F.expr("p_partkey div 20")
    start = _day("1996-01-01 18:00:00", key * 11 % 2500)
    end = _day("1996-01-01 21:00:00", key * 11 % 2500 + key % 3)
    city = (
        F.when(key % 11 == 0, F.lit(None)).when(key % 13 == 0, F.lit(""))
        .when(key % 17 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    )
    status = (
        F.when(key % 10 == 0, "draft").when(key % 10 == 1, "cancelled").when(key % 10 == 2, "ended")
        .otherwise("published")
    )
    return (
        part.join(supplier, owner == F.col("s_suppkey"))
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            key.alias("id"), (owner + CREATOR_BASE).alias("creator_id"), F.col("p_name").alias("title"),
            F.lower("p_type").alias("type"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("description"),
            start.alias("date_start"), F.when(key % 5 > 0, end).alias("date_end"),
            F.when(key % 3 > 0, F.col("p_brand")).alias("venue"), city.alias("city"),
            F.when(key % 7 == 0, F.lit(0)).otherwise(F.col("p_size")).alias("capacity"),
            F.when(key % 4 == 0, _money(F.lit(0))).otherwise(_money(F.col("p_retailprice"))).alias("price"),
            status.alias("status"), _day("1995-01-01 00:00:00", key * 3 % 2300).alias("created_at"),
        )
    )


def registrations(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """One registration per (order, part). Lines are folded before the join, so repeated lines
    of a hot order never travel; the flag's character code keeps that aggregation hash-based."""
    lines = lineitem.groupBy("l_orderkey", "l_partkey").agg(F.max(F.ascii("l_returnflag")).alias("flag"))
    cancelled, pending, confirmed = (F.col("flag") == ord(c) for c in "ANR")
    checked = confirmed & (F.col("l_orderkey") % 3 == 0)
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        _registration_id().alias("id"), F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("listing_id"),
        _ticket_code().alias("ticket_code"),
        F.when(cancelled, "cancelled").when(pending, "pending").otherwise("confirmed").alias("status"),
        checked.alias("checked_in"), F.when(checked, _plus_days(F.col("o_orderdate"), 1)).alias("checked_in_at"),
        F.col("o_orderdate").alias("created_at"),
    )


def payments(lineitem: DataFrame) -> DataFrame:
    line = F.col("l_linenumber") % 3
    flag = F.col("l_returnflag")
    return lineitem.select(
        _registration_id().alias("registration_id"), _money(F.col("l_extendedprice")).alias("amount"),
        F.when(line == 0, "upi").when(line == 1, "card").otherwise("netbanking").alias("method"),
        F.when(F.col("l_linestatus") == "F", "success").when(flag == "A", "refunded").when(flag == "N", "pending")
        .otherwise("failed").alias("status"),
        F.col("l_shipdate").alias("created_at"),
    )


def reviews(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    lines = lineitem.filter((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("listing_id"), F.col("o_custkey").alias("user_id"),
        (F.lit(1) + F.col("l_quantity") % 5).cast("int").alias("rating"),
        F.concat(F.lit("review of "), F.col("l_partkey").cast("string")).alias("review_text"),
        F.col("l_shipdate").alias("created_at"),
    )


def review_forms(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Review submissions as typed into the form: unchecked text."""
    quantity = F.col("l_quantity").cast("int")
    return lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_partkey").alias("listing_id"), F.col("o_custkey").alias("user_id"),
        F.when(quantity % 11 == 0, "great").when(quantity % 13 == 0, F.lit(None))
        .otherwise((quantity % 8).cast("string")).alias("rating"),
        F.concat(F.lit("  review "), F.col("l_partkey").cast("string"), F.lit(" ")).alias("review_text"),
        F.col("l_shipdate").alias("created_at"),
    )


def listing_forms(part: DataFrame) -> DataFrame:
    """Listing submissions as typed into the form: blanks and missing dates occur."""
    key = F.col("p_partkey")
    return part.select(
        key.alias("form_id"),
        F.when(key % 19 == 0, "   ").otherwise(F.concat(F.lit(" "), F.col("p_name"))).alias("title"),
        F.when(key % 23 == 0, "").otherwise(F.lower("p_type")).alias("type"),
        F.when(key % 29 > 0, F.concat(F.lit("2001-0"), (key % 9 + 1).cast("string"), F.lit("-15T18:00"))).alias("date_start"),
        F.concat_ws(" ", "p_brand", "p_name").alias("description"),
    )


def booking_forms(lineitem: DataFrame) -> DataFrame:
    """Registration forms: phone and quantity as typed."""
    order, part = F.col("l_orderkey"), F.col("l_partkey")
    digits = F.lpad(((order * 7919 + part) % 10000000000).cast("string"), 10, "0")
    lines = lineitem.groupBy(order, part).agg(F.max("l_quantity").alias("quantity"))
    return lines.select(
        _registration_id().alias("registration_id"), part.alias("listing_id"),
        F.when(order % 31 == 0, F.concat(F.lit("+"), digits)).when(order % 37 == 0, F.lit("")).otherwise(digits).alias("phone"),
        (F.col("quantity").cast("int") % 8).cast("string").alias("qty"),
    )


def save_toggles(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "click").select(
        "event_id", "user_id", activity_key(F.col("props")).alias("listing_id"), "ts")


def follow_toggles(events: DataFrame, n: Sizes) -> DataFrame:
    return events.filter(F.col("event_type") == "signup").select(
        "event_id", F.col("user_id").alias("follower_id"),
        _creator_of(F.col("user_id") * 13 + activity_key(F.col("props")), n).alias("creator_id"), "ts")


def view_hits(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "view").select(
        "event_id", activity_key(F.col("props")).alias("listing_id"), "ts")


def status_log(events: DataFrame, n: Sizes) -> DataFrame:
    turn = F.col("event_id") % 3
    return events.filter(F.col("event_type") == "error").select(
        "event_id", ((F.col("event_id") * 31 + activity_key(F.col("props"))) % n.listings).alias("listing_id"),
        F.when(turn == 0, "published").when(turn == 1, "cancelled").otherwise("draft").alias("status"), "ts")


def ban_log(events: DataFrame) -> DataFrame:
    turn = F.col("event_id") % 7
    return events.filter(F.col("event_type") == "error").select(
        "event_id", "user_id",
        F.when(turn == 0, "ban").when(turn == 1, "unban").otherwise("toggle").alias("action"), "ts")


def setting_log(events: DataFrame) -> DataFrame:
    """Setting changes, one scope per user."""
    key = activity_key(F.col("props"))
    name = (
        F.when(key % 4 == 0, "max_tickets_per_user").when(key % 4 == 1, "maintenance_mode")
        .when(key % 4 == 2, "tagline").otherwise("support_email")
    )
    return events.filter(F.col("event_type") == "purchase").select(
        "event_id", F.col("user_id").alias("scope_id"), name.alias("setting_key"),
        F.concat(F.lit("v"), key.cast("string")).alias("setting_value"), "ts")


def notifications(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "error").select(
        F.col("event_id").alias("id"), "user_id",
        F.concat(F.lit("listing "), activity_key(F.col("props")).cast("string")).alias("message"),
        F.lit(None).cast("string").alias("link"), (F.col("event_id") % 2 == 0).alias("is_read"),
        F.col("ts").alias("created_at"))


def thread_requests(events: DataFrame, n: Sizes) -> DataFrame:
    key = F.col("user_id") * 13 + activity_key(F.col("props"))
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("event_id").alias("request_id"), "user_id", _creator_of(key, n).alias("creator_id"),
        F.when(F.col("event_id") % 3 > 0, key % n.listings).alias("listing_id"), "ts")


def _tried(lineitem: DataFrame) -> DataFrame:
    """Every attempt at the door in numbers; some are repeated an hour later."""
    again = F.explode(F.when(_mix() % 5 == 0, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("line"), F.col("l_shipdate").alias("shipped"),
                           F.col("l_quantity").cast("int").alias("quantity"), again.alias("again")).select(
        "l_orderkey", "l_partkey", "line", (F.col("shipped") + F.make_dt_interval(F.lit(0), F.col("again"))).alias("ts"), "quantity")


def _scanned(tried: DataFrame, owners: DataFrame) -> DataFrame:
    """Attempts as scans: some without a code, at the wrong listing or by the wrong creator."""
    scan_id = F.concat_ws("/", _registration_id(), F.col("line"), F.date_format("ts", "yyyyMMddHH"), F.col("quantity"))
    return tried.join(owners, F.col("l_partkey") == F.col("part")).select(
        scan_id.alias("scan_id"), F.when(_mix() % 50 == 0, F.col("owner") + 1).otherwise(F.col("owner")).alias("scanner_id"),
        F.when(_mix() % 97 > 0, _ticket_code()).alias("ticket_code"),
        F.when(F.col("line") == 7, F.col("part") + 1).otherwise(F.col("part")).alias("listing_id"), "ts")


def _owners(listing_frame: DataFrame) -> DataFrame:
    return listing_frame.select(F.col("id").alias("part"), F.col("creator_id").alias("owner"))


def scan_rows(lineitem: DataFrame, listing_frame: DataFrame) -> DataFrame:
    """Door scans, one or two per order line."""
    return _scanned(_tried(lineitem), _owners(listing_frame))


def scans(lineitem: DataFrame, listing_frame: DataFrame) -> DataFrame:
    """Doubled order lines may repeat a scan exactly; it counts as one.

    Repeats are found among the numbers, before any text is made of them: these tell scans apart where all are there. Where
    one is missing, two attempts may give the same text, and the scans themselves are compared.
    """
    there = F.col("l_linenumber").isNotNull() & F.col("l_shipdate").isNotNull() & F.col("l_quantity").isNotNull()
    owners = _owners(listing_frame).distinct()
    whole, partly = (_scanned(_tried(lineitem.filter(f)).distinct(), owners) for f in (there, ~there))
    return whole.unionByName(partly.distinct())


def threads(conversations: DataFrame, n: Sizes) -> DataFrame:
    conv = F.col("conv_id")
    return conversations.groupBy("conv_id").agg(F.max("turn").alias("last_turn")).select(
        conv.alias("id"), _chat_attendee(n).alias("user_id"), _chat_creator(n).alias("creator_id"),
        F.when(conv % 4 > 0, conv % n.listings).alias("listing_id"), _chat_day(F.col("last_turn")).alias("last_message_at"))


def message_id(conversation: Column, turn: Column | int) -> Column:
    return conversation * TURNS + turn


def messages(conversations: DataFrame, n: Sizes) -> DataFrame:
    conv, turn = F.col("conv_id"), F.col("turn")
    return conversations.filter(F.col("role") != "system").select(
        message_id(conv, turn).alias("id"), conv.alias("thread_id"),
        F.when(F.col("role") == "assistant", _chat_creator(n)).otherwise(_chat_attendee(n)).alias("sender_id"),
        F.col("text").alias("message_text"), (turn % 3 != 0).alias("is_read"), _chat_day(turn).alias("sent_at"))


def read_log(conversations: DataFrame, n: Sizes) -> DataFrame:
    """Thread openings: even threads by the attendee, odd ones by the creator, at the second turn."""
    conv = F.col("conv_id")
    return conversations.filter(F.col("turn") == 2).select(
        conv.alias("thread_id"), F.when(conv % 2 == 0, _chat_attendee(n)).otherwise(_chat_creator(n)).alias("reader_id"),
        _chat_day(F.col("turn")).alias("read_at"))


def delete_log(conversations: DataFrame, n: Sizes) -> DataFrame:
    """Deletion requests for the second message of a thread, some by the wrong party."""
    conv = F.col("conv_id")
    return conversations.filter((F.col("turn") == 1) & (conv % 5 < 2)).select(
        message_id(conv, 1).alias("message_id"), F.when(conv % 5 == 0, _chat_creator(n)).otherwise(_chat_attendee(n)).alias("requester_id"))


def waitlist(registration_frame: DataFrame, user_frame: DataFrame) -> DataFrame:
    waiting = registration_frame.filter((F.col("status") == "pending") & ((F.col("user_id") * 7 + F.col("listing_id")) % 9 == 0))
    people = user_frame.select(F.col("id").alias("user_id"), "email")
    return waiting.join(people, "user_id").select("id", "listing_id", "email", "created_at")


def registration_log(lineitem: DataFrame) -> DataFrame:
    """The states a registration went through, one per order line."""
    flag, line = F.col("l_returnflag"), F.col("l_linenumber")
    return lineitem.select(
        _registration_id().alias("id"), F.when(flag == "A", "cancelled").when(flag == "N", "pending").otherwise("confirmed").alias("status"),
        F.col("l_shipdate").alias("ts"), (line * 1000 + F.ascii(flag)).cast("bigint").alias("seq"))


def payment_log(lineitem: DataFrame) -> DataFrame:
    """The states of a registration's payment, one per order line: refunded ones no longer count."""
    rows = payments(lineitem.withColumn("l_shipdate", F.struct("l_shipdate", "l_linenumber")))
    rank = F.when(F.col("status") == "success", 1).otherwise(0)
    return rows.select(
        F.col("registration_id").alias("id"), "status", "amount", F.col("created_at.l_shipdate").alias("ts"),
        ((F.col("created_at.l_linenumber").cast("bigint") * 10 + rank) * 1000000000 + (F.col("amount") * 100).cast("bigint")).alias("seq"))


def seat_events(registration_frame: DataFrame) -> DataFrame:
    """Every registration asks for a seat; cancelled ones give one up some days later."""
    later = (F.col("user_id") * 7 + F.col("listing_id")) % 90
    freed = F.struct(F.concat("id", F.lit("/off")).alias("id"), F.lit("release").alias("kind"),
                     (F.col("created_at") + F.make_dt_interval((later + 1).cast("int"))).alias("ts"))
    asked = F.struct(F.col("id").alias("id"), F.lit("request").alias("kind"), F.col("created_at").alias("ts"))
    both = F.when(F.col("status") == "cancelled", F.array(asked, freed)).otherwise(F.array(asked))
    return registration_frame.select("listing_id", F.inline(both)).select("id", "listing_id", "kind", "ts")


def listing_details(part: DataFrame) -> DataFrame:
    return part.select(
        F.col("p_partkey").alias("listing_id"),
        F.inline(F.array(
            F.struct((F.col("p_partkey") * 2).alias("id"), F.lit("brand").alias("field_key"), F.col("p_brand").alias("field_value")),
            F.struct((F.col("p_partkey") * 2 + 1).alias("id"), F.lit("size").alias("field_key"), F.col("p_size").cast("string").alias("field_value")),
        )),
    ).select("id", "listing_id", "field_key", "field_value")


def registration_answers(lineitem: DataFrame) -> DataFrame:
    line = F.col("l_linenumber").cast("bigint")
    return lineitem.select(
        _registration_id().alias("registration_id"),
        F.inline(F.array(
            F.struct(line.alias("id"), F.lit("qty").alias("question_key"), F.col("l_quantity").cast("int").cast("string").alias("answer")),
            F.struct(line.alias("id"), F.lit("flag").alias("question_key"), F.col("l_returnflag").alias("answer")),
        )),
    ).select("id", "registration_id", "question_key", "answer")


def listing_edits(lineitem: DataFrame) -> DataFrame:
    """Edits of a listing: a full set of fields, sometimes without a banner."""
    order = F.col("l_orderkey")
    lines = lineitem.groupBy("l_orderkey", "l_partkey").agg(
        F.max("l_shipdate").alias("ts"), F.max("l_quantity").alias("quantity"),
        F.max(_money(F.col("l_extendedprice"))).alias("price"))
    return lines.select(
        _registration_id().alias("edit_id"), F.col("l_partkey").alias("listing_id"), "ts",
        F.concat(F.lit("edit "), order.cast("string")).alias("title"), F.element_at(
            F.array(*map(F.lit, ("economy", "large", "promo"))), (order % 3 + 1).cast("int")).alias("type"),
        F.when(order % 7 > 0, F.concat(F.lit("about "), order.cast("string"))).alias("description"),
        (F.col("ts") + F.make_dt_interval(F.lit(30))).alias("date_start"),
        F.when(order % 5 > 0, F.col("ts") + F.make_dt_interval(F.lit(31))).alias("date_end"),
        F.when(order % 2 == 0, F.concat(F.lit("hall "), (order % 40).cast("string"))).alias("venue"),
        F.when(order % 11 > 0, F.concat(F.lit("city "), (order % 90).cast("string"))).alias("city"),
        F.col("quantity").cast("int").alias("capacity"), "price",
        F.when(order % 3 > 0, F.concat(F.lit("banner-"), order.cast("string"))).alias("banner"))


def listing_edit_details(lineitem: DataFrame) -> DataFrame:
    edits = listing_edits(lineitem)
    return edits.select(
        "edit_id", "listing_id",
        F.explode(F.when(F.col("capacity") % 2 == 0, F.array(F.lit("brand"), F.lit("size"))).otherwise(F.array(F.lit("size")))).alias("field_key"),
        F.col("capacity").cast("string").alias("field_value"))


def profile_edits(orders: DataFrame, part: DataFrame) -> DataFrame:
    """Profile forms of attendees (one per order) and creators (one per part)."""
    order, key = F.col("o_orderkey"), F.col("p_partkey")
    nothing = F.lit(None).cast("string")
    attendees = orders.select(
        order.alias("edit_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").alias("ts"),
        F.concat(F.lit("name "), order.cast("string")).alias("name"), F.lpad(order.cast("string"), 10, "5").alias("phone"),
        F.col("o_orderpriority").alias("bio"), F.concat(F.lit("org "), order.cast("string")).alias("organization_name"),
        nothing.alias("website_url"),
        F.concat(F.lit("city "), F.col("o_orderstatus")).alias("city"), F.lit("promo,small").alias("preferences"),
        F.when(order % 5 == 0, F.concat(F.lit("avatar-"), order.cast("string"))).alias("avatar"))
    creators = part.select(
        key.alias("edit_id"), (F.expr("p_partkey div 20") + CREATOR_BASE).alias("user_id"),
        _day("1995-01-01 00:00:00", key * 3 % 2300).alias("ts"), F.col("p_name").alias("name"),
        F.lpad(key.cast("string"), 10, "6").alias("phone"), F.col("p_brand").alias("bio"),
        F.concat(F.lit("org "), key.cast("string")).alias("organization_name"),
        F.when(key % 3 > 0, F.concat(F.lit(" https://example.com/"), key.cast("string"))).alias("website_url"), F.lit("nowhere").alias("city"),
        F.lower("p_type").alias("preferences"), nothing.alias("avatar"))
    return attendees.unionByName(creators)


def model_replies(labels: DataFrame) -> DataFrame:
    turn = F.col("doc_id") % 10
    word = F.when(F.col("toxic") == 1, "Flagged").when(F.col("quality") == 0, "Warning").otherwise("Safe")
    doc = F.col("doc_id").cast("string")
    return labels.select(
        "doc_id",
        F.when(turn == 0, "no object here").when(turn == 1, "{bad").when(turn == 2, "so {bad} it is")
        .when(turn == 3, F.concat(F.lit('{"reason": "only a reason '), doc, F.lit('"}')))
        .when(turn == 4, '{"status": "Safe"} and {"status": "Flagged"}')
        .otherwise(F.concat(F.lit('Sure! {"status": "'), word, F.lit('",\n "price": '), doc, F.lit("}\ndone"))).alias("reply"))


def reply_log(labels: DataFrame, n: Sizes) -> DataFrame:
    return model_replies(labels).select(
        (F.col("doc_id") % n.attendees).alias("user_id"), F.concat(F.lit("review "), F.col("doc_id").cast("string")).alias("prompt"),
        F.col("reply").alias("response"), F.lit("text-model").alias("model_used"), F.lit("2001-08-01 12:00:00").cast("timestamp_ntz").alias("created_at"))


def listing_views(hits: DataFrame) -> DataFrame:
    return hits.groupBy("listing_id", F.to_date("ts").alias("date")).agg(F.count("*").alias("views"))


def search_replies(orders: DataFrame, lineitem: DataFrame, listing_frame: DataFrame) -> DataFrame:
    """One free-text reply with search filters per order, about the first of the order's listings."""
    first = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_partkey").alias("listing_id"))
    wanted = listing_frame.select(F.col("id").alias("listing_id"), "type", "city")
    order = F.col("o_orderkey")
    return orders.select("o_orderkey").join(first.join(wanted, "listing_id"), "o_orderkey", "left").select(
        order.alias("request_id"),
        F.when(order % 17 == 0, "nothing to see").otherwise(F.concat(
            F.lit('Filters: {"type": "'), F.when(order % 3 > 0, F.coalesce("type", F.lit(""))).otherwise(""),
            F.lit('", "city": "'), F.when(order % 2 == 0, F.coalesce("city", F.lit(""))).otherwise(""),
            F.lit('", "price_range": "'), F.when(order % 5 == 0, "Free").otherwise("cheap"), F.lit('"}'))).alias("reply"))


def from_trade_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """All marketplace tables over a folder that holds the trade and activity Parquet tables."""
    raw: dict[str, DataFrame] = {}

    def read(name: str) -> DataFrame:
        if name not in raw:
            raw[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return raw[name]

    line, order, event = (lambda: read("lineitem")), (lambda: read("orders")), (lambda: read("events"))
    talk, part = (lambda: read("conversations")), (lambda: read("part"))
    counted = cache(lambda: sizes(spark, sf_dir))
    makers = {
        "users": lambda: users(read("customer"), read("supplier"), read("nation")),
        "listings": lambda: listings(part(), read("supplier"), read("nation")),
        "registrations": lambda: registrations(line(), order()),
        "payments": lambda: payments(line()),
        "reviews": lambda: reviews(line(), order()),
        "review_forms": lambda: review_forms(line(), order()),
        "listing_forms": lambda: listing_forms(part()),
        "booking_forms": lambda: booking_forms(line()),
        "save_toggles": lambda: save_toggles(event()),
        "follow_toggles": lambda: follow_toggles(event(), counted()),
        "view_hits": lambda: view_hits(event()),
        "status_log": lambda: status_log(event(), counted()),
        "ban_log": lambda: ban_log(event()),
        "setting_log": lambda: setting_log(event()),
        "notifications": lambda: notifications(event()),
        "thread_requests": lambda: thread_requests(event(), counted()),
        "scans": lambda: scans(line(), tables.listings),
        "threads": lambda: threads(talk(), counted()),
        "messages": lambda: messages(talk(), counted()),
        "read_log": lambda: read_log(talk(), counted()),
        "delete_log": lambda: delete_log(talk(), counted()),
        "waitlist": lambda: waitlist(tables.registrations, tables.users),
        "registration_log": lambda: registration_log(line()),
        "payment_log": lambda: payment_log(line()),
        "seat_events": lambda: seat_events(tables.registrations),
        "listing_details": lambda: listing_details(part()),
        "registration_answers": lambda: registration_answers(line()),
        "listing_edits": lambda: listing_edits(line()),
        "listing_edit_details": lambda: listing_edit_details(line()),
        "profile_edits": lambda: profile_edits(order(), part()),
        "model_replies": lambda: model_replies(read("labels")),
        "reply_log": lambda: reply_log(read("labels"), counted()),
        "listing_views": lambda: listing_views(tables.view_hits),
        "search_replies": lambda: search_replies(order(), line(), tables.listings),
        "saves": lambda: engagement.save_state(tables.save_toggles),
        "follows": lambda: engagement.follow_state(tables.follow_toggles),
    }
    tables = Tables(spark, makers)
    return tables
