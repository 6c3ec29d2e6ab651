"""Catalogue search, admin searches, lookups and batches of search requests."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.functions.ratios import shown, whole_percent
from boxoffice.functions.replies import field_or, with_fields
from boxoffice.functions.text import first_filled, folded, has_text, label, shortened
from boxoffice.functions.times import countdown, ntz
from boxoffice.operators.base import live, seat_counts, top_per_key
from boxoffice.schema import CURRENCY, PAGE_ADMIN, PAGE_CATALOGUE
from boxoffice.session import materialize
from boxoffice.sources.tables import Tables
from boxoffice.sources.textindex import TextIndex

SORTS = {
    "newest": lambda: [F.desc("created_at"), F.asc("listing_id")],
    "soonest": lambda: [F.asc("date_start"), F.asc("listing_id")],
    "price_low": lambda: [F.asc("price"), F.asc("listing_id")],
    "price_high": lambda: [F.desc("price"), F.asc("listing_id")],
}


@dataclass(frozen=True)
class ListingFilter:
    """Optional catalogue filters; empty ones do not apply."""

    types: Sequence[str] = field(default_factory=tuple)
    city: str = ""
    search: str = ""
    date_from: str = ""
    date_to: str = ""
    price: str = ""
    sort: str = "newest"
    wildcards: bool = False

    def predicates(self) -> list[Column]:
        found = [F.col("status") == "published"]
        if self.types:
            found.append(F.col("type").isin(*([self.types] if isinstance(self.types, str) else self.types)))
        if self.city:
            found.append(has_text(F.col("city"), self.city, wildcards=self.wildcards))
        if self.search:
            # An absent city or description does not hide a hit in another column.
            hits = [F.coalesce(has_text(F.col(c), self.search, wildcards=self.wildcards), F.lit(False))
                    for c in ("title", "city", "description")]
            found.append(hits[0] | hits[1] | hits[2])
        if self.date_from:
            found.append(F.col("date_start") >= ntz(self.date_from))
        if self.date_to:
            # A bare date means its midnight: later that day is outside.
            found.append(F.col("date_start") <= ntz(self.date_to))
        if self.price == "free":
            found.append(F.col("price") == 0)
        elif self.price == "paid":
            found.append(F.col("price") > 0)
        return found


LISTING_TEXTS = ("title", "city", "description")


def matching(t: Tables, wanted: ListingFilter, index: TextIndex | None = None) -> DataFrame:
    """The listings that pass the filter; an index over ``LISTING_TEXTS`` narrows them first."""
    rows = t.listings
    if index is not None and not wanted.wildcards:
        rows = index.narrowed(rows, "id", ("city",), wanted.city)
        rows = index.narrowed(rows, "id", LISTING_TEXTS, wanted.search)
    return rows.filter(reduce(and_, wanted.predicates())).withColumnRenamed("id", "listing_id")


def catalogue_matches(t: Tables, wanted: ListingFilter, index: TextIndex | None = None) -> DataFrame:
    """All matching listings without paging, with creator and seat counts."""
    rows = matching(t, wanted, index)
    seats = seat_counts(t) if index is None else seat_counts(t, rows.select("listing_id"))
    return _with_names_and_seats(t, rows, seats)


def _with_names_and_seats(t: Tables, rows: DataFrame, seats: DataFrame) -> DataFrame:
    names = t.users.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    return (
        rows.select("listing_id", "creator_id", "title", "type", "city", "date_start", "price", "capacity", "created_at")
        .join(seats, "listing_id", "left").join(names, "creator_id").select(
            "listing_id", "title", "type", "city", "date_start", F.col("price").cast("double").alias("price"),
            F.col("capacity").cast("bigint").alias("capacity"), "creator_name",
            F.coalesce("registered", F.lit(0)).alias("registered"), "created_at")
    )


def catalogue_search(t: Tables, wanted: ListingFilter, *, page: int = 1, per_page: int = PAGE_CATALOGUE) -> DataFrame:
    """One page. The page is cut first, so only its few rows meet users and registrations."""
    order = SORTS.get(wanted.sort, SORTS["newest"])()
    rows = matching(t, wanted).orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    on_page = F.broadcast(rows.select("listing_id"))  # at most ``per_page`` rows
    seats = live(t.registrations).select("listing_id").join(on_page, "listing_id", "left_semi").groupBy("listing_id").agg(
        F.count("*").alias("registered"))
    names = t.users.select(F.col("id").alias("creator_id"), "name")
    page_rows = F.broadcast(rows.select("listing_id", "creator_id", "title", "type", "city", "date_start", "price", "capacity", "created_at"))
    named = names.join(page_rows, "creator_id")  # unique user ids: still one page
    return named.join(seats, "listing_id", "left").select(
        "listing_id", "title", "type", "city", "date_start", F.col("price").cast("double").alias("price"),
        F.col("capacity").cast("bigint").alias("capacity"), F.col("name").alias("creator_name"),
        F.coalesce("registered", F.lit(0)).alias("registered"), "created_at").orderBy(*order)


def search_page_counts(t: Tables, wanted: ListingFilter, *, per_page: int = PAGE_CATALOGUE) -> DataFrame:
    return _page_counts(matching(t, wanted), per_page)


def _page_counts(rows: DataFrame, per_page: int) -> DataFrame:
    return rows.agg(F.count("*").alias("total")).select(
        "total", F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint").alias("total_pages"))


USER_TEXTS = ("name", "email")


def _searched_users(t: Tables, search: str, role: str, index: TextIndex | None = None) -> DataFrame:
    people = t.users if index is None else index.narrowed(t.users, "id", USER_TEXTS, search)
    if search:
        people = people.filter(has_text(F.col("name"), search) | has_text(F.col("email"), search))
    kinds = {"users": F.col("role") == "user", "creators": F.col("role") == "creator", "banned": F.col("is_banned")}
    return people.filter(kinds[role]) if role in kinds else people


def user_search(t: Tables, *, search: str = "", role: str = "all", page: int = 1, per_page: int = PAGE_ADMIN,
                index: TextIndex | None = None) -> DataFrame:
    """One page; an index over ``USER_TEXTS`` narrows the people first."""
    rows = _searched_users(t, search, role, index).withColumnRenamed("id", "user_id").select(
        "user_id", "name", "email", "role", "is_banned", "created_at")
    order = [F.desc("created_at"), F.asc("user_id")]
    rows = rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    on_page = F.broadcast(rows.select("user_id"))  # at most ``per_page`` rows
    counts = live(t.registrations).select("user_id").join(on_page, "user_id", "left_semi").groupBy("user_id").agg(
        F.count("*").alias("total_regs"))
    return rows.join(counts, "user_id", "left").withColumn("total_regs", F.coalesce("total_regs", F.lit(0))).orderBy(*order)


def user_search_counts(t: Tables, *, search: str = "", role: str = "all", per_page: int = PAGE_ADMIN) -> DataFrame:
    return _page_counts(_searched_users(t, search, role), per_page)


def _with_user_names(t: Tables) -> DataFrame:
    people = t.users.select(F.col("id").alias("user_id"), F.col("name").alias("user_name"))
    return t.registrations.select(
        F.col("id").alias("registration_id"), "user_id", "listing_id", "ticket_code", "status", "created_at").join(people, "user_id")


def _with_titles(t: Tables, rows: DataFrame) -> DataFrame:
    shows = t.listings.select(F.col("id").alias("listing_id"), F.col("title").alias("listing_title"))
    return shows.join(rows, "listing_id").select(
        "registration_id", "ticket_code", "status", "created_at", "listing_title", "user_name")


def registration_ledger(t: Tables) -> DataFrame:
    """Every registration with attendee and listing names, newest first."""
    return _with_titles(t, _with_user_names(t)).orderBy(F.desc("created_at"), "registration_id")


def registrations_narrowed(t: Tables, search: str, codes: TextIndex, people: TextIndex) -> DataFrame:
    """Registrations whose ticket code, or whose attendee's name, may contain the needle; from an index over ticket codes
    (by registration id) and one over ``USER_TEXTS``."""
    by_code, by_name = codes.candidates("ticket_code", search), people.candidates("name", search)
    if by_code is None or by_name is None:
        return t.registrations
    named = t.registrations.select("id", "user_id").join(by_name[0].toDF("user_id").distinct(), "user_id", "left_semi").select("id")
    return t.registrations.join(by_code[0].toDF("id").unionByName(named).distinct(), "id", "left_semi")


def _searched_registrations(t: Tables, search: str, status: str) -> DataFrame:
    rows = _with_user_names(t)
    if search:
        rows = rows.filter(has_text(F.col("ticket_code"), search) | has_text(F.col("user_name"), search))
    return rows.filter(F.col("status") == status) if status != "all" else rows


def registration_search(t: Tables, *, search: str = "", status: str = "all", page: int = 1, per_page: int = PAGE_ADMIN,
                        indexes: tuple[TextIndex, TextIndex] | None = None) -> DataFrame:
    """One page; listing titles (every registration has its listing) are looked up for the page only. ``indexes``: see
    ``registrations_narrowed``."""
    if indexes is not None and search:
        t = t.replaced(registrations=registrations_narrowed(t, search, *indexes))
    order = [F.desc("created_at"), F.asc("registration_id")]
    rows = _searched_registrations(t, search, status).orderBy(*order).offset((page - 1) * per_page).limit(per_page)
    return _with_titles(t, F.broadcast(rows)).orderBy(*order)  # at most ``per_page`` rows


def registration_search_counts(t: Tables, *, search: str = "", status: str = "all", per_page: int = PAGE_ADMIN) -> DataFrame:
    return _page_counts(_searched_registrations(t, search, status), per_page)


def similar_listings(t: Tables, *, limit: int = 3) -> DataFrame:
    """For every listing the soonest other published listings of its type.

    One more than ``limit`` candidates per type always suffice, since only the listing itself can
    drop out. They are gathered per type, so each listing meets one short array.
    """
    shows = t.listings.withColumnRenamed("id", "listing_id")
    soon = top_per_key(
        shows.filter(F.col("status") == "published").select("type", "listing_id", "title", "date_start", "creator_id"),
        ["type"], [F.asc("date_start"), F.asc("listing_id")], limit + 1, "rank")
    names = t.users.select(F.col("id").alias("creator_id"), F.col("name").alias("creator_name"))
    # limit + 1 rows for each value of the enumerated listing type.
    soon = names.join(F.broadcast(soon), "creator_id")
    entry = F.struct("rank", F.col("listing_id").alias("id"), "title", "date_start", "creator_name")
    per_type = soon.groupBy("type").agg(F.array_sort(F.collect_list(entry)).alias("near"))
    others = F.slice(F.filter(F.col("near"), lambda c: c["id"] != F.col("listing_id")), 1, limit)
    return (
        shows.select("listing_id", "type").join(F.broadcast(per_type), "type")
        .select("listing_id", F.posexplode(others).alias("pos", "c"))
        .select("listing_id", (F.col("pos") + 1).cast("bigint").alias("ordinal"), F.col("c.id").alias("similar_id"),
                F.col("c.title").alias("title"), F.col("c.date_start").alias("date_start"), F.col("c.creator_name").alias("creator_name"))
    )


def keyed_lookup(frame: DataFrame, column: str, keys: DataFrame, *, tolerant: bool = False) -> DataFrame:
    """Rows whose ``column`` occurs in the one-column ``keys``; the sides' measured sizes decide the
    join strategy. ``tolerant`` ignores case, accents and trailing spaces."""
    wanted = keys.toDF("_key").distinct()
    if tolerant:
        return frame.join(wanted, folded(F.col(column)) == folded(F.col("_key")), "left_semi")
    return frame.join(wanted, F.col(column) == F.col("_key"), "left_semi")


def registered_already(t: Tables, pairs: DataFrame) -> DataFrame:
    """For (user_id, listing_id) pairs: the first live registration, if there is one."""
    taken = live(t.registrations).groupBy("user_id", "listing_id").agg(F.min(F.struct("id", "ticket_code")).alias("first"))
    return pairs.join(taken, ["user_id", "listing_id"], "left").select(
        "user_id", "listing_id", F.col("first").isNotNull().alias("registered"), F.col("first.ticket_code").alias("ticket_code"))


def user_directory(t: Tables) -> DataFrame:
    return t.users.select(F.col("id").alias("user_id"), "name", "email", "role", "created_at", "is_banned").orderBy(
        F.desc("created_at"), "user_id")


def listing_card(t: Tables, *, as_of: datetime) -> DataFrame:
    """Display values of every published listing."""
    shows = t.listings.filter(F.col("status") == "published")
    return shows.select(
        F.col("id").alias("listing_id"), shortened(F.col("title"), 15).alias("short_title"), label(F.col("type")).alias("type_label"),
        first_filled(F.col("city"), F.col("venue"), F.lit("Online")).alias("place"),
        F.coalesce(F.date_format("date_start", "MMM dd, yyyy hh:mm a"), F.lit("TBD")).alias("starts"),
        countdown(F.col("date_start"), as_of).alias("countdown"),
        F.when(F.col("price") == 0, "FREE").otherwise(F.concat(F.lit(CURRENCY), shown(F.col("price"), 0))).alias("price_text"))


def seat_availability(t: Tables) -> DataFrame:
    """Spots left, fill and sold-out flag; a capacity of 0 means no limit."""
    limited = F.col("capacity") > 0
    return (
        t.listings.select(F.col("id").alias("listing_id"), F.col("capacity").cast("bigint").alias("capacity"))
        .join(seat_counts(t), "listing_id", "left").withColumn("registered", F.coalesce("registered", F.lit(0)))
        .select("listing_id", "capacity", "registered", F.when(limited, F.col("capacity") - F.col("registered")).alias("spots_left"),
                whole_percent(F.col("registered"), F.col("capacity")).alias("fill_pct"),
                (limited & (F.col("registered") >= F.col("capacity"))).alias("sold_out"))
    )


def parsed_requests(replies: DataFrame, known_types: Sequence[str]) -> DataFrame:
    """Search filters from free-text replies. A type the form does not offer applies no filter."""
    fields = F.col("fields")
    kind = F.coalesce(field_or(fields, "type", F.lit("")), F.lit(""))
    city = F.coalesce(field_or(fields, "city", F.lit("")), F.lit(""))
    price = F.coalesce(field_or(fields, "price_range", F.lit("")), F.lit(""))
    return with_fields(replies, "reply").select(
        "request_id", F.when(kind.isin(*known_types), kind).otherwise("").alias("type"), city.alias("city"),
        (F.lower(price) == "free").alias("free_only"))


def batch_search(t: Tables, requests: DataFrame, *, limit: int = PAGE_CATALOGUE) -> DataFrame:
    """The newest ``limit`` published listings for each request (type, city part, free_only).

    Equal requests are answered once. A listing outside the newest ``limit`` of its own (type, city,
    free) cell cannot be in any answer, so only those heads are kept, under the key of every request
    form they satisfy: own type or any, each asked city part or any, free or any. Answering is then
    an equi-join on the form. City parts are matched through the parts of the few distinct cities.
    The parsed requests and the published listings' heads are stored, since several steps read them. Runs jobs while it is built.
    """
    requests = materialize(requests.select("request_id", "type", "city", "free_only"), "search-requests")
    forms = requests.select("type", "city", "free_only").distinct()
    asked = forms.select(F.col("city").alias("part")).filter(F.col("part") != "").distinct()
    shows = t.listings.filter(F.col("status") == "published").select(
        F.col("id").alias("listing_id"), "title", "type", F.col("city").alias("listing_city"),
        (F.col("price") == 0).alias("is_free"), "created_at")
    order = [F.desc("created_at"), F.asc("listing_id")]
    # every city has a head, so the cities are those of the heads
    heads = materialize(top_per_key(shows, ["type", "listing_city", "is_free"], order, limit, "rank").drop("rank"), "search-heads")

    cities = heads.select("listing_city").filter(F.length("listing_city") > 0).distinct()
    starts = F.explode(F.sequence(F.lit(1), F.length("listing_city")))
    parts = cities.select("listing_city", starts.alias("start")).select(
        "listing_city", "start", F.explode(F.sequence(F.lit(1), F.length("listing_city") - F.col("start") + 1)).alias("len"))
    parts = parts.select("listing_city", F.substring(F.col("listing_city"), F.col("start"), F.col("len")).alias("piece"))
    hits = parts.join(asked, F.collate(F.col("piece"), "UNICODE_CI_AI") == F.collate(F.col("part"), "UNICODE_CI_AI")).select(
        "listing_city", "part").distinct()
    any_city = heads.withColumn("part", F.lit(""))
    keyed = any_city.unionByName(heads.join(hits, "listing_city"))
    options = keyed.select(
        "listing_id", "title", "created_at", F.col("part").alias("city"),
        F.explode(F.array(F.col("type"), F.lit(""))).alias("type"), "is_free")
    options = options.select(
        "listing_id", "title", "created_at", "city", "type",
        F.explode(F.when(F.col("is_free"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))).alias("free_only"))
    form = ["type", "city", "free_only"]
    answers = top_per_key(options, form, order, limit, "ordinal").join(forms, form, "left_semi")
    return requests.join(answers, form).select(
        "request_id", F.col("ordinal").cast("bigint").alias("ordinal"), "listing_id", "title")
