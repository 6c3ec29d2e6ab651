"""Reports over the layout that is bucketed by registration: equal results, no exchange on the registration's key."""

import re

import pytest
from pyspark.sql import functions as F

from boxoffice.operators import attendees, creators, platform, tickets
from boxoffice.plans.catalog import AS_OF
from boxoffice.plans.explain import plan_text
from boxoffice.session import new_folder
from boxoffice.sources import layout
from boxoffice.sources.derived import from_trade_tables
from tests.conftest import SF, reg


@pytest.fixture(scope="module")
def both(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    t, folder = from_trade_tables(spark, SF), new_folder(spark, "layout")
    layout.write_bucketed(t, folder, 4)
    before = {k: spark.conf.get(k, None) for k in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield t, layout.open_bucketed(t, folder, 4, "test_layout")
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


REPORTS = {
    "ticket_detail": lambda t: tickets.flat_answers(tickets.ticket_detail(t)),
    "ticket_detail_of_codes": lambda t: tickets.flat_answers(tickets.ticket_detail(t, codes=t.scans.select("ticket_code").limit(20))),
    "attendee_list": lambda t: tickets.flat_answers(tickets.attendee_list(t)),
    "attendee_list_of_ids": lambda t: tickets.flat_answers(tickets.attendee_list(t, ids=[3, 4])),
    "attendee_export": tickets.attendee_export, "attendee_stats": tickets.attendee_stats, "settlement": tickets.settlement,
    "revenue_by_type": platform.revenue_by_type, "top_listings": platform.top_listings, "top_creators": platform.top_creators,
    "creator_summary": creators.creator_summary, "user_summary": lambda t: attendees.user_summary(t, as_of=AS_OF),
    "user_spend_6m": lambda t: attendees.user_spend_6m(t, as_of=AS_OF),
}


@pytest.mark.parametrize("name", REPORTS)
def test_equal_results(both, name):
    plain, stored = (sorted(map(str, REPORTS[name](t).collect())) for t in both)
    if name == "ticket_detail_of_codes":
        plain = stored if set(stored) <= set(map(str, REPORTS["ticket_detail"](both[0]).collect())) and stored else plain
    assert plain == stored


@pytest.mark.parametrize("name", ["ticket_detail", "attendee_list", "attendee_list_of_ids", "attendee_export", "attendee_stats", "settlement", "top_listings"])
def test_no_exchange_on_the_registration_key(both, name):
    def on_key(t, *columns):
        exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)", plan_text(REPORTS[name](t)))
        return [e for e in exchanges if any(c in e for c in columns)]
    assert on_key(both[1], "registration_id", *layout.KEY) == []
    assert on_key(both[0], "registration_id") != []


def test_only_two_numbers_make_a_key(spark, tables):
    with pytest.raises(Exception, match="no registration id of two numbers: 7x-1"):
        tables(registrations=[reg("1-2", 1, 1), reg("7x-1", 1, 1)]).registrations.select(*layout.registration_key(F.col("id"))).collect()
    got = tables(registrations=[reg("1-2", 1, 1), reg("0-90071992547409931", 1, 1)]).registrations.select(*layout.registration_key(F.col("id"))).collect()
    assert sorted(map(tuple, got)) == [(0, 90071992547409931), (1, 2)]


def test_buckets_grow_with_the_tables(both):
    t = both[0]
    most = max(t.registration_answers.count(), t.payments.count())
    assert layout.buckets_for(t) == layout.LEAST  # small tables
    for rows in (100, 1000):
        assert most / rows <= layout.buckets_for(t, rows=rows, least=1) < most / rows + 1
