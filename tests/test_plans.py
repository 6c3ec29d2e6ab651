"""Physical plans with broadcasting switched off, so that only proven-small sides are broadcast."""

import pytest

from boxoffice.plans.catalog import QUERIES
from boxoffice.plans.explain import plan_counts, pushed_filters, read_columns
from tests.conftest import SF

BATCH = sorted(n for n in QUERIES if not n.startswith("stream_"))
# Broadcast sides of a size fixed by the call: axes, pages, rule tables, per-type heads.
BROADCASTS = {
    "listings_by_type", "listings_by_status", "chart_json", "recent_activity", "catalogue_search", "search_sorted", "user_search",
    "registration_search", "similar_listings", "missing_details", "indexed_user_search", "indexed_registration_search",
}


@pytest.fixture(scope="module")
def big(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for key in keys:
        spark.conf.set(key, "-1")
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.mark.parametrize("name", BATCH)
def test_plan_scales(big, name):
    counts = plan_counts(QUERIES[name](big, SF))
    assert counts["cartesian"] == counts["nested_loop"] == counts["python"] == 0
    assert (counts["broadcast_joins"] > 0) == (name in BROADCASTS)


def test_top_k_is_cut_before_the_shuffle(big):
    for name in ("creator_revenue_top8", "creator_top_listing", "user_upcoming", "notification_feed", "saved_feed", "recent_checkins"):
        assert plan_counts(QUERIES[name](big, SF))["group_limits"] >= 2


def test_year_is_pushed_as_a_range(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    pushed = " ".join(pushed_filters(QUERIES["revenue_by_month"](spark, SF)))
    assert "GreaterThanOrEqual(l_shipdate,2000-01-01T00:00)" in pushed and "LessThan(l_shipdate,2001-01-01T00:00)" in pushed


def test_scans_read_only_needed_columns(spark):
    for columns in read_columns(QUERIES["payment_mix"](spark, SF)):
        assert set(c.split(":")[0] for c in columns.split(",")) <= {"l_linenumber", "l_returnflag", "l_linestatus"}


def test_wanted_ids_restrict_the_facts_before_they_are_folded(big):
    """Below every aggregate over payments or registrations stands a semi join with the wanted keys."""
    from boxoffice.operators import attendees, creators, tickets
    from boxoffice.plans.catalog import AS_OF, TREND_AS_OF
    from boxoffice.sources.derived import from_trade_tables
    t = from_trade_tables(big, SF)
    one = [1_000_000_000_000_003]
    frames = (
        creators.creator_summary(t, ids=one), creators.creator_performance(t, ids=one), creators.creator_public_stats(t, ids=one),
        creators.creator_manage_stats(t, ids=one), creators.creator_listings(t, ids=one), creators.creator_trend(t, as_of=TREND_AS_OF, ids=one),
        attendees.user_summary(t, as_of=AS_OF, ids=[7]), attendees.user_spend_6m(t, as_of=AS_OF, ids=[7]),
        tickets.attendee_list(t, ids=[7]), tickets.attendee_stats(t, ids=[7]))
    for frame in frames:
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        assert "LeftSemi" in plan or "listing_id" in plan and "= 7" in plan, plan


def test_stream_plans_have_no_python_or_cross_join(spark):
    from boxoffice.plans import catalog
    from boxoffice.sources import derived
    from boxoffice.operators import engagement
    events = catalog._events(spark, SF)
    n = derived.sizes(spark, SF)
    for frame in (engagement.daily_views(derived.view_hits(events)), derived.follow_toggles(events, n), derived.status_log(events, n)):
        plan = frame._jdf.queryExecution().analyzed().toString()
        assert frame.isStreaming and "Python" not in plan and "Join Cross" not in plan
