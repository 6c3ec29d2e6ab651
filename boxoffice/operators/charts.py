"""Chart payloads: tidy (ordinal, label, value) rows to one {labels, data} object per chart."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.operators import creators, platform
from boxoffice.operators.base import Ids
from boxoffice.schema import LISTING_TYPES
from boxoffice.sources.tables import Tables


def chart_object(rows: DataFrame, *keys: str) -> DataFrame:
    """Gather each chart's points (an axis or a top-k, so few) into {labels, data}."""
    points = F.array_sort(F.collect_list(F.struct("ordinal", "label", "value")))
    packed = rows.groupBy(*keys).agg(points.alias("points"))
    payload = F.to_json(F.struct(
        F.transform("points", lambda p: p["label"]).alias("labels"), F.transform("points", lambda p: p["value"].cast("decimal(20,2)")).alias("data")))
    labels = F.array_join(F.transform("points", lambda p: p["label"]), "|")
    total = F.aggregate("points", F.lit(0.0), lambda acc, p: acc + p["value"])
    return packed.select(*keys, F.size("points").cast("bigint").alias("points"), labels.alias("labels"), total.alias("total"), payload.alias("payload"))


def _tidy(frame: DataFrame, chart: str, ordinal: str | Column, label: str, value: str, *keys: str) -> DataFrame:
    ordinal = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return frame.select(
        *keys, F.lit(chart).alias("chart"), ordinal.cast("bigint").alias("ordinal"), F.col(label).alias("label"),
        F.col(value).cast("double").alias("value"))


def platform_charts(t: Tables, *, year: int, types: tuple = LISTING_TYPES) -> DataFrame:
    """The administrator's seven charts."""
    by_size = F.row_number().over(Window.orderBy(F.desc("listings"), "label"))  # ten rows
    by_label = F.row_number().over(Window.orderBy("label"))  # one row per payment method
    parts = [
        _tidy(platform.revenue_by_month(t, year=year), "revenue_monthly", "month", "label", "revenue"),
        _tidy(platform.registrations_by_month(t, year=year), "regs_monthly", "month", "label", "registrations"),
        _tidy(platform.signups_by_month(t, year=year), "user_growth", "month", "label", "new_users"),
        _tidy(platform.listings_by_type(t, axis=types), "events_type", "ordinal", "label", "listings"),
        _tidy(platform.city_breakdown(t), "city_breakdown", by_size, "label", "listings"),
        _tidy(platform.listings_by_status(t), "event_status", "ordinal", "label", "listings"),
        _tidy(platform.payment_mix(t), "payment_methods", by_label, "label", "payments"),
    ]
    return chart_object(reduce(DataFrame.unionByName, parts), "chart")


def creator_charts(t: Tables, *, as_of: datetime, ids: Ids = None) -> DataFrame:
    """Each creator's two charts: revenue of the best earning listings, registrations per day."""
    parts = [
        _tidy(creators.creator_revenue_top8(t, ids=ids), "revenue_by_event", "ordinal", "label", "revenue", "creator_id"),
        _tidy(creators.creator_trend(t, as_of=as_of, ids=ids), "registration_trend", "ordinal", "label", "registrations", "creator_id"),
    ]
    return chart_object(reduce(DataFrame.unionByName, parts), "creator_id", "chart")
