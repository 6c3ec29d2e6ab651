"""Streams over the activity, chat, scan and marketplace files.

Append streams write Parquet directly. Aggregates whose values change (counters, toggles) run in
update mode; each micro-batch's changed keys are written as a new version of those keys, and readers
take the latest version. A replayed batch overwrites its own version, so results stay exact. Every
``COMPACT_EVERY`` batches the versions so far are folded into a new base, so readers never meet more.

State is one row per key and has no expiry: every hit, scan and toggle counts however late it comes.
``CLUSTER_SETTINGS`` keeps that state on disk. Static sides of joins should be stored tables, because
each micro-batch reads them again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from boxoffice.functions.ratios import money
from boxoffice.functions.times import days_before, ntz, on_day
from boxoffice.operators.base import live, successful
from boxoffice.operators.lifecycle import lifecycle_update

COMPACT_EVERY = 100


def read_stream(spark: SparkSession, path: str, schema: StructType, *, files_per_trigger: int | None = None) -> DataFrame:
    """A file stream over a folder of Parquet files, or over a single file.

    The last character is written as a glob class: it matches only itself, and a glob may name a file
    where a plain stream path must be a folder.
    """
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def valid_scans(scans: DataFrame, listings: DataFrame, registrations: DataFrame) -> DataFrame:
    """Scans by the owner of the right listing for a confirmed ticket, against static tables."""
    owners = listings.select(F.col("id").alias("listing_id"), F.col("creator_id").alias("scanner_id"))
    regs = registrations.filter((F.col("status") == "confirmed") & ~F.col("checked_in")).select(
        "ticket_code", "listing_id", F.col("id").alias("registration_id"))
    return scans.filter(F.col("ticket_code").isNotNull()).join(owners, ["listing_id", "scanner_id"]).join(
        regs, ["ticket_code", "listing_id"])


def first_scans(valid: DataFrame) -> DataFrame:
    """The first valid scan per registration; state is one row per checked-in ticket."""
    return valid.groupBy("registration_id").agg(F.min(F.struct("ts", "scan_id")).alias("first")).select(
        "registration_id", F.col("first.scan_id").alias("scan_id"), F.col("first.ts").alias("checked_in_at"))


def activity_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("events"))


def unread_counts(notifications: DataFrame) -> DataFrame:
    return notifications.groupBy("user_id").agg(F.count_if(~F.col("is_read")).alias("unread"))


def toggle_state(toggles: DataFrame, pair: list[str]) -> DataFrame:
    return toggles.groupBy(*pair).agg((F.count("*") % 2 == 1).alias("is_on"))


def unread_messages(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Unread messages per recipient; ``threads`` is a stored table."""
    sides = threads.select(F.col("id").alias("thread_id"), F.explode(F.array("user_id", "creator_id")).alias("viewer_id"))
    received = messages.select("thread_id", "sender_id", "is_read").join(sides, "thread_id").filter(F.col("sender_id") != F.col("viewer_id"))
    return received.groupBy(F.col("viewer_id").alias("user_id")).agg(F.count_if(~F.col("is_read")).alias("unread"))


KPIS = ("total_users", "total_creators", "total_listings", "total_registrations", "total_revenue", "listings_today", "new_users_this_week")


def kpi_totals(users: DataFrame, listings: DataFrame, registrations: DataFrame, payments: DataFrame, *, as_of: datetime) -> DataFrame:
    """Running total of each headline number over four streams of new rows; the state is seven rows."""
    attendee, published = F.col("role") == "user", F.col("status") == "published"
    rules = (
        (users, "total_users", attendee), (users, "total_creators", F.col("role") == "creator"),
        (users, "new_users_this_week", attendee & (F.col("created_at") >= ntz(days_before(as_of, 7)))),
        (listings, "total_listings", published), (listings, "listings_today", published & on_day(F.col("date_start"), as_of)),
        (live(registrations), "total_registrations", F.lit(True)), (successful(payments), "total_revenue", F.lit(True)))
    by_table: dict[int, tuple[DataFrame, list]] = {}
    for table, name, rule in rules:
        amount = F.col("amount") if name == "total_revenue" else F.lit(1)
        by_table.setdefault(id(table), (table, []))[1].append(F.when(rule, F.struct(F.lit(name).alias("kpi"), amount.cast("decimal(30,2)").alias("amount"))))
    parts = [table.select(F.explode(F.array_compact(F.array(*found))).alias("x")).select("x.*") for table, found in by_table.values()]
    return reduce(DataFrame.unionByName, parts).groupBy("kpi").agg(F.sum("amount").alias("amount"))


def kpi_row(totals: DataFrame) -> DataFrame:
    """The latest totals as one row, like the batch report."""
    value = lambda name: F.coalesce(F.max(F.when(F.col("kpi") == name, F.col("amount"))), F.lit(0))
    return totals.agg(*[(money(value(n)) if n == "total_revenue" else value(n).cast("bigint")).alias(n) for n in KPIS])


def lifecycle_sweep(ticks: DataFrame, stored: Callable[[], DataFrame], path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """At each tick, judge all stored listings as of the tick; what changes is a new version.

    ``ticks`` has one column, tick: for example the timestamps of a rate source with a period of an hour.
    """
    def sweep(batch: DataFrame, number: int) -> None:
        as_of = batch.agg(F.max("tick")).first()[0]
        if as_of is not None:
            lifecycle_update(stored(), as_of=as_of).write.mode("overwrite").parquet(f"{path}/base=0/version={number}")

    return _start(ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint), every).start()


def _start(writer, every: str | None):
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def append_stream(frame: DataFrame, path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Start an append query into Parquet; without a period it drains what is there and stops."""
    writer = frame.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return _start(writer, every).start(path)


def version_stream(frame: DataFrame, path: str, checkpoint: str, keys: list[str], *, every: str | None = None,
                   compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start an update query that writes the changed keys of each micro-batch as a new version."""
    schema = frame.schema

    def write(batch: DataFrame, number: int) -> None:
        base = number - number % compact_every
        if number and number == base:
            earlier = latest_versions(batch.sparkSession, path, schema, keys, base=base - compact_every)
            batch = earlier.join(batch.select(*keys), keys, "left_anti").select(*batch.columns).unionByName(batch)
        batch.write.mode("overwrite").parquet(f"{path}/base={base}/version={number}")

    writer = frame.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint)
    return _start(writer, every).start()


def newest_base(spark: SparkSession, path: str, before: int | None = None) -> int | None:
    """The newest base (below ``before``) whose first version is whole: the job that wrote it has left its mark."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = store.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/base=*/version=*/_SUCCESS")) or []
    marks = [re.search(r"/base=(\d+)/version=(\d+)/_SUCCESS$", f.getPath().toString()) for f in found]
    whole = [int(m[1]) for m in marks if m and m[1] == m[2] and (before is None or int(m[1]) < before)]
    return max(whole, default=None)


def latest_versions(spark: SparkSession, path: str, schema: StructType, keys: list[str], *, base: int | None = None) -> DataFrame:
    """The newest version of each key, from the newest whole base unless another is named."""
    versioned = StructType([*schema.fields, StructField("base", LongType()), StructField("version", LongType())])
    rows = spark.read.schema(versioned).option("basePath", path).parquet(path)
    base = newest_base(spark, path) if base is None else base
    rows = rows.filter(F.col("base") == F.lit(base)) if base is not None else rows
    values = [f.name for f in schema.fields if f.name not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v"))
    return newest.select(*keys, "v.*")
