"""The lifecycle sweep from a calendar: a tick reads what falls due since the last one, and every change is emitted once.

The calendar has an entry for each listing that will change by itself, under the day on which it falls due (or on which it became
known, if that is later). A tick reads the days since the tick before, keeps the entries due in between, and looks the listings up: an
entry counts only if its listing still has the status and the moment that were entered, so edits and cancellations simply leave
entries behind that no longer hold. Edited and new listings are entered again.

The listings that are looked up must take in the emitted changes (``with_changes``). Each micro-batch writes its changes, then the tick up
to which they go; a replayed batch starts from the same earlier tick and writes the same changes over its own.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxoffice.functions.times import ntz
from boxoffice.streaming.activity import _start

CHANGE = "listing_id long, old_status string, new_status string, due timestamp_ntz"
LOOKED_UP = 1000  # so many due listings are looked up by a list that is pushed into the scan


def due_changes(listings: DataFrame) -> DataFrame:
    """listing_id, old_status, new_status and due: published listings end at their end, drafts are cancelled at their start."""
    published, draft = F.col("status") == "published", F.col("status") == "draft"
    return listings.select(
        F.col("id").alias("listing_id"), F.col("status").alias("old_status"), F.when(published, "ended").when(draft, "cancelled").alias("new_status"),
        F.when(published, F.col("date_end")).when(draft, F.col("date_start")).alias("due")).filter("due is not null")


def enter(listings: DataFrame, calendar: str, *, known_at: datetime) -> None:
    """Add new or edited listings to the calendar. ``known_at`` is not before the last tick."""
    entries = due_changes(listings).withColumn("falls", F.greatest("due", ntz(known_at))).withColumn("day", F.to_date("falls"))
    entries.repartition("day", F.pmod(F.xxhash64("listing_id"), F.lit(16))).write.mode("append").partitionBy("day").parquet(calendar)


def fallen_due(spark: SparkSession, calendar: str, listings: DataFrame, since: datetime | None, now: datetime) -> DataFrame:
    """The changes that fall due from ``since`` up to before ``now``; only the days between are read."""
    schema = f"{CHANGE}, falls timestamp_ntz, day date"
    entries = spark.read.schema(schema).parquet(calendar).filter((F.col("day") <= ntz(now).cast("date")) & (F.col("falls") < ntz(now)) & (F.col("due") < ntz(now)))
    if since is not None:
        entries = entries.filter((F.col("day") >= ntz(since).cast("date")) & (F.col("falls") >= ntz(since)))
    entries = entries.drop("falls", "day").distinct()
    ids = entries.select("listing_id").distinct().limit(LOOKED_UP + 1).collect()
    if len(ids) <= LOOKED_UP:
        listings = listings.filter(F.col("id").isin(*(r["listing_id"] for r in ids)))
    return due_changes(listings).join(entries, ["listing_id", "old_status", "new_status", "due"], "left_semi")


def with_changes(listings: DataFrame, changes: DataFrame) -> DataFrame:
    """The listings after the emitted changes: the latest one of a listing holds while its status is the one that was changed."""
    latest = Window.partitionBy("listing_id").orderBy(F.desc("due"), F.desc("new_status"))
    last = changes.withColumn("_n", F.row_number().over(latest)).filter("_n = 1").select(F.col("listing_id").alias("id"), "old_status", "new_status", "due")
    moment = F.when(F.col("status") == "published", F.col("date_end")).otherwise(F.col("date_start"))
    holds = (F.col("status") == F.col("old_status")) & (moment == F.col("due"))
    return listings.join(last, "id", "left").withColumn("status", F.when(holds, F.col("new_status")).otherwise(F.col("status"))).select(*listings.columns)


def due_sweep(ticks: DataFrame, calendar: str, listings: Callable[[], DataFrame], path: str, checkpoint: str, *, every: str | None = None) -> StreamingQuery:
    """Start the sweep over ``ticks`` (one column, tick); ``emitted`` reads what it has written."""
    def sweep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        since = spark.read.parquet(f"{path}/ticks/version={number - 1}").first()["tick"] if number else None
        now = batch.agg(F.max("tick")).first()[0]
        now = since if now is None or (since is not None and now < since) else now
        if now is not None:
            changes = fallen_due(spark, calendar, listings(), since, now).withColumn("tick", ntz(now))
            changes.write.mode("overwrite").parquet(f"{path}/changes/version={number}")
        spark.createDataFrame([(now,)], "tick timestamp_ntz").coalesce(1).write.mode("overwrite").parquet(f"{path}/ticks/version={number}")

    return _start(ticks.writeStream.foreachBatch(sweep).option("checkpointLocation", checkpoint), every).start()


def emitted(spark: SparkSession, path: str) -> DataFrame:
    """Every change with the tick that emitted it; none before the first tick."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/changes")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{CHANGE}, tick timestamp_ntz")
    return spark.read.schema(f"{CHANGE}, tick timestamp_ntz").parquet(f"{path}/changes").drop("version")
