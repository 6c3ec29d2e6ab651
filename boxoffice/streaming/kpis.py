"""Headline numbers over streams of changes, with what no longer holds taken back.

Every row of the streams is a version of an entity (a user, a listing, a registration, a payment). Each entity's newest version is
held as what it contributes: an amount to a running total, and a count on a day where the number
depends on the moment of asking. A newer version takes the old contribution off and adds its own; an older one, arriving late, changes
nothing. Only these differences reach the report, summed per number and day, one small file set per micro-batch; a replayed
batch writes the same differences over its own. The report adds them up as of any moment, so "today" and "this week" move with it.

The held versions are a table beside the sums, written in versions too: a micro-batch is folded to its newest versions, meets those that
its entities hold, and writes the entities that changed, with what they held before. All of it is joins and aggregates of Spark
over the whole batch, so a first drain of years of changes costs one shuffle of them and no call per entity.

Versions are ordered by (ts, seq); equal ones are told apart by what they contribute, so replays and arrival orders agree.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from boxoffice.functions.ratios import money
from boxoffice.functions.times import days_before, micros, ntz
from boxoffice.streaming.activity import COMPACT_EVERY, _start, newest_base

COUNT, REVENUE = 1, "total_revenue"
NOTHING = ""
CHANGE = ("entity", "ts", "seq", "kpi", "amount", "dated", "day")
DELTA = "kpi string, day int, amount long"
VERSION = "struct<ts:bigint,seq:bigint,kpi:string,amount:bigint,dated:string,day:int>"
HELD = f"entity string, now {VERSION}, was {VERSION}"


def _changes(rows: DataFrame, kind: str, kpi: Column, dated: Column | None = None, day: Column | None = None, amount: Column | None = None) -> DataFrame:
    """``rows`` (id, ts, seq...) as versions of entities; a NULL ``kpi`` or ``dated`` contributes nothing."""
    counted = F.coalesce(dated, F.lit(NOTHING)) if dated is not None else F.lit(NOTHING)
    return rows.select(
        F.concat(F.lit(f"{kind} "), F.col("id").cast("string")).alias("entity"), micros(F.col("ts")).alias("ts"),
        F.col("seq").cast("long").alias("seq"), F.coalesce(kpi, F.lit(NOTHING)).alias("kpi"),
        F.coalesce(amount if amount is not None else F.lit(COUNT), F.lit(0)).cast("long").alias("amount"), counted.alias("dated"),
        F.when(counted != NOTHING, F.unix_date(day.cast("date")) if day is not None else F.lit(0)).otherwise(0).cast("int").alias("day"))


def user_changes(rows: DataFrame) -> DataFrame:
    attendee = F.col("role") == "user"
    kpi = F.when(attendee, "total_users").when(F.col("role") == "creator", "total_creators")
    return _changes(rows, "user", kpi, F.when(attendee & F.col("created_at").isNotNull(), "signups"), F.col("created_at"))


def listing_changes(rows: DataFrame) -> DataFrame:
    published = F.col("status") == "published"
    return _changes(rows, "listing", F.when(published, "total_listings"), F.when(published & F.col("date_start").isNotNull(), "starts"), F.col("date_start"))


def registration_changes(rows: DataFrame) -> DataFrame:
    return _changes(rows, "registration", F.when(F.col("status") != "cancelled", "total_registrations"))


def payment_changes(rows: DataFrame) -> DataFrame:
    """Amounts are kept in hundredths."""
    return _changes(rows, "payment", F.when(F.col("status") == "success", REVENUE), amount=(F.col("amount") * 100).cast("long"))


def _contributions(version: str, sign: int) -> list[Column]:
    """What a held version adds to the numbers, or takes off them; NULL where it adds nothing."""
    part = lambda name, day, amount: F.when(F.col(f"{version}.{name}") != NOTHING, F.struct(
        F.col(f"{version}.{name}").alias("kpi"), day.cast("int").alias("day"), (amount * sign).cast("long").alias("amount")))
    return [part("kpi", F.lit(0), F.col(f"{version}.amount")), part("dated", F.col(f"{version}.day"), F.lit(COUNT))]


def _newest(changes: DataFrame, held: DataFrame | None) -> DataFrame:
    """Per entity of both: its newest version (now), and the one held before (was; NULL when none).

    A version without a moment is neither newer nor older than another: it stays if it came first, and is passed over otherwise; so
    does one without a seq among those of the newest moment. Only for these the order of arrival counts; what is held came before.
    """
    rows = changes.select("entity", F.struct(*CHANGE[1:]).alias("now"), F.lit(None).cast(VERSION).alias("was"), F.monotonically_increasing_id().alias("turn"))
    if held is not None:
        rows = rows.unionByName(held.select("entity", "now", F.col("now").alias("was"), F.lit(-1).cast("long").alias("turn")))
    moment, seq, early = F.col("now.ts"), F.col("now.seq"), (-F.col("turn")).alias("early")
    found = rows.groupBy("entity").agg(
        F.max(F.when(moment.isNotNull() & seq.isNotNull(), F.col("now"))).alias("ordered"), F.max("was").alias("was"), F.min("turn").alias("first"),
        F.min(F.when(moment.isNull(), F.struct("turn", "now"))).alias("timeless"),
        F.max(F.when(moment.isNotNull(), F.struct(moment.alias("ts"), early))).alias("top"),
        F.max(F.when(moment.isNotNull() & seq.isNull(), F.struct(moment.alias("ts"), early, "now"))).alias("loose"))
    stays = (F.col("loose.ts") == F.col("top.ts")) & (F.col("loose.early") == F.col("top.early"))
    return found.select("entity", F.when(F.col("timeless.turn") == F.col("first"), F.col("timeless.now")).when(stays, F.col("loose.now")).otherwise(
        F.col("ordered")).alias("now"), "was")


def kpi_deltas(held: DataFrame) -> DataFrame:
    """The differences that held versions (entity, now, was) make: kpi, day (since 1970; 0 for running totals), amount."""
    changed = held.filter(~F.col("now").eqNullSafe(F.col("was")))
    return changed.select(F.inline(F.array_compact(F.array(*_contributions("now", 1), *_contributions("was", -1))))).groupBy("kpi", "day").agg(
        F.sum("amount").alias("amount"))


def _held(spark: SparkSession, path: str, number: int, base: int) -> DataFrame | None:
    """Versions held before batch ``number``, from the files of a base: the newest of each entity is its own."""
    rows = spark.read.schema(f"{HELD}, version long").option("basePath", f"{path}/held/base={base}").parquet(f"{path}/held/base={base}")
    return rows.filter(F.col("version") < number)


def kpi_stream(changes: DataFrame, path: str, checkpoint: str, *, every: str | None = None, compact_every: int = COMPACT_EVERY) -> StreamingQuery:
    """Start the query; each micro-batch writes its sums. Every ``compact_every`` batches a new base starts with the sums so far, and with
    all held versions; the other batches write those of their own entities, and read only these from the base."""
    def write(batch: DataFrame, number: int) -> None:
        spark, base = batch.sparkSession, number - number % compact_every
        anew = number == base
        source = (newest_base(spark, f"{path}/held", base) if number else None) if anew else base
        held = None if source is None else _held(spark, path, number, source)
        if held is not None and not anew:
            touched = batch.select(F.col("entity").alias("_entity")).distinct()
            held = held.join(touched, F.col("entity").eqNullSafe(F.col("_entity")), "left_semi")
        kept = f"{path}/held/base={base}/version={number}"
        _newest(batch, held).write.mode("overwrite").parquet(kept)
        sums = kpi_deltas(spark.read.schema(HELD).parquet(kept))
        if number and anew:
            sums = sums.unionByName(stored_deltas(spark, path, before=base)).groupBy("kpi", "day").agg(F.sum("amount").alias("amount"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{path}/base={base}/version={number}")

    writer = changes.select(*CHANGE).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return _start(writer, every).start()


def stored_deltas(spark: SparkSession, path: str, *, before: int | None = None) -> DataFrame:
    """The sums of the newest whole base (below ``before``); none at all before the first batch."""
    base = newest_base(spark, path, before)
    if base is None:
        return spark.createDataFrame([], DELTA)
    return spark.read.schema(DELTA).parquet(f"{path}/base={base}/version=*").filter("amount is not null")


def kpi_report(deltas: DataFrame, *, as_of: datetime) -> DataFrame:
    """The headline numbers as of a moment, in one row."""
    day, today, week = F.col("day"), F.unix_date(ntz(as_of).cast("date")), F.unix_date(ntz(days_before(as_of, 7)).cast("date"))
    total = lambda name, rule=F.lit(True): F.coalesce(F.sum(F.when((F.col("kpi") == name) & rule, F.col("amount"))), F.lit(0))
    counts = {n: total(n) for n in ("total_users", "total_creators", "total_listings", "total_registrations")}
    counts |= {"listings_today": total("starts", day == today), "new_users_this_week": total("signups", day >= week)}
    return deltas.agg(*(c.cast("bigint").alias(n) for n, c in counts.items()), money((total(REVENUE) / 100).cast("decimal(30,2)")).alias(REVENUE))
