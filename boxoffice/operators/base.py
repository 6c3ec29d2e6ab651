"""Building blocks: partial aggregates per listing and registration, axes, per-key ranking.

Facts are folded to their key before they are joined, so a key that owns a large part of the rows
shrinks to one row per task before it is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.session import materialize
from boxoffice.sources.tables import Tables

Ids = Iterable[int] | DataFrame | None
FIELDS = 32  # so many distinct form fields are folded side by side


def restrict(frame: DataFrame, column: str, ids: Ids) -> DataFrame:
    """Keep the rows of the given ids: a short list (pushed to the scan) or a one-column frame."""
    if ids is None:
        return frame
    if isinstance(ids, DataFrame):
        return frame.join(ids.toDF(column).distinct(), column, "left_semi")
    return frame.filter(F.col(column).isin(*ids))


def live(registrations: DataFrame) -> DataFrame:
    return registrations.filter(F.col("status") != "cancelled")


def successful(payments: DataFrame) -> DataFrame:
    return payments.filter(F.col("status") == "success")


def seat_counts(t: Tables, ids: Ids = None) -> DataFrame:
    """Live registrations per listing; listings without any are absent."""
    rows = restrict(live(t.registrations), "listing_id", ids)
    return rows.groupBy("listing_id").agg(F.count("*").alias("registered"))


def registration_rows(t: Tables, *columns: str, ids: Ids = None) -> DataFrame:
    """registration_id, the key by which other tables refer to it, and the given columns; of the given listings."""
    keys = [k for k in t.key if k != "registration_id"]
    return restrict(t.registrations, "listing_id", ids).select(F.col("id").alias("registration_id"), *keys, *columns)


def of_registrations(rows: DataFrame, registrations: DataFrame | None, key: Sequence[str] = ("registration_id",)) -> DataFrame:
    """The rows that belong to ``registrations``, before anything is folded; all rows without it."""
    if registrations is None:
        return rows
    return rows.join(registrations.select(*key).distinct(), list(key), "left_semi")


def payment_totals(t: Tables, registrations: DataFrame | None = None) -> DataFrame:
    """Successful payments folded to one row per registration."""
    return of_registrations(successful(t.payments), registrations, t.key).groupBy(*t.key).agg(
        F.count("*").alias("paid_rows"), F.sum("amount").alias("paid"))


def first_payments(t: Tables, registrations: DataFrame | None = None) -> DataFrame:
    """The amount of the earliest successful payment per registration."""
    return of_registrations(successful(t.payments), registrations, t.key).groupBy(*t.key).agg(
        F.min_by("amount", F.struct("created_at", "amount", "method")).alias("paid_amount"))


def joined_ledger(t: Tables, listings: Ids = None) -> DataFrame:
    """Per listing, or per one of the given: live registrations as the payment join counts them, and their revenue.

    A registration counts once per successful payment (at least once). Weighting the folded
    payments gives the same numbers as joining every payment row.
    """
    regs = live(registration_rows(t, "listing_id", "status", ids=listings)).drop("status")
    return (
        regs.join(payment_totals(t, None if listings is None else regs), list(t.key), "left").groupBy("listing_id")
        .agg(F.sum(F.coalesce("paid_rows", F.lit(1))).alias("registered"), F.sum("paid").alias("revenue"))
    )


def full_ledger(t: Tables, listings: Ids = None) -> DataFrame:
    """Per listing, or per one of the given: live registrations once each, and successful payments of all registrations."""
    regs = registration_rows(t, "listing_id", "status", ids=listings)
    return (
        regs.join(payment_totals(t, None if listings is None else regs), list(t.key), "left").groupBy("listing_id")
        .agg(F.count_if(F.col("status") != "cancelled").alias("registered"), F.sum("paid").alias("revenue"))
    )


def top_per_key(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, position: str) -> DataFrame:
    """First ``k`` rows per key. With a constant ``k`` Spark cuts inside each task before the
    shuffle (WindowGroupLimit), so a hot key sends at most ``k`` rows per task."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn(position, F.row_number().over(window)).filter(F.col(position) <= k)


def positions(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based position of every row within its key, for groups of any size.

    The rows are range-partitioned on key and order, so a hot key spreads over many slices of equal
    size; a row's position is its rank in its slice plus the sizes of the slices before it. The
    placement is written to the shared folder because two branches of the plan must see the same one.
    """
    placed = materialize(
        frame.repartitionByRange(*keys, *order).withColumn("_slice", F.spark_partition_id()), "positions")
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows")).select(
        *keys, "_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, "_slice").orderBy(*order)
    return (
        placed.withColumn("_rank", F.row_number().over(local)).join(offsets, [*keys, "_slice"])
        .withColumn(name, F.col("_rank") + F.col("_offset")).drop("_rank", "_offset", "_slice")
    )


def salted_left_join(facts: DataFrame, single: DataFrame, key: str, spread_by: str, salts: int = 16) -> DataFrame:
    """Left join in which each key of ``facts`` is spread over ``salts`` partitions.

    For joins directly followed by a grouping on the same key: there the adaptive skew split cannot
    act, because the grouping relies on the join's partitioning. ``single`` has one row per key.
    """
    spread = facts.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = single.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(copies, [key, "_salt"], "left").drop("_salt")


def zero_filled(facts: DataFrame, axis: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums per key with a zero for every axis key that has no facts.

    The axis enters as rows of zeros before the one aggregation, so no join is needed.
    """
    zeros = axis.select(*keys, *[F.lit(0).cast(facts.schema[s].dataType).alias(s) for s in sums])
    return facts.select(*keys, *sums).unionByName(zeros).groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums])


def key_value_map(frame: DataFrame, entity: str | Sequence[str], key: str, value: str, order: str, *, ask_fields: bool = False) -> DataFrame:
    """Key/value rows to one map per entity; of repeated keys the last row wins.

    Repeats are cut first, so an entity gathers at most one entry per distinct form field. With ``ask_fields`` a job looks up
    which fields there are; up to ``FIELDS`` of them are folded side by side, so that rows are shuffled once, by entity, and not by
    entity and field first.
    """
    entity = [entity] if isinstance(entity, str) else list(entity)
    rows = frame.select(*entity, key, value, order)
    fields = [r[0] for r in rows.select(key).distinct().limit(FIELDS + 1).collect()] if ask_fields else []
    if 0 < len(fields) <= FIELDS and None not in fields:
        last = [F.max(F.when(F.col(key) == F.lit(f), F.struct(order, value))).alias(f"_{i}") for i, f in enumerate(fields)]
        found = [F.when(F.col(f"_{i}").isNotNull(), F.struct(F.lit(f).alias(key), F.col(f"_{i}")[value].alias(value))) for i, f in enumerate(fields)]
        return rows.groupBy(*entity).agg(*last).select(*entity, F.map_from_entries(F.array_sort(F.array_compact(F.array(*found)))).alias("fields"))
    last = top_per_key(rows, [*entity, key], [F.desc(order), F.desc(value)], 1, "_n")
    entries = F.array_sort(F.collect_list(F.struct(key, value)))
    return last.groupBy(*entity).agg(F.map_from_entries(entries).alias("fields"))


def fields_text(fields: Column) -> Column:
    """A map as ``a=1;b=2`` with sorted keys; '' when there is none."""
    pairs = F.transform(F.array_sort(F.map_entries(fields)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit(""))))
    return F.coalesce(F.array_join(pairs, ";"), F.lit(""))
