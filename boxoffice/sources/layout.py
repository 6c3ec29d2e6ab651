"""Writing the marketplace tables: the native layout that ``Tables.from_parquet`` reads, and one bucketed by registration."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxoffice.schema import SCHEMAS
from boxoffice.sources.tables import Tables

# Tables that reports filter by time, and the column to lay them out by.
TIME_COLUMNS = {"registrations": "created_at", "payments": "created_at", "reviews": "created_at", "messages": "sent_at"}


def write_tables(t: Tables, folder: str, names: list[str] | None = None) -> None:
    """One Parquet folder per table. Fact tables are range-partitioned by time, so that the files'
    minimum and maximum let a year or a week be read without the rest."""
    for name in names or SCHEMAS:
        if name not in t:
            continue
        frame = getattr(t, name)
        frame = frame.select(*[frame[c].cast(SCHEMAS[name][c].dataType) for c in SCHEMAS[name].names if c in frame.columns])
        if name in TIME_COLUMNS:
            frame = frame.repartitionByRange(TIME_COLUMNS[name])
        frame.write.mode("errorifexists").parquet(f"{folder}/{name}")


# The tables that hold a registration's key, and the column of its id.
OF_REGISTRATIONS = {"registrations": "id", "payments": "registration_id", "registration_answers": "registration_id"}
KEY = ("registration_major", "registration_minor")
ROWS, LEAST = 1_000_000, 16  # rows of a bucket, and the fewest buckets
_KEYED = r"^(?:0|[1-9][0-9]{0,17})-(?:0|[1-9][0-9]{0,17})$"


def registration_key(id_column: Column) -> list[Column]:
    """A registration id of two numbers as these numbers: no two ids have the same. Any other id is an error."""
    def part(n: int) -> Column:
        wrong = F.raise_error(F.concat(F.lit("no registration id of two numbers: "), F.coalesce(id_column, F.lit("NULL"))))
        return F.when(id_column.rlike(_KEYED), F.split_part(id_column, F.lit("-"), F.lit(n)).cast("long")).otherwise(wrong.cast("long"))
    return [part(i + 1).alias(name) for i, name in enumerate(KEY)]


def buckets_for(t: Tables, *, rows: int = ROWS, least: int = LEAST) -> int:
    """So many buckets that one holds about ``rows`` rows of answers, or of payments, however large the tables are."""
    most = max(t.registration_answers.count(), t.payments.count())
    return max(least, -(-most // rows))


def _declare(spark: SparkSession, name: str, folder: str, schema, buckets: int) -> DataFrame:
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) "
              f"INTO {buckets} BUCKETS LOCATION '{folder}'")
    return spark.table(name)


def write_bucketed(t: Tables, folder: str, buckets: int) -> None:
    """Registrations, payments and answers in the same number of buckets of their key, sorted by it: one file per bucket.

    What refers to registrations then meets them bucket by bucket, with no exchange. Choose ``buckets`` so that a bucket of the
    largest table fits a task (``buckets_for``); the number is part of the folder's name, so readers need not be told.
    """
    for name, column in OF_REGISTRATIONS.items():
        frame = getattr(t, name).select("*", *registration_key(F.col(column)))
        table = f"writing_{name}_{re.sub('[^0-9a-zA-Z]', '_', folder)[-60:]}"
        frame.repartition(buckets, *KEY).write.bucketBy(buckets, *KEY).sortBy(*KEY).option("path", f"{folder}/buckets={buckets}/{name}").saveAsTable(table)
        t.spark.sql(f"DROP TABLE {table}")  # the catalog's entry; the files stay


def open_bucketed(t: Tables, folder: str, buckets: int, name: str) -> Tables:
    """``t`` with the tables of ``write_bucketed`` in place of its own, declared in the session's catalog under ``name``."""
    frames = {}
    for table in OF_REGISTRATIONS:
        path = f"{folder}/buckets={buckets}/{table}"
        t.spark.sql(f"DROP TABLE IF EXISTS {name}_{table}")
        frames[table] = _declare(t.spark, f"{name}_{table}", path, t.spark.read.parquet(path).schema, buckets)
    out = t.replaced(**frames)
    out.key = KEY
    return out
