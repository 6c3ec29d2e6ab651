"""The set of marketplace tables that every operator takes as its input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from boxoffice.schema import SCHEMAS


class Tables:
    """Lazily built tables, reached as attributes (``t.users``, ``t.listings``...).

    A table is a zero-argument function until first use, so a query only builds what it reads. ``key`` names the columns by
    which answers and payments refer to registrations; a stored layout may bring shorter ones than the id (``layout``).
    """

    def __init__(self, spark: SparkSession, makers: dict[str, Callable[[], DataFrame]], key: tuple[str, ...] = ("registration_id",)):
        self.spark, self.key = spark, key
        self._makers = dict(makers)
        self._built: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._makers:
            raise AttributeError(f"no table {name!r}")
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __contains__(self, name: str) -> bool:
        return name in self._makers

    def replaced(self, **frames: DataFrame) -> Tables:
        """A copy in which some tables are swapped for the given frames."""
        makers = dict(self._makers)
        for name, frame in frames.items():
            makers[name] = lambda frame=frame: frame
        return Tables(self.spark, makers, self.key)

    @classmethod
    def of(cls, spark: SparkSession, **frames: DataFrame) -> Tables:
        return cls(spark, {}).replaced(**frames)

    @classmethod
    def from_parquet(cls, spark: SparkSession, folder: str) -> Tables:
        """The native layout: one Parquet folder per table, read with a declared schema."""
        def reader(name: str) -> Callable[[], DataFrame]:
            return lambda: spark.read.schema(SCHEMAS[name]).parquet(f"{folder}/{name}")
        return cls(spark, {name: reader(name) for name in SCHEMAS})
