"""Headline numbers with retractions: after every batch they equal the batch report on the newest versions."""

from datetime import datetime, timedelta
from decimal import Decimal

from boxoffice.operators.platform import platform_kpis
from boxoffice.session import new_folder
from boxoffice.streaming import activity, kpis
from tests.conftest import listing, pay, reg, user

SCHEMAS = {
    "users": "id long, role string, created_at timestamp_ntz, ts timestamp_ntz, seq long",
    "listings": "id long, status string, date_start timestamp_ntz, ts timestamp_ntz, seq long",
    "registrations": "id string, status string, ts timestamp_ntz, seq long",
    "payments": "id string, status string, amount decimal(10,2), ts timestamp_ntz, seq long",
}
DAY = datetime(2026, 6, 1)
at = lambda hours: DAY + timedelta(hours=hours)

# Each batch: versions of entities. Later ones withdraw, cancel, refund, and arrive late or twice.
BATCHES = [
    {"users": [(1, "user", at(-100), at(0), 1), (2, "user", at(-400), at(0), 1), (3, "creator", at(0), at(0), 1)],
     "listings": [(10, "published", at(20), at(1), 1), (11, "draft", at(20), at(1), 1), (12, "published", at(50), at(1), 1)],
     "registrations": [("a", "confirmed", at(2), 1), ("b", "pending", at(2), 1)], "payments": [("p", "success", "10.50", at(3), 1), ("q", "pending", "4.00", at(3), 1)]},
    {"users": [], "listings": [(10, "cancelled", at(5), 1), (11, "published", at(5), 1)], "registrations": [("a", "cancelled", at(6), 1), ("c", "confirmed", at(4), 1)],
     "payments": [("p", "refunded", "10.50", at(7), 1), ("q", "success", "4.25", at(7), 1)]},
    {"users": [(2, "creator", at(-400), at(9), 1)], "listings": [(10, "published", at(4), 9), (12, "draft", at(8), 1), (12, "published", at(8), 2)],
     "registrations": [("a", "confirmed", at(5), 9), ("c", "cancelled", at(9), 1), ("c", "cancelled", at(9), 1)], "payments": []},
    {"users": [(4, "user", at(30), at(40), 1)], "listings": [], "registrations": [("c", "confirmed", at(10), 1)], "payments": [("r", "success", "0.10", at(11), 1)]},
]
STARTS = {10: at(20), 11: at(20), 12: at(50)}


def _full(name, row):
    if name == "listings" and len(row) == 4:
        return (row[0], row[1], STARTS[row[0]], *row[2:])
    return (*row[:2], Decimal(row[2]), *row[3:]) if name == "payments" else row


def _expected(tables, batches, as_of):
    newest = {}
    for batch in batches:
        for name, given in batch.items():
            for row in (_full(name, r) for r in given):
                if row[-2:] >= newest.get((name, row[0]), row)[-2:]:
                    newest[name, row[0]] = row
    rows = lambda name: [r for (n, _), r in newest.items() if n == name]
    t = tables(users=[user(r[0], r[1], created_at=r[2]) for r in rows("users")], listings=[listing(r[0], status=r[1], date_start=r[2]) for r in rows("listings")],
               registrations=[reg(r[0], 1, 10, r[1]) for r in rows("registrations")], payments=[pay(r[0], r[2], r[1]) for r in rows("payments")])
    return platform_kpis(t, as_of=as_of).first().asDict()


def test_retractions_over_batches_restarts_and_a_broken_compaction(spark, tables):
    source, path = new_folder(spark, "changes"), new_folder(spark, "kpis")
    makers = {"users": kpis.user_changes, "listings": kpis.listing_changes, "registrations": kpis.registration_changes, "payments": kpis.payment_changes}
    for n, batch in enumerate(BATCHES):
        for name, given in batch.items():
            spark.createDataFrame([_full(name, r) for r in given], SCHEMAS[name]).coalesce(1).write.mode("append").parquet(f"{source}/{name}")
        changes = None
        for name, make in makers.items():
            read = activity.read_stream(spark, f"{source}/{name}", spark.read.parquet(f"{source}/{name}").schema)
            changes = make(read) if changes is None else changes.unionByName(make(read))
        kpis.kpi_stream(changes, f"{path}/rows", f"{path}/progress", compact_every=2).awaitTermination()  # a restart per batch
        for as_of in (at(12), at(60), at(24 * 6 + 30), at(24 * 30)):
            got = kpis.kpi_report(kpis.stored_deltas(spark, f"{path}/rows"), as_of=as_of).first().asDict()
            assert got == _expected(tables, BATCHES[: n + 1], as_of), (n, as_of)
    # a compaction that broke off before it was whole is not read
    before = kpis.kpi_report(kpis.stored_deltas(spark, f"{path}/rows"), as_of=at(12)).first()
    spark.createDataFrame([("total_users", 0, 1000)], kpis.DELTA).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(
        f"{path}/rows/base=900/version=900")
    assert kpis.kpi_report(kpis.stored_deltas(spark, f"{path}/rows"), as_of=at(12)).first() == before


def test_nothing_yet(spark):
    got = kpis.kpi_report(kpis.stored_deltas(spark, new_folder(spark, "none")), as_of=DAY).first()
    assert set(got.asDict().values()) == {0}


def test_a_batch_is_folded_by_joins_and_writes_what_changed(spark):
    """No call and no state row per entity: what a batch changes is written with what it replaces, and read for its sums."""
    source, path = new_folder(spark, "changes"), new_folder(spark, "kpis")
    for n, given in enumerate(([("a", "confirmed", at(2), 1), ("b", "pending", at(2), 1), (None, "pending", at(2), 1)], [("a", "cancelled", at(3), 1), (None, "cancelled", at(3), 1)])):
        spark.createDataFrame(given, SCHEMAS["registrations"]).coalesce(1).write.mode("append").parquet(source)
        read = activity.read_stream(spark, source, spark.read.parquet(source).schema)
        query = kpis.kpi_stream(kpis.registration_changes(read), f"{path}/rows", f"{path}/progress")
        query.awaitTermination()
        assert not query.lastProgress["stateOperators"]
        held = spark.read.schema(kpis.HELD).parquet(f"{path}/rows/held/base=0/version={n}").collect()
        assert {(r["entity"], r["now"]["kpi"], r["was"] and r["was"]["kpi"]) for r in held} == (
            {(e, "total_registrations", None) for e in ("registration a", "registration b", None)} if n == 0 else
            {(e, "", "total_registrations") for e in ("registration a", None)})
    assert kpis.kpi_report(kpis.stored_deltas(spark, f"{path}/rows"), as_of=DAY).first()["total_registrations"] == 1


def test_versions_without_a_moment_neither_win_nor_lose(spark):
    """What came first stays if it has no moment; otherwise such versions are passed over, and those without a seq likewise at the newest moment."""
    given = [("a", None, 1, "x"), ("a", 5, 1, "y"), ("b", 5, 1, "x"), ("b", None, 9, "y"), ("c", 5, 1, "x"), ("c", 7, None, "y"), ("c", 7, 3, "z"),
             ("d", 7, 3, "x"), ("d", 7, None, "y"), ("d", 7, 4, "z"), ("d", 6, 9, "v")]
    changes = spark.createDataFrame(given, "entity string, ts long, seq long, kpi string").coalesce(1).selectExpr("*", "1L amount", "'' dated", "0 day")
    assert {r["entity"]: r["now"]["kpi"] for r in kpis._newest(changes, None).collect()} == {"a": "x", "b": "x", "c": "y", "d": "z"}
