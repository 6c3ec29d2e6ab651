"""What a query holds and moves must not outgrow its input: plans and results of the parts that were rebuilt for size."""

import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from boxoffice.functions.text import folded
from boxoffice.operators import base, integrity, lifecycle, seats, tickets
from boxoffice.sources import derived
from tests.conftest import listing, reg, rows, ts, user

EDITS = ("edit_id string, listing_id long, ts timestamp_ntz, title string, type string, description string, date_start timestamp_ntz, "
         "date_end timestamp_ntz, venue string, city string, capacity int, price decimal(10,2), banner string")


def _ran(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def _edits(spark):
    """Moments tie and are missing, and most edits bring no banner."""
    rng = random.Random(3)
    made = [(f"e{i:03d}", rng.choice([1, 2, 3, None]), rng.choice([None, ts("2026-01-01"), ts("2026-01-02"), ts("2026-01-03")]), f"t{i}", "x", None,
             None, None, None, None, i, None, rng.choice([None, None, f"b{i}"])) for i in range(60)]
    made += [("only", 4, None, "late", "x", None, None, None, None, None, 7, None, None)]
    return made, spark.createDataFrame(made, EDITS).repartition(5)


def test_edits_are_cut_to_the_last_moments_before_whole_rows_are_sorted(spark, tables):
    made, edits = _edits(spark)
    t = tables(listings=[listing(i, capacity=1) for i in range(1, 6)])
    got = lifecycle.listing_latest(t, edits)
    order = lambda e: (e[2] is not None, e[2] or datetime.min, e[0])
    want = []
    for i in range(1, 6):
        mine = sorted((e for e in made if e[1] == i), key=order)
        banners = [e[12] for e in mine if e[12]]
        want.append((i, mine[-1][0] if mine else None, mine[-1][3] if mine else f"t{i}", banners[-1] if banners else None))
    assert rows(got, "listing_id", "edit_id", "title", "banner") == want
    plan = _ran(got)
    assert "ShuffledHashJoin" in plan[plan.index("max_by("):]  # below the fold of whole rows, past the streamed moments


def test_seats_join_no_event_and_number_none(spark, monkeypatch):
    """Only the heads of blocks are numbered, and only those who waited meet the seats that came free."""
    numbered, real = [], seats.positions
    monkeypatch.setattr(seats, "positions", lambda frame, *a: numbered.append(frame.count()) or real(frame, *a))
    start = datetime(2026, 1, 1)
    events = [(f"e{i:05d}", 1, "release" if i % 3 == 2 else "request", start + timedelta(minutes=i)) for i in range(3000)]
    frame = spark.createDataFrame(events, "id string, listing_id long, kind string, ts timestamp_ntz")
    moves = seats.seat_moves(frame, spark.createDataFrame([(1, 5, 9)], "listing_id long, capacity int, waiting_places int"))
    found = seats.seat_history(moves)
    assert found.count() == 2000
    assert sum(numbered) <= 3000 // seats.BLOCK + 200  # blocks of the sorted slices, not the 3,000 events
    counts = {r["verdict"]: r["count"] for r in found.groupBy("verdict").count().collect()}
    state = seats.seat_state(moves).first()
    assert (counts["admitted"], counts["promoted"], counts["sold_out"]) == (state.admitted, state.promoted, state.sold_out)
    assert counts["waiting"] == state.waiting


def test_scans_are_read_and_joined_once(spark, tables):
    t = tables(users=[user(1)], listings=[listing(1), listing(2, 901)], registrations=[
        reg(1, 1, 1), reg(2, 1, 1, checked_in=True), reg(3, 1, 1, status="pending"), reg(4, 1, 2)])
    at = lambda h: datetime(2026, 6, 1, h)
    scans = spark.createDataFrame([
        ("a", 900, "C1", 1, at(2)), ("b", 900, "C1", 1, at(1)), ("c", 900, "C2", 1, at(1)), ("d", 900, "C3", 1, at(1)), ("e", 900, "C9", 1, at(1)),
        ("f", 900, "C4", 2, at(1)), ("g", 900, "C4", 7, at(1)), ("h", 900, None, 1, at(1)), ("i", 900, "C1", None, at(1)), ("j", None, "C4", 2, None),
    ], "scan_id string, scanner_id long, ticket_code string, listing_id long, ts timestamp_ntz")
    got = tickets.checkin_verdicts(t, scans)
    assert rows(got, "scan_id", "verdict") == [
        ("a", "already"), ("b", "success"), ("c", "already"), ("d", "status"), ("e", "invalid"), ("f", "unauthorized"), ("g", "unauthorized"),
        ("h", "missing"), ("i", "missing"), ("j", "success")]
    assert "creator_id" not in _ran(got)  # what joined listings and registrations is stored


def test_repeated_scans_are_found_among_numbers(spark):
    """The scans are those that comparing their texts leaves, also where numbers are missing or repeated an hour later."""
    rng = random.Random(5)
    shipped = [None, *(datetime(2026, 1, 1, h, m) for h in (1, 2) for m in (0, 30))]
    lines = [(rng.choice([None, 1, 5, 10]), rng.choice([None, 5, 15, 25]), rng.choice([None, 1, 7]), rng.choice([None, 1.0, 7.0, 7.5]), rng.choice(shipped))
             for _ in range(3000)]
    line = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_shipdate timestamp_ntz")
    shows = spark.createDataFrame([(5, 900), (5, 900), (15, None), (25, 901), (25, 902), (None, 903)], "id long, creator_id long")
    text = derived.scan_rows(line, shows).distinct()
    found = derived.scans(line, shows)
    assert text.exceptAll(found).count() == found.exceptAll(text).count() == 0 and found.count() > 100
    keys = re.findall(r"HashAggregate\(keys=\[([^]]*)\]", _ran(found))
    assert any("l_orderkey" in k and "scan_id" not in k for k in keys)


def test_first_requests_are_found_once(spark, tables):
    t = tables(users=[user(i) for i in range(1, 5)], listings=[listing(1, capacity=2), listing(2, capacity=0)])
    made = [("a", 1, 1), ("b", 1, 1), ("c", 2, 1), ("d", 3, 1), ("e", 3, 2), ("f", 900, 2), ("g", 4, 9)]
    requests = spark.createDataFrame([(i, u, e, datetime(2026, 1, 1, n)) for n, (i, u, e) in enumerate(made)],
                                     "id string, user_id long, listing_id long, created_at timestamp_ntz")
    got = tickets.admission(requests, t.listings, t.users)
    assert rows(got, "id", "verdict") == [("a", "admitted"), ("b", "duplicate"), ("c", "admitted"), ("d", "sold_out"), ("e", "admitted"),
                                          ("f", "not_allowed"), ("g", "not_found")]
    assert "row_number() windowspecdefinition(user_id" not in _ran(got)  # the first requests are stored


def test_plain_keys_are_compared_without_the_collation(spark, tables):
    """Repeats are those that the collation finds, but it compares only what is not plain and what equals that."""
    pool = ["ab", "AB", "ab ", "áb", "ÁB ", "cd", "çd", "x\ty", "x y", "x\x01 y", "", " ", "\x01", "é", "E", "ﬁ", "FI", "ß", "ss", "1|2", "a\n", "a"]
    rng = random.Random(2)
    for _ in range(5):
        made = [(n, w, rng.choice([1, 1, 2])) for n in (1, 2) for w in rng.sample(pool, 14)]
        keys = spark.createDataFrame(made, "number int, key string, n long")
        got = integrity._repeated(keys).groupBy("number").agg(F.sum("violations").alias("v"))
        want = keys.groupBy("number", folded(F.col("key"))).agg(F.sum("n").alias("n")).filter("n > 1").groupBy("number").agg(F.count("*").alias("v"))
        assert rows(got, "number", "v") == rows(want, "number", "v")
    t = tables(users=[user(i) for i in range(50)])
    plan = _ran(integrity.integrity_audit(t)).split("== Initial Plan ==")[0]
    assert "HashAggregate(keys=[number" in plan and "LeftSemi" not in plan  # nothing that is not plain: no plain key meets the collation


def test_answers_are_shuffled_once(spark, tables, monkeypatch):
    """Fields folded side by side give the maps of fields folded one by one, ties and missing values included."""
    rng = random.Random(4)
    made = [{"id": rng.choice([None, 1, 2, 3]), "registration_id": rng.choice([None, *range(12)]), "question_key": rng.choice(["qty", "é", "", "meal"]),
             "answer": rng.choice([None, "", "a", "b"])} for _ in range(300)]
    t = tables(users=[user(1)], listings=[listing(1)], registrations=[reg(i, 1, 1) for i in range(12)], registration_answers=made)
    folded_maps = lambda: sorted((str(r.registration_id), list(r.fields.items())) for r in tickets.answers_map(t).collect())
    got = folded_maps()
    assert "question_key" not in "".join(re.findall(r"Exchange hashpartitioning.*", _ran(tickets.answers_map(t))))
    monkeypatch.setattr(base, "FIELDS", 3)  # more fields than are folded side by side
    assert "question_key" in "".join(re.findall(r"Exchange hashpartitioning.*", _ran(tickets.answers_map(t))))
    assert got == folded_maps() and len(got) == 13
    assert tickets.ticket_detail(t).count() == tickets.attendee_list(t).count() == 12
