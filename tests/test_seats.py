"""Seats over time against a plain loop."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest

from boxoffice.operators import seats
from tests.conftest import rows

EVENTS = "id string, listing_id long, kind string, ts timestamp_ntz"
SHOWS = "listing_id long, capacity int, waiting_places int"


def plain(events, shows):
    fates, state = {}, {}
    places = {s[0]: s for s in shows}
    for id, show, kind, ts in sorted(events, key=lambda e: (e[3], e[0])):
        if show not in places:
            continue
        _, capacity, room = places[show]
        held, queue = state.setdefault(show, [0, deque(), 0])[:2]
        if kind == "request":
            if capacity == 0 or held < capacity:
                state[show][0] += 1
                fates[id] = ("admitted", ts)
            elif len(queue) < room:
                queue.append(id)
                fates[id] = ("waiting", None)
            else:
                fates[id] = ("sold_out", None)
        elif queue:
            fates[queue.popleft()] = ("promoted", ts)
        elif held:
            state[show][0] -= 1
        state[show][2] = max(state[show][2], len(queue))
    return fates, {s: (held, len(queue), most) for s, (held, queue, most) in state.items()}


def some_events(n, shows, seed):
    """One listing holds half of all events; moments tie."""
    rng = random.Random(seed)
    start = datetime(2026, 1, 1)
    return [(f"e{i:05d}", shows[0] if rng.random() < 0.5 else rng.choice(shows), "request" if rng.random() < 0.6 else "release",
             start + timedelta(minutes=rng.randrange(n // 3))) for i in range(n)]


@pytest.mark.parametrize("block", [2, 5, 64])
def test_equals_a_plain_loop(spark, block):
    shows = [(1, 7, 5), (2, 3, 0), (3, 0, 4), (4, 1, 100), (5, 2, 1)]
    events = [*some_events(900, [1, 2, 3, 4, 5], block), ("x", 99, "request", datetime(2026, 1, 1))]
    moves = seats.seat_moves(spark.createDataFrame(events, EVENTS).repartition(6), spark.createDataFrame(shows, SHOWS), block)
    fates, state = plain(events, shows)
    assert {r["id"]: (r["verdict"], r["seated_at"]) for r in seats.seat_history(moves).collect()} == fates
    assert {f for f, _ in fates.values()} == {"admitted", "waiting", "promoted", "sold_out"}
    assert rows(seats.seat_state(moves), "listing_id", "held", "waiting", "most_waiting") == sorted((s, *v) for s, v in state.items())


def test_no_events(spark):
    moves = seats.seat_moves(spark.createDataFrame([], EVENTS), spark.createDataFrame([(1, 2, 3)], SHOWS))
    assert seats.seat_history(moves).collect() == [] and seats.seat_state(moves).collect() == []


def test_freed_seats_go_down_the_list_in_order(spark):
    at = lambda h: datetime(2026, 1, 1, h)
    events = [("a", 1, "request", at(1)), ("b", 1, "request", at(2)), ("c", 1, "request", at(3)), ("d", 1, "request", at(4)), ("x", 1, "release", at(5)),
              ("e", 1, "request", at(6)), ("y", 1, "release", at(7)), ("z", 1, "release", at(8)), ("w", 1, "release", at(9)), ("v", 1, "release", at(10)),
              ("f", 1, "request", at(11))]
    moves = seats.seat_moves(spark.createDataFrame(events, EVENTS), spark.createDataFrame([(1, 1, 2)], SHOWS))
    assert rows(seats.seat_history(moves), "id", "verdict", "seated_at") == [
        ("a", "admitted", at(1)), ("b", "promoted", at(5)), ("c", "promoted", at(7)), ("d", "sold_out", None), ("e", "promoted", at(8)), ("f", "admitted", at(11))]
