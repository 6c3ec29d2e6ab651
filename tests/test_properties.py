"""Operators against plain Python that replays requests one at a time, on skewed random data."""

import json
import random
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from decimal import Decimal

from pyspark.sql import functions as F

from boxoffice.functions import replies as r
from boxoffice.operators import attendees, engagement, lifecycle, recommend, search, tickets
from boxoffice.operators.base import positions, salted_left_join
from boxoffice.operators.replies import price_parse, verdict_parse
from tests.conftest import listing, reg, rows, ts, user

NOW = datetime(2026, 5, 1, 12, 0, 0)
START = datetime(2026, 1, 1)


def test_positions_of_a_hot_key(spark):
    """Half of all rows share one key and one time; positions still run 1..n in order."""
    data = [("hot" if i % 2 else f"k{i % 7}", i % 3 if i % 2 == 0 else 0, i) for i in range(4000)]
    df = spark.createDataFrame(data, "key string, at long, id long").repartition(8)
    got = positions(df, ["key"], [F.desc("at"), F.asc("id")], "n").collect()
    want = {}
    for key in {k for k, _, _ in data}:
        for n, (_, at, i) in enumerate(sorted((x for x in data if x[0] == key), key=lambda x: (-x[1], x[2])), 1):
            want[i] = n
    assert {x.id: x.n for x in got} == want


def test_salted_join_equals_plain_join(spark):
    facts = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    single = spark.createDataFrame([(0, "a"), (1, "b")], "k long, v string")
    assert rows(salted_left_join(facts, single, "k", "id").fillna("-"), "id", "v") == rows(facts.join(single, "k", "left").fillna("-"), "id", "v")


def _replay_admission(requests, capacity, attendees_, taken):
    verdicts, seats, inside = {}, Counter(), set()
    for u, e in taken:
        seats[e] += 1
        inside.add((u, e))
    for i, u, e, at in sorted(requests, key=lambda x: (x[3], x[0])):
        if u not in attendees_:
            verdicts[i] = "not_allowed"
        elif e not in capacity:
            verdicts[i] = "not_found"
        elif capacity[e] > 0 and seats[e] >= capacity[e]:
            verdicts[i] = "sold_out"
        elif (u, e) in inside:
            verdicts[i] = "duplicate"
        else:
            verdicts[i] = "admitted"
            seats[e] += 1
            inside.add((u, e))
    return verdicts, seats


def test_admission_replays_request_by_request(tables, spark):
    for seed in (1, 2):
        rnd = random.Random(seed)
        capacity = {1: 40, 2: 0, 3: 5, 4: 3, 5: 1000}
        people = range(1, 60)
        t = tables(users=[user(u) for u in people] + [user(900, "creator")],
                   listings=[listing(e, capacity=c) for e, c in capacity.items()] + [listing(6, status="draft")])
        # Listing 1 takes half of all requests; many share one time.
        requests = [(i, rnd.choice([*people, 900]), 1 if rnd.random() < 0.5 else rnd.randint(1, 7), START + timedelta(minutes=rnd.randint(0, 20)))
                    for i in range(600)]
        taken = [] if seed == 1 else [(u, e) for e, n in ((1, 10), (3, 5), (4, 4), (5, 2)) for u in range(1, n + 1)]
        frame = spark.createDataFrame(requests, "id long, user_id long, listing_id long, created_at timestamp_ntz")
        before = spark.createDataFrame(taken, "user_id long, listing_id long") if taken else None
        want, seats = _replay_admission(requests, capacity, set(people), taken)
        got = {x.id: x.verdict for x in tickets.admission(frame, t.listings, t.users, before).collect()}
        assert got == want
        admitted = Counter(e for i, _, e, _ in requests if got[i] == "admitted")
        full = Counter(e for _, e in taken)
        assert all(c == 0 or admitted[e] <= max(0, c - full[e]) for e, c in capacity.items())


def test_thread_requests_replay(spark):
    rnd = random.Random(5)
    existing = [(i, rnd.randint(1, 4), rnd.randint(900, 902), rnd.choice([None, 1, 2])) for i in range(1, 8)]
    asked = [(100 + i, rnd.randint(1, 6), rnd.randint(900, 903), rnd.choice([None, None, 1, 2, 3]), START + timedelta(minutes=rnd.randint(0, 30))) for i in range(200)]
    threads = [(f"T{i}", i, u, c, e) for i, u, c, e in existing]
    want = {}
    for i, u, c, e, at in sorted(asked, key=lambda x: (x[4], x[0])):
        fits = [th for th in threads if th[2] == u and th[3] == c and (e is None or th[4] == e)]
        if fits:
            old = [th for th in fits if th[0][0] == "T"]
            want[i] = min(old or fits, key=lambda th: th[1])[0] if old else fits[0][0]
        else:
            threads.append((f"N{i}", i, u, c, e))
            want[i] = f"N{i}"
    got = engagement.thread_upsert(
        spark.createDataFrame(existing, "id long, user_id long, creator_id long, listing_id long"),
        spark.createDataFrame(asked, "request_id long, user_id long, creator_id long, listing_id long, ts timestamp_ntz"))
    assert {x.request_id: x.thread_key for x in got.collect()} == want


def test_toggles_replay(tables, spark):
    rnd = random.Random(7)
    log = [(i, rnd.randint(1, 5) if i % 2 else 1, 900 if i % 3 else 1, START + timedelta(minutes=rnd.randint(0, 40))) for i in range(300)]
    on, notices = {}, []
    for i, f, c, at in sorted(log, key=lambda x: (x[3], x[0])):
        if f == c:
            continue
        if (f, c) in on:
            del on[(f, c)]
        else:
            on[(f, c)] = at
            notices.append((c, f"n{f} started following you!", at))
    toggles = spark.createDataFrame(log, "event_id long, follower_id long, creator_id long, ts timestamp_ntz")
    assert rows(engagement.follow_state(toggles), "follower_id", "creator_id", "followed_at") == sorted((f, c, at) for (f, c), at in on.items())
    t = tables(users=[user(i) for i in range(6)])
    assert rows(engagement.follow_notices(t, toggles), "user_id", "message", "created_at") == sorted(notices)
    twice = toggles.unionByName(toggles.withColumn("event_id", F.col("event_id") + 1000))
    assert engagement.follow_state(twice).count() == 0


def test_publishing_reaches_who_follows_at_that_moment(tables, spark):
    rnd = random.Random(9)
    toggles = [(i, rnd.randint(1, 6), rnd.choice([900, 901]), START + timedelta(minutes=2 * rnd.randint(0, 100))) for i in range(150)]
    published = [(1000 + i, rnd.choice([1, 2]), rnd.choice(["published", "draft"]), START + timedelta(minutes=2 * rnd.randint(0, 100) + 1)) for i in range(30)]
    want = []
    for i, e, status, at in published:
        on = set()
        for _, f, c, when in sorted(toggles, key=lambda x: (x[3], x[0])):
            if when <= at and c == {1: 900, 2: 901}[e]:
                on ^= {f}
        want += [(i, f) for f in on if status == "published"]
    t = tables(users=[user(900, "creator"), user(901, "creator")], listings=[listing(1), listing(2, creator_id=901)])
    log = spark.createDataFrame(published, "event_id long, listing_id long, status string, ts timestamp_ntz")
    spans = engagement.follow_spans(spark.createDataFrame(toggles, "event_id long, follower_id long, creator_id long, ts timestamp_ntz"))
    assert rows(engagement.publish_fanout(t, log, spans), "event_id", "user_id") == sorted(want)


def test_bans_replay(tables, spark):
    rnd = random.Random(11)
    log = [(i, 1 if i % 3 else rnd.randint(2, 5), rnd.choice(["toggle"] * 4 + ["ban", "unban", "delete"]), START + timedelta(minutes=rnd.randint(0, 60)))
           for i in range(200)]
    state = {u: u == 3 for u in range(1, 7)}
    for _, u, action, _ in sorted(log, key=lambda x: (x[3], x[0])):
        state[u] = (not state[u]) if action == "toggle" else action != "unban"
    t = tables(users=[user(u, is_banned=u == 3) for u in range(1, 7)])
    got = lifecycle.ban_state(t, spark.createDataFrame(log, "event_id long, user_id long, action string, ts timestamp_ntz"))
    assert {x.user_id: x.is_banned for x in got.collect()} == state


def test_recommendations_against_brute_force(tables):
    """Attendee 1 holds nearly everything; attendee 2 holds all of their type."""
    rnd = random.Random(13)
    kinds = ["concert", "comedy", "sports"]
    shows = {i: (rnd.choice(kinds), START + timedelta(days=rnd.randint(0, 40)), rnd.random() < 0.85) for i in range(1, 120)}
    held = {(1, i) for i in shows if i % 11} | {(2, i) for i, s in shows.items() if s[0] == "comedy"}
    held |= {(rnd.randint(3, 25), rnd.choice(list(shows))) for _ in range(300)}
    t = tables(users=[user(u) for u in range(1, 31)] + [user(900, "creator")],
               listings=[listing(i, type=k, created_at=at, status="published" if ok else "draft") for i, (k, at, ok) in shows.items()],
               registrations=[reg(n, u, i) for n, (u, i) in enumerate(sorted(held))] + [reg(9000 + u, u, 1, "cancelled") for u in range(1, 31)])
    import hashlib
    want = []
    for u in range(1, 31):
        mine = {i for v, i in held if v == u}
        counts = Counter(shows[i][0] for i in mine)
        top = min(counts, key=lambda k: (-counts[k], k)) if counts else None
        free = [i for i, (_, _, ok) in shows.items() if ok and i not in mine]
        picks = sorted((i for i in free if top in (None, shows[i][0])), key=lambda i: (-shows[i][1].timestamp(), i))
        fallback = not picks and top is not None
        if fallback:
            picks = sorted(free, key=lambda i: hashlib.sha256(f"{i}:0".encode()).hexdigest())
        want += [(u, n, i, fallback) for n, i in enumerate(picks[:6], 1)]
    assert any(x[3] for x in want) and any(x[0] == 1 for x in want)
    got = recommend.recommendations(t, as_of=NOW)
    assert rows(got, "user_id", "ordinal", "listing_id", "fallback") == sorted(want)
    far = recommend._at_positions.__globals__
    head, far["HEAD"] = far["HEAD"], 2  # positions beyond the broadcast head
    try:
        assert rows(recommend.recommendations(t, as_of=NOW), "user_id", "ordinal", "listing_id", "fallback") == sorted(want)
    finally:
        far["HEAD"] = head


def test_batch_search_against_brute_force(tables, spark):
    rnd = random.Random(17)
    cities = ["New Delhi", "delhi", "Múmbai", "Navi Mumbai", "", None, "Pune"]
    shows = [(i, rnd.choice(["concert", "comedy"]), rnd.choice(cities), Decimal(rnd.choice([0, 5])), START + timedelta(days=rnd.randint(0, 9))) for i in range(200)]
    t = tables(users=[user(900, "creator")], listings=[listing(i, type=k, city=c, price=p, created_at=at) for i, k, c, p, at in shows])
    asked = [(n, k, c, f) for n, (k, c, f) in enumerate(
        [(k, c, f) for k in ("", "concert", "opera") for c in ("", "DELHI", "mumbai", "x", "pun", "i") for f in (True, False)] * 2)]

    def plain(text):
        return (text or "").lower().replace("ú", "u")
    want = []
    for n, k, c, f in asked:
        hits = [s for s in shows if k in ("", s[1]) and (c == "" or plain(c) in plain(s[2])) and (not f or s[3] == 0)]
        hits.sort(key=lambda s: (-s[4].timestamp(), s[0]))
        want += [(n, o, s[0]) for o, s in enumerate(hits[:12], 1)]
    requests = spark.createDataFrame(asked, "request_id long, type string, city string, free_only boolean")
    assert rows(search.batch_search(t, requests), "request_id", "ordinal", "listing_id") == sorted(want)


def _python_reading(text):
    found = re.search(r"\{.*\}", text, re.DOTALL)
    if not found:
        return "none", None
    try:
        return "ok", json.loads(found.group(0))
    except ValueError:
        return "broken", None


def test_replies_read_like_a_strict_json_reader(spark):
    texts = ['{"status": "Safe", "reason": "ok"}', 'x {"status":"Flagged"}\n\ny', "nothing", "{", "} {", "{}", "{'status': 'Safe'}", '{"status": "Safe",}',
             '{"a": 1} {"b": 2}', '{"a": {"b": "}"}} tail', '{"status": null, "price": 12.5}', '{"price": "800", "reason": "r"}', '{"price": 499}\n{', "",
             '{"status": "Saf\\u00e9 \\"q\\""}', "{bad}", '{"a": 1}, {"b": 2}', '[{"price": 3}]', '{"a": 1} trailing }']
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, reply string")
    verdicts = {x.doc_id: (x.status, x.reason) for x in verdict_parse(df).collect()}
    prices = {x.doc_id: (x.price, x.reason) for x in price_parse(df).collect()}
    for i, text in enumerate(texts):
        state, obj = _python_reading(text)
        if state == "none":
            assert verdicts[i] == (r.VERDICT_DEFAULT, r.VERDICT_NO_OBJECT) and prices[i] == (r.PRICE_DEFAULT, text)
        elif state == "broken":
            assert verdicts[i] == (r.VERDICT_DEFAULT, r.VERDICT_BROKEN) and prices[i] == (r.PRICE_DEFAULT, r.PRICE_REASON_BROKEN), text
        else:
            assert verdicts[i] == (obj.get("status", r.VERDICT_DEFAULT), obj.get("reason", text)), text
            price = obj.get("price", r.PRICE_DEFAULT)
            assert prices[i] == (str(price), obj.get("reason", r.PRICE_REASON_DEFAULT)), text


def test_waitlist_promotes_in_order_within_free_seats(tables):
    rnd = random.Random(19)
    waiting = [(i, 1 if i % 2 else rnd.randint(2, 4), rnd.choice(["a", "b", "c", "d", " ", "e "]), START + timedelta(minutes=rnd.randint(0, 9))) for i in range(80)]
    capacity, seats = {1: 4, 2: 0, 3: 2, 4: 9}, {1: 2, 3: 2, 4: 1}
    t = tables(users=[user(1)], listings=[listing(e, capacity=c) for e, c in capacity.items()],
               registrations=[reg(e * 100 + n, 1, e) for e, k in seats.items() for n in range(k)],
               waitlist=[{"id": i, "listing_id": e, "email": m, "created_at": at} for i, e, m, at in waiting])
    queues = defaultdict(list)
    for _, e, m, at in sorted(waiting, key=lambda x: (x[3], x[0])):
        if m.strip() and m.strip() not in queues[e]:
            queues[e].append(m.strip())
    want = [(e, m, n, capacity[e] == 0 or n <= capacity[e] - seats.get(e, 0)) for e, q in queues.items() for n, m in enumerate(q, 1)]
    assert rows(tickets.waitlist_promotion(t), "listing_id", "email", "place", "promoted") == sorted(want)


def test_month_series_add_up(tables):
    from boxoffice.operators import platform
    t = tables(registrations=[reg(i, 1, 1, created_at=START + timedelta(days=i)) for i in range(-5, 370)])
    assert sum(x.registrations for x in platform.registrations_by_month(t, year=2026).collect()) == 365


def test_spend_axis_matches_calendar_arithmetic():
    assert [p.strftime("%m-%d") for p in attendees.spend_axis(datetime(2026, 3, 31))] == ["11-01", "12-01", "12-31", "01-30", "03-01", "03-31"]


def test_fixture_times_are_naive():
    assert ts("2026-01-01").tzinfo is None
