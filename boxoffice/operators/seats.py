"""Seats over time: requests, releases and a bounded waiting list, per listing in order.

A listing's level is the number of people who hold a seat or wait for one. A request adds one unless the level has reached
seats and waiting places together; a release takes one off unless nobody is there. Each event is thus a step
``least(greatest(level + add, low), high)``, and steps of this form compose to a step of this form. So levels come from a
tree of blocks: a block's steps are composed to one, blocks of blocks likewise up to one per listing, and back
down every block starts from the level that the blocks before it leave. No task ever sees more than ``BLOCK`` steps of
a listing at a time, however many it has.

How many requests were turned away depends on the level a block is entered at as ``over + greatest(level - at, 0)``, a form that
composes as well, so the requests taken in are counted on the same way down. Whoever waits is served in order of arrival: the
k-th seat given in a listing is for the k-th request taken in, and as many seats were given as requests were taken in, less those waiting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.operators.base import positions
from boxoffice.session import materialize

BLOCK = 64
UNLIMITED = 1 << 40
REQUEST, RELEASE = "request", "release"
STEP = ("add", "low", "high", "over", "at", "asks")


def _step(level: Column, step: Column) -> Column:
    return F.least(F.greatest(level + step["add"], step["low"]), step["high"])


def _composed(steps: Column) -> Column:
    """All steps of a block as one."""
    free = F.struct(*(F.lit(v).cast("long").alias(c) for c, v in zip(STEP, (0, -UNLIMITED, UNLIMITED, 0, UNLIMITED, 0))))
    above = lambda level, step: F.greatest(level - step["at"], F.lit(0))
    return F.aggregate(steps, free, lambda first, then: F.struct(
        (first["add"] + then["add"]).alias("add"), _step(first["low"], then).alias("low"), _step(first["high"], then).alias("high"),
        (first["over"] + then["over"] + above(first["low"], then)).alias("over"),
        (first["at"] + above(first["low"], then) - above(first["high"], then)).alias("at"), (first["asks"] + then["asks"]).alias("asks")))


def _levels(level: Column, taken: Column, steps: Column) -> Column:
    """The level, and the requests taken in, before each step of a block that is entered with these."""
    none = F.array().cast("array<bigint>")
    start = F.struct(level.alias("level"), taken.alias("taken"), none.alias("levels"), none.alias("takens"))
    return F.aggregate(steps, start, lambda state, step: F.struct(
        _step(state["level"], step).alias("level"),
        (state["taken"] + step["asks"] - step["over"] - F.greatest(state["level"] - step["at"], F.lit(0))).alias("taken"),
        F.concat(state["levels"], F.array(state["level"])).alias("levels"), F.concat(state["takens"], F.array(state["taken"])).alias("takens")))


def running_levels(events: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """``events`` (keys, place from 1 without gaps, ``STEP``) to keys, place, the level and the requests taken in before the event; keys
    start at 0."""
    keys = list(keys)
    most = events.agg(F.max("place")).first()[0] or 0
    floors, rows = [], events.select(*keys, (F.col("place") - 1).cast("long").alias("n"), *STEP)
    while True:
        blocks = rows.groupBy(*keys, F.expr(f"n div {block}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", *STEP))).alias("steps"))
        floors.append(materialize(blocks, "seat-blocks"))
        if most <= block:
            break
        most = -(-most // block)
        rows = floors[-1].select(*keys, F.col("block").alias("n"), _composed(F.col("steps")).alias("s")).select(*keys, "n", "s.*")
    zero = F.lit(0).cast("long")
    entries = floors[-1].select(*keys, "block", zero.alias("level"), zero.alias("taken"))
    for blocks in reversed(floors):
        walked = blocks.join(entries, [*keys, "block"]).select(*keys, "steps", _levels(F.col("level"), F.col("taken"), F.col("steps")).alias("w"))
        entries = walked.select(*keys, F.inline(F.arrays_zip(F.col("steps.n").alias("block"), F.col("w.levels").alias("level"), F.col("w.takens").alias("taken"))))
    return entries.select(*keys, (F.col("block") + 1).alias("place"), "level", "taken")


def _event_step(kind: Column, high: Column) -> list[Column]:
    """A request or release as a step; a release meets no upper bound, for the level never exceeds that of the requests."""
    asks, long = kind == REQUEST, lambda v: F.lit(v).cast("long")
    values = (F.when(asks, long(1)).otherwise(long(-1)), long(0), F.when(asks, high).otherwise(long(UNLIMITED)), long(0),
              F.when(asks, high - 1).otherwise(long(UNLIMITED + 1)), F.when(asks, long(1)).otherwise(long(0)))
    return [v.alias(c) for c, v in zip(STEP, values)]


def _walk(level: Column, events: Column, room: int) -> Column:
    """The level before each event of a block, times ``room``, plus the requests the block has taken in until then: one number each."""
    def then(was: Column, event: Column) -> Column:
        asked = F.when(was < event["high"] * room, was + (room + 1)).otherwise(was)
        return F.when(event["kind"] == REQUEST, asked).otherwise(F.when(was >= room, was - room).otherwise(was))
    walked = F.aggregate(events, F.array(level * room), lambda out, event: F.concat(out, F.array(then(F.element_at(out, -1), event))))
    return F.slice(walked, 1, F.size(events))


def seat_moves(events: DataFrame, listings: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every event with its place (ascending in its listing, with gaps), the level before it, the listing's seats, whether a request was
    taken in and a seat was given at it, and how many of either there were with it (``entered``, ``served``).

    ``events``: id, listing_id, kind (request or release), ts, in order of (ts, id). ``listings``: listing_id, capacity (0: no limit) and
    waiting_places. Events of other listings are left out. Blocks are cut from the sorted slices, so no event is numbered or
    joined by itself; what is stored is the sorted events. Whoever reads the moves more than once stores them.
    """
    seats = F.when(F.col("capacity") > 0, F.col("capacity").cast("long")).otherwise(F.lit(UNLIMITED))
    shows = listings.select("listing_id", seats.alias("seats"), F.least(seats + F.col("waiting_places"), F.lit(UNLIMITED)).alias("high"))
    known = events.select("id", "listing_id", "kind", "ts").join(shows, "listing_id")
    order = ("listing_id", "ts", "id")
    placed = materialize(
        known.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "seat-events")
    key = ["listing_id", "block"]
    cut = placed.withColumn("block", F.expr(f"place div {block}"))
    units = lambda events: F.transform(events, lambda e: F.struct(*_event_step(e["kind"], e["high"])))
    brief = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "kind", "high"))).alias("events"))
    # stored, for the slices of ``positions`` are chosen from a sample: every block would be composed twice
    heads = materialize(brief.select(*key, _composed(units(F.col("events"))).alias("s")).select(*key, "s.*"), "seat-heads")
    numbered = positions(heads, ["listing_id"], [F.asc("block")], "place")
    entries = numbered.select("listing_id", "place", "block").join(running_levels(numbered, ["listing_id"], block), ["listing_id", "place"])
    blocks = cut.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "id", "kind", "ts", "seats", "high"))).alias("events"))
    walked = blocks.join(entries.select(*key, "level", "taken"), key).select("listing_id", "events", "taken", _walk(F.col("level"), F.col("events"), 2 * block).alias("w"))
    moves = walked.select("listing_id", "taken", F.inline(F.arrays_zip("events", "w"))).select(
        "listing_id", "events.*", F.expr(f"w div {2 * block}").alias("level"), (F.col("taken") + F.col("w") % (2 * block)).alias("before"))
    asks, level, high = F.col("kind") == REQUEST, F.col("level"), F.col("high")
    taken = asks & (level < high)
    entered = F.col("before") + F.when(taken, 1).otherwise(0)
    return moves.withColumns({
        "taken": taken, "given": F.when(asks, level < F.col("seats")).otherwise(level > F.col("seats")),
        "entered": entered, "served": entered - F.greatest(_after() - F.col("seats"), F.lit(0))}).drop("before")


def _after() -> Column:
    """The level after an event."""
    return F.least(F.greatest(F.col("level") + F.when(F.col("kind") == REQUEST, 1).otherwise(-1), F.lit(0)), F.col("high"))


def seat_history(moves: DataFrame) -> DataFrame:
    """The fate of every request of ``seat_moves``: admitted at once, promoted when a seat came free, waiting still, or sold_out.
    Stores what it needs of the moves, and joins only those who waited with the seats that came free."""
    asks = F.col("kind") == REQUEST
    moves = materialize(moves.filter(asks | F.col("given")).select(
        "listing_id", F.when(asks, F.col("id")).alias("id"), "ts", asks.alias("asks"), "taken", "given",
        F.when(asks, F.col("entered")).otherwise(F.col("served")).alias("turn")), "seat-moves")
    queue = moves.filter("asks and taken and not given").select("id", "listing_id", "ts", "turn")
    freed = moves.filter("not asks").select("listing_id", F.col("ts").alias("seated_at"), "turn")
    later = queue.join(freed, ["listing_id", "turn"], "left").select(
        "id", "listing_id", "ts", F.when(F.col("seated_at").isNotNull(), "promoted").otherwise("waiting").alias("verdict"), "seated_at")
    at_once = moves.filter("asks and (given or not taken)").select(
        "id", "listing_id", "ts", F.when(F.col("given"), "admitted").otherwise("sold_out").alias("verdict"), F.when(F.col("given"), F.col("ts")).alias("seated_at"))
    return at_once.unionByName(later)


def seat_state(moves: DataFrame) -> DataFrame:
    """Per listing with events: seats held and people waiting after the last event, the most that ever waited, and requests by fate."""
    asks = F.col("kind") == REQUEST
    waiting = lambda level: F.greatest(level - F.col("seats"), F.lit(0))
    return moves.withColumn("after", _after()).groupBy("listing_id").agg(
        F.max_by(F.least("after", "seats"), "place").alias("held"), F.max_by(waiting(F.col("after")), "place").alias("waiting"),
        F.max(waiting(F.col("after"))).alias("most_waiting"), F.count_if(asks & F.col("given")).alias("admitted"),
        F.count_if(~asks & F.col("given")).alias("promoted"), F.count_if(asks & ~F.col("taken")).alias("sold_out"))
