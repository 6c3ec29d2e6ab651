"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share by weight of all words, at most ``CAP`` times its own size; what the cap cuts off is
shared again by weight. Every document first gets the certain whole copies, ``floor(target / size of the source)``. The
rest of the target is a sample without replacement: documents are ranked by random odds divided by inclusion odds, and
taken in that order until the words are used up (the last one only if that comes nearer). Random numbers are digests
of id and text, so reruns and replayed tasks agree. An optional preference multiplies a document's inclusion odds.

Plan. Sizes and ranks are written once as a narrow table. The cut in a source's ranking is found in two steps, first over
counts per slice of the rank (about the square root of all rows), then within the one slice that holds it, so no task
sorts a whole source. Then each row decides for itself by comparison with its source's cut.

Rows with equal id and text are numbered, and the number enters the digest from the second on: each has a random number of
its own, so the cut can fall between them. Only such rows are shuffled for it, by ranges, however many are equal.

Defined results: a null text has size 0; null sources are one source, the last; rows with equal id and text are taken or left
one by one, in the order of their other columns; a source without words has target 0; other columns pass through or are ignored.
Runs jobs while it is built.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.text import WHITE, fresh
from boxoffice.operators.base import positions
from boxoffice.session import materialize

WEIGHTS = (5, 2, 1)
CAP = 3


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WHITE)), F.lit(0)).cast("long")


def uniform(doc_id: Column, text: Column, repeat: Column) -> Column:
    """A number in (0, 1) that depends on id, text and the number of the repeat alone."""
    again = F.when(repeat > 1, F.concat(F.lit("|"), repeat.cast("string"))).otherwise(F.lit(""))
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")), again).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def numbered_repeats(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the number of each row among those of equal id and text: 1 but for repeats."""
    columns = docs.columns
    key, row, order, tie = (fresh([*columns, name], c) for c in ("mix_key", "mix_row", "mix_order", "mix_tie"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    often = materialize(keyed.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key), "mix-repeats")
    if often.isEmpty():
        return docs.withColumn(name, F.lit(1).cast("long"))
    packed = keyed.join(often, key, "left_semi").select(key, F.xxhash64(*(F.col(f"`{c}`") for c in columns)).alias(order),
        F.monotonically_increasing_id().alias(tie), F.struct(*(F.col(f"`{c}`") for c in columns)).alias(row))  # the tie lets a range end among equal rows
    many = positions(packed, [key], [F.col(order), F.col(tie)], name).select(f"{row}.*", F.col(name).cast("long").alias(name))
    return keyed.join(often, key, "left_anti").drop(key).withColumn(name, F.lit(1).cast("long")).unionByName(many)


def source_key(source: Column) -> Column:
    """Never null; sorts by code point with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size) to source, source_size, target, whole (certain copies), rest (words to sample).

    One row per source passes through one task here.
    """
    turn = F.row_number().over(Window.orderBy("source")) - 1
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn % len(weights) + 1).cast("int"))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "source")
    before = F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    everything = F.sum("source_size").over(Window.partitionBy())
    levels = sizes.withColumn("weight", weight).withColumn("level", (everything - cap * before) / after)
    # the first source, from the tightest cap on, that the level of those left does not fill
    fits = F.when(F.col("level") * F.col("weight") <= cap * F.col("source_size"), F.col("level"))
    level = F.first(fits, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("common") * F.col("weight"), (cap * F.col("source_size")).cast("double"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    return levels.withColumn("common", level).withColumn("target", target).withColumn("whole", whole).select(
        "source", "source_size", "target", "whole", (F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"))


def pareto_rank(u: Column, at=F.col, preference: Column | None = None) -> Column:
    """The rank (odds of ``u`` over the odds of inclusion) as a number in (0, 1), null where nothing is sampled.

    ``at`` gives the columns rest and source_size of the row's source.
    """
    chance = at("rest") / at("source_size")
    odds = (u / (1 - u)) / (chance / (1 - chance))
    odds = odds / preference if preference is not None else odds
    return F.when(at("rest") > 0, odds / (1 + odds))


def sample_plan(rows: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """Per source: source_size, target, whole, rest, and the last rank and id taken (cut, cut_id).

    ``rows``: source, doc_id, size, u, and optionally preference.
    """
    preference = F.col("preference") if "preference" in rows.columns else None
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    plan = materialize(targets(sums.select("source", "source_size"), weights, cap), "mix-targets")
    slices = 1 << math.ceil(math.log2(math.sqrt(max(1, rows.count())) + 1))
    ranked = rows.join(plan.filter("rest > 0"), "source").withColumn("rank", pareto_rank(F.col("u"), preference=preference)).withColumn(
        "slice", F.floor(F.col("rank") * slices))
    upto = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("source", "slice").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    edge = counts.withColumn("before", F.coalesce(F.sum("words").over(upto), F.lit(0))).filter(
        "before < rest and before + words >= rest").select("source", "slice", "before")
    edge = materialize(edge.groupBy("source").agg(F.min("slice").alias("slice"), F.min_by("before", "slice").alias("before")), "mix-edges")
    units = ranked.join(edge, ["source", "slice"]).groupBy("source", "rank", "doc_id").agg(
        F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    order = Window.partitionBy("source").orderBy("rank", "doc_id")
    run = F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("before")
    taken = units.withColumn("run", run).filter("run - rest <= rest - (run - words)")
    cut = taken.groupBy("source").agg(F.max(F.struct("rank", "doc_id")).alias("last"))
    # if not even the first of the slice is taken, the slices before it still are
    cut = edge.join(cut, "source", "left").select(
        "source", F.coalesce("last.rank", F.col("slice") / slices).alias("cut"),
        F.col("last.doc_id").alias("cut_id"), F.col("last").isNotNull().alias("within"))
    return materialize(plan.join(cut, "source", "left"), "mix-plan")


def copies(rank: Column, doc_id: Column, at=F.col) -> Column:
    """How often the mix takes a row; ``at`` gives the columns of ``sample_plan``."""
    earlier = doc_id.isNull() | (at("cut_id").isNotNull() & (doc_id <= at("cut_id")))
    sampled = (rank < at("cut")) | ((rank == at("cut")) & at("within") & earlier)
    return at("whole") + F.coalesce(sampled, F.lit(False)).cast("int")


def _rows(docs: DataFrame, repeat: str) -> DataFrame:
    return docs.select("doc_id", source_key(F.col("source")).alias("source"), words_in(F.col("text")).alias("size"),
                       uniform(F.col("doc_id"), F.col("text"), F.col(repeat)).alias("u"))


def mixed_sizes(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes) of every row."""
    rows = materialize(_rows(numbered_repeats(docs.select("doc_id", "source", "text"), "repeat"), "repeat"), "mix-sizes")
    joined = rows.join(sample_plan(rows, weights, cap), "source")
    return joined.select("doc_id", "size", "source_size", "target",
                         (F.col("size") * copies(pareto_rank(F.col("u")), F.col("doc_id"))).alias("taken"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, cap: int = CAP) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, all columns."""
    own, key, turn, repeat = (fresh(docs.columns, c) for c in ("mix_plan", "mix_key", "mix_turn", "mix_repeat"))
    numbered = numbered_repeats(docs, repeat)
    plan = sample_plan(materialize(_rows(numbered, repeat), "mix-sizes"), weights, cap)
    joined = numbered.withColumn(key, source_key(F.col("source"))).join(
        plan.select(F.col("source").alias(key), F.struct(*plan.columns).alias(own)), key)
    at = lambda c: F.col(f"{own}.{c}")
    times = copies(pareto_rank(uniform(F.col("doc_id"), F.col("text"), F.col(repeat)), at), F.col("doc_id"), at)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.array_repeat(F.lit(0), times)).alias(turn)).drop(turn)
