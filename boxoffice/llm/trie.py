"""A prefix trie over conversations, with subtree sums by the Euler-tour technique.

A node is a distinct sequence of first turns; the conversations that start with it are its members. It is known by the
smallest member and its depth, and found by its depth and two 64-bit fingerprints: the exclusive or of hashes of (place,
turn), so that a conversation of any length is cut in blocks whose fingerprints combine.

The tour enters every node and leaves it after its subtree: an enter and an exit arc per node, each linked to the next one
(enter: first child, else the own exit; exit: next sibling, else the parent's exit; siblings in order of conv_id). List
ranking turns links into positions. Arcs are range-partitioned by (conv_id, depth), where most links stay within a slice, and
each task contracts its slice's chains by pointer doubling. While more than ``LAST`` chains are left, rounds of random mates
join pairs of neighbours (a quarter of all on average, each round on the shorter list); the last ones are ranked in one task
of that bound, and the rounds are undone in reverse. A subtree's sum is then a difference of prefix sums at the positions
of its two arcs; prefix sums are taken in slices of ``SLICE`` positions.

No step depends on a small depth, few children or few members: places within conversations and among siblings are found by
range partitioning, hot fingerprints are folded in every task before they are shuffled, joins by parent are not followed by a
grouping on it, and the members that end at a node are hashed in order as a stream, from pieces that tasks have joined.

Defined results: turns are ordered by turn (null first), equal turns by the digest of role and text; null roles and texts are
empty; rows with a null conv_id are in no conversation; repeated rows are turns of their own; no rows give no nodes; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.operators.base import positions
from boxoffice.session import materialize

FAMILY = 100  # conversations c - c % FAMILY lend their first turns to c
HEADS = 6  # a hash modulo this is the number of turns lent
SLICE = 1 << 16
ARCS = 500_000
LAST = 1_000_000
CHUNK = 1 << 20
END = -1  # in place of a next arc
NODE = ("depth", "f1", "f2")


class Trie(NamedTuple):
    """``nodes``: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, first and last (positions of the
    arcs), f1, f2; ``ends``: conv_id and the depth, f1, f2 of the node at which that conversation ends."""

    nodes: DataFrame
    ends: DataFrame


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), m1 and m2 (120 bits of the digest of role and text), chars (code points of the text)."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    number = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    turns = conversations.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    narrow = turns.select("conv_id", "turn", number(1).alias("m1"), number(16).alias("m2"), "chars")
    return positions(narrow, ["conv_id"], [F.asc_nulls_first("turn"), F.col("m1"), F.col("m2")], "place").select(
        "conv_id", F.col("place").cast("long").alias("place"), "m1", "m2", "chars")


def lent(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def with_shared_heads(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each conversation's first turns replaced by its family's: the turns in their new places, and all conv_ids."""
    family = lambda c: F.col(c) - F.col(c) % FAMILY
    convs = turns.select("conv_id").distinct()
    head = F.array_sort(F.collect_list(F.struct("place", "m1", "m2", "chars")))  # fewer than HEADS turns
    heads = materialize(turns.filter((family("conv_id") == F.col("conv_id")) & (F.col("place") < HEADS)).groupBy("conv_id").agg(
        head.alias("head")).withColumnRenamed("conv_id", "family"), "trie-heads")
    borrowed = convs.withColumn("family", family("conv_id")).join(heads, "family").select(
        "conv_id", F.explode(F.slice("head", F.lit(1), lent(F.col("conv_id")).cast("int"))).alias("t")).select("conv_id", "t.*")
    rest = turns.withColumn("family", family("conv_id")).filter(F.col("place") > lent(F.col("conv_id"))).join(
        heads.select("family", F.size("head").alias("there")), "family", "left")
    shift = F.least(lent(F.col("conv_id")), F.coalesce("there", F.lit(0))) - lent(F.col("conv_id"))
    own = rest.select("conv_id", (F.col("place") + shift).alias("place"), "m1", "m2", "chars")
    return borrowed.unionByName(own), convs


def _states(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """Every (conversation, depth): fingerprints of its first turns (f1, f2) and of those without the last (p1, p2), and chars."""
    rows = materialize(turns.select(
        "conv_id", "place", F.xxhash64("place", "m1", "m2").alias("x1"), F.xxhash64("m2", F.lit(1), "place", "m1").alias("x2"), "chars",
        F.floor((F.col("place") - 1) / SLICE).alias("block")), "trie-turns")
    longer = rows.filter("block > 0").select("conv_id").distinct()
    totals = rows.join(longer, "conv_id", "left_semi").groupBy("conv_id", "block").agg(*(F.bit_xor(f"x{i}").alias(f"t{i}") for i in (1, 2)))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row per block
    offsets = totals.select("conv_id", "block", *(F.bit_xor(f"t{i}").over(earlier).alias(f"o{i}") for i in (1, 2)))
    upto = Window.partitionBy("conv_id", "block").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({f"r{i}": F.bit_xor(f"x{i}").over(upto) for i in (1, 2)}).join(offsets, ["conv_id", "block"], "left")
    f = [F.col(f"r{i}").bitwiseXOR(F.coalesce(f"o{i}", F.lit(0))) for i in (1, 2)]
    states = run.select("conv_id", F.col("place").alias("depth"), f[0].alias("f1"), f[1].alias("f2"), f[0].bitwiseXOR(F.col("x1")).alias("p1"),
                        f[1].bitwiseXOR(F.col("x2")).alias("p2"), "chars")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    top = convs.select("conv_id", zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), none.alias("p1"), none.alias("p2"), zero.alias("chars"))
    return materialize(states.unionByName(top), "trie-states")


def _tree(states: DataFrame) -> DataFrame:
    """The nodes with their parents, number of children, first child and next sibling."""
    nodes = materialize(states.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"),
        F.max("chars").alias("chars")), "trie-nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("p1"), F.col("f2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    tree = materialize(nodes.join(parents, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie-parents")
    children = positions(tree.filter("depth > 0").select("parent_conv_id", "depth", "conv_id"), ["parent_conv_id", "depth"], [F.col("conv_id")], "turn")
    families = children.groupBy("parent_conv_id", "depth").agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child")).select(
        F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_children", "child")
    following = children.select("parent_conv_id", "depth", (F.col("turn") - 1).alias("turn"), F.col("conv_id").alias("sibling"))
    siblings = children.join(following, ["parent_conv_id", "depth", "turn"]).select("conv_id", "depth", "sibling")
    return materialize(tree.join(families, ["conv_id", "depth"], "left").join(siblings, ["conv_id", "depth"], "left").withColumn(
        "n_children", F.coalesce("n_children", F.lit(0))), "trie-tree")


def _arcs(tree: DataFrame) -> DataFrame:
    """Arc (c, e), e twice the depth and one more for the exit; the next arc; and what the arc adds to the prefix sums."""
    c, enter = F.col("conv_id"), F.col("depth") * 2
    zero = F.lit(0).cast("long")
    into = F.struct(
        c.alias("c"), enter.alias("e"), F.coalesce("child", c).alias("nc"), F.when(F.col("child").isNull(), enter + 1).otherwise(enter + 2).alias("ne"),
        (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    up = F.when(F.col("sibling").isNotNull(), enter).when(F.col("depth") > 0, enter - 1).otherwise(F.lit(END))
    out = F.struct(c.alias("c"), (enter + 1).alias("e"), F.coalesce("sibling", "parent_conv_id", zero).alias("nc"), up.alias("ne"),
                   zero.alias("leaves"), zero.alias("saved"))
    return tree.select(F.inline(F.array(into, out)))


def _next_places(c: np.ndarray, e: np.ndarray, nc: np.ndarray, ne: np.ndarray) -> np.ndarray:
    """The place of each element's next one in the arrays, or -1 where it is not among them."""
    known, code = np.unique(c, return_inverse=True)
    base = max(int(e.max()), int(ne.max())) + 2
    key = code * base + e
    order = np.argsort(key)
    key = key[order]
    found = np.minimum(np.searchsorted(known, nc), len(known) - 1)
    wanted = found * base + ne
    at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
    return np.where((ne >= 0) & (known[found] == nc) & (key[at] == wanted), order[at], -1)


def _from_heads(following: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointer doubling: the head of each element's chain, and the sizes of the elements before it."""
    up = np.arange(len(following))
    inner = following >= 0
    up[following[inner]] = np.flatnonzero(inner)
    before = np.where(up == np.arange(len(up)), 0, size[up])
    while True:
        further = up[up]
        if (further == up).all():
            return up, before
        before += before[up]
        up = further


def _columns(batches, names: tuple) -> list[np.ndarray] | None:
    held = list(batches)
    table = pa.Table.from_batches(held) if held else None
    return [table.column(n).to_numpy() for n in names] if table is not None and table.num_rows else None


def _chains(arcs: DataFrame, arcs_per_task: int) -> DataFrame:
    """Every arc with the head of its chain in its slice, its offset there, and the next arc of chains' last arcs."""
    names = ("c", "e", "nc", "ne", "leaves", "saved")

    def contract(batches):
        columns = _columns(batches, names)
        if columns is None:
            return
        c, e, nc, ne, leaves, saved = columns
        following = _next_places(c, e, nc, ne)
        head, offset = _from_heads(following, np.ones(len(c), np.int64))
        table = pa.table({"c": c, "e": e, "hc": c[head], "he": e[head], "offset": offset, "last": following < 0, "nc": nc, "ne": ne,
                          "leaves": leaves, "saved": saved})
        yield from table.to_batches(max_chunksize=10_000)

    parts = max(1, math.ceil(arcs.count() / arcs_per_task))
    placed = arcs.repartitionByRange(parts, "c", "e").mapInArrow(
        contract, "c long, e long, hc long, he long, offset long, last boolean, nc long, ne long, leaves long, saved long")
    return materialize(placed, "trie-chains")


def _starts(chains: DataFrame, last: int) -> DataFrame:
    """c, e, size, nc, ne of chains in a list to c, e, start: the sizes before each."""
    undo = []
    while chains.count() > last:
        coin = F.xxhash64("c", "e", F.lit(len(undo))).bitwiseAND(F.lit(1)) == 1
        first = chains.filter(coin).select(*(F.col(c).alias(f"a_{c}") for c in chains.columns))
        second = chains.filter(~coin).select(*(F.col(c).alias(f"b_{c}") for c in chains.columns))
        joined = first.join(second, (F.col("a_nc") == F.col("b_c")) & (F.col("a_ne") == F.col("b_e")), "full")
        joined = materialize(joined.select(
            F.coalesce("a_c", "b_c").alias("c"), F.coalesce("a_e", "b_e").alias("e"), F.coalesce("b_nc", "a_nc").alias("nc"), F.coalesce("b_ne", "a_ne").alias("ne"),
            (F.coalesce("a_size", F.lit(0)) + F.coalesce("b_size", F.lit(0))).alias("size"),
            *(F.when(F.col("a_c").isNotNull(), F.col(f"b_{c}")).alias(f"gone_{c}") for c in ("c", "e")), F.col("a_size").alias("offset")), "trie-mates")
        undo.append(joined.filter("gone_c is not null"))
        chains = joined.select("c", "e", "size", "nc", "ne")

    def rank(batches):
        columns = _columns(batches, ("c", "e", "size", "nc", "ne"))
        if columns is None:
            return
        c, e, size, nc, ne = columns
        _, before = _from_heads(_next_places(c, e, nc, ne), size)
        yield from pa.table({"c": c, "e": e, "start": before}).to_batches(max_chunksize=10_000)

    starts = materialize(chains.repartition(1).mapInArrow(rank, "c long, e long, start long"), "trie-starts")
    for joined in reversed(undo):
        gone = joined.join(starts, ["c", "e"]).select(F.col("gone_c").alias("c"), F.col("gone_e").alias("e"), (F.col("start") + F.col("offset")).alias("start"))
        starts = materialize(starts.unionByName(gone), "trie-starts")
    return starts


def tour(arcs: DataFrame, arcs_per_task: int = ARCS, last: int = LAST) -> DataFrame:
    """Every arc with its position in the tour and its weights."""
    chains = _chains(arcs, arcs_per_task)
    lists = chains.filter("last").select(F.col("hc").alias("c"), F.col("he").alias("e"), (F.col("offset") + 1).alias("size"), "nc", "ne")
    starts = _starts(lists, last).select(F.col("c").alias("hc"), F.col("e").alias("he"), "start")
    return chains.join(starts, ["hc", "he"]).select("c", "e", (F.col("start") + F.col("offset")).alias("position"), "leaves", "saved")


def _subtrees(placed: DataFrame) -> DataFrame:
    """Per node: the positions of its arcs, and what its subtree adds up to: the sum up to its exit less that before its entry."""
    placed = materialize(placed.withColumn("slice", F.floor(F.col("position") / SLICE)), "trie-tour")
    upto = Window.partitionBy("slice").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)  # one row per SLICE arcs
    weights = ("leaves", "saved")
    offsets = placed.groupBy("slice").agg(*(F.sum(w).alias(w) for w in weights)).select(
        "slice", *(F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"{w}_before") for w in weights))
    summed = placed.withColumns({f"{w}_run": F.sum(w).over(upto) for w in weights}).join(offsets, "slice")
    leaving = F.col("e") % 2 == 1

    def total(w: str) -> Column:
        run = F.col(f"{w}_run") + F.col(f"{w}_before")
        return F.sum(F.when(leaving, run).otherwise(F.col(w) - run))

    return summed.groupBy(F.col("c").alias("conv_id"), F.shiftright("e", 1).alias("depth")).agg(
        total("leaves").alias("n_leaves"), total("saved").alias("saved_tokens"), F.min("position").alias("first"), F.max("position").alias("last"))


def prefix_trie(turns: DataFrame, convs: DataFrame | None = None, arcs_per_task: int = ARCS, last: int = LAST) -> Trie:
    """The trie of ``turns`` (conv_id, place, m1, m2, chars, see ``numbered_turns``); ``convs`` adds conv_ids without turns.

    Runs jobs while it is built.
    """
    states = _states(turns, turns.select("conv_id").distinct() if convs is None else convs)
    tree = _tree(states)
    subtrees = _subtrees(tour(_arcs(tree), arcs_per_task, last))
    nodes = tree.join(subtrees, ["conv_id", "depth"]).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "first", "last", "f1", "f2")
    ends = states.groupBy("conv_id").agg(F.max(F.struct(*NODE)).alias("end")).select("conv_id", "end.*")
    return Trie(nodes, ends)


def end_digests(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Per node (depth, f1, f2): the SHA-256 of the conv_ids that end there, in order, joined by commas.

    A task joins the ids of its range and hashes the nodes that lie wholly within; ids of nodes at its edges, or of more than a
    chunk, are passed on in chunks and hashed as a stream.
    """
    schema = "depth long, f1 long, f2 long, part int, number int, ids string, ends_sha256 string"

    def join_ids(batches):
        part = TaskContext.get().partitionId()
        node, held, size, number, opening = None, [], 0, 0, True
        rows: list[tuple] = []

        def passed_on():
            nonlocal held, size, number
            rows.append((*node, part, number, ",".join(held), None))
            held, size, number = [], 0, number + 1

        def finished(edge: bool):
            if edge or number:
                if held or not number:
                    passed_on()
            else:
                rows.append((*node, part, 0, None, hashlib.sha256(",".join(held).encode()).hexdigest()))

        def written():
            out = pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(),) * 3 + (pa.int32(),) * 2 + (pa.string(),) * 2)],
                names=["depth", "f1", "f2", "part", "number", "ids", "ends_sha256"])
            rows.clear()
            return out

        for batch in batches:
            keys = [batch.column(n).to_numpy() for n in NODE]
            ids = batch.column("conv_id").to_pylist()
            changes = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
            for a, b in zip([0, *changes.tolist()], [*changes.tolist(), len(ids)]):
                own = tuple(int(k[a]) for k in keys) if b > a else node
                if own != node:
                    if node is not None:
                        finished(opening)
                        opening = False
                    node, held, size, number = own, [], 0, 0
                for at in range(a, b, 10_000):
                    texts = list(map(str, ids[at: min(b, at + 10_000)]))
                    held += texts
                    size += sum(map(len, texts)) + len(texts)
                    if size > chunk:
                        passed_on()
            if rows:
                yield written()
        if node is not None:
            finished(True)
            if rows:
                yield written()

    def stream(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for depth, f1, f2, ids in zip(*(batch.column(n).to_pylist() for n in (*NODE, "ids"))):
                if (depth, f1, f2) != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, f1, f2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], names=[*NODE, "ends_sha256"])
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, state.hexdigest())], names=[*NODE, "ends_sha256"])

    ordered = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    joined = materialize(ordered.mapInArrow(join_ids, schema), "trie-ends")
    edges = joined.filter("ids is not null").repartition(*NODE).sortWithinPartitions(*NODE, "part", "number").select(*NODE, "ids")
    return joined.filter("ids is null").select(*NODE, "ends_sha256").unionByName(
        edges.mapInArrow(stream, "depth long, f1 long, f2 long, ends_sha256 string"))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations with their families' heads, one row per node, and a digest of who ends there."""
    turns, convs = with_shared_heads(numbered_turns(conversations))
    trie = prefix_trie(turns, convs)
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return trie.nodes.join(end_digests(trie.ends), list(NODE), "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256"))
