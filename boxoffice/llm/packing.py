"""Packing token sequences by best-fit decreasing.

Documents become ids of a tokenizer and an end id. One longer than a window is first cut in full windows; what remains is a
piece like every short document. Longest pieces first, each goes into the open window with the least room that holds it. A
segment tree over the remaining capacities finds that window: its leaves count the open windows of each capacity.

Pieces of one length are placed together: the tightest window takes as many of them as fit, since after each it is still the
tightest, then the next one. That gives best-fit decreasing itself, with a search per run of equal pieces, not per piece.

Plan. One task encodes a part of the rows and writes its pieces with their ids to the shared folder; texts and ids are never
shuffled. Lengths alone are dealt by hash into groups of about ``GROUP`` pieces, each packed in one task; a group leaves
a window or two half empty, a few thousandths of a percent of its windows. Windows of all groups are numbered through by a
sum over groups, and the places are joined back to the pieces by number.

Defined results: null and empty texts are a document of the end id alone; repeated rows and rows with equal or null ids are
documents of their own; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.tokenfiles import encoder_of
from boxoffice.session import materialize

WINDOW = 4096
GROUP = 100_000
PIECES = "part long, number long, doc_id long, start long, length long, doc_tokens long, ids binary"


class OpenWindows:
    """Open windows by remaining capacity, under a segment tree of their numbers."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, n: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def put(self, capacity: int, windows: np.ndarray) -> None:
        if capacity and len(windows):
            self.held[capacity].append(windows)
            self._add(capacity, len(windows))

    def take(self, capacity: int, n: int) -> np.ndarray:
        """Up to ``n`` windows of that capacity, the earliest put first."""
        out, held = [], self.held[capacity]
        while held and n:
            first = held[0]
            out.append(first[:n])
            if len(first) > n:
                held[0] = first[n:]
            else:
                del held[0]
            n -= len(out[-1])
        got = np.concatenate(out)
        self._add(capacity, -len(got))
        return got

    def tightest(self, size: int) -> int | None:
        """The least capacity of at least ``size`` that an open window has."""
        node = size + self.leaves
        if not self.count[node]:
            while node & 1 or not self.count[node + 1]:  # up, to the first subtree on the right that is not empty
                node >>= 1
                if node <= 1:
                    return None
            node += 1
            while node < self.leaves:
                node *= 2
                node += not self.count[node]
        return node - self.leaves


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, int]:
    """Window and offset of each piece, and the number of windows; equal pieces in the order given."""
    order = np.argsort(-lengths, kind="stable")
    ranked = lengths[order]
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    edges = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])).tolist() if len(ranked) else []
    open_windows, windows = OpenWindows(window), 0
    for at, end in zip(edges, [*edges[1:], len(ranked)]):
        size = int(ranked[at])
        while at < end:
            capacity = open_windows.tightest(size)
            fit = (capacity or window) // size
            needed = -(-(end - at) // fit)
            if capacity is None:
                capacity, taken = window, np.arange(windows, windows + needed)
                windows += needed
            else:
                taken = open_windows.take(capacity, needed)
            placed = min(end - at, fit * len(taken))
            turn = np.arange(placed)
            own = order[at: at + placed]
            where[own] = taken[turn // fit]
            offset[own] = window - capacity + turn % fit * size
            full = placed // fit
            open_windows.put(capacity - fit * size, taken[:full])
            open_windows.put(capacity - placed % fit * size, taken[full:])
            at += placed
    return where, offset, windows


def token_pieces(docs: DataFrame, tokenizer: str, window: int = WINDOW) -> DataFrame:
    """Every document's ids cut in windows: one row per piece, known by part and number."""
    def encode(batches):
        encoder, part, number = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                ids, counts = encoder.encode(rows.column("text").to_pylist())
                ends = np.cumsum(counts)
                pieces = -(-counts // window)
                owner = np.repeat(np.arange(len(counts)), pieces)
                start = window * (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(counts[owner] - start, window)
                place = np.append(ends[owner] - counts[owner] + start, len(ids)).astype(np.int32) * 4
                raw = pa.py_buffer(ids.astype("<u4"))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(owner), part)), pa.array(np.arange(number, number + len(owner))),
                    rows.column("doc_id").cast(pa.int64()).take(pa.array(owner)), pa.array(start), pa.array(length), pa.array(counts[owner]),
                    pa.Array.from_buffers(pa.binary(), len(owner), [None, pa.py_buffer(place.astype(np.int32)), raw])],
                    names=["part", "number", "doc_id", "start", "length", "doc_tokens", "ids"])
                number += len(owner)

    return docs.select("doc_id", "text").mapInArrow(encode, PIECES)


def places_of(pieces: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """part, number, sequence_id and offset of every piece, from their lengths alone."""
    groups = max(1, math.ceil(pieces.count() / group))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("number", "ascending")])
        where, offset, windows = best_fit_decreasing(table.column("length").to_numpy(), window)
        return pa.table({"part": table.column("part"), "number": table.column("number"), "bin": table.column("bin"), "place": where,
                         "offset": offset, "windows": np.full(len(where), windows)})

    dealt = pieces.select("part", "number", "length", F.pmod(F.xxhash64("part", "number"), F.lit(groups)).alias("bin"))
    places = materialize(dealt.groupBy("bin").applyInArrow(
        pack, "part long, number long, bin long, place long, offset long, windows long"), "packing-places")
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # one row per group
    first = places.groupBy("bin").agg(F.first("windows").alias("windows")).select(
        "bin", F.coalesce(F.sum("windows").over(before), F.lit(0)).alias("first"))
    return places.join(first, "bin").select("part", "number", (F.col("first") + F.col("place")).alias("sequence_id"), "offset")


def _stored_pieces(docs: DataFrame, tokenizer: str | None, window: int) -> DataFrame:
    return materialize(token_pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), window), "packing-pieces")


def packed_pieces(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """Every piece with its ids (little-endian 32 bits each), its sequence_id and its offset there. Runs jobs while it is built."""
    pieces = _stored_pieces(docs, tokenizer, window)
    return pieces.join(places_of(pieces, window, group), ["part", "number"]).select(
        "doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def packed_sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence from ``packed_pieces``: sequence_id, length, ids, and its pieces (doc_id, start, length) in order.

    A sequence holds at most a window of ids, so a group here is bounded.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "start", "length", "ids")))
    joined = F.aggregate("parts", F.lit(b""), lambda ids, p: F.concat(ids, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("parts")).select(
        "sequence_id", "length", joined.alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"], p["start"], p["length"])).alias("pieces"))


def packed_documents(docs: DataFrame) -> DataFrame:
    """The pieces with the crc32 of their ids in place of the ids, taken before the join so that ids stay where they are."""
    pieces = _stored_pieces(docs, None, WINDOW)
    told = pieces.select("part", "number", "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return told.join(places_of(pieces), ["part", "number"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
