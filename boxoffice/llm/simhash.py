"""SimHash near-dedup with a segment-popcount embedding.

The fingerprint is the bitwise majority of XXH64 over word shingles. Equal fingerprints are folded first, so a group of
exact copies of any size becomes one. A fingerprint is mapped to the bit counts of its 32 two-bit segments; the Manhattan
distance of two such vectors never exceeds the Hamming distance of the fingerprints. The vector is cut into bands, so
many that at most one unit of the allowed distance falls into some band: two linked vectors then share, in that band,
the grid cell in which one coordinate is left open. Cells are joined in tasks that verify the Hamming distance exactly
and hand back a spanning forest of the links found, never the pairs. A cell with more than ``CELL_ROWS`` members is cut
into pieces, each pair of pieces a group of its own.

Defined results: null and empty texts have fingerprint zero, linked like any other; repeated rows are members each for
itself; a null id never is the smallest id unless its group has no other; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.components import components, local_roots
from boxoffice.llm.text import FOLD, fresh, slices
from boxoffice.session import materialize

DISTANCE = 4
SHINGLE = 4
SEED = 42
SEGMENTS = 32  # of two bits
CELL_ROWS = 4096
GROUP_ROWS = 500_000
KEEP_LINKS = 1_000_000  # links held before they are reduced to a spanning forest


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = (text or "").encode().translate(FOLD).split()
    if not words:
        return 0
    joined = b" ".join(words)
    width = min(shingle, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - width + 1]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends[width - 1:].tolist())], np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        votes += np.unpackbits(hashes[at: at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for batch in slices(batches):
        values = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "row_key": batch.column("row_key"), "fp": pa.array(values)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, row_key (a hash of id and text) and fingerprint (fp, a signed long) of every row."""
    return docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key")).mapInArrow(
        _fingerprints, "doc_id long, row_key long, fp long")


def cells(fp: Column, distance: int = DISTANCE) -> Column:
    """The open grid cells of a fingerprint: in every band, one for each of its coordinates."""
    bands = max(2, distance // 2 + 1)
    cuts = [round(k * SEGMENTS / bands) for k in range(bands + 1)]
    out = []
    for band, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        wide = 2 * (hi - lo)
        bits = F.shiftrightunsigned(fp, 2 * lo).bitwiseAND(F.lit((1 << wide) - 1))
        even = F.lit(0x5555555555555555 & ((1 << wide) - 1))
        counts = bits.bitwiseAND(even) + F.shiftrightunsigned(bits, 1).bitwiseAND(even)  # fields of two bits, each 0 to 2
        for free in range(hi - lo):
            code = counts.bitwiseAND(F.lit(((1 << wide) - 1) & ~(3 << (2 * free))))
            out.append(code + F.lit((band * SEGMENTS + free) << 40))
    return F.array(*out)


def _join_cells(table: pa.Table, distance: int) -> pa.Table:
    """Spanning forest of the links inside the cells of one group of cells."""
    fp = np.asarray(table.column("fp")).view(np.uint64)
    cell = np.asarray(table.column("cell"))
    piece = np.asarray(table.column("piece"))
    order = np.lexsort((fp, piece, cell))
    fp, cell, piece = fp[order], cell[order], piece[order]
    nodes, node = np.unique(fp, return_inverse=True)
    change = np.flatnonzero((np.diff(cell) != 0) | (np.diff(piece) != 0)) + 1
    bounds = np.concatenate([[0], change, [len(fp)]])
    end = np.repeat(bounds[1:], np.diff(bounds))
    here, step = np.arange(len(fp)), 1
    a, b, held = [], [], 0

    def reduce():
        x, y = np.concatenate(a), np.concatenate(b)
        roots = local_roots(len(nodes), x, y)
        joined = np.flatnonzero(roots != np.arange(len(nodes)))
        return [joined], [roots[joined]]

    while True:
        here = here[here + step < end[here]]
        if not len(here):
            break
        near = here[np.bitwise_count(fp[here] ^ fp[here + step]) <= distance]
        if len(near):
            a.append(node[near])
            b.append(node[near + step])
            held += len(near)
            if held > KEEP_LINKS:
                a, b = reduce()
                held = 0
        step += 1
    if a:
        a, b = reduce()
    signed = nodes.view(np.int64)
    return pa.table({"a": pa.array(signed[a[0]] if a else [], pa.int64()), "b": pa.array(signed[b[0]] if b else [], pa.int64())})


def linked(distinct: DataFrame, distance: int = DISTANCE, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``distinct`` (fp) to links (a, b) that connect exactly what the Hamming distance connects."""
    spark = distinct.sparkSession
    rows = distinct.select("fp", F.explode(cells(F.col("fp"), distance)).alias("cell"))
    large = materialize(rows.groupBy("cell").agg(F.count("*").alias("members")).filter(F.col("members") > cell_rows), "simhash-large-cells")
    k = F.coalesce(F.ceil(F.col("members") / cell_rows), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
    # the piece pair (own, j) is one number, the same from both sides
    pairs = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(F.col("own"), j) * F.col("k").cast("long") + F.greatest(F.col("own"), j))
    dealt = rows.join(large, "cell", "left").withColumn("k", k).withColumn("own", own).select("fp", "cell", F.explode(pairs).alias("piece"))
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(distinct.count() * SEGMENTS / GROUP_ROWS))
    return dealt.withColumn("group", F.pmod(F.xxhash64("cell", "piece"), F.lit(groups))).groupBy("group").applyInArrow(
        lambda t: _join_cells(t, distance), "a long, b long")


def _grouped(docs: DataFrame, distance: int) -> tuple[DataFrame, DataFrame]:
    """All rows (doc_id, row_key, fp), and per fingerprint the first row of its group (no_id, doc_id, row_key)."""
    rows = materialize(fingerprints(docs), "simhash")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_key")
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    roots = components(linked(distinct.select("fp"), distance))
    with_root = distinct.join(roots.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    groups = with_root.groupBy("root").agg(F.min("first").alias("keep"))
    return rows, with_root.join(groups, "root").select("fp", "keep")


def near_duplicate_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest id reachable by links) of every row."""
    rows, groups = _grouped(docs, distance)
    return rows.join(groups, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("keep.doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of every group: the one with the smallest id."""
    _, groups = _grouped(docs, distance)
    key = fresh(docs.columns, "row_key")
    keep = groups.select(F.col("keep.row_key").alias(key)).distinct()
    kept = docs.withColumn(key, F.xxhash64("doc_id", "text")).join(keep, key)
    return kept.dropDuplicates([key, "doc_id"]).select(*(F.col(f"`{c}`") for c in docs.columns))
