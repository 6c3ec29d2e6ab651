"""Embedding near-dedup by an epsilon grid order join.

Two unit vectors with cosine >= c lie within epsilon = sqrt(2 - 2c). Vectors are projected on their leading principal
directions (fitted on a bounded sample; any orthonormal directions give correct results), sorted by their grid cells of
width epsilon, and cut into sequence intervals of about half a megabyte. Intervals whose bounding boxes are more than
epsilon apart in the leading directions are never joined. The others meet in tasks of up to ``SUPER`` x ``SUPER``
intervals, which join them recursively, halving the longer one and skipping what is provably distant, down to small
blocks that are compared exactly in double precision. A task returns a link count and a spanning forest, never pairs.

How much is skipped depends on the data: vectors that spread evenly over many directions leave most blocks to be compared.

Defined results: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
length do not link; repeated rows are vectors each for itself; the smallest id of a group ignores null ids, and a null id
is never kept; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.components import components, local_roots
from boxoffice.operators.base import positions
from boxoffice.session import materialize

COSINE = 0.9
SAMPLE = 8000  # vectors, and at most SAMPLE_BYTES, that the principal directions are fitted on
SAMPLE_BYTES = 16_000_000
LEADING = 8
INTERVAL_BYTES = 500_000
SUPER = 8  # intervals on each side of a task
LEAF = 512
KEEP_LINKS = 1_000_000
DIM_STEP = 1 << 40  # row numbers of vectors of one length


def _units(batches):
    """Valid vectors scaled to length 1 (``unit``: doubles), and their length; 0 marks an invalid one."""
    for batch in batches:
        units, dims = [], []
        for values in batch.column("embedding").to_pylist():
            unit = None
            if values and None not in values:
                v = np.array(values, np.float64)
                if np.isfinite(v).all() and v.any():
                    v /= np.abs(v).max()  # so that the norm neither over- nor underflows
                    unit = v / np.sqrt(v @ v)
            units.append(None if unit is None else unit.tobytes())
            dims.append(0 if unit is None else len(unit))
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "dim": pa.array(dims, pa.int64()), "unit": pa.array(units, pa.binary())})


def principal_directions(vectors: DataFrame, dim: int) -> np.ndarray:
    """The leading principal directions of a bounded sample of the vectors of one length, as columns."""
    rows = max(LEADING, min(SAMPLE, SAMPLE_BYTES // (8 * dim)))
    sample = vectors.filter(F.col("dim") == dim).orderBy(F.xxhash64("unit")).limit(rows).select("unit").collect()
    x = np.frombuffer(b"".join(bytes(r["unit"]) for r in sample)).reshape(-1, dim)
    x = x - x.mean(0)
    if len(x) > dim:
        _, axes = np.linalg.eigh(x.T @ x)
        return axes[:, ::-1][:, : min(LEADING, dim)]
    return np.eye(dim)[:, : min(LEADING, dim)]


def _pack(table: pa.Table, axes: dict) -> pa.Table:
    """One interval as one row: row numbers, unit vectors, and its box in the leading directions."""
    dim = table.column("dim")[0].as_py()
    order = np.argsort(np.asarray(table.column("row")))
    units = np.frombuffer(b"".join(table.column("unit").to_pylist())).reshape(-1, dim)[order]
    shown = units @ axes[dim]
    return pa.table({"dim": pa.array([dim]), "interval": table.column("interval").slice(0, 1).combine_chunks(),
                     "rows": pa.array([np.asarray(table.column("row"))[order].tobytes()], pa.binary()), "units": pa.array([units.tobytes()], pa.binary()),
                     "low": pa.array([shown.min(0).tolist()]), "high": pa.array([shown.max(0).tolist()])})


def _join_intervals(table: pa.Table, axes: dict, cosine: float) -> pa.Table:
    """Links between the left and the right intervals of a task: per row touched, its count and a root."""
    left, right, dim = (table.column(c)[0].as_py() for c in ("left", "right", "dim"))
    intervals = np.asarray(table.column("interval"))
    rows = [np.frombuffer(b, np.int64) for b in table.column("rows").to_pylist()]
    side = {s: [k for k in np.argsort(intervals) if intervals[k] // SUPER == s] for s in {left, right}}
    used = [k for s in sorted(side) for k in side[s]]
    units = np.concatenate([np.frombuffer(table.column("units")[int(k)].as_py()).reshape(-1, dim) for k in used])
    row = np.concatenate([rows[k] for k in used])
    shown = units @ axes[dim]
    reach = 2 - 2 * cosine + 1e-9
    count = np.zeros(len(row), np.int64)
    a, b, held = [], [], 0

    def join(i, j, k, m):
        """All pairs of [i, j) with [k, m); the two are equal or do not overlap."""
        nonlocal a, b, held
        x, y = shown[i:j], shown[k:m]
        gap = np.maximum(0, np.maximum(x.min(0) - y.max(0), y.min(0) - x.max(0)))
        if gap @ gap > reach:
            return
        if max(j - i, m - k) <= LEAF:
            p, q = np.nonzero(units[i:j] @ units[k:m].T >= cosine)
            if i == k:
                p, q = p[p < q], q[p < q]
            if len(p):
                p, q = p + i, q + k
                count[:] += np.bincount(p, minlength=len(row)) + np.bincount(q, minlength=len(row))
                a.append(p)
                b.append(q)
                held += len(p)
                if held > KEEP_LINKS:
                    a, b = _forest(len(row), a, b)
                    held = 0
            return
        if i == k:
            half = (i + j) // 2
            join(i, half, i, half)
            join(half, j, half, j)
            join(i, half, half, j)
        elif j - i >= m - k:
            join(i, (i + j) // 2, k, m)
            join((i + j) // 2, j, k, m)
        else:
            join(i, j, k, (k + m) // 2)
            join(i, j, (k + m) // 2, m)

    first = sum(len(rows[k]) for k in side[min(side)])
    if left == right:
        join(0, len(row), 0, len(row))
    else:
        join(0, first, first, len(row))
    roots = local_roots(len(row), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(row))
    touched = np.flatnonzero(count)
    return pa.table({"row": pa.array(row[touched], pa.int64()), "root": pa.array(row[roots[touched]], pa.int64()), "links": pa.array(count[touched])})


def _forest(n: int, a: list, b: list) -> tuple[list, list]:
    roots = local_roots(n, np.concatenate(a), np.concatenate(b))
    joined = np.flatnonzero(roots != np.arange(n))
    return [joined], [roots[joined]]


def links_and_groups(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding). Runs jobs while it is built."""
    clean = materialize(vectors.select("vec_id", "embedding").mapInArrow(_units, "vec_id long, dim long, unit binary"), "vectors")
    dims = [r["dim"] for r in clean.filter("dim > 0").select("dim").distinct().collect()]  # the few lengths in use
    axes = {d: principal_directions(clean, d) for d in dims}
    width = math.sqrt(2 - 2 * cosine)

    def cells(batches):
        for batch in batches:
            keys = [(np.frombuffer(u) @ axes[d]) for u, d in zip(batch.column("unit").to_pylist(), batch.column("dim").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([np.floor(k / width).astype(int).tolist() for k in keys], pa.list_(pa.int32())),
                                              pa.array([k.tolist() for k in keys], pa.list_(pa.float64()))], names=[*batch.schema.names, "cells", "shown"])

    gridded = clean.filter("dim > 0").mapInArrow(cells, "vec_id long, dim long, unit binary, cells array<int>, shown array<double>")
    placed = positions(gridded, ["dim"], ["cells", "shown", "vec_id"], "position").select(
        "vec_id", "dim", "unit", (F.col("dim") * DIM_STEP + F.col("position")).alias("row"),
        F.floor((F.col("position") - 1) / F.greatest(F.lit(64), F.floor(INTERVAL_BYTES / (8 * F.col("dim"))))).alias("interval"))
    placed = materialize(placed, "vectors-placed")
    packed = materialize(placed.select("dim", "interval", "row", "unit").groupBy("dim", "interval").applyInArrow(
        lambda t: _pack(t, axes), "dim long, interval long, rows binary, units binary, low array<double>, high array<double>"), "vector-intervals")

    # boxes within reach share a grid cell of the first direction once one of them is widened by epsilon
    boxes = packed.select("dim", "interval", "low", "high")
    cell = lambda c: F.floor(c / width).cast("int")
    one = boxes.select("dim", F.col("interval").alias("i"), F.col("low").alias("low1"), F.col("high").alias("high1"), F.explode(
        F.sequence(cell(F.col("low")[0]), cell(F.col("high")[0]))).alias("cell"))
    two = boxes.select("dim", F.col("interval").alias("j"), F.col("low").alias("low2"), F.col("high").alias("high2"), F.explode(
        F.sequence(cell(F.col("low")[0] - width), cell(F.col("high")[0] + width))).alias("cell"))
    gap = lambda x, y: F.zip_with(x, y, lambda p, q: F.greatest(p - q, F.lit(0.0)))
    apart = F.aggregate(F.zip_with(gap(F.col("low1"), F.col("high2")), gap(F.col("low2"), F.col("high1")), lambda p, q: p + q),
                        F.lit(0.0), lambda s, g: s + g * g)
    near = one.join(two, ["dim", "cell"]).filter((F.col("i") <= F.col("j")) & (apart <= 2 - 2 * cosine + 1e-9))
    left, right = F.floor(F.col("i") / SUPER), F.floor(F.col("j") / SUPER)
    tasks = near.select("dim", left.alias("left"), right.alias("right"), F.explode(F.array("i", "j")).alias("interval")).distinct()
    joined = tasks.join(packed.select("dim", "interval", "rows", "units"), ["dim", "interval"]).groupBy("dim", "left", "right").applyInArrow(
        lambda t: _join_intervals(t, axes, cosine), "row long, root long, links long")
    joined = materialize(joined, "vector-links")

    degrees = joined.groupBy("row").agg(F.sum("links").alias("n_links"))
    roots = components(joined.select(F.col("row").alias("a"), F.col("root").alias("b")))
    grouped = placed.select("vec_id", "row").join(roots.toDF("row", "group"), "row", "left").withColumn("group", F.coalesce("group", "row"))
    least = grouped.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    out = grouped.join(least, "group").join(degrees, "row", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id")
    alone = clean.filter("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
