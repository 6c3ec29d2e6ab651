"""LM scoring by deleted interpolation.

n-gram maximum-likelihood estimates of every order are mixed; the weights depend on how often the longest
seen context occurred (buckets by powers of two) and are learned by expectation-maximisation on the counts
of a part of the training texts that is deleted from the estimates. Scores then use the counts of all training texts if ``whole``.

Plan. Texts are dealt into blocks of about ``BLOCK_BYTES``. A block sends each of its distinct n-grams once,
as sorted packed 64-bit fingerprints, to the owner of the fingerprint's range; owners add up the counts of all
blocks and send back one small integer per n-gram asked for. So the shuffled data follows the distinct n-grams,
a frequent n-gram costs one entry per block, and no table of counts is ever broadcast or collected. The orders are
asked for one after the other, and the shuffles of an order are deleted once its replies are stored: the disk holds
the questions of one order at a time. The driver sees only two totals and the histogram of held-out cells, whose size
the bins bound.

Defined results: null texts are empty (one end token); a null id belongs to the training texts; repeated rows are
scored, and counted, each for itself; other columns are ignored. Without training texts every probability is 1.
Words are known by 64-bit fingerprints; with a billion distinct words two of them share one with a chance of 3%.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.text import IS_WHITE, hashed_words, id_crc, mix, total_bytes
from boxoffice.session import materialize, shuffles_deleted

BLOCK_BYTES = 8_000_000
BUCKET_CODES = 1_500_000
BINS_PER_OCTAVE = 8
CELLS = 100_000
NONE = -32768  # the bin of a zero estimate
START, END = np.uint64(0xA5A5A5A5DEADBEEF), np.uint64(0x5A5A5A5A0BADF00D)

QUERY = "bucket int, block int, n_tokens int, n int, codes binary, counts binary, train binary"
REPLY = "block int, n_tokens int, bucket int, n long, kept binary, total binary, train binary, kept_total long, train_total long"


def pack_sorted(codes: np.ndarray) -> bytes:
    """Ascending 64-bit codes as the first code and fixed-width differences."""
    gaps = np.diff(codes)
    width = max(1, (int(gaps.max()).bit_length() + 7) // 8) if len(gaps) else 1
    return bytes([width]) + codes[:1].tobytes() + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(blob: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n - 1, 8), np.uint8)
    wide[:, : blob[0]] = np.frombuffer(blob, np.uint8, offset=9).reshape(n - 1, blob[0])
    out = np.empty(n, np.uint64)
    out[0] = np.frombuffer(blob, np.uint64, 1, 1)[0]
    out[1:] = wide.reshape(-1).view(np.uint64)
    return np.cumsum(out, dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    top = int(counts.max()) if len(counts) else 0
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return counts.astype(f"<u{width}").tobytes()


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"<u{len(blob) // n}").astype(np.int64)


class Tokens:
    """The n-grams of a block's rows, up to the ``longest`` asked for. Every row reads: order - 1 starts, its words, one end."""

    def __init__(self, table: pa.Table, order: int, longest: int | None = None):
        words, counts = hashed_words(table.column("text"), IS_WHITE)
        self.pad = order - 1
        lengths = counts + self.pad + 1
        self.first = np.cumsum(lengths) - lengths
        self.row = np.repeat(np.arange(len(counts)), lengths)
        place = np.arange(int(lengths.sum())) - self.first[self.row]
        self.is_word = (place >= self.pad) & (place < (lengths - 1)[self.row])
        sequence = np.where(place < self.pad, START, END)
        sequence[self.is_word] = words
        self.scored = place >= self.pad
        self.codes, self.ends = [], []
        code = mix(sequence)
        for m in range(1, (longest or order) + 1):
            if m > 1:  # the n-gram that ends here: the shorter one that ended a place before, and this token
                longer = np.zeros_like(code)
                with np.errstate(over="ignore"):
                    longer[1:] = mix(code[:-1] * np.uint64(0x9E3779B97F4A7C15) + sequence[1:] + np.uint64(m))
                code = longer
            self.codes.append(code)
            # n-grams end at a token, or at the last start: contexts of first words are counted as well
            self.ends.append(place >= max(m - 1, self.pad - 1))
        self.n_tokens = counts + 1

    def row_sums(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=values, minlength=len(self.first))


def _ask(table: pa.Table, order: int, m: int, buckets: int) -> pa.Table:
    """One question per range of fingerprints: the block's distinct n-grams of ``m`` tokens."""
    tokens = Tokens(table, order, m)
    block = table.column("block")[0].as_py()
    train_row = np.asarray(table.column("part")) <= 1
    out = {k: [] for k in ("bucket", "block", "n_tokens", "n", "codes", "counts", "train")}
    at = tokens.ends[m - 1]
    codes, index = np.unique(tokens.codes[m - 1][at], return_inverse=True)
    rows = tokens.row[at]
    # of the deleted texts in blocks below 0, of the kept ones in all others
    given = np.bincount(index, weights=train_row[rows], minlength=len(codes)).astype(np.int64)
    train = np.bincount(index, weights=(train_row[rows] & tokens.scored[at]), minlength=len(codes)).astype(np.int64)
    bucket = ((codes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    for lo, hi in zip([0, *cuts], [*cuts, len(codes)]):
        for name, value in zip(out, (int(bucket[lo]), block, m, hi - lo, pack_sorted(codes[lo:hi]), pack_counts(given[lo:hi]),
                                     pack_counts(train[lo:hi]) if m == 1 else b"")):
            out[name].append(value)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def _answer(table: pa.Table, whole: bool) -> pa.Table:
    """Adds up the counts of one range of fingerprints; one reply per question, and a row of totals.

    A reply has the counts that its block needs: of kept texts to learn the weights, of all training texts to score if ``whole``.
    """
    out = {k: [] for k in ("block", "n_tokens", "bucket", "n", "kept", "total", "train", "kept_total", "train_total")}
    start = mix(np.array([START]))[0]
    asked = table.to_pydict()
    for m in sorted(set(asked["n_tokens"])):
        mine = [i for i, k in enumerate(asked["n_tokens"]) if k == m]
        sizes = [asked["n"][i] for i in mine]
        codes = np.concatenate([unpack_sorted(asked["codes"][i], n) for i, n in zip(mine, sizes)])
        codes, index = np.unique(codes, return_inverse=True)
        total = {}
        for name in ("counts", "train") if m == 1 else ("counts",):
            given = np.concatenate([unpack_counts(asked[name][i], n) for i, n in zip(mine, sizes)])
            total[name] = np.bincount(index, weights=given, minlength=len(codes)).astype(np.int64)
            if name == "counts":
                given = given * np.repeat([asked["block"][i] >= 0 for i in mine], sizes)
                total["kept"] = np.bincount(index, weights=given, minlength=len(codes)).astype(np.int64)
        cuts = np.cumsum([0, *sizes])
        for k, i in enumerate(mine):
            part = index[cuts[k]: cuts[k + 1]]
            train = pack_counts(total["train"][part]) if m == 1 else b""
            kept = pack_counts(total["kept"][part]) if asked["block"][i] < 0 or not whole else b""
            counts = pack_counts(total["counts"][part]) if whole else b""
            for name, value in zip(out, (asked["block"][i], m, asked["bucket"][i], sizes[k], kept, counts, train, 0, 0)):
                out[name].append(value)
        if m == 1:
            real = codes != start
            for name, value in zip(out, (None, 0, asked["bucket"][mine[0]], int((total["train"] > 0).sum()), b"", b"", b"",
                                         int(total["kept"][real].sum()), int(total["train"].sum()))):
                out[name].append(value)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    return pa.table({k: pa.array(v, t) for (k, v), t in zip(out.items(), types)})


def _counted(tokens: Tokens, replies: pa.Table, order: int, column: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Counts (of ``column``: kept, total) of the n-gram of every order ending at each place; training count of each token."""
    got = sorted(zip(*(replies.column(c).to_pylist() for c in ("n_tokens", "bucket", "n", column, "train"))))
    kept, train = [], np.zeros(0)
    for m in range(1, order + 1):
        at = tokens.ends[m - 1]
        _, index = np.unique(tokens.codes[m - 1][at], return_inverse=True)
        mine = [x for x in got if x[0] == m]
        counts = np.concatenate([unpack_counts(x[3], x[2]) for x in mine])
        here = np.zeros(len(at), np.int64)
        here[at] = counts[index]
        kept.append(here)
        if m == 1:
            train = np.zeros(len(at), np.int64)
            train[at] = np.concatenate([unpack_counts(x[4], x[2]) for x in mine])[index]
    return kept, train


def _estimates(tokens: Tokens, kept: list[np.ndarray], totals: dict, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Context bucket and the estimate of every order (0: uniform) at each scored place."""
    at = np.flatnonzero(tokens.scored)
    f = np.zeros((order + 1, len(at)))
    f[0] = 1.0 / (totals["types"] + 1)
    f[1] = kept[0][at] / max(1, totals["kept"])
    key = np.zeros(len(at), np.int64)
    for m in range(2, order + 1):
        context = kept[m - 2][at - 1]
        seen = context > 0
        f[m][seen] = kept[m - 1][at][seen] / context[seen]
        key[seen] = (m - 2) * 64 + 1 + np.log2(context[seen]).astype(np.int64)
    return key, f


def _held_out(block: pa.Table, replies: pa.Table, order: int, totals: dict) -> pa.Table:
    """Cells of held-out tokens: context bucket, and the bins of each estimate's ratio to the uniform one."""
    tokens = Tokens(block, order)
    kept, _ = _counted(tokens, replies, order, "kept")
    key, f = _estimates(tokens, kept, totals, order)
    with np.errstate(divide="ignore"):
        bins = np.where(f[1:] > 0, np.round(np.log2(f[1:] / f[0]) * BINS_PER_OCTAVE), NONE).astype(np.int64)
    cells, counts = np.unique(np.vstack([key[None], bins]), axis=1, return_counts=True)
    return pa.table({"key": pa.array(cells[0], pa.int32()), "bins": pa.array(cells[1:].T.tolist(), pa.list_(pa.int32())),
                     "n": pa.array(counts, pa.int64())})


def _score(block: pa.Table, replies: pa.Table, order: int, totals: dict, weights: np.ndarray, whole: bool) -> pa.Table:
    tokens = Tokens(block, order)
    counts, train = _counted(tokens, replies, order, "total" if whole else "kept")
    key, f = _estimates(tokens, counts, {**totals, "kept": totals["train"]} if whole else totals, order)
    logs = np.zeros(len(tokens.row))
    logs[tokens.scored] = np.log10((weights[key].T * f).sum(0))
    base = np.where(tokens.scored, np.log10((train + 1) / (totals["train"] + totals["types"] + 1)), 0)
    return pa.table({
        "doc_id": block.column("doc_id"), "held_out": pa.array(np.asarray(block.column("part")) == 2),
        "n_tokens": pa.array(tokens.n_tokens, pa.int64()),
        "n_known": pa.array(tokens.row_sums((train > 0) & tokens.scored).astype(np.int64)),
        "train_tokens": pa.array(np.full(len(tokens.n_tokens), totals["train"]), pa.int64()),
        "base_score": pa.array(tokens.row_sums(base)), "score": pa.array(tokens.row_sums(logs)),
    })


def learn_weights(cells: list[tuple[int, list[int], int]], order: int, rounds: int = 60) -> np.ndarray:
    """Mixture weights per context bucket by expectation-maximisation over the held-out cells.

    ``cells``: bucket, bins of the estimates' ratios, tokens. A bucket without held-out tokens takes the weights of the
    nearest bucket of its context length, and equal weights if there is none.
    """
    return fit_weights(np.array([c[0] for c in cells], np.int64), np.array([c[1] for c in cells], np.int64).reshape(-1, order),
                       np.array([c[2] for c in cells], float), order, rounds)


def fit_weights(key: np.ndarray, bins: np.ndarray, n: np.ndarray, order: int, rounds: int = 60) -> np.ndarray:
    """``learn_weights`` of cells in columns; besides a ratio per cell and order it holds the shares of ``CELLS`` cells at a time."""
    keys = 1 + 64 * (order - 1)
    longest = np.array([1 if k == 0 else 2 + (k - 1) // 64 for k in range(keys)])
    usable = np.arange(order + 1)[None] <= longest[:, None]
    weights = usable / usable.sum(1, keepdims=True)
    if not len(key):
        return weights
    ratio = np.ones((len(key), order + 1))
    for m in range(order):
        ratio[:, m + 1] = np.where(bins[:, m] == NONE, 0, np.exp2(bins[:, m] / BINS_PER_OCTAVE))
    seen = np.bincount(key, weights=n, minlength=keys)
    for _ in range(rounds):
        sums = np.zeros((order + 1, keys))
        for at in range(0, len(key), CELLS):
            here = slice(at, at + CELLS)
            share = weights[key[here]] * ratio[here]
            share *= (n[here] / share.sum(1))[:, None]
            for m in range(order + 1):
                sums[m] += np.bincount(key[here], weights=share[:, m], minlength=keys)
        for m in range(order + 1):
            weights[:, m] = np.where(seen > 0, (sums[m] + 1e-3 * usable[:, m])
                                     / (seen + 1e-3 * usable.sum(1)), weights[:, m])
    for k in np.flatnonzero(seen == 0):
        near = [j for j in np.flatnonzero(seen > 0) if longest[j] == longest[k]]
        if near:
            weights[k] = weights[min(near, key=lambda j: abs(j - k))]
    return weights


def interpolated_scores(docs: DataFrame, held_out: Column, deleted: Column, order: int = 2, whole: bool = False) -> DataFrame:
    """Scores every row of ``docs`` (doc_id, text), learning from those that are not ``held_out``.

    ``deleted`` marks the training rows whose counts teach the weights and are left out of the estimates meanwhile; the scores
    use the counts of all training rows if ``whole``, else of those not deleted.
    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Runs jobs while it is built.
    """
    spark = docs.sparkSession
    size = total_bytes(docs)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(size / BLOCK_BYTES))
    buckets = max(least, math.ceil(size / 6 / BUCKET_CODES))
    part = F.when(held_out, 2).when(deleted, 1).otherwise(0)
    place = F.xxhash64("doc_id", "text")
    rows = docs.select("doc_id", "text", part.cast("int").alias("part")).withColumn(
        "block", F.when(F.col("part") == 1, -1 - F.pmod(place, F.lit(max(1, blocks // 8)))).otherwise(F.pmod(place, F.lit(blocks))).cast("int"))

    def counted(m: int) -> DataFrame:
        questions = rows.groupBy("block").applyInArrow(lambda t: _ask(t, order, m, buckets), QUERY)
        with shuffles_deleted(spark):
            return materialize(questions.groupBy("bucket").applyInArrow(lambda t: _answer(t, whole), REPLY), "lm-counts")

    replies = reduce(DataFrame.unionAll, [counted(m) for m in range(1, order + 1)])
    sums = replies.filter("block is null").agg(F.sum("n"), F.sum("kept_total"), F.sum("train_total")).first()
    totals = dict(zip(("types", "kept", "train"), (x or 0 for x in sums)))
    of_blocks = replies.filter("block is not null").select("block", "n_tokens", "bucket", "n", "kept", "total", "train")

    held = rows.filter("part = 1").groupBy("block").cogroup(of_blocks.filter("block < 0").groupBy("block")).applyInArrow(
        lambda left, right: _held_out(left, right, order, totals), "key int, bins array<int>, n long")
    with shuffles_deleted(spark):
        cells = held.groupBy("key", "bins").agg(F.sum("n").alias("n")).toArrow()  # in columns: no Python object per cell
    bins = np.asarray(pa.concat_arrays([c.flatten() for c in cells.column("bins").chunks] or [pa.array([], pa.int32())])).reshape(-1, order)
    weights = fit_weights(np.asarray(cells.column("key")), bins, np.asarray(cells.column("n"), float), order)
    return rows.groupBy("block").cogroup(of_blocks.groupBy("block")).applyInArrow(
        lambda left, right: _score(left, right, order, totals, weights, whole),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def document_scores(docs: DataFrame, order: int = 2, whole: bool = False) -> DataFrame:
    """``interpolated_scores`` with documents held out, and deleted, by a checksum of their ids."""
    crc = id_crc()
    return interpolated_scores(docs, F.pmod(crc, F.lit(7)) == 2, F.pmod(F.floor(crc / 7), F.lit(10)) == 3, order, whole)
