"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of the benchmark items; an item with fewer words is one
pattern. For patterns of one length, a shift table holds, for every block of two words that occurs in a pattern, how far
the block's last occurrence in any pattern is from the pattern's end; at a block that occurs in none, the search jumps
almost a whole window. Where the shift is zero, the block's bucket gives the patterns that may end there, and their words
are compared. Patterns of another length have tables of their own, so one short item does not shorten all jumps.

The benchmark is taken in pieces of at most ``PIECE`` windows; the searches of all pieces follow each other in the same
tasks over the documents, so only one bounded piece at a time is collected, and documents are never shuffled.

Defined results: null and empty texts have no words; items without an id are not searched; repeated items count once per
id; repeated documents give a row each; other columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.text import ALNUM, PUNCT_TO_SPACE, fresh, lower_az
from boxoffice.session import materialize

WINDOW = 10
PIECE = 100_000


def split_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode().translate(PUNCT_TO_SPACE).split()


class Searcher:
    """Wu-Manber tables for patterns of one length: ``patterns`` maps a tuple of words to its item ids."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[str]]):
        self.items = patterns
        self.length = len(next(iter(patterns)))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict = {}
        self.bucket = defaultdict(list)
        for words in patterns:
            for end in range(self.block, self.length + 1):
                key = words[end - self.block: end]
                self.shift[key] = min(self.shift.get(key, self.jump), self.length - end)
            self.bucket[words[-self.block:]].append(words)

    def ends(self, words: list[bytes]):
        """(position after the last word, pattern) of every occurrence."""
        shift, jump, block, length, bucket = self.shift, self.jump, self.block, self.length, self.bucket
        at, n = length, len(words)
        while at <= n:
            key = (words[at - 2], words[at - 1]) if block == 2 else (words[at - 1],)
            step = shift.get(key, jump)
            if step:
                at += step
                continue
            here = tuple(words[at - length: at])
            for pattern in bucket[key]:
                if pattern == here:
                    yield at, pattern
            at += 1


def searchers(windows: list[tuple[list[str], str]]) -> list[Searcher]:
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for words, item in windows:
        pattern = tuple(w.encode() for w in words)
        by_length[len(pattern)][pattern].append(item)
    return [Searcher(p) for _, p in sorted(by_length.items())]


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words, item (id as text), and the number of the piece that each distinct window of an item falls into."""
    words = benchmark.filter("item_id is not null").select(
        F.col("item_id").cast("string").alias("item"), F.regexp_extract_all(lower_az(F.col("text")), F.lit(ALNUM), F.lit(0)).alias("w")
    ).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return words.select("item", "w", F.explode(starts).alias("at")).select(F.slice("w", F.col("at"), window).alias("words"), "item").distinct()


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """``docs`` with hit_words (a byte per word of the text, 1 where hit) and hit_items (ids as text, sorted).

    They are the last two columns; underscores are added to their names if ``docs`` has such columns.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window), "benchmark-windows")
    pieces = max(1, -(-windows.count() // piece))
    windows = windows.withColumn("piece", F.pmod(F.xxhash64("words", "item"), F.lit(pieces)))
    out = docs.select("*", F.lit(None).cast("binary").alias(fresh(docs.columns, "hit_words")),
                      F.lit(None).cast("array<string>").alias(fresh(docs.columns, "hit_items")))
    for k in range(pieces):
        collected = [(r["words"], r["item"]) for r in windows.filter(F.col("piece") == k).collect()]  # about PIECE rows
        tables = spark.sparkContext.broadcast(collected)

        def search(batches, tables=tables):
            found = searchers(tables.value)
            for batch in batches:
                marks, lists = [], []
                earlier = zip(batch.columns[-2].to_pylist(), batch.columns[-1].to_pylist())
                for text, (mark, items) in zip(batch.column("text").to_pylist(), earlier):
                    words = split_words(text)
                    mark = np.zeros(len(words), np.uint8) if mark is None else np.frombuffer(mark, np.uint8).copy()
                    ids = set(items or ())
                    for searcher in found:
                        for end, pattern in searcher.ends(words):
                            mark[end - searcher.length: end] = 1
                            ids.update(searcher.items[pattern])
                    marks.append(mark.tobytes())
                    lists.append(sorted(ids))
                columns = batch.columns[:-2] + [pa.array(marks, pa.binary()), pa.array(lists, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        out = out.mapInArrow(search, out.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every row of ``docs``."""
    found = find_hits(docs.select("doc_id", "text"), benchmark)

    def digest(batches):
        for batch in batches:
            marks = [np.frombuffer(m, np.uint8) for m in batch.column("hit_words").to_pylist()]
            items = batch.column("hit_items").to_pylist()
            hits = np.array([int(m.sum()) for m in marks], np.int64)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_words": pa.array([len(m) for m in marks], pa.int64()), "n_hit": pa.array(hits),
                "n_items": pa.array([len(x) for x in items], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
                "contaminated": pa.array(hits > 0)})

    return found.select("doc_id", "hit_words", "hit_items").mapInArrow(
        digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    found = find_hits(docs, benchmark)
    return found.filter(F.size(found.columns[-1]) == 0).select(*(F.col(f"`{c}`") for c in docs.columns))
