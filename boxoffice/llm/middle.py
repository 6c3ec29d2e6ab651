"""Fill-in-the-middle: a text is cut in prefix, middle and suffix at ends of its units, and the middle moved to the end.

The cuts are found on 64-bit words. A batch's UTF-8 bytes are viewed as uint64; arithmetic on whole words marks the bytes
that end a unit (and those that start a code point); ``bitwise_count`` gives the marks of each word and its running sum the
marks before it. The end of the k-th unit is found by a binary search of that sum for the word, and within the word by
counting the bytes whose running number of marks is below the one wanted. Counts of code points are ranks in the same way.

Which documents change, their form and their two cuts are read from a digest of seed and id, so reruns agree. A text that
holds a mark stays as it is, so ``restored`` always gives back the text.

Plan: one pass, no shuffle; batches are cut in slices of few rows, texts stay whole.

Defined results: null texts are empty; empty texts have no unit and are plain; null ids are hashed as an empty number, so
all of them share their draws; repeated rows are transformed alike; no rows give no rows. Other columns pass through; new
columns whose name is taken get underscores.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from boxoffice.llm.text import fresh, slices, text_buffers

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ANY_MARK = "<[PSM]>"
NEW = ("n", "form", "prefix_chars", "middle_chars")

ONES = np.uint64(0x0101010101010101)
HIGH = np.uint64(0x8080808080808080)
REST = np.uint64(0x7F7F7F7F7F7F7F7F)


def as_words(data: np.ndarray) -> np.ndarray:
    """The bytes eight to a word, lowest first, and at least one zero byte after them."""
    padded = np.zeros(len(data) // 8 * 8 + 8, np.uint8)
    padded[: len(data)] = data
    return padded.view("<u8")


def bytes_equal(words: np.ndarray, byte: int) -> np.ndarray:
    """The high bit of every byte that equals ``byte``; no carry leaves a byte, so the marks are exact."""
    x = words ^ (ONES * np.uint64(byte))
    return ~(((x & REST) + REST) | x | REST)


def code_point_starts(words: np.ndarray) -> np.ndarray:
    return HIGH & (~words | (words << np.uint64(1)))


def line_ends(words: np.ndarray) -> np.ndarray:
    return bytes_equal(words, 10)


def code_point_ends(words: np.ndarray) -> np.ndarray:
    """A byte ends a code point if the next one starts one; the zeros after the data count as starts."""
    starts = code_point_starts(words)
    following = np.append(starts[1:], HIGH)
    return (starts >> np.uint64(8)) | (following << np.uint64(56))


UNITS = {"line": line_ends, "char": code_point_ends}


class Marks:
    """Marked bytes: how many lie before a place, and where the k-th lies."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.before = np.append(0, np.cumsum(np.bitwise_count(marks), dtype=np.int64))

    def rank(self, place: np.ndarray) -> np.ndarray:
        """The marked bytes before byte ``place``."""
        word = place >> 3
        below = (np.uint64(1) << (np.uint64(8) * (place & 7).astype(np.uint64))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the ``k``-th marked byte, from 0."""
        word = np.searchsorted(self.before, k, side="right") - 1
        wanted = (k - self.before[word] + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            running = (self.marks[word] >> np.uint64(7)) * ONES  # each byte: the marks up to it, at most 8
            reached = ((running | HIGH) - wanted * ONES) & HIGH
        return 8 * word + 8 - np.bitwise_count(reached).astype(np.int64)


def cut_points(data: np.ndarray, offsets: np.ndarray, h1: np.ndarray, h2: np.ndarray, unit: str = "line"):
    """Per text: its units, the bytes where prefix and middle end, and the code points of prefix and middle."""
    words = as_words(data)
    ends, chars = Marks(UNITS[unit](words)), Marks(code_point_starts(words))
    first, last = offsets[:-1], offsets[1:]
    earlier = ends.rank(first)
    n = ends.rank(last) - earlier
    closing = np.maximum(last - 1, 0)
    n = n + ((last > first) & (ends.rank(closing + 1) == ends.rank(closing)))  # a last unit without its ending byte

    def end_of(k: np.ndarray) -> np.ndarray:
        inner = (k > 0) & (k < n)
        out = np.where(k > 0, last, first)
        out[inner] = ends.select((earlier + k - 1)[inner]) + 1
        return out

    a, b = h1 % (n + 1), h2 % (n + 1)
    cut, turn = end_of(np.minimum(a, b)), end_of(np.maximum(a, b))
    at = chars.rank(cut)
    return n, cut, turn, at - chars.rank(first), chars.rank(turn) - at


def _draw(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, unit: str = "line") -> DataFrame:
    """``docs`` with the transformed text, and n, form, prefix_chars and middle_chars as the last columns.

    ``rate`` per cent of the documents change, ``spm`` per cent of these to suffix, prefix, middle and the others to prefix,
    suffix, middle; ``unit`` is line or char.
    """
    columns = list(docs.columns)
    names, taken = [], list(columns)
    for name in NEW:
        names.append(fresh(taken, name))
        taken.append(names[-1])
    inner = []
    for name in ("h1", "h2", "changes", "suffix_first"):
        inner.append(fresh(taken, name))
        taken.append(inner[-1])
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    marked = F.col("text").contains(PREFIX) | F.col("text").contains(SUFFIX) | F.col("text").contains(MIDDLE)
    changes = F.coalesce((F.length("text") > 0) & ~marked, F.lit(False)) & (_draw(digest, 2) % 100 < rate)
    drawn = docs.select(*(F.col(f"`{c}`") for c in columns), _draw(digest, 0).alias(inner[0]), _draw(digest, 1).alias(inner[1]),
                        changes.alias(inner[2]), (_draw(digest, 3) % 100 < spm).alias(inner[3]))
    place = columns.index("text")
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]

    def transform(batches):
        for batch in slices(batches):
            data, offsets = text_buffers(batch.column(place))
            h1, h2, change, suffix_first = (batch.column(len(columns) + i).to_numpy(zero_copy_only=False) for i in range(4))
            n, cut, turn, prefix, middle = cut_points(data, offsets, h1, h2, unit)
            whole = memoryview(np.ascontiguousarray(data))
            out = []
            for i, (a, c, t, z) in enumerate(zip(offsets[:-1].tolist(), cut.tolist(), turn.tolist(), offsets[1:].tolist())):
                if not change[i]:
                    out.append(bytes(whole[a:z]))
                elif suffix_first[i]:
                    out.append(b"".join((marks[1], whole[t:z], marks[0], whole[a:c], marks[2], whole[c:t])))
                else:
                    out.append(b"".join((marks[0], whole[a:c], marks[1], whole[t:z], marks[2], whole[c:t])))
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[place] = pa.array(out, pa.binary()).cast(pa.string())
            form = np.where(change, np.where(suffix_first, "spm", "psm"), "plain")
            arrays += [pa.array(n), pa.array(form, pa.string()), pa.array(prefix, pa.int64(), mask=~change), pa.array(middle, pa.int64(), mask=~change)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns + names)

    kinds = (LongType(), StringType(), LongType(), LongType())
    schema = StructType([*docs.schema.fields, *(StructField(name, kind) for name, kind in zip(names, kinds))])
    return drawn.mapInArrow(transform, schema)


def restored(text: Column, form: Column) -> Column:
    """The text before the transformation, from the output and its form.

    Marks cannot arise where parts meet: they start with the only < and end with the only > that they hold.
    """
    parts = F.split(text, ANY_MARK, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)


def middle_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and the digests of the output and of the text rebuilt from it."""
    done = fill_in_middle(docs.select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return done.select("doc_id", *NEW, digest(F.col("text")).alias("output_sha256"),
                       digest(restored(F.col("text"), F.col("form"))).alias("restored_sha256"))
