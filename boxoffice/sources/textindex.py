"""A stored index of three-character grams, so that substring searches read few files.

Text search ignores case and accents (``has_text``). Texts are folded: lower case, accented letters to their base letter,
combining marks dropped. Within printable ASCII and line breaks two characters are equal to the search exactly if they
are equal when folded, so a text that contains a needle holds every gram of the folded needle. A text that folds to anything else
(other scripts, ligatures...) is posted under ``UNFOLDED`` alone and is a candidate of every search. Candidates are a superset; the search's own predicate then
decides, so results equal the scan's.

Texts are padded at their end, so every position starts a gram: a needle of one or two characters is a range of grams. A needle
that cannot be folded, or whose rarest gram is in more than ``SHARE`` of the rows, is left to the scan.

Rows are posted in blocks of up to ``BLOCK``: a gram has one row per block, with the places of its rows in the block as small numbers, and the keys
of a block are stored once (under the field ``KEYS``). So a posting costs two bytes, whatever the key is. ``postings`` (field, gram, block, rows, keys)
is range-partitioned and sorted by field and gram: a search skips all files and row groups
whose minimum and maximum exclude its grams, and a gram that many rows hold spreads over several files. ``counts`` tells the
rarest grams. New or edited rows are appended; what edits and deletions leave behind fails the predicate, and repeated postings
do no harm. ``compacted`` writes everything anew. The blocks are stored before they are sorted, so that a lost executor cannot mix two orders of the rows.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, LongType, ShortType, StringType, StructField, StructType

from boxoffice.session import materialize

GRAM = 3
PAD = "\x01"  # sorts before every folded character
UNFOLDED = ""
KEYS = ""  # the field of the rows that hold a block's keys
BLOCK = 8192  # rows of a block; places in it are two-byte numbers
RAREST = 3  # grams of a needle that are looked up
SHARE = 0.2
PUSHED = 1000  # so many candidates become a list that is pushed into the scan
ROW_GROUP = 8 << 20

# Letters that are an ASCII letter with combining marks, and the marks themselves (but those that are more than an accent).
_letters = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
_accented = {c: d[0].lower() for c, d in _letters if d[0].isascii() and len(d) > 1 and all(unicodedata.category(m) == "Mn" for m in d[1:])}
_marks = "".join(chr(c) for c in range(0x300, 0x370) if c not in (0x345, 0x34F) and unicodedata.category(chr(c)) == "Mn")
FROM, TO = "".join(_accented) + _marks, "".join(_accented.values())
FOLDED = r"[\x20-\x7e\t\n\r]*"


def folded_text(text: Column) -> Column:
    return F.translate(F.lower(text), FROM, TO)


def folded_needle(needle: str) -> str | None:
    """The needle as the index knows it, or None if it holds anything that the fold does not cover."""
    text = needle.lower().translate({ord(c): TO[i] if i < len(TO) else None for i, c in enumerate(FROM)})
    return text if all(" " <= c <= "~" or c in "\t\n\r" for c in text) else None


def indexed_text(text: Column) -> Column:
    """The folded text; of one beyond the fold, ``PAD`` alone."""
    folded = folded_text(text)
    known = lambda c: c.rlike(rf"\A{FOLDED}\z")  # noqa: E731 - PAD is not among these characters
    return F.when(known(text), F.lower(text)).when(known(folded), folded).when(text.isNotNull(), F.lit(PAD))


def _postings(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Of a block of indexed texts: its distinct (gram, row), as codes of the grams, ascending, and rows; and how many rows have any."""
    texts = pa.concat_arrays([texts.cast(pa.string()).fill_null("")])
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset: texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]: offsets[-1]].astype(np.int64)
    sizes, ends = np.diff(offsets), offsets[1:] - offsets[0]
    row = np.repeat(np.arange(len(texts)), sizes)
    second, third = (np.full(len(data), ord(PAD)) for _ in range(2))
    left = ends[row] - np.arange(len(data))  # characters from here to the text's end
    second[left > 1], third[left > 2] = data[1:][left[:-1] > 1], data[2:][left[:-2] > 2]
    code = np.where(data == ord(PAD), 0, data << 16 | second << 8 | third)  # within the fold no text holds PAD
    found = np.unique(code * BLOCK + row)
    return found // BLOCK, found % BLOCK, int(np.count_nonzero(sizes))


def _posted(fields: Sequence[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(field: str, grams: pa.Array, block: int, counts: np.ndarray, places: pa.Array, keys: pa.Array | None) -> pa.RecordBatch:
        n = len(grams)
        keys = pa.nulls(n, schema.field("keys").type) if keys is None else pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys.cast(schema.field("keys").type.value_type))
        return pa.RecordBatch.from_arrays([pa.array([field] * n, pa.string()), grams, pa.array([block] * n, pa.int64()), pa.array(counts, pa.int32()), places, keys], schema=schema)

    def lists(starts: np.ndarray, places: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.append(starts, len(places)), pa.int32()), pa.array(places, pa.int16()))

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in (b.slice(i, BLOCK) for b in batches for i in range(0, b.num_rows, BLOCK)):
            none = np.empty(0, np.int16)
            yield rows(KEYS, pa.nulls(1, pa.string()), block, np.array([batch.num_rows]), lists(np.zeros(1, np.int64), none), batch.column(0))
            for i, field in enumerate(fields):
                codes, places, filled = _postings(batch.column(i + 1))
                starts = np.flatnonzero(np.diff(codes, prepend=-1))
                grams = pa.array([UNFOLDED if c == 0 else c.to_bytes(GRAM, "big").decode() for c in codes[starts].tolist()], pa.string())
                # the number of rows with any gram goes along (gram NULL)
                yield rows(field, pa.nulls(1, pa.string()), block, np.array([filled]), lists(np.zeros(1, np.int64), none), None)
                yield rows(field, grams, block, np.diff(np.append(starts, len(codes))), lists(starts, places), None)
            block += 1
    return post


class TextIndex:
    """An index of some text fields of a table, in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, frame: DataFrame, key: str, fields: Sequence[str]) -> TextIndex:
        """Post the rows of ``frame``: all of a table, or those that are new or edited."""
        schema = StructType([
            StructField("field", StringType()), StructField("gram", StringType()), StructField("block", LongType()), StructField("n", IntegerType()),
            StructField("rows", ArrayType(ShortType())), StructField("keys", ArrayType(frame.schema[key].dataType))])
        texts = frame.select(F.col(key).alias("key"), *(indexed_text(F.col(f)).alias(f"text{i}") for i, f in enumerate(fields)))
        blocks = materialize(texts.mapInArrow(_posted(list(fields), to_arrow_schema(schema)), schema), "gram-blocks")
        added = uuid.uuid4().hex
        stored = blocks.filter(F.col("gram").isNotNull() | (F.col("field") == KEYS)).select("field", "gram", "block", "rows", "keys")
        stored.repartitionByRange("field", "gram", "block").sortWithinPartitions("field", "gram", "block").write.option(
            "parquet.block.size", ROW_GROUP).parquet(f"{self.folder}/postings/added={added}")
        # one row per field and gram, and one per field with the number of its rows (gram NULL)
        counts = blocks.filter(F.col("field") != KEYS).groupBy("field", "gram").agg(F.sum("n").alias("n"))
        counts.repartitionByRange("field", "gram").sortWithinPartitions("field", "gram").write.parquet(f"{self.folder}/counts/added={added}")
        return self

    def compacted(self, frame: DataFrame, key: str, fields: Sequence[str], folder: str) -> TextIndex:
        return TextIndex(self.spark, folder).add(frame, key, fields)

    def _looked_up(self, field: str, needle: str) -> tuple[list[str], int] | None:
        """The grams to read (a single short one stands for all that start with it) and how many candidates they give at most."""
        text = folded_needle(needle)
        if not text:
            return None
        counts = self.spark.read.parquet(f"{self.folder}/counts").filter(F.col("field") == field)
        grams = sorted({text[i: i + GRAM] for i in range(len(text) - GRAM + 1)})
        wanted = F.col("gram").isin(*grams) if grams else F.col("gram").startswith(text)
        seen = counts.filter(wanted | F.col("gram").isNull() | (F.col("gram") == UNFOLDED)).groupBy(
            F.when(F.col("gram").isin(*grams) | F.col("gram").isNull() | (F.col("gram") == UNFOLDED), F.col("gram")).otherwise(F.lit(text)).alias("gram")).agg(F.sum("n").alias("n"))
        found = {r["gram"]: r["n"] for r in seen.collect()}  # at most a row per gram of the needle
        chosen = sorted(grams or [text], key=lambda g: found.get(g, 0))[:RAREST]
        most = found.get(chosen[0], 0) + found.get(UNFOLDED, 0)
        return (chosen, most) if most <= SHARE * found.get(None, 0) else None

    def candidates(self, field: str, needle: str) -> tuple[DataFrame, int] | None:
        """The keys (with their greatest possible number) of rows that may contain the needle; None to scan."""
        found = self._looked_up(field, needle)
        if found is None:
            return None
        chosen, most = found
        stored = self.spark.read.parquet(f"{self.folder}/postings")
        postings, at = stored.filter(F.col("field") == field), ["added", "block"]
        if len(chosen[0]) < GRAM:
            places = postings.filter(F.col("gram").startswith(chosen[0]) | (F.col("gram") == UNFOLDED)).select(*at, "rows")
        else:
            # per block, a row of each gram that is there: the places common to all, and those beyond the fold
            rows_of = lambda gram: F.coalesce(F.max(F.when(F.col("gram") == gram, F.col("rows"))), F.array().cast("array<smallint>"))
            found = postings.filter(F.col("gram").isin(*chosen, UNFOLDED)).groupBy(*at).agg(
                *(rows_of(g).alias(f"rows{i}") for i, g in enumerate(chosen)), rows_of(UNFOLDED).alias("beyond"))
            common = reduce(F.array_intersect, [F.col(f"rows{i}") for i in range(len(chosen))])
            places = found.select(*at, F.array_union(common, F.col("beyond")).alias("rows")).filter(F.size("rows") > 0)
        blocks = stored.filter(F.col("field") == KEYS).select(*at, "keys")
        keys = places.join(blocks, at).select(F.explode(F.transform("rows", lambda place: F.col("keys")[place])).alias("key"))
        return keys, most

    def narrowed(self, frame: DataFrame, key: str, fields: Sequence[str], needle: str) -> DataFrame:
        """The rows of ``frame`` that may contain the needle in one of the fields: a superset, for the predicate to decide."""
        if not needle:
            return frame
        found = [self.candidates(f, needle) for f in fields]
        if any(f is None for f in found):
            return frame
        keys = found[0][0]
        for more, _ in found[1:]:
            keys = keys.unionByName(more)
        keys = keys.distinct()
        if sum(most for _, most in found) <= PUSHED:
            return frame.filter(F.col(key).isin(*(r["key"] for r in keys.collect())))
        return frame.join(keys.withColumnRenamed("key", key), key, "left_semi")
