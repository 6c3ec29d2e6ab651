"""Words of whole texts: Column helpers and vectorised helpers for Arrow batches.

A word is a run of bytes outside a separator set; only A-Z are lower-cased. The vectorised helpers work on
the Arrow buffers of a text column and make no Python object per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_codes = np.arange(256)
IS_WHITE = (_codes == 0x20) | ((_codes >= 0x09) & (_codes <= 0x0D))
IS_PUNCT = (_codes <= 0x2F) | ((_codes >= 0x3A) & (_codes <= 0x60)) | ((_codes >= 0x7B) & (_codes <= 0x7F))
FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and turns every byte outside words of letters and digits into a space.
PUNCT_TO_SPACE = bytes(32 if IS_PUNCT[FOLD[c]] else FOLD[c] for c in range(256))

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def lower_az(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(0))


def total_bytes(frame: DataFrame, column: str = "text") -> int:
    return frame.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0)).alias("n")).first()["n"]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _byte_values(separator: np.ndarray) -> np.ndarray:
    values = mix((np.frombuffer(FOLD, np.uint8).astype(np.uint64) + np.uint64(1)) * _MULTIPLIER)
    values[separator] = 0
    return values


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column and the offsets of its rows; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start of every word, and the number of words per row."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    return starts, np.diff(np.searchsorted(starts, offsets))


def word_hashes(data: np.ndarray, starts: np.ndarray, separator: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of every word, A-Z folded: a polynomial over the word's bytes, scrambled."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    spans = np.diff(np.append(starts, len(data)))
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(separator)
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(int(spans.max()), _MULTIPLIER, np.uint64))
        at = 0
        while at < len(starts):  # pieces of about a megabyte keep the temporary arrays small
            to = max(at + 1, int(np.searchsorted(starts, starts[at] + 1_000_000)))
            piece = data[starts[at]: starts[to] if to < len(starts) else len(data)]
            local = starts[at:to] - starts[at]
            place = np.arange(len(piece)) - np.repeat(local, spans[at:to])
            out[at:to] = np.add.reduceat(values[piece] * powers[place], local)
            at = to
    return mix(out)


def hashed_words(column, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all words of a text column in order, and the number of words per row."""
    data, offsets = text_buffers(column)
    starts, counts = word_spans(data, offsets, separator)
    return word_hashes(data, starts, separator), counts


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def slices(batches, rows: int = 256):
    """The record batches in pieces, so that a task holds the words of few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def hash_share(h: Column) -> Column:
    """A 64-bit hash as a number from 0 to 1."""
    return h / float(1 << 64) + 0.5
