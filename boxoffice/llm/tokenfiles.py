"""Token ids in binary files of patched frame-of-reference blocks.

Rows are range-partitioned and sorted by id; each task encodes its texts and writes files of about ``FILE_IDS`` ids to the
shared folder, named by partition and number, so that a repeated task replaces its own files. A manifest table lists
the files of the finished write; readers take only those, and add up the ids of the files before to get global starts.

A file (little endian): magic, numbers of documents, ids and blocks; the documents' ids, null marks and lengths; for each
block of 256 ids its minimum, bit width, number of exceptions and start in the payload; the payload. A block holds its ids
minus the minimum, packed at the width that covers a percentile of them, and then the positions and values of the
exceptions that do not fit. Of ``PERCENTILES`` each block takes the one that makes it smallest.

Texts of plain and Latin letters are split into the tokenizer's own pieces on their byte arrays; pieces are known by
64-bit fingerprints, and only new ones are passed to the tokenizer's model (with the at most ``CACHE_PIECES`` pieces known
at a time, two of them share a fingerprint with a chance below 1e-7). Texts with contractions are split by a regular
expression, others by white-space words, and texts that hold a special token's mark are encoded as a whole. All this holds for one
normaliser and pre-tokenizer; with a tokenizer that has others, every text is encoded as a whole.

Defined results: null and empty texts have the end id alone; null ids come first; rows with equal ids are in order of their
text's hash; no rows give no files; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from boxoffice.llm.text import IS_WHITE, word_hashes
from boxoffice.session import materialize, new_folder

END_ID = 2
BLOCK = 256
FILE_IDS = 4_000_000
PERCENTILES = (0.80, 0.90, 0.96, 1.0)
CACHE_PIECES = 200_000  # about 30 MB of each Python worker
MAGIC = b"PFORIDS1"
HEADER = struct.Struct("<8sQQQ")

# The normaliser and pre-tokenizer for which the cuts below hold.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
LATIN = "a-zß-öø-ÿ"
PLAIN = re.compile(r"[\t-\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
CONTRACTION = re.compile(r"'(?:[stmd]|re|ve|ll)", re.IGNORECASE)
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LATIN}]+|[0-9]|[^\s0-9{LATIN}]+")

# Bytes of plain and Latin text (UTF-8): classes, and A-Z and À-Þ made lower case.
_WHITE, _LETTER, _DIGIT, _OTHER = range(4)
_byte = np.arange(256)
CLASS = np.where(IS_WHITE, _WHITE, np.where((_byte >= 0x80) | ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte >= 65), _LETTER,
                 np.where((_byte >= 48) & (_byte <= 57), _DIGIT, _OTHER))).astype(np.uint8)
LOWER = np.where((_byte >= 65) & (_byte <= 90) | (_byte >= 0x80) & (_byte <= 0x9E), _byte + 32, _byte).astype(np.uint8)
NOT_IN_PIECE = CLASS == _WHITE
# The characters that stand for bytes in a byte-level vocabulary: printable bytes for themselves, the others above them.
_printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
BYTE_LEVEL = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _printable)}


class Encoder:
    """Token ids of many texts, each followed by the end id."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.cuts_hold = (told.get("normalizer"), told.get("pre_tokenizer"), told["model"].get("type")) == (NORMALIZER, PRE_TOKENIZER, "BPE")
        self.marks = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or r"(?!)")
        self.clear()

    def clear(self) -> None:
        self.known: dict = {}
        self.ids, self.first, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self, keys: list, pieces: list[list[int]]) -> None:
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.first = np.append(self.first, len(self.ids) + np.cumsum(length) - length)
        self.length = np.append(self.length, length)
        self.ids = np.append(self.ids, np.fromiter(chain.from_iterable(pieces), np.uint32, int(length.sum())))
        self.known.update(zip(keys, range(len(self.known), len(self.known) + len(keys))))

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of known pieces in a row, and where each piece ends in them."""
        length = self.length[codes]
        ends = np.cumsum(length)
        return self.ids[np.arange(int(length.sum())) + np.repeat(self.first[codes] - ends + length, length)], ends

    def split(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts of plain and Latin letters without contractions."""
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        data = LOWER[np.frombuffer(b"".join(raw), np.uint8)]
        kind = CLASS[data]
        first = np.ones(len(kind), bool)
        first[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        offsets = np.cumsum(sizes) - sizes
        first[offsets[sizes > 0]] = True
        starts = np.flatnonzero(first)
        inside = kind[starts] != _WHITE
        hashes = word_hashes(data, starts, NOT_IN_PIECE)[inside]
        ends = np.append(starts[1:], len(data))[inside]
        starts = starts[inside]
        keys, where, index = np.unique(hashes, return_index=True, return_inverse=True)
        keys = keys.tolist()
        fresh = [i for i, k in enumerate(keys) if k not in self.known]
        whole, tokenize = data.tobytes(), self.tokenizer.model.tokenize
        spans = zip(starts[where[fresh]].tolist(), ends[where[fresh]].tolist())
        self.learn([keys[i] for i in fresh], [[t.id for t in tokenize(whole[a:b].decode("latin-1").translate(BYTE_LEVEL))] for a, b in spans])
        codes = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[index]
        ids, piece_ends = self.gather(codes)
        last = np.searchsorted(starts, offsets + sizes)  # pieces up to the end of each text
        return np.split(ids, np.append(0, piece_ends)[last[:-1]])

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and the number of ids per text."""
        if not self.cuts_hold:
            found = [[*e.ids, END_ID] for e in self.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.known) > CACHE_PIECES:
            self.clear()
        out: list = [None] * len(texts)
        plain, words = [], []
        for i, text in enumerate(texts):
            text = text or ""
            if self.marks.search(text):
                out[i] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            elif not PLAIN.fullmatch(text):
                words.append((i, [w.decode() for w in text.encode().split()]))
            elif CONTRACTION.search(text):
                words.append((i, PIECE.findall(text.lower())))
            else:
                plain.append(i)
        new = list({p for _, pieces in words for p in pieces if p not in self.known})
        self.learn(new, [e.ids for e in self.tokenizer.encode_batch(new, add_special_tokens=False)])
        for i, pieces in words:
            out[i], _ = self.gather(np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces)))
        for i, ids in zip(plain, self.split([texts[i] or "" for i in plain]) if plain else ()):
            out[i] = ids
        end = np.array([END_ID], np.uint32)
        return np.concatenate([x for ids in out for x in (ids, end)]), np.fromiter(map(len, out), np.int64, len(out)) + 1


_encoders: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder per Python worker: later tasks go on with the pieces of earlier ones."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _to_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of BLOCK values to rows of packed bytes, ``width`` bits a value, most significant bit first."""
    size = 16 if width <= 16 else 32
    bits = np.unpackbits(values.astype(f">u{size // 8}").view(np.uint8).reshape(-1, size // 8), axis=1)[:, size - width:]
    return np.packbits(bits.reshape(len(values), BLOCK * width), axis=1)


def _from_bits(packed: np.ndarray, width: int) -> np.ndarray:
    size = 16 if width <= 16 else 32
    bits = np.zeros((len(packed) * BLOCK, size), np.uint8)
    bits[:, size - width:] = np.unpackbits(packed, axis=1).reshape(-1, width)
    return np.packbits(bits, axis=1).view(f">u{size // 8}").reshape(-1, BLOCK).astype(np.uint32)


def pack_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimum, width, exceptions, start of each block, and the payload."""
    blocks = -(-len(ids) // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[: len(ids)] = ids
    full[len(ids):] = ids[-1] if len(ids) else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(1) if blocks else np.zeros(0, np.uint32)
    rest = full - low[:, None]
    need = np.empty(rest.shape, np.uint8)  # bits of each value
    for at in range(0, blocks, 1024):
        need[at: at + 1024] = np.ceil(np.log2(rest[at: at + 1024].astype(np.float64) + 1))
    ranked = np.sort(need, axis=1)
    choices = ranked[:, [min(BLOCK - 1, int(p * BLOCK)) for p in PERCENTILES]].astype(np.int64)
    cost = np.stack([BLOCK // 8 * w + 5 * (need > w[:, None]).sum(1) for w in choices.T], axis=1)
    width = choices[np.arange(blocks), cost.argmin(1)]
    patched = need > width[:, None]
    exceptions = patched.sum(1)
    sizes = BLOCK // 8 * width + 5 * exceptions
    start = np.cumsum(sizes) - sizes
    payload = np.zeros(int(sizes.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, -(-len(own) // 2048)):
            payload[start[part, None] + np.arange(BLOCK // 8 * w)] = _to_bits(rest[part] & np.uint32((1 << int(w)) - 1), int(w))
    block, place = np.nonzero(patched)
    number = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = start[block] + BLOCK // 8 * width[block]
    payload[at + number] = place
    payload[(at + exceptions[block] + 4 * number)[:, None] + np.arange(4)] = full[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return low, width.astype(np.uint8), exceptions.astype(np.uint16), start.astype(np.uint64), payload


def unpack_ids(n: int, low, width, exceptions, start, payload) -> np.ndarray:
    start, width, exceptions = start.astype(np.int64), width.astype(np.int64), exceptions.astype(np.int64)
    full = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width[width > 0]):
        own = np.flatnonzero(width == w)
        for part in np.array_split(own, -(-len(own) // 2048)):
            full[part] = _from_bits(payload[start[part, None] + np.arange(BLOCK // 8 * w)], int(w))
    full += low[:, None]
    block = np.repeat(np.arange(len(low)), exceptions)
    number = np.arange(len(block)) - np.repeat(np.cumsum(exceptions) - exceptions, exceptions)
    at = start[block] + BLOCK // 8 * width[block]
    values = payload[(at + exceptions[block] + 4 * number)[:, None] + np.arange(4)]
    full[block, payload[at + number]] = np.ascontiguousarray(values).view("<u4").reshape(-1)
    return full.reshape(-1)[:n]


def file_bytes(doc_ids: list, counts: np.ndarray, ids: np.ndarray) -> bytes:
    low, width, exceptions, start, payload = pack_ids(ids)
    return b"".join([
        HEADER.pack(MAGIC, len(doc_ids), len(ids), len(low)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
        bytes(d is None for d in doc_ids), counts.astype("<u8").tobytes(), low.astype("<u4").tobytes(), width.tobytes(),
        exceptions.astype("<u2").tobytes(), start.astype("<u8").tobytes(), payload.tobytes()])


def parse_file(content: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, their numbers of token ids, and all token ids of a file."""
    magic, docs, n, blocks = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    at = HEADER.size

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(content, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, null, counts = take("<i8", docs), take("u1", docs), take("<u8", docs)
    ids = unpack_ids(n, take("<u4", blocks), take("u1", blocks), take("<u2", blocks), take("<u8", blocks), np.frombuffer(content, np.uint8, -1, at))
    return [None if x else int(d) for d, x in zip(doc_ids, null)], counts.astype(np.int64), ids


def _write(folder: str, name: str, content: bytes) -> None:
    """Whole files only: a temporary name first."""
    store, path = fs.FileSystem.from_uri(re.sub("^file:/*", "file:///", folder))
    store.create_dir(path, recursive=True)
    part = f"{path}/_{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(content)
    store.move(part, f"{path}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Encodes every row of ``docs`` (doc_id, text) into files in ``folder``; the manifest: name, ids, first_id."""
    def encode(batches):
        encoder, number = encoder_of(tokenizer), 0
        partition = TaskContext.get().partitionId()
        held, held_docs, held_counts, size = [], [], [], 0

        def flush():
            nonlocal held, held_docs, held_counts, size, number
            name = f"part-{partition:07d}-{number:05d}.pfor"
            _write(folder, name, file_bytes(held_docs, np.concatenate(held_counts), np.concatenate(held)))
            row = pa.RecordBatch.from_pydict({"name": [name], "ids": [size]})
            held, held_docs, held_counts, size, number = [], [], [], 0, number + 1
            return row

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                ids, counts = encoder.encode(part.column("text").to_pylist())
                held.append(ids)
                held_docs.extend(part.column("doc_id").to_pylist())
                held_counts.append(counts)
                size += len(ids)
                if size >= file_ids:
                    yield flush()
        if held:
            yield flush()

    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    manifest = materialize(ordered.mapInArrow(encode, "name string, ids long"), "token-manifest")
    before = Window.orderBy("name").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return manifest.withColumn("first_id", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files listed."""
    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content")):
                doc_ids, counts, ids = parse_file(content.as_buffer())
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c): 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "name": pa.array([name] * len(doc_ids)), "doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(ends - counts),
                    "n_tokens": pa.array(counts), "ids_crc32": pa.array(crc, pa.int64())})

    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.pfor").load(folder).select(
        F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    parsed = files.mapInArrow(decode, "name string, doc_id long, start long, n_tokens long, ids_crc32 long")
    return parsed.join(manifest.select("name", "first_id"), "name").select(
        "doc_id", (F.col("start") + F.col("first_id")).alias("start"), "n_tokens", "ids_crc32")


def document_tokens(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the token files of ``docs`` and reads them back. Runs jobs while it is built."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    manifest = write_token_files(docs, folder, tokenizer or public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, folder, manifest)
