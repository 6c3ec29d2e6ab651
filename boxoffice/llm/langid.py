"""Language ID by segmentation-marginalised unigram models.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability is the sum over all
its segmentations into pieces, computed by the forward algorithm; a text's is the product over its words. The piece
probabilities are learned by expectation-maximisation (forward-backward) from a bounded sample of labelled documents,
``SAMPLE_DOCS`` per language; each round is a Spark job that returns one count per piece and language. Bytes that no
piece covers have a piece of their own, so every text has a probability.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. In a task each distinct word is computed
once for many words at a time; very long words take a path of constant memory per byte. The score is the posterior of
the predicted language, all languages being equally likely beforehand.

Defined results: ``und`` with score 0 for null texts and texts without a letter, and for every text if there is nothing to
learn from; null languages teach nothing; repeated rows are predicted alike and teach once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.decontam import split_words
from boxoffice.llm.text import ALNUM, fresh, hash_share, id_crc, lower_az, slices
from boxoffice.session import materialize

SAMPLE_DOCS = 1000
ROUNDS = 4
SMOOTHING = 0.05  # added to each piece's expected count
LONG = 48  # bytes; longer words are computed one at a time
CACHE_WORDS = 200_000
WORD_START = b" "  # stands for the vocabulary's mark of a word start
MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            piece = model.id_to_piece(i).replace(MARK, " ").encode()
            if b" " not in piece[1:]:
                pieces.add(piece)
    return sorted(pieces)


class Pieces:
    """Finds the pieces in many words at once: polynomial hashes of substrings, looked up in an open hash table."""

    SLOTS = 20

    def __init__(self, pieces: list[bytes]):
        self.count = len(pieces)
        self.longest = max(map(len, pieces))
        self.index = {p: i for i, p in enumerate(pieces)}
        self.keys = np.array([self.hash_one(p) for p in pieces], np.uint64)
        assert len(np.unique(self.keys)) == self.count
        self.slots = np.full(1 << self.SLOTS, self.count, np.int32)
        self.probes = 1
        for i, key in enumerate(self.keys.tolist()):
            slot, tries = self._slot(key), 1
            while self.slots[slot] != self.count:
                slot, tries = (slot + 1) & ((1 << self.SLOTS) - 1), tries + 1
            self.slots[slot] = i
            self.probes = max(self.probes, tries)
        self.keys = np.append(self.keys, np.uint64(0))

    @classmethod
    def _slot(cls, key: int) -> int:
        return ((key ^ (key >> 29)) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF) >> (64 - cls.SLOTS)

    @staticmethod
    def hash_one(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of the piece with each hash, or ``count``."""
        with np.errstate(over="ignore"):
            slot = ((hashes ^ (hashes >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.SLOTS)
        slot = slot.astype(np.int64)
        got = self.slots[slot]
        found = np.where(self.keys[got] == hashes, got, self.count)
        left = np.flatnonzero((found == self.count) & (got != self.count))
        for step in range(1, self.probes):
            if not len(left):
                break
            got = self.slots[(slot[left] + step) & ((1 << self.SLOTS) - 1)]
            found[left] = np.where(self.keys[got] == hashes[left], got, self.count)
            left = left[(found[left] == self.count) & (got != self.count)]
        return found

    def spans(self, words: list[bytes]):
        """For words of equal length: (start, end, rows, pieces) of every span in which some word has a piece."""
        n = len(words[0])
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), n).astype(np.uint64) + np.uint64(1)
        prefix = np.zeros((n + 1, len(words)), np.uint64)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.full(self.longest, _BASE))
            for j in range(n):
                prefix[j + 1] = prefix[j] * _BASE + letters[:, j]
            for end in range(1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    found = self.find(prefix[end] - prefix[start] * power[end - start - 1])
                    rows = np.flatnonzero(found != self.count)
                    if len(rows):
                        yield start, end, rows, found[rows]


# Probabilities are scaled by this factor per byte, so that words up to LONG bytes neither under- nor overflow.
SCALE = 2.0 ** 10


def word_log_probabilities(pieces: Pieces, chances: np.ndarray, words: list[bytes]) -> np.ndarray:
    """log P(word | language), a row per word; ``chances``: pieces by languages."""
    out = np.zeros((len(words), chances.shape[1]))
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    for n, rows in by_length.items():
        if n > LONG:
            for i in rows:
                out[i] = _long_word(pieces, chances, WORD_START + words[i])
            continue
        for at in range(0, len(rows), 20_000):
            part = rows[at: at + 20_000]
            forward = np.zeros((n + 1, len(part), chances.shape[1]))
            forward[0] = 1
            for start, end, who, what in pieces.spans([WORD_START + words[i] for i in part]):
                forward[end, who] += forward[start, who] * chances[what] * SCALE ** (end - start)
            out[part] = np.log(forward[n]) - n * np.log(SCALE)
    return out


def _long_word(pieces: Pieces, chances: np.ndarray, word: bytes) -> np.ndarray:
    """The forward algorithm over a window of the longest piece's length, rescaled at every byte."""
    window = [np.ones(chances.shape[1])]
    total = np.zeros(chances.shape[1])
    for end in range(1, len(word) + 1):
        here = np.zeros(chances.shape[1])
        for back in range(1, min(len(window), pieces.longest) + 1):
            piece = pieces.index.get(word[end - back: end])
            if piece is not None:
                here += window[-back] * chances[piece]
        total += np.log(here)
        window = [w / here for w in window[-pieces.longest + 1:]] + [np.ones_like(here)]
    return total


def expected_counts(pieces: Pieces, chances: np.ndarray, words: list[bytes], weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all segmentations of the words; ``chances`` of one language."""
    out = np.zeros(pieces.count)
    by_length = defaultdict(list)
    for i, w in enumerate(words):
        by_length[len(w) + 1].append(i)
    logs = None
    for n, rows in by_length.items():
        if n > LONG:
            logs = np.log(chances).tolist() if logs is None else logs
            for i in rows:
                for piece, uses in _long_counts(pieces, logs, WORD_START + words[i]).items():
                    out[piece] += uses * weights[i]
            continue
        spans = list(pieces.spans([WORD_START + words[i] for i in rows]))
        forward, backward = np.zeros((n + 1, len(rows))), np.zeros((n + 1, len(rows)))
        forward[0] = backward[n] = 1
        for start, end, who, what in spans:
            forward[end, who] += forward[start, who] * chances[what] * SCALE ** (end - start)
        for start, end, who, what in sorted(spans, key=lambda s: -s[0]):
            backward[start, who] += backward[end, who] * chances[what] * SCALE ** (end - start)
        share = weights[rows] / forward[n]
        for start, end, who, what in spans:
            out += np.bincount(what, forward[start, who] * backward[end, who] * chances[what] * SCALE ** (end - start) * share[who],
                               minlength=pieces.count)
    return out


def _long_counts(pieces: Pieces, logs: list[float], word: bytes) -> dict[int, float]:
    """The expected uses of each piece in one word, in logarithms, so that no length under- or overflows.

    Forward: the log probability of every beginning. Backward: the chance that a place is a boundary is passed on to the
    starts of the pieces that may end there, in the shares they have in the probability of that beginning.
    """
    index, longest, n = pieces.index, pieces.longest, len(word)
    upto, ending = [0.0], [[]]
    for end in range(1, n + 1):
        found = []
        for start in range(max(0, end - longest), end):
            piece = index.get(word[start:end])
            if piece is not None:
                found.append((start, piece, upto[start] + logs[piece]))
        most = max(f[2] for f in found)
        upto.append(most + math.log(sum(math.exp(f[2] - most) for f in found)))
        ending.append(found)
    boundary, uses = [0.0] * n + [1.0], defaultdict(float)
    for end in range(n, 0, -1):
        if boundary[end]:
            for start, piece, log in ending[end]:
                share = boundary[end] * math.exp(log - upto[end])
                uses[piece] += share
                boundary[start] += share
    return uses


def learn(docs: DataFrame, learnable: Column, model_path: str, sample_docs: int = SAMPLE_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages, and the probability of every piece in each; from rows (text, lang) that are ``learnable``."""
    spark = docs.sparkSession
    labelled = docs.filter(learnable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    # about twice the sample passes by its hash, so the ranking meets few rows however many tasks and documents there are
    sizes = materialize(labelled.groupBy("lang").agg(F.count("*").alias("n")), "lang-sizes")
    near = labelled.select("lang", "h").join(sizes, "lang").filter(hash_share(F.col("h")) * F.col("n") <= 2 * sample_docs).select("lang", "h").distinct()
    first = Window.partitionBy("lang").orderBy("h")
    cuts = materialize(near.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= sample_docs)
                       .groupBy("lang").agg(F.max("h").alias("cut")), "lang-cuts")
    sample = labelled.join(cuts, "lang").filter("h <= cut").dropDuplicates(["lang", "h"])
    words = materialize(sample.select("lang", F.explode(F.regexp_extract_all(lower_az(F.col("text")), F.lit(ALNUM), F.lit(0))).alias("word"))
                        .groupBy("lang", "word").agg(F.count("*").alias("n")), "lang-words")
    langs = sorted(r["lang"] for r in cuts.select("lang").collect())
    size = Pieces(vocabulary(model_path)).count
    chances = np.full((size, len(langs)), 1.0 / size)
    for _ in range(ROUNDS if langs else 0):
        model = spark.sparkContext.broadcast(chances)

        def expect(batches, model=model):
            pieces = Pieces(vocabulary(model_path))
            sums = defaultdict(lambda: np.zeros(pieces.count))
            for batch in batches:
                by_lang = defaultdict(list)
                for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n"))):
                    by_lang[lang].append((word.encode(), n))
                for lang, given in by_lang.items():
                    sums[lang] += expected_counts(pieces, model.value[:, langs.index(lang)], [w for w, _ in given],
                                                  np.array([n for _, n in given], float))
            for lang, counts in sums.items():
                used = np.flatnonzero(counts > 0)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([langs.index(lang)] * len(used), pa.int32()),
                                                  "piece": pa.array(used, pa.int32()), "n": pa.array(counts[used])})

        counts = words.mapInArrow(expect, "lang int, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        chances = np.full((size, len(langs)), SMOOTHING)
        for r in counts.collect():  # at most pieces x languages
            chances[r["piece"], r["lang"]] += r["n"]
        chances /= chances.sum(0)
    return langs, chances


def predict(docs: DataFrame, learnable: Column, model_path: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score, the last two columns (underscores added if ``docs`` has such columns)."""
    model_path = model_path or public_tokenizers.path("piece_bpe_32k.model")
    langs, chances = learn(docs, learnable, model_path)
    model = docs.sparkSession.sparkContext.broadcast(chances)
    given = docs.columns

    def classify(batches):
        pieces = Pieces(vocabulary(model_path))
        known: dict[bytes, int] = {}
        logs = np.zeros((0, len(langs)))
        for batch in slices(batches):
            texts = [split_words(t) if ok else [] for t, ok in zip(batch.column("text").to_pylist(), batch.column(letter).to_pylist())]
            if len(known) > CACHE_WORDS:
                known, logs = {}, logs[:0]
            new = list({w for words in texts for w in words if w not in known})
            for w in new:
                known[w] = len(known)
            if new and langs:
                logs = np.vstack([logs, word_log_probabilities(pieces, model.value, new)])
            labels, scores = [], []
            for words in texts:
                if not words or not langs:
                    labels.append("und")
                    scores.append(0.0)
                    continue
                total = logs[np.fromiter(map(known.__getitem__, words), np.int64, len(words))].sum(0)
                best = int(total.argmax())
                labels.append(langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            columns = [batch.column(c) for c in given] + [pa.array(labels, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*given, pred, score])

    letter, pred, score = (fresh(docs.columns, c) for c in ("has_letter", "lang_pred", "score"))
    schema = docs.withColumns({pred: F.lit(""), score: F.lit(0.0)}).schema
    return docs.withColumn(letter, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(classify, schema)


def document_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; a fifth of the ids, by checksum, is held out."""
    held_out = F.pmod(id_crc(), F.lit(5)) == 0
    out = predict(docs.select("doc_id", "text", "lang"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text has a language, all columns."""
    out = predict(docs, F.pmod(id_crc(), F.lit(5)) != 0)
    return out.filter(F.col(out.columns[-2]) != "und").select(*(F.col(f"`{c}`") for c in docs.columns))
