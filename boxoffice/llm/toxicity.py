"""Toxicity by weak supervision.

Voters are lexicon entries (whole words) and patterns (beginnings of words, shouting, runs of exclamation marks); they
vote "toxic" or abstain. Candidates are mined from a bounded sample of labelled training documents. A generative model
with a latent class estimates by expectation-maximisation how often each voter, and the given label itself, fires in
either class; voters that fire together within a class (correlation estimated in each round) share their weight, so a
word and its beginnings count about once. A logistic regression is trained on the posterior labels; it scores every text.

The sample holds at most ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` documents, chosen by a hash of their ids and weighted back
to the share of the classes among all labelled training documents. Scoring passes over the documents without a shuffle.

Defined results: null and empty texts have no votes and the lowest score; a document with several labels counts as toxic
if one of them is; a null label or id teaches nothing, and without labels of both classes every score is the share of toxic
ones (0 if there are none); repeated rows are scored alike and teach once; of documents
with one id the text with the least hash teaches; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxoffice.llm.decontam import split_words
from boxoffice.llm.text import hash_share, id_crc, slices
from boxoffice.session import materialize

SAMPLE_TOXIC, SAMPLE_CLEAN = 6000, 12000
BLOCK = 500  # voters whose correlations with all others are held at a time
PAIRED = 20_000  # firings that are paired with their rows' others at a time
CORRELATE_EVERY = 5  # rounds of the label model
LEAST_TOXIC = 3  # sample documents in which a voter fires
LEAST_LIFT = 4.0  # how much more often in toxic than in clean ones
PREFIXES = (3, 4, 5, 6)  # bytes
THRESHOLD = 0.3
CACHE_WORDS = 400_000
SHOUT = re.compile(r"(?:\b[A-Z]{2,}\b\W+){4}")
EXCLAIM = re.compile(r"!!|!(?:\s|$).{0,80}!")


def word_features(word: bytes) -> list[bytes]:
    """The word itself, and its beginnings marked by a star."""
    return [word, *(word[:k] + b"*" for k in PREFIXES if len(word) > k)]


def style_features(text: str | None) -> list[bytes]:
    return [name for name, pattern in ((b"!shout", SHOUT), (b"!exclaim", EXCLAIM)) if text and pattern.search(text)]


def features(text: str | None) -> set[bytes]:
    return {f for w in set(split_words(text)) for f in word_features(w)} | set(style_features(text))


class Votes:
    """Which of the chosen voters fire in a text; words seen before are looked up."""

    def __init__(self, voters: list[bytes]):
        self.voter = {v: i for i, v in enumerate(voters)}
        self.known: dict[bytes, tuple] = {}

    def of(self, text: str | None) -> list[int]:
        if len(self.known) > CACHE_WORDS:
            self.known = {}
        fired, known = set(), self.known
        for w in set(split_words(text)):
            hits = known.get(w)
            if hits is None:
                hits = known[w] = tuple(self.voter[f] for f in word_features(w) if f in self.voter)
            if hits:
                fired.update(hits)
        fired.update(self.voter[f] for f in style_features(text) if f in self.voter)
        return sorted(fired)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class Firings:
    """Which voters fire in which rows, as pairs of numbers: memory goes by firings, not by rows times voters."""

    def __init__(self, fired: list[list[int]], voters: int):
        self.rows, self.voters = len(fired), voters
        self.length = np.fromiter(map(len, fired), np.int64, self.rows)
        self.row = np.repeat(np.arange(self.rows), self.length)
        self.voter = np.fromiter((v for f in fired for v in f), np.int64, len(self.row))

    def per_voter(self, value: np.ndarray) -> np.ndarray:
        """For each voter, the sum of a value over the rows in which it fires."""
        return np.bincount(self.voter, value[self.row], minlength=self.voters)

    def per_row(self, value: np.ndarray) -> np.ndarray:
        """For each row, the sum of a value over the voters that fire in it."""
        return np.bincount(self.row, value[self.voter], minlength=self.rows)

    def correlations(self, weight: np.ndarray) -> np.ndarray:
        """For each voter, the sum of its positive correlations with all voters, itself included, over weighted rows."""
        total = weight.sum() + 1e-9
        mean = self.per_voter(weight) / total
        spread = np.sqrt(np.maximum(mean - mean ** 2, 0)) + 1e-9
        out = np.zeros(self.voters)
        start = np.cumsum(self.length) - self.length
        order = np.argsort(self.voter, kind="stable")
        for low in range(0, self.voters, BLOCK):  # the firings of a block's voters, each with all firings of its row
            high = min(self.voters, low + BLOCK)
            together = np.zeros(self.voters * (high - low))
            own = order[np.searchsorted(self.voter, low, sorter=order): np.searchsorted(self.voter, high, sorter=order)]
            for part in np.array_split(own, max(1, -(-len(own) // PAIRED))):
                row = self.row[part]
                n = self.length[row]
                other = self.voter[np.arange(int(n.sum())) + np.repeat(start[row] - np.cumsum(n) + n, n)]
                together += np.bincount(other * (high - low) + np.repeat(self.voter[part] - low, n), np.repeat(weight[row], n), minlength=len(together))
            shared = together.reshape(self.voters, high - low) / total - np.outer(mean, mean[low:high])
            out[low:high] = np.clip(shared / np.outer(spread, spread[low:high]), 0, 1).sum(0)
        return out


def label_model(votes: Firings, label: np.ndarray, weight: np.ndarray, rounds: int = 15) -> np.ndarray:
    """Posterior probability of the class "toxic" for rows of votes with a given 0/1 label.

    Each voter fires independently given the class, but for its share: 1 / (1 + the sum of its positive correlations
    with other voters within the classes), estimated anew every few rounds. The given label is one more voter, of full share.
    """
    posterior = np.where(label == 1, 0.9, 0.1)
    for turn in range(rounds):
        sides = [weight * side for side in (posterior, 1 - posterior)]
        rates = [(np.append(votes.per_voter(w), w @ label) + 0.5) / (w.sum() + 1) for w in sides]
        if turn % CORRELATE_EVERY == 0:
            share = np.append(1 / np.maximum(1, sum(w.sum() * votes.correlations(w) for w in sides) / weight.sum()), 1.0)
        fire = np.log(rates[0] / rates[1]) * share
        rest = np.log((1 - rates[0]) / (1 - rates[1])) * share
        prior = np.clip((weight @ posterior) / weight.sum(), 1e-6, 1 - 1e-6)
        change = fire - rest
        new = _sigmoid(np.log(prior / (1 - prior)) + votes.per_row(change[:-1]) + label * change[-1] + rest.sum())
        if np.abs(new - posterior).max() < 1e-4:
            break
        posterior = new
    return posterior


def linear_classifier(votes: Firings, target: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 400) -> np.ndarray:
    """Weights of the voters and, last, the bias: logistic regression on soft targets, by accelerated gradient steps."""
    forth = lambda beta: votes.per_row(beta[:-1]) + beta[-1]
    back = lambda rest: np.append(votes.per_voter(rest), rest.sum())
    scale = np.sqrt(back(weight) + ridge)  # each column its own step
    penalty = np.append(np.full(votes.voters, ridge), 0.0)
    beta = ahead = np.zeros(votes.voters + 1)
    step, vector = 0.0, np.ones(votes.voters + 1)
    for _ in range(12):  # largest curvature of the scaled problem
        vector = back(weight * forth(vector / scale)) / scale
        step = np.linalg.norm(vector)
        vector /= step + 1e-12
    step = 1 / (step / 4 + ridge)
    for k in range(rounds):
        slope = back(weight * (_sigmoid(forth(ahead)) - target)) + penalty * ahead
        new = ahead - step * slope / scale ** 2
        ahead = new + k / (k + 3) * (new - beta)
        beta = new
    return beta


def training_sample(docs: DataFrame, labels: DataFrame, learnable: Column) -> tuple[DataFrame, dict[int, int]]:
    """The sample (text, toxic), and how many labelled training documents each class has."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learnable).groupBy("doc_id").agg(
        (F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.join(docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", "left_semi")
    totals = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    # about twice the sample passes by its hash, so the ranking meets few rows however many tasks and labels there are
    limit, n = (F.when(F.col("toxic") == 1, one).otherwise(zero) for one, zero in ((SAMPLE_TOXIC, SAMPLE_CLEAN), (totals.get(1, 0), totals.get(0, 0))))
    near = known.filter(hash_share(F.xxhash64("doc_id")) * n <= 2 * limit)
    first = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = near.withColumn("k", F.row_number().over(first)).filter(f"k <= {max(SAMPLE_TOXIC, SAMPLE_CLEAN)}").filter(
        f"k <= if(toxic = 1, {SAMPLE_TOXIC}, {SAMPLE_CLEAN})").select("doc_id", "toxic")
    # broadcast: at most SAMPLE_TOXIC + SAMPLE_CLEAN pairs of numbers
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = found.groupBy("doc_id", "toxic").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first"))
    sample = one.select("first.text", "toxic")
    return materialize(sample, "toxic-sample"), totals


def mine_voters(sample: DataFrame) -> list[bytes]:
    """All features that pass the least counts, the strongest association first."""
    def count(batches):
        for batch in slices(batches):
            counts: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[toxic] += 1
            yield pa.RecordBatch.from_pydict({"feature": pa.array(counts.keys(), pa.binary()), "clean": pa.array([c[0] for c in counts.values()], pa.int64()),
                                              "toxic": pa.array([c[1] for c in counts.values()], pa.int64())})

    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sums = sample.mapInArrow(count, "feature binary, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate1, rate0 = (F.col("toxic") + 0.5) / (sizes.get(1, 0) + 1), (F.col("clean") + 0.5) / (sizes.get(0, 0) + 1)
    strength = F.col("toxic") * F.log(rate1 / rate0)
    best = sums.filter((F.col("toxic") >= LEAST_TOXIC) & (rate1 / rate0 >= LEAST_LIFT)).orderBy(strength.desc(), "feature")
    return [bytes(r["feature"]) for r in best.select("feature").collect()]


def train(docs: DataFrame, labels: DataFrame, learnable: Column) -> tuple[list[bytes], np.ndarray]:
    """Voters, and their weights with the bias."""
    sample, totals = training_sample(docs, labels, learnable)
    if not (totals.get(0) and totals.get(1)):
        share = totals.get(1, 0) / max(1, sum(totals.values()))
        return [], np.array([np.log(max(share, 1e-9) / max(1 - share, 1e-9))])
    voters = mine_voters(sample)

    def fired(batches):
        votes = Votes(voters)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"toxic": batch.column("toxic"), "fired": pa.array([votes.of(t) for t in batch.column("text").to_pylist()], pa.list_(pa.int32()))})

    # texts in which the same voters fire are one row; most clean ones have none
    patterns = sample.mapInArrow(fired, "toxic int, fired array<int>").groupBy("toxic", "fired").agg(F.count("*").alias("n"))
    rows = patterns.orderBy("toxic", "fired").collect()  # bounded by the sample
    votes = Firings([r["fired"] for r in rows], len(voters))
    label, n = np.array([r["toxic"] for r in rows]), np.array([r["n"] for r in rows])
    weight = n * np.where(label == 1, totals[1] / max(1, n[label == 1].sum()), totals[0] / max(1, n[label == 0].sum()))
    weight = weight * n.sum() / weight.sum()
    posterior = label_model(votes, label, weight)
    return voters, linear_classifier(votes, posterior, weight)


def toxicity_scores(docs: DataFrame, labels: DataFrame, learnable: Column) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs``. Runs jobs while it is built."""
    voters, beta = train(docs, labels, learnable)

    def score(batches):
        votes = Votes(voters)
        for batch in batches:
            scores = [float(_sigmoid(beta[-1] + beta[votes.of(t)].sum())) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": pa.array(scores, pa.float64())})

    return docs.select("doc_id", "text").mapInArrow(score, "doc_id long, score double")


def document_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; a quarter of the ids, by checksum, is held out."""
    held_out = F.pmod(id_crc(), F.lit(4)) == 2
    scored = toxicity_scores(docs, labels, ~held_out)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
