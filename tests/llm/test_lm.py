"""Deleted interpolation against plain dictionaries."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import lm
from boxoffice.llm.queries import QUERIES
from boxoffice.llm.text import id_crc
from boxoffice.session import materialize

TEXTS = ["the cat sat on the mat", "The cat sat", "a dog sat on the cat", "the dog", "", None, "on the mat the cat", "zebra quagga"] * 12


def brute(texts):
    """Scores by the definition, for ids 0, 1, ..."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(table)) + ["</s>"] for t in texts]
    crc = [zlib.crc32(str(i).encode()) for i in range(len(texts))]
    part = [2 if c % 7 == 2 else 1 if c // 7 % 10 == 3 else 0 for c in crc]
    train = Counter(w for ws, p in zip(words, part) if p < 2 for w in ws)
    total, types = sum(train.values()), len(train)
    one = Counter(w for ws, p in zip(words, part) if p == 0 for w in ws)
    size = sum(one.values())
    one["<s>"] = part.count(0)
    two = Counter(b for ws, p in zip(words, part) if p == 0 for b in zip(["<s>", *ws], ws))

    def estimates(u, w):
        seen = one[u] > 0
        return (1 + int(math.log2(one[u])) if seen else 0, [1 / (types + 1), one[w] / size, two[u, w] / one[u] if seen else 0])

    cells = Counter()
    for ws, p in zip(words, part):
        for u, w in zip(["<s>", *ws], ws) if p == 1 else ():
            key, f = estimates(u, w)
            cells[key, tuple(round(math.log2(x / f[0]) * lm.BINS_PER_OCTAVE) if x else lm.NONE for x in f[1:])] += 1
    weights = lm.learn_weights([(k, list(b), n) for (k, b), n in cells.items()], 2)
    out = []
    for i, ws in enumerate(words):
        score = 0
        for u, w in zip(["<s>", *ws], ws):
            key, f = estimates(u, w)
            score += math.log10(sum(a * b for a, b in zip(weights[key], f)))
        base = sum(math.log10((train[w] + 1) / (total + types + 1)) for w in ws)
        out.append((i, part[i] == 2, len(ws), sum(train[w] > 0 for w in ws), total, base, score))
    assert abs(sum(sum(a * b for a, b in zip(weights[estimates("cat", w)[0]], estimates("cat", w)[1])) for w in [*train, "unknown"]) - 1) < 1e-9
    return out


def test_against_dictionaries(docs):
    got = sorted(tuple(r) for r in lm.document_scores(docs(TEXTS)).collect())
    for a, b in zip(got, brute(TEXTS), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], abs=1e-9)


def test_scores_use_all_training_texts(docs):
    part = lambda i: 2 if zlib.crc32(str(i).encode()) % 7 == 2 else 1 if zlib.crc32(str(i).encode()) // 7 % 10 == 3 else 0
    by_part = {p: [i for i in range(400) if part(i) == p] for p in (0, 1, 2)}
    told, kept, held = by_part[1][0], by_part[0], by_part[2][0]
    texts = {i: "the cat sat" for i in kept[:40] + by_part[1][1:6]} | {told: "quagga zebra " * 30, held: "quagga zebra"}
    rows = [(i, t) for i, t in texts.items()]
    got = {whole: {r["doc_id"]: r for r in lm.document_scores(docs(rows), whole=whole).collect()} for whole in (False, True)}
    assert got[True][held]["held_out"] and got[True][held]["n_known"] == 3
    assert got[True][held]["score"] > got[False][held]["score"] + 0.5
    # one document by hand: the order-1 model, whose weights do not depend on the context
    one = Counter(w for i, t in texts.items() if part(i) < 2 for w in [*t.split(), "</s>"])
    crc = id_crc()
    frame, held_out, deleted = docs(rows), F.pmod(crc, F.lit(7)) == 2, F.pmod(F.floor(crc / 7), F.lit(10)) == 3
    first = {r["doc_id"]: r["score"] for r in lm.interpolated_scores(frame, held_out, deleted, 1, True).collect()}
    kept_one = Counter(w for i, t in texts.items() if part(i) == 0 for w in [*t.split(), "</s>"])
    ratio = lambda c, w: c[w] / sum(c.values()) * (len(one) + 1)
    cells = Counter(round(math.log2(ratio(kept_one, w)) * lm.BINS_PER_OCTAVE) if kept_one[w] else lm.NONE
                    for i, t in texts.items() if part(i) == 1 for w in [*t.split(), "</s>"])
    a, b = lm.learn_weights([(0, [k], n) for k, n in cells.items()], 1)[0]
    assert first[held] == pytest.approx(sum(math.log10((a + b * ratio(one, w)) / (len(one) + 1)) for w in ("quagga", "zebra", "</s>")))


def test_the_registered_query_has_trigrams_of_all_training_texts(spark):
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r["score"] for r in QUERIES["op1_lm_scores"](spark, sf).collect()}
    want = {r["doc_id"]: r["score"] for r in lm.document_scores(spark.read.parquet(f"{sf}/documents.parquet"), 3, True).collect()}
    bigrams = {r["doc_id"]: r["score"] for r in lm.document_scores(spark.read.parquet(f"{sf}/documents.parquet"), 2, True).collect()}
    assert got == pytest.approx(want) and got != pytest.approx(bigrams)


def test_trigrams_run_and_are_no_worse_on_repeated_text(docs):
    from pyspark.sql import functions as F

    from boxoffice.llm.text import id_crc
    frame = docs(TEXTS)
    crc = id_crc()
    held, deleted = F.pmod(crc, F.lit(7)) == 2, F.pmod(F.floor(crc / 7), F.lit(10)) == 3
    sums = [lm.interpolated_scores(frame, held, deleted, order=n).agg(F.sum("score")).first()[0] for n in (1, 2, 3)]
    assert sums[0] < sums[1] <= sums[2] + 1


def test_odd_rows(odd):
    got = lm.document_scores(odd).collect()
    assert len(got) == odd.count()
    assert all(r["score"] <= 0 and r["base_score"] <= 0 and r["n_tokens"] >= 1 for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] == 1} == {1}
    assert len({(r["score"], r["base_score"]) for r in got if r["doc_id"] == 3}) == 1


def test_no_rows(none):
    assert lm.document_scores(none).collect() == []


def test_packing():
    rng = np.random.default_rng(1)
    for n in (1, 2, 1000):
        codes = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1)
        assert (lm.unpack_sorted(lm.pack_sorted(codes), len(codes)) == codes).all()
    for top in (3, 300, 70_000, 1 << 40):
        counts = np.array([0, top])
        assert (lm.unpack_counts(lm.pack_counts(counts), 2) == counts).all()


def test_beats_the_base_on_held_out_documents(spark):
    from pyspark.sql import functions as F
    scored = lm.document_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out")
    r = scored.agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert r["s"] > 0.9 * r["b"]


def test_orders_are_asked_one_at_a_time_and_their_shuffles_deleted(spark, docs, monkeypatch):
    key, asked = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", []

    def stored(frame, purpose):
        out = materialize(frame, purpose)
        asked.append(({r[0] for r in out.filter("block is not null").select("n_tokens").distinct().collect()}, spark.conf.get(key)))
        return out

    before = spark.conf.get(key)
    monkeypatch.setattr(lm, "materialize", stored)
    assert lm.document_scores(docs(TEXTS), 3, True).count() == len(TEXTS)
    assert asked == [({1}, "true"), ({2}, "true"), ({3}, "true")] and spark.conf.get(key) == before


def test_many_cells_take_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    n, order = 400_000, 3
    key, bins = rng.integers(0, 129, n), rng.integers(-40, 90, (n, order))
    tracemalloc.start()
    weights = lm.fit_weights(key, bins, np.ones(n), order, 2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert weights.sum(1) == pytest.approx(1) and most < 70 * n
