"""Decontamination, license scans, language ID, toxicity and mixing against plain versions."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import decontam, langid, licenses, mixing, toxicity

SF = "/root/testdata/sf0.01"


# ---- decontamination

def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_contamination(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        words = plain_words(text)
        hit, found = set(), set()
        for item, passage in items:
            w = plain_words(passage)
            size = min(window, len(w))
            wanted = {tuple(w[i:i + size]) for i in range(max(1, len(w) - window + 1))} if w else set()
            for i in range(len(words) - size + 1) if w and item is not None else ():
                if tuple(words[i:i + size]) in wanted:
                    hit.update(range(i, i + size))
                    found.add(str(item))
        out.append((doc_id, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("piece", [100_000, 3])
def test_contamination(spark, docs, piece, monkeypatch):
    monkeypatch.setattr(decontam.find_hits, "__defaults__", (decontam.WINDOW, piece))
    ten = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [f"x {ten.upper()}! lambda", ten.replace(" ", " -- "), ten[:-6], "é ü short item here", "short item", "solo", "solosolo", None, "",
             " ".join(["a"] * 30), ("a b " * 20), f"{ten} lambda mu {ten}", "so lo"]
    items = [(1, f"{ten} lambda"), (2, "short item"), (3, "Solo."), (4, "a " * 12), (5, None), (6, " ... "), (None, ten), (2, "é ü"), (10, f"{ten} LAMBDA"), (7, "a b a b")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(docs(texts, extra=True), bench)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_contamination(list(enumerate(texts)), items)
    kept = decontam.drop_contaminated(docs(texts, extra=True), bench)
    assert kept.columns == docs(texts, extra=True).columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in plain_contamination(list(enumerate(texts)), items) if not r[5]}


def test_contamination_of_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(1, "one two three four five")], "item_id long, text string")
    empty = bench.limit(0)
    assert sum(r["contaminated"] for r in decontam.contamination(odd, bench).collect()) == 3
    assert decontam.contamination(odd, empty).filter("contaminated").count() == 0
    assert decontam.contamination(none, bench).collect() == []


# ---- license scans

def test_licenses(spark, docs, odd, none):
    full = next(t for i, t in licenses.KNOWN if i == "MIT" and len(t) > 500)
    texts = [f" * Copyright (c) 2020 Someone\nAll rights reserved.\n\n{full.upper()}", full.replace("sublicense", "sub-licence").replace(" ", "\n  "), full + " More.",
             "text\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0.\n", "Copyright 1999", full, None, ""]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.license_scan(docs(texts, extra=True)).collect()}
    assert got == {0: ("MIT", []), 1: ("MIT", []), 2: (None, []), 3: (None, ["CC-BY-NC-4.0", "MIT"]), 4: (None, []), 5: ("MIT", []),
                   6: (None, []), 7: (None, [])}
    assert len(licenses.license_scan(odd).collect()) == odd.count()
    assert licenses.license_scan(none).collect() == []
    forms = licenses.known_digests(spark)
    assert forms.count() == len({re.sub(r"\W+", " ", t).lower() for _, t in licenses.KNOWN})


COMMON = {"Apache-2.0": "Apache-2.0", "Artistic": "Artistic-1.0-Perl", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2",
          "GFDL-1.3": "GFDL-1.3", "GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1",
          "LGPL-3": "LGPL-3.0", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


def test_complete_standard_texts(spark, docs):
    paths = [p for p in (Path("/usr/share/common-licenses") / name for name in COMMON) if p.exists()]
    if not paths:
        pytest.skip("no standard texts here")
    texts = {p.name: p.read_text() for p in paths}
    rows = [(COMMON[n], t) for n, t in texts.items()]
    rows += [(COMMON[n], t.split("END OF TERMS AND CONDITIONS")[0] + "END OF TERMS AND CONDITIONS") for n, t in texts.items() if "END OF TERMS" in t]
    rows += [(COMMON[n], re.sub(r"51\s+Franklin\s+St(reet)?,\s+Fifth\s+Floor,\s+Boston,?\s+MA\s+02110-1301", "59 Temple Place, Suite 330, Boston, MA 02111-1307", t))
             for n, t in texts.items()]
    rows += [(i, "\n".join(f" * {line}" for line in t.upper().splitlines())) for i, t in rows]
    rows += [(None, t + " More.") for t in texts.values()] + [(None, t[:-200]) for t in texts.values()]
    got = {r["doc_id"]: r["license_id"] for r in licenses.license_scan(docs([t for _, t in rows])).collect()}
    assert [got[k] for k in range(len(rows))] == [i for i, _ in rows]
    passed = spark.createDataFrame([("mine", "My own terms.")], "license_id string, text string")
    assert {r["license_id"] for r in licenses.license_scan(docs([rows[0][1], "my own terms"]), passed).collect()} == {None, "mine"}


# ---- language ID

def test_forward_algorithm_sums_all_segmentations():
    rng = np.random.default_rng(0)
    vocab = sorted({bytes([b]) for b in b" abc"} | {b" a", b"ab", b"bc", b"abc", b"ca", b" ab", b"bca"})
    chances = rng.dirichlet(np.ones(len(vocab)), 2).T
    pieces = langid.Pieces(vocab)
    place = {p: i for i, p in enumerate(vocab)}

    def brute(word):
        total, uses = np.zeros(2), np.zeros((len(vocab), 2))
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(1, len(word)), k) for k in range(len(word))):
            parts = [word[i:j] for i, j in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in place for p in parts):
                p = np.prod([chances[place[x]] for x in parts], axis=0)
                total += p
                for x in parts:
                    uses[place[x]] += p
        return total, uses / total

    words = [b"a", b"abc", b"abcab", b"cabca", b"bcabca"]
    got = langid.word_log_probabilities(pieces, chances, words)
    assert np.allclose(got, [np.log(brute(b" " + w)[0]) for w in words])
    assert np.allclose(got, [langid._long_word(pieces, chances, b" " + w) for w in words])
    counts = langid.expected_counts(pieces, chances[:, 0].copy(), words, np.array([1., 2, 3, 1, 1]))
    assert np.allclose(counts, sum(n * brute(b" " + w)[1][:, 0] for w, n in zip(words, [1, 2, 3, 1, 1])))


def test_long_words_teach(monkeypatch):
    """The path for long words against the other one, and against itself where no other can go."""
    rng = np.random.default_rng(1)
    vocab = sorted({bytes([b]) for b in b" abcd"} | {bytes(rng.choice(list(b"abcd"), rng.integers(2, 6)).tolist()) for _ in range(60)})
    chances = rng.dirichlet(np.ones(len(vocab)))
    pieces = langid.Pieces(vocab)
    words = [bytes(rng.choice(list(b"abcd"), n).tolist()) for n in (3, 47, 48, 60, 100)]
    weights = np.array([1., 2, 1, 3, 1])
    got = langid.expected_counts(pieces, chances, words, weights)
    monkeypatch.setattr(langid, "LONG", 1000)
    assert np.allclose(got, langid.expected_counts(pieces, chances, words, weights))
    monkeypatch.setattr(langid, "LONG", 0)
    assert np.allclose(got, langid.expected_counts(pieces, chances, words, weights))
    endless = bytes(rng.choice(list(b"abcd"), 20_000).tolist())
    counts = langid._long_counts(pieces, np.log(chances).tolist(), b" " + endless)
    assert sum(n * len(vocab[p]) for p, n in counts.items()) == pytest.approx(len(endless) + 1)


def test_languages_without_spaces(docs):
    """Japanese and Chinese texts whose sentences are single words; a fifth of them is held out."""
    rng = np.random.default_rng(5)
    kana, both, hanzi = list("あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわをん"), list("日本人中国大小山川田学生先時間年月"), list(
        "这们说对没为来过还后会样当经发现实问题见让给动两长开关门东车书语")
    text = lambda letters: "".join(rng.choice(letters, 300))
    rows = [(i, text(kana + both) if i % 2 else text(hanzi + both), "ja" if i % 2 else "zh", "a") for i in range(240)]
    got = langid.document_languages(docs(rows)).filter("held_out").collect()
    assert len(got) > 30 and np.mean([r["lang_pred"] == ("ja" if r["doc_id"] % 2 else "zh") for r in got]) > 0.95


def test_language_of_held_out_documents(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.document_languages(frame).join(frame.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98 and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)


def test_language_of_odd_rows(odd, none, docs):
    got = langid.document_languages(odd).collect()
    assert len(got) == odd.count()
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in got if r["doc_id"] in (1, 2, 6))
    assert all(r["lang_pred"] != "und" for r in got if r["doc_id"] in (3, 4, 5))
    assert langid.document_languages(none).collect() == []
    kept = langid.drop_unidentified(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} == {None, 3, 4, 5}
    unlabelled = docs([(1, "some words", None, "a")])
    assert [r["lang_pred"] for r in langid.document_languages(unlabelled).collect()] == ["und"]


# ---- toxicity

def test_toxicity_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = toxicity.document_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), labels)
    rows = got.join(labels, "doc_id").collect()
    toxic, clean = ([r["score"] for r in rows if r["toxic"] == t and r["held_out"]] for t in (1, 0))
    assert np.mean([(a > b) + (a == b) / 2 for a in toxic for b in clean]) > 0.9
    assert np.mean([s < 0.3 for s in clean]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)


def test_toxicity_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (3, 0), (5, 0), (None, 1), (4, None), (99, 1), (7, 0), (8, 0)], "doc_id long, toxic int")
    got = toxicity.document_toxicity(odd, labels).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert {r["predicted"] for r in toxicity.document_toxicity(odd, labels.limit(0)).collect()} == {0}
    assert toxicity.document_toxicity(none, labels).collect() == []


def test_every_feature_that_passes_votes(spark):
    words = [f"q{k}" for k in range(1000)]
    rows = [(" ".join(words), 1)] * 3 + [("fine text", 0)] * 30
    voters = toxicity.mine_voters(spark.createDataFrame(rows, "text string, toxic int"))
    assert {w.encode() for w in words} <= set(voters)


def firings(votes):
    return toxicity.Firings([np.flatnonzero(v).tolist() for v in votes], votes.shape[1])


def plain_label_model(votes, label, weight, rounds=15):
    """The label model on whole tables."""
    def correlation(w):
        total = w.sum() + 1e-9
        centred = (votes - (w @ votes) / total) * np.sqrt(w / total)[:, None]
        centred = centred / (np.sqrt((centred ** 2).sum(0)) + 1e-9)
        return np.clip(centred.T @ centred, 0, 1).sum(0)

    given, posterior = np.column_stack([votes, label]), np.where(label == 1, 0.9, 0.1)
    for turn in range(rounds):
        sides = [weight * posterior, weight * (1 - posterior)]
        rates = [(w @ given + 0.5) / (w.sum() + 1) for w in sides]
        if turn % 5 == 0:
            share = np.append(1 / np.maximum(1, sum(w.sum() * correlation(w) for w in sides) / weight.sum()), 1)
        odds = (given * np.log(rates[0] / rates[1]) + (1 - given) * np.log((1 - rates[0]) / (1 - rates[1]))) @ share
        prior = (weight @ posterior) / weight.sum()
        new = 1 / (1 + np.exp(-(np.log(prior / (1 - prior)) + odds)))
        done, posterior = np.abs(new - posterior).max() < 1e-4, new
        if done:
            return posterior
    return posterior


def some_votes(rows=900, voters=37, seed=3):
    rng = np.random.default_rng(seed)
    y = rng.random(rows) < 0.25
    rate = rng.random(voters) * 0.25
    votes = (rng.random((rows, voters)) < np.where(y[:, None], rate * 2, rate * 0.4)).astype(float)
    votes[:, 5] = votes[:, 4]
    votes[:40] = 0
    return votes, np.where(rng.random(rows) < 0.1, ~y, y).astype(int), rng.random(rows) * 3 + 0.1


def test_label_model_equals_the_one_on_whole_tables(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    monkeypatch.setattr(toxicity, "PAIRED", 50)
    votes, label, weight = some_votes()
    assert np.allclose(toxicity.label_model(firings(votes), label, weight), plain_label_model(votes, label, weight), atol=1e-3)


def test_linear_classifier_is_at_the_minimum():
    """The gradient of the penalised log loss, over whole tables, is zero there."""
    votes, label, weight = some_votes()
    target = np.clip(label + 0.1, 0, 0.95)
    beta = toxicity.linear_classifier(firings(votes), target, weight, rounds=3000)
    score = 1 / (1 + np.exp(-(votes @ beta[:-1] + beta[-1])))
    slope = np.append(votes.T @ (weight * (score - target)) + beta[:-1], (weight * (score - target)).sum())
    assert np.abs(slope).max() < 1e-2 * weight.sum() / len(weight)


def test_of_documents_with_one_id_the_same_text_teaches(spark, docs):
    rows = [(i, f"plain words number {i}", "en", "a") for i in range(40)] + [(i, f"vile{i % 3} rant {i}", "en", "a") for i in range(40, 70)]
    rows += [(50, "another text", "en", "a"), (51, "and vile0 another", "en", "a")]
    labels = spark.createDataFrame([(i, int(i >= 40)) for i in range(70)], "doc_id long, toxic int")
    runs = [sorted(map(str, toxicity.document_toxicity(docs(r).repartition(n), labels).collect())) for r, n in ((rows, 3), (rows[::-1], 7))]
    assert runs[0] == runs[1]


def test_label_model_shares_the_weight_of_correlated_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.3
    good = (rng.random(4000) < np.where(y, 0.7, 0.05)).astype(float)
    other = (rng.random(4000) < np.where(y, 0.6, 0.1)).astype(float)
    label = np.where(rng.random(4000) < 0.1, ~y, y).astype(int)
    once = toxicity.label_model(firings(np.column_stack([good, other])), label, np.ones(4000))
    copied = toxicity.label_model(firings(np.column_stack([good] * 5 + [other])), label, np.ones(4000))
    assert np.mean((once > 0.5) == y) > np.mean(label == y)
    assert np.abs(once - copied).mean() < 0.05


# ---- mixing

def plain_targets(sizes, weights=(5, 2, 1), cap=3):
    """Shares again and again until no source is above its cap."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        left = [s for s in names if s not in fixed]
        share = {s: (total - sum(fixed.values())) * weight[s] / sum(weight[x] for x in left) for s in left}
        over = {s: cap * sizes[s] for s in left if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**fixed, **share}
        fixed |= over


def check_mix(frame, slack):
    rows = mixing.mixed_sizes(frame).collect()
    again = mixing.mixed_sizes(frame.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    source = defaultdict(list)
    for r in frame.select("doc_id", "source", "text").collect():
        source[r["doc_id"]].append((r["source"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))))
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for given in source.values():
        for s, n in given:
            sizes[s] += n
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        s = next(s for s, n in source[r["doc_id"]] if n == r["size"] and sizes[s] == r["source_size"])
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = plain_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= slack(s, sizes[s], source)
    assert mixing.mix(frame).agg(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.mix(frame).columns == frame.columns


def test_mix_of_the_small_table(spark):
    longest = lambda s, size, rows: max(n for given in rows.values() for x, n in given if x == s)
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"), longest)


def test_mix_with_tight_caps(docs):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 9)), "en", s) for i, s in enumerate(["a"] * 5 + ["b"] * 300 + ["c"] * 3 + [None] * 400 + ["é"])]
    check_mix(docs(rows, extra=True), lambda s, size, rows: 9)


@pytest.mark.parametrize("first", [3, 77, 500])
def test_repeated_rows_are_cut_one_by_one(docs, first):
    """Half of a source is one repeated row; its words still come near the target."""
    rows = [(first, "w " * 10, "en", "a")] * 150 + [(1000 + i, "x " * 10, "en", "a") for i in range(150)] + [(2000 + i, "y " * 10, "en", "b") for i in range(300)]
    frame = docs(rows, extra=True)
    got = mixing.mixed_sizes(frame).collect()
    for source in {r["target"] for r in got}:
        assert abs(sum(r["taken"] for r in got if r["target"] == source) - source) <= 10
    assert sorted(map(str, got)) == sorted(map(str, mixing.mixed_sizes(frame.repartition(3)).collect()))
    mixed = mixing.mix(frame)
    assert mixed.columns == frame.columns and {r["_slice"] for r in mixed.select("_slice").distinct().collect()} <= {"x"}
    assert mixed.agg(F.sum(mixing.words_in(F.col("text")))).first()[0] == sum(r["taken"] for r in got)


def test_mix_of_odd_rows(odd, none):
    rows = mixing.mixed_sizes(odd).collect()
    assert len(rows) == odd.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_sizes(none).collect() == [] and mixing.mix(none).collect() == []
    assert mixing.mix(odd).columns == odd.columns


def test_no_line_with_a_known_form_is_left_out(spark, docs, monkeypatch):
    """Every known text on one line, as it is and in all other spellings at once and one by one, with and without the shapes."""
    lines = []
    for _, text in licenses.KNOWN:
        flat = re.sub(r"\s+", " ", text)
        lines += [flat, flat.upper() + "."]
        for spelling, variant in licenses.SPELLINGS:
            lines.append(re.sub(rf"\b{spelling}\b", variant, flat, flags=re.IGNORECASE))
        every = flat
        for spelling, variant in licenses.SPELLINGS[::-1]:
            every = re.sub(rf"\b{spelling}\b", variant, every, flags=re.IGNORECASE)
        lines.append(every)
    texts = sorted(set(lines)) + ["intro\n" + "\n\nand then\r\n".join(lines[:40]), "per cent", "sub licence granted", "MIT", "the\nMIT License"]
    given = docs(texts)
    want = sorted(map(str, licenses.license_scan(given).collect()))
    shapes = licenses.line_shapes(spark)
    assert len(shapes) < 200
    monkeypatch.setattr(licenses, "line_shapes", lambda *_: None)
    assert sorted(map(str, licenses.license_scan(given).collect())) == want
    found = [r for r in licenses.license_scan(given).collect() if r["notices"]]
    assert len(found) >= 2 * len(licenses.KNOWN)
