"""Packing against a plain best-fit decreasing and the whole texts' ids."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxoffice.llm import packing, tokenfiles
from tests.llm.test_bytes import ODD_TEXTS, PATH


def plain_best_fit(lengths, window):
    """Longest first, each into the fullest window that holds it; returns the contents of the windows."""
    windows = []
    for size in sorted(lengths, reverse=True):
        fits = [w for w in windows if sum(w) + size <= window]
        if fits:
            max(fits, key=sum).append(size)
        else:
            windows.append([size])
    return windows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.sampled_from([40, 47, 64]))
def test_best_fit_decreasing(lengths, window):
    where, offset, windows = packing.best_fit_decreasing(np.array(lengths, np.int64), window)
    held = [[] for _ in range(windows)]
    for size, w, at in sorted(zip(lengths, where.tolist(), offset.tolist()), key=lambda x: x[2]):
        assert at == sum(held[w])
        held[w].append(size)
    # windows of equal room are alike, so only how full they get is determined
    assert sorted(map(sum, held)) == sorted(map(sum, plain_best_fit(lengths, window)))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 33), st.integers(1, 5)), max_size=30), st.integers(1, 33))
def test_tightest(puts, size):
    tree = packing.OpenWindows(33)
    for n, (capacity, windows) in enumerate(puts):
        tree.put(capacity, np.arange(windows) + 100 * n)
    assert tree.tightest(size) == min((c for c, _ in puts if c >= size), default=None)


def check(rows, got, window=4096):
    """Each id once, offsets without gaps, no window overfull; the number of sequences."""
    encoder = tokenfiles.Encoder(PATH)
    texts = {}
    for doc_id, text in rows:
        texts.setdefault(doc_id, []).append(np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4"))
    for doc_id, versions in texts.items():
        cuts = [(at, min(window, len(ids) - at), zlib.crc32(ids[at: at + window].tobytes()), len(ids)) for ids in versions for at in range(0, len(ids), window)]
        assert sorted(tuple(r)[1:5] for r in got if r["doc_id"] == doc_id) == sorted(cuts)
    assert {r["doc_id"] for r in got} == set(texts)
    ends = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert sorted(ends) == list(range(len(ends))) and all(e <= window for e in ends.values())
    return ends


def test_documents(docs):
    texts = [*ODD_TEXTS, "word " * 20_000, *("a b c " * k for k in range(0, 1400, 7)), *(["same text"] * 50)]
    got = packing.packed_documents(docs(texts, extra=True).repartition(7)).collect()
    ends = check(list(enumerate(texts)), got)
    assert len(ends) == len(plain_best_fit([r["length"] for r in got], 4096))


def test_small_table_in_groups(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = packing.packed_pieces(frame, group=60)
    got = [r for r in pieces.selectExpr("doc_id", "start", "length", "crc32(ids) as ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    check([(r["doc_id"], r["text"]) for r in frame.collect()], got)
    by_sequence = {}
    for r in sorted(pieces.collect(), key=lambda r: (r["sequence_id"], r["offset"])):
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    sequences = packing.packed_sequences(pieces).collect()
    assert len(sequences) == len(by_sequence)
    for s in sequences:
        own = by_sequence[s["sequence_id"]]
        assert bytes(s["ids"]) == b"".join(bytes(r["ids"]) for r in own) and s["length"] == sum(r["length"] for r in own)
        assert [tuple(p) for p in s["pieces"]] == [(r["doc_id"], r["start"], r["length"]) for r in own]


def test_little_padding(spark):
    got = packing.packed_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    total, sequences = got.selectExpr("sum(length)", "count(distinct sequence_id)").first()
    assert 4096 * sequences <= total * 1.01 + 4096


def test_odd_rows(odd, none):
    got = packing.packed_documents(odd).collect()
    check([(r["doc_id"], r["text"]) for r in odd.collect()], got)
    assert packing.packed_documents(none).collect() == []


@pytest.mark.parametrize("lengths", [[], [4096] * 3, [1]])
def test_edges(lengths):
    where, offset, windows = packing.best_fit_decreasing(np.array(lengths, np.int64))
    assert windows == len(lengths) and where.tolist() == list(range(len(lengths))) and not offset.any()
