"""Fill-in-the-middle against a plain version on strings, and the words' marks against loops."""

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from boxoffice.llm import middle


def plain(doc_id, text, seed=7, rate=100, spm=50, unit=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(unit, text, re.DOTALL)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i: 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    out, form = (f"<S>{s}<P>{p}<M>{m}", "spm") if h4 % 100 < spm else (f"<P>{p}<S>{s}<M>{m}", "psm")
    return doc_id, len(units), form, len(p), len(m), out


TEXTS = ["", None, "\n", "\n\n\n", "one", "one\ntwo", "one\ntwo\n", "Ünï\nçödé — 漢字\n\U0001F600\n\nx", "a <P> b\nc\nd", "<\nP>\n<S", "x\r\ny\x0b z\n",
         "line\n" * 5000, "no end " * 9000, *(f"{'ä' * k}\n{'b' * (9 - k)}\n" * k for k in range(9))]


@pytest.mark.parametrize("unit", ["line", "char"])
def test_equals_the_plain_version(docs, unit):
    rows = list(enumerate(TEXTS * 3))
    got = middle.fill_in_middle(docs([t for _, t in rows]), unit=unit).collect()
    want = [plain(i, t, unit=r"[^\n]*\n|[^\n]+" if unit == "line" else ".") for i, t in rows]
    assert sorted(tuple(r[c] for c in ("doc_id", "n", "form", "prefix_chars", "middle_chars", "text")) for r in got) == want


def test_rates(docs):
    rows = [(i, "a\nb\nc\n") for i in range(400)]
    got = middle.fill_in_middle(docs([t for _, t in rows]), seed=9, rate=30, spm=80).collect()
    assert sorted((r["doc_id"], r["form"], r["text"]) for r in got) == [(w[0], w[2], w[5]) for w in (plain(i, t, 9, 30, 80) for i, t in rows)]
    assert 80 < sum(r["form"] != "plain" for r in got) < 160


def test_digests(docs):
    got = sorted(tuple(r) for r in middle.middle_digests(docs(TEXTS, extra=True)).collect())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == [(*w[:5], sha(w[5]), sha(t or "")) for w, t in ((plain(i, t), t) for i, t in enumerate(TEXTS))]


def test_odd_rows(odd, none):
    got = middle.fill_in_middle(odd)
    assert got.columns[:len(odd.columns)] == odd.columns
    key = lambda r: [str(v) for v in r]
    others = [c for c in odd.columns if c != "text"]
    new = got.columns[len(odd.columns):]
    seen = sorted((key([r[c] for c in [*others, *new, "text"]]) for r in got.collect()))
    assert seen == sorted(key([*(r[c] for c in others), *plain(r["doc_id"], r["text"])[1:]]) for r in odd.collect())
    assert middle.middle_digests(none).collect() == []


def test_new_columns_do_not_overwrite(docs):
    frame = docs(["a\nb\n"]).selectExpr("*", "'kept' as n", "1.5 as form", "'z' as h1")
    got = middle.fill_in_middle(frame)
    assert got.columns[-4:] == ["n_", "form_", "prefix_chars", "middle_chars"]
    assert tuple(got.select("n", "form", "h1").first()) == ("kept", frame.first()["form"], "z")


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=70), st.integers(0, 255))
def test_marks(data, byte):
    raw = np.frombuffer(data, np.uint8)
    marks = middle.Marks(middle.bytes_equal(middle.as_words(raw), byte))
    places = np.flatnonzero(np.append(raw, np.zeros(8 - len(raw) % 8, np.uint8)) == byte)
    assert marks.select(np.arange(len(places))).tolist() == places.tolist()
    assert marks.rank(np.arange(len(raw) + 1)).tolist() == [int((places < k).sum()) for k in range(len(raw) + 1)]
