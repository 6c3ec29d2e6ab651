import pytest

#: Names that the operators use inside.
CLASHES = ("block", "size", "u", "fp", "row_key", "score", "lang_pred", "has_letter", "hit_words", "hit_items", "mix_plan",
           "mix_key", "mix_turn", "mix_repeat", "n_values", "pii_values", "bucket", "h", "root", "rank", "_row_key", "_slice", "repeat", "mix_row", "part", "number", "n", "form", "_words", "_form", "lines")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Documents from texts, or from (doc_id, text, lang, source); with columns of clashing names on request."""
    def build(rows, extra=False):
        full = [(i, r, "en", "a", 0) if not isinstance(r, tuple) else (*r, *("en", "a")[len(r) - 2:], 0) for i, r in enumerate(rows)]
        out = spark.createDataFrame(full, SCHEMA)
        return out.selectExpr("*", *(f"'x' as `{c}`" for c in CLASHES)) if extra else out
    return build


@pytest.fixture
def odd(docs):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    long = "word " * 30_000 + "x" * 50_000
    rows = [(None, None, None, None), (1, None, "en", "a"), (2, "", None, "b"), (3, "one two three four five", "en", "a"),
            (3, "one two three four five", "en", "a"), (None, "one two three four five", "en", None), (4, "Ünï çödé — 漢字 \U0001F600", "de", "é"),
            (5, long, "en", "a"), (6, " \t\n ", "fr", "b"), (7, "12 34 !!", "fr", None)]
    return docs(rows, extra=True)


@pytest.fixture
def none(docs):
    return docs([])


def untouched(frame):
    """No operator has written into the columns that only share a name with one of its own."""
    assert all(tuple(r) == ("x",) * len(CLASHES) for r in frame.select(*(f"`{c}`" for c in CLASHES)).distinct().collect())
