"""Searches through the gram index give what the scan gives, and read few files."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from boxoffice.functions.text import has_text
from boxoffice.operators import search
from boxoffice.operators.search import ListingFilter
from boxoffice.session import new_folder
from boxoffice.sources import textindex
from boxoffice.sources.derived import from_trade_tables
from boxoffice.sources.textindex import TextIndex
from tests.conftest import SF, rows

TEXTS = ["Rock Night", "rock  NIGHT", "Röck nîght", "Röck", "Straße", "STRASSE", "Ærø æ", "ﬁnal", "İstanbul", "istanbul", "ıspanak", "東京 rock", "naïve café",
         "a", "ab", "abc", "", None, "100% _fun_", "tab\there", "two\nlines", "soft­hyphen", "zero​width", "Ångström Å", "50 K", "ſilent", "x\x01y", "eͅ", "Đà Nẵng",
         "𝐛old", "ROCK'N'ROLL", "l·l", "ŉ", "don't", "don’t", "o̸"]
NEEDLES = ["rock", "ROCK", "röck", "night", "a", "B", "ab", "ss", "ß", "ae", "æ", "fi", "i", "I", "ist", "東京", "café", "%", "_fun", " ", "\t", "\n", "hyph", "softhyphen", "zerow",
           "ang", "k", "K", "s", "xy", "e", "da na", "bold", "n'r", "ll", "n", "'t", "t", "o", "zzz", "abcd", "rock  n", "̈", ""]


@pytest.fixture(scope="module")
def index(spark):
    frame = spark.createDataFrame(list(enumerate(TEXTS * 4)), "id long, text string").cache()
    return frame, TextIndex(spark, new_folder(spark, "grams")).add(frame, "id", ("text",))


def test_every_needle_equals_the_scan(index, monkeypatch):
    frame, built = index
    monkeypatch.setattr(textindex, "SHARE", 1.0)
    for pushed in (0, 1000):
        monkeypatch.setattr(textindex, "PUSHED", pushed)
        for needle in NEEDLES[pushed and 25:]:
            scan = frame.filter(has_text(F.col("text"), needle))
            assert rows(built.narrowed(frame, "id", ("text",), needle).filter(has_text(F.col("text"), needle)), "id") == rows(scan, "id"), needle


def test_folded_characters_are_equal_exactly_if_the_search_says_so(spark):
    """The premise of the index, on every pair of characters it folds to, and on every letter it folds."""
    plain = [chr(c) for c in range(32, 127)] + ["\t", "\n", "\r"]
    pairs = spark.createDataFrame([(a, b) for a in plain for b in plain], "a string, b string")
    same = pairs.filter(has_text(F.col("a"), F.col("b")))
    assert sorted(map(tuple, same.collect())) == sorted((a, b) for a in plain for b in plain if a.lower() == b.lower())
    letters = spark.createDataFrame(list(zip(textindex.FROM, textindex.TO)), "a string, b string")
    assert letters.filter(~has_text(F.col("a"), F.col("b"))).count() == 0
    assert all(unicodedata.combining(c) or unicodedata.category(c) == "Mn" for c in textindex.FROM[len(textindex.TO):])


def test_random_texts_and_needles(spark, monkeypatch):
    monkeypatch.setattr(textindex, "SHARE", 1.0)
    rng = random.Random(4)
    letters = "abcABé ́ñ-#"
    frame = spark.createDataFrame([(i, "".join(rng.choice(letters) for _ in range(rng.randrange(14)))) for i in range(400)], "id long, text string").cache()
    built = TextIndex(spark, new_folder(spark, "grams")).add(frame, "id", ("text",))
    for _ in range(25):
        needle = "".join(rng.choice(letters[:9]) for _ in range(rng.randrange(1, 5)))
        scan = frame.filter(has_text(F.col("text"), needle))
        assert rows(built.narrowed(frame, "id", ("text",), needle).filter(has_text(F.col("text"), needle)), "id") == rows(scan, "id"), repr(needle)


def test_added_and_edited_rows_are_found(spark, monkeypatch):
    monkeypatch.setattr(textindex, "SHARE", 1.0)
    first = spark.createDataFrame([(1, "red hall"), (2, "blue hall"), (3, "green room")], "id long, text string")
    built = TextIndex(spark, new_folder(spark, "grams")).add(first, "id", ("text",))
    built.add(spark.createDataFrame([(2, "yellow barn"), (4, "red barn")], "id long, text string"), "id", ("text",))
    now = spark.createDataFrame([(1, "red hall"), (2, "yellow barn"), (4, "red barn")], "id long, text string")  # 2 edited, 3 deleted
    small = built.compacted(now, "id", ("text",), new_folder(spark, "grams"))
    for each in (built, small):
        for needle, want in (("hall", [(1,)]), ("barn", [(2,), (4,)]), ("green", []), ("ed", [(1,), (4,)])):
            assert rows(each.narrowed(now, "id", ("text",), needle).filter(has_text(F.col("text"), needle)), "id") == want


@pytest.mark.parametrize("wanted", [ListingFilter(search="gear"), ListingFilter(city="nation_1", search="hot"), ListingFilter(search="#1"),
                                    ListingFilter(search="r_ng", wildcards=True), ListingFilter(city="tion_3", price="free")])
def test_catalogue_equals_the_scan(spark, wanted, monkeypatch):
    monkeypatch.setattr(textindex, "SHARE", 1.0)
    t = from_trade_tables(spark, SF)
    built = TextIndex(spark, new_folder(spark, "grams")).add(t.listings, "id", search.LISTING_TEXTS)
    found = search.catalogue_matches(t, wanted, built)
    assert rows(found, "listing_id", "registered") == rows(search.catalogue_matches(t, wanted), "listing_id", "registered")


def _rows_read(frame):
    """Rows that the file scans of a finished query handed on, after files, row groups and pages were skipped."""
    query = frame._jdf.queryExecution()
    frame.collect()
    leaves = query.executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.length()))


def test_a_search_reads_few_postings(spark, monkeypatch):
    monkeypatch.setattr(textindex, "ROW_GROUP", 1 << 16)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        words = spark.range(40_000).select("id", F.concat(F.md5(F.col("id").cast("string")), F.lit(" needle"), F.col("id").cast("string")).alias("text"))
        folder = new_folder(spark, "grams")
        built = TextIndex(spark, folder).add(words, "id", ("text",))
        postings = spark.read.parquet(f"{folder}/postings")
        keys, most = built.candidates("text", "e39999")
        found = [r["key"] for r in keys.collect()]
        assert 39999 in found and len(found) <= most
        plan = keys._jdf.queryExecution().executedPlan().toString()
        assert "PushedFilters: [IsNotNull(field), EqualTo(field,text)" in plan and "gram" in plan.split("PushedFilters")[1]
        assert most < 1000 and _rows_read(postings.filter(F.col("gram").isin("e39", "399", "999"))) < postings.count() / 20
        assert built.candidates("text", "needle") is None  # in every row: the scan is cheaper
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_a_gram_is_posted_once_per_block(spark, monkeypatch):
    """Digits of many rows: a row per block and gram, not one per row and gram; several blocks, text keys, and texts beyond the fold."""
    monkeypatch.setattr(textindex, "BLOCK", 300)
    monkeypatch.setattr(textindex, "SHARE", 1.0)
    monkeypatch.setattr(textindex, "PUSHED", 0)
    code = F.when(F.col("id") % 500 == 7, F.lit("東京 17")).when(F.col("id") % 400 == 9, F.lit("")).otherwise(F.concat(F.lit("TCK-"), F.col("id") % 10))
    frame = spark.range(0, 2000, 1, 2).select(F.concat(F.lit("r"), F.col("id")).alias("id"), code.alias("text")).cache()
    folder = new_folder(spark, "grams")
    built = TextIndex(spark, folder).add(frame, "id", ("text",))
    assert spark.read.parquet(f"{folder}/postings").filter("field = 'text'").count() <= 8 * 40
    for needle in ("k-3", "TCK-7", "17", "7", "tck-77"):
        scan = frame.filter(has_text(F.col("text"), needle))
        assert rows(built.narrowed(frame, "id", ("text",), needle).filter(has_text(F.col("text"), needle)), "id") == rows(scan, "id"), needle
