"""Token files and pseudonyms: round trips and plain versions."""

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from boxoffice.llm import pii, tokenfiles
from boxoffice.session import materialize

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD_TEXTS = ["It's we'll. .'s ''s x''ll don't <|endoftext|> hi", "naïve ΟΔΟΣ ΣΑΣ. café é …’s ²³ 12a", None, "", "\x00a\x1cb\x85c\xa0d",
             "ÀÉß ÿ×÷", "İstanbul", "é ä", "x" * 3000, "漢字\U0001F600 ok"]


@pytest.mark.parametrize("kind", ["none", "small", "wide", "same", "full"])
def test_blocks(kind):
    rng = np.random.default_rng(0)
    ids = {"none": [], "small": rng.integers(0, 50_000, 1000), "wide": rng.zipf(1.5, 5000) % 4_000_000_000, "same": [7] * 300,
           "full": [2 ** 32 - 1, 0]}[kind]
    ids = np.array(ids, np.uint32)
    assert (tokenfiles.unpack_ids(len(ids), *tokenfiles.pack_ids(ids)) == ids).all()
    counts = np.array([len(ids), 0])
    doc_ids, got, back = tokenfiles.parse_file(tokenfiles.file_bytes([None, -5], counts, ids))
    assert doc_ids == [None, -5] and (got == counts).all() and (back == ids).all()


def test_ids_are_those_of_the_whole_text():
    encoder = tokenfiles.Encoder(PATH)
    for _ in range(2):
        ids, counts = encoder.encode(ODD_TEXTS)
        at = 0
        for text, n in zip(ODD_TEXTS, counts):
            assert ids[at: at + n].tolist() == encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
            at += n


def test_other_tokenizers_encode_whole_texts(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = tokenfiles.Encoder(path)
    assert tokenfiles.Encoder(PATH).cuts_hold and not encoder.cuts_hold
    texts = ["Hello  World", "don't", "A\n\nB 123", *ODD_TEXTS]
    ids, counts = encoder.encode(texts)
    want = [encoder.tokenizer.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == list(map(len, want))
    got = sorted(tuple(r) for r in tokenfiles.document_tokens(docs(texts), path).collect())
    assert [r[2] for r in got] == list(map(len, want)) and [r[3] for r in got] == [zlib.crc32(np.array(w, "<u4").tobytes()) for w in want]


def expected(rows):
    encoder, start, out = tokenfiles.Encoder(PATH), 0, []
    for doc_id, text in rows:
        ids = np.array(encoder.tokenizer.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_documents_in_order(docs):
    rows = list(enumerate(ODD_TEXTS))
    got = tokenfiles.document_tokens(docs(ODD_TEXTS[::-1], extra=True).withColumn("doc_id", len(rows) - 1 - F.col("doc_id"))).collect()
    assert sorted(tuple(r) for r in got) == expected(rows)


def test_small_table_over_many_files(spark, monkeypatch):
    monkeypatch.setattr(tokenfiles.write_token_files, "__defaults__", (5000,))
    frame = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = tokenfiles.document_tokens(frame.repartition(4)).collect()
    assert sorted(tuple(r) for r in got) == expected([(r["doc_id"], r["text"]) for r in frame.orderBy("doc_id").collect()])


def test_odd_rows(odd, none):
    got = sorted((tuple(r) for r in tokenfiles.document_tokens(odd).collect()), key=lambda r: r[1])
    assert len(got) == odd.count()
    assert [r[0] for r in got] == sorted((r["doc_id"] for r in odd.collect()), key=lambda d: -1 if d is None else d)
    assert [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert tokenfiles.document_tokens(none).collect() == []


# ---- pseudonyms

def plain_feistel(values, radices, key, kind):
    state, half = list(values), len(values) // 2
    for number in range(pii.ROUNDS):
        right = number % 2 == 0
        fixed = state[:half] if right else state[half:]
        told = "|".join([key, kind, str(number), str(len(state)), ",".join(map(str, fixed))])
        digest = hashlib.sha256(told.encode()).hexdigest()
        for i in range(half, len(state)) if right else range(half):
            stream = int(hashlib.sha256(f"{digest}{i}".encode()).hexdigest()[:12], 16)
            state[i] = (state[i] + stream) % radices[i]
    return state


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def replaced(docs, texts, key="k"):
    return {r["doc_id"]: (r["text"], r["n_values"]) for r in pii.pseudonymised(docs(texts), key).collect()}


def test_cards_stay_valid_and_linked(docs):
    texts = ["4041894974608795 and 4041 8949 7460 8795", "pay 4041-8949-7460-8795!", "4041894974608796", "a4041894974608795", "3782 822463 10005"]
    got = replaced(docs, texts)
    payload = [int(c) for c in "404189497460879"]
    new = "".join(map(str, plain_feistel(payload, [10] * 15, "k", "card")))
    seen = re.sub(r"\D", "", got[1][0])
    assert seen[:-1] == new and luhn(seen) and got[1][0] == f"pay {seen[:4]}-{seen[4:8]}-{seen[8:12]}-{seen[12:]}!"
    assert got[0] == (f"{seen} and {seen[:4]} {seen[4:8]} {seen[8:12]} {seen[12:]}", 2)
    assert got[2] == (texts[2], 0) and got[3] == (texts[3], 0)
    assert luhn(re.sub(r"\D", "", got[4][0])) and re.fullmatch(r"\d{4} \d{6} \d{5}", got[4][0])
    assert replaced(docs, texts, "other key")[1] != got[1]


def test_formats(docs):
    texts = ["mail Bob.42@mail8.example.com now", "+1 (988) 555-2485 x 555-0123", "152.143.123.131, 999.1.1.1", "2024-02-29 2023-02-29", "31.12.1999 12/25/2020 25/12/2020",
             "123-45-6789 000-12-3456 666-12-3456", "GB82 WEST 1234 5698 7654 32 DE89370400440532013001", "1/2/2003", "1799-12-31"]
    got = replaced(docs, texts)
    assert re.fullmatch(r"mail [A-Z][a-z]{2}\.\d\d@mail8\.example\.com now", got[0][0]) and got[0][0] != texts[0]
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} x \d{3}-\d{4}", got[1][0]) and got[1][1] == 2
    address, other = got[2][0].split(", ")
    assert all(int(o) < 256 for o in address.split(".")) and other == "999.1.1.1" and got[2][1] == 1
    assert re.fullmatch(r"\d{4}-\d\d-\d\d 2023-02-29", got[3][0]) and got[3][0] != texts[3]
    assert got[4][1] == 3
    m, d, y = got[4][0].split()[1].split("/")
    assert got[4][0].split()[2] in (f"{d}/{m}/{y}", f"{m}/{d}/{y}")
    area, group, serial = map(int, got[5][0].split()[0].split("-"))
    assert 0 < area < 900 and area != 666 and group and serial and got[5][1] == 1
    assert re.fullmatch(r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d DE89370400440532013001", got[6][0])
    number = "".join(str(int(c, 36)) for c in (lambda s: s[4:] + s[:4])(got[6][0][:27].replace(" ", "")))
    assert int(number) % 97 == 1
    assert got[7][1] == 1 and got[8] == (texts[8], 0)


def test_the_date_permutation_is_one(spark):
    a, b = pii.DAY_RADIX
    days = spark.range(a * b).select(pii.feistel(F.array(F.floor(F.col("id") / b).cast("int"), (F.col("id") % b).cast("int")), F.array(F.lit(a), F.lit(b)), "k", "date").alias("v"))
    r = days.agg(F.count_distinct(F.col("v")[0] * b + F.col("v")[1]), F.max(F.col("v")[0]), F.max(F.col("v")[1])).first()
    assert tuple(r) == (a * b, a - 1, b - 1)


def test_a_single_free_position_is_ranked(docs, spark):
    """Names of one letter or digit are permuted among their kind, not shifted; names without any stay."""
    names = [*"abcdefghijklmnopqrstuvwxyz", *"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *"0123456789", "_", "._%", *(f"{c}_" for c in "abc")]
    for key in ("k", "other"):
        got = replaced(docs, [f"{n}@x.org" for n in names], key)
        new = {n: got[i][0][:-6] for i, n in enumerate(names)}
        for group in (names[:26], names[26:52], names[52:62]):
            assert sorted(new[n] for n in group) == sorted(group)
            assert len({(ord(new[n]) - ord(n)) % len(group) for n in group}) > 3
        assert new["_"] == "_" and new["._%"] == "._%" and got[names.index("_")][1] == 0
        assert [new[f"{c}_"] for c in "abc"] == [f"{new[c]}_" for c in "abc"]


def slash_texts(spark, first, days):
    """Dates written month first, and those after a 12th day first as well."""
    day = F.date_add(F.lit(pii.FIRST_DAY).cast("date"), F.col("id").cast("int"))
    dates = spark.range(first, first + days).select(day.alias("day"))
    return dates.select(F.date_format("day", "MM/dd/yyyy").alias("t")).unionByName(
        dates.filter(F.dayofmonth("day") > 12).select(F.date_format("day", "dd/MM/yyyy").alias("t"))).repartition(16)


def test_every_slash_date_has_a_number_of_its_own(spark, monkeypatch):
    """With the permutations left out, all 234,594 texts come back."""
    monkeypatch.setattr(pii, "_pair", lambda index, radix, key, kind: index + F.lit(0))
    texts = slash_texts(spark, 0, 146097)
    r = texts.agg(F.count("*"), F.count_if(pii.slash_date(F.col("t"), "k") == F.col("t"))).first()
    assert tuple(r) == (234594, 234594)


def test_slash_dates_stay_different(spark):
    new = materialize(slash_texts(spark, 36_000, 6000).select("t", pii.slash_date(F.col("t"), "k").alias("p")), "slash")
    sort = lambda c: F.when((F.substring(c, 1, 2) <= "12") & (F.substring(c, 4, 2) <= "12"), 0).when(F.substring(c, 1, 2) <= "12", 1).otherwise(2)
    r = new.agg(F.count("p") - F.count_distinct("p"), F.count_if(sort(F.col("t")) != sort(F.col("p"))), F.count_if(F.col("t") == F.col("p"))).first()
    assert tuple(r[:2]) == (0, 0) and r[2] < 20 and new.count() > 9000


@pytest.mark.parametrize("radix", [pii.EARLY_RADIX, pii.LATE_RADIX])
def test_the_slash_permutations_are_ones(spark, radix):
    numbers = spark.range(radix[0] * radix[1]).repartition(16).select(pii._pair(F.col("id"), radix, "k", "kind").alias("n"))
    assert tuple(numbers.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first()) == (radix[0] * radix[1], 0, radix[0] * radix[1] - 1)


def plain_slash(text, key):
    import datetime as dt
    a, b, year = map(int, text.split("/"))
    month, day = (a, b) if a <= 12 else (b, a)
    first = dt.date(1800, 1, 1)
    if day <= 12:
        n = (year - 1800) * 144 + (month - 1) * 12 + day - 1
        x, y = plain_feistel([n // 240, n % 240], [240, 240], key, "early date")
        n = x * 240 + y
        new = dt.date(1800 + n // 144, n // 12 % 12 + 1, n % 12 + 1)
    else:
        late = [d for d in (first + dt.timedelta(i) for i in range(146097)) if d.day > 12]
        x, y = plain_feistel([late.index(dt.date(year, month, day)) // 9833, late.index(dt.date(year, month, day)) % 9833], [9, 9833], key, "late date")
        new = late[x * 9833 + y]
    return new.strftime("%m/%d/%Y" if a <= 12 else "%d/%m/%Y")


def test_slash_dates_equal_a_plain_version(docs):
    texts = ["02/03/2020", "12/25/2020", "25/12/2020", "01/01/1800", "12/31/2199", "29/02/2000", "07/12/1999"]
    got = replaced(docs, texts)
    assert [got[i][0] for i in range(len(texts))] == [plain_slash(t, "k") for t in texts]


def test_odd_rows_of_text(odd, none):
    got = pii.pseudonymised(odd, "k")
    assert got.columns[:-1] == odd.columns
    assert sorted(map(str, got.drop(got.columns[-1]).collect())) == sorted(map(str, odd.collect()))
    assert pii.pseudonymised(none, "k").collect() == []
    assert not re.search("Python|Arrow|Pandas|Exchange", got._jdf.queryExecution().executedPlan().toString())


def test_packing_ids_takes_little_memory():
    import tracemalloc

    ids = np.random.default_rng(5).integers(0, 49_000, 4_000_000).astype(np.uint32)
    tracemalloc.start()
    packed = tokenfiles.pack_ids(ids)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20 * len(ids) and (tokenfiles.unpack_ids(len(ids), *packed) == ids).all()
