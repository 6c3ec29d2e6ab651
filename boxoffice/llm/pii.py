"""PII pseudonyms by a keyed Feistel permutation within each value's format. DataFrame functions only.

Found and validated: card numbers (13 to 19 digits, Luhn), social security numbers, phone numbers, IPv4 addresses, bank
account numbers (IBAN, mod 97), e-mail names, and calendar dates from 1800 to 2199. A value is a list of positions, each
with its radix: digits 10, letters 26, octets 256, the 146097 days of 400 years as 189 x 773. A Feistel network shifts one
half of the positions by a digest of the key and the other half, and in the next round the other way; this is a
permutation of exactly the values of that format. One position alone is mapped by a keyed ranking. Check digits are left out and computed anew, so the result validates
too. Equal values of a kind give equal pseudonyms in every document, whatever their separators, without any join.

A text is cut at the matches of one pattern and put together again; texts without a match pass unchanged. No shuffle.

Defined results: a null text stays null with no values; what matches but does not validate stays as it is; repeated rows
give equal results; all other columns pass through.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxoffice.llm.text import fresh

ROUNDS = 8
FIRST_DAY, LAST_DAY = "1800-01-01", "2199-12-31"  # 146097 days
DAY_RADIX = (189, 773)
FIRST_YEAR, MONTHS = 1800, 4800
EARLY_RADIX, LATE_RADIX = (240, 240), (9, 9833)  # 57600 days up to a 12th, 88497 later ones
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999  # 001-899 without 666, 01-99, 0001-9999

#: Kind, pattern. The first that matches at a place decides; possessive quantifiers keep long words linear.
KINDS = (
    ("email", r"(?<![\w.%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("iso_date", r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"),
    ("dot_date", r"(?<![\w.])\d{1,2}\.\d{1,2}\.\d{4}(?!\w)"),
    ("slash_date", r"(?<![\w/])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"),
    ("ip", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<!\w)(?:\d{13,19}|\d{4} \d{4} \d{4} \d{1,7}|\d{4}-\d{4}-\d{4}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?!\w)"),
    ("phone", r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\) ?|\d{2,4}[ .-])?\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)"),
)
ANY = "|".join(p for _, p in KINDS)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _numbers(text: Column) -> Column:
    """The digits of ``text`` as an array of numbers."""
    return F.transform(F.split(text, "(?!^)(?!$)"), lambda c: c.cast("int"))


def _text(numbers: Column) -> Column:
    return F.array_join(F.transform(numbers, lambda n: n.cast("string")), "")


def feistel(values: Column, radices: Column, key: str, kind: str) -> Column:
    """``values`` (numbers below their ``radices``) permuted: rounds that shift the halves in turn."""
    half = F.floor(F.size(values) / 2).cast("int")

    def turn(state: Column, number: Column) -> Column:
        moves_right = number % 2 == 0
        fixed = F.when(moves_right, F.slice(state, 1, half)).otherwise(F.slice(state, half + 1, F.size(state) - half))
        told = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), F.size(state).cast("string"), F.array_join(F.transform(fixed, lambda n: n.cast("string")), ","))
        digest = F.sha2(told, 256)

        def moved(value: Column, place: Column) -> Column:
            stream = F.conv(F.substring(F.sha2(F.concat(digest, place.cast("string")), 256), 1, 12), 16, 10).cast("long")
            shifted = ((value + stream) % F.get(radices, place)).cast("int")
            return F.when((place >= half) == moves_right, shifted).otherwise(value)

        return F.transform(state, moved)

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, turn)


def permuted(values: Column, radices: Column, key: str, kind: str) -> Column:
    """``feistel``; a single value, which leaves one half of a network empty, is mapped by a keyed ranking of all it could be."""
    radix = F.get(radices, F.lit(0))
    ranked = F.array_sort(F.transform(F.sequence(F.lit(0), radix - 1), lambda v: F.struct(
        F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), F.lit("rank"), radix.cast("string"), v.cast("string")), 256).alias("by"), v.alias("value"))))
    one = F.array(F.get(ranked, F.get(values, F.lit(0)))["value"].cast("int"))
    return F.when(F.size(values) == 1, one).otherwise(feistel(values, radices, key, kind))


def _fill(value: Column, pattern: str, pieces: Column) -> Column:
    """``value`` with its matches of ``pattern`` replaced, in order, by ``pieces``."""
    rest = F.split(value, pattern, -1)
    return F.array_join(F.flatten(F.zip_with(rest, pieces, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")


def _same(radix: int, values: Column) -> Column:
    return F.transform(values, lambda _: F.lit(radix))


def _luhn_sum(numbers: Column, odd: int) -> Column:
    """Luhn sum from the right; places with index % 2 == ``odd`` are doubled."""
    terms = F.transform(F.reverse(numbers), lambda n, i: F.when(i % 2 == odd, F.when(n > 4, 2 * n - 9).otherwise(2 * n)).otherwise(n))
    return F.aggregate(terms, F.lit(0), lambda s, n: s + n)


def card(value: Column, key: str) -> Column:
    numbers = _numbers(_digits(value))
    payload = F.slice(numbers, F.lit(1), F.size(numbers) - 1)
    new = feistel(payload, _same(10, payload), key, "card")
    check = (10 - _luhn_sum(new, 0) % 10) % 10
    filled = _fill(value, r"\d", F.transform(F.concat(new, F.array(check)), lambda n: n.cast("string")))
    return F.when(_luhn_sum(numbers, 1) % 10 == 0, filled)


def phone(value: Column, key: str) -> Column:
    """The country code stays."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .(-])", 0)
    rest = F.substring(value, F.length(code) + 1, F.length(value))
    numbers = _numbers(_digits(rest))
    new = F.transform(feistel(numbers, _same(10, numbers), key, "phone"), lambda n: n.cast("string"))
    return F.when(F.length(_digits(value)).between(7, 15), F.concat(code, _fill(rest, r"\d", new)))


def ip(value: Column, key: str) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("int"))
    new = F.array_join(F.transform(feistel(octets, _same(256, octets), key, "ip"), lambda n: n.cast("string")), ".")
    return F.when(F.forall(octets, lambda o: o <= 255), new)


def ssn(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, "-"), lambda p: p.cast("int"))
    area, group, serial = (F.get(parts, F.lit(i)) for i in range(3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    values = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    new = feistel(values, F.array(F.lit(SSN_AREAS), F.lit(SSN_GROUPS), F.lit(SSN_SERIALS)), key, "ssn")
    a = F.get(new, F.lit(0)) + 1
    out = F.format_string("%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), F.get(new, F.lit(1)) + 1, F.get(new, F.lit(2)) + 1)
    return F.when(valid, out)


def _classes(text: Column) -> tuple[Column, Column]:
    """Numbers and radices of a text of digits and letters."""
    chars = F.split(text, "(?!^)(?!$)")
    base = lambda c: F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).otherwise(65)
    radices = F.transform(chars, lambda c: F.when(c.between("0", "9"), 10).otherwise(26))
    return F.transform(chars, lambda c: F.ascii(c) - base(c)), radices


def _with_classes(text: Column, numbers: Column) -> Column:
    """Each digit or letter of ``text`` becomes the one of its class with the given number."""
    low, high, ten = (F.lit(a) for a in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"))
    return F.array_join(F.zip_with(F.split(text, "(?!^)(?!$)"), numbers, lambda c, n: F.when(
        c.between("0", "9"), F.substr(ten, n + 1, F.lit(1))).when(c.between("a", "z"), F.substr(low, n + 1, F.lit(1))).when(
        c.between("A", "Z"), F.substr(high, n + 1, F.lit(1))).otherwise(c)), "")


def email(value: Column, key: str) -> Column:
    """The letters and digits of the name before the @; the domain and other characters stay. A name without any has no pseudonym."""
    name = F.substring_index(value, "@", 1)
    free = F.regexp_replace(name, "[^A-Za-z0-9]", "")
    new = _with_classes(free, permuted(*_classes(free), key, "email"))
    out = F.concat(_fill(name, "[A-Za-z0-9]", F.split(new, "(?!^)(?!$)")), F.lit("@"), F.substring_index(value, "@", -1))
    return F.when(free != "", out)


def _mod97(text: Column) -> Column:
    """The number that a text of digits and letters (A is 10) stands for, modulo 97."""
    values = F.transform(F.split(text, "(?!^)(?!$)"), lambda c: F.when(c.between("0", "9"), c.cast("int")).otherwise(F.ascii(c) - 55))
    return F.aggregate(values, F.lit(0), lambda s, v: F.when(v > 9, s * 100 + v).otherwise(s * 10 + v) % 97)


def iban(value: Column, key: str) -> Column:
    bare = F.regexp_replace(value, " ", "")
    country, account = F.substring(bare, 1, 2), F.substring(bare, 5, 40)
    numbers, radices = _classes(account)
    new = _with_classes(account, feistel(numbers, radices, key, "iban"))
    check = F.lpad((98 - _mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    out = _fill(value, "[A-Z0-9]", F.split(F.concat(country, check, new), "(?!^)(?!$)"))
    return F.when(_mod97(F.concat(account, country, F.substring(bare, 3, 2))) == 1, out)


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _valid_day(iso: Column) -> Column:
    first, last = (F.lit(d).cast("date") for d in (FIRST_DAY, LAST_DAY))
    return _let(F.try_to_date(iso, "yyyy-M-d"), lambda day: F.when(day.between(first, last), day))


def _pair(index: Column, radix: tuple[int, int], key: str, kind: str) -> Column:
    """A number below the product of two radices, permuted."""
    a, b = radix
    halves = _let(index, lambda n: F.array(F.floor(n / b).cast("int"), (n % b).cast("int")))
    return _let(feistel(halves, F.array(F.lit(a), F.lit(b)), key, kind), lambda n: F.get(n, F.lit(0)) * b + F.get(n, F.lit(1)))


def _date(value: Column, key: str, pattern: str, iso: Column) -> Column:
    """``iso``: the ISO text of the value's one reading."""
    first, short = F.lit(FIRST_DAY).cast("date"), pattern.replace("dd", "d").replace("MM", "M")
    moved = _let(_valid_day(iso), lambda day: F.when(day.isNotNull(), F.date_add(first, _pair(F.datediff(day, first), DAY_RADIX, key, "date"))))
    return _let(moved, lambda day: F.when(F.length(value) == 10, F.date_format(day, pattern)).otherwise(F.date_format(day, short)))


def _month_start(month: Column) -> Column:
    """The first of a month, counted from the first year's January as 0."""
    return F.make_date(FIRST_YEAR + F.floor(month / 12).cast("int"), (month % 12 + 1).cast("int"), F.lit(1))


def _late_days_before(month: Column) -> Column:
    """How many days after a 12th lie before a month."""
    return F.datediff(_month_start(month), F.lit(FIRST_DAY).cast("date")) - 12 * month


def _early_moved(month: Column, day: Column, key: str) -> Column:
    """The pseudonym of a day up to the 12th."""
    return _let(_pair(month * 12 + day - 1, EARLY_RADIX, key, "early date"), lambda n: F.date_add(_month_start(F.floor(n / 12).cast("int")), (n % 12).cast("int")))


def _late_moved(month: Column, day: Column, key: str) -> Column:
    """The pseudonym of a day after the 12th. A month has 16 to 19 of them, so its month is the guessed one or one beside it."""
    def found(n: Column) -> Column:
        def near(month: Column) -> Column:
            return F.when(month.between(0, MONTHS - 1) & (_late_days_before(month) <= n), month)
        guess = F.floor(n * MONTHS / (LATE_RADIX[0] * LATE_RADIX[1])).cast("int")
        return _let(guess, lambda g: _let(F.greatest(near(g - 1), near(g), near(g + 1)), lambda m: F.date_add(
            _month_start(m), (n - _late_days_before(m) + 12).cast("int"))))
    return _let(_pair(_late_days_before(month) + day - 13, LATE_RADIX, key, "late date"), found)


def slash_date(value: Column, key: str) -> Column:
    """Month first if that is a date, else day first. Days up to the 12th read both ways, later ones one way: each sort is permuted
    apart, so a pseudonym is read as it was written, and different dates stay different."""
    def reading(iso: Column, american: bool) -> Column:
        return _let(_valid_day(iso), lambda day: F.when(day.isNotNull(), F.struct(
            ((F.year(day) - FIRST_YEAR) * 12 + F.month(day) - 1).alias("month"), F.dayofmonth(day).alias("day"), F.lit(american).alias("american"))))

    def moved(r: Column) -> Column:
        return F.when(r["day"] <= 12, _early_moved(r["month"], r["day"], key)).otherwise(_late_moved(r["month"], r["day"], key))

    def written(r: Column) -> Column:
        def text(new: Column) -> Column:
            one, two = (F.when(r["american"], a).otherwise(b) for a, b in ((F.month(new), F.dayofmonth(new)), (F.dayofmonth(new), F.month(new))))
            return F.when(F.length(value) == 10, F.format_string("%02d/%02d/%04d", one, two, F.year(new))).otherwise(
                F.format_string("%d/%d/%04d", one, two, F.year(new)))
        return F.when(r.isNotNull(), _let(moved(r), text))

    either = F.coalesce(reading(_iso(value, "/", (2, 0, 1)), True), reading(_iso(value, "/", (2, 1, 0)), False))
    return _let(either, written)


def _iso(value: Column, separator: str, order: tuple[int, int, int]) -> Column:
    parts = F.split(value, separator)
    return F.concat_ws("-", *(F.get(parts, F.lit(i)) for i in order))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one match, or null where it does not validate."""
    makers = {
        "email": lambda v: email(v, key), "iban": lambda v: iban(v, key), "ip": lambda v: ip(v, key), "ssn": lambda v: ssn(v, key),
        "card": lambda v: card(v, key), "phone": lambda v: phone(v, key),
        "iso_date": lambda v: _date(v, key, "yyyy-MM-dd", v), "dot_date": lambda v: _date(v, key, "dd.MM.yyyy", _iso(v, r"\.", (2, 1, 0))),
        "slash_date": lambda v: slash_date(v, key),
    }
    cases = [(value.rlike(f"^(?:{p})$"), makers[k](value)) for k, p in KINDS]
    return reduce(lambda out, c: out.when(*c), cases[1:], F.when(*cases[0]))


def pseudonymised(docs: DataFrame, key: str, column: str = "text") -> DataFrame:
    """``docs`` with ``column`` pseudonymised, and n_values: how many values were replaced (the last column)."""
    text = F.col(f"`{column}`")
    found, count = fresh(docs.columns, "pii_values"), fresh(docs.columns, "n_values")
    pairs = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, key).alias("new")))
    hit = docs.withColumn(found, F.when(text.rlike(ANY), pairs))
    pieces = F.transform(F.col(found), lambda p: F.coalesce(p["new"], p["old"]))
    return hit.select(*(
        (F.when(F.col(found).isNotNull(), _fill(text, ANY, pieces)).otherwise(text).alias(c) if c == column else F.col(f"`{c}`")) for c in docs.columns),
        F.coalesce(F.size(F.filter(F.col(found), lambda p: p["new"].isNotNull())), F.lit(0)).cast("long").alias(count))
