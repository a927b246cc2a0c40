"""Format-preserving pseudonyms for personal data, by a keyed Feistel permutation in SQL expressions.

One pattern finds candidates. Each is validated; a valid one is permuted among the valid values of its own class, so the map is
one-to-one on all values and the key undoes it (`inverse`). A candidate that is not valid (an order number, 1985-13-45) is not
personal data of that class and stays as it is.

- cards: 13 to 19 digits with a right Luhn digit; the others are permuted, the Luhn digit follows
- dates (year-month-day, or day and month first, or month/day/year where that alone makes sense): days of 1800 to 2199
- IPv4 addresses of four octets up to 255 without leading zeros
- phone numbers with a plus or brackets, or like 123-456-7890, of 7 to 15 digits: the digits, the country code kept
- social security numbers, 123-45-6789, in the ranges that are given out
- IBANs that pass mod 97: the account part; new check digits
- mail addresses: the local part, its letters and digits each within their kind
- secrets of 32 or more hex digits, which stay hex; and quoted after token, key, secret or password (also where the name is quoted, as
  in JSON): characters within their kind

Equal values get equal pseudonyms in all documents, however they are spaced, since the permutation sees the characters
without the separators; phone numbers with and without a country code are different values. Text around matches is unchanged.

The key has no default: who knows it can undo the pseudonyms. `session_key` reads it from the setting spark.arcweft.pii.key; where
that is unset it draws a key that nobody keeps.

Nulls stay null, empty texts stay empty, a row with no match is returned as it is. Repeated rows get equal results; extra columns
pass through, whatever their names, as no column is added. Empty table: no rows. Long texts are worked on whole, and so are
long matches: the work on one grows in proportion to its length.
"""

from __future__ import annotations

import calendar
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that holds the key.
KEY_SETTING = "spark.arcweft.pii.key"
#: Days since 1800-01-01 that dates are permuted among: DAYS_A * DAYS_B.
DAYS_A, DAYS_B, FIRST_DAY = 400, 365, "1800-01-01"
#: Days of a leap year, as month/day, that cannot be read day first.
LATE_DAYS = tuple(f"{m:02}/{d:02}" for m in range(1, 13) for d in range(13, calendar.monthrange(2000, m)[1] + 1))
#: Most times that a value of no meaning is permuted on to one that has.
ROUNDABOUT = 8

#: Matches over so many characters are permuted by pads of a digest of the other half, so that the work stays in proportion.
LONG = 128

#: Candidates, most specific first. A mail address begins where its run of characters does or where the last match ended: one
#: start per run. Marks in front of its first letter or digit may be a bullet and stay as they are.
MAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[._%+-]*+[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,10}"
SECRET = r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,}+(?![0-9A-Za-z])"
NAMED = r"(?<=(?i:token|key|secret|password)[\"']? ?[=:] ?)[\"'][A-Za-z0-9+/_=-]{8,}+[\"']"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![0-9A-Za-z])"
DATE = r"(?<![0-9.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[.-][0-9])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"
PHONE = r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])"
#: Country codes: those of one and of two digits, all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
NUMBER = r"(?<![0-9-])[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9-])"
CANDIDATE = "|".join((MAIL, SECRET, NAMED, IBAN, DATE, ADDRESS, PHONE, CARD, NUMBER))
#: A quick test: a line without one of these holds no candidate, and no candidate crosses lines.
HINT = "[0-9@\"']"


def number(c: Column) -> Column:
    return c.cast("long")


def pad(key: str, *parts: Column | str) -> Column:
    """64 hex digits that depend on the key and all parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)), 256)


def draw(hexes: Column, below: Column | int) -> Column:
    """60 bits of a pad, below a bound."""
    return F.pmod(F.conv(F.substring(hexes, 1, 15), 16, 10).cast("long"), below if isinstance(below, Column) else F.lit(below))


def permute_pair(a: Column, b: Column, size_a: int, size_b: int, key: str, kind: str, inverse: bool = False) -> tuple[Column, Column]:
    """A permutation of pairs a < size_a, b < size_b: the two are moved in turn, each by a pad of the other."""
    state = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    rounds = list(range(ROUNDS))
    sign = -1 if inverse else 1

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        moved_a = F.pmod(s["a"] + sign * draw(pad(key, kind, i, s["b"]), size_a), F.lit(size_a))
        moved_b = F.pmod(s["b"] + sign * draw(pad(key, kind, i, s["a"]), size_b), F.lit(size_b))
        return F.struct(F.when(even, moved_a).otherwise(s["a"]).alias("a"), F.when(even, s["b"]).otherwise(moved_b).alias("b"))

    out = F.aggregate(F.array(*map(F.lit, rounds[::-1] if inverse else rounds)), state, step)
    return out["a"], out["b"]


def let(value: Column, work) -> Column:
    """work(value), the value computed once wherever work uses it."""
    return F.transform(F.array(value), work)[0]


def permute_chars(text: Column, key: str, kind: str, inverse: bool = False, hexed: bool = False) -> Column:
    """A permutation of strings of one shape: digits, capitals and small letters each stay what they are, others stay; hexed:
    letters up to F.

    The first and the second half are moved in turn, each character within its kind by a pad of the other half."""
    chars = F.transform(F.split(text, ""), F.ascii)
    low = lambda c: F.when((c >= 48) & (c <= 57), 48).when((c >= 65) & (c <= 90), 65).when((c >= 97) & (c <= 122), 97)
    span = lambda c: F.when((c >= 48) & (c <= 57), 10).otherwise(6 if hexed else 26)
    half = F.floor((F.char_length(text) + 1) / 2).cast("int")
    sign = -1 if inverse else 1

    def moved(part: Column, other: Column, i: Column) -> Column:
        joined = F.concat_ws(",", other)
        seed = F.when(F.size(part) + F.size(other) > LONG, F.sha2(joined, 256)).otherwise(joined)
        eight = lambda p: F.transform(F.sequence(F.lit(0), F.lit(7)), lambda x: F.substr(p, x * 8 + 1, F.lit(8)))
        pads = let(seed, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.floor((F.size(part) + 7) / 8).cast("int")), lambda j: let(pad(key, kind, i, j, F.size(part), s), eight))))

        def shift(c: Column, p: Column) -> Column:
            base = low(c)
            return F.when(base.isNull(), c).otherwise(base + F.pmod(c - base + sign * F.conv(p, 16, 10).cast("long"), span(c))).cast("int")

        return F.zip_with(part, F.slice(pads, 1, F.size(part)), shift)

    state = F.struct(F.slice(chars, F.lit(1), half).alias("a"), F.slice(chars, half + 1, F.char_length(text)).alias("b"))

    def step(s: Column, i: Column) -> Column:
        even = F.pmod(i, F.lit(2)) == 0
        a, b = s["a"], s["b"]
        return F.struct(F.when(even, moved(a, b, i)).otherwise(a).alias("a"), F.when(even, b).otherwise(moved(b, a, i)).alias("b"))

    rounds = list(range(ROUNDS))
    out = F.aggregate(F.array(*map(F.lit, rounds[::-1] if inverse else rounds)), state, step, lambda s: F.concat(s["a"], s["b"]))
    return F.array_join(F.transform(out, lambda c: F.chr(c)), "")


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def fill(shape: Column, chars: Column, pattern: str) -> Column:
    """The characters of `shape` that match the pattern replaced, in order, by those of `chars`."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(s: Column, c: Column) -> Column:
        take = c.rlike(pattern)
        return F.struct(F.concat(s["out"], F.when(take, F.substr(chars, s["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(take, s["at"] + 1).otherwise(s["at"]).alias("at"))

    return F.aggregate(F.split(shape, ""), start, step)["out"]


def luhn_sum(digits: Column, odd: int) -> Column:
    """Of digits from the right; those at even places from the right (from 1), or odd ones, count double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(F.pmod(i, F.lit(2)) == odd, F.pmod(number(d) * 2, F.lit(10)) + F.floor(number(d) / 5)).otherwise(number(d)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda s, d: s + d)


def luhn_valid(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits, 1), F.lit(10)) == 0


def card(m: Column, key: str, inverse: bool) -> Column:
    digits = digits_of(m)
    body = permute_chars(F.substr(digits, F.lit(1), F.char_length(digits) - 1), key, "card", inverse)
    return let(body, lambda b: fill(m, F.concat(b, F.pmod(-luhn_sum(b, 0), F.lit(10)).cast("string")), "[0-9]"))


def day_of(m: Column) -> Column:
    """The day that a date means, as days since FIRST_DAY; null for none of those years."""
    flat = F.replace(m, F.lit("/"), F.lit("."))
    day = F.when(m.rlike("^[0-9]{4}-"), F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(F.try_to_timestamp(flat, F.lit("dd.MM.yyyy"))).cast("date")
    n = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    return F.when((n >= 0) & (n < DAYS_A * DAYS_B), n)


def date(m: Column, key: str, inverse: bool) -> Column:
    n = day_of(m)
    a, b = permute_pair(F.floor(n / DAYS_B), F.pmod(n, F.lit(DAYS_B)), DAYS_A, DAYS_B, key, "date", inverse)
    to = F.date_add(F.lit(FIRST_DAY).cast("date"), (a * DAYS_B + b).cast("int"))
    mark = F.substring(m, 3, 1)
    return F.when(m.rlike("^[0-9]{4}-"), F.date_format(to, "yyyy-MM-dd")).otherwise(F.replace(F.date_format(to, "dd.MM.yyyy"), F.lit("."), mark))


def late(m: Column) -> Column:
    """A date that only makes sense with the month first."""
    return m.rlike("^[0-9]{2}/") & F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).isNotNull() & F.array_contains(F.array(*map(F.lit, LATE_DAYS)), F.substring(m, 1, 5)) & F.substring(m, 7, 4).between("1800", "2199")


def late_date(m: Column, key: str, inverse: bool) -> Column:
    """Year and day of the year are permuted; the 29th of February of a common year is permuted on."""
    days = F.array(*map(F.lit, LATE_DAYS))
    start = F.struct((number(F.substring(m, 7, 4)) - 1800).alias("a"), (F.array_position(days, F.substring(m, 1, 5)) - 1).alias("b"))

    def step(s: Column, i: Column) -> Column:
        year = s["a"] + 1800
        leap = (F.pmod(year, F.lit(4)) == 0) & ((F.pmod(year, F.lit(100)) != 0) | (F.pmod(year, F.lit(400)) == 0))
        sound = leap | (s["b"] != LATE_DAYS.index("02/29"))
        a, b = permute_pair(s["a"], s["b"], 400, len(LATE_DAYS), key, "late date", inverse)
        return F.when((i > 0) & sound, s).otherwise(F.struct(a.alias("a"), b.alias("b")))

    return let(F.aggregate(F.array(*map(F.lit, range(ROUNDABOUT))), start, step), lambda s: F.concat(F.get(days, s["b"].cast("int")), F.lit("/"), (s["a"] + 1800).cast("string")))


def address(m: Column, key: str, inverse: bool) -> Column:
    parts = F.transform(F.split(m, r"\."), number)
    a, b = permute_pair(parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], 65536, 65536, key, "address", inverse)
    return F.concat_ws(".", F.floor(a / 256), F.pmod(a, F.lit(256)), F.floor(b / 256), F.pmod(b, F.lit(256)))


def phone(m: Column, key: str, inverse: bool) -> Column:
    digits = digits_of(m)
    code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY, 0)).otherwise("")
    rest = F.substr(digits, F.char_length(code) + 1, F.char_length(digits))
    return fill(m, F.concat(code, permute_chars(rest, key, "phone", inverse)), "[0-9]")


def social(m: Column, key: str, inverse: bool) -> Column:
    """Areas 001 to 899 but 666, groups from 01, serials from 0001."""
    area = number(F.substring(m, 1, 3))
    area = area - F.when(area > 666, 2).otherwise(1)
    a, b = permute_pair(area, (number(F.substring(m, 5, 2)) - 1) * 9999 + number(F.substring(m, 8, 4)) - 1, 898, 99 * 9999, key, "social", inverse)
    wide = lambda c, n: F.lpad(c.cast("string"), n, "0")
    return F.concat_ws("-", wide(a + F.when(a >= 665, 2).otherwise(1), 3), wide(F.floor(b / 9999) + 1, 2), wide(F.pmod(b, F.lit(9999)) + 1, 4))


def mod97(text: Column) -> Column:
    """Of a string of capitals and digits, letters counting 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda s, c: F.pmod(F.when(c.rlike("[0-9]"), s * 10 + F.ascii(c) - 48).otherwise(s * 100 + F.ascii(c) - 55), F.lit(97)))


def iban_valid(m: Column) -> Column:
    """Right check digits, which are 02 to 98: one pair for each account."""
    flat = F.replace(m, F.lit(" "), F.lit(""))
    return F.substring(flat, 3, 2).between("02", "98") & (mod97(F.concat(F.substr(flat, F.lit(5), F.char_length(flat)), F.substring(flat, 1, 4))) == 1)


def iban(m: Column, key: str, inverse: bool) -> Column:
    flat = F.replace(m, F.lit(" "), F.lit(""))
    country = F.substring(flat, 1, 2)
    account = permute_chars(F.substr(flat, F.lit(5), F.char_length(flat)), key, "iban", inverse)
    check = lambda new: F.lpad((98 - mod97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0")
    return let(account, lambda new: fill(m, F.concat(country, check(new), new), "[A-Z0-9]"))


def mail(m: Column, key: str, inverse: bool) -> Column:
    marks = F.regexp_extract(m, "^[._%+-]*", 0)
    local = F.substr(F.substring_index(m, "@", 1), F.char_length(marks) + 1, F.char_length(m))
    return F.concat(marks, permute_chars(local, key, "mail", inverse), F.substr(m, F.char_length(marks) + F.char_length(local) + 1, F.char_length(m)))


ALL_HEX = "^[0-9a-fA-F]{32,}$"


def secret(m: Column, key: str, inverse: bool) -> Column:
    """A quoted secret that is no hex secret; one that would become hex is permuted on."""
    inner = F.substr(m, F.lit(2), F.char_length(m) - 2)
    once = lambda c: permute_chars(c, key, "secret", inverse)
    new = let(once(inner), lambda c: F.when(c.rlike(ALL_HEX), let(once(c), lambda d: F.when(d.rlike(ALL_HEX), once(d)).otherwise(d))).otherwise(c))
    return F.concat(F.substring(m, 1, 1), new, F.substring(m, -1, 1))


def hex_secret(m: Column, key: str, inverse: bool) -> Column:
    mark = F.regexp_extract(m, "^[\"']?", 0)
    inner = F.substr(m, F.char_length(mark) + 1, F.char_length(m) - 2 * F.char_length(mark))
    return F.concat(mark, permute_chars(inner, key, "hex", inverse, hexed=True), F.when(mark != "", F.substring(m, -1, 1)).otherwise(""))


WORK = {"hex": hex_secret, "secret": secret, "mail": mail, "date": date, "late": late_date, "address": address, "card": card, "phone": phone, "social": social, "iban": iban}


def kind_of(m: Column) -> Column:
    """The class of a candidate; null for one that is not valid."""
    size = F.char_length(digits_of(m))
    return (
        F.when(m.rlike("^[\"']?[0-9a-fA-F]{32,}[\"']?$"), "hex")
        .when(m.rlike("^[\"']"), "secret")
        .when(m.contains("@"), "mail")
        .when(m.rlike(f"^(?:{DATE})$"), F.when(day_of(m).isNotNull(), "date").when(late(m), "late"))
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.when(m.rlike(r"^(?:(?:0|[1-9][0-9]?|1[0-9]{2}|2[0-4][0-9]|25[0-5])(?:\.|$)){4}$"), "address"))
        .when(m.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), F.when(luhn_valid(digits_of(m)), "card"))
        .when(m.rlike("^[+(]"), F.when(size.between(7, 15), "phone"))
        .when(m.rlike("^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), "phone")
        .when(m.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(m.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$"), "social"))
        .when(m.rlike(f"^(?:{IBAN})$"), F.when(iban_valid(m), "iban"))
    )


def pseudonym(m: Column, key: str, inverse: bool = False) -> Column:
    """struct<text, n>: of one candidate its pseudonym and 1, or itself and 0."""

    def by_kind(kind: Column) -> Column:
        out = F.when(kind.isNull(), m)
        for name, work in WORK.items():
            out = out.when(kind == name, work(m, key, inverse))
        return F.struct(out.alias("text"), F.when(kind.isNull(), 0).otherwise(1).alias("n"))

    return let(kind_of(m), by_kind)


def treated(text: Column, key: str, inverse: bool = False) -> Column:
    """struct<text, n>: every valid candidate replaced, and their number. What stands between matches is joined with the pseudonyms;
    only lines with a HINT are searched."""

    def woven(line: Column) -> Column:
        matches = F.transform(F.regexp_extract_all(line, F.lit(f"({CANDIDATE})"), F.lit(1)), lambda m: pseudonym(m, key, inverse))

        def joined(found: Column) -> Column:
            new = F.array_join(F.zip_with(F.split(line, CANDIDATE, -1), F.concat(found["text"], F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
            return F.when(F.size(found) == 0, F.struct(line.alias("text"), F.lit(0).alias("n"))).otherwise(F.struct(new.alias("text"), F.aggregate(found["n"], F.lit(0), lambda s, n: s + n).alias("n")))

        return let(matches, joined)

    lines = F.transform(F.split(text, "\n", -1), lambda line: F.when(line.rlike(HINT), woven(line)).otherwise(F.struct(line.alias("text"), F.lit(0).alias("n"))))
    whole = let(lines, lambda x: F.struct(F.array_join(x["text"], "\n").alias("text"), F.aggregate(x["n"], F.lit(0), lambda s, n: s + n).alias("n")))
    return F.when(text.rlike(HINT), whole).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n")))


def session_key(spark: SparkSession) -> str:
    """The key of the setting, or a fresh one: then equal values are linked within this call's result only."""
    return spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)


def pseudonymized(docs: DataFrame, key: str, text_col: str = "text", inverse: bool = False) -> DataFrame:
    return docs.withColumn(text_col, treated(F.col(text_col).cast("string"), key, inverse)["text"])


def op10_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """doc_id, n_found, text."""
    key = key or session_key(docs.sparkSession)
    out = docs.select("doc_id", treated(F.col("text").cast("string"), key).alias("out"))
    return out.select("doc_id", F.coalesce(F.col("out.n"), F.lit(0)).cast("long").alias("n_found"), F.col("out.text").alias("text"))
