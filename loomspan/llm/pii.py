"""Format-preserving Feistel pseudonyms, in DataFrame functions only.

A text is cut at the matches of one pattern; each match is validated (Luhn and issuer prefix, mod 97, calendar, octets, number
plan) and, if valid, replaced by a keyed permutation of the valid values of its own shape; the pieces are joined again. The
permutation is a Feistel network over Z_a x Z_b whose round function is keyed SHA-256 and whose a * b is the exact number of
such values, so that a value has the same pseudonym in every document, no two share one, and back=True gives it back. Mail
names and secrets have no numeric format: their letters and digits are shifted by a keyed digest, class by class.
"""

from __future__ import annotations

import os
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import fresh, quoted

ROUNDS = 10
#: Dates of 400 years from this one on are known.
YEAR_0, YEARS = 1800, 400
#: Where the key is read from.
KEY_SETTING, KEY_VARIABLE = "spark.loomspan.pii.secret", "LOOMSPAN_PII_KEY"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}"
SECRET = r"(?i:(?<![a-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'<>|,;]{6,}+"
VENDOR = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:gh[pousr]_|sk-|xox[bap]-)[A-Za-z0-9_-]{16,}+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]*\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IPV4 = r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)"
DATE = r"(?<![\d.])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{4}\.\d{2}\.\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?!\d)"
CARD = r"(?<!\d)\d{13,19}(?!\d)|(?<!\d)\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}(?!\d)|(?<!\d)\d{4}[ -]\d{6}[ -]\d{4,5}(?!\d)"
#: Issuer prefixes of payment cards with the lengths of their numbers (fixed values).
ISSUER = r"^(?:4(?:\d{12}|\d{15}|\d{18})|(?:5[1-5]\d{2}|222[1-9]|22[3-9]\d|2[3-6]\d{2}|27[01]\d|2720)\d{12}|3[47]\d{13}|3(?:0[0-5]|[68]\d)\d{11}|(?:6011|64[4-9]\d|65\d{2}|62\d{2})\d{12,15}|35(?:2[89]|[3-8]\d)\d{12,15}|(?:50|5[6-8]|6[37])\d{11,17})$"
KINDS = {"email": EMAIL, "secret": f"{SECRET}|{VENDOR}", "iban": IBAN, "phone": PHONE, "ssn": SSN, "ip": IPV4, "date": DATE, "card": CARD}
ANY = "|".join(KINDS.values())
#: What every match holds at least one of.
GATE = r"[0-9@=:]"


def _prf(key: Column, tweak: str, turn: Column, x: Column) -> Column:
    """Below 2**60; conv() reads hexadecimal."""
    digest = F.sha2(F.concat_ws(":", key, F.lit(tweak), turn.cast("string"), x.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(a: Column, b: Column, size_a: Column, size_b: Column, tweak: str, key: Column, back: bool = False) -> Column:
    """struct<x, y>: (a, b) permuted within range(size_a) x range(size_b), or permuted back. An even number of rounds."""
    start = F.struct(a.cast("long").alias("x"), b.cast("long").alias("y"))
    if back:
        turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1))
        size = lambda i: F.when(i % 2 == 0, size_a).otherwise(size_b).cast("long")
        return F.aggregate(turns, start, lambda s, i: F.struct(F.pmod(s["y"] - _prf(key, tweak, i, s["x"]), size(i)).alias("x"), s["x"].alias("y")))
    turns = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    size = lambda i: F.when(i % 2 == 0, size_a).otherwise(size_b).cast("long")
    return F.aggregate(turns, start, lambda s, i: F.struct(s["y"].alias("x"), F.pmod(s["x"] + _prf(key, tweak, i, s["y"]), size(i)).alias("y")))


def _let(value: Column, f) -> Column:
    """f(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _pow10(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def _pad(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _digits(d: Column, tweak: str, key: Column, back: bool) -> Column:
    """A string of 2 to 36 digits, permuted among those of its length."""
    la = F.floor(F.length(d) / 2).cast("int")
    lb = F.length(d) - la
    out = feistel(F.left(d, la), F.right(d, lb), _pow10(la), _pow10(lb), tweak, key, back)
    return _let(out, lambda s: F.concat(_pad(s["x"], la), _pad(s["y"], lb)))


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _refill(m: Column, d: Column) -> Column:
    """m with its digits replaced by those of d, one after another."""
    step = lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s["out"], F.substring(d, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i")))
    return F.aggregate(F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), step, lambda s: s["out"])


def _luhn(d: Column) -> Column:
    """Sum whose multiple of ten makes a number valid."""
    at = lambda i: F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
    add = lambda s, i: s + F.when(i % 2 == 0, at(i)).otherwise(at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add)


def _card(m: Column, key: Column, back: bool) -> Column:
    """The first four digits, which tell the issuer, stay; the body is permuted, the check digit is made anew."""
    def number(d: Column) -> Column:
        body = _digits(F.substring(d, F.lit(5), F.length(d) - 5), "card", key, back)
        return _let(F.concat(F.left(d, F.lit(4)), body), lambda b: F.concat(b, F.pmod(10 - _luhn(F.concat(b, F.lit("0"))) % 10, F.lit(10)).cast("string")))

    return _let(_only_digits(m), lambda d: F.when(d.rlike(ISSUER) & (_luhn(d) % 10 == 0), _refill(m, number(d))).otherwise(m))


def _plan_code(c: Column) -> Column:
    """Number of an area or exchange code among the 792 that start with 2 to 9 and don't end in 11; null for others."""
    x = c % 100
    return F.when((c >= 200) & (x != 11), (F.floor(c / 100) - 2) * 99 + x - (x > 11).cast("int"))


def _phone(m: Column, key: Column, back: bool) -> Column:
    """The last ten digits are permuted, a country code stays. With code 1 or none these are an area and an exchange code and
    four digits; elsewhere any that don't start with 0, and the country code doesn't either."""
    def number(d: Column) -> Column:
        code, own = F.left(d, F.length(d) - 10), F.right(d, F.lit(10))
        area, exchange = (_plan_code(F.substring(own, k, 3).cast("int")) for k in (1, 4))
        near = feistel(area, exchange * 10000 + F.right(own, F.lit(4)).cast("int"), F.lit(792), F.lit(7920000), "phone", key, back)
        show = lambda i: _pad((F.floor(i / 99) + 2) * 100 + i % 99 + (i % 99 >= 11).cast("int"), F.lit(3))
        near = _let(near, lambda s: F.concat(code, show(s["x"]), show(F.floor(s["y"] / 10000)), _pad(s["y"] % 10000, F.lit(4))))
        far = feistel(F.left(own, F.lit(5)).cast("int") - 10000, F.right(own, F.lit(5)).cast("int"), F.lit(90000), F.lit(100000), "abroad", key, back)
        far = _let(far, lambda s: F.concat(code, (s["x"] + 10000).cast("string"), _pad(s["y"], F.lit(5))))
        return F.when(code.isin("", "1"), F.when(area.isNotNull() & exchange.isNotNull(), near)).when(code.rlike("^[2-9]") & ~own.startswith("0"), far)

    return _let(_only_digits(m), lambda d: _let(number(d), lambda new: F.when(new.isNotNull(), _refill(m, new)).otherwise(m)))


def _ssn(m: Column, key: Column, back: bool) -> Column:
    """Areas 001 to 899 but 666, groups and serials not zero."""
    area, group, serial = F.substring(m, 1, 3).cast("int"), F.substring(m, 5, 2).cast("int"), F.substring(m, 8, 4).cast("int")
    ok = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    out = feistel(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), "ssn", key, back)
    show = lambda s: F.concat(_pad(F.when(s["x"] >= 665, s["x"] + 2).otherwise(s["x"] + 1), F.lit(3)), F.lit("-"), _pad(F.floor(s["y"] / 9999) + 1, F.lit(2)), F.lit("-"), _pad(s["y"] % 9999 + 1, F.lit(4)))
    return F.when(ok, _let(out, show)).otherwise(m)


def _ip(m: Column, key: Column, back: bool) -> Column:
    """Octets without leading zeros, each permuted among those with as many digits: 0-9, 10-99, 100-255."""
    octets = F.transform(F.split(m, r"\."), lambda x: F.struct(x.cast("int").alias("v"), F.when(F.length(x) == 1, 0).when(F.length(x) == 2, 10).otherwise(100).alias("low"), F.when(F.length(x) == 1, 10).when(F.length(x) == 2, 90).otherwise(156).alias("many")))

    def turn(o: Column) -> Column:
        v, low, many = ([o[k][f] for k in range(4)] for f in ("v", "low", "many"))
        out = feistel((v[0] - low[0]) * many[1] + v[1] - low[1], (v[2] - low[2]) * many[3] + v[3] - low[3], many[0] * many[1], many[2] * many[3], "ip", key, back)
        return _let(out, lambda s: F.concat_ws(".", *((x + low[k]).cast("string") for k, x in enumerate((F.floor(s["x"] / many[1]), s["x"] % many[1], F.floor(s["y"] / many[3]), s["y"] % many[3])))))

    return _let(octets, lambda o: F.when(F.forall(o, lambda x: (x["v"] >= x["low"]) & (x["v"] < x["low"] + x["many"])), turn(o)).otherwise(m))


def _iban_rest(s: Column) -> Column:
    """An IBAN without blanks, modulo 97."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.left(s, F.lit(4)))
    add = lambda r, c: F.when(c.rlike(r"^\d$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(moved, ""), F.lit(0), add)


def _iban(m: Column, key: Column, back: bool) -> Column:
    """The account's digits are permuted, its letters stay, the check digits, 02 to 98, are made anew."""
    def number(s: Column) -> Column:
        body = F.substring(s, F.lit(5), F.length(s))
        new = _refill(body, _digits(_only_digits(body), "iban", key, back))
        return _let(new, lambda b: F.concat(F.left(s, F.lit(2)), _pad(98 - _iban_rest(F.concat(F.left(s, F.lit(2)), F.lit("00"), b)), F.lit(2)), b))

    bare = F.regexp_replace(m, " ", "")
    ok = lambda s: (_iban_rest(s) == 1) & F.substring(s, 3, 2).between("02", "98") & (F.length(_only_digits(F.substring(s, F.lit(5), F.length(s)))) >= 4)
    return _let(bare, lambda s: F.when(ok(s), _refill(m, _only_digits(number(s)))).otherwise(m))


def _days(month: int, first: int, last: int) -> list[int]:
    """Days of a year, but 29 February, as month * 100 + day, whose month has at most so many digits and whose day is in the
    range; in order."""
    length = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    return [m * 100 + d for m in range(1, 10 if month == 1 else 13) for d in range(first, min(last, length[m - 1]) + 1)]


def _table(numbers: list[int]) -> Column:
    """An array of their decimal strings, a constant of the plan."""
    return F.split(F.lit(" ".join(map(str, numbers))), " ")


def _date(m: Column, key: Column, back: bool) -> Column:
    """Years 1800 to 2199. Year first; with dots day, month, year; with slashes month, day, year, or day first where the first
    number is above 12. The pseudonym has as many digits in each place and reads the same way; 29 February becomes one of
    another leap year."""
    p = F.split(m, "[-/.]")
    one, two, three = (F.element_at(p, k) for k in (1, 2, 3))
    first = F.length(one) == 4
    day_first = m.contains(".") | (one.cast("int") > 12)
    y = F.when(first, one).otherwise(three)
    mo = F.when(first | day_first, two).otherwise(one)
    d = F.when(first, three).when(day_first, one).otherwise(two)
    sep = F.regexp_extract(m, r"([-/.])", 1)
    late = ~first & day_first & (sep == "/")
    number, year = mo.cast("int") * 100 + d.cast("int"), y.cast("int") - YEAR_0

    def show(yy: Column, day: Column) -> Column:
        yy, mm, dd = yy.cast("string"), _pad(F.floor(day / 100), F.length(mo)), _pad(day % 100, F.length(d))
        return F.when(first, F.concat_ws("-", yy, mm, dd)).when(day_first, F.concat_ws("-", dd, mm, yy)).otherwise(F.concat_ws("-", mm, dd, yy))

    def among(days: list[int]) -> Column:
        table = _table(days)
        at = F.array_position(table, number.cast("string")).cast("int")
        out = feistel(year, at - 1, F.lit(YEARS), F.lit(len(days)), "date", key, back)
        return F.when(at > 0, _let(out, lambda s: show(s["x"] + YEAR_0, F.element_at(table, (s["y"] + 1).cast("int")).cast("int"))))

    leap = _table([k for k in range(YEARS) if k % 4 == 0 and (k % 100 or k == 200)])
    leap_at = F.array_position(leap, year.cast("string")).cast("int")
    by = _prf(key, "leap", F.lit(0), F.lit(0)) * (-1 if back else 1)
    leap_day = F.when(leap_at > 0, show(F.element_at(leap, (F.pmod(leap_at - 1 + by, F.lit(97)) + 1).cast("int")).cast("int") + YEAR_0, F.lit(229)))
    whole = F.when(number == 229, leap_day)
    for digits in (1, 2):
        wide = F.length(mo) == digits
        whole = whole.when(wide & late, among(_days(digits, 13, 31))).when(wide & (F.length(d) == 1), among(_days(digits, 1, 9))).when(wide, among(_days(digits, 1, 31)))
    whole = F.when(year.between(0, YEARS - 1), whole)
    return _let(whole, lambda new: F.when(new.isNotNull(), F.replace(new, F.lit("-"), sep)).otherwise(m))


def _shift(v: Column, tweak: str, key: Column, back: bool) -> Column:
    """A Feistel network over text: letters and digits of one half are shifted within their class by a keyed digest of
    the other half, four times in turn."""
    half = F.floor(F.length(v) / 2).cast("int")

    def move(s: Column, by: Column, turn: int, undo: bool) -> Column:
        digest = F.concat(*(F.sha2(F.concat_ws(":", key, F.lit(f"{tweak}{turn}{k}"), by), 512) for k in range(2)))
        amount = lambda i: F.conv(F.substring(digest, (i * 3) % 240 + 1, F.lit(3)), 16, 10).cast("int") * (-1 if undo else 1)

        def one(c: Column, i: Column) -> Column:
            code = F.ascii(c)
            new = lambda base, n: F.char((F.pmod(code - base + amount(i), F.lit(n)) + base).cast("long"))
            return F.when(c.rlike("^[0-9]$"), new(48, 10)).when(c.rlike("^[a-z]$"), new(97, 26)).when(c.rlike("^[A-Z]$"), new(65, 26)).otherwise(c)

        return F.array_join(F.transform(F.split(s, ""), one), "")

    def round_of(turn: int):
        if turn % 2 == 0:
            return lambda t: F.struct(move(t["x"], t["y"], turn, back).alias("x"), t["y"].alias("y"))
        return lambda t: F.struct(t["x"].alias("x"), move(t["y"], t["x"], turn, back).alias("y"))

    s = F.struct(F.left(v, half).alias("x"), F.right(v, F.length(v) - half).alias("y"))
    for turn in reversed(range(4)) if back else range(4):
        s = _let(s, round_of(turn))
    return _let(s, lambda t: F.concat(t["x"], t["y"]))


def _email(m: Column, key: Column, back: bool) -> Column:
    """The name is shifted, the domain stays."""
    return F.concat(_shift(F.substring_index(m, "@", 1), "mail", key, back), F.lit("@"), F.substring_index(m, "@", -1))


def _secret(m: Column, key: Column, back: bool) -> Column:
    """What follows the key word or the vendor's prefix is shifted."""
    head = F.regexp_extract(m, r"^((?i:[a-z_-]+[\"']?\s{0,3}[=:]\s{0,3}[\"']?)|AKIA|ASIA|gh[pousr]_|sk-|xox[bap]-)", 1)
    return _let(head, lambda h: F.concat(h, _shift(F.substring(m, F.length(h) + 1, F.length(m)), "secret", key, back)))


def _kind(m: Column) -> Column:
    """The first kind whose pattern matches a match as a whole."""
    out = F
    for name, pattern in KINDS.items():
        out = out.when(m.rlike(f"^(?:{pattern})$"), F.lit(name))
    return out


def pseudonym(m: Column, key: Column, back: bool = False) -> Column:
    """The pseudonym of one match; a match that isn't valid stays as it is."""
    made = {"email": _email, "secret": _secret, "iban": _iban, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "card": _card}

    def of(kind: Column) -> Column:
        out = F
        for name, f in made.items():
            out = out.when(kind == name, f(m, key, back))
        return out.otherwise(m)

    return _let(_kind(m), of)


def rewrite(text: Column, key: str, back: bool = False) -> Column:
    """struct<text, n>: the text with pseudonyms, and how many values were replaced. Null stays null, with n 0."""
    secret = F.lit(key)
    new = F.transform(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(m, secret, back).alias("new")))

    def join(found: Column) -> Column:
        rest = F.split(text, ANY, -1)
        after = F.concat(F.transform(found, lambda x: x["new"]), F.array(F.lit("")))
        whole = F.array_join(F.zip_with(rest, after, lambda r, x: F.concat(r, x)), "")
        return F.struct(whole.alias("text"), F.size(F.filter(found, lambda x: x["old"] != x["new"])).cast("long").alias("n"))

    none = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    return F.when(text.rlike(GATE), F.when(text.rlike(ANY), _let(new, join)).otherwise(none)).otherwise(none)


def key_of(spark: SparkSession) -> str:
    """The key that the settings name: spark.loomspan.pii.secret, or LOOMSPAN_PII_KEY in the driver's environment. Where neither
    is set, a random one that lives as long as the application: values are linked within it, and nobody can restore them."""
    key = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key


def pseudonymise(docs: DataFrame, key: str, back: bool = False, text: str = "text", counter: str | None = None, length: str | None = None) -> DataFrame:
    """docs with the text column rewritten; all other columns, whatever their names, and all rows stay. counter names a column
    for the number of values replaced; length one that holds the text's length and follows its change. Empty and null texts
    stay; back=True restores what the same key has replaced."""
    if not key:
        raise ValueError("a key is needed")
    done = fresh("pii", docs.columns)
    out = docs.select("*", rewrite(quoted(text), key, back).alias(done))
    own = {text: F.col(f"{done}.text")}
    if length:
        longer = F.coalesce(F.length(own[text]) - F.length(quoted(text)), F.lit(0))
        own[length] = (quoted(length) + longer).cast(docs.schema[length].dataType)
    columns = [own.get(c, quoted(c)).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col(f"{done}.n").alias(counter)] if counter else []))
