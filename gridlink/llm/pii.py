"""Operator 5: format-preserving Feistel pseudonyms, in DataFrame expressions alone.

A single pattern finds candidates; each number or date is validated (Luhn sum, octets, calendar, number ranges), e-mail
addresses, phone numbers and secrets by their form alone, and then permuted within its own format by a keyed Feistel
network, so equal values keep equal pseudonyms across documents, different ones never share one, and the key's holder
can turn them back (`invert`). Card numbers keep a right check digit, addresses stay addresses, dates stay dates, a date
that only reads month first stays one. Candidates that don't validate stay as they are.

Numbers and dates: two halves with moduli a and b, whose product is the number of values in the format; each round adds
a SHA-256 value of the one to the other. Strings: each round shifts every letter or digit of one half within its class;
values of any length are permuted whole. No row moves and nothing is gathered.

The key is the session's setting `spark.gridlink.pii.key`. Where it is unset the query warns and takes a key that anyone
can read here: enough for tests, not for real data.

Defined cases: a null text stays null with no finding; empty and very long texts and texts without a finding come back
unchanged; null doc_ids and repeated rows give one row each, alike; an empty table gives an empty result; a date that
fits two orders is read day first; dates outside 1800-01-01 to 2238-01-25 (month first: to 2237-03) are left alone, as
are octets with leading zeros. Only the named columns are read, so further columns can't clash.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlink.llm.common import table

KEY, ROUNDS = "gridlink-demo-key", 8
KEY_SETTING = "spark.gridlink.pii.key"
#: The number of days is DAYS squared; of days after the twelfth of a month, LATE squared.
DAYS, LATE = 400, 311
#: In the order in which they are tried. secret: what stands before the value is kept.
KINDS = {
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    "secret": r"\b(?:AKIA[0-9A-Z]{16}\b|(?:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?[^\s\"']{6,})",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/.])\d{2}/\d{2}/\d{4}(?![\d/])|(?<![\d/.])\d{2}\.\d{2}\.\d{4}(?!\d|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}(?: \d{4}){3}|\d{4}(?:-\d{4}){3}|\d{13,19})(?!\d)",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{2,4}\)?[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)",
}
PATTERN = "|".join(KINDS.values())
#: Each kind needs one of these; most texts have none and are done with this look.
_QUICK = "[@0-9=:]|AKIA"
_SECRET_HEAD = r"^(?:\w{5,8}\s{0,3}[=:]\s{0,3}[\"']?|AKIA)"


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often the body, or a lambda in it, names it."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, kind: str, i: Column, value: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), value.cast("string")), 256)


def _order(invert: bool) -> Column:
    return F.sequence(F.lit(ROUNDS), F.lit(1), F.lit(-1)) if invert else F.sequence(F.lit(1), F.lit(ROUNDS))


def permute_numbers(left: Column, right: Column, a: int, b: int, kind: str, key: str, invert: bool) -> Column:
    """struct(l, r) of a keyed permutation of the pairs below a and b."""
    sign = -1 if invert else 1

    def value(i: Column, x: Column, m: int) -> Column:
        return F.pmod(F.conv(F.substring(_hash(key, kind, i, x), 1, 12), 16, 10).cast("long"), F.lit(m))

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, F.pmod(acc["l"] + sign * value(i, acc["r"], a), F.lit(a))).otherwise(acc["l"]).alias("l"),
            F.when(odd, acc["r"]).otherwise(F.pmod(acc["r"] + sign * value(i, acc["l"], b), F.lit(b))).alias("r"),
        )

    return F.aggregate(_order(invert), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def permute_text(s: Column, kind: str, key: str, invert: bool) -> Column:
    """A keyed permutation of strings that keeps each character's class: digit, a-f, g-z, A-Z, or itself. So hexadecimal
    strings stay such, and no others become some."""
    sign = -1 if invert else 1

    def shifted(half: Column, seed: Column) -> Column:
        def one(c: Column, i: Column, stream: Column) -> Column:
            by = sign * F.conv(F.substr(F.get(stream, F.shiftright(i, 5)), 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
            code = F.ascii(c)
            turned = lambda first, n: F.chr(first + F.pmod(code - first + by, F.lit(n)))
            return F.when(c.between("0", "9"), turned(48, 10)).when(c.between("a", "f"), turned(97, 6)).when(c.between("g", "z"), turned(103, 20)).when(c.between("A", "Z"), turned(65, 26)).otherwise(c)

        # a hash of its own for every 32 characters, so that the shifts don't repeat within a long half
        stream = F.transform(F.sequence(F.lit(0), F.floor(F.length(half) / 32).cast("int")), lambda j: F.when(j == 0, seed).otherwise(F.sha2(F.concat_ws("|", seed, j.cast("string")), 256)))
        out = let(stream, lambda h: F.array_join(F.transform(F.split(half, ""), lambda c, i: one(c, i, h)), ""))
        return F.when(F.length(half) == 0, "").otherwise(out)

    def step(acc: Column, i: Column) -> Column:
        odd = i % 2 == 1
        return F.struct(
            F.when(odd, let(_hash(key, kind, i, acc["r"]), lambda h: shifted(acc["l"], h))).otherwise(acc["l"]).alias("l"),
            F.when(odd, acc["r"]).otherwise(let(_hash(key, kind, i, acc["l"]), lambda h: shifted(acc["r"], h))).alias("r"),
        )

    half = F.floor(F.length(s) / 2).cast("int")
    out = F.aggregate(_order(invert), F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1, F.length(s)).alias("r")), step)
    return let(out, lambda x: F.concat(x["l"], x["r"]))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _refill(form: Column, digits: Column) -> Column:
    """form with its digits replaced by others, in order."""
    def one(i: Column) -> Column:
        c = F.substr(form, i, F.lit(1))
        return F.when(c.between("0", "9"), F.substr(digits, F.length(_digits(F.substr(form, F.lit(1), i))), F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), one), "")


def _luhn(digits: Column, shift: int) -> Column:
    """Luhn sum; shift 0: the last digit counts once, 1: twice."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, n - i + 1, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when((i + shift) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _card(s: Column, key: str, invert: bool) -> Column:
    def renewed(digits: Column) -> Column:
        body = permute_text(F.substr(digits, F.lit(1), F.length(digits) - 1), "card", key, invert)
        new = let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(b, 1) % 10, F.lit(10)).cast("string")))
        return F.when(_luhn(digits, 0) % 10 == 0, let(new, lambda n: _refill(s, n))).otherwise(s)

    return let(_digits(s), renewed)


def _ip(s: Column, key: str, invert: bool) -> Column:
    part = [F.split(s, r"\.")[i].cast("int") for i in range(4)]
    out = permute_numbers(part[0] * 256 + part[1], part[2] * 256 + part[3], 1 << 16, 1 << 16, "ip", key, invert)
    def written(x: Column) -> Column:
        octets = [F.floor(x["l"] / 256), x["l"] % 256, F.floor(x["r"] / 256), x["r"] % 256]
        return F.concat_ws(".", *(o.cast("string") for o in octets))

    return F.when((F.greatest(*part) <= 255) & ~s.rlike(r"(?:^|\.)0\d"), let(out, written)).otherwise(s)


def _epoch() -> Column:
    return F.lit("1800-01-01").cast("date")


def _any_day(date: Column, key: str, invert: bool) -> Column:
    """The date's pseudonym among all days of the range, or null beyond it."""
    day = F.datediff(date, _epoch())
    new = permute_numbers(F.floor(day / DAYS), day % DAYS, DAYS, DAYS, "date", key, invert)
    moved = F.date_add(_epoch(), let(new, lambda x: x["l"] * DAYS + x["r"]).cast("int"))
    return F.when((day >= 0) & (day < DAYS * DAYS), moved)


def _late_day(date: Column, key: str, invert: bool) -> Column:
    """The same among days after the twelfth of a month, counted on from the range's first: these can't be read as months."""
    month = (F.year(date) - 1800) * 12 + F.month(date) - 1
    place = F.datediff(date, _epoch()) - 12 * month - 12
    new = permute_numbers(F.floor(place / LATE), place % LATE, LATE, LATE, "late", key, invert)

    def start(month: Column) -> Column:  # of a month in this count; months have 18.436875 such days on average
        return F.datediff(F.add_months(_epoch(), month), _epoch()) - 12 * month

    def dated(n: Column) -> Column:
        near = F.floor(n / 18.436875).cast("int")
        at = F.when(start(near + 1) <= n, near + 1).when(start(near) <= n, near).otherwise(near - 1)
        return let(at, lambda m: F.date_add(F.add_months(_epoch(), m), (n - start(m)).cast("int") + 12))

    moved = let(let(new, lambda x: x["l"] * LATE + x["r"]), dated)
    return F.when((place >= 0) & (place < LATE * LATE), moved)


def _moved(s: Column, form: str, permuted, key: str, invert: bool) -> Column:
    return let(F.try_to_timestamp(s, F.lit(form)).cast("date"), lambda d: permuted(d, key, invert))


def _date(s: Column, key: str, invert: bool) -> Column:
    out = s
    for sep, form, permuted in reversed(_DATES):
        there = F.contains(s, F.lit(sep)) & F.try_to_timestamp(s, F.lit(form)).isNotNull()
        out = F.when(there, F.coalesce(F.date_format(_moved(s, form, permuted, key, invert), form), s)).otherwise(out)
    return out


_DATES = (("-", "yyyy-MM-dd", _any_day), ("/", "dd/MM/yyyy", _any_day), ("/", "MM/dd/yyyy", _late_day), (".", "dd.MM.yyyy", _any_day))


def _ssn(s: Column, key: str, invert: bool) -> Column:
    area, group, serial = (F.split(s, "-")[i].cast("int") for i in range(3))
    good = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    place = F.when(area > 666, area - 2).otherwise(area - 1)
    out = permute_numbers(place * 99 + group - 1, serial - 1, 898 * 99, 9999, "ssn", key, invert)

    def written(x: Column) -> Column:
        first = F.floor(x["l"] / 99)
        return F.format_string("%03d-%02d-%04d", F.when(first >= 665, first + 2).otherwise(first + 1), x["l"] % 99 + 1, x["r"] + 1)

    return F.when(good, let(out, written)).otherwise(s)


def _phone(s: Column, key: str, invert: bool) -> Column:
    head = F.regexp_extract(s, r"^\+\d", 0)
    rest = F.substr(s, F.length(head) + 1, F.length(s))
    return F.concat(head, let(permute_text(_digits(rest), "phone", key, invert), lambda d: _refill(rest, d)))


def _email(s: Column, key: str, invert: bool) -> Column:
    at = F.locate("@", s)
    return F.concat(permute_text(F.substr(s, F.lit(1), at - 1), "email", key, invert), F.substr(s, at, F.length(s)))


def _secret(s: Column, key: str, invert: bool) -> Column:
    head = F.regexp_extract(s, _SECRET_HEAD, 0)
    value = F.substr(s, F.length(head) + 1, F.length(s))
    return F.concat(head, permute_text(value, "secret", key, invert))


_MAKERS = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}
#: Tells the kind of a hit by its own form, without what had to stand around it.
_FORMS = {
    "email": "@",
    "secret": r"^(?:AKIA[0-9A-Z]{16}$|[a-z_]{5,8}\s{0,3}[=:])",
    "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$",
    "date": r"^(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$",
    "ssn": r"^\d{3}-\d{2}-\d{4}$",
    "card": r"^\d[\d -]+$",
    "phone": r"^[+(]",
}


def kind_of(hit: Column) -> Column:
    secret_first = ["secret", *(k for k in _FORMS if k != "secret")]
    return reduce(lambda out, k: F.when(hit.rlike(_FORMS[k]), k).otherwise(out), reversed(secret_first), F.lit(None).cast("string"))


def pseudonym(hit: Column, key: str = KEY, invert: bool = False) -> Column:
    """The hit's pseudonym within its format, or the hit itself where it doesn't validate."""
    return let(kind_of(hit), lambda kind: reduce(lambda out, k: F.when(kind == k, _MAKERS[k](hit, key, invert)).otherwise(out), _MAKERS, hit))


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, invert: bool = False) -> DataFrame:
    """docs with text_col pseudonymised; all other columns stay."""
    text = F.col(text_col).cast("string")
    hits = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))
    parts = F.arrays_zip(F.split(text, PATTERN, -1).alias("part"), hits.alias("hit"))
    new = F.array_join(F.transform(parts, lambda x: F.concat(x["part"], F.coalesce(pseudonym(x["hit"], key, invert), F.lit("")))), "")
    return docs.withColumn(text_col, F.when(text.rlike(_QUICK), new).otherwise(text))


def key_of(spark: SparkSession) -> str:
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is unset: pseudonyms are made with a key that is no secret", stacklevel=2)
    return key or KEY


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, and the number of candidates found."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    docs = docs.withColumn("n_found", F.when(F.col("text").rlike(_QUICK), F.regexp_count("text", F.lit(PATTERN))).otherwise(0))
    return pseudonymise(docs, key=key_of(spark))


QUERIES = {"op5_pii": op5_pii}
ORACLES: dict[str, str] = {}
