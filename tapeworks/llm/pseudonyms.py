"""Format-preserving pseudonyms for validated numbers and dates.

Found and validated: payment cards (13-19 digits, bare or in the usual groups,
Luhn check), phone numbers, social security numbers (no reserved area, group or
serial), IPv4 addresses (octets up to 255, no leading zeros) and calendar dates
from 1800 to 2199 (yyyy-mm-dd, mm/dd/yyyy or else dd/mm/yyyy, dd.mm.yyyy).  What
fails validation stays as it is.

A value becomes two numbers l < m and r < n with m * n the exact number of valid
values, and ``ROUNDS`` rounds of a Feistel network add to one half a keyed SHA-256
of the other: a permutation of the format's valid values, so nothing is cut off
and no walking is needed (a 400-year cycle has 146097 = 189 * 773 days; a card
permutes its digits but for the check digit, which is computed anew).  The same
value gives the same pseudonym in every document, and a date in every format,
without any state; ``undo=True`` runs the rounds backwards.

A scan and built-in functions only: no shuffle, no state, any key skew.

Defined cases: null text stays null, empty text empty; texts of any length are
taken whole; values that touch a letter or digit on either side are no values;
repeated rows repeat; an empty table gives no rows; other columns are not read
(``replace`` works on one column and leaves all others).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeworks.llm.common import table
from tapeworks.llm.registry import query

ROUNDS = 10
KEY = "tapeworks"  # stands for the secret that a deployment passes in
CARD = r"\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}"
PHONE = r"(?:\+1[ -])?\(\d{3}\) \d{3}-\d{4}|(?:\+1[ -])?\d{3}-\d{3}-\d{4}"
SSN = r"\d{3}-\d{2}-\d{4}"
DATE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
VALUE = rf"(?=[0-9+(])(?<![0-9A-Za-z])(?<!\d[.])(?:{PHONE}|{SSN}|{DATE}|{IPV4}|{CARD})(?![0-9A-Za-z])(?![.]\d)"
EPOCH = "1800-01-01"
DAYS = (189, 773)
SSNS = (898 * 99, 9999)


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), then)[0]


def feistel(kind: str, l: Column, r: Column, m: Column | int, n: Column | int, key: str, undo: bool) -> Column:
    """struct(l, r) after the rounds; even rounds change l, odd ones r."""
    m, n = (x if isinstance(x, Column) else F.lit(x) for x in (m, n))
    m, n = m.cast("bigint"), n.cast("bigint")

    def step(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        other = F.when(even, s["r"]).otherwise(s["l"])
        code = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), m.cast("string"), n.cast("string"), i.cast("string"), other.cast("string")), 256)
        f = F.conv(F.substring(code, 1, 15), 16, 10).cast("bigint")
        f = -f if undo else f
        return F.struct(
            F.when(even, F.pmod(s["l"] + F.pmod(f, m), m)).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(F.pmod(s["r"] + F.pmod(f, n), n)).alias("r")
        )

    order = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(i) for i in order]), F.struct(l.cast("bigint").alias("l"), r.cast("bigint").alias("r")), step)


def digits_of(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def filled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, one by one, by ``digits``."""

    def put(s: Column, c: Column) -> Column:
        digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(s["out"], F.when(digit, F.substring(s["left"], F.lit(1), F.lit(1))).otherwise(c)).alias("out"),
            F.when(digit, F.substring(s["left"], F.lit(2), F.length(s["left"]))).otherwise(s["left"]).alias("left"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("out"), digits.alias("left")), put)["out"]


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of ``digits``; shift 0 if the last one is the check digit, 1 if
    that is still to come."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when((n - i + shift) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def number(kind: str, digits: Column, key: str, undo: bool) -> Column:
    """A string of digits permuted among those of its length (at most 18)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.round(F.pow(F.lit(10.0), k)).cast("bigint")
    halves = feistel(kind, F.substring(digits, F.lit(1), a).cast("bigint"), F.substring(digits, a + 1, n - a).cast("bigint"), ten(a), ten(n - a), key, undo)
    return let(halves, lambda s: F.concat(F.lpad(s["l"].cast("string"), a, F.lit("0")), F.lpad(s["r"].cast("string"), n - a, F.lit("0"))))


def card(v: Column, key: str, undo: bool) -> Column:
    def shown(d: Column) -> Column:
        body = number("card", F.substring(d, F.lit(1), F.length(d) - 1), key, undo)
        whole = let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 1) % 10) % 10).cast("string")))
        return F.when(luhn_sum(d, 0) % 10 == 0, filled(v, whole))

    return let(digits_of(v), shown)


def phone(v: Column, key: str, undo: bool) -> Column:
    """The country code is format and stays."""
    own = let(F.regexp_replace(v, r"^\+1[ -]", ""), lambda o: filled(o, let(digits_of(o), lambda d: number("phone", d, key, undo))))
    return F.concat(F.regexp_extract(v, r"^(\+1[ -])?", 0), own)


def ssn(v: Column, key: str, undo: bool) -> Column:
    area, group, serial = (F.split_part(v, F.lit("-"), F.lit(i)).cast("bigint") for i in (1, 2, 3))
    fine = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)

    def shown(s: Column) -> Column:
        a = F.floor(s["l"] / 99) + 1
        a = a + F.when(a >= 666, 1).otherwise(0)
        return F.concat(F.lpad(a.cast("string"), 3, "0"), F.lit("-"), F.lpad((s["l"] % 99 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((s["r"] + 1).cast("string"), 4, "0"))

    return F.when(fine, let(feistel("ssn", (area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, *SSNS, key, undo), shown))


def ipv4(v: Column, key: str, undo: bool) -> Column:
    o = [F.split_part(v, F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]
    fine = (F.greatest(*o) < 256) & ~v.rlike(r"(^|\.)0\d")

    def shown(s: Column) -> Column:
        return F.concat_ws(".", F.floor(s["l"] / 256).cast("string"), (s["l"] % 256).cast("string"), F.floor(s["r"] / 256).cast("string"), (s["r"] % 256).cast("string"))

    return F.when(fine, let(feistel("ipv4", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, undo), shown))


def date(v: Column, key: str, undo: bool) -> Column:
    def as_date(fmt: str) -> Column:
        return F.try_to_timestamp(v, F.lit(fmt)).cast("date")

    def shown(day: Column, fmt: str) -> Column:
        def moved(i: Column) -> Column:
            back = let(feistel("date", F.floor(i / DAYS[1]), i % DAYS[1], *DAYS, key, undo), lambda s: F.date_add(F.lit(EPOCH).cast("date"), (s["l"] * DAYS[1] + s["r"]).cast("int")))
            return F.when((i >= 0) & (i < DAYS[0] * DAYS[1]), F.date_format(back, fmt))

        return let(F.datediff(day, F.lit(EPOCH).cast("date")).cast("bigint"), moved)

    return (
        F.when(v.contains("-"), shown(as_date("yyyy-MM-dd"), "yyyy-MM-dd"))
        .when(v.contains("."), shown(as_date("dd.MM.yyyy"), "dd.MM.yyyy"))
        .otherwise(F.coalesce(shown(as_date("MM/dd/yyyy"), "MM/dd/yyyy"), shown(as_date("dd/MM/yyyy"), "dd/MM/yyyy")))
    )


KINDS = [("phone", PHONE, phone), ("ssn", SSN, ssn), ("date", DATE, date), ("ipv4", IPV4, ipv4), ("card", CARD, card)]


def pseudonym(value: Column, key: str = KEY, undo: bool = False) -> Column:
    """The pseudonym of one value, null if it isn't a valid one."""
    out = F
    for _, pattern, form in KINDS:
        out = out.when(value.rlike(f"^(?:{pattern})$"), form(value, key, undo))
    return out


def found(text: Column) -> Column:
    """Candidate values of a text in order; one without digits isn't searched."""
    return F.when(text.rlike("[0-9]"), F.regexp_extract_all(text, F.lit(VALUE), F.lit(0)))


def woven(text: Column, values: Column, key: str = KEY, undo: bool = False) -> Column:
    """``text`` with the valid ones of its ``values`` replaced: the parts between
    values and the values are taken apart once, in order."""
    shown = F.transform(values, lambda v: F.coalesce(pseudonym(v, key, undo), v))
    parts = F.arrays_zip(F.split(text, VALUE, -1).alias("b"), shown.alias("v"))
    joined = F.array_join(F.flatten(F.transform(parts, lambda z: F.array(z["b"], F.coalesce(z["v"], F.lit(""))))), "")
    return F.when(F.size(values) > 0, joined).otherwise(text)


def replace(df: DataFrame, column: str = "text", key: str = KEY, undo: bool = False, counted: str | None = None) -> DataFrame:
    """``df`` with the values in ``column`` replaced; ``counted`` names a column
    for the number of candidates (0 for null)."""
    names = {c.lower() for c in [*df.columns, counted or ""]}
    held = "_values"
    while held in names:
        held += "_"
    # a step of its own, so that the search is done once
    out = df.withColumn(column, F.col(column).cast("string")).withColumn(held, found(F.col(column)))
    if counted:
        out = out.withColumn(counted, F.coalesce(F.when(F.col(held).isNotNull(), F.size(held)), F.lit(0)).cast("bigint"))
    return out.withColumn(column, woven(F.col(column), F.col(held), key, undo)).drop(held)


def linked(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, place, kind, value, pseudonym) of every valid value."""
    v = F.posexplode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(VALUE), F.lit(0))).alias("place", "value")
    kind = F
    for name, pattern, _ in KINDS:
        kind = kind.when(F.col("value").rlike(f"^(?:{pattern})$"), name)
    return docs.select("doc_id", v).select("doc_id", "place", kind.alias("kind"), "value", pseudonym(F.col("value"), key).alias("pseudonym")).where("pseudonym is not null")


@query("op6_pseudonyms")
def op6_pseudonyms(spark, sf):
    return replace(table(spark, sf, "documents").select("doc_id", "text"), counted="n_candidates")
