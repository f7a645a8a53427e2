"""Personal numbers, dates and addresses replaced by keyed pseudonyms of the same format.

A value is a list of symbols, each below a radix of its own: digits, octets, the
letters of a name, the day of a date. A Feistel network permutes such lists: each
round adds to one half a stream drawn from the key and the other half. It can be
undone with the key, keeps the format, and gives equal values equal pseudonyms
in every document. Only values that pass their check (sums, ranges, calendar) are
touched, and their pseudonyms pass it too. The stream is an HMAC; its key comes
to the rows as a scalar subquery, so no plan or event log shows it.

Lengths are those of the mail standards: 64 characters before the @, labels of
63, 127 labels. So a search takes a bounded number of steps from any position,
and texts of any length and content take time in proportion. What is longer is
not an address: of a longer run of letters and digits before an @ nothing is
touched, of a longer run with dots in it the part behind a dot that fits, and of
a domain, which stays as it is anyway, the labels that fit are looked at.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitally.llm.common import let, plain, whole_text

ROUNDS = 8
# 400 years of the calendar are 189 x 773 days, from this day on.
FIRST_DAY, DAYS = "1800-01-01", (189, 773)
LETTERS = "abcdefghijklmnopqrstuvwxyz"

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
# Patterns of values, tried in this order at each position.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63}",
    "date": r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})",
    "ip": r"(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])",
    "ssn": r"(?<!-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-)",
    "phone": r"(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
# The area code may stand in brackets or after a plus, so only its left neighbour differs.
ANY = "|".join((r"(?<![\p{L}\p{N}+])" if kind == "phone" else _EDGE) + f"(?:{p})" + _END for kind, p in PATTERNS.items())


def longs(*values: Column) -> Column:
    return F.array(*[v.cast("long") for v in values])


def digits_of(value: Column) -> Column:
    """The digits of a string as numbers."""
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]"), F.lit(0)), lambda d: d.cast("long"))


def with_digits(value: Column, digits: Column) -> Column:
    """The string with its digits replaced in order."""
    gaps = F.split(value, "[0-9]", -1)
    return F.array_join(F.zip_with(gaps, digits, lambda g, d: F.concat(g, F.coalesce(d.cast("string"), F.lit("")))), "")


def key_columns(spark: SparkSession, key: str) -> Column:
    """(inner, outer) of an HMAC with SHA-256, as a scalar subquery over one row."""
    block = key.encode()
    block = (hashlib.sha256(block).digest() if len(block) > 64 else block).ljust(64, b"\0")
    pads = [bytes(b ^ pad for b in block) for pad in (0x36, 0x5C)]
    # A local table of the driver, whose values no plan prints.
    row = pa.table({"inner": [pads[0]], "outer": [pads[1]]})
    return spark.createDataFrame(row).select(F.struct("inner", "outer").alias("pads")).scalar()


def keyed(key: Column, message: Column) -> Column:
    """The HMAC of a string, in hexadecimal digits."""
    first = F.unhex(F.sha2(F.concat(key["inner"], message.cast("binary")), 256))
    return F.sha2(F.concat(key["outer"], first), 256)


def permuted(symbols: Column, radices: Column, key: Column, kind: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """Feistel permutation of a list of symbols; `undo` gives the list back.

    A round replaces (A, B) by (B, A + stream(B)), symbol by symbol modulo its
    radix. The number of rounds is even, so both halves end where they began.
    """
    half = F.floor(F.size(symbols) / 2).cast("int")
    rest = F.size(symbols) - half
    start = F.struct(
        F.slice(symbols, F.lit(1), half).alias("a"),
        F.slice(radices, F.lit(1), half).alias("ra"),
        F.slice(symbols, half + 1, rest).alias("b"),
        F.slice(radices, half + 1, rest).alias("rb"),
    )

    def stream(round_: Column, other: Column, place: Column) -> Column:
        drawn = keyed(key, F.concat_ws("|", F.lit(kind), round_, F.array_join(other, ","), place))
        return F.conv(F.substring(drawn, 1, 12), 16, 10).cast("long")

    def forward(acc: Column, round_: Column) -> Column:
        moved = F.transform(
            acc["a"], lambda x, i: F.pmod(x + stream(round_, acc["b"], i), F.get(acc["ra"], i))
        )
        return F.struct(acc["b"].alias("a"), acc["rb"].alias("ra"), moved.alias("b"), acc["ra"].alias("rb"))

    def backward(acc: Column, round_: Column) -> Column:
        moved = F.transform(
            acc["b"], lambda x, i: F.pmod(x - stream(round_, acc["a"], i), F.get(acc["rb"], i))
        )
        return F.struct(moved.alias("a"), acc["rb"].alias("ra"), acc["a"].alias("b"), acc["ra"].alias("rb"))

    order = range(rounds)[::-1] if undo else range(rounds)
    return F.aggregate(
        F.array(*[F.lit(i) for i in order]), start, backward if undo else forward, lambda acc: F.concat(acc["a"], acc["b"])
    )


def luhn_sum(digits: Column) -> Column:
    """Luhn sum of all digits, the last one being the check digit."""

    def share(d: Column, i: Column) -> Column:
        double = d * 2
        return F.when((F.size(digits) - 1 - i) % 2 == 0, d).otherwise(F.when(double > 9, double - 9).otherwise(double))

    return F.aggregate(F.transform(digits, share), F.lit(0).cast("long"), lambda a, x: a + x)


def _card(value: Column, key: Column, undo: bool) -> Column:
    def replaced(digits: Column) -> Column:
        body = F.slice(digits, F.lit(1), F.size(digits) - 1)
        fresh = permuted(body, F.transform(body, lambda d: F.lit(10).cast("long")), key, "card", undo=undo)
        return let(fresh, lambda b: F.concat(b, longs(F.pmod(-luhn_sum(F.concat(b, longs(F.lit(0)))), F.lit(10)))))

    return let(
        digits_of(value),
        lambda d: F.when(luhn_sum(d) % 10 == 0, with_digits(value, replaced(d))),
    )


def _phone(value: Column, key: Column, undo: bool) -> Column:
    """The ten digits, the first of area and exchange from 2 to 9; a country code stays."""
    lowest, radix = [2, 0, 0, 2, 0, 0, 0, 0, 0, 0], [8, 10, 10, 8, 10, 10, 10, 10, 10, 10]

    def replaced(digits: Column) -> Column:
        skip = F.size(digits) - 10
        own = F.zip_with(F.slice(digits, skip + 1, F.lit(10)), longs(*map(F.lit, lowest)), lambda d, low: d - low)
        fresh = permuted(own, longs(*map(F.lit, radix)), key, "phone", undo=undo)
        back = F.zip_with(fresh, longs(*map(F.lit, lowest)), lambda d, low: d + low)
        return F.concat(F.slice(digits, F.lit(1), skip), back)

    return let(digits_of(value), lambda d: with_digits(value, replaced(d)))


def _numbers(value: Column) -> Column:
    return F.transform(F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), lambda d: d.cast("long"))


def _ip(value: Column, key: Column, undo: bool) -> Column:
    """Four octets of 0 to 255 without leading zeros."""
    plain = ~value.rlike(r"(^|\.)0[0-9]")
    fresh = lambda n: F.array_join(permuted(n, longs(*[F.lit(256)] * 4), key, "ip", undo=undo), ".")
    return let(_numbers(value), lambda n: F.when(plain & (F.array_max(n) < 256), fresh(n)))


def _ssn(value: Column, key: Column, undo: bool) -> Column:
    """Area 001 to 899 without 666, group 01 to 99, serial 0001 to 9999."""

    def replaced(n: Column) -> Column:
        area = F.get(n, 0)
        own = longs(area - F.when(area > 666, 2).otherwise(1), F.get(n, 1) - 1, F.get(n, 2) - 1)
        fresh = permuted(own, longs(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn", undo=undo)

        def shown(f: Column) -> Column:
            back = F.get(f, 0) + F.when(F.get(f, 0) + 1 >= 666, 2).otherwise(1)
            parts = [(back, 3), (F.get(f, 1) + 1, 2), (F.get(f, 2) + 1, 4)]
            return F.concat_ws("-", *[F.lpad(p.cast("string"), w, "0") for p, w in parts])

        return let(fresh, shown)

    valid = lambda n: F.get(n, 0).between(1, 899) & (F.get(n, 0) != 666) & (F.get(n, 1) > 0) & (F.get(n, 2) > 0)
    return let(_numbers(value), lambda n: F.when(valid(n), replaced(n)))


def _date(value: Column, key: Column, undo: bool) -> Column:
    """Year first, or last: then the middle is the month if both can be, but for slashes the first is."""
    first = F.to_date(F.lit(FIRST_DAY))

    def moved(day: Column, form: str) -> Column:
        n = F.date_diff(day, first).cast("long")
        a, b = DAYS
        own = longs(F.floor(n / b), n % b)
        fresh = permuted(own, longs(F.lit(a), F.lit(b)), key, "date", undo=undo)
        back = let(fresh, lambda f: F.get(f, 0) * b + F.get(f, 1))
        return F.when((n >= 0) & (n < a * b), F.date_format(F.date_add(first, back.cast("int")), form))

    out = F.lit(None).cast("string")
    forms = [("yyyy-MM-dd", "^....-"), ("dd.MM.yyyy", r"^..\...\."), ("dd/MM/yyyy", "^../../"), ("MM/dd/yyyy", "^../../")]
    for form, shape in forms:
        day = F.try_to_timestamp(value, F.lit(form)).cast("date")
        out = F.when(value.rlike(shape) & day.isNotNull(), moved(day, form)).otherwise(out)
    return out


def _email(value: Column, key: Column, undo: bool) -> Column:
    """Letters of the local part to letters of the same case, digits to digits; the domain stays."""
    at = F.length(F.regexp_extract(value, "^[^@]*", 0))
    local, domain = F.substring(value, F.lit(1), at), F.substring(value, at + 1, F.length(value))
    chars = F.regexp_extract_all(local, F.lit("[A-Za-z0-9]"), F.lit(0))

    def shown(fresh: Column, own: Column) -> Column:
        back = F.zip_with(
            fresh,
            own,
            lambda n, c: F.when(c.rlike("[0-9]"), n.cast("string"))
            .when(c.rlike("[a-z]"), F.substring(F.lit(LETTERS), (n + 1).cast("int"), F.lit(1)))
            .otherwise(F.substring(F.lit(LETTERS.upper()), (n + 1).cast("int"), F.lit(1))),
        )
        gaps = F.split(local, "[A-Za-z0-9]", -1)
        return F.array_join(F.zip_with(gaps, back, lambda g, c: F.concat(g, F.coalesce(c, F.lit("")))), "")

    index = lambda c: (F.call_function("instr", F.lit(LETTERS), F.lower(c)) - 1).cast("long")
    values = lambda own: F.transform(own, lambda c: F.coalesce(c.try_cast("long"), index(c)))
    radices = lambda own: F.transform(own, lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(26)).cast("long"))
    return F.concat(
        let(chars, lambda own: shown(permuted(values(own), radices(own), key, "email", undo=undo), own)), domain
    )


KINDS = {"email": _email, "date": _date, "ip": _ip, "ssn": _ssn, "phone": _phone, "card": _card}


def _named(kind: str):
    return lambda fresh: F.struct(F.when(fresh.isNotNull(), kind).alias("kind"), fresh.alias("fresh"))


def _number_of(hits: Column, kind: str) -> Column:
    return F.size(F.filter(hits, lambda hit: hit["new"]["kind"] == kind)).cast("long").alias(f"n_{kind}")


def pseudonym(value: Column, key: Column, undo: bool = False) -> Column:
    """(kind, fresh) of a value found by `ANY`; fresh is null where the check fails."""
    nothing = F.struct(F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("fresh"))
    out = nothing
    for kind in reversed(PATTERNS):
        fresh = KINDS[kind](value, key, undo)
        made = let(fresh, _named(kind))
        out = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), made).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, undo: bool = False, counts: bool = True) -> DataFrame:
    """Every row with its text rewritten, and, with `counts`, n_<kind> of the values replaced.

    A null text stays null, an empty one empty, and all other columns stay as
    they are; repeated rows are rewritten alike. An input column with the name of
    a count goes on as <name>_given. `undo` with the same key gives the original
    texts back. One narrow stage; nothing is shuffled.
    """
    rows, restored = plain(docs, ("text",))
    rows = rows.withColumn("_key", key_columns(docs.sparkSession, key))
    text = whole_text()
    found = F.transform(
        F.regexp_extract_all(text, F.lit(ANY), F.lit(0)),
        lambda v: F.struct(v.alias("old"), pseudonym(v, F.col("_key"), undo).alias("new")),
    )
    fresh = lambda hits: F.array_join(
        F.zip_with(
            F.split(text, ANY, -1), hits, lambda gap, hit: F.concat(gap, F.coalesce(hit["new"]["fresh"], hit["old"], F.lit("")))
        ),
        "",
    )
    done = F.when(
        F.rlike(text, F.lit(ANY)),
        let(found, lambda hits: F.struct(fresh(hits).alias("text"), *[_number_of(hits, kind) for kind in PATTERNS])),
    )
    names = [f"n_{k}" for k in PATTERNS]
    rewritten = rows.withColumn("_done", done).withColumn("text", F.coalesce(F.col("_done.text"), F.col("text")))
    if not counts:
        return restored(rewritten)
    given = [c for c in rows.columns if c != "text"]
    shown = {c: f"{c}_given" if c in names else c for c in docs.columns}
    columns = [F.col("text" if c == "text" else given.pop(0)).alias(shown[c]) for c in docs.columns]
    return rewritten.select(*columns, *[F.coalesce(F.col("_done")[n], F.lit(0)).alias(n) for n in names])
