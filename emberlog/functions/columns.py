"""Column helpers that all operators share: missing values, entropy, addresses, encodings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Candidate names of the time field, first non-empty wins (fixed values).
TIME_FIELDS = ("SystemTime", "UtcTime", "TimeCreated", "timestamp", "Timestamp", "@timestamp", "time", "ts", "EventTime", "_time")


def column(name: str) -> Column:
    """A column by its name, whatever characters that holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> Column:
    """A field as text; null, '' and a column that is not there are all ''."""
    known = {c.lower(): c for c in df.columns}
    return F.coalesce(column(known[name.lower()]).cast("string"), F.lit("")) if name.lower() in known else F.lit("")


def present(column: Column) -> Column:
    return F.coalesce(column, F.lit("")) != ""


def first_of(df: DataFrame, names) -> Column:
    """The first non-empty field of several, or null."""
    return F.coalesce(*[F.nullif(field(df, n), F.lit("")) for n in names])


def event_time(df: DataFrame, names=TIME_FIELDS) -> Column:
    return F.try_to_timestamp(first_of(df, names))


def _balanced(conditions: list[Column], join) -> Column:
    """One condition of many, as a tree of small depth."""
    while len(conditions) > 1:
        pairs = [join(a, b) for a, b in zip(conditions[::2], conditions[1::2], strict=False)]
        conditions = pairs + conditions[len(pairs) * 2 :]
    return conditions[0]


def any_of(conditions: list[Column]) -> Column:
    return _balanced(conditions, lambda a, b: a | b) if conditions else F.lit(False)


def all_of(conditions: list[Column]) -> Column:
    return _balanced(conditions, lambda a, b: a & b) if conditions else F.lit(True)


def let(value: Column, then) -> Column:
    """`then` of a value that is computed once, however often `then` names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def contains_any(column: Column, words) -> Column:
    """Whether lower-case `column` holds any of the words, as one alternation."""
    import re

    return F.lower(column).rlike("|".join(re.escape(w.lower()) for w in words))


def entropy(column: Column) -> Column:
    """Shannon entropy over bytes; 0 for empty text.

    The bytes' hex pairs are sorted once; runs of equal ones are found by the places where
    the pair changes, so the work grows with the length and not with its square.
    """
    codes = F.hex(F.encode(F.coalesce(column, F.lit("")), "UTF-8"))
    pairs = F.array_sort(F.regexp_extract_all(codes, F.lit(".."), F.lit(0)))

    def of(sorted_pairs: Column) -> Column:
        size = F.size(sorted_pairs)
        ends = F.filter(F.sequence(F.lit(1), size), lambda i: (i == size) | (F.get(sorted_pairs, i) != F.get(sorted_pairs, i - 1)))
        runs = F.transform(ends, lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0))) / size)
        return F.aggregate(runs, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.when(F.octet_length(F.coalesce(column, F.lit(""))) > 0, let(pairs, of)).otherwise(F.lit(0.0))


def octets(ip: Column) -> Column:
    """Four whole numbers of a dotted quad without leading zeros, or null."""
    quad = r"^(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})\.(0|[1-9][0-9]{0,2})$"
    numbers = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("int"))
    return F.when(ip.rlike(quad) & F.forall(numbers, lambda x: x <= 255), numbers)


def ip_number(ip: Column) -> Column:
    return F.aggregate(octets(ip), F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)


def ipv6_hex(ip: Column) -> Column:
    """The 32 hex digits of an IPv6 address (without zone or dotted part), or null; their order is that of the addresses."""
    text = F.lower(ip)
    halves = F.split(text, "::", -1)
    groups = lambda t: F.filter(F.split(t, ":", -1), lambda g: g != "")
    left, right = groups(F.get(halves, F.lit(0))), F.coalesce(groups(F.get(halves, F.lit(1))), F.array().cast("array<string>"))
    short = F.contains(text, F.lit("::"))
    missing = F.lit(8) - F.size(left) - F.size(right)
    filled = F.concat(left, F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), right)
    shape = text.rlike(r"^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?)?$")
    fits = F.when(short, missing >= 1).otherwise(missing == 0)
    return F.when(shape & fits, F.array_join(F.transform(filled, lambda g: F.lpad(g, 4, "0")), ""))


def is_public_ip(ip: Column) -> Column:
    o = octets(ip)
    a, b = o[0], o[1]
    private = (a == 0) | (a == 10) | (a == 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127)) | ((o[2] == 0) & (o[3] == 0)) | (o[3] == 255)
    return F.coalesce(o.isNotNull() & ~private, F.lit(False))
