"""Text, amount, date and identifier functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Company suffixes that a merchant name loses.
SUFFIXES = ("PRIVATE", "LIMITED", "PVT", "LTD")
#: Lengths of a bank reference's readable fragments.
LEAST_FRAGMENT, UTR_LENGTH = 6, 16


def money(x: Column) -> Column:
    """Two decimal places, halves away from zero."""
    return F.round(x, 2).cast("decimal(18,2)")


def rate(numerator: Column, denominator: Column, places: int = 6) -> Column:
    """Halves to even; null over zero."""
    return F.bround(numerator.cast("decimal(20,4)") / F.nullif(denominator.cast("decimal(20,4)"), F.lit(0)), places).cast(f"decimal(18,{places})")


def _apart(text: Column, parse: Callable[[Column], Column]) -> Column:
    """parse(text), by itself: what is generated for a row of many columns stays small enough to be compiled."""
    return F.get(F.transform(F.array(text), parse), F.lit(0))


def parse_amount(text: Column) -> Column:
    """Plain, grouped, rupee-signed and bracketed (negative) amounts; null for anything else."""
    usual = text.rlike(r"\A-?\d{1,16}\.\d\d\z")  # most are written so, and need none of the rest
    return F.when(usual, text.try_cast("decimal(18,2)")).otherwise(_apart(text, _parse_amount))


def _parse_amount(text: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), "₹", "")
    bracketed = bare.rlike(r"^\(.*\)$")
    digits = F.regexp_replace(F.when(bracketed, F.regexp_replace(bare, r"^\(|\)$", "")).otherwise(bare), r",|^\s+|\s+$", "")
    value = money(F.when(digits.rlike(r"^-?\d+(\.\d+)?$"), digits).try_cast("decimal(38,18)"))
    return F.when(bracketed, F.when(~digits.startswith("-"), F.when(value == 0, value).otherwise(-value))).otherwise(value)


def parse_date(text: Column, day_first: bool | None = None) -> Column:
    """struct(value, ambiguous): year first, or day and month in the one order that is a date; two such dates need day_first."""
    usual = text.rlike(r"\A[1-9]\d{3}-\d\d-\d\d\z")  # most are written so, and need none of the rest
    day = F.struct(text.try_cast("date").alias("value"), F.lit(False).alias("ambiguous"))
    return F.when(usual, day).otherwise(_apart(text, lambda t: _parse_date(t, day_first)))


def _parse_date(text: Column, day_first: bool | None) -> Column:
    t = F.trim(text)
    iso = F.coalesce(F.try_to_date(F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t), "yyyy-MM-dd"), F.try_to_date(F.when(t.rlike(r"^\d{4}/\d{2}/\d{2}$"), t), "yyyy/MM/dd"))
    plain = F.when(t.rlike(r"^\d{1,2}([/-])\d{1,2}\1\d{4}$"), F.regexp_replace(t, "-", "/"))
    first, second = F.try_to_date(plain, "d/M/yyyy"), F.try_to_date(plain, "M/d/yyyy")
    if day_first is not None:
        return F.struct(F.coalesce(iso, first if day_first else second).alias("value"), F.lit(False).alias("ambiguous"))
    ambiguous = iso.isNull() & first.isNotNull() & second.isNotNull() & (first != second)
    return F.struct(F.coalesce(iso, F.when(~ambiguous | first.isNull() | second.isNull(), F.coalesce(first, second))).alias("value"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def utr(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]+", "")


def narration(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "))


def utr_candidates(text: Column) -> Column:
    """Distinct tokens of 6 to 16 characters, the longest first, then by text."""
    tokens = F.array_distinct(F.filter(F.split(narration(text), " "), lambda t: F.length(t).between(LEAST_FRAGMENT, UTR_LENGTH)))
    return F.transform(F.sort_array(F.transform(tokens, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))), lambda s: s["t"])


def merchant_name(text: Column) -> Column:
    """Without company suffixes, as words or run together, but never empty."""
    words = F.split(narration(text), " ")
    kept = F.filter(words, lambda w: ~w.isin(*SUFFIXES))
    joined = F.array_join(F.when(F.size(kept) > 0, kept).otherwise(words), "")
    return F.regexp_replace(joined, f"^(.+?)({'|'.join(SUFFIXES)})+$", "$1")


def stable_id(*parts: Column) -> Column:
    """16 hex characters of the SHA-256 of the parts joined by bars; a null counts as None."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 16)


def profile_of(customer_id: Column) -> Column:
    """Null where the customer names no profile."""
    return F.nullif(F.lower(F.regexp_extract(customer_id, "^CUST-(PROFILE_[A-Z])-", 1)), F.lit(""))


def common_prefix(a: Column, b: Column) -> Column:
    """The number of leading characters that a and b share."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, 1, i) == F.substring(b, 1, i)), i).otherwise(k))).otherwise(0)
