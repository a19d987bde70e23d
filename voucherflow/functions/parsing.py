"""Column expressions that turn untrusted cell text into typed values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherflow import schema

MONEY = "decimal(28,10)"
RATE = "decimal(9,4)"
BLANKS = " \t\n\r\f\x0b"

# Control characters dropped from cells, currency marks dropped from amounts,
# and the date layouts tried in order (ISO first, then day before month).
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MONEY_MARKS = r"(?i)inr|rs\.?|₹|,|\s|\(|\)"
DATE_LAYOUTS = ("yyyy-MM-dd", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "d MMM yyyy", "d-MMM-yyyy", "yyyy/M/d")


def trim_all(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor an empty string."""
    return F.coalesce(*[blank_to_null(c) for c in cols])


def fold_header(c: Column) -> Column:
    return F.lower(trim_all(F.regexp_replace(c, r"\s+", " ")))


def fold_space(c: Column) -> Column:
    """Lower-cased text with runs of blanks collapsed; null becomes ''."""
    return F.coalesce(fold_header(c.cast("string")), F.lit(""))


def clean_cell(c: Column, max_chars: int | None = None) -> Column:
    """Drop control characters and surrounding blanks; null tokens and empty cells become null."""
    text = trim_all(F.regexp_replace(c.cast("string"), CONTROL_CHARS, ""))
    kept = F.when((text != "") & ~F.lower(text).isin(*schema.CELL_NULLS), text)
    return F.substring(kept, 1, max_chars) if max_chars else kept


def clean_number_cell(c: Column) -> Column:
    """Text of a double; whole values below 1e15 lose the trailing '.0'."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(F.isnan(c), None).when(whole, c.cast("bigint").cast("string")).otherwise(c.cast("string"))


def clean_field(c: Column) -> Column:
    """Rule-engine cleaning: trimmed text, '' for missing values and null tokens."""
    text = trim_all(c.cast("string"))
    return F.coalesce(F.when(~F.lower(text).isin(*schema.FIELD_NULLS), text), F.lit(""))


def is_filled(c: Column) -> Column:
    return clean_field(c) != ""


def money_text(c: Column) -> Column:
    """Canonical text of an amount: marks removed, parentheses mean negative, '' and '-' mean no amount."""
    raw = trim_all(c.cast("string"))
    bare = F.regexp_replace(raw, MONEY_MARKS, "")
    negative = raw.startswith("(") & raw.endswith(")")
    signed = F.when(negative & bare.startswith("-"), bare.substr(F.lit(2), F.length(bare))) \
        .when(negative, F.concat(F.lit("-"), bare)).otherwise(bare)
    return F.when(~bare.isin("", "-"), signed)


def parse_money(c: Column) -> Column:
    return money_text(c).try_cast(MONEY)


def rate_text(c: Column) -> Column:
    return money_text(F.regexp_replace(trim_all(c.cast("string")), r"%+\s*$", ""))


def parse_rate(c: Column) -> Column:
    return rate_text(c).try_cast(RATE)


def parse_date(c: Column) -> Column:
    text = trim_all(c.cast("string"))
    return F.coalesce(*[F.try_to_date(text, layout) for layout in DATE_LAYOUTS])


def parse_code(c: Column) -> Column:
    """GSTINs and the like: no blanks anywhere, upper case."""
    return F.upper(F.regexp_replace(c.cast("string"), r"\s", ""))


def is_bad_amount(c: Column) -> Column:
    text = money_text(c)
    return text.isNotNull() & text.try_cast(MONEY).isNull()


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions) if conditions else F.lit(True)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def flag(c: Column) -> Column:
    """A predicate with null read as false."""
    return F.coalesce(c, F.lit(False))
