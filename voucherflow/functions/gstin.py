"""GSTIN format and check digit as plain expressions, so they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherflow import schema


# The doubled digit with its carry added, 2v or 2v - 35, takes each of 0..35 once, so it is a place in this text. The first character stands for no digit:
# a character outside base 36 counts as minus two.
_DOUBLED = "\x00" + "".join(schema.BASE36[v // 2 if v % 2 == 0 else v // 2 + 18] for v in range(36))


def _digit(g: Column, position: int, places: str = schema.BASE36, first: int = 1) -> Column:
    return F.instr(F.lit(places), F.substring(g, position, 1)) - first


def check_digit(g: Column) -> Column:
    """Base-36 digit over the first fourteen characters, weights 1,2,1,2,…

    A weight of one never exceeds 35, so only the doubled places need carrying; one lookup does that.
    """
    total = F.lit(0)
    for position in range(1, 15):
        total = total + (_digit(g, position) if position % 2 else _digit(g, position, _DOUBLED, 2))
    return F.substring(F.lit(schema.BASE36), (F.lit(36) - total % 36) % 36 + 1, F.lit(1))


def gstin_status(g: Column, verify_checksum: bool = True) -> Column:
    status = F.when(F.coalesce(g, F.lit("")) == "", "missing").when(~g.rlike(schema.GSTIN_REGEX), "invalid_format")
    if verify_checksum:
        status = status.when(check_digit(g) != F.substring(g, 15, 1), "invalid_checksum")
    return status.otherwise("valid")
