"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hex digits of an md5 digest that are read as a number: 60 bits fit a bigint.
HASH_DIGITS = 15
HASH_RANGE = 1 << (4 * HASH_DIGITS)


def rank_order(score: str = "score", item: str = "contentId") -> list[Column]:
    """The one ranking rule: best rounded score first, then the item id."""
    return [F.round(F.col(score), 9).desc(), F.col(item).asc()]


def digest(*parts: Column | str) -> Column:
    """md5 of the parts joined by ``|``; the same text in any SQL engine."""
    return F.md5(F.concat_ws("|", *parts))


def digest_number(hexdigest: Column) -> Column:
    """The leading digits of an md5 digest as a bigint in [0, HASH_RANGE)."""
    return F.conv(F.substring(hexdigest, 1, HASH_DIGITS), 16, 10).cast("bigint")


def known(value: Column, default: float = 0.0) -> Column:
    """``value`` with nulls replaced."""
    return F.coalesce(value, F.lit(default))
