"""Money and number parsing. Unparsable text gives NULL, never zero and never an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.schemas import MONEY


def _to_money(col: Column) -> Column:
    return col.try_cast(MONEY)


def _digits(col: Column) -> Column:
    return F.regexp_replace(col, r"[^0-9.,\-]", "")


def parse_digits(s: Column) -> Column:
    """Amount from text that already holds only digits, separators and a sign."""
    # translate(',.' -> '.') turns the comma into a point and drops the points that grouped thousands.
    return _to_money(F.when(F.rlike(s, F.lit(r",[^.]*$")), F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", "")))


def parse_amount(col: Column) -> Column:
    """Amount in US or EU notation: the separator that comes last is the decimal one, a lone comma is decimal."""
    return parse_digits(_digits(col))


def parse_amount_grouped(col: Column) -> Column:
    """As :func:`parse_amount`, but a lone comma before exactly three digits groups thousands."""
    s = _digits(col)
    grouped = ~F.contains(s, F.lit(".")) & F.rlike(s, F.lit(r",[0-9]{3}([^0-9]|$)"))
    return _to_money(
        F.when(grouped, F.translate(s, ",", ""))
        .when(F.rlike(s, F.lit(r",[^.]*$")), F.translate(s, ",.", "."))
        .otherwise(F.translate(s, ",", ""))
    )


def parse_amount_signed(col: Column) -> Column:
    """As :func:`parse_amount`, with accounting brackets or a minus sign meaning a negative amount."""
    value = parse_amount(col)
    bracketed = F.rlike(col, F.lit(r"^\s*\(.*\)\s*$"))
    return F.when(bracketed, -F.abs(value)).otherwise(value)


def all_numbers(col: Column) -> Column:
    """Every number of a text in order, decimal commas read as points, as an array of doubles."""
    found = F.regexp_extract_all(col, F.lit(r"[-+]?[0-9]+(?:[.,][0-9]+)?"), F.lit(0))
    return F.transform(found, lambda n: F.translate(n, ",", ".").try_cast("double"))


def near_rel(a: Column, b: Column, tol: float = 0.01) -> Column:
    """|a-b| within ``tol`` of the larger magnitude; two zeros are equal; missing values are unequal."""
    biggest = F.greatest(F.abs(a), F.abs(b))
    # Compare products instead of quotients: exact in decimals and free of division by zero.
    return F.coalesce(F.abs(a - b) <= biggest * F.lit(tol).cast("decimal(9,6)"), F.lit(False))
