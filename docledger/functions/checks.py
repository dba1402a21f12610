"""Format checks for single field values: Column in, Boolean out, never NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from docledger.functions.amounts import parse_amount

EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9][a-zA-Z0-9.-]*\.[a-zA-Z]{2,}$"
EMAIL_PREFIX = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"

# Accepted date layouts, four-digit years only.
DATE_FORMATS = [
    "yyyy-M-d",
    "d-M-yyyy",
    "M-d-yyyy",
    "yyyy/M/d",
    "d/M/yyyy",
    "M/d/yyyy",
    "yyyy.M.d",
    "d.M.yyyy",
    "M.d.yyyy",
    "d MMM yyyy",
    "d MMMM yyyy",
]
# Digits of the tax number by country.
TAX_ID_DIGITS = {"PL": 10, "DE": 11, "FR": 14}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def valid_percentage(col: Column) -> Column:
    """0 to 100 with at most one percent sign."""
    s = F.trim(col.cast("string"))
    ok = F.rlike(s, F.lit(r"^[+-]?[0-9]+(?:\.[0-9]+)?\s*%?$"))
    return _sure(ok & F.rtrim(F.translate(s, "%", "")).try_cast("double").between(0, 100))


def valid_currency(col: Column) -> Column:
    """One optional leading or trailing currency mark around an amount with at most four decimals."""
    s = F.trim(col.cast("string"))
    mark = r"(?:[$€£¥]|[A-Z]{3})"
    number = r"[+-]?[0-9][0-9.,]*"
    shape = rf"^(?:{mark}\s*{number}|{number}\s*{mark}|{number})$"
    too_fine = F.rlike(s, F.lit(r"[.,][0-9]{5,}[^0-9]*$"))
    return _sure(F.rlike(s, F.lit(shape)) & ~too_fine & parse_amount(s).isNotNull())


def valid_date(col: Column) -> Column:
    s = col.cast("string")
    return F.coalesce(*[F.try_to_date(s, f) for f in DATE_FORMATS]).isNotNull()


def valid_tax_id(col: Column, country: Column | None = None) -> Column:
    """Country rule where there is one, otherwise at least six letters or digits."""
    s = F.regexp_replace(F.upper(col), r"[^A-Z0-9]", "")
    generic = F.length(s) >= 6
    if country is None:
        return _sure(generic)
    rule = None
    for code, digits in TAX_ID_DIGITS.items():
        test = F.rlike(s, F.lit(rf"^[0-9]{{{digits}}}$"))
        cond = F.upper(country) == code
        rule = F.when(cond, test) if rule is None else rule.when(cond, test)
    return _sure(rule.otherwise(generic))


def valid_phone(col: Column) -> Column:
    """Optional plus sign and 8 to 15 digits once blanks, dashes, dots and brackets are removed."""
    return _sure(F.rlike(F.regexp_replace(col, r"[\s().\-]", ""), F.lit(r"^\+?[0-9]{8,15}$")))


def valid_email(col: Column) -> Column:
    return _sure(F.rlike(col, F.lit(EMAIL)))


def valid_text(col: Column) -> Column:
    return _sure(F.trim(col) != "")


_BUILTIN: dict[str, Callable[[Column], Column]] = {
    "percentage": valid_percentage,
    "currency": valid_currency,
    "date": valid_date,
    "tax_id": valid_tax_id,
    "phone": valid_phone,
    "email": valid_email,
    "text": valid_text,
}


class Validators:
    """Field-type registry: built-in checks plus the caller's own."""

    def __init__(self) -> None:
        self._checks = dict(_BUILTIN)

    def register(self, field_type: str, check: Callable[[Column], Column]) -> "Validators":
        """Add or override a type. ``check`` builds a Column; a ``pandas_udf`` serves for Python predicates."""
        self._checks[field_type] = check
        return self

    def known(self, field_type: str) -> bool:
        return field_type in self._checks

    def check(self, field_type: str, col: Column) -> Column:
        """Boolean column; an unknown type is never valid."""
        if field_type not in self._checks:
            return F.lit(False)
        return _sure(self._checks[field_type](col))
