"""Date parsing with day-first precedence and a two-digit-year pivot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: two-digit years below the pivot belong to the 2000s.
YEAR_PIVOT = 69
# Fixed value: month abbreviations in calendar order.
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"

_TIME = r"[ T]\d{1,2}:\d{2}(:\d{2})?$"
_EDGES = r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$"
_DAY = r"(0?[1-9]|[12][0-9]|3[01])"
_MONTH = r"(0?[1-9]|1[0-2])"
_DD, _MM = r"(0[1-9]|[12][0-9]|3[01])", r"(0[1-9]|1[0-2])"
_SEP = r"([-/.])"


def _short_years() -> list[tuple[str, str]]:
    """Two-digit years and their centuries, from the pivot."""
    tens, ones = divmod(YEAR_PIVOT, 10)
    young = rf"([0-{tens - 1}][0-9]|{tens}[0-{ones - 1}])"
    old = rf"({tens}[{ones}-9]|[{tens + 1}-9][0-9])"
    return [(young, "20"), (old, "19")]


def _rewrites() -> list[tuple[str, str]]:
    """Layouts and their ISO form, in order of precedence: day first, year first, month first."""
    out = [
        (rf"^([0-9]{{4}}){_SEP}([0-9]{{1,2}})\2([0-9]{{1,2}})$", "$1-$3-$4"),
        (rf"^{_DAY}{_SEP}{_MONTH}\2([0-9]{{4}})$", "$4-$3-$1"),
        (rf"^{_MONTH}{_SEP}{_DAY}\2([0-9]{{4}})$", "$4-$1-$3"),
    ]
    for year, century in _short_years():
        out.append((rf"^{_DAY}{_SEP}{_MONTH}\2{year}$", f"{century}$4-$3-$1"))
    for year, century in _short_years():
        out.append((rf"^{year}{_SEP}{_MONTH}\2{_DAY}$", f"{century}$1-$3-$4"))
    for year, century in _short_years():
        out.append((rf"^{_MONTH}{_SEP}{_DAY}\2{year}$", f"{century}$4-$1-$3"))
    out += [
        (rf"^([0-9]{{4}}){_MM}{_DD}$", "$1-$2-$3"),
        (rf"^{_DD}{_MM}([0-9]{{4}})$", "$3-$2-$1"),
        (rf"^{_MM}{_DD}([0-9]{{4}})$", "$3-$1-$2"),
    ]
    name = r"([a-z]{3})[a-z]*\.?"
    for year, century in [(r"([0-9]{4})", ""), *_short_years()]:
        out.append((rf"^([0-9]{{1,2}})(?:st|nd|rd|th)?[\s-]+{name}[\s,-]+{year}$", f"{century}$3-$2-$1"))
        out.append((rf"^{name}[\s-]+([0-9]{{1,2}})(?:st|nd|rd|th)?[\s,-]+{year}$", f"{century}$3-$1-$2"))
    return out


def clean_date_text(col: Column) -> Column:
    """Lower-cased date text without edge punctuation and time of day."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(col), _EDGES, ""), _TIME, ""))


def parse_clean_date(s: Column) -> Column:
    """Parse text already passed through :func:`clean_date_text`.

    A chain of rewrites: the layout that fits turns the text into ISO form, after which no other one fits. Each value
    passes the chain once, instead of failing dozens of format attempts.
    """
    for pattern, iso in _rewrites():
        s = F.regexp_replace(s, pattern, iso)
    for i in range(12):
        s = F.replace(s, F.lit(f"-{MONTHS[3 * i : 3 * i + 3]}-"), F.lit(f"-{i + 1}-"))
    # Anything that is not a full ISO date by now becomes '' and then NULL.
    return F.regexp_extract(s, r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$", 0).try_cast("date")


def parse_date(col: Column) -> Column:
    """Date of a date-like text, NULL if it is none."""
    return parse_clean_date(clean_date_text(col))


def parse_date_formats(col: Column, formats: Sequence[str]) -> Column:
    """First of the given Spark datetime patterns that fits."""
    return F.coalesce(*[F.try_to_date(col, f) for f in formats])
