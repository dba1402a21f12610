"""Value tables of the scalar functions."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.functions import amounts, checks, dates, language, text as tx
from docledger.functions.currency import currency
from docledger.functions.regexes import required_word


def values(spark, rows, fn, schema="v STRING"):
    df = spark.createDataFrame([(r,) for r in rows], schema).coalesce(1)
    return [r[0] for r in df.select(fn(F.col("v"))).collect()]


DAY = dt.date(2023, 10, 15)
DATE_TABLE = {
    "15/10/2023": DAY, "15-10-2023": DAY, "15.10.2023": DAY, "15/10/23": DAY, "10/15/2023": DAY, "10-15-2023": DAY,
    "10.15.2023": DAY, "10/15/23": DAY, "2023-10-15": DAY, "2023/10/15": DAY, "2023.10.15": DAY, "15 Oct 2023": DAY,
    "15 October 2023": DAY, "Oct 15, 2023": DAY, "October 15, 2023": DAY, "15-Oct-2023": DAY, "15-October-2023": DAY,
    "15102023": DAY, "20231015": DAY, "15th October 2023": DAY, "Oct-15-2023": DAY, "2023-10-15 08:30:00": DAY,
    " (15.10.2023) ": DAY, "15 Oct 23": DAY,
    # Day first wins over year first where both fit.
    "23-10-15": dt.date(2015, 10, 23), "15/10/99": dt.date(1999, 10, 15), "15/10/68": dt.date(2068, 10, 15),
    "15/10/69": dt.date(1969, 10, 15), "03/04/2023": dt.date(2023, 4, 3),
    "31/02/2023": None, "2023-13-01": None, "abc": None, "": None, None: None, "2023": None,
}


def test_parse_date(spark):
    got = values(spark, list(DATE_TABLE), dates.parse_date)
    assert dict(zip(DATE_TABLE, got)) == DATE_TABLE


@pytest.mark.parametrize(
    ("fn", "table"),
    [
        (amounts.parse_amount, {
            "$1,234.56": "1234.56", "€1.234,56": "1234.56", "1234.56": "1234.56", "12,5": "12.5", "1,234": "1.234",
            "1.234.567,89": "1234567.89", "-5.00": "-5", "invalid": None, "": None, None: None, "1.2.3": None, "-": None,
        }),
        (amounts.parse_amount_grouped, {"1,234": "1234", "1,23": "1.23", "1,234,567": "1234567", "1.234,5": "1234.5", "x": None}),
        (amounts.parse_amount_signed, {"(21.84)": "-21.84", "-21.84": "-21.84", "21,84": "21.84", "(": None, "()": None}),
    ],
)
def test_amounts(spark, fn, table):
    got = values(spark, list(table), fn)
    assert got == [None if v is None else Decimal(v).quantize(Decimal("0.0001")) for v in table.values()]


def test_all_numbers(spark):
    assert values(spark, ["a 1,5 b -2 c 3.25"], amounts.all_numbers) == [[1.5, -2.0, 3.25]]


@pytest.mark.parametrize(
    ("a", "b", "equal"),
    [("100.00", "100.00", True), ("100.00", "100.99", True), ("100.00", "102.00", False), (None, "100", False), ("0", "0", True)],
)
def test_relative_equality(spark, a, b, equal):
    df = spark.createDataFrame([(a, b)], "a STRING, b STRING")
    near = amounts.near_rel(F.col("a").cast("decimal(18,4)"), F.col("b").cast("decimal(18,4)"))
    assert df.select(near).first()[0] is equal


VALID = {
    "percentage": (["50%", "0%", "100%", "23.45%", "50", "100"], ["101%", "-1%", "abc", "50%%", None]),
    "currency": (["100.00", "$100.00", "€100,00", "1,234.56", "-100.00", "100.1234", "100 EUR"], ["100.12345", "abc", "$100.00$", None]),
    "date": (["2023-01-01", "01-01-2023", "01/01/2023", "01.01.2023", "01 Jan 2023", "01 January 2023"], ["2023-13-01", "01-32-2023", "abc", "01-01-23", None]),
    "tax_id": (["ABC123456", "1234567890"], ["ABC12", "", None]),
    "phone": (["+48123456789", "123-456-7890", "(123) 456 7890", "123.456.7890"], ["123", "abc", None]),
    "email": (["test@example.com", "test.user@example.co.uk", "test_user123@example.org"],
              ["test@", "@example.com", "test@example", "test@.com", "test@example.", "test example.com", None]),
    "text": (["x"], ["", " ", None]),
}


@pytest.mark.parametrize("kind", VALID)
def test_validators(spark, kind):
    good, bad = VALID[kind]
    check = checks.Validators()
    got = values(spark, good + bad, lambda c: check.check(kind, c))
    assert got == [True] * len(good) + [False] * len(bad)


def test_tax_id_by_country(spark):
    rows = [("1234567890", "PL", True), ("123456789", "PL", False), ("12345678901", "DE", True), ("1234567890A", "DE", False), ("12345678901234", "FR", True)]
    df = spark.createDataFrame(rows, "v STRING, c STRING, ok BOOLEAN")
    assert df.filter(checks.valid_tax_id(F.col("v"), F.col("c")) != F.col("ok")).count() == 0


def test_own_validator_and_unknown_type(spark):
    v = checks.Validators().register("even", lambda c: c.cast("int") % 2 == 0)
    assert values(spark, ["2", "3"], lambda c: v.check("even", c)) == [True, False]
    assert values(spark, ["2"], lambda c: v.check("nope", c)) == [False]


def test_currency(spark):
    table = {
        "Currency: EUR $5": "EUR", "Total $5": "USD", "Total $5 CAD": "CAD", "5 €": "EUR", "5 zł": "PLN", "5 kr NOK": "NOK",
        "5 kr": "SEK", "pay 5 chf": "CHF", "nothing": None,
    }
    assert values(spark, list(table), currency) == list(table.values())


def test_filename_and_description(spark):
    assert values(spark, ["Ünïcödé: file?.pdf", "///", "a" * 300 + ".txt"], tx.clean_filename) == [
        "Unicode_file_.pdf", "untitled", "a" * 251 + ".txt",
    ]
    assert values(spark, ["AB-12  Web   design XYZ9", "Item: lamp!", None], tx.normalize_description) == ["Web design", "lamp", None]
    assert values(spark, ["2 x 1.50 Pens pcs $3.00"], tx.strip_item_noise) == ["Pens"]


def test_normalize_applies_nfkc(spark):
    assert values(spark, [" ﬁne \n  print ", None], tx.normalize_text) == ["fine print", None]


def test_markup_limits(spark):
    rows = values(spark, ["<b>", "x" * 20, None], lambda c: tx.escape_markup(c, 10))
    assert [r.escaped for r in rows] == ["&lt;b&gt;", None, ""]
    assert [r.error is None for r in rows] == [True, False, True]


def test_table_runs_reach_the_last_line(spark):
    text = "a\nx  1\ny  2\nz  3\nb\nu  1\nv  2\nw  3\nt  4"
    runs = values(spark, [text], lambda c: tx.table_runs(tx.lines(c)))[0]
    assert [(r.start, r.end) for r in runs] == [(1, 3), (5, 8)]
    assert runs[0].lines == ["x  1", "y  2", "z  3"]


def test_regions_of_few_lines(spark):
    r = values(spark, ["ab\ncd\nef"], lambda c: tx.layout_regions(tx.lines(c)))[0]
    assert (r.top, r.middle, r.bottom, r.left, r.right) == ("", "ab\ncd", "ef", "a\nc\ne", "b\nd\nf")


def test_required_word_is_conservative():
    assert required_word(r"Bill\s+To") == "bill"
    assert required_word("colou?r") == "colo"
    for p in ("a|b", "abc*", "ab{2}c", r"\d+", "(?:x)abc"):
        assert required_word(p) is None


def test_marker_words_are_counted_in_the_parts_that_may_hold_one(spark):
    words = sorted({w for ws in language.MARKERS.values() for w in ws})
    rng = random.Random(8)
    texts = ["".join(rng.choice([rng.choice(words), rng.choice(words)[: rng.randrange(1, 6)], rng.choice(" \n7.ąxé")]) for _ in range(50)) for _ in range(200)] + ["", None, "7 1.(" * 500]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, t STRING").select("i", "t", language.language_scores(F.col("t")).alias("s"), F.regexp_extract_all("t", F.lit(language._marked(words)), F.lit(0)).alias("parts"))
    for r in df.collect():
        if r.t is None:
            continue
        assert [(x.lang, x.score) for x in r.s] == [(lang, sum(r.t.count(w) for w in ws) / len(ws)) for lang, ws in language.MARKERS.items()]
        assert len(r.parts) == 0 or "(" not in r.t
