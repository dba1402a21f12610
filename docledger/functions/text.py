"""Text normalisation, sanitising and line-level layout, all within one row and without a shuffle."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Limits of the sanitisers.
MAX_TEXT = 1_000_000
MAX_MARKUP = 10_000
MAX_FILENAME = 255
# Words that mark a totals line.
TOTAL_WORDS = ["total", "sum", "amount", "subtotal", "tax", "vat", "net", "gross", "razem", "suma", "kwota"]
HEADER_LINES = 10
HEADER_MAX = 50
TAIL_LINES = 15
MIN_TABLE_RUN = 3

BLANK = r"^\s*$"


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


def normalize_text(col: Column, nfkc: bool = True) -> Column:
    """Whitespace runs to one space, trimmed, then NFKC.

    Spark has no Unicode normalisation, so ``nfkc=True`` costs an Arrow round trip for texts beyond ASCII; others are NULL on
    that way, and ``nfkc=False`` stays JVM-side altogether.
    """
    squeezed = F.trim(F.regexp_replace(col, r"(?U)\s+", " "))
    return F.coalesce(_nfkc(F.when(F.rlike(squeezed, F.lit(r"[^\x00-\x7F]")), squeezed)), squeezed) if nfkc else squeezed


def sanitize_text(col: Column, max_len: int | None = None) -> Column:
    """Drop control characters except newline, tab and carriage return.

    The whole text is kept unless a ``max_len`` (such as :data:`MAX_TEXT`) is asked for.
    """
    kept = col if max_len is None else F.substring(col, 1, max_len)
    return F.regexp_replace(kept, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def escape_markup(col: Column, max_len: int | None = None) -> Column:
    """Struct of the escaped text and an error. With a ``max_len`` (such as :data:`MAX_MARKUP`) longer text is refused, not cut."""
    out = col
    # Character and its entity.
    for char, entity in [("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"), ("`", "&#96;")]:
        out = F.replace(out, F.lit(char), F.lit(entity))
    too_long = F.lit(False) if max_len is None else F.length(col) > max_len
    return F.struct(
        F.when(~F.coalesce(too_long, F.lit(False)), F.coalesce(out, F.lit(""))).alias("escaped"),
        F.when(too_long, F.lit(f"longer than {max_len} characters")).alias("error"),
    )


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """ASCII folds of Latin letters, derived from their Unicode decompositions."""
    src, dst, multi = [], [], {}
    for code in range(0xA0, 0x250):
        ch = chr(code)
        base = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(base) == 1:
            src.append(ch)
            dst.append(base)
        elif len(base) > 1:
            multi[ch] = base
    return "".join(src), "".join(dst), multi


def ascii_fold(col: Column) -> Column:
    """Decompose accented Latin letters to their base and drop whatever is still not ASCII."""
    src, dst, multi = _fold_tables()
    out = F.translate(col, src, dst)
    pairs = out
    for ch, base in multi.items():
        pairs = F.replace(pairs, F.lit(ch), F.lit(base))
    out = F.when(F.rlike(out, F.lit("[" + "".join(multi) + "]")), pairs).otherwise(out)
    return F.regexp_replace(out, r"[^\x00-\x7F]", "")


def clean_filename(col: Column, max_len: int = MAX_FILENAME) -> Column:
    """Portable file name: forbidden characters to underscores, ASCII, single underscores, extension kept."""
    s = F.regexp_replace(F.regexp_replace(col, r'[<>:"/\\|?*]', "_"), r"[\x00-\x1F]", "")
    s = F.regexp_replace(ascii_fold(s), r"[_\s]+", "_")
    s = F.regexp_replace(s, r"^[_. ]+|[_. ]+$", "")
    s = F.when(s == "", F.lit("untitled")).otherwise(s)
    ext = F.regexp_extract(s, r"[^.](\.[^.]+)$", 1)
    stem = F.left(s, F.length(s) - F.length(ext))
    short = F.concat(F.left(stem, F.lit(max_len) - F.length(ext)), ext)
    return F.when(F.length(s) > max_len, short).otherwise(s)


def normalize_description(col: Column) -> Column:
    """Item description without leading and trailing codes, labels, edge punctuation and whitespace runs."""
    s = F.trim(col, F.lit(" \t\r\n"))
    s = F.regexp_replace(s, r"^[A-Z0-9-]+\s+", "")
    s = F.regexp_replace(s, r"\s+", " ")
    s = F.regexp_replace(s, r"\s+[A-Z0-9-]{3,10}$", "")
    s = F.regexp_replace(s, r"^Item:\s*", "")
    s = F.regexp_replace(s, r"^Product:\s*", "")
    s = F.regexp_replace(s, r"^Description:\s*", "")
    s = F.regexp_replace(s, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    return F.trim(s)


def strip_item_noise(col: Column) -> Column:
    """Older description cleaner: also removes "2 x 1.50" factors, unit words and prices."""
    s = F.regexp_replace(col, r"[0-9]+\s*[xX×]\s*[0-9]+(?:[.,][0-9]+)?", " ")
    s = F.regexp_replace(s, r"(?i)\b(?:pcs?|ea|units?|hrs?|hours?|kg|lbs?)\b\.?", " ")
    s = F.regexp_replace(s, r"[$€£¥]\s*[0-9]+(?:[.,][0-9]+){0,6}", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def content_hash(col: Column, algorithm: str = "sha256") -> Column:
    """Hex digest of a string or binary column."""
    if algorithm == "md5":
        return F.md5(col)
    if algorithm == "sha1":
        return F.sha1(col)
    return F.sha2(col, int(algorithm.removeprefix("sha")))


# ---- layout of one text; every function takes the array of lines made by :func:`lines`


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def is_blank(line: Column) -> Column:
    return F.rlike(line, F.lit(BLANK))


def layout_regions(arr: Column) -> Column:
    """Struct of top / middle / bottom quarters and left / right halves of the non-blank lines."""
    n = F.size(arr)
    quarter, three = F.floor(n / 4).cast("int"), F.floor(n * 3 / 4).cast("int")
    filled = F.filter(arr, lambda x: ~is_blank(x))
    half = F.lit(" \t\r\n")

    def not_blank(a: Column) -> Column:
        return F.array_join(F.filter(a, lambda x: x != ""), "\n")

    def mid(x: Column) -> Column:
        return F.floor(F.length(x) / 2).cast("int")

    left = F.transform(filled, lambda x: F.trim(F.left(x, mid(x)), half))
    right = F.transform(filled, lambda x: F.trim(F.substring(x, mid(x) + 1, F.length(x)), half))
    return F.struct(
        F.array_join(F.slice(arr, 1, quarter), "\n").alias("top"),
        F.array_join(F.slice(arr, quarter + 1, three - quarter), "\n").alias("middle"),
        F.array_join(F.slice(arr, three + 1, n - three), "\n").alias("bottom"),
        not_blank(left).alias("left"),
        not_blank(right).alias("right"),
    )


def structure_counts(arr: Column) -> Column:
    return F.struct(
        F.size(arr).alias("total_lines"),
        F.size(F.filter(arr, is_blank)).alias("empty_lines"),
    )


def numbered(arr: Column) -> Column:
    """Array of (line_no, line), numbered from 0."""
    return F.transform(arr, lambda x, i: F.struct(i.alias("line_no"), x.alias("line")))


def header_lines(arr: Column) -> Column:
    """Short non-blank lines near the start, with their numbers."""
    head = numbered(F.slice(arr, 1, HEADER_LINES))
    return F.filter(head, lambda r: ~is_blank(r["line"]) & (F.length(r["line"]) < HEADER_MAX))


def total_lines(arr: Column) -> Column:
    """Lines near the end that name a total, with their real line numbers."""
    words = F.lit("|".join(TOTAL_WORDS))
    return F.filter(
        numbered(arr),
        lambda r: (r["line_no"] >= F.size(arr) - TAIL_LINES) & F.rlike(F.lower(r["line"]), words),
    )


def is_table_line(line: Column) -> Column:
    """Two spaces, a tab, or several of one delimiter."""
    return F.rlike(line, F.lit(r"  |\t|\|[^\n]*\||:[^\n]*:|,[^\n]*,[^\n]*,"))


def table_runs(arr: Column) -> Column:
    """Maximal runs of at least three table-like lines: array of (start, end, lines).

    One pass over the flags of a row: a run ends where the next line is not table-like. No explode, no window.
    """
    flags = F.transform(arr, is_table_line)
    runs = F.aggregate(
        numbered_flags(flags),
        F.struct(
            F.lit(-1).alias("start"),
            F.array().cast("array<struct<start:int,end:int>>").alias("done"),
        ),
        lambda acc, r: F.struct(
            F.when(~r["flag"], F.lit(-1)).when(acc["start"] < 0, r["i"]).otherwise(acc["start"]).alias("start"),
            F.when(
                ~r["flag"] & (acc["start"] >= 0) & (r["i"] - acc["start"] >= MIN_TABLE_RUN),
                F.concat(
                    acc["done"],
                    F.array(F.struct(acc["start"].alias("start"), (r["i"] - 1).alias("end"))),
                ),
            )
            .otherwise(acc["done"])
            .alias("done"),
        ),
        lambda acc: acc["done"],
    )
    return F.transform(
        runs,
        lambda r: F.struct(
            r["start"].alias("start"),
            r["end"].alias("end"),
            F.slice(arr, r["start"] + 1, r["end"] - r["start"] + 1).alias("lines"),
        ),
    )


def numbered_flags(flags: Column) -> Column:
    """(i, flag) pairs with a closing false flag, so that a run reaching the last line is closed too."""
    closed = F.concat(flags, F.array(F.lit(False)))
    return F.transform(closed, lambda f, i: F.struct(i.alias("i"), f.alias("flag")))


# Signs of a table in running text: paired header words on adjacent lines, dashes, pipes.
_HEAD = r"\b(?:item|description|qty|quantity|price|amount|total)\b"


def has_table(col: Column) -> Column:
    return F.rlike(
        col,
        F.lit(rf"(?i){_HEAD}[^\n]*\n[^\n]*{_HEAD}|---[^\n]*---|\|[^\n]*\|"),
    )


def short_blanks(text: Column) -> Column:
    """Text whose runs of three or more blanks and tabs are two blanks: columns stay apart, and no pattern meets a long run."""
    return F.regexp_replace(text, "[ \\t]{3,}", "  ")
