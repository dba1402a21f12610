"""Rows that any operator has to bear, and plain versions of what the contracts say."""

import re
import zlib

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, spans int, lang_pred string, fp int, stats int, n_words string, part string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def hostile(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names operators use."""
    long_text = "The quick brown fox, " * 20_000
    rows = [(1, "Hello it's A TEST 123", "en", "s", 5), (None, "Bonjour le monde", "fr", None, None), (3, None, None, None, None), (4, "", "en", "s", 0), (5, long_text, "en", "s", 1)]
    rows += [(6, "same text here", "en", "s", 1)] * 3 + [(6, "other text here", None, "s", 1), (7, "same text here", "en", "s", 1), (8, " \n\t ", "de", "s", 1), (9, "🙂 中文 ½ \x00 \x1c é", "zh", "s", 1), (10, "a" * 50_000, "en", "s", 1)]
    return spark.createDataFrame([(*r, 0.5, "x", 7, "q", 3, 2, "w", "p") for r in rows], COLUMNS)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)
