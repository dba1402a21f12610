"""The tests before a pattern lose no match: guarded patterns find what the plain ones find."""

import random

from pyspark.sql import functions as F

from docledger.functions import regexes as rx
from docledger.operators import fields, langpacks, rules
from docledger.sources.ledger import Ledger


def _patterns() -> list[str]:
    tables = [v for k, v in vars(fields).items() if k.endswith("_PATTERNS")]
    blocks = [fields.SELLER_BLOCK, fields.BUYER_BLOCK, fields.TAX_ID, fields.REGISTRATION, fields.PHONE, fields.MAIL, fields.ANY_DATE]
    packs = [rx.any_case(p) for pack in langpacks.PACKS.values() for ps in pack.values() for p in ps]
    return sorted({*(p for t in tables for p in t), *blocks, *packs, *(r.regex for r in rules.RULE_CATALOGUE)})


def test_guarded_patterns_find_what_plain_ones_find(spark, data):
    draw = random.Random(7)
    texts = [r["text"] for r in Ledger(spark, data).documents.select("text").limit(60).collect()]
    # Texts cut, joined, in other case and with blanks in odd places, so that labels stand at every border.
    odd = [None, "", "total", "TOTAL 5", "Konto 7", "İban: X", "ſubtotal: 5", "invoice\nnumber: A1", "net 30", "No. 7"]
    for t in texts:
        a = draw.randrange(len(t))
        odd += [t, t[a:], t.upper(), t[a:].swapcase() + t[:a], t.replace(" ", " \n", 5), t.replace(": ", "\t:", 9)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "id int, text string").cache()
    ps = _patterns()
    assert sum(bool(rx.words_of(p)) for p in ps) > len(ps) * 0.8 and sum(rx.quick(p) != p for p in ps) > len(ps) * 0.8
    for at in range(0, len(ps), 60):
        some = ps[at : at + 60]
        plain = [F.coalesce(F.nullif(F.trim(F.regexp_extract("text", p, 1), F.lit(rx.WHITESPACE)), F.lit("")), F.lit("-")) for p in some if "(" in p.replace("(?", "")]
        grouped = [p for p in some if "(" in p.replace("(?", "")]
        for name in ("text", F.col("text")):
            quick = [F.coalesce(rx.group(name, p), F.lit("-")) for p in grouped]
            wrong = [F.count_if(a != b).alias(f"c{i}") for i, (a, b) in enumerate(zip(plain, quick, strict=True))]
            row = docs.agg(*wrong).first()
            assert [grouped[i] for i, n in enumerate(row) if n] == []
        hits = docs.agg(*(F.count_if(~F.rlike("text", F.lit(p)).eqNullSafe(rx.found(F.col("text"), p))).alias(f"h{i}") for i, p in enumerate(some))).first()
        assert [some[i] for i, n in enumerate(hits) if n] == []


def test_tests_before_a_pattern():
    assert rx.words_of(r"(?i)\b(?:net\s+total|sub-?total)\b") == ("total",)
    assert rx.quick(r"(?i)\bdue\b") == r"(?i)(?=[\x{64}])\bdue\b"
    # Nothing is known of what may be empty, of Unicode case, and of what only Java reads.
    for p in (r"(?:total)?", r"(?iu)total", r"\p{L}total", r"[a-z&&[^b]]total", r"total|[0-9]*"):
        assert rx.quick(p) == p and (p[:2] != "(?" or not rx.words_of(p))
