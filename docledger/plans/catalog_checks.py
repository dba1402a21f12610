"""Registered queries that validate, ground and merge: over the ledger's records and over extracted ones."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import checks as ck
from docledger.functions.regexes import explode_rows
from docledger.operators import consistency as co
from docledger.operators import grounding as gr
from docledger.operators import jsonops, langpacks, merge, rules
from docledger.operators import validate as va
from docledger.plans.ledger_sql import INV, dbl, text
from docledger.plans.registry import query
from docledger.schemas import MONEY
from docledger.sources.ledger import Ledger

AS_OF = dt.date(2000, 1, 1)


def _s(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _n(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("bigint")


def _ledger(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lg = Ledger(spark, d)
    return lg.invoices, lg.items


# ---- consistency

_NEAR = "coalesce(abs({0} - {1}) <= greatest(abs({0}), abs({1})) * {2}, false)"
_CHK = f"""{INV}, chk AS (SELECT doc_id, {_NEAR.format('total', '(subtotal + coalesce(tax_amount, 0))', '0.01')} AS total_ok, n_items > 0 AS items_ok,
    coalesce(date_diff('day', issue_date, due_date) BETWEEN 0 AND 365, true) AS dates_ok, true AS currency_ok,
    CASE WHEN subtotal IS NULL OR tax_amount IS NULL THEN false WHEN tax_rate IS NOT NULL THEN {_NEAR.format('tax_amount', '(subtotal * tax_rate / 100)', '0.01')}
      ELSE tax_amount <= subtotal * 0.3 END AS tax_ok FROM inv)"""


@query(
    "chk_all",
    f"WITH {_CHK} SELECT *, total_ok AND items_ok AND dates_ok AND currency_ok AND tax_ok AS all_ok FROM chk",
)
def chk_all(spark, d):
    return co.check_all(*_ledger(spark, d))


@query(
    "chk_summary",
    f"""WITH {_CHK} SELECT check_name, valid, count(*) AS n_docs FROM (SELECT unnest([{{'check_name': 'total_ok', 'valid': total_ok}},
        {{'check_name': 'items_ok', 'valid': items_ok}}, {{'check_name': 'dates_ok', 'valid': dates_ok}}, {{'check_name': 'currency_ok', 'valid': currency_ok}},
        {{'check_name': 'tax_ok', 'valid': tax_ok}}, {{'check_name': 'all_ok', 'valid': total_ok AND items_ok AND dates_ok AND currency_ok AND tax_ok}}], recursive := true) FROM chk) GROUP BY ALL""",
)
def chk_summary(spark, d):
    return co.check_summary(co.check_all(*_ledger(spark, d)))


@query(
    "line_total_match",
    f"WITH {INV} SELECT doc_id, n_items, n_items > 0 AND coalesce(abs(subtotal - total) <= 0.02, true) AS match FROM inv",
)
def line_total_match(spark, d):
    return co.line_total_match(*_ledger(spark, d)).select("doc_id", "n_items", "match")


@query(
    "reconcile_totals",
    f"""WITH {INV} SELECT doc_id, {dbl('subtotal')} AS subtotal, {dbl('coalesce(CASE WHEN total > 0 THEN total END, subtotal + tax_amount)')} AS total, false AS subtotal_differs,
        coalesce(n_items > 0 AND total > 0 AND subtotal + tax_amount > 0 AND NOT {_NEAR.format('total', '(subtotal + tax_amount)', '0.05')}, false) AS total_differs
        FROM inv WHERE total IS NOT NULL OR n_items > 0""",
)
def reconcile_totals(spark, d):
    r = co.reconcile_totals(*_ledger(spark, d)).filter("total is not null")
    return r.select("doc_id", F.col("subtotal").cast("double").alias("subtotal"), F.col("total").cast("double").alias("total"), "subtotal_differs", "total_differs")


@query(
    "currency_offenders",
    f"""WITH {INV} SELECT doc_id, CASE WHEN currency = 'USD' THEN '' WHEN currency = 'EUR' AND total IS NOT NULL THEN 'total'
        ELSE '' END AS offenders FROM inv""",
)
def currency_offenders(spark, d):
    inv, _ = _ledger(spark, d)
    # Every total is printed with a dollar sign, every subtotal with its code.
    shown = {
        "total": F.concat(F.lit("$"), F.col("totals.total").cast("string")),
        "subtotal": F.concat(F.col("totals.subtotal").cast("string"), F.lit(" "), F.col("currency")),
    }
    return inv.select("doc_id", F.array_join(co.currency_offenders(F.col("currency"), shown), ",").alias("offenders"))


# ---- validation

_ITEM_STATS = """lines AS (SELECT doc_id, lower(trim(description)) AS d, count(*) AS n, sum(CASE WHEN abs(amount - quantity * unit_price) > 0.01 THEN 1 ELSE 0 END) AS off FROM it GROUP BY ALL),
 st AS (SELECT doc_id, sum(off) AS off, count(*) FILTER (n > 1) AS dups FROM lines GROUP BY doc_id)"""
_B = "CAST({} AS INT)"


def _b(cond: str) -> str:
    return f"coalesce(CAST(({cond}) AS INT), 0)"


_STRICT_W = " + ".join(
    [
        _b("issue_date > DATE '2000-01-02'"), _b("issue_date < DATE '2000-01-01' - 3650"), _b("due_date - issue_date > 365"),
        _b("seller_name IS NOT NULL"), _b("buyer_name IS NOT NULL AND buyer_tax_id IS NULL"), _b("buyer_email LIKE '%@invalid'"),
        _b("subtotal + tax_amount = 0"), _b("total = 0"),
        _b("n_items > 0 AND tax_rate IS NOT NULL AND tax_amount <> 0 AND abs(tax_amount - CAST(round(subtotal * tax_rate / 100, 4) AS DECIMAL(18,4))) > 0.01"),
        "coalesce(off, 0)",
    ]
)
_STRICT = f"""{INV}, {_ITEM_STATS}, v AS (SELECT inv.doc_id, {_b('seller_name IS NULL')} + {_b('buyer_name IS NULL')} + {_b('total IS NULL AND subtotal IS NULL')} + {_b('n_items = 0')} AS e,
    {_STRICT_W} AS w, 2 + {_b('due_date IS NOT NULL')} + 4 * {_b('seller_name IS NOT NULL')} + 4 * {_b('buyer_name IS NOT NULL')} + {_b('buyer_tax_id IS NOT NULL')}
    + {_b('subtotal <> 0')} + {_b('tax_amount <> 0')} + {_b('total <> 0')} + {_b('tax_rate IS NOT NULL')} + least(n_items, 5) AS filled FROM inv LEFT JOIN st USING (doc_id))"""


@query(
    "val_strict",
    f"""WITH {_STRICT} SELECT doc_id, e = 0 AS is_valid, CAST(e AS BIGINT) AS n_errors, CAST(w AS BIGINT) AS n_warnings,
        greatest(0, least(1000, 1000 - 200 * e - 50 * w + 15 * filled)) / 1000.0::DOUBLE AS score FROM v""",
)
def val_strict(spark, d):
    v = va.validate(*_ledger(spark, d), "strict", F.lit(AS_OF))
    return v.select("doc_id", "is_valid", _n("n_errors").alias("n_errors"), _n("n_warnings").alias("n_warnings"), F.col("score"))


_COMP_W = " + ".join(
    [
        _b("issue_date > DATE '2000-01-02'"), _b("issue_date < DATE '2000-01-01' - 1825"), _b("due_date > DATE '2000-01-01' + 365"),
        _b("n_items = 0"), _b("n_items = 0 AND total > 0"), _b("subtotal > 0 AND tax_amount > subtotal * 0.5"),
        _b("abs(round(subtotal + tax_amount, 2) - round(total, 2)) > 0.01"),
        _b("status = 'F' AND account IS NOT NULL"), _b("status = 'O' AND account IS NULL"), "coalesce(off, 0)", "coalesce(dups, 0)",
    ]
)
_COMP = f"""{INV}, {_ITEM_STATS}, v AS (SELECT inv.doc_id, {_b('seller_name IS NULL')} + {_b('buyer_name IS NULL')} + {_b('total IS NULL AND subtotal IS NULL')}
    + {_b("buyer_email LIKE '%@invalid'")} AS e, {_COMP_W} AS w, 4 + {_b('seller_name IS NOT NULL')} + {_b('buyer_name IS NOT NULL')} + {_b('n_items > 0')}
    + {_b('total IS NOT NULL OR subtotal IS NOT NULL')} + {_b('due_date IS NOT NULL')} + {_b('method IS NOT NULL')} AS present FROM inv LEFT JOIN st USING (doc_id))"""


@query(
    "val_component",
    f"""WITH {_COMP} SELECT doc_id, e = 0 AS is_valid, CAST(e AS BIGINT) AS n_errors, CAST(w AS BIGINT) AS n_warnings,
        round(CAST((100 - least(50, 10 * e) - least(30, 5 * w)) * present / 1100.0 AS DOUBLE), 6) AS score FROM v""",
)
def val_component(spark, d):
    v = va.validate(*_ledger(spark, d), "component", F.lit(AS_OF))
    return v.select("doc_id", "is_valid", _n("n_errors").alias("n_errors"), _n("n_warnings").alias("n_warnings"), F.round("score", 6).alias("score"))


@query(
    "findings_strict",
    f"""WITH {_STRICT} SELECT CASE WHEN e > 0 THEN 'error' ELSE 'warning' END AS severity, sum(x) AS n_findings FROM (
        SELECT 1 AS e, sum(e) AS x FROM v UNION ALL SELECT 0, sum(w) FROM v) GROUP BY ALL""",
)
def findings_strict(spark, d):
    found = va.findings(*_ledger(spark, d), "strict", F.lit(AS_OF))
    return found.groupBy("severity").agg(F.count("*").alias("n_findings"))


@query(
    "findings_component",
    f"""WITH {_COMP} SELECT CASE WHEN e > 0 THEN 'error' ELSE 'warning' END AS severity, sum(x) AS n_findings FROM (
        SELECT 1 AS e, sum(e) AS x FROM v UNION ALL SELECT 0, sum(w) FROM v) GROUP BY ALL""",
)
def findings_component(spark, d):
    found = va.findings(*_ledger(spark, d), "component", F.lit(AS_OF))
    return found.groupBy("severity").agg(F.count("*").alias("n_findings"))


@query("findings_by_check")
def findings_by_check(spark, d):
    inv, items = _ledger(spark, d)
    both = va.findings(inv, items, ["strict", "component"], F.lit(AS_OF))
    return both.groupBy("profile", "check_name", "severity").agg(F.count("*").alias("n_findings"))


@query(
    "suggestions",
    f"WITH {INV} SELECT sum(CAST(due_date IS NULL AS INT)) AS no_due_date, sum(CAST(method IS NULL AS INT)) AS no_method FROM inv",
)
def suggestions(spark, d):
    v = va.validate(*_ledger(spark, d), "strict", F.lit(AS_OF))
    has = lambda t: F.count_if(F.array_contains("suggestions", t))
    return v.agg(
        has("Consider adding a due date for payment").alias("no_due_date"), has("Specify payment method for clarity").alias("no_method")
    )


@query("val_summary")
def val_summary(spark, d):
    return va.summary(va.validate(*_ledger(spark, d), "strict", F.lit(AS_OF))).groupBy("summary").agg(F.count("*").alias("n"))


@query("validate_quick", f"WITH {INV} SELECT doc_id, n_items > 0 AND coalesce(total <> 0, false) AS quick_ok FROM inv")
def validate_quick(spark, d):
    return va.validate_quick(*_ledger(spark, d))


@query(
    "required_present",
    f"WITH {INV} SELECT doc_id, 3 AS fields_checked, 2 + CAST(total IS NOT NULL AS INT) AS fields_valid, CAST(total IS NULL AS INT) AS fields_invalid FROM inv",
)
def required_present(spark, d):
    return va.required_present(_ledger(spark, d)[0])


@query(
    "field_formats",
    f"""WITH {INV} SELECT doc_id, coalesce(buyer_email LIKE '%@example.com', false) AS email_ok, buyer_phone IS NOT NULL AS phone_ok,
        seller_tax_id IS NOT NULL AS tax_id_ok, total IS NOT NULL AS amount_ok, true AS date_ok, tax_rate IS NOT NULL AS rate_ok,
        coalesce(buyer_tax_id IS NOT NULL, false) AS nip_ok FROM inv""",
)
def field_formats(spark, d):
    inv, _ = _ledger(spark, d)
    return inv.select(
        "doc_id",
        ck.valid_email(F.col("buyer.email")).alias("email_ok"),
        ck.valid_phone(F.col("buyer.phone")).alias("phone_ok"),
        ck.valid_tax_id(F.col("seller.tax_id")).alias("tax_id_ok"),
        ck.valid_currency(F.col("totals.total").cast("string")).alias("amount_ok"),
        ck.valid_date(F.col("issue_date").cast("string")).alias("date_ok"),
        ck.valid_percentage(F.concat(F.col("totals.tax_rate").cast("string"), F.lit("%"))).alias("rate_ok"),
        ck.valid_tax_id(F.col("buyer.tax_id"), F.lit("PL")).alias("nip_ok"),
    )


@query(
    "validate_fields",
    f"WITH {INV} SELECT doc_id, 2 + CAST(buyer_email IS NOT NULL AS INT) AS n_fields, coalesce(buyer_email NOT LIKE '%@invalid', true) AS valid FROM inv",
)
def validate_fields(spark, d):
    inv, _ = _ledger(spark, d)
    flat = inv.select("doc_id", F.col("document_number"), F.col("issue_date"), F.col("buyer.email").alias("email"))
    own = ck.Validators().register("number", lambda c: F.rlike(c, F.lit(r"^INV-[0-9]{8}$")))
    v = va.validate_fields(flat, {"document_number": "number", "issue_date": "date", "email": "email"}, own)
    return v.select("doc_id", F.size("fields").alias("n_fields"), "valid")


# ---- grounding, on rendered documents


def _read_back(spark: SparkSession, d: str) -> DataFrame:
    docs = Ledger(spark, d).documents.withColumn("language", F.element_at("metadata", F.lit("language")))
    return langpacks.extract_pack(docs, F.col("language"), keep=("text",))


@query(
    "grounding",
    f"""WITH {INV} SELECT doc_id, 3 AS n_fields, 1 + CAST(seller_name IS NOT NULL AS INT) + CAST(buyer_name IS NOT NULL AS INT) AS n_valid,
        seller_name IS NOT NULL AND buyer_name IS NOT NULL AS grounded FROM inv""",
)
def grounding(spark, d):
    values = {"number": F.col("document_number"), "seller": F.col("seller.name"), "buyer": F.col("buyer.name")}
    return gr.grounding(_read_back(spark, d), values).select("doc_id", "n_fields", "n_valid", "grounded")


@query(
    "grounding_ngram",
    f"WITH {INV} SELECT doc_id, 2 AS n_fields, buyer_name IS NOT NULL AS grounded FROM inv",
)
def grounding_ngram(spark, d):
    rec = _read_back(spark, d)
    # A mangled name is not in the text verbatim but shares most of its trigrams.
    mangled = F.concat(F.lower(F.col("buyer.name")), F.lit("?"))
    return gr.grounding(rec, {"number": F.col("document_number"), "buyer": mangled}, mode="ngram").select("doc_id", "n_fields", "grounded")


@query(
    "ungrounded",
    f"WITH {INV} SELECT field, count(*) AS n FROM (SELECT 'total' AS field FROM inv WHERE lang <> 'en' AND total IS NOT NULL UNION ALL SELECT 'alias' FROM inv) GROUP BY field",
)
def ungrounded(spark, d):
    rec = _read_back(spark, d)
    # Totals of the other languages are printed with a decimal comma.
    shown = F.col("totals.total").cast("decimal(18,2)").cast("string")
    missing = gr.ungrounded_values(
        rec, {"number": F.col("document_number"), "total": shown, "alias": F.lit("no such text")}, {"seller": F.upper(F.col("seller.name"))}
    )
    return missing.groupBy("field").agg(F.count("*").alias("n"))


@query(
    "text_agreement",
    f"WITH {INV} SELECT doc_id, 1.0::DOUBLE AS number_score, CASE WHEN seller_name IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS seller_score FROM inv",
)
def text_agreement(spark, d):
    return gr.text_agreement(_read_back(spark, d), {"number": F.col("document_number"), "seller": F.col("seller.name")})


@query(
    "overall_success",
    f"WITH {_CHK} SELECT inv.doc_id, seller_name IS NOT NULL AND buyer_name IS NOT NULL AND total_ok AND items_ok AND dates_ok AND tax_ok AS success FROM inv JOIN chk USING (doc_id)",
)
def overall_success(spark, d):
    values = {"number": F.col("document_number"), "seller": F.col("seller.name"), "buyer": F.col("buyer.name")}
    return gr.overall_success(gr.grounding(_read_back(spark, d), values), co.check_all(*_ledger(spark, d)))


# ---- merging


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Three extractors that agree, disagree and tie by order status."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    status = F.col("o_orderstatus")

    def rows(name: str, value: Column, confidence: Column) -> DataFrame:
        return o.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderpriority").alias("field"), value.alias("value"), confidence.alias("confidence"), F.lit(name).alias("extractor"))

    a = rows("rules", F.concat(F.lit("a"), status), F.when(status == "O", 0.9).otherwise(0.4))
    b = rows("pack", F.concat(F.lit("b"), status), F.when(status == "F", 0.8).otherwise(0.4))
    c = rows("model", F.concat(F.lit("c"), status), F.lit(0.4))
    return a.unionByName(b).unionByName(c)


@query(
    "best_candidate",
    """SELECT o_orderkey AS doc_id, o_orderpriority AS field, CASE o_orderstatus WHEN 'O' THEN 'aO' WHEN 'F' THEN 'bF' ELSE 'aP' END AS value,
       CASE o_orderstatus WHEN 'O' THEN 0.9 WHEN 'F' THEN 0.8 ELSE 0.4 END::DOUBLE AS confidence, o_orderstatus <> 'P' AS valid FROM orders""",
)
def best_candidate(spark, d):
    best = merge.best_candidate(_candidates(spark, d), ["rules", "pack", "model"])
    return best.select("doc_id", "field", "value", F.col("confidence").cast("double").alias("confidence"), "valid")


@query(
    "merge_precedence",
    """SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus = 'O' THEN 'S-' || o_orderkey ELSE 'P-' || o_orderkey END AS document_number,
       CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderstatus ELSE '' END AS extra FROM orders""",
)
def merge_precedence(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey").cast("string")
    primary = o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("P-"), key).alias("document_number"))
    secondary = o.filter("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("doc_id"),
        F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("S-"), key)).otherwise("").alias("invoice_number"),
        F.col("o_orderstatus").alias("flag"),
    )
    m = merge.merge_precedence(primary, secondary)
    return m.select("doc_id", "document_number", _s(F.element_at("metadata", F.lit("alt_flag"))).alias("extra"))


@query(
    "best_engine",
    """SELECT l_orderkey AS doc_id, max(CAST(l_quantity AS DOUBLE)) AS confidence FROM lineitem GROUP BY l_orderkey""",
)
def best_engine(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    pages = li.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page"), F.concat_ws("-", F.lit("engine"), F.col("l_linenumber").cast("string")).alias("engine"),
        F.lit("text").alias("text"), F.col("l_quantity").alias("confidence"),
    )
    return merge.best_engine(pages).select("doc_id", "confidence")


_WORDS_SQL = """w AS (SELECT doc_id, i - 1 AS p, t[i] AS word, (i * 37) % 101 AS conf FROM (SELECT doc_id, t, unnest(range(1, len(t) + 1)) AS i
  FROM (SELECT doc_id, string_split(text, ' ') AS t FROM documents)) WHERE trim(t[i], E' \\t\\r\\n') <> '')"""


def words_of(docs: DataFrame) -> DataFrame:
    """Recognised words of documents laid out 10 to a line, 40 lines to a block and page, from their tokens."""
    tokens = explode_rows(docs.select("doc_id", F.split("text", " ").alias("t")), "t", "p", "text")
    p = F.col("p")
    return tokens.filter(F.trim("text", F.lit(" \t\r\n")) != "").select(
        "doc_id",
        F.floor(p / 400).cast("int").alias("page"),
        F.lit("tokens").alias("engine"),
        F.floor(p / 40).cast("int").alias("block_no"),
        F.floor(p / 10).cast("int").alias("line_no"),
        p.alias("word_no"),
        "text",
        ((p + 1) * 37 % 101).cast("int").alias("conf"),
        (p % 10 * 100).cast("int").alias("x"),
        (F.floor(p / 10) % 40 * 20).cast("int").alias("y"),
        F.lit(90).alias("w"),
        F.lit(18).alias("h"),
        F.lit(1000).alias("page_w"),
        F.lit(800).alias("page_h"),
    )


def _words(spark: SparkSession, d: str) -> DataFrame:
    return words_of(spark.read.parquet(f"{d}/documents.parquet"))


@query(
    "words_to_text",
    f"""WITH {_WORDS_SQL} SELECT doc_id, p // 400 AS page, md5(string_agg(word, ' ' ORDER BY p)) AS digest, count(*) AS n_words,
        round(avg(conf) / 100, 6) AS confidence FROM w WHERE conf > 30 AND trim(word) <> '' GROUP BY ALL""",
)
def words_to_text(spark, d):
    t = merge.words_to_text(_words(spark, d))
    return t.select("doc_id", _n("page").alias("page"), F.md5("text").alias("digest"), "n_words", F.round("confidence", 6).alias("confidence"))


@query(
    "quadrant_text",
    f"""WITH {_WORDS_SQL}, q AS (SELECT *, CASE WHEN (p // 10) % 40 * 20 + 9 < 400 THEN 'top' ELSE 'bottom' END || '-' ||
        CASE WHEN p % 10 * 100 + 45 < 500 THEN 'left' ELSE 'right' END AS quadrant FROM w)
        SELECT doc_id, p // 400 AS page, quadrant, md5(string_agg(word, ' ' ORDER BY p)) AS digest, count(*) AS n_words, round(avg(conf), 6) AS confidence,
        md5(string_agg(p // 40 || ' ' || p // 10 || ' ' || p || ' ' || p % 10 * 100 || ' ' || (p // 10) % 40 * 20 || ' 90 18', ',' ORDER BY p)) AS boxes FROM q
        WHERE conf > 0 AND trim(word) <> '' GROUP BY ALL""",
)
def quadrant_text(spark, d):
    q = merge.quadrant_text(_words(spark, d))
    boxes = F.array_join(F.transform("boxes", lambda b: F.concat_ws(" ", *(b[c].cast("string") for c in ("block_no", "line_no", "word_no", "x", "y", "w", "h")))), ",")
    return q.select("doc_id", _n("page").alias("page"), "quadrant", F.md5("text").alias("digest"), "n_words", F.round("confidence", 6).alias("confidence"), F.md5(boxes).alias("boxes"))


@query(
    "layout_text",
    f"""WITH {_WORDS_SQL}, l AS (SELECT doc_id, p // 400 AS page, p // 40 AS block_no, p // 10 AS line_no, string_agg(word, ' ' ORDER BY p) AS t FROM w GROUP BY ALL)
        SELECT doc_id, page, block_no, md5(string_agg(t, chr(10) ORDER BY line_no)) AS digest, count(*) AS n_lines FROM l GROUP BY ALL""",
)
def layout_text(spark, d):
    t = merge.layout_text(_words(spark, d))
    return t.select("doc_id", _n("page").alias("page"), _n("block_no").alias("block_no"), F.md5("text").alias("digest"), "n_lines")


# ---- JSON


@query("json_key_k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_key_k(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", jsonops.json_key(F.col("props"), "k").cast("bigint").alias("k"))


def _nested(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select(
        "event_id", F.concat(F.lit('{"a": ['), F.col("props"), F.lit(', {"b": '), F.col("props"), F.lit('}], "t": "'), F.col("event_type"), F.lit('"}')).alias("doc")
    )


@query("json_find_key", "SELECT event_id, json_extract_string(props, '$.k') AS first, 2 AS n FROM events")
def json_find_key(spark, d):
    found = _nested(spark, d).select("event_id", jsonops.json_find_key(F.col("doc"), "k").alias("v"))
    return found.select("event_id", F.get("v", F.lit(0)).alias("first"), F.size("v").alias("n"))


@query("json_filter", "SELECT event_id, event_type AS t, false AS has_k FROM events")
def json_filter(spark, d):
    kept = _nested(spark, d).select("event_id", jsonops.json_filter(F.col("doc"), exclude=["k"]).alias("j"))
    return kept.select("event_id", F.get_json_object("j", "$.t").alias("t"), F.contains("j", F.lit('"k"')).alias("has_k"))


@query("json_try_parse", "SELECT event_id, event_type <> 'error' AS parsed FROM events")
def json_try_parse(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    raw = F.when(F.col("event_type") == "error", F.substring("props", 1, 4)).otherwise(F.col("props"))
    return e.select("event_id", jsonops.json_try_parse(raw).isNotNull().alias("parsed"))
