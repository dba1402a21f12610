"""Registered queries over invoice documents rendered from the ledger: extraction has to give the ledger back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import amounts, dates
from docledger.functions.regexes import explode_rows
from docledger.functions.text import lines
from docledger.operators import classify as cl
from docledger.operators import fields, items as it, langpacks, routes, rules
from docledger.operators.consistency import check_all, check_summary, compare_with_reference, comparison_counts, unpivot
from docledger.plans import pipeline
from docledger.plans.ledger_sql import INV, INV_EN, LI, dbl, text
from docledger.plans.registry import ORACLES, query
from docledger.schemas import MONEY
from docledger.session import run_folder
from docledger.sources import files, markup
from docledger.sources.ledger import Ledger
from docledger.streaming import paging, silence
from docledger.streaming.jobs import read_stream, start


def _s(c: Column | str) -> Column:
    """Text with '' for missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _d(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.cast("double")


def _documents(spark: SparkSession, d: str) -> DataFrame:
    return Ledger(spark, d).documents.withColumn("language", F.element_at("metadata", F.lit("language")))


def _english(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the ledger, written in English."""
    return Ledger(spark, d).render(language="en").withColumn("language", F.lit("en"))


def _pack(spark: SparkSession, d: str) -> DataFrame:
    return langpacks.extract_pack(_documents(spark, d), F.col("language"))


# ---- rendering


@query(
    "render_documents",
    f"WITH {INV} SELECT doc_id, 0 AS page, lang AS language, document_number || '.txt' AS filename, n_items FROM inv",
)
def render_documents(spark, d):
    docs = _documents(spark, d)
    n = F.size(F.filter(lines(F.col("text")), lambda x: F.rlike(x, F.lit(r"Part [0-9]+ stock"))))
    return docs.select(
        "doc_id", F.col("page").cast("bigint").alias("page"), "language", F.element_at("metadata", F.lit("filename")).alias("filename"),
        n.cast("bigint").alias("n_items"),
    )


# ---- language packs


@query(
    "pack_header",
    f"WITH {INV} SELECT doc_id, document_number, {text('issue_date')} AS issue_date, {text('due_date')} AS due_date, currency FROM inv",
)
def pack_header(spark, d):
    return _pack(spark, d).select("doc_id", _s("document_number").alias("document_number"), _s("issue_date").alias("issue_date"), _s("due_date").alias("due_date"), _s("currency").alias("currency"))


@query(
    "pack_parties",
    f"""WITH {INV} SELECT doc_id, {text('seller_name')} AS seller_name, {text('seller_tax_id')} AS seller_tax_id,
        {text('buyer_name')} AS buyer_name, {text('buyer_tax_id')} AS buyer_tax_id FROM inv""",
)
def pack_parties(spark, d):
    return _pack(spark, d).select("doc_id", _s("seller.name").alias("seller_name"), _s("seller.tax_id").alias("seller_tax_id"), _s("buyer.name").alias("buyer_name"), _s("buyer.tax_id").alias("buyer_tax_id"))


@query(
    "pack_totals",
    f"WITH {INV} SELECT doc_id, {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('total')} AS total FROM inv",
)
def pack_totals(spark, d):
    return _pack(spark, d).select("doc_id", _d("totals.subtotal").alias("subtotal"), _d("totals.tax_amount").alias("tax_amount"), _d("totals.total").alias("total"))


@query(
    "pack_payment",
    f"""WITH {INV} SELECT doc_id, coalesce(CAST(days AS BIGINT), -1) AS days, {text('method')} AS method, {text('account')} AS iban FROM inv""",
)
def pack_payment(spark, d):
    p = _pack(spark, d)
    return p.select("doc_id", F.coalesce(F.col("payment.terms_days"), F.lit(-1)).cast("bigint").alias("days"), _s("payment.method").alias("method"), _s("payment.iban").alias("iban"))


# ---- English extraction


@query(
    "inv_header",
    f"WITH {INV_EN} SELECT doc_id, document_number, {text('issue_date')} AS issue_date FROM inv",
)
def inv_header(spark, d):
    docs = fields.with_dates(_english(spark, d))
    return docs.select("doc_id", _s(fields.document_number(F.col("text"))).alias("document_number"), _s("issue_date").alias("issue_date"))


@query(
    "inv_due_date",
    f"WITH {INV_EN} SELECT doc_id, {text('coalesce(due_date, issue_date)')} AS due_date FROM inv",
)
def inv_due_date(spark, d):
    return fields.with_dates(_english(spark, d)).select("doc_id", _s("due_date").alias("due_date"))


@query(
    "inv_totals",
    f"""WITH {INV_EN} SELECT doc_id, {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('total')} AS total, currency
        FROM inv""",
)
def inv_totals(spark, d):
    t = fields.with_totals(_english(spark, d))
    return t.select("doc_id", _d("subtotal").alias("subtotal"), _d("tax_amount").alias("tax_amount"), _d("total").alias("total"), "currency")


@query(
    "inv_parties",
    f"""WITH {INV_EN} SELECT doc_id, {text('seller_name')} AS seller_name, {text('seller_tax_id')} AS seller_tax_id,
        {text('seller_email')} AS seller_email, {text('buyer_name')} AS buyer_name, {text('buyer_tax_id')} AS buyer_tax_id FROM inv""",
)
def inv_parties(spark, d):
    p = fields.with_parties(_english(spark, d))
    return p.select("doc_id", _s("seller.name").alias("seller_name"), _s("seller.tax_id").alias("seller_tax_id"), _s("seller.email").alias("seller_email"), _s("buyer.name").alias("buyer_name"), _s("buyer.tax_id").alias("buyer_tax_id"))


@query(
    "inv_payment",
    f"""WITH {INV_EN} SELECT doc_id, coalesce('Net ' || days || ' days', '') AS terms, {text('method')} AS method, {text('account')} AS iban,
        CASE WHEN status = 'F' THEN 'credit_card' WHEN status = 'O' OR account IS NOT NULL THEN 'bank_transfer' ELSE '' END AS kind FROM inv""",
)
def inv_payment(spark, d):
    docs = _english(spark, d)
    p = docs.select("doc_id", fields.payment_info(F.col("text")).alias("p"), fields.payment_method_class(F.col("text")).alias("k"))
    return p.select("doc_id", _s("p.terms").alias("terms"), _s("p.method").alias("method"), _s("p.iban").alias("iban"), _s("k").alias("kind"))


@query(
    "inv_last_total",
    f"WITH {INV_EN} SELECT doc_id, {dbl('total')} AS total FROM inv",
)
def inv_last_total(spark, d):
    return _english(spark, d).select("doc_id", _d(fields.last_amount_total(F.col("text"))).alias("total"))


@query(
    "inv_kind",
    f"WITH {INV_EN} SELECT doc_id, 'Invoice' AS document_kind, '' AS order_number FROM inv",
)
def inv_kind(spark, d):
    m = fields.with_order_metadata(_english(spark, d))
    return m.select("doc_id", _s("document_kind").alias("document_kind"), _s("order_number").alias("order_number"))


@query(
    "rules_info",
    f"""WITH {INV_EN} SELECT field, count(*) AS n_docs, sum(CAST(ok AS INT)) AS n_found FROM (
        SELECT unnest([{{'field': 'invoice_number', 'ok': true}}, {{'field': 'customer_name', 'ok': buyer_name IS NOT NULL}},
          {{'field': 'currency', 'ok': true}}, {{'field': 'due_date', 'ok': due_date IS NOT NULL AND days IS NULL}}], recursive := true) FROM inv) GROUP BY field""",
)
def rules_info(spark, d):
    info = rules.extract_with_info(_english(spark, d).select("doc_id", "text"), rules.DEFAULT_FIELD_RULES)
    shown = info.filter(F.col("field").isin("invoice_number", "customer_name", "currency", "due_date"))
    return shown.groupBy("field").agg(F.count("*").alias("n_docs"), F.count_if("success").alias("n_found"))


@query(
    "rules_wide",
    f"""WITH {INV_EN} SELECT doc_id, document_number AS invoice_number, {text('issue_date')} AS issue_date, {text('buyer_name')} AS buyer_name,
        {text('seller_name')} AS seller_name, {dbl('total')} AS total FROM inv""",
)
def rules_wide(spark, d):
    wanted = {"invoice_number", "issue_date", "buyer.name", "seller.name", "total_amount"}
    w = rules.extract_wide(_english(spark, d).select("doc_id", "text"), [r for r in rules.RULE_CATALOGUE if r.field in wanted])
    return w.select(
        "doc_id", _s("invoice_number").alias("invoice_number"),
        _s(rules.convert_value(F.col("issue_date"), "date")).alias("issue_date"), _s("buyer_name").alias("buyer_name"),
        _s("seller_name").alias("seller_name"), _d(rules.convert_value(F.col("total_amount"), "currency")).alias("total"),
    )


@query(
    "rules_nested",
    f"WITH {INV_EN} SELECT doc_id, document_number, {text('seller_name')} AS seller_name, {text('buyer_name')} AS buyer_name FROM inv",
)
def rules_nested(spark, d):
    base = [r for r in rules.RULE_CATALOGUE if r.field in ("invoice_number", "seller.name", "buyer.name")]
    cands = rules.candidates(_english(spark, d), base, "catalogue")
    wide = rules.pivot_candidates(cands, ["invoice_number", "seller.name", "buyer.name"])
    flat = wide.select("doc_id", F.col("invoice_number").alias("document_number"), F.col("`seller.name`").alias("seller_name"), F.col("`buyer.name`").alias("buyer_name"))
    n = rules.assemble_nested(flat)
    return n.select("doc_id", "document_number", _s("seller.name").alias("seller_name"), _s("buyer.name").alias("buyer_name"))


@query(
    "type_detect",
    f"""WITH {INV} SELECT doc_id, CASE WHEN lang = 'en' AND prio <> '4-NOT SPECIFIED' THEN 'invoice' ELSE 'unknown' END AS doc_type,
        CASE WHEN lang = 'en' AND prio <> '4-NOT SPECIFIED' THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END AS confidence FROM inv""",
)
def type_detect(spark, d):
    t = cl.detect_type(_documents(spark, d))
    return t.select("doc_id", "doc_type", F.round("type_confidence", 6).alias("confidence"))


@query(
    "route_extractor",
    f"""WITH {INV_EN} SELECT doc_id, 'default' AS extractor, document_number, {text('issue_date')} AS issue_date, {dbl('total')} AS total FROM inv""",
)
def route_extractor(spark, d):
    """The rules of each document's route, and what they find."""
    docs = _english(spark, d).select("doc_id", "text", F.lit("invoice").alias("doc_type"), F.lit("en").alias("language"), F.lit(False).alias("has_tables"))
    found = cl.routed_fields(cl.route_extractor(docs))
    value = lambda name: F.element_at("fields", F.lit(name))
    return found.select("doc_id", "extractor", value("document_number").alias("document_number"), dates.parse_date(value("issue_date")).cast("string").alias("issue_date"), _d(amounts.parse_amount(value("total"))).alias("total"))


# ---- parsing


@query(
    "amounts",
    """SELECT o_orderkey AS doc_id, v AS us, v AS eu, -v AS bracketed, CAST(trunc(v) AS DOUBLE) AS grouped
       FROM (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) AS v FROM orders)""",
)
def amounts_query(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    us = F.format_number("o_totalprice", 2)
    whole = F.substring_index(us, ".", 1)
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        _d(amounts.parse_amount(F.concat(F.lit("$"), us))).alias("us"),
        _d(amounts.parse_amount(F.concat(F.translate(us, ",.", ".,"), F.lit(" €")))).alias("eu"),
        _d(amounts.parse_amount_signed(F.concat(F.lit("("), us, F.lit(")")))).alias("bracketed"),
        _d(amounts.parse_amount_grouped(whole)).alias("grouped"),
    )


@query("parse_date", "SELECT o_orderkey AS doc_id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders")
def parse_date(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    day, p = F.col("o_orderdate"), F.col("o_orderpriority")
    shown = (
        F.when(p == "1-URGENT", F.date_format(day, "dd.MM.yyyy"))
        .when(p == "2-HIGH", F.date_format(day, "yyyy/M/d"))
        .when(p == "3-MEDIUM", F.date_format(day, "MMM d, yyyy"))
        .when(p == "5-LOW", F.date_format(day, "d MMMM yyyy"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    raw = o.select(F.col("o_orderkey").alias("doc_id"), shown.alias("raw"))
    return raw.select("doc_id", _s(dates.parse_date(F.col("raw"))).alias("day"))


@query(
    "convert_values",
    """SELECT o_orderkey AS doc_id, CAST(o_custkey AS BIGINT) AS as_int, CAST(o_totalprice AS DOUBLE) AS as_decimal,
       o_orderstatus = 'O' AS as_bool, replace(CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE o_orderstatus END, 'P', 'pending') AS looked_up,
       regexp_replace(o_orderpriority, '^[0-9]-', '') AS stripped FROM orders""",
)
def convert_values(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        rules.convert_value(F.col("o_custkey").cast("string"), "int").cast("bigint").alias("as_int"),
        _d(rules.convert_value(F.format_number("o_totalprice", 2), "decimal")).alias("as_decimal"),
        rules.convert_value(F.when(F.col("o_orderstatus") == "O", "yes").otherwise("no"), "bool").alias("as_bool"),
        rules.post_process(F.col("o_orderstatus"), swap="P|pending", lookup={"f": "finished"}).alias("looked_up"),
        rules.post_process(F.col("o_orderpriority"), regex=(r"^[0-9]-", "")).alias("stripped"),
    )


@query(
    "complete_totals",
    f"""WITH {INV} SELECT doc_id, {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('subtotal + tax_amount')} AS total
        FROM inv WHERE n_items > 0""",
)
def complete_totals(spark, d):
    lg = Ledger(spark, d)
    # One of the three amounts is missing, which one varies with the number of lines.
    kind = F.col("n_items") % 3
    t = lg.totals.withColumn("total", (F.col("subtotal") + F.col("tax_amount")).cast(MONEY)).withColumns(
        {
            "subtotal": F.when(kind != 0, F.col("subtotal")),
            "tax_amount": F.when(kind != 1, F.col("tax_amount")),
            "total": F.when(kind != 2, F.col("total")),
            "tax_rate": F.lit(None).cast(MONEY),
        }
    )
    c = fields.complete_totals(t)
    return c.select("doc_id", _d("subtotal").alias("subtotal"), _d("tax_amount").alias("tax_amount"), _d("total").alias("total"))


@query(
    "confidence",
    f"""WITH {INV} SELECT doc_id, least((3 + 2 * (seller_name IS NOT NULL)::INT + 2 * (buyer_name IS NOT NULL)::INT + 2 * coalesce(total > 0, false)::INT
        + 2 * (method IS NOT NULL OR account IS NOT NULL)::INT + 2 * (n_items > 0)::INT) / 10.0, 1.0)::DOUBLE AS points,
        ((4 + 2 * (seller_name IS NOT NULL)::INT + (buyer_name IS NOT NULL)::INT + 3 * coalesce(total > 0, false)::INT) / 10.0)::DOUBLE AS weighted FROM inv""",
)
def confidence(spark, d):
    lg = Ledger(spark, d)
    inv = lg.invoices.join(lg.totals.select("doc_id", "n_items"), "doc_id", "left")
    return inv.select("doc_id", fields.extraction_confidence(F.col("n_items")).alias("points"), fields.weighted_confidence().alias("weighted"))


# ---- items

_ITEMS = f"WITH {LI} SELECT doc_id, description, {dbl('quantity')} AS quantity, {dbl('unit_price')} AS unit_price, {dbl('amount')} AS amount FROM it"


def _item_rows(df: DataFrame) -> DataFrame:
    rows = it.explode_items(df)
    return rows.select("doc_id", "description", _d("quantity").alias("quantity"), _d("unit_price").alias("unit_price"), _d("amount").alias("amount"))


@query("inv_items", _ITEMS)
def inv_items(spark, d):
    return _item_rows(it.extract_items(_documents(spark, d), "language"))


_ENGLISH_ITEMS = f"""WITH {INV_EN} SELECT doc_id, description, {dbl('quantity')} AS quantity, {dbl('unit_price')} AS unit_price, {dbl('amount')} AS amount
    FROM it WHERE doc_id IN (SELECT doc_id FROM inv)"""


@query("items_by_lines", _ENGLISH_ITEMS)
def items_by_lines(spark, d):
    return _item_rows(it.extract_items(_english(spark, d), "lines"))


@query("items_by_header", _ENGLISH_ITEMS)
def items_by_header(spark, d):
    return _item_rows(it.extract_items(_english(spark, d), "header"))


@query("items_by_rule", _ENGLISH_ITEMS)
def items_by_rule(spark, d):
    num = r"([0-9]+(?:[.,][0-9]+)?)"
    found = it.items_by_rule(
        F.col("text"), r"Description\s+Quantity\s+Unit Price\s+Amount", "Subtotal", rf"^\s*([^\n]+?)\s{{2,}}{num}\s+{num}\s+{num}\s*$",
        [("description", "str"), ("quantity", "float"), ("unit_price", "currency"), ("amount", "currency")], ["description", "amount"],
    )
    rows = explode_rows(_english(spark, d).select("doc_id", found.alias("items")), "items", "_i", "x")
    return rows.select("doc_id", "x.description", _d("x.quantity").alias("quantity"), _d("x.unit_price").alias("unit_price"), _d("x.amount").alias("amount"))


@query(
    "items_auto",
    f"""WITH {INV_EN} SELECT doc_id, n_items, {dbl('subtotal')} AS amount FROM inv WHERE n_items > 0""",
)
def items_auto(spark, d):
    rows = it.explode_items(it.extract_items(_english(spark, d)))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_items"), _d(F.sum("amount")).alias("amount"))


@query(
    "item_lines",
    f"WITH {INV_EN} SELECT doc_id, n_items AS n_lines FROM inv",
)
def item_lines(spark, d):
    arr = lines(it.item_section(F.col("text")))
    n = F.size(F.filter(arr, it.is_item_line))
    return _english(spark, d).select("doc_id", n.cast("bigint").alias("n_lines"))


_KEY = "trim(description), quantity, unit_price"


def _table_items(spark: SparkSession, d: str) -> DataFrame:
    return Ledger(spark, d).items


@query("items_rollup", f"WITH {LI} SELECT doc_id, {dbl('sum(amount)')} AS subtotal, {dbl('sum(tax_amount)')} AS tax_amount, {dbl('sum(amount) + sum(tax_amount)')} AS total, count(*) AS n_items FROM it GROUP BY doc_id")
def items_rollup(spark, d):
    r = it.items_rollup(_table_items(spark, d))
    return r.select("doc_id", _d("subtotal").alias("subtotal"), _d("tax_amount").alias("tax_amount"), _d("total").alias("total"), "n_items")


@query(
    "text_rollup",
    f"WITH {LI} SELECT doc_id, {dbl('sum(amount)')} AS subtotal, count(*) AS n_items FROM it GROUP BY doc_id",
)
def text_rollup(spark, d):
    r = it.items_rollup(it.explode_items(it.extract_items(_documents(spark, d), "language")))
    return r.select("doc_id", _d("subtotal").alias("subtotal"), "n_items")


def _supplier_bills(spark: SparkSession, d: str) -> DataFrame:
    """Lines billed per supplier and rounded to a coarse price, so that equal lines really occur."""
    items = _table_items(spark, d)
    return items.select(
        F.col("supplier_id").alias("doc_id"),
        F.concat(F.lit(" Part "), (F.col("item_code").cast("bigint") % 7).cast("string")).alias("description"),
        "quantity",
        F.lit(1).cast(MONEY).alias("unit_price"),
        F.xxhash64("doc_id", "line_number", "item_code", "unit_price").alias("item_no"),
        F.col("amount").cast(MONEY).alias("amount"),
    )


_BILLS = f"""WITH {LI} SELECT l_suppkey AS doc_id, 'Part ' || (l_partkey % 7) AS description, CAST(quantity AS DOUBLE) AS quantity FROM it"""


@query("items_dedupe", f"SELECT doc_id, description, quantity, 1 AS copies FROM ({_BILLS}) GROUP BY ALL")
def items_dedupe(spark, d):
    one = it.dedupe_items(_supplier_bills(spark, d))
    return one.groupBy("doc_id", F.trim("description").alias("description"), _d("quantity").alias("quantity")).agg(F.count("*").alias("copies"))


@query(
    "allocate_missing",
    f"""WITH {INV}, s AS (SELECT doc_id, sum(amount) FILTER (l_returnflag <> 'R') AS known, count(*) FILTER (l_returnflag = 'R') AS missing FROM it GROUP BY doc_id)
        SELECT doc_id, count(*) AS n, CAST(round(sum(CASE WHEN l_returnflag = 'R'
          THEN CAST(round((subtotal + tot.tax_amount - coalesce(known, 0)) / missing, 4) AS DECIMAL(18,4)) ELSE it.amount END), 1) AS DOUBLE) AS amount
        FROM it JOIN s USING (doc_id) JOIN tot USING (doc_id) GROUP BY doc_id""",
)
def allocate_missing(spark, d):
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    from docledger.sources.ledger import ledger_items

    flagged = li.withColumn("l_partkey", F.when(F.col("l_returnflag") == "R", -F.col("l_partkey") - 1).otherwise(F.col("l_partkey")))
    items = ledger_items(flagged).withColumn("amount", F.when(F.col("item_code").cast("bigint") >= 0, F.col("amount").cast(MONEY)))
    totals = Ledger(spark, d).totals.withColumn("total", (F.col("subtotal") + F.col("tax_amount")).cast(MONEY))
    done = it.allocate_missing(items, totals)
    return done.groupBy("doc_id").agg(F.count("*").alias("n"), _d(F.round(F.sum("amount"), 1)).alias("amount"))


@query(
    "derive_items",
    f"""WITH {LI} SELECT doc_id, count(*) AS n, {dbl('sum(quantity * unit_price)')} AS amount, round({dbl('sum(quantity * unit_price * rate)')}, 0) AS tax FROM it GROUP BY doc_id""",
)
def derive_items(spark, d):
    items = _table_items(spark, d).withColumns(
        {c: F.lit(None).cast(MONEY) for c in ("amount", "tax_amount", "net_amount")}
    )
    out = it.derive_item_values(items)
    return out.groupBy("doc_id").agg(F.count("*").alias("n"), _d(F.sum("amount")).alias("amount"), F.round(_d(F.sum("tax_amount")), 0).alias("tax"))


@query(
    "refund_sign",
    f"""WITH {LI} SELECT doc_id, {dbl("sum(CASE WHEN l_returnflag = 'R' THEN -amount ELSE amount END)")} AS amount,
        {dbl("sum(CASE WHEN l_returnflag = 'R' THEN -unit_price ELSE unit_price END)")} AS price, bool_and(l_returnflag = 'R') AS refund FROM it GROUP BY doc_id""",
)
def refund_sign(spark, d):
    from docledger.sources.ledger import ledger_items

    li = spark.read.parquet(f"{d}/lineitem.parquet")
    # A returned line carries a negative net amount only; the operator spreads the sign.
    items = ledger_items(li.withColumn("l_partkey", F.when(F.col("l_returnflag") == "R", -F.col("l_partkey") - 1).otherwise(F.col("l_partkey"))))
    returned = F.col("item_code").cast("bigint") < 0
    items = items.withColumn("net_amount", F.when(returned, -F.col("amount")).otherwise(F.col("amount")))
    names = ["description", "quantity", "unit_price", "net_amount", "tax_amount", "amount"]
    signed = items.select("doc_id", it.refund_sign(F.struct(*names)).alias("i")).select("doc_id", "i.*")
    sums = signed.groupBy("doc_id").agg(F.sum("amount").cast(MONEY).alias("total"), F.sum("unit_price").cast(MONEY).alias("price"))
    flags = it.refund_totals(sums.withColumn("_t", F.col("total")), signed).withColumn("refund", F.col("total") < 0)
    by_item = signed.groupBy("doc_id").agg(F.bool_and(F.col("amount") < 0).alias("all_negative"))
    return flags.join(by_item, "doc_id").select("doc_id", _d("_t").alias("amount"), _d("price").alias("price"), F.col("all_negative").alias("refund"))


@query("items_dups", f"SELECT doc_id, lower(description) AS description, count(*) AS n FROM ({_BILLS}) GROUP BY ALL HAVING count(*) > 1")
def items_dups(spark, d):
    from docledger.operators.validate import duplicate_items

    return duplicate_items(_supplier_bills(spark, d))


# ---- layout packs: header documents of the ledger in the vendor and the European layout


def _shown(c: Column) -> Column:
    return c.cast("decimal(18,2)").cast("string")


def _stated(spark: SparkSession, d: str) -> DataFrame:
    """Invoices with lines and a buyer, whose layouts print every amount."""
    return Ledger(spark, d).invoices.filter("seller is not null and buyer is not null")


@query(
    "vendor_layout",
    f"""WITH {INV} SELECT doc_id, document_number, {text('issue_date')} AS issue_date, {text('issue_date + 30')} AS due_date, currency, buyer_name,
        {dbl('subtotal')} AS subtotal, {dbl('tax_amount')} AS tax_amount, {dbl('total')} AS total FROM inv WHERE seller_name IS NOT NULL AND buyer_name IS NOT NULL""",
)
def vendor_layout(spark, d):
    t, cur = F.col("totals"), F.col("currency")
    day = lambda c: F.upper(F.date_format(c, "dd-MMM-yyyy"))

    def money(label: str, c: Column) -> Column:
        return F.concat(F.lit(f"{label} ("), cur, F.lit(") "), _shown(c))

    body = F.concat_ws(
        "\n", F.concat(F.lit("Invoice Number "), F.col("document_number")), F.concat(F.lit("Currency "), cur), F.lit(""), F.lit("Bill To"),
        F.col("buyer.name"), F.col("buyer.address"), F.lit(""),
        F.concat(F.lit("Service Term: "), day(F.col("issue_date")), F.lit(" to "), day(F.date_add("issue_date", 30))),
        F.lit("Invoice Total"), money("NET AMOUNT", t["subtotal"]), money("TAXES (SEE DETAILS FOR RATES)", t["tax_amount"]), money("GRAND TOTAL", t["total"]),
    )
    docs = _stated(spark, d).select("doc_id", body.alias("text"), F.create_map().cast("map<string,string>").alias("metadata"))
    v = langpacks.extract_vendor(docs)
    return v.select("doc_id", "document_number", _s("issue_date").alias("issue_date"), _s("due_date").alias("due_date"), "currency", "buyer_name", _d("subtotal").alias("subtotal"), _d("tax_amount").alias("tax_amount"), _d("total").alias("total"))


@query(
    "european_layout",
    f"""WITH {INV} SELECT doc_id, {text('issue_date')} AS issue_date, currency, seller_name, buyer_name, buyer_address, {dbl('subtotal')} AS subtotal,
        {dbl('subtotal')} AS item_net, {dbl('subtotal + tax_amount')} AS total FROM inv WHERE seller_name IS NOT NULL AND buyer_name IS NOT NULL""",
)
def european_layout(spark, d):
    t = F.col("totals")
    body = F.concat_ws(
        "\n", F.concat(F.lit("Date "), F.date_format("issue_date", "dd.MM.yyyy")), F.lit("CLIENT"), F.col("buyer.name"), F.col("buyer.address"),
        F.lit(""), F.lit("Product/Service"), F.lit("Goods of the order"), F.concat(F.lit("Price "), _shown(t["subtotal"])), F.lit("Quantity 1 (pcs)"),
        F.lit("Sum without VAT"), _shown(t["subtotal"]), F.concat(F.lit("Invoice total "), _shown(t["subtotal"] + t["tax_amount"]), F.lit(" "), F.col("currency")),
        # The issuer stands at the foot of the page, in the five lines above its tax id.
        F.lit("\n\n\n"), F.col("seller.name"), F.lit("VAT no: EE123456789"), F.lit("IBAN: EE12345"), F.lit("SWIFT: ABCDEFGH"),
    )
    e = langpacks.extract_european(_stated(spark, d).select("doc_id", body.alias("text")))
    return e.select("doc_id", _s("issue_date").alias("issue_date"), "currency", "seller_name", "buyer_name", "buyer_address", _d("subtotal").alias("subtotal"), _d("item_net").alias("item_net"), _d("total").alias("total"))


# ---- routes as data

_C = "c_custkey IS NOT NULL AND c_custkey"


@query(
    "route_table",
    f"""SELECT o_orderkey AS doc_id, CASE WHEN {_C} % 5 = 0 AND o_orderstatus = 'F' THEN 'paid-' || c_custkey
        WHEN o_orderstatus = 'O' AND o_orderpriority IS NOT NULL THEN 'open-' || o_orderpriority
        WHEN {_C} % 7 = 0 THEN 'changed-' || c_custkey WHEN {_C} % 3 = 0 THEN 'customer-' || c_custkey
        WHEN o_orderpriority IS NOT NULL THEN 'any-' || o_orderpriority ELSE 'default' END AS extractor,
        CASE WHEN {_C} % 5 = 0 AND o_orderstatus = 'F' THEN 'paid' WHEN o_orderstatus = 'O' AND o_orderpriority IS NOT NULL THEN 'open' ELSE '' END AS mode
        FROM orders LEFT JOIN customer ON c_custkey = o_custkey""",
)
def route_table(spark, d):
    """Orders through a table of routes by customer, status and priority, as many as customers have, after an upsert."""
    names = ["status", "priority", "customer"]
    orders, customers = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    docs = orders.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer"))
    key, none = F.col("c_custkey").cast("string"), F.lit(None).cast("string")

    def of(rows: DataFrame, status: Column, priority: Column, customer: Column, prefix: str, name: Column, mode: str | None = None) -> DataFrame:
        params = F.create_map(F.lit("mode"), F.lit(mode)) if mode else F.lit(None).cast("map<string,string>")
        return rows.select(status.alias("status"), priority.alias("priority"), customer.alias("customer"), F.concat(F.lit(prefix), name).alias("extractor"), params.alias("params"))

    every = orders.select("o_orderpriority").where("o_orderpriority is not null").distinct()
    priority = F.col("o_orderpriority")
    table = (
        of(customers.where("c_custkey % 5 = 0"), F.lit("F"), none, key, "paid-", key, "paid")
        .unionByName(of(customers.where("c_custkey % 3 = 0"), none, none, key, "customer-", key))
        .unionByName(of(every, F.lit("O"), priority, none, "open-", priority, "open"))
        .unionByName(of(every, none, priority, none, "any-", priority))
    )
    changes = of(customers.where("c_custkey % 7 = 0"), none, none, key, "changed-", key)
    out = routes.routed(docs, routes.upserted(table, changes, names), names)
    return out.select("doc_id", "extractor", F.coalesce(F.element_at("params", F.lit("mode")), F.lit("")).alias("mode"))


# ---- whole pipeline and exchange formats


@query(
    "run_corpus",
    f"""WITH {INV} SELECT doc_id, document_number, {text('issue_date')} AS issue_date, {dbl('total')} AS total, n_items,
        coalesce(abs(total - subtotal - tax_amount) <= greatest(abs(total), abs(subtotal + tax_amount)) * 0.01, false) AS total_ok,
        n_items > 0 AS items_ok, coalesce(date_diff('day', issue_date, due_date) BETWEEN 0 AND 365, true) AS dates_ok, '' AS error,
        (1 + CAST(seller_name IS NOT NULL AS INT) + CAST(buyer_name IS NOT NULL AS INT) + n_items) * 10 >= (3 + n_items) * 7 AS grounded FROM inv""",
)
def run_corpus(spark, d):
    # Languages are detected; long documents come as pages and are put together again.
    return _corpus_rows(pipeline.run_paged(Ledger(spark, d).render(page_lines=500)))


def _corpus_rows(r: DataFrame, *more: str) -> DataFrame:
    return r.select(
        *more, "doc_id", "document_number", _s("issue_date").alias("issue_date"), _d("totals.total").alias("total"),
        F.col("n_items").cast("bigint").alias("n_items"), "total_ok", "items_ok", "dates_ok", _s("error").alias("error"), "grounded",
    )


@query("stream_records", ORACLES["run_corpus"].replace(" AS grounded FROM inv", " AS grounded, true AS complete FROM inv"))
def stream_records(spark, d):
    """Pages of three lines arrive in any order, in four or more batches; only the last one states their number."""
    pages = Ledger(spark, d).render(page_lines=3)
    # A range of line numbers without a line is no page.
    last = pages.groupBy("doc_id").agg(F.max("page").alias("_last"), F.count("*").cast("int").alias("_pages"))
    arrival = F.pmod(F.xxhash64("doc_id", "page"), F.lit(4)).cast("int")
    come = pages.join(last, "doc_id").withColumns(
        {"n_pages": F.when(F.col("page") == F.col("_last"), F.col("_pages")), "ts": F.timestamp_seconds(F.lit(1_704_067_200) + arrival * 60)}
    )
    folder = run_folder(spark)
    come.drop("_last", "_pages").repartitionByRange(8, "ts", F.xxhash64("doc_id", "page")).write.parquet(f"{folder}/pages")
    schema = spark.read.parquet(f"{folder}/pages").schema
    stream = paging.stream_records(read_stream(silence.use_rocksdb(spark), f"{folder}/pages", schema, max_files=2))
    start(stream, f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    r = spark.read.schema(stream.schema).parquet(f"{folder}/out")
    return _corpus_rows(r, "complete")


@query(
    "hostile_docs",
    f"""WITH {INV} SELECT doc_id, document_number, n_items + CASE WHEN doc_id % 4 = 1 THEN 2 ELSE 0 END AS n_items,
        CASE WHEN doc_id % 4 = 1 THEN 'amount out of range' ELSE '' END AS error FROM inv""",
)
def hostile_docs(spark, d):
    """Every document with something appended that a pattern or a sum could break on: only impossible sums are errors."""
    key, lang = F.pmod("doc_id", F.lit(4)), F.col("language")
    runs = F.concat(F.lit("\nNote "), F.repeat(F.lit("7 "), 400), F.lit("\n"), F.repeat(F.lit("1."), 400), F.lit("\n"), F.repeat(F.lit("("), 400))
    huge = {
        "en": "Part 1 stock   1   99999999999999.00   99999999999999.00", "pl": "Part 1 stock   99999999999999,00   1   5%   99999999999999,00",
        "other": "1 x Part 1 stock 99999999999999,00 EUR 99999999999999,00",
    }
    row = F.when(lang == "en", huge["en"]).when(lang == "pl", huge["pl"]).otherwise(huge["other"])
    # The two rows stand before the document's own first item, below the header of the table.
    head = r"((?:Description|Menge|Cantidad|Quantité|Nazwa)[^\n]*\n)"
    with_rows = F.regexp_replace(F.col("text"), F.lit(head), F.concat(F.lit("$1"), row, F.lit("\n"), row, F.lit("\n")))
    odd = F.when(key == 0, F.concat("text", runs)).when(key == 1, with_rows).when(key == 2, F.concat("text", F.lit("\nNet 2147483647 days"))).otherwise(F.concat("text", F.lit("\n\u0000\uffff<[\\")))
    r = pipeline.run_pipeline(_documents(spark, d).withColumn("text", odd), language=lang)
    return r.select("doc_id", "document_number", F.col("n_items").cast("bigint").alias("n_items"), _s("error").alias("error"))


@query(
    "flagship",
    f"""WITH {INV}, c AS (SELECT coalesce(abs(total - subtotal - tax_amount) <= greatest(abs(total), abs(subtotal + tax_amount)) * 0.01, false) AS a,
        n_items > 0 AS b, coalesce(date_diff('day', issue_date, due_date) BETWEEN 0 AND 365, true) AS d, coalesce(abs(subtotal - total) <= 0.02, true) AND n_items > 0 AS m FROM inv)
        SELECT check_name, valid, count(*) AS n_docs FROM (SELECT unnest([{{'check_name': 'total_ok', 'valid': a}}, {{'check_name': 'items_ok', 'valid': b}},
        {{'check_name': 'dates_ok', 'valid': d}}, {{'check_name': 'lines_ok', 'valid': m}}], recursive := true) FROM c) GROUP BY ALL""",
)
def flagship(spark, d):
    docs = Ledger(spark, d).documents
    r = pipeline.run_pipeline(docs, language=F.element_at("metadata", F.lit("language")))
    lines_ok = F.when(F.col("n_items") == 0, F.lit(False)).otherwise(
        F.coalesce(F.abs(F.col("items_amount") - F.col("totals.total")) <= F.lit(0.02).cast(MONEY), F.lit(True))
    )
    return check_summary(r.select("total_ok", "items_ok", "dates_ok", lines_ok.alias("lines_ok")))


@query(
    "compare_reference",
    f"""WITH {INV} SELECT field, count(*) AS checked, count(*) AS valid, 0 AS invalid FROM (SELECT unnest([
        {{'field': 'document_number', 'v': document_number}}, {{'field': 'issue_date', 'v': CAST(issue_date AS VARCHAR)}}, {{'field': 'due_date', 'v': CAST(due_date AS VARCHAR)}},
        {{'field': 'currency', 'v': currency}}, {{'field': 'total', 'v': CAST(total AS VARCHAR)}}], recursive := true) FROM inv) WHERE v IS NOT NULL GROUP BY field""",
)
def compare_reference(spark, d):
    names = ["document_number", "issue_date", "due_date", "currency", "total"]
    got = unpivot(_pack(spark, d).withColumn("total", F.col("totals.total")), names)
    want = unpivot(Ledger(spark, d).invoices.withColumn("total", F.col("totals.total")), names)
    return comparison_counts(compare_with_reference(got, want))


@query(
    "json_roundtrip",
    f"WITH {INV} SELECT doc_id, document_number, {text('issue_date')} AS issue_date, {text('seller_name')} AS seller_name, {dbl('total')} AS total FROM inv",
)
def json_roundtrip(spark, d):
    texts = files.invoice_json(Ledger(spark, d).invoices)
    back = texts.select(files.parse_invoice_json(F.col("json")).alias("r")).filter("r._corrupt is null")
    return back.select("r.doc_id", "r.document_number", _s("r.issue_date").alias("issue_date"), _s("r.seller.name").alias("seller_name"), _d("r.totals.total").alias("total"))


def _broken(r: DataFrame) -> DataFrame:
    read = files.with_error(r)
    total = F.col("totals.total") if "totals" in read.columns else F.col("total")
    return read.select("doc_id", _s("document_number").alias("document_number"), _s("issue_date").alias("issue_date"), F.coalesce(_d(total), F.lit(-1.0)).alias("total"), _s("error").alias("error"))


def _broken_sql(bad: str) -> str:
    return f"""WITH {INV} SELECT doc_id, CASE WHEN {bad} THEN '' ELSE document_number END AS document_number, CASE WHEN {bad} THEN '' ELSE {text('issue_date')} END AS issue_date,
        CASE WHEN {bad} THEN -1 ELSE coalesce({dbl('total')}, -1) END AS total, CASE WHEN {bad} THEN 'malformed record' ELSE '' END AS error FROM inv"""


@query("broken_json", _broken_sql("doc_id % 3 = 0"))
def broken_json(spark, d):
    """Records as JSON lines on disk, a third of them cut short: each is a row with an error."""
    folder = f"{run_folder(spark)}/json"
    whole = F.col("json")
    cut = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.left(whole, F.length(whole) - 20)).otherwise(whole)
    files.invoice_json(Ledger(spark, d).invoices).select(cut.alias("value")).write.text(folder)
    return _broken(files.read_invoice_json(spark, folder))


@query("broken_csv", _broken_sql("doc_id % 3 = 1"))
def broken_csv(spark, d):
    """The same through the CSV sink; a third of the lines has a cell too many."""
    ledger, folder = Ledger(spark, d), run_folder(spark)
    files.write_flat_csv(ledger.invoices, ledger.items, f"{folder}/csv")
    line = F.col("value")
    bad = F.pmod(F.substring_index(line, ",", 1).try_cast("bigint"), F.lit(3)) == 1
    rows = spark.read.text(f"{folder}/csv/invoices").filter(~line.startswith("doc_id,"))
    rows.select(F.when(bad, F.concat(line, F.lit(",surplus"))).otherwise(line).alias("value")).write.text(f"{folder}/lines")
    return _broken(files.read_flat_csv(spark, f"{folder}/lines", header=False))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.extract_records(Ledger(spark, d).documents, language=F.element_at("metadata", F.lit("language")))


@query(
    "xml_roundtrip",
    f"""WITH {INV}, s AS (SELECT doc_id, {dbl('sum(amount)')} AS amount FROM it GROUP BY doc_id)
        SELECT doc_id, document_number, {text('issue_date')} AS issue_date, currency, {text('buyer_name')} AS buyer_name, n_items, amount, {dbl('coalesce(total, 0)')} AS total
        FROM inv LEFT JOIN s USING (doc_id)""",
)
def xml_roundtrip(spark, d):
    r = markup.parse_eu_xml(markup.to_eu_xml(_records(spark, d)))
    total = F.aggregate("items", F.lit(0).cast(MONEY), lambda a, i: (a + i["amount"]).cast(MONEY))
    return r.select(
        "doc_id", "document_number", _s("issue_date").alias("issue_date"), "currency", _s("buyer.name").alias("buyer_name"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), _d(F.when(F.size("items") > 0, total)).alias("amount"),
        _d("totals.total").alias("total"),
    )


@query("ubl_xml", f"WITH {INV} SELECT doc_id, document_number AS id, CAST(issue_date AS VARCHAR) AS issued, '380' AS code FROM inv")
def ubl_xml(spark, d):
    x = markup.to_ubl_xml(Ledger(spark, d).invoices)

    def tag(name: str) -> Column:
        return F.regexp_extract("xml", f"<{name}>([^<]*)</{name}>", 1)

    return x.select("doc_id", tag("ID").alias("id"), tag("IssueDate").alias("issued"), tag("InvoiceTypeCode").alias("code"))


@query(
    "generic_xml",
    f"WITH {INV} SELECT doc_id, document_number, {text('seller_name')} AS seller_name, {text('buyer_tax_id')} AS buyer_tax_id FROM inv",
)
def generic_xml(spark, d):
    x = markup.to_generic_xml(Ledger(spark, d).invoices, ["document_number", "seller", "buyer"])
    v = x.select("doc_id", markup.read_generic_xml(F.col("xml")).alias("v"))

    def at(path: str) -> Column:
        return F.try_variant_get("v", path, "string")

    # Numeric text comes back as a number, so leading zeros are put back.
    return v.select("doc_id", at("$.document_number").alias("document_number"), _s(at("$.seller.name")).alias("seller_name"), _s(F.lpad(at("$.buyer.tax_id"), 10, "0")).alias("buyer_tax_id"))


@query(
    "html_report",
    f"WITH {INV} SELECT doc_id, n_items + 1 AS n_rows, true AS has_number, true AS has_total FROM inv",
)
def html_report(spark, d):
    h = markup.to_html_report(_records(spark, d).withColumn("_total", F.col("totals.total")))
    return h.select(
        "doc_id", F.size(F.regexp_extract_all("html", F.lit("<tr>"), F.lit(0))).cast("bigint").alias("n_rows"),
        F.contains("html", F.lit("<b>Number</b> INV-")).alias("has_number"), F.contains("html", F.lit("<b>Total</b> ")).alias("has_total"),
    )
