"""Inline documents and the records they must give."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger.functions.doctype import DetectionRule, layout_route
from docledger.functions.text import lines
from docledger.operators import classify as cl, ext, fields, items as it, langpacks, rules
from docledger.plans import pipeline

ENGLISH = """Bill To: Harrow & Finch Bakery
7 Mill Lane, Oakford

From: Lindqvist Printing LLC
88 Quay Road, Port Ellis
VAT: IE90817263X

INVOICE #LP-4471
Date: 2021-03-08
Due Date: 2021-04-07

Description            Qty  Unit Price  Amount
Menu card printing     25     4.80       120.00
Window lettering       2     62.50       125.00

Subtotal: 245.00
VAT (10%): 24.50
Total: 269.50

Payment Terms: Net 30
"""
RECEIPT = """HILLTOP CORNER SHOP
Receipt #5518-2290
Date: 02/19/2022 09:05:47
---------------------------------
ITEM                QTY  PRICE  TOTAL
---------------------------------
GROCERIES
Oats            1.00lb  3.15    3.15
Honey             1     6.40    6.40

SUBTOTAL:               9.55
TAX:                   0.45
TOTAL:                10.00
"""
PIPED = """From: Norwell Garden Care
Tax ID: US445566778

To: Stonebridge Primary School
Tax ID: US112233445

INVOICE #NG-0310
--------------------------------------------------
| Description           | Qty | Unit Price | Total   |
--------------------------------------------------
| Hedge trimming        | 12  | $150.00    | $1,800.00|
| Compost delivery      | 3   | $22.00     | $66.00  |
| Rose bushes           | 1   | $34.00     | $34.00  |
--------------------------------------------------

Subtotal: $1,900.00
Tax (5%): $95.00
Total: $1,995.00

Payment Terms: Net 30

Notes: Please water daily.
"""
POLISH = """FAKTURA FS/77/2022
Sprzedawca:
Drukarnia Borsuk s.c.
NIP: 521-33-44-719

Nabywca:
Kawiarnia Pod Lipami
NIP: 634-20-18-055

Data wystawienia: 2022-09-03
Termin płatności: 2022-09-17

Projekt plakatu         320,00   5    23%   1600,00
Druk ulotek             45,00    20   23%   900,00

Suma netto:     2500,00 PLN
VAT 23%:        575,00 PLN
Razem:          3075,00 PLN
"""
REFUND = """Adobe Systems Software Ireland Ltd
Currency EUR
Invoice Number CR88041
Invoice Date 07-SEP-2021

Bill To
Marlow Design Studio
19 Canal Row
Delft, Netherlands

Customer VAT No: NL445566778
Service Term: 07-SEP-2021 to 06-OCT-2021
PRODUCT NUMBER  PRODUCT DESCRIPTION       QTY  EA  UNIT PRICE  NET AMOUNT  TAX RATE  TAX AMOUNT  TOTAL AMOUNT
70112233       Photo storage plan        1    EA  (13.50)     (13.50)     0.0%      (0.00)      (13.50)
Invoice Total
NET AMOUNT (EUR)  (13.50)
TAXES (SEE DETAILS FOR RATES) (EUR)  (0.00)
GRAND TOTAL (EUR)  (13.50)
"""
EUROPEAN = """Invoice no: 880417
Date 21.06.2022
CLIENT
Fjord Bikes AS
Harbour street 14
VAT no: NO811223344

Product/Service
Gear workshop
Price 40.00
Quantity 3 (pcs)
Sum without VAT
120.00
VAT 25% 30.00
Invoice total 150.00 EUR
Velo Parts OU
Cedar avenue 2
VAT no: EE770011223
IBAN: EE77001
SWIFT: QRSTUVWX
"""


def docs(spark, *texts, **meta):
    rows = [(i, 0, t, "test", dict(meta)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, page INT, text STRING, source STRING, metadata MAP<STRING,STRING>")


def dec(x):
    return Decimal(x).quantize(Decimal("0.0001"))


def test_english_record(spark):
    r = fields.extract_invoice(docs(spark, ENGLISH)).first()
    assert (r.document_number, r.issue_date, r.due_date) == ("LP-4471", dt.date(2021, 3, 8), dt.date(2021, 4, 7))
    assert (r.seller.name, r.seller.tax_id, r.buyer.name) == ("Lindqvist Printing LLC", "IE90817263X", "Harrow & Finch Bakery")
    assert "88 Quay Road" in r.seller.address
    assert (r.totals.subtotal, r.totals.tax_amount, r.totals.total) == (dec(245), dec("24.50"), dec("269.50"))
    assert r.totals.tax_rate == dec(10)
    assert r.payment.terms == "Net 30" and r.payment.terms_days == 30


@pytest.mark.parametrize("method", ["auto", "lines", "header"])
def test_english_items(spark, method):
    rows = it.explode_items(it.extract_items(docs(spark, ENGLISH), method)).orderBy("item_no").collect()
    assert [(r.quantity, r.unit_price, r.amount) for r in rows] == [(dec(25), dec("4.80"), dec(120)), (dec(2), dec("62.50"), dec(125))]
    assert rows[0].description == "Menu card printing"


def test_receipt(spark):
    d = docs(spark, RECEIPT)
    r = fields.extract_invoice(d).first()
    assert (r.document_number, r.issue_date) == ("5518-2290", dt.date(2022, 2, 19))
    assert (r.totals.total, r.totals.tax_amount) == (dec("10.00"), dec("0.45"))
    rows = it.explode_items(it.extract_items(d, "lines")).orderBy("item_no").collect()
    assert [(r.description, r.quantity, r.amount) for r in rows] == [
        ("Oats", dec(1), dec("3.15")), ("Honey", dec(1), dec("6.40")),
    ]


def test_piped_table(spark):
    d = docs(spark, PIPED)
    r = fields.extract_invoice(d).first()
    assert (r.seller.tax_id, r.buyer.name, r.buyer.tax_id) == ("US445566778", "Stonebridge Primary School", "US112233445")
    assert (r.totals.subtotal, r.totals.tax_amount, r.totals.total) == (dec(1900), dec(95), dec(1995))
    assert r.notes == "Please water daily."
    rows = it.explode_items(it.extract_items(d, "header")).orderBy("item_no").collect()
    assert [r.amount for r in rows] == [dec(1800), dec(66), dec(34)]


def test_polish_pack(spark):
    d = docs(spark, POLISH)
    r = langpacks.extract_pack(d, "pl").first()
    assert (r.document_number, r.issue_date, r.due_date, r.currency) == ("FS/77/2022", dt.date(2022, 9, 3), dt.date(2022, 9, 17), "PLN")
    assert (r.seller.name, r.seller.tax_id, r.buyer.name, r.buyer.tax_id) == ("Drukarnia Borsuk s.c.", "5213344719", "Kawiarnia Pod Lipami", "6342018055")
    assert (r.totals.subtotal, r.totals.tax_amount, r.totals.total) == (dec(2500), dec(575), dec(3075))
    rows = it.explode_items(it.extract_items(d, "pl")).orderBy("item_no").collect()
    assert [(r.quantity, r.unit_price, r.amount, r.tax_rate) for r in rows] == [
        (dec(5), dec(320), dec(1600), dec(23)), (dec(20), dec(45), dec(900), dec(23)),
    ]


def test_polish_totals_without_labels(spark):
    r = langpacks.extract_pack(docs(spark, "nr faktury 123\nPLN 100,00\n50.00 PLN\nreverse charge"), "pl").first()
    assert (r.totals.total, r.totals.subtotal, r.totals.tax_amount) == (dec(100), dec(150), dec(0))
    assert r.notes.startswith("Reverse charge")


def test_vendor_refund(spark):
    r = langpacks.extract_vendor(docs(spark, REFUND)).first()
    assert (r.document_number, r.issue_date, r.due_date, r.currency) == ("CR88041", dt.date(2021, 9, 7), dt.date(2021, 10, 6), "EUR")
    assert (r.buyer_name, r.buyer_tax_id) == ("Marlow Design Studio", "NL445566778")
    assert r.buyer_address == "19 Canal Row\nDelft, Netherlands"
    assert (r.subtotal, r.total) == (dec("-13.50"), dec("-13.50"))
    item = r["items"][0]
    assert (item.item_code, item.unit_price, item.net_amount, item.amount) == ("70112233", dec("-13.50"), dec("-13.50"), dec("-13.50"))


def test_vendor_number_layers(spark):
    by_name = langpacks.extract_vendor(docs(spark, REFUND, filename="Adobe_Transaction_No_777_20240831.json")).first()
    assert by_name.document_number == "777"
    by_po = langpacks.extract_vendor(docs(spark, REFUND, po_number="PO9")).first()
    assert by_po.document_number == "PO9"
    token = langpacks.extract_vendor(docs(spark, "see AB12CD34 of 01-02-2023, tel 123456789")).first()
    assert token.document_number == "AB12CD34"


def test_european_layout(spark):
    d = docs(spark, EUROPEAN)
    assert d.select(layout_route(F.col("text"))).first()[0] == "european"
    r = langpacks.extract_european(d).first()
    assert (r.document_number, r.issue_date, r.currency) == ("880417", dt.date(2022, 6, 21), "EUR")
    assert (r.buyer_name, r.buyer_address, r.buyer_tax_id) == ("Fjord Bikes AS", "Harbour street 14", "NO811223344")
    # The client has a tax-id line too; the seller's is the one outside the client's block.
    assert (r.seller_name, r.seller_tax_id) == ("Velo Parts OU", "EE770011223")
    assert (r.subtotal, r.tax_amount, r.total) == (dec(120), dec(30), dec(150))
    assert (r.item_description, r.item_quantity, r.item_unit_price, r.item_tax) == ("Gear workshop", dec(3), dec(40), dec(30))


DUE = [
    ("Due Date: 15/11/2023", dt.date(2023, 11, 15)),
    ("Payment Due: 2023-11-15", dt.date(2023, 11, 15)),
    ("Due on: November 15, 2023", dt.date(2023, 11, 15)),
    ("Payment Due Date: 15-Nov-2023", dt.date(2023, 11, 15)),
    ("Invoice Date: 2023-10-15\nPayment Terms: Net 30 days", dt.date(2023, 11, 14)),
    ("Invoice Date: 2023-10-15\nDue in 30 days", dt.date(2023, 11, 14)),
    ("Invoice Date: 2023-10-15\nNet 30", dt.date(2023, 11, 14)),
    ("Invoice Date: 2023-10-15\nTerms: 30 days net", dt.date(2023, 11, 14)),
    ("Net 30 days", None),
]


def test_due_dates(spark):
    got = fields.with_dates(docs(spark, *[t for t, _ in DUE])).orderBy("doc_id").collect()
    assert [r.due_date for r in got] == [d for _, d in DUE]


ISSUE = ["Invoice Date: 15/10/2023", "Date: 2023-10-15", "Issued on: October 15, 2023", "Document Date: 15-Oct-2023", "Date 15102023"]


def test_issue_dates(spark):
    got = fields.with_dates(docs(spark, *ISSUE)).collect()
    assert {r.issue_date for r in got} == {dt.date(2023, 10, 15)}


def test_terms_by_language(spark):
    table = {
        "Payment Terms: Net 30": "Net 30", "Zahlungsbedingungen: 14 Tage": "14 Tage", "Conditions de paiement: 30 jours": "30 jours",
        "Condiciones de pago: 30 días": "30 días",
    }
    got = docs(spark, *table).select("doc_id", fields.payment_terms("text").alias("t")).orderBy("doc_id").collect()
    assert [r.t for r in got] == list(table.values())


def test_order_metadata_discount_share(spark):
    text = "Purchase Order: PO-77\nRef: R-5\nDelivery date: 01.02.2023\nDiscount: 10%\nShipping: $5.00"
    d = docs(spark, text).withColumn("subtotal", F.lit(200).cast("decimal(18,4)"))
    r = fields.with_order_metadata(d).first()
    assert (r.order_number, r.reference_number, r.delivery_date) == ("PO-77", "R-5", dt.date(2023, 2, 1))
    assert (r.discount, r.shipping) == (dec(20), dec(5))


LABELLED = """INVOICE

Invoice No: TK-2208
Date: 01/01/2023
Due Date: 31/01/2023

Vendor: Brightwater Tiles
Tax ID: 5566778899

Customer: Mara Quill

Subtotal: 80.00
Tax (19%): 15.20
Total: 95.20

Currency: USD
"""


def test_default_rules(spark):
    info = {r.field: r for r in rules.extract_with_info(docs(spark, LABELLED), rules.DEFAULT_FIELD_RULES).collect()}
    want = {
        "invoice_number": "TK-2208", "issue_date": "01/01/2023", "due_date": "31/01/2023", "vendor_name": "Brightwater Tiles",
        "vendor_tax_id": "5566778899", "customer_name": "Mara Quill", "tax_rate": "19%", "currency": "USD", "total_amount": "95.20",
    }
    assert {k: info[k].value for k in want} == want
    assert all(info[k].valid for k in want)
    assert LABELLED[info["invoice_number"].match_pos :].startswith(info["invoice_number"].match_text)


def test_rule_overrides(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('{"currency": "cur=([A-Z]+)", "number": {"pattern": "no ([0-9]+)", "fallback_patterns": ["nr ([0-9]+)"]}}')
    loaded = rules.load_rules(str(path), spark, rules.DEFAULT_FIELD_RULES)
    own = rules.register_pattern(loaded, "buyer", r"buyer=(\w+)")
    r = rules.extract_wide(docs(spark, "cur=EUR nr 5 buyer=me"), [x for x in own if x.field in ("currency", "number", "buyer")]).first()
    assert (r.currency, r.number, r.buyer) == ("EUR", "5", "me")


def test_merge_next_line(spark):
    text = "Plan A 1 $20.00 $20.00\nJan 1 2024 - Jan 31 2024\nPlan B 1 $5.00 $5.00"
    merged = docs(spark, text).select(it.merge_next_line(lines(F.col("text"))).alias("m")).first().m
    assert merged == ["Plan A (Jan 1 2024 - Jan 31 2024) 1 $20.00 $20.00", "Plan B 1 $5.00 $5.00"]


def test_generic_shapes(spark):
    text = "Widgets 3 pcs 2.00 6.00\n2 x Gadget @ 4.50 9.00\n4 Bolts 0.25 1.00\nSetup fee - 15.00\nTotal 31.00"
    rows = docs(spark, text).select(it.items_by_pattern(lines(F.col("text"))).alias("i")).first().i
    assert [(r.description, r.quantity, r.unit_price, r.amount) for r in rows] == [
        ("Widgets", dec(3), dec(2), dec(6)), ("Gadget", dec(2), dec("4.5"), dec(9)), ("Bolts", dec(4), dec("0.25"), dec(1)),
        ("Setup fee", dec(1), dec(15), dec(15)),
    ]


def test_english_shapes(spark):
    text = "2 x Lamp @ $10.00 = $20.00\nDesk organiser  $35.50"
    rows = docs(spark, text).select(it.items_en(lines(F.col("text"))).alias("i")).first().i
    assert [(r.description, r.quantity, r.amount) for r in rows] == [("Lamp", dec(2), dec(20)), ("Desk organiser", dec(1), dec("35.5"))]


def test_detection(spark):
    own = [
        DetectionRule("a", "p", ["alpha", "beta"], priority=1, min_matches=1, threshold=0.5),
        DetectionRule("b", "m", keys={"source": ["web"]}, priority=1),
        DetectionRule("c", "p", ["gamma", "delta", "eps"], min_matches=2),
    ]
    rows = cl.detect_type(docs(spark, "ALPHA", "gamma", "gamma delta", "", source="file"), own).orderBy("doc_id").collect()
    assert [r.doc_type for r in rows] == ["a", "unknown", "c", "unknown"]
    assert cl.detect_type(docs(spark, "x", source="The Web"), own).first().doc_type == "b"


def test_default_detection_needs_three_of_five(spark):
    rows = cl.detect_type(docs(spark, REFUND, RECEIPT, "Invoice # Bill To", "Invoice # Bill To Due Date")).orderBy("doc_id").collect()
    assert [r.doc_type for r in rows] == ["adobe_invoice", "receipt", "unknown", "invoice"]


def test_routing_tree(spark):
    typed = docs(spark, ENGLISH).withColumns(
        {"doc_type": F.lit("invoice"), "type_confidence": F.lit(0.9), "language": F.lit("pl"), "has_tables": F.lit(True)}
    )
    assert cl.route_tree(typed).first().extractor == "default"
    tree = cl.update_tree(cl.default_tree(), ["invoice", "language", "pl"], cl.RouteNode("polish"))
    assert cl.route_tree(typed, tree).first().extractor == "polish"
    strict = cl.update_tree(tree, ["invoice"], cl.RouteNode("late", confidence_threshold=0.95))
    assert cl.route_tree(typed, strict).first().extractor == "default"
    merged = cl.route_extractor(typed, {"pl": {"due_date": "x"}}, {"tax_amount": "y"}).first()
    assert merged.extractor == "table" and merged.rules["due_date"] == "x" and merged.rules["tax_amount"] == "y"


def test_pipeline_reports_bad_documents(spark):
    rows = {r.doc_id: r for r in pipeline.run_pipeline(docs(spark, ENGLISH, None, "  ", "Date: 99/99/9999 Total: 1.2.3.4")).collect()}
    assert len(rows) == 4
    assert rows[0].error is None and rows[0].document_number == "LP-4471"
    assert rows[1].error == "no text" and rows[2].error == "empty text"
    assert rows[3].error is None and rows[3].issue_date is None


def test_each_route_gives_its_record(spark):
    rows = {r.doc_id: r for r in pipeline.run_pipeline(docs(spark, ENGLISH, REFUND, EUROPEAN, POLISH, RECEIPT)).collect()}
    assert [rows[i].extractor for i in range(3)] == ["default", "vendor", "european"]
    assert (rows[1].document_number, rows[1].issue_date, rows[1].due_date, rows[1].buyer.name) == ("CR88041", dt.date(2021, 9, 7), dt.date(2021, 10, 6), "Marlow Design Studio")
    assert (rows[1].totals.subtotal, rows[1].totals.total, rows[1].n_items) == (dec("-13.50"), dec("-13.50"), 1)
    assert (rows[2].document_number, rows[2].seller.name, rows[2].buyer.name, rows[2].currency) == ("880417", "Velo Parts OU", "Fjord Bikes AS", "EUR")
    assert (rows[2].totals.subtotal, rows[2].totals.total, rows[2].items_amount, rows[2].items_ok) == (dec(120), dec(150), dec(120), True)
    assert (rows[3].document_number, rows[3].totals.total, rows[3].n_items) == ("FS/77/2022", dec(3075), 2)
    assert (rows[4].doc_type, rows[4].totals.total) == ("receipt", dec(10))


def test_extension_points(spark):
    d = docs(spark, ENGLISH, "nothing").withColumn("doc_type", F.lit("invoice"))
    reg = ext.Extractors().register("invoice", lambda x: rules.candidates(x, rules.DEFAULT_FIELD_RULES, "own"))
    assert reg.extract(d).filter("field = 'invoice_number'").count() == 1
    hooked = ext.with_items_hook(
        d, lambda t: F.filter(it.items_by_pattern(lines(t)), lambda i: F.lit(False)), lambda t: it.items_by_lines(lines(t))
    )
    assert hooked.filter("doc_id = 0").select(F.size("items")).first()[0] == 2


def test_items_table_function(spark):
    ext.register_items_function(spark)
    docs(spark, "2 x Gadget @ 4.50 9.00\nSetup fee - 15.00").createOrReplaceTempView("some_docs")
    rows = spark.sql("SELECT d.doc_id, i.* FROM some_docs d, LATERAL invoice_items(d.text) i ORDER BY item_no").collect()
    assert [(r.description, r.quantity, r.amount) for r in rows] == [("Gadget", "2", "9.00"), ("Setup fee", None, "15.00")]


def test_model_extraction_reads_whole_texts(spark):
    def load():
        def score(question, context):
            at = context.find("TOTAL=")
            if "total amount" in question and at >= 0:
                return context[at + 6 : at + 11], 0.9
            return "x", 0.1

        return score

    long = "filler " * 4000 + "TOTAL=12.50 end"
    found = ext.model_extract(docs(spark, long), load).collect()
    assert [(r.field, r.value) for r in found] == [("total_amount", "12.50")]
    assert found[0].match_pos == long.find("12.50")
