"""Items named after summary words, sections of items, and texts with very long runs of one character."""

import time

import pytest
from pyspark.sql import functions as F

from docledger.functions.text import lines
from docledger.operators import ext, items as it
from docledger.plans import pipeline

HEAD = "INVOICE\nInvoice number: A-17\nInvoice date: 2024-03-01\nSeller: North Works\nBill to: South Shop\nDescription   Qty   Price   Amount\n"
FOOT = "Subtotal: {0}\nTax (0%): 0.00\nTotal: {0} USD\n"
NAMES = ["Tax consulting", "Total station tripod", "Discount vouchers", "Payment terminal", "Shipping crate", "Balance board", "Subtotal stamp"]


def _documents(spark):
    body = "".join(f"{n}   2   10.00   20.00\n" for n in NAMES)
    return spark.createDataFrame([(1, HEAD + body + FOOT.format(f"{20 * len(NAMES)}.00"))], "doc_id long, text string")


def test_items_named_after_summary_words_are_items(spark):
    row = pipeline.run_pipeline(_documents(spark), language=F.lit("en")).first()
    assert [i["description"] for i in row["items"]] == NAMES
    assert row["error"] is None and row["items_amount"] == 20 * len(NAMES)


@pytest.mark.parametrize(
    "line, summary",
    [("Total: 5.00", True), ("  TOTAL 5.00 EUR", True), ("Grand total ........ 5.00", True), ("Tax (23%): 1.15", True), ("Sales tax 8.25 % 4.00", True), ("Total before tax 3.00", True),
     ("Amount due: $7.00", True), ("Shipping and handling 4.00", True), ("Payment method: card", True), ("| Subtotal | 9.00 |", True), ("VAT", True), ("Discount -2,00 zł", True),
     ("Tax consulting 1 5.00 5.00", False), ("Total station 1 5.00", False), ("Taxi ride 12.00", False), ("Totally fine mug 2.00", False), ("Payment terminal 9.00", False), ("Widget, total set 3.00", False),
     ("Tax pen 3.00", False), ("", False)],
)
def test_summary_lines_are_told_by_their_form(spark, line, summary):
    assert spark.createDataFrame([(line,)], "line string").select(it.is_summary(F.col("line"))).first()[0] is summary


def test_sections_begin_at_a_heading_and_end_at_a_sum(spark):
    texts = {
        "a\nDescription   Qty   Price\nTax book 1 2.00\nTotal: 2.00\nb": "Tax book 1 2.00",
        "a\nItems:\nPen 1.00\nInk 2.00": "Pen 1.00\nInk 2.00",
        "GROCERIES\nMilk 1.00\nSubtotal 1.00": "Milk 1.00",
        "We sell items of any price.\nPen 1.00": None,
    }
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", it.item_section(F.col("text")).alias("s")).collect()
    assert {r["text"]: r["s"] for r in rows} == {t: s if s is not None else t for t, s in texts.items()}


def test_the_table_function_keeps_the_same_items(spark):
    ext.register_items_function(spark, "items_of_test")
    _documents(spark).createOrReplaceTempView("named_items")
    text = "Tax guide 2 pcs 10.00 20.00\nTotal station - 300.00\nTotal - 320.00"
    spark.createDataFrame([(1, text)], "doc_id long, text string").createOrReplaceTempView("named_items")
    rows = spark.sql("SELECT i.* FROM named_items d, LATERAL items_of_test(d.text) i").collect()
    assert [(r["description"], r["amount"]) for r in rows] == [("Tax guide", "20.00"), ("Total station", "300.00")]
    own = spark.table("named_items").select(it.items_by_pattern(lines(F.col("text"))).alias("i")).first()["i"]
    assert [i["description"] for i in own] == ["Tax guide", "Total station"]


def test_no_text_stalls_a_pattern(spark):
    n = 100_000
    runs = [f"Seller:{' ' * n}Total:{' ' * n}x", "Total" + "\t " * n, "7" * n, "7 " * n, "1." * n, "(" * n, "[" * n, "-" * n, "Tax (" + "9" * n, ": " * n, "total " * 10_000, "a" * n + "@", "Net " * 20_000, "\n" * n, ". " * n]
    langs = ["en", "pl", "de", "es", "fr"]
    docs = spark.createDataFrame([(i, HEAD + r + "\n" + FOOT.format("1.00"), lang) for i, r in enumerate(runs) for lang in langs], "doc_id long, text string, lang string").repartition(8)
    start = time.time()
    rows = pipeline.run_pipeline(docs, language=F.col("lang")).select("doc_id", "document_number", "error").collect()
    assert len(rows) == len(runs) * len(langs) and all(r["error"] is None for r in rows)
    # Two seconds for each text of a task, its start included.
    assert time.time() - start < 2 * len(rows) / 8 + 20
