"""Validation, consistency, merging, formats and job analytics on small tables."""

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docledger import schemas
from docledger.operators import consistency as co, grounding as gr, items as it, jsonops, merge, validate as va
from docledger.plans import catalog, jobstats as js, pipeline
from docledger.sources import files, ledger, markup

AS_OF = dt.date(2025, 6, 20)


def record(**change):
    base = {
        "doc_id": 1, "document_number": "FV/2025/001", "issue_date": "2025-06-15", "due_date": "2025-07-15", "currency": "PLN",
        "seller": {"name": "Seller Ltd", "address": "Street 1", "tax_id": "1234567890", "phone": "+48 123", "email": "a@b.com"},
        "buyer": {"name": "Buyer Ltd", "address": "Street 2", "tax_id": "9876543210", "phone": "+48 456", "email": "c@d.com"},
        "totals": {"subtotal": 7600, "tax_rate": 23, "tax_amount": 1748, "total": 9348, "currency": "PLN"},
        "payment": {"method": "przelew", "bank_account": "PL61"}, "notes": "n",
    }
    base.update(change)
    return base


ITEMS = [
    {"doc_id": 1, "item_no": 1, "description": "Programming services", "quantity": 40, "unit_price": 150, "amount": 6000, "currency": "PLN"},
    {"doc_id": 1, "item_no": 2, "description": "Consulting", "quantity": 8, "unit_price": 200, "amount": 1600, "currency": "PLN"},
]


def table(spark, rows, schema):
    texts = spark.createDataFrame([(json.dumps(r),) for r in rows], "j STRING")
    return texts.select(F.from_json("j", schema, {"dateFormat": "yyyy-MM-dd"}).alias("r")).select("r.*")


def invoices(spark, *rows, extra=""):
    return table(spark, rows, schemas.INVOICE + extra)


def items(spark, rows=ITEMS):
    return table(spark, rows, schemas.INVOICE_ITEMS)


def run(spark, profile, rec, rows=ITEMS, extra=""):
    v = va.validate(invoices(spark, rec, extra=extra), items(spark, rows), profile, F.lit(AS_OF)).first()
    found = va.findings(invoices(spark, rec, extra=extra), items(spark, rows), profile, F.lit(AS_OF)).collect()
    assert v.n_errors == sum(f.severity == "error" for f in found)
    assert v.n_warnings == sum(f.severity == "warning" for f in found)
    return v, {(f.check_name, f.field) for f in found}


@pytest.mark.parametrize("profile", va.PROFILES)
def test_complete_record_is_valid(spark, profile):
    v, found = run(spark, profile, record())
    assert v.is_valid and not found
    assert v.score > 0.8


@pytest.mark.parametrize(
    ("change", "rows", "want"),
    [
        ({"issue_date": "2025-12-15", "due_date": None}, ITEMS, ("date_future", "issue_date")),
        ({"due_date": "2025-06-01"}, ITEMS, ("due_before_issue", "due_date")),
        ({"due_date": "2027-06-01"}, ITEMS, ("due_late", "due_date")),
        ({"issue_date": "2010-06-15"}, ITEMS, ("date_old", "issue_date")),
        ({"document_number": "A"}, ITEMS, ("number_short", "document_number")),
        ({"seller": None}, ITEMS, ("missing", "seller")),
        ({}, [], ("items_empty", "items")),
        ({}, [{**ITEMS[0], "quantity": -1}, ITEMS[1]], ("amount_product", "amount")),
        ({}, [{**ITEMS[0], "amount": 1}, ITEMS[1]], ("subtotal_items", "totals.subtotal")),
        ({"buyer": {"name": "Seller Ltd", "tax_id": "55555555"}}, ITEMS, ("same_name", "buyer.name")),
        ({"seller": {"name": "S & Co", "tax_id": "12345678", "email": "nope"}}, ITEMS, ("email", "seller.email")),
    ],
)
def test_findings(spark, change, rows, want):
    profile = "component" if want[0] == "amount_product" else "strict"
    _, found = run(spark, profile, record(**change), rows)
    assert want in found


def test_only_a_number(spark):
    v, found = run(spark, "strict", {"doc_id": 1, "document_number": "X-1"}, [])
    assert {f for c, f in found if c in ("missing", "items_empty")} == {"document_date", "seller", "buyer", "items", "totals"}
    assert not v.is_valid and v.score < 0.5


def test_unreadable_date(spark):
    rec = record(issue_date=None, issue_date_raw="soon")
    _, found = run(spark, "strict", rec, extra=", issue_date_raw STRING")
    assert ("date_format", "issue_date") in found and ("missing", "document_date") not in found


def test_component_cross_fields(spark):
    _, found = run(spark, "component", record(payment={"method": "cash", "bank_account": "PL61"}))
    assert ("cash_account", "payment.bank_account") in found
    v, found = run(spark, "component", record(), [*ITEMS, {**ITEMS[1], "description": " consulting "}])
    assert ("duplicate_item", "items") in found


CONSISTENT = {"total": "1234.56", "subtotal": "1124.56", "tax": "110.00", "rate": "9.8"}


@pytest.mark.parametrize(
    ("change", "total_ok", "tax_ok"),
    [({}, True, True), ({"total": "1300"}, False, True), ({"total": None}, False, True), ({"tax": None, "subtotal": "1234.56"}, True, False),
     ({"tax": "150"}, False, False), ({"rate": None}, True, True), ({"rate": None, "tax": "500"}, False, False)],
)
def test_totals_consistency(spark, change, total_ok, tax_ok):
    row = {**CONSISTENT, **change}
    c = {k: F.lit(v).cast("decimal(18,4)") for k, v in row.items()}
    got = spark.range(1).select(
        co.total_consistent(c["total"], c["subtotal"], c["tax"]), co.tax_consistent(c["subtotal"], c["tax"], c["rate"])
    ).first()
    assert tuple(got) == (total_ok, tax_ok)


def test_dates_and_currency_consistency(spark):
    d = lambda s: F.lit(s).cast("date")
    got = spark.range(1).select(
        co.dates_consistent(d("2023-01-01"), d("2023-02-01")), co.dates_consistent(d("2023-03-01"), d("2023-02-01")),
        co.dates_consistent(d("2023-01-01"), d("2025-02-01")), co.dates_consistent(d(None), d("2025-02-01")),
        co.currency_offenders(F.lit("USD"), {"total": F.lit("$5"), "tax": F.lit("€5")}, F.array(F.lit("5 USD"), F.lit("5"))),
        co.currency_consistent(F.lit(None).cast("string"), {"total": F.lit("5")}),
    ).first()
    assert list(got) == [True, False, False, True, ["tax", "items[1].amount"], True]


def test_perturbing_one_total_flips_one_document(spark):
    recs = [record(doc_id=i) for i in range(20)]
    lines = [{**r, "doc_id": i} for i in range(20) for r in ITEMS]
    base = {r.doc_id: r.total_ok for r in co.check_all(invoices(spark, *recs), items(spark, lines)).collect()}
    recs[7]["totals"] = {**recs[7]["totals"], "total": 99999}
    moved = {r.doc_id: r.total_ok for r in co.check_all(invoices(spark, *recs), items(spark, lines).repartition(7)).collect()}
    assert {i for i in base if base[i] != moved[i]} == {7}


def test_compare_with_reference(spark):
    schema = "doc_id BIGINT, field STRING, value STRING"
    got = spark.createDataFrame([(1, "a", "x"), (1, "b", "y"), (1, "d", "z")], schema)
    want = spark.createDataFrame([(1, "a", "x"), (1, "b", "q"), (1, "c", "w")], schema)
    rows = {r.field: r.status for r in co.compare_with_reference(got, want).collect()}
    assert rows == {"a": "valid", "b": "invalid", "c": "missing", "d": "extra"}


def test_allocation(spark):
    rows = [{"doc_id": 1, "description": d, "quantity": q, "amount": a} for d, q, a in [("a", 1, 10), ("b", 2, None), ("c", 1, None)]]
    rows += [{"doc_id": 2, "description": "d", "quantity": 4, "amount": None}]
    totals = spark.createDataFrame([(1, 30), (2, 8)], "doc_id BIGINT, total INT").withColumn("total", F.col("total").cast("decimal(18,4)"))
    got = {r.description: (r.amount, r.unit_price) for r in it.allocate_missing(items(spark, rows), totals).collect()}
    assert got["b"] == (Decimal(10), Decimal(5)) and got["c"] == (Decimal(10), Decimal(10)) and got["d"] == (Decimal(8), Decimal(2))


def test_dedupe_keeps_the_first(spark):
    rows = [{**ITEMS[0], "item_no": i, "description": f"{' ' * i}x", "unit": str(i)} for i in (3, 1, 2)]
    got = it.dedupe_items(items(spark, rows)).collect()
    assert [(r.item_no, r.unit) for r in got] == [(1, "1")]


def test_grounding_modes(spark):
    df = spark.createDataFrame([(1, "Invoice 77 from Acme Corporation", "77", "acme corporatin")], "doc_id BIGINT, text STRING, n STRING, s STRING")
    values = {"n": F.col("n"), "s": F.col("s")}
    assert gr.grounding(df, values).first().grounded is False
    assert gr.grounding(df, values, mode="ngram").first().grounded is True
    assert gr.grounding(df, {"n": F.col("n")}, issues=F.lit(1)).first().grounded is False


def test_grounding_reads_all_items(spark):
    df = spark.sql("SELECT 1L AS doc_id, 'a b c d' AS text, array(named_struct('description','a'), named_struct('description','b'), named_struct('description','c'), named_struct('description','zz')) AS items")
    assert gr.grounding(df, {}, items="items").first().n_fields == 4
    assert gr.grounding(df, {}, items="items", max_items=3).first().share == 1.0


def test_json_tools(spark):
    df = spark.createDataFrame([('{"a": {"k": 1}, "l": [{"k": "x", "z": null}], "k": [2]}',), ("{bad",), (None,)], "j STRING")
    rows = df.select(jsonops.json_find_key(F.col("j"), "k").alias("v")).collect()
    assert [r.v for r in rows] == [["1", "x", "[2]"], [], []]
    kept = df.select(jsonops.json_filter(F.col("j"), exclude=["k"]).alias("v")).first().v
    assert json.loads(kept) == {"a": {}, "l": [{"z": None}]}
    dropped = df.select(jsonops.json_filter(F.col("j"), equals={"k": 1}).alias("v")).first().v
    assert dropped is None
    assert df.select(jsonops.json_try_parse(F.col("j"), "{}").isNotNull()).distinct().count() == 1


def test_files(spark, tmp_path):
    (tmp_path / "2024.05" / "attachments").mkdir(parents=True)
    (tmp_path / "2024.05" / "attachments" / "a.PDF").write_bytes(b"%PDF-1.7 rest of it")
    (tmp_path / "b.pdf").write_bytes(b"no")
    (tmp_path / "c.txt").write_text("hello\nworld")
    assert files.scan_files(spark, str(tmp_path), ["pdf"]).count() == 1
    assert files.scan_files(spark, str(tmp_path), [".pdf"], recursive=True).count() == 2
    probe = {r.path.rsplit("/", 1)[1]: r.is_valid for r in files.file_probe(files.scan_files(spark, str(tmp_path), ["pdf"], True)).collect()}
    assert probe == {"a.PDF": True, "b.pdf": False}
    assert files.scan_month(spark, str(tmp_path), 2024, 5).count() == 1
    today = dt.date.today()
    assert files.scan_month(spark, str(tmp_path), today.year, today.month, by="modified").count() == 3
    docs = files.read_text_docs(spark, str(tmp_path / "c.txt")).first()
    assert docs.text == "hello\nworld" and docs.metadata["filename"] == "c.txt"


def test_pages(spark):
    text = "one\n--- PAGE 1 ---\ntwo\n--- PAGE 2 ---\nthree"
    df = spark.createDataFrame([(1, text)], "doc_id BIGINT, text STRING")
    assert [r.text for r in files.explode_pages(df).orderBy("page").collect()] == ["one", "two", "three"]
    assert files.explode_pages(df, 2).count() == 2
    assert df.select(files.join_pages(F.col("text"), 2)).first()[0] == "one\ntwo"


def test_json_files_with_a_bad_record(spark, tmp_path):
    src = tmp_path / "in.json"
    src.write_text(json.dumps(record()) + "\n{broken\n")
    rows = files.read_invoice_json(spark, str(src)).collect()
    assert [r._corrupt is None for r in rows] == [True, False]
    out = tmp_path / "out"
    files.write_invoice_json(invoices(spark, record()), str(out))
    assert files.read_invoice_json(spark, str(out)).first().totals.total == Decimal("9348")
    files.write_flat_csv(invoices(spark, record()), items(spark), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv" / "items")).count() == 2


def test_xml_files(spark, tmp_path):
    rec = invoices(spark, record(seller={"name": "A & <B>", "address": "Street 1\nTown"})).withColumn(
        "items", F.expr("array(named_struct('description','x','quantity',2,'unit_price',3,'amount',6,'tax_rate',cast(null as decimal(18,4)),'tax_amount',cast(null as decimal(18,4))))")
    )
    xml = markup.to_eu_xml(rec, F.lit("PL"))
    text = xml.first().xml
    assert '<TaxAmount currencyID="PLN">1.38</TaxAmount>' in text and "<CountryCode>PL</CountryCode>" in text
    markup.write_xml(xml.withColumn("xml", F.regexp_replace("xml", "\n", " ")), str(tmp_path / "x"))
    back = markup.read_invoice_xml(spark, str(tmp_path / "x")).first()
    assert (back.document_number, back.seller.name, back.seller.address) == ("FV/2025/001", "A & <B>", "Street 1\nTown")
    assert back.totals.total == Decimal(9348) and back["items"][0].amount == Decimal(6)


def test_html_report_escapes(spark):
    rec = invoices(spark, record(seller={"name": "<script>"})).withColumn("items", F.expr("array(named_struct('description','a<b','quantity',1,'unit_price',2,'amount',2))"))
    html = markup.to_html_report(rec).first().html
    assert "&lt;script&gt;" in html and "a&lt;b" in html and "9348.00" in html
    assert markup.html_to_text(F.lit(html)) is not None


def test_long_documents_are_paged(spark):
    """A document that owns most lines is spread over pages of consecutive lines; nothing is lost."""
    n = 1000
    rows = [(1 if i % 3 else 2 + i, 7, 3, i + 1 if i % 3 else 1, 2.0, 5.0, 0.0, 0.0, "N", "O", dt.datetime(1995, 1, 1)) for i in range(n)]
    line = spark.createDataFrame(rows, "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP")
    orders = line.select("l_orderkey").distinct().selectExpr("l_orderkey o_orderkey", "1L o_custkey", "'O' o_orderstatus", "1.0D o_totalprice", "timestamp'1995-01-01' o_orderdate", "'2-HIGH' o_orderpriority")
    cust = spark.sql("SELECT 1L c_custkey, 'C' c_name, 1 c_nationkey, 0.0D c_acctbal, 'BUILDING' c_mktsegment")
    supp = spark.sql("SELECT 3L s_suppkey, 'S' s_name, 1 s_nationkey, 0.0D s_acctbal")
    nation = spark.sql("SELECT 1 n_nationkey, 'N' n_name, 1 n_regionkey")
    its = ledger.ledger_items(line)
    tot = ledger.ledger_totals(its)
    docs = ledger.render_documents(ledger.ledger_invoices(orders, tot, cust, supp, nation), its, page_lines=50)
    per = docs.withColumn("n", F.size(F.split("text", "Part 7 stock")) - 1).cache()
    assert per.agg(F.sum("n")).first()[0] == n
    assert per.filter("doc_id = 1").count() > 8
    assert per.agg(F.max("n")).first()[0] <= 50
    whole = pipeline.run_paged(docs).filter("doc_id = 1").first()
    assert whole.n_items == len(whole["items"]) == 666 and whole.items_ok


@pytest.mark.parametrize("run", ["7 ", "1.", "(", " ", "7", "1,234 ", "a@"])
def test_long_runs_stop_nothing(spark, run):
    text = "INVOICE #INV-1\nInvoice Number: INV-1\nDescription   Quantity   Unit Price   Amount\nPart 1 stock   1   5.00   5.00\n\nSubtotal: 5.00\nTotal: 5.00\nNet 2147483647 days\n"
    docs = spark.createDataFrame([(1, text + run * 10_000, None)], "doc_id BIGINT, text STRING, metadata MAP<STRING,STRING>")
    row = pipeline.run_pipeline(docs, F.lit("en")).first()
    assert (row.document_number, row.n_items, row.totals.total, row.error) == ("INV-1", 1, Decimal(5), None)


@pytest.mark.parametrize("n", [499, 500, 501, 5_000])
def test_the_size_of_a_document_changes_nothing(spark, n):
    line = spark.range(1, n + 1).selectExpr("1L l_orderkey", "id l_partkey", "3L l_suppkey", "CAST(id AS INT) l_linenumber", "2.0D l_quantity", "5.0D l_extendedprice", "0.0D l_discount", "0.0D l_tax")
    orders = spark.sql("SELECT 1L o_orderkey, 1L o_custkey, 'O' o_orderstatus, 1.0D o_totalprice, timestamp'1995-01-01' o_orderdate, '2-HIGH' o_orderpriority")
    cust = spark.sql("SELECT 1L c_custkey, 'C' c_name, 0 c_nationkey, 0.0D c_acctbal, 'BUILDING' c_mktsegment")
    supp = spark.sql("SELECT 3L s_suppkey, 'S' s_name, 1 s_nationkey, 0.0D s_acctbal")
    nation = spark.sql("SELECT 0 n_nationkey, 'N' n_name, 1 n_regionkey")
    its = ledger.ledger_items(line)
    inv = ledger.ledger_invoices(orders, ledger.ledger_totals(its), cust, supp, nation)
    for docs in (ledger.render_documents(inv, its), ledger.render_documents(inv, its, page_lines=500)):
        rows = pipeline.run_paged(docs).collect()
        assert [(r.n_items, len(r["items"]), r.items_ok, r.total_ok, r.document_number, r.error) for r in rows] == [(n, n, True, True, "INV-00000001", None)]
        assert [i.description for i in rows[0]["items"]] == [f"Part {i} stock" for i in range(1, n + 1)]


JOB = "job_id STRING, status STRING, input_format STRING, output_format STRING, file_size BIGINT, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP"


def test_jobs_that_never_ran_have_no_mean(spark):
    now = dt.datetime(2024, 1, 31)
    jobs = spark.createDataFrame([("a", "completed", "pdf", "json", 10, now, None, None)], JOB)
    assert js.conversion_summary(jobs, now).first().avg_seconds is None


def test_retention_rewrites_only_old_days(spark, tmp_path):
    now = dt.datetime(2024, 3, 1)
    old, new = now - dt.timedelta(days=40), now - dt.timedelta(days=1)
    jobs = spark.createDataFrame([("a", "completed", "p", "j", 1, old, None, None), ("b", "pending", "p", "j", 1, old, None, None), ("c", "failed", "p", "j", 1, new, None, None)], JOB)
    path = str(tmp_path / "jobs")
    jobs.withColumn("day", F.to_date("created_at")).write.partitionBy("day").parquet(path)
    js.apply_retention(spark.createDataFrame(jobs.collect(), JOB), path, now)
    assert {r.job_id for r in spark.read.parquet(path).collect()} == {"b", "c"}


def test_views(spark):
    now = dt.datetime(2024, 1, 31)
    jobs = spark.createDataFrame([("a", "completed", "pdf", "json", 10, now, now, now)], JOB)
    ocr = spark.createDataFrame([("a", 0.9, "en", "e", 1.0, now)], "job_id STRING, confidence DOUBLE, language STRING, engine STRING, processing_time DOUBLE, created_at TIMESTAMP")
    calls = spark.createDataFrame([("/x", 200, 0.5, now)], "endpoint STRING, status_code INT, response_time DOUBLE, ts TIMESTAMP")
    js.register_views(jobs, ocr, calls, now)
    assert spark.sql("SELECT request_count FROM api_performance").first()[0] == 1


def test_words_below_the_limit_are_dropped(spark):
    rows = [(1, 0, "e", 0, 0, i, w, c, 0, 0, 1, 1, 10, 10) for i, (w, c) in enumerate([("a", 90), ("b", 30), ("c", 31)])]
    t = merge.words_to_text(spark.createDataFrame(rows, schemas.OCR_WORDS)).first()
    assert (t.text, t.n_words) == ("a c", 2)


def test_ngrams_of_a_value_are_searched_in_the_text(spark):
    """The n-grams of the text are never listed; short values and texts are compared as a whole."""
    rows = [("Invoice of Acme Corp", "acme corp?"), ("ab", "AB"), ("xabx", "AB"), ("", "a"), ("Größe 😀 Öl", "größe 😀?"), (None, "abc")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id BIGINT, text STRING, v STRING")
    g = gr.grounding(df, {"v": F.col("v")}, mode="ngram")
    assert "split(lower(text" not in g._jdf.queryExecution().optimizedPlan().toString()
    got = {r.doc_id: r.fields[0].confidence for r in g.collect()}
    assert got == {0: 7 / 8, 1: 1.0, 2: 0.0, 3: 0.0, 4: 5 / 6, 5: 0.0}


def test_words_of_a_block_move_once(spark):
    rows = [(1, 0, 0, line, w, t) for line, w, t in [(1, 3, "d"), (0, 1, "b"), (0, 0, "a"), (1, 2, "c"), (2, 4, None), (None, 5, "x"), (3, 6, "e"), (3, 7, None), (3, 8, "f")]]
    rows += [(2, 1, 7, 70 + i // 10, i, f"w{i}") for i in reversed(range(40))]
    words = spark.createDataFrame(rows, "doc_id BIGINT, page INT, block_no INT, line_no INT, word_no INT, text STRING")
    out = merge.layout_text(words)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    got = {r.doc_id: (r.block_no, r.text, r.n_lines) for r in out.collect()}
    assert got[1] == (0, "x\na b\nc d\n\ne f", 5)
    assert got[2] == (7, "\n".join(" ".join(f"w{10 * k + i}" for i in range(10)) for k in range(4)), 4)


def test_findings_of_both_profiles_come_from_one_pass(spark):
    rec, rows = record(document_number="", due_date="2020-01-01"), [*ITEMS, {**ITEMS[0], "amount": -5}]
    both = va.findings(invoices(spark, rec), items(spark, rows), va.PROFILES, F.lit(AS_OF))
    apart = [va.findings(invoices(spark, rec), items(spark, rows), p, F.lit(AS_OF)) for p in va.PROFILES]
    assert both.columns == apart[0].columns
    got = sorted(map(repr, both.collect()))
    assert got == sorted(repr(r) for a in apart for r in a.collect()) and len({r.profile for r in both.collect()}) == 2
    # Records are read once, items for the counts, the findings and the duplicates.
    assert both._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 4


def test_words_join_in_the_order_of_structs_whatever_is_null(spark):
    rows = [(i % 3, None if i % 5 == 0 else i % 4 - 2, None if i % 7 == 0 else i * 37 % 11, f"w{i % 13}") for i in range(200)]
    words = spark.createDataFrame(rows, "doc_id INT, line_no INT, word_no INT, text STRING").repartition(5)
    order = ["line_no", "word_no"]
    got = words.groupBy("doc_id").agg(merge._joined(order, "text", " ").alias("a"), merge._joined_words(order, "text").alias("b")).collect()
    assert len(got) == 3 and all(r.a == r.b for r in got)


def test_quadrants_keep_their_boxes_in_the_order_of_words(spark, data):
    rows = [("d", 0, 0, line, no, t, conf, x, 5, 90, 18, 1000, 800) for line, no, t, conf, x in [(1, 2, "b", 60, 20), (0, 9, "a", 40, None), (1, None, "n", 80, 30), (2, 0, "-", 0, 10)]]
    schema = "doc_id string, page int, block_no int, line_no int, word_no int, text string, conf int, x int, y int, w int, h int, page_w int, page_h int"
    got = {r.text: r for r in merge.quadrant_text(spark.createDataFrame(rows, schema)).collect()}
    left, right = got["n b"], got["a"]
    assert [(b.line_no, b.word_no, b.x, b.w) for b in left.boxes] == [(1, None, 30, 90), (1, 2, 20, 90)] and left.confidence == 70
    assert [(b.line_no, b.word_no, b.x, b.h) for b in right.boxes] == [(0, 9, None, 18)] and right.quadrant == "top-right"
    # The query gives all that the operator makes.
    assert {"confidence", "boxes"} <= set(catalog.QUERIES["quadrant_text"](spark, data).columns)
