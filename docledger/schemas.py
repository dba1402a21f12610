"""Column contracts of the tables this package reads and writes."""

DOCUMENTS = "doc_id BIGINT, page INT, text STRING, source STRING, metadata MAP<STRING,STRING>"

PARTY = (
    "STRUCT<name:STRING,address:STRING,tax_id:STRING,registration_number:STRING,"
    "vat_number:STRING,phone:STRING,email:STRING>"
)
TOTALS = (
    "STRUCT<subtotal:DECIMAL(18,4),tax_rate:DECIMAL(18,4),tax_amount:DECIMAL(18,4),discount:DECIMAL(18,4),"
    "shipping:DECIMAL(18,4),total:DECIMAL(18,4),currency:STRING>"
)
PAYMENT = (
    "STRUCT<terms:STRING,terms_days:INT,method:STRING,status:STRING,bank_name:STRING,"
    "bank_account:STRING,iban:STRING,swift:STRING>"
)
INVOICE = (
    "doc_id BIGINT, doc_type STRING, document_number STRING, issue_date DATE, due_date DATE, currency STRING, "
    f"seller {PARTY}, buyer {PARTY}, totals {TOTALS}, payment {PAYMENT}, order_number STRING, "
    "reference_number STRING, delivery_date DATE, notes STRING, language STRING, confidence DOUBLE"
)
ITEM_FIELDS = (
    "item_code STRING, description STRING, quantity DECIMAL(18,4), unit STRING, unit_price DECIMAL(18,4), "
    "net_amount DECIMAL(18,4), tax_rate DECIMAL(18,4), tax_amount DECIMAL(18,4), amount DECIMAL(18,4), currency STRING"
)
INVOICE_ITEMS = f"doc_id BIGINT, item_no INT, {ITEM_FIELDS}, extractor STRING"
# One record per document with its items nested, as JSON files hold it.
INVOICE_JSON = f"{INVOICE}, items ARRAY<STRUCT<{ITEM_FIELDS.replace(' DECIMAL', ':DECIMAL').replace(' STRING', ':STRING')}>>"

CANDIDATES = (
    "doc_id BIGINT, field STRING, value STRING, confidence DOUBLE, extractor STRING, rule_id STRING, "
    "match_pos INT, match_text STRING"
)
FINDINGS = (
    "doc_id BIGINT, profile STRING, check_name STRING, field STRING, severity STRING, message STRING, "
    "value STRING, suggestion STRING"
)
JOBS = (
    "job_id STRING, status STRING, input_format STRING, output_format STRING, file_name STRING, file_size BIGINT, "
    "languages ARRAY<STRING>, created_at TIMESTAMP, started_at TIMESTAMP, completed_at TIMESTAMP, error_message STRING, "
    "job_type STRING, n_files INT"
)
OCR_RESULTS = (
    "job_id STRING, confidence DECIMAL(3,2), language STRING, engine STRING, processing_time DECIMAL(10,3), "
    "created_at TIMESTAMP"
)
JOB_METRICS = "job_id STRING, metric_name STRING, metric_value DECIMAL(15,6), metric_unit STRING, recorded_at TIMESTAMP"
API_CALLS = (
    "endpoint STRING, method STRING, status_code INT, response_time DOUBLE, request_size BIGINT, "
    "response_size BIGINT, ts TIMESTAMP"
)
OCR_WORDS = (
    "doc_id BIGINT, page INT, engine STRING, block_no INT, line_no INT, word_no INT, text STRING, conf INT, "
    "x INT, y INT, w INT, h INT, page_w INT, page_h INT"
)
MONEY = "decimal(18,4)"
