"""Invoice header fields from text: number, dates, parties, totals, payment, order data, confidence.

Operators add raw capture columns first and parse them in a second step. Catalyst keeps the steps apart because the
captures are expensive and read more than once, so no pattern runs twice on a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import parse_amount
from docledger.functions.currency import currency
from docledger.functions.dates import parse_date
from docledger.functions.regexes import all_of, blank_to_null, first_of, found, group, last_of
from docledger.schemas import MONEY

_MON = r"(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
DATE = (
    r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"
    r"|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})"
    rf"|[0-9]{{1,2}}(?:st|nd|rd|th)?[ -]{_MON}[, -]+[0-9]{{4}}"
    rf"|{_MON}[ -]+[0-9]{{1,2}}(?:st|nd|rd|th)?[, -]+[0-9]{{4}}"
    r"|[0-9]{8}"
)
# Longest payment terms taken for such, in days.
MAX_TERMS = 3_650

NUM = r"[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}"
PRICE = rf"[€$£¥]?[ \t]*{NUM}"

NUMBER_PATTERNS = [
    r"(?i)\binvoice\s+number[ \t]*[:#]?[ \t]*#?([A-Z0-9/-]*[0-9][A-Z0-9/-]*)",
    r"(?i)\b(?:invoice|bill|receipt)[ \t]*(?:no\.?)?[ \t]*[#:]*[ \t]*([A-Z0-9/-]*[0-9][A-Z0-9/-]*)",
    r"(?i)\b(?:no\.?|number|nr\.?)[ \t]*[:#]?[ \t]*([A-Z0-9/-]*[0-9][A-Z0-9/-]*)",
]
ISSUE_PATTERNS = [
    rf"(?i)\b(?:invoice\s+date|document\s+date|issue\s+date|date\s+of\s+issue|issued(?:\s+on)?|dated)\s*:?\s*({DATE})\b",
    rf"(?im)^[ \t]*date[ \t]*:?[ \t]*({DATE})\b",
]
# Any date that is not part of a longer run of digits and dashes.
ANY_DATE = rf"(?im)(?:^|[^0-9.-])({DATE})(?:[^0-9.-]|\.?$|\.[^0-9])"
DUE_PATTERNS = [
    rf"(?i)\b(?:payment\s+due\s+date|payment\s+due(?:\s+on)?|due\s+date|due\s+on|due\s+by|payment\s+date)\s*:?\s*({DATE})\b",
    rf"(?i)\bdue[\s:]+({DATE})\b",
]
NET_DAYS_PATTERNS = [
    r"(?i)\bnet[ \t]*:?[ \t]*([0-9]{1,4})\b",
    r"(?i)\bdue\s+(?:in|within)\s+([0-9]{1,4})\s*d",
    r"(?i)\bterms?\b[ \t]*:?[ \t]*([0-9]{1,4})[ \t]*d",
    r"(?i)\b([0-9]{1,4})[ \t]+days?\b",
]
TOTAL_PATTERNS = [
    rf"(?i)\b(?:grand\s+total|total\s+amount|amount\s+total|total\s+sum|sum\s+total|total)\b[^0-9€$£¥\n]{{0,100}}({PRICE})",
    rf"(?i)\b(?:amount\s+(?:now\s+)?due|balance\s+due|due\s+amount|to\s+pay)\b[^0-9€$£¥\n]{{0,100}}({PRICE})",
]
SUBTOTAL_PATTERNS = [
    rf"(?i)\b(?:sub-?total|net\s+amount|net\s+total)\b[^0-9€$£¥\n]{{0,100}}({PRICE})",
    rf"(?i)\bnet[ \t]*:[ \t]*({PRICE})",
]
TAX_PATTERNS = [
    rf"(?i)\b(?:sales\s+tax|tax|vat|gst)\b(?:[ \t]+(?:amount|total))?[ \t]*(?:\(?{NUM}[ \t]*%\)?)?[ \t]*:?[ \t]*([€$£¥]?[ \t]*[0-9][0-9.,]*[.,][0-9]{{2}})\b",
]
RATE_PATTERNS = [
    rf"(?i)\b(?:tax|vat|gst)\b(?:[ \t]+(?:rate|amount))?[ \t]*:?[ \t]*\(?({NUM})[ \t]*%",
    rf"(?i)\b({NUM})[ \t]*%[ \t]*(?:tax|vat|gst)\b",
]

_SELLER = r"(?:seller|provider|supplier|from|vendor|biller)"
_BUYER = r"(?:bill\s+to|buyer|customer|client|recipient|to)"
SELLER_BLOCK = rf"(?is)(?:^|\n)[ \t]*{_SELLER}[ \t]*:(.*?)(?:\n[ \t]*{_BUYER}[ \t]*:|\n[ \t]*\n|$)"
BUYER_BLOCK = rf"(?is)(?:^|\n)[ \t]*{_BUYER}[ \t]*:(.*?)(?:\n[ \t]*\n|$)"
TAX_ID = r"(?i)\b(?:tax\s+id|vat(?:\s+(?:number|id|no\.?|reg(?:istration)?))?|gst\s+reg)[ \t]*:[ \t]*([A-Z]{0,3}[0-9][A-Z0-9-]{4,})"
REGISTRATION = r"(?i)\b(?:company\s+reg|reg\.?\s+no\.?|registration(?:\s+number)?|customer\s+no\.?)[ \t]*:[ \t]*([A-Z0-9-]+)"
PHONE = r"(?i)\b(?:phone|tel|telephone)\.?[ \t]*:[ \t]*([0-9+()][0-9+() .-]{5,18}[0-9])"
MAIL = r"(?i)\b(?:e-?mail)[ \t]*:[ \t]*([a-z0-9_.+-]+@[a-z0-9-]+\.[a-z0-9.-]*[a-z0-9])"

EMAIL_ALL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,8}\.[A-Za-z]{2,}"
PHONE_ALL = r"\+?[0-9][0-9 ()-]{6,}[0-9]"
TAX_ID_ALL = r"\b[A-Z]{2}[0-9]{8,12}\b|\b[0-9]{3}-[0-9]{3}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{10}\b"
DATE_ALL = r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}\b"


def document_number(text: Column | str) -> Column:
    return first_of(text, NUMBER_PATTERNS)


def find_all_emails(text: Column) -> Column:
    return all_of(text, EMAIL_ALL)


def find_all_phones(text: Column) -> Column:
    return all_of(text, PHONE_ALL)


def find_all_tax_ids(text: Column) -> Column:
    return all_of(text, TAX_ID_ALL)


def find_all_dates(text: Column) -> Column:
    return all_of(text, DATE_ALL)


def terms_days(raw: Column) -> Column:
    """Days of payment terms; NULL for what no terms grant, so that a due date always lies in the calendar."""
    days = raw.try_cast("int")
    return F.when(days.between(0, MAX_TERMS), days)


def with_dates(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``issue_date`` and ``due_date``.

    Issue: labelled date, else the first date anywhere. Due: labelled date, else issue date plus the days of the terms,
    else the first date that is not before the issue date. Without an issue date bare terms give no due date.
    """
    t = text
    raw = docs.withColumns(
        {
            "_issue": F.coalesce(first_of(t, ISSUE_PATTERNS), group(t, ANY_DATE)),
            "_any": group(t, ANY_DATE),
            "_due": first_of(t, DUE_PATTERNS),
            "_days": terms_days(first_of(t, NET_DAYS_PATTERNS)),
        }
    )
    parsed = raw.withColumns(
        {"issue_date": parse_date(F.col("_issue")), "_due": parse_date(F.col("_due")), "_any": parse_date(F.col("_any"))}
    )
    later = F.when(F.col("issue_date").isNull() | (F.col("_any") >= F.col("issue_date")), F.col("_any"))
    relative = F.date_add("issue_date", F.col("_days"))
    due = F.coalesce("_due", relative, F.when(F.col("_days").isNull() | F.col("issue_date").isNotNull(), later))
    return parsed.withColumn("due_date", due).drop("_issue", "_any", "_due", "_days")


def with_totals(docs: DataFrame, text: str = "text", complete: bool = True) -> DataFrame:
    """Add flat ``subtotal``, ``tax_amount``, ``tax_rate``, ``total`` and ``currency``."""
    t = text
    raw = docs.withColumns(
        {
            "_total": first_of(t, TOTAL_PATTERNS),
            "_sub": first_of(t, SUBTOTAL_PATTERNS),
            "_tax": first_of(t, TAX_PATTERNS),
            "_rate": first_of(t, RATE_PATTERNS),
            "currency": currency(t),
        }
    )
    out = raw.withColumns(
        {
            "total": parse_amount(F.col("_total")),
            "subtotal": parse_amount(F.col("_sub")),
            "tax_amount": parse_amount(F.col("_tax")),
            "tax_rate": parse_amount(F.col("_rate")),
        }
    ).drop("_total", "_sub", "_tax", "_rate")
    return complete_totals(out) if complete else out


def complete_totals(df: DataFrame) -> DataFrame:
    """Fill the one missing value among subtotal, tax and total, and the rate from tax and subtotal."""
    sub, tax, total, rate = F.col("subtotal"), F.col("tax_amount"), F.col("total"), F.col("tax_rate")
    filled = df.withColumns(
        {
            "total": F.coalesce(total, (sub + tax).try_cast(MONEY)),
            "tax_amount": F.coalesce(tax, (total - sub).try_cast(MONEY)),
            "subtotal": F.coalesce(sub, (total - tax).try_cast(MONEY)),
        }
    )
    share = F.try_divide(tax * 100, sub).try_cast(MONEY)
    return filled.withColumn("tax_rate", F.coalesce(rate, F.when((sub > 0) & (tax > 0), share)))


def last_amount_total(text: Column | str) -> Column:
    """Total as the last match of the first amount pattern that occurs."""
    raw = last_of(
        text,
        [
            rf"(?i)\b(?:total|amount due|balance due)\b[^0-9\n]{{0,40}}({NUM})",
            rf"[$€£¥][ \t]*({NUM})",
            r"\b([0-9]+(?:,[0-9]{3}){0,5}\.[0-9]{2})\b",
        ],
    )
    return F.translate(raw, ",", "").try_cast(MONEY)


def _party(block: str, text: str, own_labels: str) -> Column:
    name = group(block, r"^[ \t\n]*([^\n]+)")
    # Address: up to four lines below the name that carry no label.
    address = group(block, r"^[^\n]*\n((?:[ \t]*[^\n:]*[^\s:][^\n:]*(?:\n|$)){1,4})")
    return F.struct(
        name.alias("name"),
        F.regexp_replace(address, r"[ \t]*\n[ \t]*", "\n").alias("address"),
        F.coalesce(group(block, TAX_ID), group(text, rf"(?i)\b{own_labels}\s+(?:tax\s+id|vat)[ \t]*:[ \t]*([A-Z0-9-]+)")).alias("tax_id"),
        group(block, REGISTRATION).alias("registration_number"),
        F.lit(None).cast("string").alias("vat_number"),
        F.coalesce(group(block, PHONE), group(text, rf"(?i)\b{own_labels}\s+(?:phone|tel)\.?[ \t]*:[ \t]*([0-9+()][0-9+() .-]{{5,18}}[0-9])")).alias("phone"),
        F.coalesce(group(block, MAIL), group(text, rf"(?i)\b{own_labels}\s+e-?mail[ \t]*:[ \t]*(\S+@\S+)")).alias("email"),
    )


def with_parties(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``seller`` and ``buyer`` structs, each read from its own block of the text."""
    t = text
    blocks = docs.withColumns({"_seller": group(t, SELLER_BLOCK), "_buyer": group(t, BUYER_BLOCK)})
    return blocks.withColumns(
        {
            "seller": _party("_seller", t, "(?:seller|vendor)"),
            "buyer": _party("_buyer", t, "(?:customer|buyer)"),
        }
    ).drop("_seller", "_buyer")


def payment_status(text: Column | str) -> Column:
    """Paid / Unpaid from wording, else the labelled status."""
    text = F.col(text) if isinstance(text, str) else text
    paid = found(text, r"(?i)\bpaid\b|\bpayment\s+(?:received|completed)\b")
    unpaid = found(text, r"(?i)\bunpaid\b|\bdue\b|\bpending\s+payment\b")
    return (
        F.when(paid, "Paid")
        .when(unpaid, "Unpaid")
        .otherwise(group(text, r"(?i)\b(?:payment\s+)?status[ \t]*:[ \t]*([^\n]+)"))
    )


def payment_method_class(text: Column | str) -> Column:
    """Credit card, bank transfer, PayPal or check: the first kind whose words occur."""
    # Wordings by payment kind, in test order.
    kinds = [
        ("credit_card", r"visa|mastercard|amex|american express|discover|credit card|debit card"),
        ("bank_transfer", r"bank transfer|wire transfer|sepa|ach|iban|swift"),
        ("paypal", r"pay[\s-]*pal"),
        ("check", r"check|cheque"),
    ]
    out = None
    text = F.col(text) if isinstance(text, str) else text
    for name, words in kinds:
        cond = found(text, f"(?i)(?:{words})")
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


TERMS_PATTERNS = [
    r"(?i)\b(?:payment\s+terms|terms\s+of\s+payment|payment\s+conditions?|zahlungsbedingungen|conditions\s+de\s+paiement|condiciones\s+de\s+pago)[ \t]*:?[ \t]*([^\n]+)",
    r"(?im)^[ \t]*terms[ \t]*:[ \t]*([^\n]+)",
    r"(?i)\b((?:due|payment)\s+(?:within|in)\s+[0-9]+\s+days)\b",
    r"(?i)\b(net\s+[0-9]+(?:\s+days)?)\b",
]


def payment_terms(text: Column | str) -> Column:
    return first_of(text, TERMS_PATTERNS)


def notes(text: Column | str) -> Column:
    """Distinct notes, each up to a blank line, joined."""
    all_notes = all_of(
        text, r"(?is)(?:^|\n)[ \t]*(?:notes?|comments?|remarks?|additional\s+information)[ \t]*:[ \t]*(.+?)(?:\n[ \t]*\n|$)", 1
    )
    trimmed = F.transform(all_notes, lambda n: F.trim(n, F.lit(" \t\r\n")))
    return blank_to_null(F.array_join(F.array_distinct(trimmed), "\n"))


def payment_info(text: Column | str) -> Column:
    """Struct of terms, days, method, status and bank details."""
    return F.struct(
        payment_terms(text).alias("terms"),
        terms_days(first_of(text, NET_DAYS_PATTERNS)).alias("terms_days"),
        first_of(
            text,
            [
                r"(?i)\b(?:payment\s+method|method\s+of\s+payment)[ \t]*:[ \t]*([^\n]+)",
                r"(?i)\b(?:paid\s+by|pay\s+by|payment\s+via)[ \t]*:?[ \t]*([^\n]+)",
            ],
        ).alias("method"),
        payment_status(text).alias("status"),
        group(text, r"(?i)\bbank\s+name[ \t]*:[ \t]*([^\n]+)").alias("bank_name"),
        group(text, r"(?i)\b(?:account(?:\s+(?:no\.?|number))?|iban)[ \t]*:[ \t]*([A-Z0-9][A-Z0-9 ]{8,32}[A-Z0-9])").alias("bank_account"),
        F.replace(group(text, r"(?i)\biban[ \t]*:[ \t]*([A-Z]{2}[0-9]{2}[A-Z0-9 ]{8,32})"), F.lit(" "), F.lit("")).alias("iban"),
        group(text, r"(?i)\b(?:swift|bic)(?:\s+code)?[ \t]*:[ \t]*([A-Z0-9]{8,11})\b").alias("swift"),
    )


def with_order_metadata(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add order and reference number, delivery date, document kind, discount (amount or share of subtotal), shipping."""
    t = text
    raw = docs.withColumns(
        {
            "order_number": group(t, r"(?i)\b(?:purchase\s+order|order|po)(?:[ \t]+(?:number|no\.?))?[ \t]*[:#]+[ \t]*#?([A-Z0-9-]*[0-9][A-Z0-9-]*)"),
            "reference_number": group(t, r"(?i)\b(?:reference|ref\.?)(?:[ \t]+(?:number|no\.?))?[ \t]*[:#]+[ \t]*#?([A-Z0-9-]*[0-9][A-Z0-9-]*)"),
            "_delivery": group(t, rf"(?i)\b(?:delivery|shipped|dispatch)\s+date[\s:]+({DATE})"),
            "document_kind": F.initcap(F.lower(group(t, r"(?i)\b(invoice|receipt|bill|statement|debit\s+note|credit\s+note)\b"))),
            "_discount": group(t, rf"(?i)\b(?:discount|reduction)[ \t]*:[ \t]*-?({PRICE}[ \t]*%?)"),
            "_shipping": group(t, rf"(?i)\b(?:shipping|freight|delivery|transport)[ \t]*:[ \t]*({PRICE})"),
        }
    )
    amount = parse_amount(F.col("_discount"))
    share = F.contains("_discount", F.lit("%"))
    subtotal = F.col("subtotal") if "subtotal" in docs.columns else F.lit(None).cast(MONEY)
    return raw.withColumns(
        {
            "delivery_date": parse_date(F.col("_delivery")),
            "discount": F.when(share, (amount * subtotal / 100).try_cast(MONEY)).otherwise(amount),
            "shipping": parse_amount(F.col("_shipping")),
        }
    ).drop("_delivery", "_discount", "_shipping")


def extract_invoice(docs: DataFrame) -> DataFrame:
    """Invoice records from documents: all header fields in one narrow pass; the text is dropped at the end."""
    keys = [c for c in ("doc_id", "page") if c in docs.columns]
    staged = with_order_metadata(with_parties(with_totals(with_dates(docs))))
    staged = staged.withColumns(
        {"document_number": document_number("text"), "payment": payment_info("text"), "notes": notes("text")}
    )
    language = F.col("language") if "language" in docs.columns else F.lit(None).cast("string")
    doc_type = F.col("doc_type") if "doc_type" in docs.columns else F.lower("document_kind")
    return staged.select(
        *keys,
        doc_type.alias("doc_type"),
        "document_number", "issue_date", "due_date", "currency", "seller", "buyer",
        F.struct("subtotal", "tax_rate", "tax_amount", "discount", "shipping", "total", "currency").alias("totals"),
        "payment", "order_number", "reference_number", "delivery_date", "notes",
        language.alias("language"),
        F.lit(None).cast("double").alias("confidence"),
    )


# ---- confidence of a record

# The payment block is counted twice in the documented score.
PAYMENT_WEIGHT = 2


def _pts(cond: Column, points: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), points).otherwise(0)


def extraction_confidence(n_items: Column | None = None) -> Column:
    """Completeness points over ten, at most 1, for a record in the ``invoice`` layout."""

    def party(p: str) -> Column:
        return _pts(F.col(f"{p}.name").isNotNull(), 1) + _pts(
            F.col(f"{p}.tax_id").isNotNull() | F.col(f"{p}.address").isNotNull(), 1
        )

    paid = F.col("payment.method").isNotNull() | F.col("payment.bank_account").isNotNull()
    score = (
        _pts(F.col("document_number").isNotNull(), 2)
        + _pts(F.col("issue_date").isNotNull(), 1)
        + party("seller")
        + party("buyer")
        + _pts(F.col("totals.total") > 0, 2)
        + _pts(paid, 1) * PAYMENT_WEIGHT
    )
    if n_items is not None:
        score = score + _pts(n_items > 0, 2)
    return F.least(score / 10, F.lit(1.0)).cast("double")


def weighted_confidence() -> Column:
    """Weighted presence of number, date, seller, buyer and total."""
    # Weights in tenths.
    tenths = (
        _pts(F.col("document_number").isNotNull(), 2)
        + _pts(F.col("issue_date").isNotNull(), 2)
        + _pts(F.col("seller.name").isNotNull(), 2)
        + _pts(F.col("buyer.name").isNotNull(), 1)
        + _pts(F.col("totals.total") > 0, 3)
    )
    return (tenths / 10).cast("double")
