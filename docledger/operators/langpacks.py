"""Language and layout packs: the labels of English, Polish, German, Spanish and French invoices, the vendor layout and
the European layout.

A pack is a table of patterns by field. Mixed-language corpora are extracted in one pass: every field is one conditional
expression over the language column, and only the branch of a row's own language runs.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import parse_amount, parse_amount_signed
from docledger.functions.dates import parse_date
from docledger.functions.regexes import all_of, any_case, first_of, first_sql, group, let
from docledger.functions.text import lines
from docledger.operators.fields import terms_days
from docledger.operators.items import extract_items, is_refund
from docledger.schemas import MONEY

_D = r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"
# An amount: groups of three digits parted by blanks, or digits with points and commas. Repetitions are bounded, so that no text
# can exhaust the matcher's stack.
_N = r"(?:[0-9]{1,3}(?: [0-9]{3}){1,5}(?:[.,][0-9]{1,4})?\b|[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6})"
_LINE = r"[ \t]*([^\n]+)"
_IBAN = r"([A-Z]{2}[ ]?[0-9]{2}[A-Z0-9 ]{10,32})"
_BIC = r"([A-Z0-9]{8,11})\b"

# The labels that invoices print before a field, by field and language.
PACK_LABELS: dict[str, dict[str, list[str]]] = {
    "document_number": {
        "en": ["invoice", "invoice number", "invoice no", "bill", "receipt", "document", "doc"], "pl": ["faktura", "faktura nr", "nr faktury", "numer faktury"],
        "de": ["rechnungsnummer", "rechnungs-nr", "nr"], "es": ["factura", "número", "numero", "núm"], "fr": ["facture", "numéro", "numero", "n°", "ref"],
    },
    "order_number": {"en": ["order", "purchase order", "po"]},
    "issue_date": {"en": ["invoice date", "issued", "issue date", "dated"], "pl": ["data", "data wystawienia", "data sprzedaży"], "de": ["datum", "rechnungsdatum"], "es": ["fecha", "fecha de emisión", "fecha de emision"], "fr": ["date", "date de facturation", "date d'émission"]},
    "due_date": {
        "en": ["due", "due date", "payment due", "payment date", "payment by", "payable by"], "pl": ["termin płatności", "termin płatnosci", "termin wymagalności", "zapłacono do"],
        "de": ["fällig", "fällig am", "fälligkeit", "fälligkeitsdatum", "zahlbar bis"], "es": ["vencimiento", "fecha de vencimiento", "pagar antes de"], "fr": ["échéance", "echeance", "date d'échéance", "date de paiement"],
    },
    "currency": {"en": ["currency", "amount", "balance", "subtotal", "total"], "pl": ["waluta", "kwota w", "płatność w"], "de": ["währung", "betrag in"], "es": ["moneda", "importe en"], "fr": ["devise", "montant en"]},
    "seller_name": {"en": ["from", "provider", "seller", "vendor"], "pl": ["sprzedawca"], "de": ["lieferant", "rechnungssteller", "verkäufer"], "es": ["emisor", "empresa", "proveedor", "vendedor"], "fr": ["entreprise", "fournisseur", "société", "vendeur"]},
    "seller_tax_id": {"en": ["tax id", "vat id", "vat no", "gst no", "vat", "gst", "tax"], "pl": ["nip"], "de": ["ust-id", "ust-idnr", "ust-id-nr", "umsatzsteuer-identifikationsnummer"], "es": ["cif", "nif", "nif/cif"], "fr": ["siren", "siret", "tva", "n° siret", "n° tva"]},
    "buyer_name": {"en": ["bill to", "invoice to", "sold to"], "pl": ["klient", "nabywca"], "de": ["käufer", "rechnungsempfänger"], "es": ["cliente", "comprador", "receptor"], "fr": ["acheteur", "client", "destinataire"]},
    "buyer_tax_id": {"en": ["buyer tax id", "buyer vat", "customer tax id", "customer vat"], "pl": ["nip nabywcy"], "de": ["kunden-steuernummer"], "es": ["nif del cliente"], "fr": ["siret acheteur"]},
    "buyer_vat": {"pl": ["nr vat"]},
    "net": {"en": ["subtotal", "sub-total", "total before tax"], "pl": ["suma netto", "suma bez vat"], "de": ["netto", "nettobetrag", "nettosumme", "zwischensumme"], "es": ["base imponible", "importe neto"], "fr": ["montant ht", "total ht", "net à payer", "net a payer"]},
    "tax": {
        "en": ["gst", "sales tax", "tax", "vat"], "pl": ["kwota vat", "vat"], "de": ["mehrwertsteuer", "mwst", "steuerbetrag", "umsatzsteuer", "ust"],
        "es": ["importe del iva", "iva", "total iva"], "fr": ["montant tva", "total tva", "tva"],
    },
    "rate": {"en": ["gst", "tax", "vat"], "pl": ["vat"], "de": ["mehrwertsteuer", "mwst", "umsatzsteuer", "ust"], "es": ["iva", "tasa"], "fr": ["tva"]},
    "total": {
        "en": ["amount due", "balance due", "grand total", "total"], "pl": ["do zapłaty", "kwota łączna faktury", "razem", "razem do zapłaty"], "de": ["endbetrag", "gesamtbetrag", "rechnungsbetrag", "zu zahlender betrag"],
        "es": ["total a pagar", "total factura", "total general"], "fr": ["total ttc", "total à payer", "total général"],
    },
    "terms": {"en": ["payment terms", "terms"], "pl": ["warunki płatności"], "de": ["zahlbar innerhalb von", "zahlungsbedingungen", "zahlungsziel"], "es": ["condiciones de pago", "pago a", "términos de pago"], "fr": ["conditions de paiement", "modalités de paiement", "paiement sous"]},
    "days": {"en": ["days"], "pl": ["dni"], "de": ["tag", "tage", "tagen"], "es": ["dia", "dias", "día", "días"], "fr": ["jour", "jours"]},
    "method": {"en": ["payment method"], "pl": ["forma płatności", "metoda płatności", "sposób płatności"], "de": ["bezahlung", "zahlungsart", "zahlungsweise"], "es": ["forma de pago", "método de pago"], "fr": ["mode de paiement", "moyen de paiement"]},
    "bank_name": {"en": ["bank", "bank name"]},
    "iban": {"en": ["iban", "international bank account number"], "pl": ["iban"], "de": ["iban", "kontonummer", "konto-nr"], "es": ["cuenta bancaria", "iban", "número de cuenta"], "fr": ["compte bancaire", "iban", "référence bancaire"]},
    "swift": {"en": ["bic", "bic code", "swift", "swift code"], "pl": ["swift"], "de": ["bankleitzahl", "bic", "swift"], "es": ["bic", "swift"], "fr": ["bic", "code banque", "swift"]},
}
# Forms of tax numbers by language.
_TAX_NUMBERS = {"en": "[A-Z]{0,3}[0-9][A-Z0-9-]{4,20}", "pl": "[A-Z]{0,2}[0-9][0-9 -]{6,12}[0-9]", "de": "[A-Z]{2}[ ]?[0-9]{1,15}[0-9A-Z]{0,6}", "es": r"[A-Z0-9]{8,12}\b", "fr": "[A-Z0-9][A-Z0-9 ]{7,16}[A-Z0-9]"}
_NUMBER = r"([A-Z0-9/-]*[0-9][A-Z0-9/-]*)"
_LINE_START = r"(?:^|\n)[ \t]*+"
_GAP = r"\.?[ \t:]*+"
_SYMBOL = r"[$€£¥]?[ \t]*+"


def _any(labels: Sequence[str]) -> str:
    """A group of labels, longer ones first, with any blanks between their words."""
    return "(?:" + "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(labels, key=lambda x: (-len(x), x))) + ")"


def _pack(lang: str) -> dict[str, list[str]]:
    """Patterns of every field of one language, composed of its labels and the form of the value."""
    label = {field: _any(by_lang[lang]) for field, by_lang in PACK_LABELS.items() if lang in by_lang}
    # Where amounts are followed by their currency, a number without one is no amount ("netto 30 Tage").
    coded = lang in ("de", "es", "fr")
    amount = rf"({_N})[ \t]*[A-Z]{{3}}" if coded else rf"({_N})"
    cents = amount if lang != "en" else r"([0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}[.,][0-9]{2})"
    # Polish parties may stand on the line after their label.
    name = r"[ \t]*:?\s*([^\n]+)" if lang == "pl" else rf"[ \t]*:{_LINE}"
    colon = ":?" if coded else ":"
    forms = {
        "document_number": [rf"\b{{}}\.?[ \t:#]*+{_NUMBER}"],
        "order_number": [rf"\b{{}}[ \t:#]*+{_NUMBER}"],
        "issue_date": [rf"\b{{}}{_GAP}({_D})"] + ([rf"{_LINE_START}date[ \t:]*+({_D})"] if lang == "en" else []),
        "due_date": [rf"\b{{}}{_GAP}({_D})"],
        "currency": [rf"\b{{}}{_GAP}([A-Z]{{3}})\b"],
        "seller_name": [(_LINE_START if lang == "en" else r"\b") + "{}" + (name if lang != "pl" else r"[ \t]*:\s*([^\n]+)")],
        "buyer_name": [(_LINE_START if lang == "en" else r"\b") + "{}" + name],
        "terms": [rf"\b{{}}[ \t]*{colon}{_LINE}"],
        "method": [rf"\b{{}}[ \t]*:{_LINE}"],
        "bank_name": [rf"\b{{}}[ \t]*:{_LINE}"],
    }
    own = {field: [p.replace("{}", label[field]) for p in patterns] for field, patterns in forms.items() if field in label}
    own["seller_tax_id"] = [rf"{_LINE_START}{label['seller_tax_id']}{_GAP}({_TAX_NUMBERS[lang]})"]
    own["buyer_tax_id"] = [rf"\b{label['buyer_tax_id']}{_GAP}([A-Z0-9-]+)"]
    if lang == "pl":
        own["buyer_tax_id"].append(rf"(?s)\b{label['buyer_name']}\b.*?\b{label['seller_tax_id']}{_GAP}([0-9][0-9 -]{{8,12}}[0-9])")
        own["buyer_vat"] = [rf"\b{label['buyer_vat']}{_GAP}([A-Z]{{0,2}}[ ]?[0-9][0-9 -]{{7,12}})"]
    own["net"] = [rf"\b{label['net']}(?:\s+[0-9]+%)?{_GAP}{_SYMBOL}{amount}"]
    own["total"] = [rf"\b{label['total']}{_GAP}{_SYMBOL}{amount}"]
    own["tax"] = [rf"\b{label['tax']}\.?(?:[ \t]+amount)?[ \t:]*+(?:\(?[0-9.,]+[ \t]*%\)?)?[ \t:]*+{_SYMBOL}{cents}"]
    own["rate"] = [rf"\b{label['rate']}{_GAP}\(?([0-9]+(?:\.[0-9]+)?)[ \t]*%"]
    own["days"] = ([r"\bnet[ \t]+([0-9]+)", rf"\bwithin[ \t]+([0-9]+)[ \t]+{label['days']}"] if lang == "en" else []) + ([] if lang == "en" else [rf"\b([0-9]+)[ \t]*{label['days']}\b"])
    own["iban"] = [rf"\b{label['iban']}{_GAP}{_IBAN}"]
    own["swift"] = [rf"\b{label['swift']}{_GAP}{_BIC}"]
    return own


# Field -> patterns, by language. Labels are matched without regard to case.
PACKS: dict[str, dict[str, list[str]]] = {lang: _pack(lang) for lang in ("en", "pl", "de", "es", "fr")}

FIELDS = list(dict.fromkeys(f for pack in PACKS.values() for f in pack))
_PLN = r"(?i)pln[ \t:]*([0-9]+[.,][0-9]{2})|([0-9]+[.,][0-9]{2})[ \t]*pln"


def _captured(text: str, field: str, lang: Column | str) -> Column:
    """A field by the pack of one language, or of the row's own language when ``lang`` is the column ``_lang``."""
    by_lang = {
        code: first_sql(text, [any_case(p) for p in pack[field]]) for code, pack in PACKS.items() if pack.get(field)
    }
    if isinstance(lang, str):
        return F.expr(by_lang[lang]) if lang in by_lang else F.lit(None).cast("string")
    cases = " ".join(f"WHEN '{code}' THEN {sql}" for code, sql in by_lang.items() if code != "en")
    other = by_lang.get("en", "CAST(NULL AS STRING)")
    known = " ".join(f"WHEN '{code}' THEN CAST(NULL AS STRING)" for code in PACKS if code not in by_lang and code != "en")
    return F.expr(f"CASE _lang {cases} {known} ELSE {other} END")


def pln_amounts(text: Column) -> Column:
    """Every PLN amount above one, in text order."""
    found = all_of(text, _PLN, 0)
    amounts = F.transform(found, lambda x: parse_amount(x))
    return F.filter(amounts, lambda a: a > 1)


def extract_pack(docs: DataFrame, lang: Column | str, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Records of one language, or of mixed documents when ``lang`` is a column; narrow. ``keep`` names columns to carry."""
    t = F.col(text)
    lang_col = F.lit(lang) if isinstance(lang, str) else F.col("_lang")
    raw = docs if isinstance(lang, str) else docs.withColumn("_lang", lang)
    raw = raw.withColumns({f"_{f}": _captured(text, f, lang) for f in FIELDS})
    raw = raw.withColumn("_pln", F.when(lang_col == "pl", pln_amounts(t)))
    raw = raw.withColumn("_reverse", F.contains(F.lower(t), F.lit("reverse charge")))
    default = F.when(lang_col == "pl", "PLN").when(lang_col != "en", "EUR")

    def money(name: str) -> Column:
        return parse_amount(F.col(name))

    typed = raw.withColumns(
        {
            "issue_date": parse_date(F.col("_issue_date")),
            "_due": parse_date(F.col("_due_date")),
            "_days": terms_days(F.col("_days")),
            "_net": money("_net"),
            "_tax": money("_tax"),
            "_rate": money("_rate"),
            "_total": money("_total"),
            "currency": F.upper(F.coalesce("_currency", default)),
        }
    )
    # Polish documents without labelled totals: the largest PLN amount, and the sum of all as net.
    largest = F.array_max("_pln")
    summed = F.aggregate("_pln", F.lit(0).cast(MONEY), lambda acc, a: (acc + a).try_cast(MONEY))
    some = F.size("_pln") > 0
    keys = [c for c in ("doc_id", "page") if c in docs.columns]

    def party(p: str, vat: Column) -> Column:
        return F.struct(
            F.col(f"_{p}_name").alias("name"),
            F.lit(None).cast("string").alias("address"),
            F.regexp_replace(F.col(f"_{p}_tax_id"), r"[ -]", "").alias("tax_id"),
            F.lit(None).cast("string").alias("registration_number"),
            vat.alias("vat_number"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(None).cast("string").alias("email"),
        )

    return typed.select(
        *keys,
        *keep,
        F.lit("invoice").alias("doc_type"),
        F.col("_document_number").alias("document_number"),
        "issue_date",
        F.coalesce("_due", F.date_add("issue_date", F.col("_days"))).alias("due_date"),
        "currency",
        party("seller", F.lit(None).cast("string")).alias("seller"),
        party("buyer", F.regexp_replace(F.col("_buyer_vat"), r"[ -]", "")).alias("buyer"),
        F.struct(
            F.coalesce("_net", F.when(some & F.col("_total").isNull(), summed)).alias("subtotal"),
            F.col("_rate").alias("tax_rate"),
            F.coalesce("_tax", F.when(F.col("_reverse"), F.lit(0).cast(MONEY))).alias("tax_amount"),
            F.lit(None).cast(MONEY).alias("discount"),
            F.lit(None).cast(MONEY).alias("shipping"),
            F.coalesce("_total", F.when(some, largest)).alias("total"),
            F.col("currency").alias("currency"),
        ).alias("totals"),
        F.struct(
            F.col("_terms").alias("terms"),
            F.col("_days").alias("terms_days"),
            F.col("_method").alias("method"),
            F.lit(None).cast("string").alias("status"),
            F.col("_bank_name").alias("bank_name"),
            F.replace(F.col("_iban"), F.lit(" "), F.lit("")).alias("bank_account"),
            F.replace(F.col("_iban"), F.lit(" "), F.lit("")).alias("iban"),
            F.col("_swift").alias("swift"),
        ).alias("payment"),
        F.col("_order_number").alias("order_number"),
        F.lit(None).cast("string").alias("reference_number"),
        F.lit(None).cast("date").alias("delivery_date"),
        F.when(F.col("_reverse"), "Reverse charge EU directive 2006/112").alias("notes"),
        lang_col.alias("language"),
        F.lit(None).cast("double").alias("confidence"),
    )


# ---- vendor layout

_VENDOR_NUMBERS = [
    r"(?i)\binvoice\s+number\s*[:#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)",
    r"(?i)\binvoice\s+#\s*([A-Z0-9-]+)",
    r"(?i)\b(?:credit\s+note|credit|refund|reference)\s*(?:number|#)\s*[:#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)",
    r"(?i)\b(?:transaction|document)\s+(?:id|number)\s*[:#]?\s*([A-Z0-9-]*[0-9][A-Z0-9-]*)",
]
_SIGNED = r"(\(?-?[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}\)?)"


def generic_number_token(text: Column) -> Column:
    """First upper-case token of six or more characters that is neither a date nor a bare long number."""
    tokens = all_of(text, r"\b[A-Z0-9-]{6,}\b", 0)
    plausible = F.filter(
        tokens,
        lambda x: F.rlike(x, F.lit("[0-9]"))
        & ~F.rlike(x, F.lit(r"^[0-9]{1,2}-(?:[0-9]{1,2}|[A-Z]{3})-[0-9]{4}$"))
        & ~F.rlike(x, F.lit(r"^[0-9]{5,}"))
        & ~x.isin("000000", "FFFFFF"),
    )
    return F.get(plausible, F.lit(0))


def extract_vendor(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """Vendor layout with layered lookups: file name, order field, terms, labelled numbers, plausible token.

    ``keep`` names columns to carry.
    """
    t, meta = text, F.col("metadata")
    name = F.try_element_at(meta, F.lit("filename"))
    po = F.try_element_at(meta, F.lit("po_number"))
    number = F.coalesce(
        group(name, r"_No_([0-9]+)"),
        F.when(~po.isin("", "Information"), po),
        group(t, r"Order Number\s+([0-9]+)"),
        first_of(t, _VENDOR_NUMBERS),
        generic_number_token(t),
    )
    staged = extract_items(docs, "vendor", text).withColumns(
        {
            "document_number": number,
            "_from": F.coalesce(
                group(t, r"(?i)Service Term:\s+([0-9]{2}-[A-Z]{3}-[0-9]{4})\s+to"),
                group(t, r"(?i)Invoice\s+Date\s*:?\s*([0-9]{2}-[A-Z]{3}-[0-9]{4})"),
                group(name, r"_([0-9]{8})\.json$"),
            ),
            "_to": group(t, r"(?i)\bto\s+([0-9]{2}-[A-Z]{3}-[0-9]{4})"),
            "currency": F.coalesce(
                F.nullif(F.try_element_at(meta, F.lit("currency")), F.lit("TAX")),
                group(t, r"\bCurrency\s+([A-Z]{3})\b"),
                group(t, r"NET AMOUNT \(([A-Z]{3})\)"),
                group(t, r"GRAND TO[TU]AL \(([A-Z]{3})\)"),
            ),
            "_buyer": group(t, r"(?s)Bill To\s+(.*?)(?:\s+Customer VAT No:|\n[ \t]*\n|$)"),
            "_buyer_vat": group(t, r"Customer VAT No:\s+([A-Z0-9]+)"),
            "_net": first_of(t, [rf"(?i)NET\s+AMOUNT\s*\([A-Z]{{3}}\)\s*{_SIGNED}", rf"(?i)\bsub-?total\s*:?\s*{_SIGNED}"]),
            "_tax": first_of(t, [rf"(?i)TAXES[^\n]*?\([A-Z]{{3}}\)\s*{_SIGNED}", rf"(?i)\b(?:VAT|TAX)\s+AMOUNT\s*:?\s*{_SIGNED}"]),
            "_total": first_of(t, [rf"(?i)GRAND\s+TO[TU]AL\s*(?:\([A-Z]{{3}}\))?\s*{_SIGNED}", rf"(?i)TOTAL\s+AMOUNT\s*(?:\([A-Z]{{3}}\))?\s*{_SIGNED}"]),
        }
    )
    refund = (F.size("items") > 0) & F.forall("items", is_refund)

    def money(c: str) -> Column:
        return let(parse_amount_signed(F.col(c)), lambda v: F.when(refund, -F.abs(v)).otherwise(v))

    keys = [c for c in ("doc_id", "page") if c in docs.columns]
    return staged.withColumns({"_n": money("_net"), "_t": money("_tax"), "_g": money("_total")}).select(
        *keys,
        *keep,
        "document_number",
        parse_date(F.col("_from")).alias("issue_date"),
        parse_date(F.col("_to")).alias("due_date"),
        "currency",
        F.trim(F.get(F.split("_buyer", "\n"), F.lit(0))).alias("buyer_name"),
        F.regexp_replace(group(F.col("_buyer"), r"(?s)^[^\n]*\n(.*)$"), r"[ \t]*\n[ \t]*", "\n").alias("buyer_address"),
        F.col("_buyer_vat").alias("buyer_tax_id"),
        F.col("_n").alias("subtotal"),
        F.col("_t").alias("tax_amount"),
        F.col("_g").alias("total"),
        "items",
    )


# ---- European layout

_NOT_A_NAME = r"(?i)vat|reg|iban|swift|phone|www|client|invoice|^[0-9.,% ]+$"


def extract_european(docs: DataFrame, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """European layout by line neighbourhood.

    The seller is named in the five lines above its tax-id line, the buyer in the lines after ``CLIENT``, the item after
    ``Product/Service``. Neighbours are slices of the document's own line array, so nothing is exploded or shuffled.
    """
    staged = docs.withColumn("_lines", F.transform(lines(F.col(text)), lambda x: F.trim(x))).withColumn("_t", F.col(text))
    arr, t = F.col("_lines"), "_t"

    def at(pattern: str) -> Column:
        return F.array_position(F.transform(arr, lambda x: F.rlike(x, F.lit(pattern))), F.lit(True)).cast("int")

    staged = staged.withColumns(
        {
            "_client_at": at(r"(?i)^CLIENT$"),
            "_product_at": at(r"(?i)^Product/Service$"),
            "_sum_at": at(r"(?i)Sum without VAT|Thank you"),
        }
    )
    # The client's block runs to the first blank line or to the item, however long it is.
    after = F.slice(arr, F.col("_client_at") + 1, F.greatest(F.size(arr) - F.col("_client_at"), F.lit(0)))
    staged = staged.withColumn("_after", F.when(F.col("_client_at") > 0, after))
    staged = staged.withColumn("_client_end", F.array_position(F.transform("_after", lambda x: (x == "") | F.contains(x, F.lit("Product/Service"))), F.lit(True)).cast("int"))
    last_client = F.col("_client_at") + F.when(F.col("_client_end") > 0, F.col("_client_end") - 1).otherwise(F.size("_after"))
    # The seller's is the last tax-id line outside that block.
    tax_lines = F.filter(
        F.transform(arr, lambda x, i: F.when(F.rlike(x, F.lit(r"(?i)VAT\s+no\.?:")), i + 1)),
        lambda i: i.isNotNull() & ~F.coalesce((i > F.col("_client_at")) & (i <= last_client) & (F.col("_client_at") > 0), F.lit(False)),
    )
    staged = staged.withColumn("_tax_at", F.coalesce(F.array_max(tax_lines), F.lit(0)).cast("int"))

    def slice_from(start: Column, stop: Column) -> Column:
        n = F.greatest(stop - start, F.lit(0))
        return F.when(start > 0, F.slice(arr, F.greatest(start, F.lit(1)), n))

    above = slice_from(F.greatest(F.col("_tax_at") - 5, F.lit(1)), F.col("_tax_at"))
    seller = F.filter(above, lambda x: (x != "") & ~F.rlike(x, F.lit(_NOT_A_NAME)))
    client_end = F.col("_client_end")
    client = F.when(client_end > 1, F.slice("_after", F.lit(1), client_end - 1)).when(client_end == 0, F.col("_after"))
    product = F.filter(
        slice_from(F.col("_product_at") + 1, F.col("_sum_at")),
        lambda x: (x != "") & ~F.rlike(x, F.lit(r"Price|Quantity|VAT|Sum")),
    )
    staged = staged.withColumns({"_seller": seller, "_client": client, "_product": product})
    plain_client = F.filter("_client", lambda x: ~F.rlike(x, F.lit(r"(?i)vat\s+no|reg\s+no")))
    num = r"([0-9]+(?:\.[0-9]+)?)"
    staged = staged.withColumns(
        {
            "_gross": group(t, rf"(?i)Invoice\s+total\s+{num}").try_cast(MONEY),
            "_tax": group(t, rf"VAT\s+[0-9]+%\s+{num}").try_cast(MONEY),
            "_net": group(t, rf"(?s)Sum without VAT[^0-9]*{num}").try_cast(MONEY),
            "_price": group(t, rf"Price[^0-9\n]*{num}").try_cast(MONEY),
            "_qty": F.coalesce(group(t, r"Quantity[^0-9\n]*([0-9]+)\s*\(pc").try_cast(MONEY), F.lit(1).cast(MONEY)),
            "_rate": F.coalesce(group(t, r"VAT\s+([0-9]+)%").try_cast(MONEY), F.lit(0).cast(MONEY)),
        }
    )
    item_net = F.coalesce("_net", (F.col("_price") * F.col("_qty")).try_cast(MONEY))
    net = F.coalesce("_net", item_net)
    item_tax = (item_net * F.col("_rate") / 100).try_cast(MONEY)
    keys = [c for c in ("doc_id", "page") if c in docs.columns]
    return staged.select(
        *keys,
        *keep,
        first_of(t, [r"(?i)Invoice\s+no\.?\s*:?\s*(\w+)"]).alias("document_number"),
        parse_date(group(t, r"(?m)^[ \t]*Date\s+([0-9]{2}\.[0-9]{2}\.[0-9]{4})")).alias("issue_date"),
        F.coalesce(
            group(t, r"(?i)Invoice\s+total\s+[0-9.]+\s*([A-Z]{3})"),
            F.when(F.contains(t, F.lit("EUR")), "EUR").when(F.contains(t, F.lit("PLN")), "PLN").otherwise("EUR"),
        ).alias("currency"),
        F.get("_seller", F.lit(0)).alias("seller_name"),
        F.nullif(F.array_join(F.slice("_seller", F.lit(2), F.size("_seller")), ", "), F.lit("")).alias("seller_address"),
        group(F.try_element_at(arr, F.nullif(F.col("_tax_at"), F.lit(0))), r"(?i)VAT\s+no\.?:\s*([A-Z0-9]+)").alias("seller_tax_id"),
        F.get(plain_client, F.lit(0)).alias("buyer_name"),
        F.nullif(F.array_join(F.slice(plain_client, F.lit(2), F.size(plain_client)), ", "), F.lit("")).alias("buyer_address"),
        group(F.array_join("_client", "\n"), r"(?i)VAT\s+no\.?:\s*([A-Z0-9]+)").alias("buyer_tax_id"),
        net.alias("subtotal"),
        F.coalesce("_tax", F.when(F.col("_gross") > net, (F.col("_gross") - net).try_cast(MONEY))).alias("tax_amount"),
        F.coalesce("_gross", (net + item_tax).try_cast(MONEY)).alias("total"),
        F.array_join("_product", " ").alias("item_description"),
        F.col("_qty").alias("item_quantity"),
        F.coalesce("_price", F.try_divide(item_net, F.col("_qty")).try_cast(MONEY)).alias("item_unit_price"),
        item_net.alias("item_net"),
        item_tax.alias("item_tax"),
    )
