"""Rule-driven field extraction.

A rule set is configuration. It is folded into literal column expressions on the driver, so that a corpus is read once,
every pattern is compiled once per task and no document is multiplied by the rules.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import parse_amount
from docledger.functions.checks import Validators
from docledger.functions.dates import parse_date, parse_date_formats
from docledger.functions.regexes import blank_to_null, explode_rows, found, group, quick
from docledger.operators.classify import config_rows
from docledger.schemas import MONEY


@dataclass(frozen=True)
class FieldRule:
    """One way to find a field; lower ``priority`` is tried first."""

    field: str
    pattern: str
    group: int = 1
    type: str = "text"
    format: str | None = None
    priority: int = 0
    confidence: float = 0.9
    ignore_case: bool = True
    lang: str | None = None

    @property
    def regex(self) -> str:
        return f"(?i){self.pattern}" if self.ignore_case else self.pattern


_DAY = r"[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}"
_SPOKEN = r"[0-9]{1,2} [a-z]{3,9} [0-9]{4}|[a-z]{3,9} [0-9]{1,2}, [0-9]{4}"
_MONEY = r"[€£$]?[ \t]*[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}"
_CENTS = r"[€£$]?[ \t]*[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}[.,][0-9]{2}"
_CODE = r"[a-z0-9/-]*[0-9][a-z0-9/-]*"
_SHARE = r"[0-9]{1,2}(?:[.,][0-9]{1,2})?[ \t]*%"
_LINE = r"[^\n]+"

# The vocabulary: what stands before a value, by meaning and language. All patterns below are composed from it.
LABELS: dict[str, dict[str, list[str]]] = {
    "number": {"en": ["invoice number", "invoice no", "invoice"], "de": ["rechnungsnummer", "rechnung"], "fr": ["facture"], "es": ["factura"], "it": ["fattura"], "pl": ["nr faktury", "faktura"]},
    "issued": {"en": ["invoice date", "issue date", "date"], "de": ["rechnungsdatum", "datum"], "fr": ["date de facturation"], "es": ["fecha de emisión", "fecha"], "pl": ["data wystawienia", "data"]},
    "due": {"en": ["payment due date", "payment due", "payment date", "due date"], "de": ["fälligkeitsdatum", "zahlungstermin"], "fr": ["date d'échéance"], "es": ["fecha de vencimiento"], "it": ["data scadenza"], "pl": ["termin płatności"]},
    "due_by": {"en": ["due on", "due by"]},
    "total": {"en": ["total amount", "total"], "de": ["gesamtbetrag", "summe"], "fr": ["montant total"], "es": ["importe total"], "pl": ["suma"]},
    "owed": {"en": ["amount due"]},
    "net": {"en": ["subtotal", "sub-total", "net"], "de": ["zwischensumme", "nettobetrag", "netto"], "fr": ["sous-total", "montant ht"], "it": ["subtotale", "imponibile"]},
    "tax": {"en": ["tax", "vat"], "de": ["mwst", "ust"], "fr": ["tva"], "es": ["iva"], "nl": ["btw"], "pl": ["podatek"]},
    "money": {"en": ["amount"], "de": ["betrag"], "fr": ["montant"], "es": ["importe"], "pl": ["kwota"]},
    "share": {"en": ["rate"], "de": ["satz"], "fr": ["taux"], "es": ["tasa"], "pl": ["stawka"]},
    "seller": {"en": ["vendor", "seller", "supplier", "from"], "de": ["verkäufer", "lieferant"], "fr": ["vendeur", "fournisseur"], "es": ["vendedor"], "pl": ["sprzedawca"]},
    "buyer": {"en": ["bill to", "customer", "buyer"], "de": ["käufer", "kunde"], "fr": ["acheteur", "client"], "es": ["comprador", "cliente"], "pl": ["nabywca"]},
    "tax_id": {"en": ["tax id", "vat id"], "de": ["ust-id", "steuernummer"], "fr": ["siret"], "es": ["cif", "nif"], "it": ["partita iva"], "pl": ["nip"]},
    "phone": {"en": ["phone", "tel"], "de": ["telefon"], "fr": ["téléphone"], "es": ["teléfono"], "it": ["telefono"]},
    "currency": {"en": ["currency"], "de": ["währung"], "fr": ["devise"], "es": ["moneda"], "pl": ["waluta"]},
    "terms": {"en": ["payment terms"], "de": ["zahlungsbedingungen"], "fr": ["conditions de paiement"], "es": ["condiciones de pago"], "it": ["termini di pagamento"]},
    "days": {"en": ["days"], "de": ["tagen"], "fr": ["jours"], "es": ["días"], "it": ["giorni"]},
    "order": {"en": ["purchase order"], "de": ["bestellnummer"], "fr": ["bon de commande"], "es": ["orden de compra"]},
    "method": {"en": ["payment method"], "de": ["zahlungsart", "zahlungsmethode"], "fr": ["moyen de paiement"], "es": ["forma de pago"], "it": ["metodo di pagamento"]},
}
CURRENCIES = ["usd", "eur", "gbp", "jpy", "inr", "cad", "aud", "chf", "cny", "sek", "nok", "dkk", "pln", "czk", "huf", "ron", "bgn"]


def any_label(*meanings: str) -> str:
    """A group of all labels of these meanings, longer ones first, with any blanks between their words."""
    labels = {label for m in meanings for own in LABELS[m].values() for label in own}
    return "(?:" + "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(labels, key=lambda x: (-len(x), x))) + ")"


def after(meaning: str, value: str, gap: str = r"\s*:?\s*", start: str = r"\b") -> str:
    """The pattern of a value that follows a label."""
    return f"{start}{any_label(meaning)}{gap}({value})"


_LINE_START = r"(?:^|\n)[ \t]*"
_COLON = r"\s*:[ \t]*"
_TAX_GAP = rf"\b(?:[ \t]+{any_label('money')})?(?:[ \t]*\([0-9.,]+[ \t]*%\))?[ \t]*:?[ \t]*"

# Default rules for the common fields. The confidences.
DEFAULT_FIELD_RULES: list[FieldRule] = [
    FieldRule("invoice_number", after("number", _CODE, r"[ \t]*(?:no|nr|number|nummer)?\.?[ \t]*[:#]?[ \t]*#?")),
    FieldRule("invoice_number", after("number", r"\S+", r"\.?\s*:\s*"), priority=1),
    FieldRule("issue_date", after("issued", _DAY, r"\b[^0-9\n]{0,20}", _LINE_START), type="date"),
    FieldRule("issue_date", after("issued", _DAY), type="date", priority=1, confidence=0.7),
    FieldRule("due_date", after("due", _DAY), type="date"),
    FieldRule("total_amount", after("total", _MONEY, rf"\b(?:[ \t]+{any_label('money')})?\s*:?\s*"), type="currency"),
    FieldRule("total_amount", after("owed", _MONEY), type="currency", priority=1),
    FieldRule("tax_amount", after("tax", _CENTS, _TAX_GAP), type="currency"),
    FieldRule("tax_rate", after("tax", _SHARE, rf"\b(?:[ \t]+{any_label('share')})?[ \t]*:?[ \t]*\(?"), type="percentage"),
    FieldRule("vendor_name", after("seller", _LINE, _COLON)),
    FieldRule("vendor_tax_id", after("tax_id", r"[a-z0-9][a-z0-9 ./-]*", _COLON), type="tax_id"),
    FieldRule("customer_name", after("buyer", _LINE, _COLON)),
    FieldRule("currency", after("currency", r"[a-z]{3}") + r"\b"),
]

# Wider catalogue: field names with a dot become struct members when assembled. The confidences.
RULE_CATALOGUE: list[FieldRule] = [
    FieldRule("invoice_number", after("number", _CODE, r"[\s:#]+(?:no\.?|nr\.?|number)?[\s:#]*")),
    FieldRule("invoice_number", rf"(?:\bno\.?|\bnr\.?|#)[\s:]*({_CODE})", confidence=0.8, priority=1),
    FieldRule("issue_date", r"\bdate\s+paid\s+([a-z]+\s+[0-9]{1,2},\s+[0-9]{4})", type="date", confidence=0.95),
    FieldRule("issue_date", after("issued", f"{_DAY}|{_SPOKEN}", r"\b[\s:]+", _LINE_START), type="date", priority=1),
    FieldRule("issue_date", f"({_DAY})", type="date", confidence=0.7, priority=2),
    FieldRule("due_date", after("due", f"{_DAY}|{_SPOKEN}", r"[\s:]+"), type="date"),
    FieldRule("due_date", after("due_by", _DAY, r"[\s:]+"), type="date", confidence=0.85, priority=1),
    FieldRule("seller.name", after("seller", _LINE, _COLON, _LINE_START), confidence=0.85),
    FieldRule("seller.tax_id", rf"\b{any_label('tax', 'tax_id')}\s*:[ \t]*([a-z]{{0,2}}[0-9][a-z0-9-]{{5,}})", type="tax_id"),
    FieldRule("seller.address", after("seller", _LINE, r"\s*:[^\n]*\n[ \t]*", _LINE_START), confidence=0.85),
    FieldRule("seller.email", r"\b([a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,})\b", type="email"),
    FieldRule("seller.phone", after("phone", r"[+0-9][0-9 ()-]{6,}", r"[\s:.]+"), type="phone", confidence=0.85),
    FieldRule("buyer.name", _LINE_START + rf"(?:{any_label('buyer')}|to)\s*:[ \t]*({_LINE})", confidence=0.85),
    FieldRule("buyer.tax_id", rf"\b{any_label('buyer')}\s+{any_label('tax', 'tax_id')}\s*:[ \t]*([a-z0-9-]+)", type="tax_id"),
    FieldRule("total_amount", after("total", _MONEY, r"\b[\s:]*"), type="currency", confidence=0.95),
    FieldRule("tax_amount", after("tax", _CENTS, r"\b[\s:]*(?:\(?[0-9.,]+\s*%\)?)?[\s:]*"), type="currency"),
    FieldRule("subtotal", after("net", _MONEY, r"[ \t]*:[ \t]*"), type="currency"),
    FieldRule("currency", rf"\b({'|'.join(CURRENCIES)})\b"),
    FieldRule("payment_terms", after("terms", _LINE, _COLON)),
    FieldRule("payment_terms", rf"\b((?:net|due)\s+[0-9]+\s+{any_label('days')})", confidence=0.85, priority=1),
    FieldRule("purchase_order", after("order", _CODE, r"[\s:#]+")),
    FieldRule("payment_method", after("method", _LINE, _COLON), confidence=0.85),
]


def fields_of(rules: Sequence[FieldRule]) -> list[str]:
    return list(dict.fromkeys(r.field for r in rules))


def _ordered(rules: Sequence[FieldRule], field: str) -> list[FieldRule]:
    own = [r for r in rules if r.field == field]
    return sorted(own, key=lambda r: r.priority)


def override_rules(base: Sequence[FieldRule], custom: dict[str, object] | Sequence[FieldRule]) -> list[FieldRule]:
    """Custom rules replace the base rules of the same field; a bare string is a text pattern."""
    if isinstance(custom, dict):
        given: list[FieldRule] = []
        for field, spec in custom.items():
            if isinstance(spec, str):
                given.append(FieldRule(field, spec))
                continue
            main = FieldRule(
                field,
                spec["pattern"],
                group=spec.get("group", 1),
                type=spec.get("type", "text"),
                format=spec.get("format"),
                confidence=spec.get("confidence", 0.9),
            )
            given.append(main)
            given += [
                replace(main, pattern=p, priority=i + 1) for i, p in enumerate(spec.get("fallback_patterns", []))
            ]
    else:
        given = list(custom)
    replaced = {r.field for r in given}
    return [r for r in base if r.field not in replaced] + given


def register_pattern(rules: Sequence[FieldRule], field: str, pattern: str, **options: object) -> list[FieldRule]:
    """Rule set with the rules of one field replaced by a new pattern."""
    return override_rules(rules, [FieldRule(field, pattern, **options)])


def load_rules(path: str, spark, base: Sequence[FieldRule] = ()) -> list[FieldRule]:
    """Rules from a JSON file (field -> pattern or object), read through Spark so that any file system serves."""
    text = config_rows(spark.read.text(path, wholetext=True))[0]["value"]
    return override_rules(base, json.loads(text))


def rules_from_table(df: DataFrame) -> list[FieldRule]:
    """Rules kept as rows (field, pattern, group, type, format, priority, confidence)."""
    return [
        FieldRule(
            r["field"], r["pattern"], r["group"], r["type"], r["format"], r["priority"], float(r["confidence"])
        )
        for r in sorted(config_rows(df), key=lambda r: (r["field"], r["priority"]))
    ]


def extract_field(text: Column | str, rules: Sequence[FieldRule]) -> Column:
    """First value any of the rules captures, in priority order."""
    ordered = sorted(rules, key=lambda r: r.priority)
    return F.coalesce(*[group(text, r.regex, r.group) for r in ordered])


def extract_wide(docs: DataFrame, rules: Sequence[FieldRule], text: str = "text") -> DataFrame:
    """One string column per field (dots become underscores)."""
    cols = {f.replace(".", "_"): extract_field(text, _ordered(rules, f)) for f in fields_of(rules)}
    return docs.withColumns(cols)


def extract_with_info(
    docs: DataFrame, rules: Sequence[FieldRule], text: str = "text", validators: Validators | None = None
) -> DataFrame:
    """Long result: one row per document and field with value, position, matched text, rule and validity.

    Fields without a match are rows too (``success`` false), as a caller needs to see what was not found.
    """
    validators = validators or Validators()
    t = F.col(text)
    per_field, where = [], []
    for f in fields_of(rules):
        chosen = None
        for i, r in enumerate(_ordered(rules, f)):
            rule_id = f"{f}/{i}"
            hit = F.struct(
                F.lit(f).alias("field"),
                group(text, r.regex, r.group).alias("value"),
                F.lit(True).alias("success"),
                F.lit(i).alias("fallback_index"),
                F.lit(float(r.confidence)).alias("confidence"),
                F.lit(r.type).alias("type"),
                F.lit(rule_id).alias("rule_id"),
            )
            cond = found(t, r.regex)
            where.append((rule_id, F.regexp_instr(t, F.lit(quick(r.regex))) - 1, F.regexp_extract(t, quick(r.regex), 0)))
            chosen = F.when(cond, hit) if chosen is None else chosen.when(cond, hit)
        types = _ordered(rules, f)[0].type
        missing = F.struct(
            F.lit(f).alias("field"),
            F.lit(None).cast("string").alias("value"),
            F.lit(False).alias("success"),
            F.lit(None).cast("int").alias("fallback_index"),
            F.lit(0.0).alias("confidence"),
            F.lit(types).alias("type"),
            F.lit(None).cast("string").alias("rule_id"),
        )
        per_field.append(chosen.otherwise(missing))
    keys = [c for c in docs.columns if c != text]
    rows = explode_rows(docs.select(*keys, text, F.array(*per_field).alias("_found")), "_found", "_i", "m")
    # Place and text of a match are found again by its rule, and only for callers who read them.
    pos, matched = F.lit(None).cast("int"), F.lit(None).cast("string")
    for rule_id, p, m in where:
        own = F.col("m.rule_id") == rule_id
        pos, matched = F.when(own, p).otherwise(pos), F.when(own, m).otherwise(matched)
    long = rows.select(
        *keys, "m.field", "m.value", "m.success", pos.alias("match_pos"), matched.alias("match_text"), "m.fallback_index",
        "m.confidence", "m.type", "m.rule_id",
    )
    valid = None
    for kind in sorted({r.type for r in rules}):
        cond = F.col("type") == kind
        check = validators.check(kind, F.col("value"))
        valid = F.when(cond, check) if valid is None else valid.when(cond, check)
    return long.withColumn("valid", F.when(F.col("success"), valid.otherwise(F.lit(False))))


def candidates(docs: DataFrame, rules: Sequence[FieldRule], extractor: str, text: str = "text") -> DataFrame:
    """Found values only, in the ``candidates`` layout."""
    return (
        extract_with_info(docs.select("doc_id", text), rules, text)
        .filter("success and value is not null")
        .select(
            "doc_id", "field", "value", "confidence", F.lit(extractor).alias("extractor"), "rule_id", "match_pos",
            "match_text",
        )
    )


def convert_value(col: Column, kind: str, fmt: str | Sequence[str] | None = None) -> Column:
    """Typed value; text that does not convert gives NULL, the raw column stays with the caller."""
    if kind == "int":
        return F.trim(col).try_cast("int")
    if kind == "float":
        return parse_amount(col).cast("double")
    if kind in ("decimal", "currency"):
        return parse_amount(col)
    if kind == "percentage":
        return F.translate(F.translate(col, "% ", ""), ",", ".").try_cast(MONEY)
    if kind == "date":
        if fmt:
            return parse_date_formats(col, [fmt] if isinstance(fmt, str) else list(fmt))
        return parse_date(col)
    if kind == "bool":
        # Words read as true.
        return F.lower(F.trim(col)).isin("true", "yes", "1", "y", "on")
    return col


def post_process(
    col: Column,
    swap: str | None = None,
    lookup: dict[str, str] | None = None,
    regex: tuple[str, str] | None = None,
) -> Column:
    """``old|new`` replacement, case-insensitive lookup, regex replacement, in this order."""
    out = col
    if swap:
        old, _, new = swap.partition("|")
        out = F.replace(out, F.lit(old), F.lit(new))
    if lookup:
        pairs = F.create_map(*[F.lit(x) for k, v in lookup.items() for x in (k.lower(), v)])
        out = F.coalesce(F.try_element_at(pairs, F.lower(out)), out)
    if regex:
        out = F.regexp_replace(out, regex[0], regex[1])
    return out


def pivot_candidates(cands: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row per document with one column per field; the field list is given, so no extra pass finds it."""
    picked = cands.filter(F.col("field").isin(list(fields)))
    return picked.groupBy("doc_id").pivot("field", list(fields)).agg(F.max_by("value", "confidence"))


# Fields of the record templates.
TEMPLATES: dict[str, dict[str, list[str]]] = {
    "invoice": {
        "": ["document_number", "issue_date", "due_date", "currency", "payment_terms", "payment_method", "notes"],
        "seller": ["name", "address", "tax_id", "phone", "email"],
        "buyer": ["name", "address", "tax_id", "phone", "email"],
        "totals": ["subtotal", "tax_rate", "tax_amount", "total"],
    },
    "receipt": {
        "": ["document_number", "issue_date", "currency", "payment_method"],
        "seller": ["name", "address", "tax_id", "phone"],
        "totals": ["subtotal", "tax_amount", "total"],
    },
    "payment": {
        "": ["document_number", "payment_date", "currency", "payment_method", "reference_number"],
        "payer": ["name", "account"],
        "payee": ["name", "account"],
        "totals": ["total"],
    },
}


def assemble_nested(df: DataFrame, template: str = "invoice", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Flat columns (``seller_name``) to the structs of a record template; fields nobody extracted are NULL."""
    have = set(df.columns)

    def leaf(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    out = [F.col(k) for k in keys]
    for part, names in TEMPLATES[template].items():
        if part:
            out.append(F.struct(*[leaf(f"{part}_{n}").alias(n) for n in names]).alias(part))
        else:
            out += [leaf(n).alias(n) for n in names]
    return df.select(*out)
