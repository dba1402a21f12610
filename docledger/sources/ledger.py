"""Invoices out of an order ledger: structured records, and the documents one would have received for them.

The star schema plays the part of an archive of business documents: :func:`ledger_items` and :func:`ledger_invoices`
give the records, :func:`render_documents` the texts from which extraction has to recover those records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.schemas import MONEY

LANGUAGES = ["en", "de", "es", "fr", "pl"]
CURRENCY = {"en": "USD", "de": "EUR", "es": "EUR", "fr": "EUR", "pl": "PLN"}

LABELS: dict[str, dict[str, str]] = {
    "en": {
        "title": "INVOICE", "number": "Invoice Number:", "issue": "Invoice Date:", "due": "Due Date:",
        "currency": "Currency:", "seller": "From:", "seller_tax": "Tax ID:", "seller_mail": "Email:",
        "buyer": "Bill To:", "buyer_tax": "Customer Tax ID:", "head": "Description   Quantity   Unit Price   Amount",
        "net": "Subtotal:", "tax": "VAT amount:", "total": "Total:", "terms": "Payment Terms: Net",
        "terms_end": "days", "method": "Payment Method:", "iban": "IBAN:",
    },
    "de": {
        "title": "RECHNUNG", "number": "Rechnungsnummer:", "issue": "Rechnungsdatum:", "due": "Fälligkeitsdatum:",
        "currency": "Währung:", "seller": "Lieferant:", "seller_tax": "USt-ID:", "seller_mail": "E-Mail:",
        "buyer": "Rechnungsempfänger:", "buyer_tax": "Kunden-Steuernummer:", "head": "Menge Bezeichnung Preis Betrag",
        "net": "Nettobetrag:", "tax": "Steuerbetrag:", "total": "Gesamtbetrag:", "terms": "Zahlungsziel:",
        "terms_end": "Tage", "method": "Zahlungsart:", "iban": "IBAN:",
    },
    "es": {
        "title": "FACTURA", "number": "Número:", "issue": "Fecha de emisión:", "due": "Fecha de vencimiento:",
        "currency": "Moneda:", "seller": "Vendedor:", "seller_tax": "NIF:", "seller_mail": "Correo:",
        "buyer": "Cliente:", "buyer_tax": "NIF del cliente:", "head": "Cantidad Concepto Precio Importe",
        "net": "Base imponible:", "tax": "Importe del IVA:", "total": "Total factura:", "terms": "Condiciones de pago:",
        "terms_end": "días", "method": "Forma de pago:", "iban": "IBAN:",
    },
    "fr": {
        "title": "FACTURE", "number": "Numéro:", "issue": "Date de facturation:", "due": "Date d'échéance:",
        "currency": "Devise:", "seller": "Vendeur:", "seller_tax": "SIRET:", "seller_mail": "Courriel:",
        "buyer": "Acheteur:", "buyer_tax": "SIRET acheteur:", "head": "Quantité Désignation Prix Montant",
        "net": "Montant HT:", "tax": "Montant TVA:", "total": "Total TTC:", "terms": "Conditions de paiement:",
        "terms_end": "jours", "method": "Mode de paiement:", "iban": "IBAN:",
    },
    "pl": {
        "title": "FAKTURA", "number": "Nr faktury:", "issue": "Data wystawienia:", "due": "Termin płatności:",
        "currency": "Waluta:", "seller": "Sprzedawca:", "seller_tax": "NIP:", "seller_mail": "E-mail:",
        "buyer": "Nabywca:", "buyer_tax": "NIP nabywcy:", "head": "Nazwa towaru   Cena   Ilość   VAT   Wartość",
        "net": "Suma netto:", "tax": "Kwota VAT:", "total": "Razem do zapłaty:", "terms": "Warunki płatności:",
        "terms_end": "dni", "method": "Metoda płatności:", "iban": "IBAN:",
    },
}


def _dec(c: Column, precision: int = 18, scale: int = 2) -> Column:
    return c.cast(f"decimal({precision},{scale})")


def ledger_items(lineitem: DataFrame) -> DataFrame:
    """One row per invoice line, exact decimals throughout; narrow."""
    quantity, price = _dec(F.col("l_quantity"), 9, 2), _dec(F.col("l_extendedprice"), 12, 2)
    rate = _dec(F.col("l_tax"), 4, 2)
    lines = lineitem.select(
        F.col("l_orderkey").alias("doc_id"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_suppkey").alias("supplier_id"),
        F.col("l_partkey").cast("string").alias("item_code"),
        F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" stock")).alias("description"),
        quantity.alias("quantity"),
        price.alias("unit_price"),
        (rate * 100).cast(MONEY).alias("tax_rate"),
        _dec(F.round(quantity * price * (1 - _dec(F.col("l_discount"), 4, 2)), 2)).alias("amount"),
        rate.alias("_rate"),
    )
    return lines.withColumn("tax_amount", _dec(F.round(F.col("amount") * F.col("_rate"), 2))).drop("_rate")


def ledger_totals(items: DataFrame, entries: bool = False) -> DataFrame:
    """Per document: line count, net and tax sums, and the supplier who issues the invoice. Partially aggregated.

    With ``entries`` also what is printed of its lines, in their order, so that sums and lines come from one pass over the items.
    """
    return items.groupBy("doc_id").agg(
        F.count("*").alias("n_items"),
        F.sum("amount").cast(MONEY).alias("subtotal"),
        F.sum("tax_amount").cast(MONEY).alias("tax_amount"),
        F.min("supplier_id").alias("supplier_id"),
        *([_entries()] if entries else []),
    )


def _entries() -> Column:
    """The printed values of the lines of a group, in the order of their numbers."""
    entry = F.struct("line_number", "item_code", "quantity", "unit_price", "amount", "tax_rate", "description")
    return F.sort_array(F.collect_list(entry)).alias("entries")


def _by_language(options: dict[str, Column], lang: Column) -> Column:
    out = None
    for code, value in options.items():
        out = F.when(lang == code, value) if out is None else out.when(lang == code, value)
    return out


def buyer_language(nation_key: Column) -> Column:
    """Language an invoice is written in: that of the buyer's nation, nations taking the languages in turn."""
    turn = F.pmod(F.coalesce(nation_key, F.lit(0)), F.lit(len(LANGUAGES)))
    return F.element_at(F.array(*[F.lit(x) for x in LANGUAGES]), (turn + 1).cast("int"))


def ledger_invoices(
    orders: DataFrame, totals: DataFrame, customer: DataFrame, supplier: DataFrame, nation: DataFrame, language: str | None = None
) -> DataFrame:
    """Invoice records of the ledger, one per order, with nested parties, totals and payment, all in one language if it is given.

    Totals with ``entries`` give records with the ``body`` of their texts: lines are printed as soon as the language is known,
    and are not moved again.

    Orders whose status is ``P`` state the ledger's own total, which differs from the line sums; orders without lines
    have neither seller nor net sums. Both give the validators real failures to find.
    """
    priority, status = F.col("o_orderpriority"), F.col("o_orderstatus")
    segment = F.col("c_mktsegment")
    terms_days = F.when(priority == "2-HIGH", 14).when(priority == "3-MEDIUM", 30)
    issue = F.col("o_orderdate").cast("date")
    nations = nation.select(F.col("n_nationkey"), F.col("n_name"))
    seller = supplier.select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name"), F.col("s_nationkey").alias("n_nationkey")
    ).join(nations, "n_nationkey", "left").withColumnRenamed("n_name", "s_nation").drop("n_nationkey")
    buyer = customer.select(
        F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey")
    ).join(nations, "n_nationkey", "left").withColumnRenamed("n_name", "c_nation").withColumnRenamed("n_nationkey", "c_nationkey")
    lang = buyer_language(F.col("c_nationkey")) if language is None else F.lit(language)
    base = orders.withColumn("doc_id", F.col("o_orderkey"))
    printed = ["body"] if "entries" in totals.columns else []
    if printed:
        # The buyer tells the language, and entries are moved by one join less.
        base = base.join(buyer, "o_custkey", "left").join(totals, "doc_id", "left").withColumn("body", _body(lang)).drop("entries")
    else:
        base = base.join(totals, "doc_id", "left").join(buyer, "o_custkey", "left")
    base = base.join(seller, "supplier_id", "left")
    null = F.lit(None)
    cust = F.col("o_custkey").cast("string")
    stated = F.when(status == "P", _dec(F.col("o_totalprice")).cast(MONEY)).otherwise(
        F.col("subtotal") + F.col("tax_amount")
    )
    money = F.lit(None).cast(MONEY)
    return base.select(
        "doc_id",
        F.lit("invoice").alias("doc_type"),
        F.concat(F.lit("INV-"), F.lpad(F.col("doc_id").cast("string"), 8, "0")).alias("document_number"),
        issue.alias("issue_date"),
        F.when(priority == "1-URGENT", F.date_add(issue, 7))
        .when(priority == "5-LOW", F.date_add(issue, 400))
        .otherwise(F.date_add(issue, terms_days))
        .alias("due_date"),
        _by_language({k: F.lit(v) for k, v in CURRENCY.items()}, lang).alias("currency"),
        F.when(
            F.col("s_name").isNotNull(),
            F.struct(
                F.col("s_name").alias("name"),
                F.col("s_nation").alias("address"),
                F.concat(F.lit("SU"), F.lpad(F.col("supplier_id").cast("string"), 8, "0")).alias("tax_id"),
                null.cast("string").alias("registration_number"),
                null.cast("string").alias("vat_number"),
                null.cast("string").alias("phone"),
                F.concat(F.lit("s"), F.col("supplier_id").cast("string"), F.lit("@example.com")).alias("email"),
            ),
        ).alias("seller"),
        F.when(
            F.col("c_name").isNotNull(),
            F.struct(
                F.col("c_name").alias("name"),
                F.col("c_nation").alias("address"),
                F.when(segment != "FURNITURE", F.lpad(cust, 10, "0")).alias("tax_id"),
                null.cast("string").alias("registration_number"),
                null.cast("string").alias("vat_number"),
                F.concat(F.lit("+49 30 "), F.lpad(cust, 7, "0")).alias("phone"),
                F.concat(
                    F.lit("c"), cust, F.when(segment == "MACHINERY", F.lit("@invalid")).otherwise(F.lit("@example.com"))
                ).alias("email"),
            ),
        ).alias("buyer"),
        F.struct(
            F.col("subtotal").alias("subtotal"),
            F.when(priority == "1-URGENT", F.lit("5").cast(MONEY)).alias("tax_rate"),
            F.col("tax_amount").alias("tax_amount"),
            money.alias("discount"),
            money.alias("shipping"),
            stated.cast(MONEY).alias("total"),
            _by_language({k: F.lit(v) for k, v in CURRENCY.items()}, lang).alias("currency"),
        ).alias("totals"),
        F.struct(
            F.concat(F.lit("Net "), terms_days.cast("string")).alias("terms"),
            terms_days.cast("int").alias("terms_days"),
            F.when(status == "O", "Bank Transfer").when(status == "F", "Credit Card").alias("method"),
            null.cast("string").alias("status"),
            null.cast("string").alias("bank_name"),
            F.when(segment == "BUILDING", F.concat(F.lit("DE"), F.lpad(cust, 20, "0"))).alias("bank_account"),
            F.when(segment == "BUILDING", F.concat(F.lit("DE"), F.lpad(cust, 20, "0"))).alias("iban"),
            null.cast("string").alias("swift"),
        ).alias("payment"),
        null.cast("string").alias("order_number"),
        null.cast("string").alias("reference_number"),
        null.cast("date").alias("delivery_date"),
        null.cast("string").alias("notes"),
        lang.alias("language"),
        null.cast("double").alias("confidence"),
        *printed,
    )


def _line_text(entry: Column, lang: Column) -> Column:
    """One item line in the layout of its language."""
    qty, price = entry["quantity"].cast("string"), entry["unit_price"].cast("string")
    amount, description = entry["amount"].cast("string"), entry["description"]

    def comma(c: Column) -> Column:
        return F.translate(c, ".", ",")

    columns = F.concat_ws("   ", description, qty, price, amount)
    factor = F.concat_ws(" ", comma(qty), F.lit("x"), description, comma(price), F.lit("EUR"), comma(amount))
    rate = F.concat(entry["tax_rate"].cast("int").cast("string"), F.lit("%"))
    polish = F.concat_ws("   ", description, comma(price), comma(qty), rate, comma(amount))
    return F.when(lang == "en", columns).when(lang == "pl", polish).otherwise(factor)


def _body(lang: Column) -> Column:
    """The lines of ``entries`` as they are printed."""
    return F.array_join(F.transform("entries", lambda e: _line_text(e, lang)), "\n")


def in_language(invoices: DataFrame, language: str) -> DataFrame:
    """The same invoices, all written in one language and its currency."""
    money = F.lit(CURRENCY[language])
    return invoices.withColumn("language", F.lit(language)).withColumn("currency", money).withColumn("totals", F.col("totals").withField("currency", money))


def render_documents(invoices: DataFrame, items: DataFrame, page_lines: int | None = None) -> DataFrame:
    """Invoice texts (doc_id, page, text, source, metadata) in five languages.

    A document is one text. With ``page_lines`` it is one text for each range of so many line numbers instead, so that an
    order which owns a large share of the ledger is spread over many rows; lines keep their order, every page repeats
    the header and the totals, as printed invoices do, and the pipeline puts the pages of a document together again.
    """
    page = F.lit(0) if page_lines is None else F.coalesce(F.floor((F.col("line_number") - 1) / page_lines), F.lit(0))
    body = (
        items.select(
            "doc_id",
            page.cast("int").alias("page"),
            "line_number", "item_code", "quantity", "unit_price", "amount", "tax_rate", "description",
        )
        .groupBy("doc_id", "page")
        .agg(_entries())
    )
    joined = invoices.join(body, "doc_id", "left").withColumn("page", F.coalesce("page", F.lit(0)))
    return _texts(joined.withColumn("body", _body(F.col("language"))))


def _texts(printed: DataFrame) -> DataFrame:
    """The texts of invoices, given with the body of each page."""
    return printed.select(
        "doc_id",
        "page",
        _document_text().alias("text"),
        F.lit("ledger").alias("source"),
        F.create_map(
            F.lit("language"), F.col("language"),
            F.lit("filename"), F.concat(F.col("document_number"), F.lit(".txt")),
        ).alias("metadata"),
    )


def _document_text() -> Column:
    lang = F.col("language")

    def label(name: str) -> Column:
        return _by_language({k: F.lit(v[name]) for k, v in LABELS.items()}, lang)

    def row(name: str, value: Column) -> Column:
        # concat gives NULL for a missing value and concat_ws then leaves the line out.
        return F.concat(label(name), F.lit(" "), value)

    def day(c: Column) -> Column:
        return _by_language(
            {
                "en": F.date_format(c, "yyyy-MM-dd"),
                "de": F.date_format(c, "dd.MM.yyyy"),
                "pl": F.date_format(c, "dd.MM.yyyy"),
                "es": F.date_format(c, "dd/MM/yyyy"),
                "fr": F.date_format(c, "dd/MM/yyyy"),
            },
            lang,
        )

    def money(c: Column) -> Column:
        s = _dec(c).cast("string")
        return F.when(lang == "en", s).otherwise(F.concat(F.translate(s, ".", ","), F.lit(" "), F.col("currency")))

    days = F.col("payment.terms_days")
    return F.concat_ws(
        "\n",
        F.when(lang == "en", F.concat(label("title"), F.lit(" #"), F.col("document_number"))).otherwise(label("title")),
        row("number", F.col("document_number")),
        row("issue", day(F.col("issue_date"))),
        # A due date that follows from the terms is not printed.
        F.when(days.isNull(), row("due", day(F.col("due_date")))),
        row("currency", F.col("currency")),
        F.lit(""),
        row("seller", F.col("seller.name")),
        row("seller_tax", F.col("seller.tax_id")),
        row("seller_mail", F.col("seller.email")),
        F.lit(""),
        row("buyer", F.col("buyer.name")),
        row("buyer_tax", F.col("buyer.tax_id")),
        F.lit(""),
        label("head"),
        F.col("body"),
        F.lit(""),
        row("net", money(F.col("totals.subtotal"))),
        row("tax", money(F.col("totals.tax_amount"))),
        row("total", money(F.col("totals.total"))),
        F.lit(""),
        F.concat(label("terms"), F.lit(" "), days.cast("string"), F.lit(" "), label("terms_end")),
        row("method", F.col("payment.method")),
        row("iban", F.col("payment.iban")),
    )


class Ledger:
    """The ledger tables of one folder, and the views derived from them."""

    def __init__(self, spark, folder: str) -> None:
        def table(name: str) -> DataFrame:
            return spark.read.parquet(f"{folder}/{name}.parquet")

        self.orders, self.lineitem = table("orders"), table("lineitem")
        self.customer, self.supplier, self.nation = table("customer"), table("supplier"), table("nation")

    @property
    def items(self) -> DataFrame:
        return ledger_items(self.lineitem)

    @property
    def totals(self) -> DataFrame:
        return ledger_totals(self.items)

    @property
    def invoices(self) -> DataFrame:
        return ledger_invoices(self.orders, self.totals, self.customer, self.supplier, self.nation)

    @property
    def documents(self) -> DataFrame:
        return self.render()

    def render(self, language: str | None = None, page_lines: int | None = None) -> DataFrame:
        """The documents, all in one language if it is given."""
        if page_lines is not None:
            invoices = self.invoices if language is None else in_language(self.invoices, language)
            return render_documents(invoices, self.items, page_lines)
        totals = ledger_totals(self.items, entries=True)
        invoices = ledger_invoices(self.orders, totals, self.customer, self.supplier, self.nation, language)
        invoices = invoices if language is None else in_language(invoices, language)
        return _texts(invoices.withColumn("page", F.lit(0)))
