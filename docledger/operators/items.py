"""Line items: from text to rows, and the arithmetic on item tables.

Text operators work on the line array of one document and return an array of item structs, so they neither explode nor
shuffle until the caller wants rows. Table operators group by keys that spread (document plus content) before they group
by document, and attach sums by joins that adaptive execution can split when one document is huge.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docledger.functions.amounts import parse_digits
from docledger.functions.currency import CODES
from docledger.functions.regexes import explode_rows, group, let
from docledger.functions.text import lines, normalize_description, short_blanks
from docledger.schemas import MONEY

SEP = "\x01"
# Order of the parts every shape is rewritten to.
PARTS = ["item_code", "description", "quantity", "unit", "unit_price", "net_amount", "tax_rate", "tax_amount", "amount", "currency"]
NUMERIC = {"quantity", "unit_price", "net_amount", "tax_rate", "tax_amount", "amount"}

N = r"[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}"
P = rf"[€$£¥]?[ \t]*+({N})"
D = r"([\p{L}\p{N}_][\p{L}\p{N}_ \t.,()&+'/-]*?)"
S = r"[ \t]++"

# Shapes as (pattern, parts by capture group); the whole line has to fit.
GENERIC_SHAPES = [
    (rf"^[ \t]*{D}{S}({N}){S}([A-Za-z]+){S}{P}{S}{P}[ \t]*$", ["description", "quantity", "unit", "unit_price", "amount"]),
    (rf"^[ \t]*({N})[ \t]*[xX×][ \t]*{D}[ \t]*@[ \t]*{P}{S}{P}[ \t]*$", ["quantity", "description", "unit_price", "amount"]),
    (rf"^[ \t]*({N}){S}([\p{{L}}][\p{{L}}\p{{N}}_ \t.,()&+'/-]*?){S}{P}{S}{P}[ \t]*$", ["quantity", "description", "unit_price", "amount"]),
    (rf"^[ \t]*{D}{S}-{S}{P}[ \t]*$", ["description", "amount"]),
]
ENGLISH_SHAPES = [
    (rf"^[ \t]*({N})[ \t]*[xX×][ \t]*([^@\n]+?)[ \t]*@[ \t]*{P}[ \t]*=[ \t]*{P}[ \t]*$", ["quantity", "description", "unit_price", "amount"]),
    (rf"^[ \t]*([^\n]{{4,}}?[\p{{L}})]){S}[€$£¥]?[ \t]*([0-9]+(?:,[0-9]{{3}}){{0,5}}(?:\.[0-9]{{2}})?)[ \t]*$", ["description", "amount"]),
]
LANGUAGE_SHAPES = {
    lang: [(rf"^[ \t]*({N})[ \t]+[xX*][ \t]+([^\n]+?){S}({N}){S}([A-Z]{{3}}){S}({N})[ \t]*$", ["quantity", "description", "unit_price", "currency", "amount"])]
    for lang in ("de", "es", "fr")
}
LANGUAGE_SHAPES["en"] = ENGLISH_SHAPES
LANGUAGE_SHAPES["pl"] = [
    (rf"^[ \t]*([^\n]+?)[ \t]{{2,}}({N}){S}({N})(?:[ \t]*\([^)\n]*\))?{S}({N})%{S}({N})[ \t]*$", ["description", "unit_price", "quantity", "tax_rate", "amount"]),
    (rf"^[ \t]*([^\n]+?)[ \t]{{2,}}({N})[ \t]*([A-Z]{{3}})[ \t]*$", ["description", "amount", "currency"]),
    (rf"^[ \t]*([^\n]+?)[ \t]{{2,}}([0-9]+[.,][0-9]{{2}})[ \t]*$", ["description", "amount"]),
]
_SIGNED = r"(\(?-?[0-9]{1,15}(?:[.,][0-9]{1,15}){0,6}\)?)"
VENDOR_SHAPES = [
    (rf"^[ \t]*([0-9]+){S}([^\n]+?){S}([0-9]+){S}([A-Z]{{2}}){S}{_SIGNED}{S}{_SIGNED}{S}([0-9.,]+)%{S}{_SIGNED}{S}{_SIGNED}[ \t]*$",
     ["item_code", "description", "quantity", "unit", "unit_price", "net_amount", "tax_rate", "tax_amount", "amount"]),
    (rf"^[ \t]*([0-9]+){S}([^\n]+?){S}([0-9]+){S}([A-Z]{{2}}){S}{_SIGNED}{S}{_SIGNED}[ \t]*$",
     ["item_code", "description", "quantity", "unit", "unit_price", "net_amount"]),
]

# Words that a summary line begins with, and words of header lines.
SUMMARY_WORDS = ["subtotal", "sub-total", "total", "tax", "vat", "shipping", "discount", "amount due", "balance", "payment"]
HEADER_WORDS = r"\b(?:DESCRIPTION|ITEM|QTY|PRICE|AMOUNT|TOTAL)"
POLISH_SKIP = r"(?i)produkt|usługa|towar|nazwa|suma|razem|kwota|^[ \t]*vat\b"
SECTION_START = r"item|description|product|groceries"

# A summary line begins with one of its words, may go on in words that qualify a sum, and then holds no more letters than a
# currency; or its label ends in a colon. "Tax consulting" or "Total station" begin an item.
_BEFORE = ["grand", "net", "gross", "sales", "order", "invoice"]
_AFTER = ["total", "tax", "vat", "due", "amount", "sum", "net", "gross", "before", "after", "incl", "excl", "including", "excluding", "of", "in", "to", "pay", "and", "handling", "costs?", "fees?", "rate", "method", "terms", "payable", "now"]
_UNIT = rf"(?:{'|'.join(c.lower() for c in CODES)}|zł|kr)"
SUMMARY_LINE = (
    rf"^[ \t|]*+(?:(?:{'|'.join(_BEFORE)})[ \t]++)?(?:{'|'.join(SUMMARY_WORDS)})(?![\p{{L}}\p{{N}}_])(?:[ \t.&/(]++(?:{'|'.join(_AFTER)})(?![\p{{L}}_]))*+"
    rf"(?:[ \t)]*+:|[^\p{{L}}]*+(?:{_UNIT}(?![\p{{L}}])[^\p{{L}}]*+)?$)"
)
# A line that opens a list of items: a heading of its own, or the names of two columns.
_COLUMNS = r"(?:items?|products?|description|article|qty|quantity|unit|price|amount|rate)"
SECTION_LINE = rf"^[^\p{{L}}\p{{N}}]*+(?:(?:invoice |line |order )?(?:items?|products|merchandise|groceries)(?: (?:details|information|purchased))?[^\p{{L}}\p{{N}}]*+$|{_COLUMNS}[ \t|]++(?:[^\n]*[ \t|])?{_COLUMNS}(?![\p{{L}}]))"


def is_summary(line: Column) -> Column:
    """True for a line that states a sum, a tax, a discount or a payment, and nothing else."""
    return F.rlike(F.lower(line), F.lit(SUMMARY_LINE))


def item_section(text: Column) -> Column:
    """Text from the first line that opens a list of items to the first summary line after it, the whole text if there is none."""
    section = _between(lines(text), lambda x: F.rlike(F.lower(x), F.lit(SECTION_LINE)), is_summary)
    return F.coalesce(let(section, lambda found: F.when(F.size(found) > 0, F.array_join(found, "\n"))), text)


def is_item_line(line: Column) -> Column:
    """Long enough, no header, no summary word, with three letters in a row and a price."""
    header = (F.upper(line) == line) & F.rlike(line, F.lit(HEADER_WORDS))
    return (
        (F.length(F.trim(line)) >= 5)
        & ~header
        & ~is_summary(line)
        & F.rlike(line, F.lit(r"[a-zA-Z]{3,}"))
        & F.rlike(line, F.lit(r"[0-9]+[,.][0-9]{2}"))
    )


def _template(groups: Sequence[str]) -> str:
    slots = {name: f"${i + 1}" for i, name in enumerate(groups)}
    return SEP + SEP.join(slots.get(p, "") for p in PARTS)


def _fit(line: Column, shapes: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The line rewritten to the common part order by the first shape that fits; it then starts with the separator.

    A rewritten line fits no later shape, because its amount is no longer at the end: one regex per shape suffices.
    """
    for pat, gs in shapes:
        line = F.regexp_replace(line, pat, _template(gs))
    return line


def _signed_digits(c: Column) -> Column:
    plain = parse_digits(F.translate(c, "()€$£¥ ", ""))
    return F.when(F.startswith(c, F.lit("(")), -F.abs(plain)).otherwise(plain)


def _raw(parts: Column, signed: bool, clean: bool) -> Column:
    """Struct of the typed parts of a fitted line."""
    out = []
    for i, name in enumerate(PARTS):
        text = F.trim(parts[i + 1])
        if name in NUMERIC:
            text = F.when(text != "", _signed_digits(text) if signed else parse_digits(text))
        elif name == "description" and clean:
            text = normalize_description(text)
        out.append(text.alias(name))
    return F.struct(*out)


def _item(raw: Column) -> Column:
    """Item struct with quantity, price and amount derived where they are missing."""
    quantity = F.coalesce(raw["quantity"], F.lit(1).cast(MONEY))
    with_tax = (raw["net_amount"] + F.coalesce(raw["tax_amount"], F.lit(0).cast(MONEY))).try_cast(MONEY)
    amount = F.coalesce(raw["amount"], with_tax)
    values = {p: raw[p] if p in NUMERIC else F.nullif(raw[p], F.lit("")) for p in PARTS}
    values["quantity"], values["amount"] = quantity, amount
    values["unit_price"] = F.coalesce(raw["unit_price"], F.try_divide(amount, quantity).try_cast(MONEY))
    return F.struct(*[values[p].alias(p) for p in PARTS])


def items_by_shapes(
    arr: Column, shapes: Sequence[tuple[str, Sequence[str]]], signed: bool = False, clean: bool = True
) -> Column:
    """Array of items of the lines that fit one of the shapes; others are left out."""
    fitted = F.filter(F.transform(arr, lambda x: _fit(short_blanks(x), shapes)), lambda x: F.startswith(x, F.lit(SEP)))
    raws = F.transform(F.transform(fitted, lambda x: F.split(x, SEP)), lambda p: _raw(p, signed, clean))
    items = F.transform(raws, _item)
    return F.filter(items, lambda i: i["description"].isNotNull() & (i["description"] != "") & i["amount"].isNotNull())


def items_by_pattern(arr: Column) -> Column:
    """Four generic row shapes; needs a description and a positive amount, and the line must not be a summary."""
    rows = F.filter(arr, lambda x: ~is_summary(x))
    return F.filter(items_by_shapes(rows, GENERIC_SHAPES), lambda i: i["amount"] > 0)


def _between(arr: Column, start: Callable[[Column], Column], end: Callable[[Column], Column]) -> Column:
    """Lines after the first one that is a ``start`` up to the next one that is an ``end``; null if no line starts."""

    def first(a: Column, test: Callable[[Column], Column]) -> Column:
        return F.array_position(F.transform(a, test), F.lit(True)).cast("int")

    def after(i: Column) -> Column:
        return F.when(i > 0, F.slice(arr, i + 1, F.greatest(F.size(arr) - i, F.lit(0))))

    def until(tail: Column) -> Column:
        return let(first(tail, end), lambda j: F.when(j > 0, F.slice(tail, 1, j - 1)).otherwise(tail))

    return let(let(first(arr, start), after), until)


def items_by_lines(arr: Column) -> Column:
    """Items of the section between a header line and the next summary line.

    A line splits on two or more spaces (or pipes) into description [, quantity [, price]], amount; otherwise the
    trailing number is the amount and an "n x" factor the quantity.
    """
    section = F.filter(_between(arr, lambda x: F.rlike(F.lower(x), F.lit(SECTION_START)), is_summary), is_item_line)
    # Fixed layouts by number of columns, rewritten like any other shape.
    cell = r"([^\n|]+?)"
    gap = r"(?:[ \t]{2,}|[ \t]*\|[ \t]*)"
    edge = r"[ \t]*\|?[ \t]*"
    num = r"[€$£¥]?[ \t]*([0-9][0-9.,]*)[a-zA-Z]*"
    shapes = [
        (rf"^{edge}{cell}{gap}{num}{gap}{num}{gap}{num}{edge}$", ["description", "quantity", "unit_price", "amount"]),
        (rf"^{edge}{cell}{gap}{num}{gap}{num}{edge}$", ["description", "quantity", "amount"]),
        (rf"^{edge}{cell}{gap}{num}{edge}$", ["description", "amount"]),
        (rf"^[ \t]*({N})[ \t]*(?:x|×|ea|pcs)[ \t]*([^\n]*?)[ \t]*[€$£¥]?({N})[ \t]*$", ["quantity", "description", "amount"]),
        (rf"^[ \t]*([^\n]*?)[ \t]*[€$£¥]?({N})[ \t]*$", ["description", "amount"]),
    ]
    return items_by_shapes(section, shapes)


# Words that name a column of an item table, in test order.
COLUMN_WORDS = [
    ("description", r"desc|item|product|service"),
    ("quantity", r"qty|quantity|amount"),
    ("unit_price", r"price|rate|unit"),
    ("total", r"total"),
]


def _column_name(header: Column) -> Column:
    out = None
    for name, words in COLUMN_WORDS:
        cond = F.rlike(F.lower(header), F.lit(words))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise("")


def _cells(line: Column) -> Column:
    bare = F.regexp_replace(line, r"^[ \t|]+|[ \t|]+$", "")
    return F.split(bare, r"[ \t]*\|[ \t]*|[ \t]{2,}|\t")


def items_by_header(arr: Column) -> Column:
    """Items of a table whose header names its columns: rows are mapped by position, not by shape.

    A column called "amount" next to a quantity column is the row total.
    """
    return let(F.filter(arr, lambda x: F.trim(x) != ""), _header_table)


def _header_table(filled: Column) -> Column:
    def is_header(x: Column) -> Column:
        named = F.filter(F.transform(_cells(x), _column_name), lambda n: n != "")
        return ~F.rlike(x, F.lit("[0-9]")) & (F.size(named) >= 2)

    def names_at(i: Column) -> Column:
        names = F.transform(_cells(F.when(i > 0, F.try_element_at(filled, i))), _column_name)
        return let(
            names,
            lambda ns: F.transform(
                ns, lambda n, k: F.when((n == "quantity") & (F.array_position(ns, "quantity") <= k), "total").otherwise(n)
            ),
        )

    def rows_after(i: Column) -> Column:
        rows = F.when(i > 0, F.slice(filled, i + 1, F.greatest(F.size(filled) - i, F.lit(0))))
        ends = F.transform(rows, lambda x: F.rlike(F.lower(x), F.lit(r"total|balance|amount due")))
        stop = F.array_position(ends, F.lit(True)).cast("int")
        return let(stop, lambda j: F.when(j > 0, F.slice(rows, 1, j - 1)).otherwise(rows))

    def items(i: Column) -> Column:
        cells = F.filter(F.transform(rows_after(i), _cells), lambda c: F.size(c) >= 2)
        return let(names_at(i), lambda names: F.transform(cells, lambda c: _header_item(c, names)))

    header_at = F.array_position(F.transform(filled, is_header), F.lit(True)).cast("int")
    return F.filter(
        let(header_at, items),
        lambda i: i["description"].isNotNull() & (i["amount"].isNotNull() | i["unit_price"].isNotNull()),
    )


def _header_item(cells: Column, names: Column) -> Column:
    def value(name: str) -> Column:
        at = F.array_position(names, F.lit(name)).cast("int")
        return F.when(at > 0, F.try_element_at(cells, at))

    def number(name: str) -> Column:
        return parse_digits(F.regexp_replace(value(name), r"[^0-9.,]", ""))

    quantity, price, total = number("quantity"), number("unit_price"), number("total")
    known = {
        "description": F.nullif(F.trim(value("description")), F.lit("")),
        "quantity": F.coalesce(quantity, F.lit(1).cast(MONEY)),
        "unit_price": F.coalesce(price, F.try_divide(total, quantity).try_cast(MONEY)),
        "amount": F.coalesce(total, (quantity * price).try_cast(MONEY)),
    }
    empty = {p: F.lit(None).cast(MONEY if p in NUMERIC else "string") for p in PARTS}
    return F.struct(*[{**empty, **known}[p].alias(p) for p in PARTS])


def items_by_rule(
    text: Column, start: str, end: str, row: str, columns: Sequence[tuple[str, str]], required: Sequence[str] = ()
) -> Column:
    """Items of the section between two patterns, one per line the row pattern fits, with named typed columns."""
    body = group(text, rf"(?is){start}(.*?)(?:{end}|\z)")
    template = SEP + SEP.join(f"${i + 1}" for i in range(len(columns)))
    fitted = F.filter(
        F.transform(lines(body), lambda x: F.regexp_replace(x, row, template)), lambda x: F.startswith(x, F.lit(SEP))
    )

    def item(p: Column) -> Column:
        out = []
        for i, (name, kind) in enumerate(columns):
            raw = F.nullif(F.trim(p[i + 1]), F.lit(""))
            value = raw if kind in ("str", "text") else parse_digits(F.regexp_replace(raw, r"[^0-9.,-]", ""))
            out.append(value.alias(name))
        return F.struct(*out)

    items = F.transform(F.transform(fitted, lambda x: F.split(x, SEP)), item)

    def complete(i: Column) -> Column:
        ok = F.lit(True)
        for name in required:
            ok = ok & i[name].isNotNull()
        return ok

    return F.filter(items, complete)


def items_lang(arr: Column, lang: str) -> Column:
    """Row shapes of one language pack. Polish rows that repeat header or summary words are skipped."""
    rows = F.filter(arr, lambda x: ~F.rlike(x, F.lit(POLISH_SKIP))) if lang == "pl" else arr
    items = items_by_shapes(rows, LANGUAGE_SHAPES[lang], clean=False)
    if lang != "pl":
        return items
    # A quantity within a hundredth of a whole number is that number.
    whole = lambda q: F.round(q, 0)
    return F.transform(
        items,
        lambda i: i.withField(
            "quantity",
            F.when(F.abs(i["quantity"] - whole(i["quantity"])) < 0.01, whole(i["quantity"]).try_cast(MONEY)).otherwise(
                i["quantity"]
            ),
        ),
    )


def items_by_language(arr: Column, lang: Column, default: str = "en") -> Column:
    """Items of every row by the pack of its own language; only that branch is evaluated."""
    out = None
    for code in LANGUAGE_SHAPES:
        if code == default:
            continue
        out = F.when(lang == code, items_lang(arr, code)) if out is None else out.when(lang == code, items_lang(arr, code))
    if default != "en":
        return out.otherwise(items_lang(arr, default))
    # English rows below a header line, else rows that fit an English shape on their own; an empty list if there is neither.
    below = F.get(F.filter(F.array(items_by_lines(arr)), lambda found: F.size(found) > 0), F.lit(0))
    return out.otherwise(F.coalesce(below, items_lang(arr, "en")))


def items_en(arr: Column) -> Column:
    return items_lang(arr, "en")


def items_vendor(arr: Column) -> Column:
    """Coded vendor rows with unit, net [, rate, tax, total]; bracketed values are negative, refunds all negative."""
    return F.transform(items_by_shapes(arr, VENDOR_SHAPES, signed=True, clean=False), refund_sign)


def is_refund(item: Column) -> Column:
    negative = (item["unit_price"] < 0) | (item["net_amount"] < 0) | (item["amount"] < 0)
    return F.coalesce(negative, F.lit(False)) | F.coalesce(
        F.contains(F.lower(item["description"]), F.lit("credit")), F.lit(False)
    )


def refund_sign(item: Column) -> Column:
    """Item with every money value negative if it is a refund."""
    refund = is_refund(item)
    out = item
    for name in ("unit_price", "net_amount", "tax_amount", "amount"):
        out = out.withField(name, F.when(refund, -F.abs(item[name])).otherwise(item[name]))
    return out


def extract_items(docs: DataFrame, method: str = "auto", text: str = "text") -> DataFrame:
    """Add an ``items`` array. ``auto``: generic shapes on the item section, else line scanning."""
    staged = docs.withColumn("_lines", lines(F.col(text)))
    arr = F.col("_lines")
    if method == "auto":
        staged = staged.withColumn("_section", lines(item_section(F.col(text))))
        staged = staged.withColumn("_shaped", items_by_pattern(F.col("_section")))
        items = F.when(F.size("_shaped") > 0, F.col("_shaped")).otherwise(items_by_lines(arr))
        return staged.withColumn("items", items).drop("_lines", "_section", "_shaped")
    makers = {
        "pattern": items_by_pattern,
        "lines": items_by_lines,
        "header": items_by_header,
        "vendor": items_vendor,
        "en": items_en,
    }
    if method == "language":
        return staged.withColumn("items", items_by_language(arr, F.col("language"))).drop("_lines")
    maker = makers[method] if method in makers else (lambda a: items_lang(a, method))
    return staged.withColumn("items", maker(arr)).drop("_lines")


def explode_items(df: DataFrame, extractor: str = "text", keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``invoice_items`` rows of an ``items`` array, numbered from 1 within their row."""
    present = [k for k in (*keys, "page") if k in df.columns]
    return explode_rows(df.select(*present, "items"), "items", "_pos", "_item").select(
        *present, (F.col("_pos") + 1).alias("item_no"), "_item.*", F.lit(extractor).alias("extractor")
    )


# ---- item tables


def dedupe_items(items: DataFrame, key: str = "doc_id", order: str = "item_no") -> DataFrame:
    """First of equal (trimmed description, quantity, unit price) rows of a document.

    An aggregate instead of a ranking window: copies collapse map-side, so a group of copies never meets in one task.
    """
    rest = [c for c in items.columns if c not in (key, "description", "quantity", "unit_price", order)]
    row = F.struct(*[F.col(c) for c in (order, "description", *rest)])
    return (
        items.groupBy(key, F.trim("description").alias("_d"), "quantity", "unit_price")
        .agg(F.min_by(row, F.struct(order, *[F.col(c).cast("string") for c in rest])).alias("_r"))
        .select(key, "quantity", "unit_price", "_r.*")
        .select(*items.columns)
    )


def merge_next_line(arr: Column, item: str = r"[0-9]+[.,][0-9]{2}\s*$", continuation: str = r"20[0-9]{2}.*-|-.*20[0-9]{2}") -> Column:
    """Lines with a date-range line appended in brackets to the item line above it, and consumed there."""
    n = F.size(arr)

    def follows(i: Column) -> Column:
        above, here = F.try_element_at(arr, i), F.try_element_at(arr, i + 1)
        return F.coalesce(
            (i > 0) & F.rlike(above, F.lit(item)) & F.rlike(here, F.lit(continuation)) & ~F.rlike(here, F.lit(item)),
            F.lit(False),
        )

    def merged(x: Column, i: Column) -> Column:
        below = F.try_element_at(arr, i + 2)
        with_range = F.regexp_replace(
            x, r"^(.*?)((?:\s+[€$£¥]?[0-9][0-9.,]*)+\s*)$", F.concat(F.lit("$1 ("), F.trim(below), F.lit(")$2"))
        )
        return F.when((i + 1 < n) & follows(i + 1), with_range).otherwise(x)

    marked = F.transform(arr, lambda x, i: F.when(~follows(i), merged(x, i)))
    return F.filter(marked, lambda x: x.isNotNull())


def allocate_missing(items: DataFrame, totals: DataFrame, gross: str = "total", key: str = "doc_id") -> DataFrame:
    """Give items without an amount equal shares of what the document total leaves over; price follows from it.

    Only documents with such items take part in the join: their sums are a small aggregate, not a window that would
    hold a whole document in one task.
    """
    known = items.groupBy(key).agg(
        F.sum("amount").try_cast(MONEY).alias("_known"), F.count_if(F.col("amount").isNull()).alias("_missing")
    )
    share = (
        known.filter("_missing > 0")
        .join(totals.select(key, F.col(gross).alias("_gross")), key)
        .select(
            key,
            F.try_divide(F.col("_gross") - F.coalesce("_known", F.lit(0).cast(MONEY)), F.col("_missing"))
            .try_cast(MONEY)
            .alias("_share"),
        )
    )
    amount = F.coalesce("amount", "_share")
    return (
        items.join(share, key, "left")
        .withColumn("unit_price", F.coalesce("unit_price", F.try_divide(amount, F.col("quantity")).try_cast(MONEY)))
        .withColumn("amount", amount)
        .drop("_share")
    )


def derive_item_values(items: DataFrame) -> DataFrame:
    """Fill quantity, price, amount, tax and net from each other."""
    q = F.coalesce("quantity", F.lit(1).cast(MONEY))
    price = F.coalesce("unit_price", F.try_divide(F.col("amount"), q).try_cast(MONEY))
    amount = F.coalesce("amount", (price * q).try_cast(MONEY))
    tax = F.coalesce("tax_amount", (amount * F.col("tax_rate") / 100).try_cast(MONEY))
    net = F.coalesce("net_amount", (amount - F.coalesce(tax, F.lit(0).cast(MONEY))).try_cast(MONEY))
    return items.withColumns({"_q": q, "_p": price, "_a": amount, "_t": tax, "_n": net}).select(
        *[
            F.col({"quantity": "_q", "unit_price": "_p", "amount": "_a", "tax_amount": "_t", "net_amount": "_n"}.get(c, c)).alias(c)
            for c in items.columns
        ]
    )


def items_rollup(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document: subtotal, tax, total and count; partially aggregated, so one huge document is no hot spot."""
    value = F.coalesce("amount", (F.col("unit_price") * F.col("quantity")).try_cast(MONEY))
    zero = F.lit(0).cast(MONEY)
    out = items.groupBy(key).agg(
        F.coalesce(F.sum(value).try_cast(MONEY), zero).alias("subtotal"),
        F.coalesce(F.sum("tax_amount").try_cast(MONEY), zero).alias("tax_amount"),
        F.count("*").alias("n_items"),
    )
    return out.withColumn("total", (F.col("subtotal") + F.col("tax_amount")).try_cast(MONEY))


def refund_totals(totals: DataFrame, items: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals with negative signs where every item of the document is a refund."""
    flag = is_refund(F.struct("unit_price", "net_amount", "amount", "description"))
    all_refunds = items.groupBy(key).agg(F.bool_and(flag).alias("_refund"))
    joined = totals.join(all_refunds, key, "left")
    money = [c for c in ("subtotal", "tax_amount", "total") if c in totals.columns]
    return joined.withColumns(
        {c: F.when(F.col("_refund"), -F.abs(F.col(c))).otherwise(F.col(c)) for c in money}
    ).drop("_refund")
