"""Registered queries over free text and web pages: normalisation, layout, language, document type, contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.functions import amounts, doctype, language, text as tx
from docledger.functions.regexes import explode_rows
from docledger.operators import classify as cl, fields
from docledger.plans.registry import query
from docledger.session import run_folder
from docledger.sources import files, markup


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def _n(c):
    return c.cast("bigint")


# ---- sources

_EXT = r"lower(regexp_extract(regexp_extract(url, '([^/\\]+)$', 1), '[^.]\.([A-Za-z0-9]+)$', 1))"


@query(
    "route_format",
    f"""SELECT page_id, CASE WHEN {_EXT} IN ('pdf') THEN 'pdf'
        WHEN {_EXT} IN ('jpg','jpeg','png','tiff','tif','bmp') THEN 'image' WHEN {_EXT} = 'json' THEN 'json'
        WHEN {_EXT} = 'xml' THEN 'xml' WHEN {_EXT} IN ('html','htm') THEN 'html' ELSE 'unknown' END AS format FROM pages""",
)
def route_format(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", files.route_format(F.col("url")).alias("format"))


@query(
    "ext_allowed",
    f"""SELECT page_id, ext IN ('html','pdf') AS is_allowed,
        CASE WHEN ext = '' THEN 'no extension' WHEN ext NOT IN ('html','pdf') THEN 'extension not allowed' ELSE '' END AS reason
        FROM (SELECT page_id, {_EXT} AS ext FROM pages)""",
)
def ext_allowed(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    out = files.ext_allowed(pages, [".html", ".PDF"], "url")
    return out.select("page_id", "is_allowed", F.coalesce("reason", F.lit("")).alias("reason"))


# Pages as files that came in over seven years, and the content of a file: one line.
_MONTH = "(1992 + page_id % 7) || '.' || lpad(CAST(1 + page_id % 12 AS VARCHAR), 2, '0')"


def _attachments(spark: SparkSession, d: str) -> str:
    base = f"{run_folder(spark)}/incoming"
    day = F.make_date(F.lit(1992) + F.pmod("page_id", F.lit(7)).cast("int"), F.lit(1) + F.pmod("page_id", F.lit(12)).cast("int"), F.lit(15))
    files.write_attachments(spark.read.parquet(f"{d}/pages.parquet").withColumn("day", day), base, "day", "html")
    return base


@query("scan_files", "SELECT 'txt' AS ext, count(*) AS n_files, CAST(sum(octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS n_bytes FROM pages")
def scan_files(spark, d):
    found = files.scan_files(spark, _attachments(spark, d), [".TXT"], recursive=True)
    return found.groupBy("ext").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query(
    "scan_months",
    f"""SELECT {_MONTH} AS month, count(*) AS n_files, CAST(sum(octet_length(encode(coalesce(html, ''))) + 1) AS BIGINT) AS n_bytes
        FROM pages WHERE {_MONTH} BETWEEN '1993.02' AND '1996.10' GROUP BY 1""",
)
def scan_months(spark, d):
    """The files of some months: a range of folders is the feature, and no other folder is listed."""
    found = files.scan_months(spark, _attachments(spark, d), (1993, 2), (1996, 10))
    return found.groupBy("month").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"))


@query("text_files", "SELECT md5(coalesce(html, '') || chr(10)) AS digest, count(*) AS n FROM pages GROUP BY 1")
def text_files(spark, d):
    docs = files.read_text_docs(spark, _attachments(spark, d))
    return docs.groupBy(F.md5("text").alias("digest")).agg(F.count("*").alias("n"))


@query(
    "file_probe",
    """SELECT page_id, CASE WHEN octet_length(encode(html)) < 10 THEN 'too small' WHEN html[1:5] <> '%PDF-' THEN 'no PDF header'
       ELSE '' END AS reason FROM pages""",
)
def file_probe(spark, d):
    pages = spark.read.parquet(f"{d}/pages.parquet")
    raw = pages.select("page_id", F.encode("html", "UTF-8").alias("content")).withColumn("length", F.octet_length("content"))
    return files.file_probe(raw).select("page_id", F.coalesce("reason", F.lit("")).alias("reason"))


@query(
    "html_text",
    r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id, trim(regexp_replace(
        replace(replace(replace(replace(replace(replace(
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?is)<(?:script)\b.*?</script\s*>', ' ', 'g'), '(?is)<(?:style)\b.*?</style\s*>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'),
          '<[^>]*>', ' ', 'g'),
        '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
        '\s+', ' ', 'g')) AS t FROM pages)""",
)
def html_text(spark, d):
    t = _pages(spark, d).select("page_id", markup.html_to_text(F.col("html")).alias("t"))
    return t.select("page_id", _n(F.length("t")).alias("n_chars"), F.md5("t").alias("digest"))


@query(
    "page_split",
    r"""SELECT doc_id, page - 1 AS page, md5(part) AS digest FROM (
        SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS page FROM (
          SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS parts FROM documents))""",
)
def page_split(spark, d):
    marked = _docs(spark, d).select("doc_id", F.replace("text", F.lit("\n"), F.lit("\n--- PAGE 1 ---\n")).alias("text"))
    return files.explode_pages(marked).select("doc_id", _n(F.col("page")).alias("page"), F.md5("text").alias("digest"))


# ---- normalisation


@query("normalize_text", r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS digest FROM documents")
def normalize_text(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.normalize_text(F.col("text"))).alias("digest"))


@query(
    "sanitize",
    r"SELECT doc_id, md5(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS digest FROM documents",
)
def sanitize(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(tx.sanitize_text(F.col("text"))).alias("digest"))


@query(
    "escape_markup",
    """SELECT doc_id, md5(replace(replace(replace(replace(
       replace(text, '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;'), '`', '&#96;')) AS digest FROM documents""",
)
def escape_markup(spark, d):
    e = _docs(spark, d).select("doc_id", tx.escape_markup(F.col("text")).alias("e"))
    return e.select("doc_id", F.md5("e.escaped").alias("digest"))


@query("escape_limit", "SELECT doc_id, length(text) > 10000 AS too_long FROM documents")
def escape_limit(spark, d):
    """The limit as an option: which texts it refuses."""
    e = _docs(spark, d).select("doc_id", tx.escape_markup(F.col("text"), tx.MAX_MARKUP).alias("e"))
    return e.select("doc_id", F.col("e.error").isNotNull().alias("too_long"))


@query(
    "clean_filename",
    r"""SELECT page_id, CASE WHEN s = '' THEN 'untitled' ELSE s END AS name FROM (SELECT page_id, regexp_replace(regexp_replace(
        regexp_replace(strip_accents(regexp_replace(url, '[<>:"/\\|?*]', '_', 'g')), '[^\x00-\x7F]', '', 'g'),
        '[_\s]+', '_', 'g'), '^[_. ]+|[_. ]+$', '', 'g') AS s FROM pages)""",
)
def clean_filename(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", tx.clean_filename(F.col("url")).alias("name"))


@query(
    "normalize_desc",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        'SKU-' || p_partkey || '  Item: ' || p_name || '  (' || p_type || ')   ' || 'X' || (1000 + p_size),
        '^[A-Z0-9-]+\s+', ''), '\s+', ' ', 'g'), '\s+[A-Z0-9-]{3,10}$', ''), '^Item:\s*|[^\p{L}\p{N}_]+$', '', 'g')) AS description
        FROM part""",
)
def normalize_desc(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    raw = F.concat(
        F.lit("SKU-"), F.col("p_partkey").cast("string"), F.lit("  Item: "), F.col("p_name"), F.lit("  ("), F.col("p_type"),
        F.lit(")   X"), (F.col("p_size") + 1000).cast("string"),
    )
    return part.select("p_partkey", tx.normalize_description(raw).alias("description"))


@query(
    "content_hash_dups",
    "SELECT sha256(text) AS digest, count(*) AS copies, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1",
)
def content_hash_dups(spark, d):
    hashed = _docs(spark, d).select("doc_id", tx.content_hash(F.col("text")).alias("digest"))
    return (
        hashed.groupBy("digest")
        .agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))
        .filter("copies > 1")
    )


# ---- layout

_LINES = "SELECT doc_id, string_split(text, chr(10)) AS l FROM documents"


@query(
    "lines",
    f"""SELECT doc_id, i - 1 AS line_no, md5(l[i]) AS digest
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({_LINES}))""",
)
def lines(spark, d):
    rows = explode_rows(_docs(spark, d).select("doc_id", tx.lines(F.col("text")).alias("l")), "l", "line_no", "line")
    return rows.select("doc_id", _n(F.col("line_no")).alias("line_no"), F.md5("line").alias("digest"))


@query(
    "regions",
    rf"""SELECT doc_id, md5(array_to_string(l[1:q], chr(10))) AS top, md5(array_to_string(l[q + 1:t], chr(10))) AS middle,
         md5(array_to_string(l[t + 1:], chr(10))) AS bottom,
         md5(array_to_string(list_filter(list_transform(f, lambda x: trim(left(x, length(x) // 2), E' \t\r\n')), lambda x: x <> ''), chr(10))) AS left_half,
         md5(array_to_string(list_filter(list_transform(f, lambda x: trim(x[length(x) // 2 + 1:], E' \t\r\n')), lambda x: x <> ''), chr(10))) AS right_half
         FROM (SELECT doc_id, l, len(l) // 4 AS q, len(l) * 3 // 4 AS t,
               list_filter(l, lambda x: NOT regexp_full_match(x, '\s*')) AS f FROM ({_LINES}))""",
)
def regions(spark, d):
    r = _docs(spark, d).select("doc_id", tx.lines(F.col("text")).alias("l")).select("doc_id", tx.layout_regions(F.col("l")).alias("r"))
    cols = {"top": "top", "middle": "middle", "bottom": "bottom", "left": "left_half", "right": "right_half"}
    return r.select("doc_id", *[F.md5(f"r.{k}").alias(v) for k, v in cols.items()])


@query(
    "struct_counts",
    rf"""SELECT doc_id, len(l) AS total_lines, len(list_filter(l, lambda x: regexp_full_match(x, '\s*'))) AS empty_lines
         FROM ({_LINES})""",
)
def struct_counts(spark, d):
    c = _docs(spark, d).select("doc_id", tx.structure_counts(tx.lines(F.col("text"))).alias("c"))
    return c.select("doc_id", _n(F.col("c.total_lines")).alias("total_lines"), _n(F.col("c.empty_lines")).alias("empty_lines"))


@query(
    "header_lines",
    rf"""SELECT doc_id, i - 1 AS line_no, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, least(len(l), 10) + 1)) AS i FROM ({_LINES}))
         WHERE NOT regexp_full_match(l[i], '\s*') AND length(l[i]) < 50""",
)
def header_lines(spark, d):
    h = _docs(spark, d).select("doc_id", tx.header_lines(tx.lines(F.col("text"))).alias("h"))
    rows = explode_rows(h, "h", "_i", "r")
    return rows.select("doc_id", _n(F.col("r.line_no")).alias("line_no"), F.col("r.line").alias("line"))


_TABLE_LINE = r"  |\t|\|[^\n]*\||:[^\n]*:|,[^\n]*,[^\n]*,"


@query(
    "table_runs",
    rf"""WITH x AS (SELECT doc_id, i - 1 AS n, regexp_matches(l[i], '{_TABLE_LINE}') AS f
           FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM ({_LINES}))),
         g AS (SELECT doc_id, n, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM x WHERE f)
         SELECT doc_id, min(n) AS first_line, max(n) AS last_line, count(*) AS n_lines FROM g GROUP BY doc_id, island HAVING count(*) >= 3""",
)
def table_runs(spark, d):
    t = _docs(spark, d).select("doc_id", tx.lines(F.col("text")).alias("l")).select("doc_id", tx.table_runs(F.col("l")).alias("t"))
    rows = explode_rows(t, "t", "_i", "r")
    return rows.select(
        "doc_id", _n(F.col("r.start")).alias("first_line"), _n(F.col("r.end")).alias("last_line"),
        _n(F.size("r.lines")).alias("n_lines"),
    )


@query(
    "total_lines",
    rf"""SELECT doc_id, i - 1 AS line_no FROM (SELECT doc_id, l, unnest(range(greatest(len(l) - 14, 1), len(l) + 1)) AS i FROM ({_LINES}))
         WHERE regexp_matches(lower(l[i]), 'total|sum|amount|subtotal|tax|vat|net|gross|razem|suma|kwota')""",
)
def total_lines(spark, d):
    t = _docs(spark, d).select("doc_id", tx.total_lines(tx.lines(F.col("text"))).alias("t"))
    return explode_rows(t, "t", "_i", "r").select("doc_id", _n(F.col("r.line_no")).alias("line_no"))


_HEAD = r"\b(?:item|description|qty|quantity|price|amount|total)\b"
_HAS_TABLE = rf"(?i){_HEAD}[^\n]*\n[^\n]*{_HEAD}|---[^\n]*---|\|[^\n]*\|"


@query("has_table", f"SELECT doc_id, regexp_matches(text, '{_HAS_TABLE}') AS has_table FROM documents")
def has_table(spark, d):
    return _docs(spark, d).select("doc_id", tx.has_table(F.col("text")).alias("has_table"))


# ---- language


def _score_sql(words: list[str]) -> str:
    parts = [f"(length(t) - length(replace(t, '{w}', ''))) // {len(w)}" for w in words]
    return f"({' + '.join(parts)}) / {len(words)}.0"


_SCORES = " UNION ALL ".join(
    f"SELECT doc_id, '{lang}' AS lang, {i} AS ord, {_score_sql(ws)} AS score FROM low" for i, (lang, ws) in enumerate(language.MARKERS.items())
)
_LOW = "WITH low AS (SELECT doc_id, lower(text) AS t, text, lang AS label FROM documents)"


@query("lang_scores", f"{_LOW} SELECT doc_id, lang, CAST(score AS DOUBLE) AS score FROM ({_SCORES})")
def lang_scores(spark, d):
    low = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    s = explode_rows(low.select("doc_id", language.language_scores(F.col("t")).alias("s")), "s", "_i", "r")
    return s.select("doc_id", "r.lang", "r.score")


@query(
    "lang_top",
    f"{_LOW} SELECT doc_id, arg_max(lang, score * 1000 - ord) AS lang FROM ({_SCORES}) GROUP BY doc_id",
)
def lang_top(spark, d):
    low = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    s = low.select("doc_id", language.language_scores(F.col("t")).alias("s"))
    return s.select("doc_id", language.language_top(F.col("s")).alias("lang"))


_IND = " UNION ALL ".join(
    "SELECT doc_id, '{}' AS lang, {} AS ord, {} AS n FROM low".format(
        lang, i, " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in ws)
    )
    for i, (lang, ws) in enumerate(language.INDICATORS.items())
)


@query("lang_indicators", f"{_LOW} SELECT doc_id, arg_max(lang, n * 1000 - ord) AS lang, CAST(max(n) AS DOUBLE) AS n FROM ({_IND}) GROUP BY doc_id")
def lang_indicators(spark, d):
    low = _docs(spark, d).select("doc_id", F.lower("text").alias("t"))
    s = low.select("doc_id", language.language_indicators(F.col("t")).alias("s"))
    return s.select("doc_id", language.language_top(F.col("s")).alias("lang"), F.array_max(F.transform("s", lambda x: x["score"])).alias("n"))


_DIACRITICS = "CASE " + " ".join(f"WHEN regexp_matches(text, '[{ls}]') THEN '{lang}'" for lang, ls in language.LETTERS) + " ELSE 'en' END"


@query("lang_by_diacritics", f"SELECT doc_id, {_DIACRITICS} AS lang FROM documents")
def lang_by_diacritics(spark, d):
    return _docs(spark, d).select("doc_id", language.language_by_diacritics(F.col("text")).alias("lang"))


@query("lang_confusion", f"SELECT lang AS label, {_DIACRITICS} AS guess, count(*) AS n FROM documents GROUP BY ALL")
def lang_confusion(spark, d):
    g = _docs(spark, d).select(F.col("lang").alias("label"), language.language_by_diacritics(F.col("text")).alias("guess"))
    return g.groupBy("label", "guess").agg(F.count("*").alias("n"))


def _any(words: list[str], col: str = "t") -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def _present(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words)


@query("lang_by_keyword", f"{_LOW} SELECT doc_id, CASE WHEN {_any(language.POLISH_WORDS)} THEN 'pl' ELSE 'en' END AS lang FROM low")
def lang_by_keyword(spark, d):
    return _docs(spark, d).select("doc_id", language.language_by_keyword(F.lower("text")).alias("lang"))


# ---- document type


@query(
    "detect_features",
    f"""{_LOW} SELECT doc_id, {_any(doctype.INVOICE_FLAG_WORDS)} AS invoice_words, {_any(doctype.RECEIPT_FLAG_WORDS)} AS receipt_words,
        {_any(doctype.VAT_FLAG_WORDS)} AS vat_words FROM low""",
)
def detect_features(spark, d):
    f = _docs(spark, d).select("doc_id", F.lower("text").alias("t")).select("doc_id", doctype.detection_features(F.col("t")).alias("f"))
    return f.select(
        "doc_id", F.col("f.has_invoice_keywords").alias("invoice_words"), F.col("f.has_receipt_keywords").alias("receipt_words"),
        F.col("f.has_vat_references").alias("vat_words"),
    )


_FLAGS = f"""{_LOW}, flags AS (SELECT doc_id, {_any(doctype.INVOICE_WORDS)} AS inv, {_any(doctype.RECEIPT_WORDS)} AS rec,
    {_any(doctype.ORDER_WORDS)} AS ord, {_any(doctype.VAT_WORDS)} AS vat, regexp_matches(text, '{_HAS_TABLE}') AS tab,
    regexp_matches(text, '\\b[A-Z]{{2}}[0-9]{{9,12}}\\b|\\b[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}\\b|\\b[0-9]{{2}}-[0-9]{{7}}\\b|\\bTAX ID:?\\s*[A-Z0-9-]+') AS tid,
    regexp_matches(t, 'payment\\s+terms|due\\s+in\\s+[0-9]+\\s+days|net\\s+[0-9]+|due\\s+date|termin\\s+płatności') AS pay,
    regexp_matches(t, '\\b(?:qty|quantity|ilość)\\b[^\\n]*\\b(?:price|cena)\\b[^\\n]*\\b(?:amount|kwota)\\b|\\b[0-9]+\\s*x\\s*[0-9.,]+\\s*=\\s*[0-9.,]+|\\b(?:item|description|opis)\\b[^\\n]*\\b(?:unit|price|cena)\\b') AS itm
    FROM low),
    scores AS (SELECT *, 2 * inv::INT + vat::INT + tid::INT + 2 * pay::INT + itm::INT + tab::INT AS si,
      2 * rec::INT + (1 - pay::INT) + (1 - tid::INT) + tab::INT AS sr, 2 * ord::INT + itm::INT + tab::INT AS so FROM flags),
    typed AS (SELECT *, CASE WHEN si > sr AND si > so THEN 'invoice' WHEN sr > si AND sr > so THEN 'receipt'
      WHEN so > si AND so > sr THEN 'order' ELSE 'invoice' END AS doc_type,
      CASE WHEN si > sr AND si > so THEN least(0.5 + si / 10.0, 0.95) WHEN sr > si AND sr > so THEN least(0.5 + sr / 8.0, 0.95)
      WHEN so > si AND so > sr THEN least(0.5 + so / 8.0, 0.95) ELSE 0.5 END AS conf FROM scores)"""


@query("classifier_flags", f"{_FLAGS} SELECT doc_id, inv, rec, ord, vat, tab, tid, pay, itm FROM flags")
def classifier_flags(spark, d):
    c = cl.classify(_docs(spark, d).select("doc_id", "text"))
    names = {
        "inv": "has_invoice_keywords", "rec": "has_receipt_keywords", "ord": "has_order_keywords", "vat": "has_vat_references",
        "tab": "has_table_structure", "tid": "has_tax_id", "pay": "has_payment_terms", "itm": "has_line_items",
    }
    return c.select("doc_id", *[F.col(f"features.{v}").alias(k) for k, v in names.items()])


@query("classify_additive", f"{_FLAGS} SELECT doc_id, doc_type, round(CAST(conf AS DOUBLE), 6) AS confidence FROM typed")
def classify_additive(spark, d):
    c = cl.classify(_docs(spark, d).select("doc_id", "text"))
    return c.select("doc_id", "doc_type", F.round("type_confidence", 6).alias("confidence"))


@query(
    "route_tree",
    f"{_FLAGS} SELECT doc_type, CASE doc_type WHEN 'receipt' THEN 'receipt_mode' WHEN 'order' THEN 'order_mode' ELSE '' END AS mode, count(*) AS n FROM typed GROUP BY ALL",
)
def route_tree(spark, d):
    c = cl.classify(_docs(spark, d).select("doc_id", "text")).withColumn("has_tables", F.col("features.has_table_structure"))
    routed = cl.route_tree(c)
    mode = F.coalesce(F.get(F.map_keys("params"), F.lit(0)), F.lit(""))
    return routed.groupBy("doc_type", mode.alias("mode")).agg(F.count("*").alias("n"))


@query(
    "classify_vote",
    f"""{_LOW} SELECT doc_id, CASE WHEN {_present(doctype.RECEIPT_VOTES)} > {_present(doctype.INVOICE_VOTES)} THEN 'receipt'
        ELSE 'invoice' END AS doc_type FROM low""",
)
def classify_vote(spark, d):
    return _docs(spark, d).select("doc_id", F.lower("text").alias("t")).select("doc_id", doctype.classify_vote(F.col("t")).alias("doc_type"))


@query(
    "decision_tree",
    f"""{_LOW} SELECT doc_id, CASE WHEN {_any(doctype.VENDOR_LEGAL_NAMES, 'text')} THEN 'adobe' WHEN {_any(doctype.TREE_RECEIPT_WORDS)}
        OR (regexp_matches(t, '{doctype.TREE_ITEM_SECTIONS}') AND NOT regexp_matches(t, '{doctype.TREE_PAYMENT_TERMS}'))
        THEN 'receipt' ELSE 'standard_invoice' END AS doc_type FROM low""",
)
def decision_tree(spark, d):
    t = _docs(spark, d).select("doc_id", "text", F.lower("text").alias("low"))
    return t.select("doc_id", doctype.decision_tree(F.col("text"), F.col("low"))["doc_type"].alias("doc_type"))


@query(
    "vendor_score",
    "SELECT doc_id, "
    + " + ".join(f"CAST(regexp_matches(text, '(?i){p}') AS INT)" for p in doctype.VENDOR_FORMAT_PATTERNS)
    + """ AS score, CASE WHEN regexp_matches(text, '(?i)VAT\\s+no\\.?:') AND regexp_matches(text, '(?i)IBAN:')
        AND regexp_matches(text, '(?i)SWIFT:') THEN 'european' ELSE 'default' END AS route FROM documents""",
)
def vendor_score(spark, d):
    return _docs(spark, d).select(
        "doc_id", doctype.vendor_score(F.col("text")).alias("score"), doctype.layout_route(F.col("text")).alias("route")
    )


# ---- contacts and numbers


def _find_all(name: str, pattern: str, finder) -> None:
    @query(
        name,
        f"SELECT doc_id, unnest(regexp_extract_all(text, '{pattern}')) AS value FROM documents",
    )
    def found(spark, d):
        hits = _docs(spark, d).select("doc_id", finder(F.col("text")).alias("v"))
        return explode_rows(hits, "v", "_i", "value").select("doc_id", "value")


_find_all("emails", fields.EMAIL_ALL, fields.find_all_emails)
_find_all("phones", fields.PHONE_ALL, fields.find_all_phones)
_find_all("tax_ids", fields.TAX_ID_ALL, fields.find_all_tax_ids)
_find_all("dates", fields.DATE_ALL, fields.find_all_dates)


@query(
    "numbers",
    """SELECT doc_id, CAST(replace(n, ',', '.') AS DOUBLE) AS value
       FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[-+]?[0-9]+(?:[.,][0-9]+)?')) AS n FROM documents)""",
)
def numbers(spark, d):
    found = _docs(spark, d).select("doc_id", amounts.all_numbers(F.col("text")).alias("v"))
    return explode_rows(found, "v", "_i", "value").select("doc_id", "value")
