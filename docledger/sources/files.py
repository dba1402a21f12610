"""Files in, records in, records out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger import schemas
from docledger.functions.regexes import explode_rows

# Formats by extension.
FORMATS = {
    "pdf": ["pdf"],
    "image": ["jpg", "jpeg", "png", "tiff", "tif", "bmp"],
    "json": ["json"],
    "xml": ["xml"],
    "html": ["html", "htm"],
}
MIN_PDF_BYTES = 10
# A local file system keeps a checksum file beside each file, and makes both by a process each: twice the work for small files. Other
# file systems do not read these options.
NO_CHECKSUM_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
PAGE_MARKER = r"\n?--- PAGE [0-9]+ ---\n?"


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path segment, NULL if it has none."""
    name = F.regexp_extract(path, r"([^/\\]+)$", 1)
    return F.nullif(F.lower(F.regexp_extract(name, r"[^.]\.([A-Za-z0-9]+)$", 1)), F.lit(""))


def scan_files(spark: SparkSession, path: str, exts: Sequence[str] = (), recursive: bool = False) -> DataFrame:
    """One row per file. Content is read only by queries that use it."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    )
    out = files.withColumn("ext", extension(F.col("path")))
    wanted = [e.lower().lstrip(".") for e in exts]
    return out.filter(F.col("ext").isin(wanted)) if wanted else out


def scan_month(spark: SparkSession, base: str, year: int, month: int, by: str = "path") -> DataFrame:
    """Files of one month: the folder ``YYYY.MM/attachments``, or any file last modified in that month."""
    if by == "path":
        return scan_files(spark, f"{base}/{year:04d}.{month:02d}/attachments", recursive=True)
    start = F.make_date(F.lit(year), F.lit(month), F.lit(1))
    modified = F.col("modificationTime")
    files = scan_files(spark, base, recursive=True)
    return files.filter((modified >= start) & (modified < F.add_months(start, 1)))


def scan_months(spark: SparkSession, base: str, first: tuple[int, int], last: tuple[int, int]) -> DataFrame:
    """Files of the months from ``first`` to ``last``, both (year, month) and included, with their ``month``.

    Only the folders of those months are listed, by one listing; months without a folder have no files.
    """
    start, end = (y * 12 + m - 1 for y, m in (first, last))
    names = [f"{n // 12:04d}.{n % 12 + 1:02d}" for n in range(start, end + 1)]
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    there = {s.getPath().getName() for s in system.listStatus(root)}
    paths = [f"{base}/{name}/attachments" for name in names if name in there]
    # Without any folder the scan of the base keeps no file, which leaves its columns.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths or [base])
    month = F.regexp_extract("path", r"/([0-9]{4}\.[0-9]{2})/attachments/", 1)
    out = files.withColumn("ext", extension(F.col("path"))).withColumn("month", month)
    return out if paths else out.filter(F.lit(False))


def write_attachments(docs: DataFrame, base: str, day: str, text: str = "text") -> None:
    """Each text as a file of its own under ``YYYY.MM/attachments``; a row without a day goes to ``0000.00``.

    Tasks write to a folder beside, and whole months are renamed when all have finished, so a lost task leaves no file. Each task
    has a folder of its own within a month: the job then commits by renaming folders, where tasks that share one have their files
    renamed one after another by the driver.
    """
    spark = docs.sparkSession
    month = F.coalesce(F.date_format(day, "yyyy.MM"), F.lit("0000.00"))
    landing = f"{base}/_landing"
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("value"), month.alias("month"), F.spark_partition_id().alias("task"))
    rows.write.options(maxRecordsPerFile=1, **NO_CHECKSUM_FILES).partitionBy("month", "task").text(landing)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(landing).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for folder in system.listStatus(path(landing)):
        name = folder.getPath().getName()
        if name.startswith("month="):
            target = path(f"{base}/{name.removeprefix('month=')}")
            system.mkdirs(target)
            if not system.rename(folder.getPath(), path(target, "attachments")):
                raise OSError(f"{name} could not be moved to {target}")
    system.delete(path(landing), True)


def file_probe(files: DataFrame) -> DataFrame:
    """Validity of PDF files by size and signature, with a reason."""
    head = F.decode(F.substring("content", 1, 5), "ISO-8859-1")
    reason = F.when(F.col("length") < MIN_PDF_BYTES, "too small").when(head != "%PDF-", "no PDF header")
    return files.withColumn("reason", reason).withColumn("is_valid", F.col("reason").isNull())


def ext_allowed(df: DataFrame, allowed: Sequence[str], path: str = "path") -> DataFrame:
    """Whether the extension is on the list, with a reason when it is not."""
    wanted = [a.lower().lstrip(".") for a in allowed]
    ext = extension(F.col(path))
    reason = (
        F.when(F.coalesce(F.col(path), F.lit("")) == "", "no file name")
        .when(ext.isNull(), "no extension")
        .when(~ext.isin(wanted), "extension not allowed")
    )
    return df.withColumn("reason", reason).withColumn("is_allowed", F.col("reason").isNull())


def route_format(path: Column) -> Column:
    """pdf / image / json / xml / html / unknown by extension."""
    ext = extension(path)
    out = None
    for fmt, exts in FORMATS.items():
        out = F.when(ext.isin(exts), fmt) if out is None else out.when(ext.isin(exts), fmt)
    return out.otherwise("unknown")


def read_text_docs(spark: SparkSession, path: str) -> DataFrame:
    """Text files as documents, one per file."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    name = F.col("_metadata.file_path")
    return raw.select(
        F.xxhash64(name).alias("doc_id"),
        F.lit(0).alias("page"),
        F.col("value").alias("text"),
        name.alias("source"),
        F.create_map(F.lit("filename"), F.col("_metadata.file_name")).alias("metadata"),
    )


def explode_pages(docs: DataFrame, max_pages: int | None = None, marker: str = PAGE_MARKER) -> DataFrame:
    """One row per marked page; all pages unless ``max_pages`` asks for the first few."""
    parts = F.filter(F.split("text", marker), lambda p: F.trim(p) != "")
    pages = parts if max_pages is None else F.slice(parts, 1, max_pages)
    rest = [c for c in docs.columns if c not in ("text", "page")]
    staged = docs.select(*rest, pages.alias("_pages"))
    return explode_rows(staged, "_pages", "page", "text")


def join_pages(text: Column, max_pages: int | None = None, marker: str = PAGE_MARKER) -> Column:
    """The pages of one text without their markers, joined with newlines."""
    parts = F.filter(F.split(text, marker), lambda p: F.trim(p) != "")
    return F.array_join(parts if max_pages is None else F.slice(parts, 1, max_pages), "\n")


def page_confidence(pages: DataFrame) -> DataFrame:
    """Mean confidence and page count per document."""
    return pages.groupBy("doc_id").agg(F.avg("confidence").alias("confidence"), F.count("*").alias("n_pages"))


def read_invoice_json(spark: SparkSession, path: str, schema: str = schemas.INVOICE_JSON, multiline: bool = False) -> DataFrame:
    """JSON records; a malformed one is a row with ``_corrupt`` set and everything else NULL."""
    return (
        spark.read.schema(schema + ", _corrupt STRING")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("multiLine", str(multiline).lower())
        .json(path)
    )


def with_error(records: DataFrame) -> DataFrame:
    """Records read permissively with an ``error`` instead of ``_corrupt``; of a malformed one only its number may be known."""
    # The sources parse only columns that are asked for. The second condition never holds, but it asks for all of them, so that
    # a record is malformed or not whatever the query.
    bad = F.col("_corrupt").isNotNull() | (F.pmod(F.hash(*[c for c in records.columns if c != "_corrupt"]), F.lit(1)) != 0)
    known = F.regexp_extract("_corrupt", r'^\{?(?:"doc_id":)?([0-9]{1,18})\b', 1).try_cast("bigint")
    fields = [F.when(~bad, F.col(c)).alias(c) for c in records.columns if c not in ("doc_id", "_corrupt")]
    return records.select(F.when(bad, known).otherwise(F.col("doc_id")).alias("doc_id"), *fields, F.when(bad, "malformed record").alias("error"))


def parse_invoice_json(col: Column, schema: str = schemas.INVOICE_JSON) -> Column:
    """Record struct of a JSON text with ``_corrupt`` for malformed input."""
    return F.from_json(col, schema + ", _corrupt STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})


def invoice_json(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One JSON text per record: ISO dates, decimals as numbers."""
    cols = list(columns or [c for c in df.columns if c != "doc_id"])
    return df.select("doc_id", F.to_json(F.struct("doc_id", *cols), {"dateFormat": "yyyy-MM-dd"}).alias("json"))


def write_invoice_json(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """JSON lines through the output committer; a failed task leaves no half-written record."""
    writer = df.write.mode("overwrite").option("dateFormat", "yyyy-MM-dd")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)


def write_flat_csv(invoices: DataFrame, items: DataFrame, path: str) -> None:
    """Header and item tables as two CSV folders."""
    flat = invoices.select(
        "doc_id", "document_number", "issue_date", "due_date", "currency",
        F.col("seller.name").alias("seller_name"), F.col("buyer.name").alias("buyer_name"),
        "totals.subtotal", "totals.tax_amount", "totals.total",
    )
    flat.write.mode("overwrite").option("header", "true").csv(f"{path}/invoices")
    items.write.mode("overwrite").option("header", "true").csv(f"{path}/items")


FLAT_INVOICES = (
    "doc_id BIGINT, document_number STRING, issue_date DATE, due_date DATE, currency STRING, seller_name STRING, buyer_name STRING, "
    "subtotal DECIMAL(18,4), tax_amount DECIMAL(18,4), total DECIMAL(18,4)"
)


def read_flat_csv(spark: SparkSession, path: str, schema: str = FLAT_INVOICES, header: bool = True) -> DataFrame:
    """Rows of a CSV folder as :func:`write_flat_csv` leaves it; a malformed one is a row with ``_corrupt`` set."""
    reader = spark.read.schema(schema + ", _corrupt STRING").option("header", str(header).lower()).option("mode", "PERMISSIVE")
    return reader.option("columnNameOfCorruptRecord", "_corrupt").option("columnPruning", "false").csv(path)
