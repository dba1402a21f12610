"""Batch, job and request analytics. Periods end at ``as_of``; the bounds reach the scan as plain comparisons."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docledger.operators import quantiles

# Periods and bands of the reports.
SUMMARY_DAYS, OCR_DAYS, API_HOURS, JOB_DAYS, CALL_DAYS = 30, 7, 24, 30, 7
BANDS = [(0.1, "excellent"), (0.5, "good"), (2.0, "fair")]
FINISHED = ["completed", "failed"]


def _since(as_of: dt.datetime, **delta: float) -> Column:
    return F.lit(as_of - dt.timedelta(**delta))


def batch_summary(results: DataFrame) -> DataFrame:
    """Total, successful and failed documents. The failures themselves are rows: see :func:`batch_failures`."""
    return results.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )


def batch_failures(results: DataFrame, key: str = "doc_id") -> DataFrame:
    """What failed, and why."""
    return results.filter(F.col("error").isNotNull()).select(key, "error")


def pending_docs(docs: DataFrame, done: DataFrame, key: str = "doc_id", overwrite: bool = False) -> DataFrame:
    """Documents without a result yet."""
    return docs if overwrite else docs.join(done.select(key), key, "left_anti")


def job_list(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs, newest first, with their type and number of files: a job that states neither is a single file."""
    kind = F.coalesce("job_type", F.lit("single")) if "job_type" in jobs.columns else F.lit("single")
    n_files = F.coalesce("n_files", F.lit(1)) if "n_files" in jobs.columns else F.lit(1)
    out = jobs.select("job_id", "status", kind.alias("type"), n_files.alias("n_files"), "input_format", "output_format", "created_at", "completed_at")
    ordered = out.orderBy(F.desc("created_at"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def job_counts(jobs: DataFrame) -> DataFrame:
    return jobs.agg(
        F.count("*").alias("total"), F.count_if(F.col("status").isin("pending", "processing")).alias("active")
    )


def job_progress(jobs: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Completed share of every batch in percent."""
    done = F.count_if(F.col("status").isin(FINISHED))
    return jobs.groupBy(batch).agg(
        F.count("*").alias("total"),
        done.alias("completed"),
        F.try_divide(done * 100.0, F.count("*")).alias("progress"),
    )


def job_metrics(jobs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Metric rows with the status of their job."""
    return metrics.join(jobs.select("job_id", "status"), "job_id")


def _processing_seconds() -> Column:
    return (F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1_000_000


def conversion_summary(jobs: DataFrame, as_of: dt.datetime, days: int = SUMMARY_DAYS) -> DataFrame:
    """By day, input, output and status: jobs, mean seconds (NULL where none has run), mean size."""
    recent = jobs.filter(F.col("created_at") >= _since(as_of, days=days))
    return recent.groupBy(
        F.date_trunc("day", "created_at").alias("day"), "input_format", "output_format", "status"
    ).agg(
        F.count("*").alias("job_count"),
        F.avg(_processing_seconds()).alias("avg_seconds"),
        F.avg("file_size").alias("avg_file_size"),
    )


def conversion_rollup(jobs: DataFrame, as_of: dt.datetime, days: int = SUMMARY_DAYS) -> DataFrame:
    """The same counts with subtotals per day and overall."""
    recent = jobs.filter(F.col("created_at") >= _since(as_of, days=days))
    return recent.rollup(F.date_trunc("day", "created_at").alias("day"), "status").agg(
        F.count("*").alias("job_count"), F.grouping_id().alias("level")
    )


def ocr_performance(results: DataFrame, as_of: dt.datetime, days: int = OCR_DAYS) -> DataFrame:
    recent = results.filter(F.col("created_at") >= _since(as_of, days=days))
    return recent.groupBy(F.date_trunc("hour", "created_at").alias("hour"), "engine", "language").agg(
        F.count("*").alias("ocr_count"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time").alias("avg_seconds"),
    )


def api_performance(calls: DataFrame, as_of: dt.datetime, hours: int = API_HOURS) -> DataFrame:
    recent = calls.filter(F.col("ts") >= _since(as_of, hours=hours))
    return recent.groupBy(F.date_trunc("hour", "ts").alias("hour"), "endpoint").agg(
        F.count("*").alias("request_count"),
        F.avg("response_time").alias("avg_response_time"),
        F.count_if(F.col("status_code") >= 400).alias("error_count"),
        F.count_if(F.col("status_code") < 400).alias("success_count"),
    )


def expired_jobs(jobs: DataFrame, as_of: dt.datetime, days: int = JOB_DAYS) -> Column:
    return (F.col("created_at") < _since(as_of, days=days)) & F.col("status").isin(FINISHED)


def retention(jobs: DataFrame, calls: DataFrame, as_of: dt.datetime, job_days: int = JOB_DAYS, call_days: int = CALL_DAYS) -> DataFrame:
    """Kept and dropped row counts of the retention rules, by table."""
    gone_jobs = expired_jobs(jobs, as_of, job_days)
    gone_calls = F.col("ts") < _since(as_of, days=call_days)

    def counts(df: DataFrame, name: str, gone: Column) -> DataFrame:
        return df.agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept")).select(
            F.lit(name).alias("table_name"), "deleted", "kept"
        )

    return counts(jobs, "jobs", gone_jobs).unionByName(counts(calls, "api_calls", gone_calls))


def retained(jobs: DataFrame, as_of: dt.datetime, days: int = JOB_DAYS) -> DataFrame:
    """The jobs that the retention rule keeps: those that are young, or not finished."""
    return jobs.filter(~F.coalesce(expired_jobs(jobs, as_of, days), F.lit(False)))


def apply_retention(jobs: DataFrame, path: str, as_of: dt.datetime, days: int = JOB_DAYS) -> None:
    """Rewrite only the day partitions that hold expired rows, and delete those of which nothing is kept.

    Days are the partitions of ``path``; only the days with an expired row are read again, and their number is that of the
    days on disk. Untouched days stay as they are.
    """
    spark = jobs.sparkSession
    bound = (as_of - dt.timedelta(days=days)).date()
    old_days = jobs.withColumn("day", F.to_date("created_at")).filter(F.col("day") <= F.lit(bound))
    gone = F.coalesce(expired_jobs(jobs, as_of, days), F.lit(False))
    touched = old_days.groupBy("day").agg(F.count_if(gone).alias("gone"), F.count_if(~gone).alias("kept")).filter("gone > 0").collect()
    partly = [r["day"] for r in touched if r["kept"]]
    if partly:
        kept = old_days.filter(F.col("day").isin(partly) & ~gone)
        old = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            kept.write.mode("overwrite").partitionBy("day").parquet(path)
        finally:
            spark.conf.set("spark.sql.sources.partitionOverwriteMode", old)
    # A day without kept rows writes nothing, so overwriting would leave it.
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for r in touched:
        if not r["kept"]:
            files.delete(jvm.org.apache.hadoop.fs.Path(folder, f"day={r['day'].isoformat()}"), True)


def rating(seconds: Column) -> Column:
    out = None
    for limit, name in BANDS:
        out = F.when(seconds < limit, name) if out is None else out.when(seconds < limit, name)
    return out.otherwise("slow")


def latency_stats(calls: DataFrame, by: str = "endpoint") -> DataFrame:
    """Mean, least, largest and number of response times, with a rating band."""
    stats = calls.groupBy(by).agg(
        F.avg("response_time").alias("avg_seconds"),
        F.min("response_time").alias("min_seconds"),
        F.max("response_time").alias("max_seconds"),
        F.count("*").alias("n"),
    )
    return stats.withColumn("rating", rating(F.col("avg_seconds")))


def latency_quantile(calls: DataFrame, by: Sequence[str], value: str = "response_time", q: float = 0.95, exact: bool = False) -> DataFrame:
    """Quantile per group and the number of rows: estimated from hourly sketches, or exact with linear interpolation."""
    if exact:
        return quantiles.exact(calls, by, value, q)
    return quantiles.estimated(quantiles.merged(hourly_sketches(calls, by, value), by), by, q)


def hourly_sketches(calls: DataFrame, by: Sequence[str], value: str = "response_time") -> DataFrame:
    """(hour, ``by``, bucket, n): sketches to be kept as a table; those of any hours merge into the sketch of their calls."""
    return quantiles.sketch(calls.withColumn("hour", F.date_trunc("hour", "ts")), ["hour", *by], value)


def rate_series(calls: DataFrame, by: Sequence[str] = ("endpoint",), minutes: int = 5) -> DataFrame:
    """Requests per second and share of failed requests per series and window."""
    win = F.window("ts", f"{minutes} minutes")
    return (
        calls.groupBy(win.alias("w"), *by)
        .agg(F.count("*").alias("requests"), F.count_if(F.col("status_code") >= 500).alias("errors"))
        .select(
            F.col("w.start").alias("window_start"),
            *by,
            "requests",
            "errors",
            (F.col("requests") / (minutes * 60)).alias("per_second"),
            (F.col("errors") / F.col("requests")).alias("error_ratio"),
        )
    )


# Leaves of a record counted by the coverage report.
LEAVES = [
    "document_number", "issue_date", "due_date", "currency", "seller.name", "seller.tax_id", "seller.email",
    "buyer.name", "buyer.tax_id", "totals.subtotal", "totals.tax_amount", "totals.total", "payment.method",
    "payment.terms", "payment.bank_account",
]


def extraction_coverage(invoices: DataFrame, leaves: Sequence[str] = tuple(LEAVES)) -> DataFrame:
    """Per document the number of fields with a value."""
    n = sum((F.col(leaf).isNotNull().cast("int") for leaf in leaves), F.lit(0))
    return invoices.select("doc_id", n.alias("n_fields"))


def fill_rates(invoices: DataFrame, by: str = "doc_type", leaves: Sequence[str] = tuple(LEAVES)) -> DataFrame:
    """Fill rate of every field by document type: one aggregation, then a stack of its few rows."""
    wide = invoices.groupBy(by).agg(
        F.count("*").alias("_n"), *[F.count(F.col(leaf)).alias(f"_c{i}") for i, leaf in enumerate(leaves)]
    )
    pairs = F.array(*[F.struct(F.lit(leaf).alias("field"), F.col(f"_c{i}").alias("filled")) for i, leaf in enumerate(leaves)])
    return wide.select(by, "_n", F.explode(pairs).alias("p")).select(
        by, "p.field", F.col("_n").alias("n_docs"), "p.filled", (F.col("p.filled") / F.col("_n")).alias("fill_rate")
    )


def register_views(jobs: DataFrame, ocr: DataFrame, calls: DataFrame, as_of: dt.datetime) -> None:
    """The three reports as temporary SQL views."""
    conversion_summary(jobs, as_of).createOrReplaceTempView("conversion_summary")
    ocr_performance(ocr, as_of).createOrReplaceTempView("ocr_performance")
    api_performance(calls, as_of).createOrReplaceTempView("api_performance")


# ---- alert conditions in batch


def error_rate(calls: DataFrame, by: Sequence[str] = ("source",), threshold: float = 0.10) -> DataFrame:
    """Share of server errors over sliding five-minute windows, and whether it is above the threshold."""
    return (
        calls.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), *by)
        .agg(F.count("*").alias("n"), F.count_if(F.col("status_code") >= 500).alias("errors"))
        .select(
            F.col("w.end").alias("window_end"), *by, "n", "errors",
            (F.col("errors") > F.col("n") * threshold).alias("breach"),
        )
    )


def _stitched(pieces: DataFrame, by: str, joins: Column) -> DataFrame:
    """Pieces of intervals (``by``, first, last, n, bucket), at most a few for each bucket of time, joined where ``joins`` holds.

    ``joins`` compares ``first`` with ``_before``, the end of the piece before it.
    """
    w = Window.partitionBy(by).orderBy("first")
    marked = pieces.withColumn("_before", F.lag("last").over(w))
    numbered = marked.withColumn("_run", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "_run").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n")).drop("_run")


def heartbeat_gaps(events: DataFrame, by: str = "source", ts: str = "ts", gap: str = "1 minute") -> DataFrame:
    """Activity of a source between silences of ``gap`` or longer.

    Events are first counted by (source, instant), which combines before the shuffle; sessions are then found inside each
    (source, hour), so that a source which sends a third of all events is spread over its hours; what is left of each hour
    are its sessions, and those that continue over the border of an hour are joined.
    """
    instants = events.groupBy(F.col(by), F.col(ts).alias("_ts")).agg(F.count("*").alias("n"))
    hourly = instants.groupBy(by, F.date_trunc("hour", "_ts").alias("_hour"), F.session_window("_ts", gap).alias("s")).agg(
        F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.sum("n").alias("n")
    )
    near = F.col("first") < F.col("_before") + F.expr(f"INTERVAL {gap}")
    return _stitched(hourly.select(by, "first", "last", "n"), by, near).select(by, F.col("first").alias("first_seen"), F.col("last").alias("last_seen"), "n")


def alert_runs(states: DataFrame, by: str, ts: str = "window_end", breach: str = "breach", minutes: int = 5, step_minutes: int = 1) -> DataFrame:
    """Maximal runs of breaching samples, and whether each lasted long enough to fire.

    Works on windowed samples: one row per source and minute, whatever the number of events behind it. A missing sample
    ends a run. Runs are found inside each (source, day) and joined over the border of the day.
    """
    bad = states.filter(F.col(breach)).select(by, F.col(ts).alias("_ts"), F.date_trunc("day", ts).alias("_day"))
    step = step_minutes * 60
    w = Window.partitionBy(by, "_day").orderBy("_ts")
    island = F.unix_seconds("_ts") - F.row_number().over(w) * step
    daily = bad.withColumn("_island", island).groupBy(by, "_day", "_island").agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"), F.count("*").alias("n"))
    next_step = F.unix_seconds("first") - F.unix_seconds("_before") == step
    return (
        _stitched(daily.select(by, "first", "last", "n"), by, next_step)
        .select(by, F.col("first").alias("since"), F.col("last").alias("until"), F.col("n").alias("samples"))
        .withColumn("fires", (F.unix_seconds("until") - F.unix_seconds("since")) >= minutes * 60)
    )
