"""Registered queries over job, recognition and request events, in batch and as streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.operators import quantiles
from docledger.plans import jobstats as js
from docledger.plans.registry import query
from docledger.session import run_folder
from docledger.sources import activity as act
from docledger.streaming import alerts, jobs as sj, silence

AS_OF = dt.datetime(2024, 1, 31)
_E = "CAST(json_extract_string(props, '$.k') AS INT)"
_JOBS = f"""jobs AS (SELECT 'job-' || event_id AS job_id, user_id AS batch_id, ts AS created_at, value AS secs, event_type IN ('error', 'view', 'purchase') AS done,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'processing' ELSE 'completed' END AS status,
  CASE {_E} % 3 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' ELSE 'json' END AS input_format, CASE user_id % 2 WHEN 0 THEN 'json' ELSE 'xml' END AS output_format,
  {_E} * 1000 AS file_size, {_E} AS k, coalesce({_E} % 5 = 0, false) AS batch FROM events)"""
_CALLS = "calls AS (SELECT '/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status_code, value AS response_time, user_id AS source, ts FROM events)"


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet")


def _r(c: Column | str, digits: int = 9) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits)


def _t(c: Column | str) -> Column:
    """Time as text, the same on every engine."""
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _ts(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S')"


@query(
    "conv_summary",
    f"""WITH {_JOBS} SELECT {_ts("date_trunc('day', created_at)")} AS day, input_format, output_format, status, count(*) AS job_count,
        coalesce(round(avg(CASE WHEN done THEN secs END), 9), -1) AS avg_seconds, round(avg(file_size), 9) AS avg_file_size
        FROM jobs WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY 1, 2, 3, 4""",
)
def conv_summary(spark, d):
    s = js.conversion_summary(act.jobs_from_events(_events(spark, d)), AS_OF)
    return s.select(_t("day").alias("day"), "input_format", "output_format", "status", "job_count", F.coalesce(_r("avg_seconds"), F.lit(-1.0)).alias("avg_seconds"), _r("avg_file_size").alias("avg_file_size"))


@query(
    "conv_rollup",
    f"""WITH {_JOBS} SELECT coalesce({_ts("date_trunc('day', created_at)")}, '') AS day, coalesce(status, '') AS status, count(*) AS job_count
        FROM jobs WHERE created_at >= TIMESTAMP '2024-01-01' GROUP BY ROLLUP ({_ts("date_trunc('day', created_at)")}, status)""",
)
def conv_rollup(spark, d):
    s = js.conversion_rollup(act.jobs_from_events(_events(spark, d)), AS_OF)
    return s.select(F.coalesce(_t("day"), F.lit("")).alias("day"), F.coalesce("status", F.lit("")).alias("status"), "job_count")


@query(
    "ocr_perf",
    f"""SELECT {_ts("date_trunc('hour', ts)")} AS hour, CASE user_id % 2 WHEN 0 THEN 'engine_a' ELSE 'engine_b' END AS engine,
        CASE {_E} % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'de' ELSE 'pl' END AS language, count(*) AS ocr_count, round(avg({_E} / 100.0), 9) AS avg_confidence,
        round(avg(value), 9) AS avg_seconds FROM events WHERE ts >= TIMESTAMP '2024-01-24' GROUP BY 1, 2, 3""",
)
def ocr_perf(spark, d):
    s = js.ocr_performance(act.ocr_from_events(_events(spark, d)), AS_OF)
    return s.select(_t("hour").alias("hour"), "engine", "language", "ocr_count", _r("avg_confidence").alias("avg_confidence"), _r("avg_seconds").alias("avg_seconds"))


_API = f"""SELECT {_ts("date_trunc('hour', ts)")} AS hour, endpoint, count(*) AS request_count, round(avg(response_time), 9) AS avg_response_time,
    count(*) FILTER (status_code >= 400) AS error_count, count(*) FILTER (status_code < 400) AS success_count FROM calls"""


@query("api_perf", f"WITH {_CALLS} {_API} WHERE ts >= TIMESTAMP '2024-01-30' GROUP BY 1, 2")
def api_perf(spark, d):
    s = js.api_performance(act.api_calls_from_events(_events(spark, d)), AS_OF)
    return s.withColumn("hour", _t("hour")).withColumn("avg_response_time", _r("avg_response_time"))


@query(
    "retention",
    f"""WITH {_JOBS}, {_CALLS} SELECT 'jobs' AS table_name, count(*) FILTER (created_at < TIMESTAMP '2024-01-21' AND status IN ('completed', 'failed')) AS deleted,
        count(*) FILTER (NOT (created_at < TIMESTAMP '2024-01-21' AND status IN ('completed', 'failed'))) AS kept FROM jobs
        UNION ALL SELECT 'api_calls', count(*) FILTER (ts < TIMESTAMP '2024-01-24'), count(*) FILTER (ts >= TIMESTAMP '2024-01-24') FROM calls""",
)
def retention(spark, d):
    e = _events(spark, d)
    return js.retention(act.jobs_from_events(e), act.api_calls_from_events(e), AS_OF, job_days=10)


@query(
    "latency_rating",
    f"""WITH {_CALLS} SELECT endpoint, round(avg(response_time), 9) AS avg_seconds, min(response_time) AS min_seconds, max(response_time) AS max_seconds, count(*) AS n,
        CASE WHEN avg(response_time) < 0.1 THEN 'excellent' WHEN avg(response_time) < 0.5 THEN 'good' WHEN avg(response_time) < 2 THEN 'fair' ELSE 'slow' END AS rating FROM calls GROUP BY endpoint""",
)
def latency_rating(spark, d):
    s = js.latency_stats(act.api_calls_from_events(_events(spark, d)))
    return s.withColumn("avg_seconds", _r("avg_seconds"))


@query("p95", f"WITH {_CALLS} SELECT endpoint, round(quantile_cont(response_time, 0.95), 9) AS quantile, count(*) AS n FROM calls GROUP BY endpoint")
def p95(spark, d):
    q = js.latency_quantile(act.api_calls_from_events(_events(spark, d)), ["endpoint"], exact=True)
    return q.withColumn("quantile", _r("quantile"))


# The value at the rank, from all values in order, and the middle of the range of equal relative error that it lies in.
_AT_RANK = "max(CASE WHEN pos = floor((known - 1) * 0.95::DOUBLE) THEN response_time END)"
_MIDDLE = f"round(CASE WHEN {_AT_RANK} > 0 THEN pow(1.01::DOUBLE / 0.99, ceil(ln({_AT_RANK}) / ln(1.01::DOUBLE / 0.99))) * 2 / (1.01::DOUBLE / 0.99 + 1) ELSE {_AT_RANK} END, 9)"


@query(
    "p95_approx",
    f"""WITH {_CALLS}, o AS (SELECT endpoint, response_time, count(response_time) OVER (PARTITION BY endpoint) AS known,
        row_number() OVER (PARTITION BY endpoint ORDER BY response_time NULLS LAST) - 1 AS pos FROM calls)
        SELECT endpoint, {_MIDDLE} AS quantile, count(*) AS n, true AS within FROM o GROUP BY endpoint""",
)
def p95_approx(spark, d):
    """From sketches of an hour; ``within`` holds them against the exact quantile: no further off than the proven error and one rank."""
    calls = act.api_calls_from_events(_events(spark, d))
    found = js.latency_quantile(calls, ["endpoint"])
    above = js.latency_quantile(calls, ["endpoint"], exact=True).select(F.col("endpoint").alias("_e"), F.col("quantile").alias("_q"))
    return found.join(above, F.col("endpoint").eqNullSafe(F.col("_e"))).select("endpoint", _r("quantile").alias("quantile"), "n", (F.col("quantile") <= F.col("_q") * 1.0100001).alias("within"))


@query(
    "p95_by_day",
    f"""WITH {_CALLS}, o AS (SELECT endpoint, date_trunc('day', ts) AS day, response_time, count(response_time) OVER w AS known,
        row_number() OVER (PARTITION BY endpoint, date_trunc('day', ts) ORDER BY response_time NULLS LAST) - 1 AS pos FROM calls
        WINDOW w AS (PARTITION BY endpoint, date_trunc('day', ts)))
        SELECT endpoint, {_ts("day")} AS day, {_MIDDLE} AS quantile, count(*) AS n FROM o GROUP BY endpoint, day""",
)
def p95_by_day(spark, d):
    """Hourly sketches, kept as a table, merged to days."""
    folder = f"{run_folder(spark)}/sketches"
    js.hourly_sketches(act.api_calls_from_events(_events(spark, d)), ["endpoint"]).write.parquet(folder)
    days = spark.read.parquet(folder).withColumn("day", F.date_trunc("day", "hour"))
    found = quantiles.estimated(quantiles.merged(days, ["endpoint", "day"]), ["endpoint", "day"], 0.95)
    return found.select("endpoint", _t("day").alias("day"), _r("quantile").alias("quantile"), "n")


@query(
    "rate_series",
    f"""WITH {_CALLS} SELECT {_ts("time_bucket(INTERVAL 5 MINUTE, ts)")} AS window_start, endpoint, count(*) AS requests, count(*) FILTER (status_code >= 500) AS errors,
        round(count(*) / 300.0, 9) AS per_second FROM calls GROUP BY 1, 2""",
)
def rate_series(spark, d):
    s = js.rate_series(act.api_calls_from_events(_events(spark, d)))
    return s.select(_t("window_start").alias("window_start"), "endpoint", "requests", "errors", _r("per_second").alias("per_second"))


@query(
    "job_list",
    f"""WITH {_JOBS} SELECT job_id, status, {_ts('created_at')} AS created_at, CASE WHEN batch THEN 'batch' ELSE 'single' END AS type,
        CASE WHEN batch THEN 2 + k % 7 ELSE 1 END AS n_files FROM jobs""",
)
def job_list(spark, d):
    j = js.job_list(act.jobs_from_events(_events(spark, d)))
    return j.select("job_id", "status", _t("created_at").alias("created_at"), "type", "n_files")


@query(
    "retention_kept",
    f"""WITH {_JOBS} SELECT job_id, status FROM jobs WHERE NOT (jobs.created_at < (SELECT max(created_at) FROM jobs) - INTERVAL 30 DAY AND status IN ('completed', 'failed'))""",
)
def retention_kept(spark, d):
    jobs = act.jobs_from_events(_events(spark, d))
    now = jobs.agg(F.max("created_at")).first()[0]
    return js.retained(jobs, now).select("job_id", "status")


@query("job_counts", f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status IN ('pending', 'processing')) AS active FROM jobs")
def job_counts(spark, d):
    return js.job_counts(act.jobs_from_events(_events(spark, d)))


@query(
    "job_progress",
    f"WITH {_JOBS} SELECT batch_id, count(*) AS total, count(*) FILTER (status IN ('completed', 'failed')) AS completed, round(count(*) FILTER (status IN ('completed', 'failed')) * 100.0 / count(*), 9) AS progress FROM jobs GROUP BY batch_id",
)
def job_progress(spark, d):
    return js.job_progress(act.jobs_from_events(_events(spark, d))).withColumn("progress", _r("progress"))


@query("job_metrics", f"WITH {_JOBS} SELECT status, count(*) AS n, round(avg(file_size / 1000), 9) AS mean_value FROM jobs GROUP BY status")
def job_metrics(spark, d):
    e = _events(spark, d)
    m = js.job_metrics(act.jobs_from_events(e), act.metrics_from_events(e))
    return m.groupBy("status").agg(F.count("*").alias("n"), _r(F.avg("metric_value")).alias("mean_value"))


@query("pending", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending(spark, d):
    docs, done = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    return js.pending_docs(docs.select("doc_id"), done)


@query("batch_summary", f"WITH {_JOBS} SELECT count(*) AS total, count(*) FILTER (status <> 'failed') AS successful, count(*) FILTER (status = 'failed') AS failed FROM jobs")
def batch_summary(spark, d):
    j = act.jobs_from_events(_events(spark, d)).withColumn("error", F.col("error_message"))
    return js.batch_summary(j)


@query("batch_failures", f"WITH {_JOBS} SELECT job_id, 'conversion failed' AS error FROM jobs WHERE status = 'failed'")
def batch_failures(spark, d):
    j = act.jobs_from_events(_events(spark, d)).withColumn("error", F.col("error_message"))
    return js.batch_failures(j, "job_id")


@query(
    "coverage",
    "SELECT 'invoice' AS doc_type, count(*) AS n_docs, count(o_orderstatus) FILTER (o_orderstatus IN ('O', 'F')) AS with_method, count(*) FILTER (o_orderpriority <> '4-NOT SPECIFIED') AS with_due FROM orders",
)
def coverage(spark, d):
    from docledger.sources.ledger import Ledger

    rates = js.fill_rates(Ledger(spark, d).invoices, leaves=["payment.method", "due_date"])
    return rates.groupBy("doc_type").agg(
        F.max("n_docs").alias("n_docs"), F.max(F.when(F.col("field") == "payment.method", F.col("filled"))).alias("with_method"),
        F.max(F.when(F.col("field") == "due_date", F.col("filled"))).alias("with_due"),
    )


_RATE = f"""WITH {_CALLS}, w AS (SELECT *, unnest(range(0, 5)) AS o FROM calls),
  s AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE * (o + 1) AS window_end, source, status_code FROM w),
  rate AS (SELECT window_end, source, count(*) AS n, count(*) FILTER (status_code >= 500) AS errors, count(*) FILTER (status_code >= 500) > count(*) * 0.1 AS breach FROM s GROUP BY 1, 2)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    return act.api_calls_from_events(_events(spark, d))


@query("error_rate_5m", f"{_RATE} SELECT {_ts('window_end')} AS window_end, source, n, errors, breach FROM rate")
def error_rate_5m(spark, d):
    return js.error_rate(_sources(spark, d)).withColumn("window_end", _t("window_end"))


@query(
    "alert_runs",
    f"""{_RATE}, b AS (SELECT source, window_end, epoch(window_end) / 60 - row_number() OVER (PARTITION BY source ORDER BY window_end) AS g FROM rate WHERE breach)
        SELECT source, {_ts('min(window_end)')} AS since, {_ts('max(window_end)')} AS until, count(*) AS samples,
        epoch(max(window_end)) - epoch(min(window_end)) >= 240 AS fires FROM b GROUP BY source, g""",
)
def alert_runs(spark, d):
    runs = js.alert_runs(js.error_rate(_sources(spark, d)), "source", minutes=4)
    return runs.select("source", _t("since").alias("since"), _t("until").alias("until"), "samples", "fires")


@query(
    "heartbeat_gaps",
    f"""WITH {_CALLS}, g AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM calls),
        s AS (SELECT source, ts, sum(new) OVER (PARTITION BY source ORDER BY ts) AS k FROM g)
        SELECT source, {_ts('min(ts)')} AS first_seen, {_ts('max(ts)')} AS last_seen, count(*) AS n FROM s GROUP BY source, k""",
)
def heartbeat_gaps(spark, d):
    g = js.heartbeat_gaps(_sources(spark, d), gap="1 hour")
    return g.select("source", _t("first_seen").alias("first_seen"), _t("last_seen").alias("last_seen"), "n")


# ---- streams: the same tables as file streams, run to their end


def _stream(spark: SparkSession, d: str) -> DataFrame:
    # The table may be one file or a folder of part files; a file stream reads the files of a folder.
    table = spark.read.parquet(f"{d}/events.parquet")
    names = {row["p"] for row in table.select(F.input_file_name().alias("p")).distinct().limit(1).collect()}
    whole = any(name.endswith("/events.parquet") for name in names)
    return sj.read_stream(spark, d, table.schema, glob="events.parquet") if whole else sj.read_stream(spark, f"{d}/events.parquet", table.schema)


def _finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = run_folder(spark)
    q = sj.start(stream, f"{folder}/out", f"{folder}/checkpoint")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


# Append mode emits a window once the watermark has passed its end: the last ones stay open.
_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM calls)"


@query("stream_hourly", f"WITH {_CALLS} {_API} GROUP BY date_trunc('hour', ts), endpoint HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= {_CLOSED}")
def stream_hourly(spark, d):
    s = _finished(spark, sj.stream_hourly_calls(act.api_calls_from_events(_stream(spark, d))))
    return s.withColumn("hour", _t("hour")).withColumn("avg_response_time", _r("avg_response_time"))


@query("stream_error_rate", f"{_RATE} SELECT {_ts('window_end')} AS window_end, source, n, errors, breach FROM rate WHERE window_end <= {_CLOSED}")
def stream_error_rate(spark, d):
    s = _finished(spark, sj.stream_error_rate(act.api_calls_from_events(_stream(spark, d))))
    return s.withColumn("window_end", _t("window_end"))


@query("stream_dedupe", f"WITH {_CALLS} SELECT DISTINCT source FROM calls")
def stream_dedupe(spark, d):
    calls = act.api_calls_from_events(_stream(spark, d)).select("source", "ts")
    # One day of repeats per source is dropped; the sink keeps what is first in each.
    first = _finished(spark, sj.stream_dedupe(calls, ["source"], watermark="1 day"))
    return first.select("source").distinct()


@query(
    "stream_p95",
    f"""WITH {_CALLS}, x AS (SELECT *, unnest(range(0, 5)) AS o FROM calls),
        s AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) + INTERVAL 1 MINUTE * (o + 1) AS window_end, endpoint, response_time FROM x),
        o AS (SELECT *, count(response_time) OVER (PARTITION BY window_end, endpoint) AS known,
          row_number() OVER (PARTITION BY window_end, endpoint ORDER BY response_time NULLS LAST) - 1 AS pos FROM s WHERE window_end <= {_CLOSED}),
        p AS (SELECT window_end, endpoint, {_MIDDLE} AS p95, count(*) AS n FROM o GROUP BY window_end, endpoint)
        SELECT {_ts("window_end")} AS window_end, endpoint, p95, n, p95 > 10 AS breach FROM p""",
)
def stream_p95(spark, d):
    s = _finished(spark, sj.stream_slow_p95(act.api_calls_from_events(_stream(spark, d))))
    return s.withColumn("window_end", _t("window_end")).withColumn("p95", _r("p95"))


@query(
    "alert_for",
    f"""{_RATE}, kept AS (SELECT * FROM rate WHERE window_end <= {_CLOSED}),
        mark AS (SELECT max(window_end) - INTERVAL 10 MINUTE AS passed FROM kept),
        bad AS (SELECT source, window_end, epoch(window_end) / 60 - row_number() OVER (PARTITION BY source ORDER BY window_end) AS g FROM kept, mark WHERE breach AND window_end < passed),
        held AS (SELECT source, min(window_end) AS since, max(window_end) AS until FROM bad GROUP BY source, g HAVING max(window_end) - min(window_end) >= INTERVAL 4 MINUTE)
        SELECT source, {_ts("since + INTERVAL 4 MINUTE")} AS "at", 'firing' AS state, {_ts("since")} AS since FROM held
        UNION ALL SELECT source, {_ts("until + INTERVAL 1 MINUTE")} AS "at", 'resolved' AS state, {_ts("since")} AS since FROM held, mark WHERE until + INTERVAL 1 MINUTE < passed""",
)
def alert_for(spark, d):
    # Two streams: windowed samples to a table, alerts from that table. Each keeps its own state and checkpoint.
    folder = run_folder(spark)
    samples = sj.stream_error_rate(act.api_calls_from_events(_stream(spark, d)))
    sj.start(samples, f"{folder}/samples", f"{folder}/checkpoint-samples").awaitTermination()
    found = _finished(spark, alerts.alert_for(sj.read_stream(spark, f"{folder}/samples", samples.schema), minutes=4))
    return found.select("source", _t("at").alias("at"), "state", _t("since").alias("since"))


@query(
    "silence_alarms",
    f"""WITH {_CALLS}, g AS (SELECT source, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY source ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM calls),
        s AS (SELECT source, ts, sum(new) OVER (PARTITION BY source ORDER BY ts) AS k FROM g),
        w AS (SELECT source, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY source, k)
        SELECT source, {_ts('first')} AS first_seen, {_ts('last')} AS last_seen, n, {_ts('last + INTERVAL 1 HOUR')} AS alarm_at FROM w
        WHERE epoch_us(last) + 3600000000 <= (SELECT (epoch_ms(max(ts)) - 600000) * 1000 FROM calls)""",
)
def silence_alarms(spark, d):
    silence.use_rocksdb(spark)
    found = _finished(spark, silence.silence_alarms(act.api_calls_from_events(_stream(spark, d)), gap_seconds=3600))
    return found.select("source", *(_t(c).alias(c) for c in ("first_seen", "last_seen", "alarm_at")), "n")


_LIVES = """WITH e AS (SELECT 'job-' || user_id || '-' || epoch(date_trunc('hour', ts))::BIGINT AS job_id, floor(epoch(ts))::BIGINT AS sec,
    CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' ELSE 'processing' END AS status FROM events),
  j AS (SELECT job_id, min(sec) AS started, min(sec) FILTER (status <> 'processing') AS e FROM e GROUP BY job_id),
  o AS (SELECT job_id, started, CASE WHEN e - started <= 300 THEN (SELECT min(status) FROM e AS x WHERE x.job_id = j.job_id AND x.sec = j.e AND x.status <> 'processing') ELSE 'timeout' END AS outcome,
    CASE WHEN e - started <= 300 THEN e ELSE started + 300 END AS ended FROM j)"""


@query(
    "job_lifecycle",
    f"""{_LIVES} SELECT job_id, outcome, started, ended, CAST(ended - started AS DOUBLE) AS seconds FROM o
        WHERE ended * 1000 < (SELECT floor(epoch_ms(max(ts)))::BIGINT - 600000 FROM events)""",
)
def job_lifecycle(spark, d):
    """Jobs are the activity of a user within an hour."""
    e = _stream(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    status = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").otherwise("processing")
    job = F.concat_ws("-", F.lit("job"), F.col("user_id").cast("string"), F.unix_seconds(F.date_trunc("hour", "ts")).cast("string"))
    done = _finished(spark, alerts.job_lifecycle(e.select(job.alias("job_id"), status.alias("status"), "ts")))
    return done.select("job_id", "outcome", F.unix_seconds("started_at").alias("started"), F.unix_seconds("ended_at").alias("ended"), "seconds")
