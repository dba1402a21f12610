"""Job, recognition and request tables derived from an event stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _k() -> Column:
    return F.get_json_object("props", "$.k").try_cast("int")


def _seconds_after(ts: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.round(seconds * 1_000_000).cast("bigint"))


def _pick(options: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(o) for o in options]), F.pmod(index, F.lit(len(options))).cast("int"))


def jobs_from_events(events: DataFrame) -> DataFrame:
    """Every event is a conversion job: its type gives the status, its value the processing time.

    Time-zone-free event times are read as UTC, which is the session's zone.
    """
    ts, kind = F.col("ts").cast("timestamp"), F.col("event_type")
    status = F.when(kind == "error", "failed").when(kind == "signup", "pending").when(kind == "click", "processing").otherwise("completed")
    started = F.when(kind != "signup", _seconds_after(ts, _k()))
    done = F.when(kind.isin("error", "view", "purchase"), _seconds_after(started, F.col("value")))
    return events.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        status.alias("status"),
        _pick(["pdf", "image", "json"], _k()).alias("input_format"),
        _pick(["json", "xml"], F.col("user_id")).alias("output_format"),
        F.concat(F.lit("doc-"), F.col("event_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        (_k() * 1000).cast("bigint").alias("file_size"),
        F.array(_pick(["en", "de", "pl"], _k())).alias("languages"),
        ts.alias("created_at"),
        started.alias("started_at"),
        done.alias("completed_at"),
        F.when(kind == "error", "conversion failed").alias("error_message"),
        F.col("user_id").alias("batch_id"),
        # Every fifth job is a batch of several files; the others state neither type nor number.
        F.when(F.pmod(_k(), F.lit(5)) == 0, "batch").alias("job_type"),
        F.when(F.pmod(_k(), F.lit(5)) == 0, F.lit(2) + F.pmod(_k(), F.lit(7))).cast("int").alias("n_files"),
    )


def ocr_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        (_k() / 100).cast("double").alias("confidence"),
        _pick(["en", "de", "pl"], _k()).alias("language"),
        _pick(["engine_a", "engine_b"], F.col("user_id")).alias("engine"),
        F.col("value").alias("processing_time"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def metrics_from_events(events: DataFrame) -> DataFrame:
    return events.select(
        F.concat(F.lit("job-"), F.col("event_id").cast("string")).alias("job_id"),
        F.lit("k").alias("metric_name"),
        _k().cast("double").alias("metric_value"),
        F.lit("count").alias("metric_unit"),
        F.col("ts").cast("timestamp").alias("recorded_at"),
    )


def api_calls_from_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("/"), kind).alias("endpoint"),
        F.lit("POST").alias("method"),
        F.when(kind == "error", 500).otherwise(200).alias("status_code"),
        F.col("value").alias("response_time"),
        (_k() * 10).cast("bigint").alias("request_size"),
        (_k() * 100).cast("bigint").alias("response_size"),
        F.col("user_id").alias("source"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
