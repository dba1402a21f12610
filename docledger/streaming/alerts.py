"""Stateful streaming: alerts that must hold for a while, and job lifecycles.

State is a few numbers per key and the rows that wait for the watermark. Rows are taken in the order of their time, once
the watermark has passed them, so results depend neither on the order of arrival nor on the borders of batches. Alerts
take windowed samples (one row per source and minute), never raw events, so a source that sends a third of all events
costs no more than any other.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ALERT_SCHEMA = "source BIGINT, at TIMESTAMP, state STRING, since TIMESTAMP"
_ALERT_STATE = "since BIGINT, last BIGINT, firing BOOLEAN, waiting STRING"


def _ts(seconds: int) -> pd.Timestamp:
    return pd.Timestamp(seconds, unit="s")


def _due(waiting: list, batches: Iterator[pd.DataFrame], time: str, value: str, watermark_ms: int) -> tuple[list, list]:
    """(rows that the watermark has passed, rows that still wait), each as [second, value] in order of time."""
    for batch in batches:
        seconds = batch[time].astype("datetime64[s]").astype("int64").tolist()
        waiting = waiting + [list(x) for x in zip(seconds, batch[value].tolist(), strict=True)]
    return _split(waiting, watermark_ms)


def _split(waiting: list, watermark_ms: int) -> tuple[list, list]:
    """Rows of [second, value], put in order of time: those that the watermark has passed, and the rest."""
    waiting.sort()
    passed = sum(at * 1000 < watermark_ms for at, _ in waiting)
    return waiting[:passed], waiting[passed:]


def alert_for(
    samples: DataFrame, by: str = "source", minutes: int = 5, step_minutes: int = 1, watermark: str = "10 minutes"
) -> DataFrame:
    """``firing`` once a condition has held without a break for ``minutes``, ``resolved`` when it breaks.

    ``samples`` needs columns (``by``, ``window_end``, ``breach``), at most one row per key and step. A missing sample is
    a break; a sample that comes late, but inside the watermark, is none. Samples come from a table that
    ``stream_error_rate`` or ``stream_slow_p95`` keeps: an append-mode stream takes no state after an aggregate.
    """
    hold, step = minutes * 60, step_minutes * 60

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, last, firing, held = state.get if state.exists else (-1, -1, False, "[]")
        now = state.getCurrentWatermarkMs()
        due, waiting = _due(json.loads(held), iter(()) if state.hasTimedOut else batches, "window_end", "breach", now)
        out = []
        for at, breach in due:
            broken = last >= 0 and at - last > step
            if firing and (broken or not breach):
                out.append((key[0], _ts(last + step if broken else at), "resolved", _ts(since)))
                firing = False
            if broken or not breach:
                since = -1
            if breach:
                since = at if since < 0 else since
                if not firing and at - since >= hold:
                    firing = True
                    out.append((key[0], _ts(at), "firing", _ts(since)))
            last = at
        # The watermark has passed the next sample's time, and there is none: the condition is no longer known to hold.
        if last >= 0 and (last + step) * 1000 < now:
            if firing:
                out.append((key[0], _ts(last + step), "resolved", _ts(since)))
            since, last, firing = -1, -1, False
        if last < 0 and not waiting:
            state.remove()
        else:
            state.update((since, last, firing, json.dumps(waiting)))
            next_due = min(([waiting[0][0]] if waiting else []) + ([last + step] if last >= 0 else []))
            state.setTimeoutTimestamp(max(next_due * 1000, now + 1))
        yield pd.DataFrame(out, columns=["source", "at", "state", "since"])

    return (
        samples.select(by, "window_end", "breach")
        .withWatermark("window_end", watermark)
        .groupBy(by)
        .applyInPandasWithState(update, ALERT_SCHEMA, _ALERT_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )


LIFECYCLE_SCHEMA = "job_id STRING, outcome STRING, started_at TIMESTAMP, ended_at TIMESTAMP, seconds DOUBLE"
# JSON list of [job, start, end, waiting rows] of the jobs of one part.
_LIFECYCLE_STATE = "jobs STRING"
# Fixed value: seconds after which a job counts as timed out.
JOB_TIMEOUT = 300
# Seconds for which an ended job is remembered, so that its later events are ignored.
REMEMBERED = 86_400
# Jobs are kept by the hash of their id, many in one row of state, so that Python is called for a part and not for each job. A
# checkpoint goes on with the number it was begun with.
PARTS = 1_024


def job_lifecycle(
    events: DataFrame, watermark: str = "10 minutes", timeout: int = JOB_TIMEOUT, remembered: int = REMEMBERED, parts: int = PARTS
) -> DataFrame:
    """Outcome and duration of every job from its status events (job_id, status, ts).

    A job ends with its first event ``completed`` or ``failed``, or as ``timeout`` when neither comes within the limit after
    its start. Events after the end are ignored for ``remembered`` seconds; what comes still later starts the job anew.
    """

    def lived(started: int, ended: int, due: list, waiting: list, now: int) -> tuple[int, int, list]:
        """(start, end, ends found as (outcome, start, end)) of a job after the rows that are due."""
        out = []
        for at, status in due:
            if ended >= 0 and at - ended > remembered:
                started, ended = -1, -1
            if ended >= 0:
                continue
            started = at if started < 0 else started
            if at - started > timeout:
                ended = started + timeout
                out.append(("timeout", started, ended))
            elif status in ("completed", "failed"):
                ended = at
                out.append((status, started, ended))
        if ended < 0 <= started and (started + timeout) * 1000 < now:
            ended = started + timeout
            out.append(("timeout", started, ended))
        if ended >= 0 and not waiting and (ended + remembered) * 1000 < now:
            started, ended = -1, -1
        return started, ended, out

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        jobs = {job: [started, ended, waiting] for job, started, ended, waiting in (json.loads(state.get[0]) if state.exists else ())}
        for batch in iter(()) if state.hasTimedOut else batches:
            seconds = batch["ts"].astype("datetime64[s]").astype("int64").tolist()
            for job, at, status in zip(batch["job_id"].tolist(), seconds, batch["status"].tolist(), strict=True):
                jobs.setdefault(job, [-1, -1, []])[2].append([at, status])
        found, kept, limits = [], [], []
        for job, (started, ended, rows) in jobs.items():
            due, waiting = _split(rows, now) if rows else ([], [])
            started, ended, out = lived(started, ended, due, waiting, now)
            found += [(job, *x) for x in out]
            if started < 0 and not waiting:
                continue
            kept.append((job, started, ended, waiting))
            if waiting:
                limits.append(waiting[0][0])
            if started >= 0:
                limits.append(ended + remembered if ended >= 0 else started + timeout)
        if kept:
            state.update((json.dumps(kept),))
            state.setTimeoutTimestamp(max(min(limits) * 1000, now + 1))
        else:
            state.remove()
        frame = pd.DataFrame(found, columns=["job_id", "outcome", "started_at", "ended_at"])
        frame["seconds"] = (frame["ended_at"] - frame["started_at"]).astype("float64")
        for c in ("started_at", "ended_at"):
            frame[c] = pd.to_datetime(frame[c].astype("int64"), unit="s")
        yield frame

    return (
        events.withWatermark("ts", watermark)
        .select(F.pmod(F.xxhash64("job_id"), F.lit(parts)).alias("part"), "job_id", "status", "ts")
        .groupBy("part")
        .applyInPandasWithState(update, LIFECYCLE_SCHEMA, _LIFECYCLE_STATE, "append", GroupStateTimeout.EventTimeTimeout)
    )
