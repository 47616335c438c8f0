"""Job states from the event log, as batch or stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sheetdelta import config as C
from sheetdelta.functions.text import parse_progress

TERMINAL_STATES = ("completed", "cancelled", "failed")


def latest_job_state(events: DataFrame) -> DataFrame:
    """Newest event of every job (T3). Update or complete mode; state is one row per job."""
    pages = parse_progress(F.col("message"))
    body = F.struct("at", "event_id", "state", "progress", "message", pages.alias("pages"))
    return events.groupBy("job_id").agg(
        F.max_by(body, F.struct("at", "event_id")).alias("s"), F.count("*").alias("events")
    ).select(
        "job_id", "s.at", "s.state", "s.progress", "s.message", "s.pages.completed_pages", "s.pages.total_pages", "events"
    )


_STALE = "job_id string, last_at timestamp, last_state string, events long, state string, error string"


def stale_jobs(events: DataFrame, now: Column, silence_sec: int = 60, grace_sec: int = C.QUEUED_GRACE_SEC) -> DataFrame:
    """Active jobs without a sign of life (T4): the newest event is active and older than allowed.

    A job that is only queued is allowed ``grace_sec``, any other ``silence_sec``. Times
    are compared in milliseconds, as timers do.
    """
    newest = F.max_by(F.struct("at", "state"), F.struct("at", "event_id"))
    jobs = events.groupBy("job_id").agg(newest.alias("s"), F.count("*").alias("events"))
    allowed = F.when(F.col("s.state") == "queued", grace_sec).otherwise(silence_sec) * 1000
    silent = F.unix_millis("s.at") + allowed < F.unix_millis(now)
    return jobs.filter(F.col("s.state").isin(*C.ACTIVE_JOB_STATES) & silent).select(
        "job_id", F.col("s.at").alias("last_at"), F.col("s.state").alias("last_state"), "events",
        F.lit("failed").alias("state"), F.lit("stale worker process").alias("error"),
    )


#: Groups that the jobs of a stream are dealt to; a group keeps one state and one timer.
JOB_GROUPS = 2048
_HELD = "job_id array<string>, at_us array<long>, event_id array<long>, state array<string>, events array<long>, due array<long>"


def stream_stale_jobs(
    events: DataFrame, silence_sec: int = 60, grace_sec: int = C.QUEUED_GRACE_SEC, lateness: str = "10 minutes", groups: int = JOB_GROUPS,
) -> DataFrame:
    """The same on a stream, append mode: each job has a time when it is due, which a later event sets anew.

    A job is due once the watermark has passed its newest event by the allowed silence;
    finished jobs are forgotten then without a row. Jobs are dealt to ``groups`` by a hash. The state
    of a group holds its jobs, and its timer is the earliest due time, so a call serves many jobs.
    """

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ((),) * 6
        jobs = {job: tuple(rest) for job, *rest in zip(*held)}
        now, touched = state.getCurrentWatermarkMs(), set()
        if not state.hasTimedOut:
            for batch in batches:
                for job, when, number, other in zip(batch["job_id"], batch["at_us"], batch["event_id"], batch["state"]):
                    at, event, name, seen, _ = jobs.get(job, (-1, -1, "", 0, 0))
                    if (when, number) > (at, event):
                        at, event, name = int(when), int(number), other
                    due = at // 1000 + (grace_sec if name == "queued" else silence_sec) * 1000
                    jobs[job] = (at, event, name, seen + 1, max(due, now + 1))
                    touched.add(job)
        over = [job for job, held in jobs.items() if held[-1] < now and job not in touched]
        found = [(job, *jobs.pop(job)) for job in over]
        if jobs:
            state.update(tuple(map(list, zip(*((job, *rest) for job, rest in jobs.items())))))
            state.setTimeoutTimestamp(min(rest[-1] for rest in jobs.values()))
        elif state.exists:
            state.remove()
        stale = [(job, at, name, seen) for job, at, _, name, seen, _ in found if name in C.ACTIVE_JOB_STATES]
        if stale:
            names, ats, last, seen = zip(*stale)
            yield pd.DataFrame({
                "job_id": names, "last_at": pd.to_datetime(list(ats), unit="us", utc=True), "last_state": last, "events": seen,
                "state": "failed", "error": "stale worker process",
            })

    watched = events.withWatermark("at", lateness).select(
        F.pmod(F.xxhash64("job_id"), F.lit(groups)).alias("part"), "job_id", "at", F.unix_micros("at").alias("at_us"), "event_id", "state")
    return watched.groupBy("part").applyInPandasWithState(watch, _STALE, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def terminal_history(events: DataFrame) -> DataFrame:
    """One history row per finished job (T5); re-renders leave none. Update or complete mode.

    A job's first final event counts, by time and event number, in whatever order events
    arrive; the state is one row per finished job.
    """
    final = events.filter(F.col("state").isin(*TERMINAL_STATES)).filter(F.col("operation") == "compare")
    rows = final.select("job_id", "at", F.col("state").alias("result"), "event_id")
    return rows.groupBy("job_id").agg(F.min_by(F.struct("at", "result"), F.struct("at", "event_id")).alias("r")).select(
        "job_id", "r.at", "r.result"
    )
