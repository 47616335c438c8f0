"""Streaming queries, each driven to the end of the data, with batch checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from sheetdelta.plans.registry import CHECKS, query
from sheetdelta.session import scratch_path
from sheetdelta.sources import readers
from sheetdelta.sources.testviews import view_ctes
from sheetdelta.streaming import jobs as J
from sheetdelta.streaming import progress as P
from sheetdelta.streaming.run import drain


def as_stream(v, df, name: str):
    """Writes a view to the shared folder and reads it as a file stream."""
    path = scratch_path(v.spark, name)
    df.write.parquet(path)
    return v.spark.readStream.schema(df.schema).parquet(path)


def details_stream(v):
    columns = ("run_id", "seq", "status", "change_level", "elapsed_sec")
    return as_stream(v, v.view("details").select(*columns), "details")


def events_stream(v):
    return as_stream(v, v.view("job_events").withColumn("at", F.col("at").cast("timestamp")), "events")


_LIVE = view_ctes("details").rstrip() + """,
live as (select run_id, seq, change_level, elapsed_sec, case when status in ('added', 'removed') then status when status = 'size_mismatch' or change_level = 'size_mismatch' then 'changed'
  when coalesce(change_level, 'unchanged') = 'unchanged' then 'unchanged' else 'changed' end as live_status from details)"""
_E = view_ctes("job_events").rstrip()


@query("t1_live_progress", _LIVE + """
select run_id, count(*) as done, count(*) filter (live_status = 'changed') as changed, count(*) filter (live_status = 'unchanged') as unchanged,
  count(*) filter (live_status = 'added') as added, count(*) filter (live_status = 'removed') as removed from live group by run_id""")
def t1(v):
    return drain(P.live_progress(details_stream(v)), ["run_id"])


@query("t2_live_page_stream", _LIVE + " select run_id, seq, live_status, change_level, seq * 2 as a_idx, seq * 2 + 1 as b_idx from live")
def t2(v):
    page_map = v.table("orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 2).alias("a_idx"),
        (F.col("o_orderkey") * 2 + 1).alias("b_idx"),
    )
    return drain(P.live_page_stream(details_stream(v), page_map))


@query("t3_latest_job_state", _E + r"""
select job_id, strftime(max(at_ts), '%Y-%m-%d %H:%M:%S') as at_text, arg_max(state, at_ts) as state, arg_max(progress, at_ts) as progress, count(*) as events,
  cast(regexp_extract(arg_max(message, at_ts), '(\d+) / (\d+)', 1) as bigint) as completed_pages, cast(regexp_extract(arg_max(message, at_ts), '(\d+) / (\d+)', 2) as bigint) as total_pages
from job_events group by job_id""")
def t3(v):
    latest = drain(J.latest_job_state(events_stream(v)), ["job_id"])
    return latest.select(
        "job_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "state", "progress", "events", "completed_pages", "total_pages"
    )


# silence counts up to the newest event of all jobs, less the lateness of the stream
_STALE = """, last as (select job_id, arg_max(state, row(at_ts, event_id)) as last_state, max(at_ts) as at_ts, count(*) as events from job_events group by job_id),
clock as (select epoch_ms(max(at_ts)) - 600000 as now from job_events)
select job_id, strftime(at_ts, '%Y-%m-%d %H:%M:%S') as last_at, last_state, events from last, clock
where last_state in ('queued', 'running', 'cancelling') and epoch_ms(at_ts) + case when last_state = 'queued' then 14400000 else 7200000 end < now"""


def _stale_columns(found):
    return found.select("job_id", F.date_format("last_at", "yyyy-MM-dd HH:mm:ss").alias("last_at"), "last_state", "events")


@query("t4_stale_jobs", _E + _STALE)
def t4(v):
    events = v.view("job_events").withColumn("at", F.col("at").cast("timestamp"))
    clock = events.agg((F.max("at") - F.expr("interval 10 minutes")).alias("now")).first()["now"]
    return _stale_columns(J.stale_jobs(events, F.lit(clock), 7200, 14400))


@query("t4_stale_jobs_stream", _E + _STALE)
def t4b(v):
    return _stale_columns(drain(J.stream_stale_jobs(events_stream(v), 7200, 14400)))


@query("t5_terminal_history", _E + """
select job_id, strftime(min(at_ts), '%Y-%m-%d %H:%M:%S') as at_text, arg_min(state, at_ts) as result from job_events where state in ('completed', 'cancelled', 'failed') and operation = 'compare' group by job_id""")
def t5(v):
    rows = J.terminal_history(v.view("job_events"))
    return rows.select("job_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "result")


@query("t5_terminal_history_stream", CHECKS["t5_terminal_history"])
def t5b(v):
    rows = drain(J.terminal_history(events_stream(v)), ["job_id"])
    return rows.select("job_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "result")


@query("t6_eta_stream", view_ctes("details").rstrip() + """
select run_id, count(*) + run_id % 7 as total, count(*) as done, sum(elapsed_sec) as elapsed_sec, sum(elapsed_sec) / count(*) * (run_id % 7) as remaining_sec from details group by run_id""")
def t6(v):
    totals = v.table("orders").groupBy(F.col("o_custkey").alias("run_id")).agg(F.count("*").alias("n"))
    totals = totals.select("run_id", (F.col("n") + F.col("run_id") % 7).alias("total"))
    return drain(P.eta_stream(details_stream(v), totals), ["run_id"])


@query("s8_read_job_events", _E + " select job_id, event_id, state, strftime(at_ts, '%Y-%m-%d %H:%M:%S') as at_text, message from job_events")
def s8(v):
    """The event log as JSON lines, read back as a stream."""
    path = scratch_path(v.spark, "event-log")
    v.view("job_events").write.json(path)
    read = drain(readers.stream_job_events(v.spark, path))
    return read.select("job_id", "event_id", "state", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at_text"), "message")
