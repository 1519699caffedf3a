"""Streams bound to the events table, each compared with its batch meaning in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.sinks import scratch_path
from ..streaming import limiter as li
from ..streaming import logs as lo
from .registry import query

# accepted times still in the window travel along the rows of a user; a day is the window here
_LIMIT_SQL = """
with recursive e as (select user_id, event_id, epoch_us(ts) as tick, row_number() over (partition by user_id order by ts, event_id) as k from events),
f as (
 select user_id, event_id, k, [tick] as recent, true as accepted from e where k = 1
 union all
 select e.user_id, e.event_id, e.k,
  case when len(list_filter(f.recent, lambda x: e.tick - x <= 86400000000)) < 3 then list_append(list_filter(f.recent, lambda x: e.tick - x <= 86400000000), e.tick)
       else list_filter(f.recent, lambda x: e.tick - x <= 86400000000) end,
  len(list_filter(f.recent, lambda x: e.tick - x <= 86400000000)) < 3
 from f join e on e.user_id = f.user_id and e.k = f.k + 1)
select user_id, event_id, accepted from f"""


def _log(t):
    return lo.read_log(t.spark, t.dir, "events.parquet", t.events.schema)


@query("rate_limit_flags", _LIMIT_SQL)
def _(t):
    ev = t.events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return li.rate_limit_flags(ev, "user_id", "at_us", "event_id", limit=3, window_s=86_400)


@query("rate_limit_stream", _LIMIT_SQL)
def _(t):
    ev = _log(t).select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"))
    return lo.drain(li.rate_limit_stream(ev, "user_id", "at_us", "event_id", limit=3, window_s=86_400))


@query("latest_state_stream", """
select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1""")
def _(t):
    path = scratch_path(t.spark, "latest")
    lo.latest_state_stream(_log(t), ["user_id"], ["ts", "event_id"], ["event_type"], path, scratch_path(t.spark, "latest-state"))
    return lo.read_latest(t.spark, path).select("user_id", "event_id", "event_type")


@query("attempt_log_stream", """
select strftime(ts, '%Y-%m-%d') as day, event_type, count(*) as n from events group by all""")
def _(t):
    out = lo.drain_to_end(_log(t), "ts", lambda log: lo.windowed_counts(log, "ts", "1 day", "10 minutes", "event_type"))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


@query("pause_sessions_stream", """
with e as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval 6 hour, true) as fresh from events),
s as (select *, sum(fresh::integer) over (partition by user_id order by ts rows unbounded preceding) as session from e),
g as (select user_id, session, min(ts) as first, max(ts) as last, count(*) as n from s group by all)
select user_id, epoch_us(first) as start_us, n from g""")
def _(t):
    out = lo.drain_to_end(_log(t), "ts", lambda log: lo.sessions(log, "ts", "6 hours", "10 minutes", "user_id"))
    return out.select("user_id", F.unix_micros("start").alias("start_us"), "n")
