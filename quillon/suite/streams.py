"""Windows over events, as bounded queries; tests run the same functions on streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon.streaming import windows
from quillon.suite.relational import rel


@rel("w1_tumbling", "select time_bucket(interval 1 hour, ts) as window_start, time_bucket(interval 1 hour, ts) + interval 1 hour as window_end, event_type, count(*) as n from events group by all")
def _(t):
    return windows.tumbling(t("events").df, "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)))


@rel("w2_sliding", "select s as window_start, s + interval 2 hour as window_end, count(*) as n from (select unnest([time_bucket(interval 1 hour, ts), time_bucket(interval 1 hour, ts) - interval 1 hour]) as s from events) group by s")
def _(t):
    return windows.tumbling(t("events").df, "ts", "2 hours", slide="1 hour", n=F.count(F.lit(1)))


@rel(
    "w3_sessions",
    "with a as (select user_id, ts, case when ts < lag(ts) over w + interval 30 minute then 0 else 1 end as b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts rows unbounded preceding) as k from a) select min(ts) as session_start, max(ts) + interval 30 minute as session_end, user_id, count(*) as n from s group by user_id, k",
)
def _(t):
    return windows.sessions(t("events").df, "ts", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
