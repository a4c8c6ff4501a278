"""Queries that run streams over the events to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.sources.tables import table
from corpusloom.streaming import jobs as J


def _events(spark: SparkSession, d: str) -> DataFrame:
    return J.read_events(spark, f"{d}/events.parquet")


def stream_monitor(spark: SparkSession, d: str) -> DataFrame:
    """Hourly counts by type: the last update of each window."""
    out = J.last_state(J.run_to_files(J.monitor(_events(spark, d)), "monitor", "update"), "start", "event_type")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean", F.round("most", 6).alias("most"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed, and those open at the stream's end."""
    closed = J.run_to_files(J.sessions(_events(spark, d)), "sessions").select("user_id", "began", "ended", "n")
    seen = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    every = closed.unionByName(J.still_open(seen, closed))
    return every.select("user_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def stream_budget(spark: SparkSession, d: str) -> DataFrame:
    """Months against a budget of 40,000: the last update of each."""
    return J.last_state(J.run_to_files(J.budgets(_events(spark, d), 40_000.0), "budget", "update"), "month")


def stream_dialogs(spark: SparkSession, d: str) -> DataFrame:
    """Dialogs that were suspended, by topic."""
    x = _events(spark, d).select("user_id", "ts", "event_id", F.col("event_type").alias("topic"))
    out = J.run_to_files(J.dialogs(x), "dialogs")
    return out.where("why = 'suspended'").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("messages"))


def stream_theta(spark: SparkSession, d: str) -> DataFrame:
    """Ability of users, purchases and sign-ups counting as right answers."""
    a = _events(spark, d).select("user_id", "ts", "event_id", F.col("event_type").isin("purchase", "signup").alias("correct"))
    out = J.last_state(J.run_to_files(J.ability(a), "theta", "update"), "user_id")
    return out.select("user_id", F.round("theta", 6).alias("theta"), "n", "streak")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    out = J.run_to_files(J.deduplicated(_events(spark, d).select("event_id", "ts", "event_type")), "dedup")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (stream_monitor, stream_sessions, stream_budget, stream_dialogs, stream_theta, stream_dedup)}

SQL = {
    "stream_monitor": "select date_trunc('hour', ts) as start, event_type, count(*) as n, round(avg(value), 6) as mean, round(max(value), 6) as most from events group by 1, 2",
    "stream_sessions": "with x as (select user_id, ts, event_id, case when ts - lag(ts) over w > interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)), s as (select *, sum(new) over (partition by user_id order by ts, event_id) as session from x) select user_id, min(ts) as began, max(ts) + interval 30 minute as ended, count(*) as n from s group by user_id, session",
    "stream_budget": "select strftime(ts, '%Y-%m') as month, count(*) as n, round(sum(value), 4) as total, (case when sum(value) >= 40000 then 100 when sum(value) >= 32000 then 80 else 0 end)::int as level from events group by 1",
    "stream_dialogs": """with x as (select user_id, event_type as topic, ts, event_id, case when lag(ts) over w is null or ts - lag(ts) over w > interval 30 minute or lag(event_type) over w <> event_type then 1 else 0 end as new from events window w as (partition by user_id order by ts, event_id)),
        s as (select *, sum(new) over (partition by user_id order by ts, event_id) as i from x), g as (select user_id, i, min(topic) as topic, count(*) as n, min(ts) as began, max(ts) as ended from s group by 1, 2),
        y as (select *, lead(began) over (partition by user_id order by i) as nxt from g) select topic, count(*) as n, sum(n)::bigint as messages from y where nxt - ended <= interval 30 minute group by 1""",
    "stream_theta": """select user_id, round(list_reduce(list_prepend(0.0::double, list((event_type in ('purchase', 'signup'))::int::double order by ts, event_id)), lambda t, x: greatest(-3.0, least(3.0, t + 0.3 * (x - (0.25 + 0.75 / (1 + exp(-t))))))), 6) as theta, count(*) as n,
        list_reduce(list_prepend(0, list(case when event_type in ('purchase', 'signup') then 1 else -1 end order by ts, event_id)), lambda s, x: case when x = 1 then case when s >= 0 then s + 1 else 1 end else case when s <= 0 then s - 1 else -1 end end)::bigint as streak from events group by 1""",
    "stream_dedup": "select event_type, count(distinct event_id) as n from events group by 1",
}
