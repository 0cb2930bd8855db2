"""Registered queries over streams, each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators.queries import query
from ledgerlens.streaming.windows import events_windows, on_time, windowed


def shown(df, *names):
    return df.select(*[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c.startswith("window") else F.col(c) for c in (*names,)])



@query("events_tumbling", "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 2) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def events_tumbling(spark, d):
    make = lambda s: windowed(on_time(s, "ts", "1 hour"), "ts", ["event_type"], {"n": F.count("*"), "total": F.sum("value"), "most": F.max("value")}, length="6 hours")
    out = events_windows(spark, f"{d}/events.parquet", make, ["window_start", "event_type"], "update")
    return shown(out, "window_start", "event_type", "n", "total", "most").withColumn("total", F.round("total", 2))


@query("events_sliding", "SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors FROM (SELECT event_type, time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01') - k * INTERVAL 6 HOURS AS s FROM events, range(4) r(k)) GROUP BY s")
def events_sliding(spark, d):
    make = lambda s: windowed(on_time(s, "ts", "1 hour"), "ts", [], {"n": F.count("*"), "errors": F.count_if(F.col("event_type") == "error")}, length="1 day", slide="6 hours")
    return shown(events_windows(spark, f"{d}/events.parquet", make, ["window_start"], "update"), "window_start", "window_end", "n", "errors")


@query("events_sessions", """SELECT user_id, strftime(date_trunc('second', min(ts)), '%Y-%m-%d %H:%M:%S') AS window_start, strftime(date_trunc('second', max(ts) + INTERVAL 8 HOURS), '%Y-%m-%d %H:%M:%S') AS window_end, count(*) AS n
  FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 8 HOURS THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def events_sessions(spark, d):
    make = lambda s: windowed(on_time(s, "ts", "1 hour"), "ts", ["user_id"], {"n": F.count("*")}, gap="8 hours")
    return shown(events_windows(spark, f"{d}/events.parquet", make, ["window_start", "user_id"], "complete"), "user_id", "window_start", "window_end", "n")
