"""Quotas, durations and streams over events, documents and customer.

Events are sparse (a few per user and day), so windows here are a day wide instead of a minute.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import operations
from ..plans.lineage import scratch_folder
from ..sources import files
from ..streaming import jobs
from . import query, table
from .catalogue import SQL_ASSETS
from .joins import SQL_MERGED, credits

DAY = 86_400
SQL_EVENTS = """SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS sec, CAST(ts - INTERVAL 8 HOUR AS DATE) AS day,
    CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 3 = 0 THEN user_id % 7 ELSE user_id END AS run FROM events"""


def requests(spark, folder) -> DataFrame:
    """Events as a request ledger; a few keys take a third of all requests."""
    at = F.col("ts").cast("timestamp")
    return table(spark, folder, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).otherwise(F.col("user_id")).alias("run"), F.col("event_id").alias("request_id"), "ts",
        F.floor(F.unix_micros(at) / 1_000_000).alias("epoch"), operations.quota_day(F.col("ts")).alias("day"), F.get_json_object("props", "$.k").cast("bigint").alias("k"),
        "event_type", "value",
    )


@query("rolling_usage", f"""
    WITH e AS ({SQL_EVENTS})
    SELECT run, event_id AS request_id, count(*) OVER w AS window_requests, CAST(sum(k) OVER w AS BIGINT) AS window_tokens,
           row_number() OVER (PARTITION BY run, day ORDER BY sec, event_id) AS day_requests
    FROM e WINDOW w AS (PARTITION BY run ORDER BY sec RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW)
""")
def rolling_usage(spark, folder):
    used = operations.rolling_usage(requests(spark, folder), ["run"], "epoch", "day", F.col("k"), "request_id", window=DAY)
    return used.select("run", "request_id", "window_requests", "window_tokens", "day_requests")


SQL_DURATIONS = """SELECT user_id, event_id, event_type, date_diff('microsecond', ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS micros FROM events"""


@query("step_durations", SQL_DURATIONS)
def step_durations(spark, folder):
    events = table(spark, folder, "events").select("user_id", "event_id", "event_type", "ts")
    return operations.step_durations(events, ["user_id"], "ts", "event_id").drop("ts")


@query("step_totals", f"SELECT event_type, count(micros) AS steps, CAST(sum(micros) AS BIGINT) AS total_micros, max(micros) AS longest_micros FROM ({SQL_DURATIONS}) GROUP BY 1")
def step_totals(spark, folder):
    return operations.step_totals(step_durations(spark, folder), ["event_type"])


SQL_STALLED = "SELECT user_id, event_id AS snapshot_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value / 10) ORDER BY {order}) > 1 AS stalled FROM events"


@query("stalled_runs", SQL_STALLED.format(order="ts, event_id"))
def stalled_runs(spark, folder):
    snapshots = table(spark, folder, "events").select("user_id", F.col("event_id").alias("snapshot_id"), "ts", "event_type", F.floor(F.col("value") / 10).alias("done"))
    return operations.stagnation(snapshots, ["user_id"], ["event_type", "done"], "ts", "snapshot_id").select("user_id", "snapshot_id", "stalled")


# A day wide, few requests: the sparse events still meet every limit.
LIMITS = operations.Limits(window=DAY // 2, requests=3, tokens=150, daily=5)


def ledger(spark, folder) -> DataFrame:
    settled = F.when(F.col("event_type") != "error", F.floor(F.col("k") / 2))
    return requests(spark, folder).select("run", "request_id", "epoch", "day", F.col("k").alias("estimate"), settled.alias("settled"), F.when(settled.isNotNull(), F.col("epoch") + 600).alias("settled_at"))


#: One request of every run a step; the list holds the admitted ones still inside the window.
SQL_ADMITTED = f"""
    WITH RECURSIVE e AS ({SQL_EVENTS}),
    r AS (SELECT run, event_id AS request_id, sec, day, k, CASE WHEN event_type <> 'error' THEN k // 2 END AS settled, row_number() OVER (PARTITION BY run ORDER BY sec, event_id) AS n FROM e),
    s AS (
        SELECT DISTINCT run, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS request_id, FALSE AS admitted, CAST(NULL AS DATE) AS day, CAST(0 AS BIGINT) AS today,
               CAST([] AS STRUCT(sec BIGINT, k BIGINT, settled BIGINT)[]) AS recent FROM r
        UNION ALL
        SELECT run, n, request_id, ok, day, before + CAST(ok AS BIGINT), CASE WHEN ok THEN list_append(recent, {{'sec': sec, 'k': greatest(1, k), 'settled': settled}}) ELSE recent END FROM (
            SELECT *, len(recent) < {LIMITS.requests} AND before < {LIMITS.daily} AND greatest(1, k) + coalesce(list_sum(list_transform(recent,
                   lambda x: CASE WHEN x.settled IS NOT NULL AND x.sec + 600 <= sec THEN x.settled ELSE x.k END)), 0) <= {LIMITS.tokens} AS ok FROM (
                SELECT r.*, list_filter(s.recent, lambda x: x.sec > r.sec - {LIMITS.window}) AS recent, CASE WHEN r.day IS NOT DISTINCT FROM s.day THEN s.today ELSE 0 END AS before
                FROM s JOIN r ON r.run = s.run AND r.n = s.n + 1)))
    SELECT run, request_id, admitted FROM s WHERE n > 0
"""


@query("admitted_requests", SQL_ADMITTED)
def admitted_requests(spark, folder):
    return operations.admit_requests(ledger(spark, folder), "run", LIMITS)


def table_stream(spark, folder, name: str) -> DataFrame:
    """A table as a stream, whether it is one file or a folder of part files."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}[.]parquet")


def event_stream(spark, folder) -> DataFrame:
    """The events table as a stream."""
    return table_stream(spark, folder, "events").withColumn("at", F.col("ts").cast("timestamp"))


@query("streamed_admissions", SQL_ADMITTED)
def streamed_admissions(spark, folder):
    stream = event_stream(spark, folder)
    k = F.get_json_object("props", "$.k").cast("bigint")
    epoch = F.floor(F.unix_micros("at") / 1_000_000)
    settled = F.when(F.col("event_type") != "error", F.floor(k / 2))
    rows = stream.select(
        F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 7).otherwise(F.col("user_id")).alias("run"), F.col("event_id").alias("request_id"), epoch.alias("epoch"),
        operations.quota_day(F.col("ts")).cast("string").alias("day"), k.alias("estimate"), settled.alias("settled"), F.when(settled.isNotNull(), epoch + 600).alias("settled_at"),
    )
    return jobs.drain(jobs.admit_stream(rows, "run", LIMITS))


@query("streamed_stagnation", SQL_STALLED.format(order="event_id"))
def streamed_stagnation(spark, folder):
    snapshots = event_stream(spark, folder).select("user_id", F.col("event_id").alias("snapshot_id"), "event_type", F.floor(F.col("value") / 10).alias("done"))
    signature = F.sha2(F.to_json(F.struct("done", "event_type")), 256)
    return jobs.drain(jobs.stagnation_stream(snapshots, "user_id", signature))


# A window has come out when its end is not after the last event less the delay.
SQL_CLOSED = "{end} <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"


@query("streamed_usage", f"""
    SELECT event_type, CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS window_start, count(*) AS requests, CAST(sum(json_extract(props, '$.k')::BIGINT) AS BIGINT) AS tokens
    FROM events GROUP BY 1, 2, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') HAVING {SQL_CLOSED.format(end="time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') + INTERVAL 6 HOUR")}
""")
def streamed_usage(spark, folder):
    stream = event_stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    found = jobs.drain(jobs.usage_windows(stream, "at", ["event_type"], "k", "6 hours", "1 day"))
    return found.select("event_type", F.unix_seconds("window.start").alias("window_start"), "requests", "tokens")


@query("streamed_sliding_usage", f"""
    WITH e AS (SELECT event_type, ts, json_extract(props, '$.k')::BIGINT AS k, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 3 HOUR * i AS start FROM events CROSS JOIN generate_series(0, 1) g(i))
    SELECT event_type, CAST(epoch(start) AS BIGINT) AS window_start, count(*) AS requests, CAST(sum(k) AS BIGINT) AS tokens FROM e GROUP BY event_type, start HAVING {SQL_CLOSED.format(end="start + INTERVAL 6 HOUR")}
""")
def streamed_sliding_usage(spark, folder):
    stream = event_stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    found = jobs.drain(jobs.usage_windows(stream, "at", ["event_type"], "k", "6 hours", "1 day", "3 hours"))
    return found.select("event_type", F.unix_seconds("window.start").alias("window_start"), "requests", "tokens")


@query("streamed_steps", f"""
    SELECT event_type AS gate, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS day_start, count(*) AS steps FROM events
    GROUP BY 1, 2, time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') HAVING {SQL_CLOSED.format(end="time_bucket(INTERVAL 1 DAY, ts, TIMESTAMP '1970-01-01') + INTERVAL 1 DAY")}
""")
def streamed_steps(spark, folder):
    path = scratch_folder(spark)
    events = table(spark, folder, "events")
    log = events.select(F.lit(1).alias("schema"), F.col("user_id").alias("pid"), F.col("event_type").alias("gate"), F.lit("step").alias("step"), F.lit("LOOK_001").alias("look_id"), F.col("ts").cast("timestamp").alias("at"))
    log.write.json(path)
    found = jobs.drain(jobs.step_counts(files.stream_activity_log(spark, path), "at", ["gate"], "1 day", "1 day"))
    return found.select("gate", F.unix_seconds("window.start").alias("day_start"), "steps")


@query("activity_log", "SELECT event_type AS gate, count(*) AS steps, count(DISTINCT user_id) AS runs FROM events GROUP BY 1")
def activity_log(spark, folder):
    path = scratch_folder(spark)
    events = table(spark, folder, "events")
    events.select(F.lit(1).alias("schema"), F.col("user_id").alias("pid"), F.col("event_type").alias("gate"), F.lit("s").alias("step"), F.col("ts").cast("timestamp").alias("at")).write.json(path)
    return files.read_activity_log(spark, path).groupBy("gate").agg(F.count("*").alias("steps"), F.count_distinct("pid").alias("runs"))


@query("streamed_sessions", f"""
    WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 8 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM e)
    SELECT user_id, epoch_us(min(ts)) AS started, epoch_us(max(ts) + INTERVAL 8 HOUR) AS ended, count(*) AS steps FROM s GROUP BY user_id, n HAVING {SQL_CLOSED.format(end="max(ts) + INTERVAL 8 HOUR")}
""")
def streamed_sessions(spark, folder):
    found = jobs.drain(jobs.run_sessions(event_stream(spark, folder), "at", ["user_id"], "8 hours", "1 day"))
    return found.select("user_id", F.unix_micros("session_window.start").alias("started"), F.unix_micros("session_window.end").alias("ended"), "steps")


@query("streamed_distinct_assets", f"SELECT DISTINCT length, sha256 FROM ({SQL_ASSETS})")
def streamed_distinct_assets(spark, folder):
    documents = table_stream(spark, folder, "documents")
    identity = documents.select(
        F.octet_length("text").cast("bigint").alias("length"), F.sha2("text", 256).alias("sha256"), F.timestamp_seconds(F.col("doc_id") + 1).alias("at")
    )
    return jobs.drain(jobs.first_arrivals(identity, "at", "3650 days")).select("length", "sha256")


@query("streamed_credits", SQL_MERGED)
def streamed_credits(spark, folder):
    existing, incoming = credits(spark, folder)
    path = scratch_folder(spark)
    incoming.write.parquet(f"{path}/incoming")
    refreshes = spark.readStream.schema(incoming.schema).parquet(f"{path}/incoming")
    return jobs.upsert_credits(refreshes, existing, ["project", "look_id"], f"{path}/map")
