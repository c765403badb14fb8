"""Queries of streams, run over the tables' files as they are, with equal batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.plans.queries import query
from quillspan.streaming import streams

#: Seconds after which an attempt without success or failure has expired.
PATIENCE = 6 * 3600


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_counts(spark, sf):
    """Hours brought up to date batch by batch; an hour's state goes a day after it."""
    got = streams.versions(streams.tumbling_counts(streams.events(spark, sf), "1 hour", "1 day"), streams.run_folder(spark, "hours"))
    last = streams.latest(got, ["window", "event_type"])
    return last.select("event_type", F.col("window.start").alias("hour"), "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type, min(event_id) AS first_event FROM events GROUP BY ALL")
def stream_dedup(spark, sf):
    key = ["user_id", "event_type"]
    return streams.latest(streams.versions(streams.first_events(streams.events(spark, sf), key), streams.run_folder(spark, "first")), key)


@query("SELECT event_id, user_id FROM events")
def stream_once(spark, sf):
    """Events delivered twice; each counts once."""
    e = streams.events(spark, sf).select("event_id", "user_id", "ts")
    return streams.append(streams.once(e.unionByName(e), ["event_id"], "1 day"), streams.run_folder(spark, "once")).select("event_id", "user_id")


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, k""")
def stream_session(spark, sf):
    """Sessions, each written once when the watermark is past it."""
    folder = streams.run_folder(spark, "sessions")
    e = streams.timed(streams.end_of_input(streams.events(spark, sf).select("user_id", "ts"), folder), "1 day")
    return streams.append(streams.sessions(e, "30 minutes"), folder).filter("user_id is not null").select("user_id", F.col("session.start").alias("session_start"), "n")


@query(f"""WITH s AS (SELECT *, event_type IN ('signup', 'click') AS begins FROM events WHERE user_id IS NOT NULL), a AS (SELECT *, sum(begins::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS attempt FROM s),
b AS (SELECT user_id, attempt, min(ts) FILTER (WHERE begins) AS started_at FROM a WHERE attempt > 0 GROUP BY ALL), n AS (SELECT *, lead(started_at) OVER (PARTITION BY user_id ORDER BY attempt) AS next_at, started_at + INTERVAL {PATIENCE} SECOND AS due FROM b),
t AS (SELECT user_id, attempt, min_by({{'ts': a.ts, 'event_type': event_type}}, {{'ts': a.ts, 'id': event_id}}) AS term FROM a JOIN n USING (user_id, attempt) WHERE event_type IN ('purchase', 'error') AND a.ts <= due GROUP BY ALL)
SELECT user_id, attempt::INT AS attempt, started_at, CASE WHEN term IS NOT NULL THEN term.ts WHEN next_at <= due THEN next_at ELSE due END AS ended_at, CASE WHEN term.event_type = 'purchase' THEN 'success' WHEN term.event_type = 'error' THEN 'failed' WHEN next_at <= due THEN 'superseded' ELSE 'expired' END AS status FROM n LEFT JOIN t USING (user_id, attempt)""")
def stream_attempts(spark, sf):
    """Attempts of each user: signups and clicks begin one, a purchase is its success, an error its failure."""
    folder = streams.run_folder(spark, "attempts")
    log = streams.timed(streams.end_of_input(streams.events(spark, sf).select("user_id", "event_id", "event_type", "ts"), folder), "1 day")
    return streams.append(streams.attempts(log, "user_id", ["signup", "click"], ["purchase"], ["error"], PATIENCE), folder)


@query("""SELECT j.user_id, j.event_id AS job_id, min(m.event_id) AS marker_id FROM events j JOIN events m ON j.user_id = m.user_id AND j.event_type = 'click' AND m.event_type = 'signup' AND m.ts >= j.ts AND m.ts <= j.ts + INTERVAL 12 HOUR GROUP BY ALL""")
def stream_released(spark, sf):
    """Clicks that wait for a signup of their user, twelve hours at most, and the first that releases them."""
    e = streams.events(spark, sf).select("user_id", "event_id", "event_type", "ts")
    pairs = streams.append(streams.released(e.filter("event_type = 'click'"), e.filter("event_type = 'signup'"), "user_id", "12 hours", "1 day"), streams.run_folder(spark, "released"))
    return pairs.groupBy("user_id", "job_id").agg(F.min("marker_id").alias("marker_id"))


@query("SELECT conv_id || ':' || turn AS job, any_value(length(coalesce(text, '')))::BIGINT AS n_chars, count(DISTINCT conv_id)::BIGINT AS runs FROM conversations GROUP BY conv_id, turn")
def stream_worker(spark, sf):
    """A worker that ran, lost its checkpoint and ran again: every job was done once."""
    folder = streams.run_folder(spark, "worker")
    jobs = streams.events(spark, sf, "conversations").withColumn("job", F.concat_ws(":", "conv_id", "turn"))
    work = lambda rows: rows.select("job", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))
    streams.worker(jobs, folder, "job", work)
    return streams.worker(jobs, folder, "job", work, "again").groupBy("job").agg(F.max("n_chars").alias("n_chars"), F.count("*").alias("runs"))
