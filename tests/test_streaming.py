"""Streams over a folder that grows between runs, each run a new query that goes on from the checkpoint."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillspan.plans.streaming import PATIENCE
from quillspan.streaming import streams

SF = "/root/testdata/sf0.001"


@pytest.fixture
def growing(spark, tmp_path):
    """Runs a stream three times, a third of the events (by time, so that sessions and attempts are cut) coming before
    each run; in the last run, the end of the input comes too."""
    events = spark.read.parquet(f"{SF}/events.parquet").repartition(1).sortWithinPartitions("ts")
    schema, cuts = events.schema, [-1, 333, 667, 10**9]  # ids are in order of time

    def run(go, closing=True):
        folder, source = str(tmp_path / "out"), str(tmp_path / "in")
        for k in range(3):
            events.filter((F.col("event_id") > cuts[k]) & (F.col("event_id") <= cuts[k + 1])).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).parquet(source)
            if closing and k == 2:
                events.limit(1).select(*(F.lit("2200-01-01" if c == "ts" else None).cast(schema[c].dataType).alias(c) for c in schema.names)).write.mode("append").parquet(source)
            out = go(stream, folder, k)
        return out

    return run


@pytest.fixture
def sql():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{SF}/events.parquet'")
    return lambda name, columns: sorted(map(str, c.sql(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()))


def rows(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*columns).collect())


def test_attempts(spark, growing, sql):
    columns = ["user_id", "attempt", "status"]
    seen = []

    def go(stream, folder, k):
        log = streams.timed(stream.select("user_id", "event_id", "event_type", "ts"), "1 hour")
        out = streams.append(streams.attempts(log, "user_id", ["signup", "click"], ["purchase"], ["error"], PATIENCE), folder)
        seen.append(out.count())
        return out

    got = growing(go)
    assert rows(got, columns) == sql("stream_attempts", columns)
    assert 0 < seen[0] < seen[1] < seen[2]


def test_sessions(growing, sql):
    def go(stream, folder, k):
        return streams.append(streams.sessions(streams.timed(stream.select("user_id", "ts"), "1 hour"), "30 minutes"), folder)

    assert rows(growing(go).filter("user_id is not null"), ["user_id", "n"]) == sql("stream_session", ["user_id", "n"])


def test_hours_and_first(growing, sql):
    def hours(stream, folder, k):
        return streams.latest(streams.versions(streams.tumbling_counts(stream, "1 hour", "1 hour"), folder + "h"), ["window", "event_type"])

    assert rows(growing(hours, closing=False), ["event_type", "n"]) == sql("stream_tumbling_counts", ["event_type", "n"])


def test_once_and_released(spark, growing, sql):
    def go(stream, folder, k):
        e = stream.select("event_id", "user_id", "event_type", "ts")
        out = streams.append(streams.once(e.unionByName(e), ["event_id"], "1 hour"), folder + "o").count()
        pairs = streams.append(streams.released(e.filter("event_type = 'click'"), e.filter("event_type = 'signup'"), "user_id", "12 hours", "1 hour"), folder + "r")
        return out, pairs

    n, pairs = growing(go, closing=False)
    assert n == spark.read.parquet(f"{SF}/events.parquet").count()
    assert rows(pairs.groupBy("user_id", "job_id").agg(F.min("marker_id").alias("marker_id")), ["user_id", "job_id", "marker_id"]) == sql("stream_released", ["user_id", "job_id", "marker_id"])


def test_worker(spark, growing):
    calls = []

    def go(stream, folder, k):
        work = lambda r: r.select("event_id", F.lit(k).alias("run"))
        out = streams.worker(stream, folder, "event_id", work, f"run{k}")  # every run has lost its checkpoint
        calls.append(out.count())
        return out

    out = growing(go, closing=False)
    assert out.count() == out.select("event_id").distinct().count() == spark.read.parquet(f"{SF}/events.parquet").count()
    assert calls == sorted(calls)
    assert {r["run"] for r in out.select("run").distinct().collect()} == {0, 1, 2}


def test_states(spark):
    log = spark.createDataFrame([("a", 1, "failed"), ("a", 2, "success"), ("a", 3, "running"), ("b", 1, "success"), ("b", 2, "failed"), ("c", 1, "running")], "job string, o int, status string")
    jobs = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "job string")
    assert sorted(r[0] for r in streams.pending(jobs, log, "job", "o").collect()) == ["c", "d"]
    assert sorted(r[0] for r in streams.pending(jobs, log, "job", "o", retry_failed=True).collect()) == ["b", "c", "d"]
