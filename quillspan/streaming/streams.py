"""Streams over files: windows, sessions, keyed state with timers, gates, and workers that resume.

Results go to files in the shared folder, with a checkpoint beside them, so that a run goes on where the last one ended
and nothing is held by the driver. Two sinks: append() for rows that are final when they come, and versions() for
aggregates that later batches bring up to date; the latter writes each batch to a folder of its own, which a repeated
batch replaces, and latest() takes every key's last version.

State is bounded by watermarks: a session or an attempt leaves it once the watermark is past it. What is still open at
the end of a finite input is closed by end_of_input(), a row far in the future that moves the watermark and belongs to
no key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspan.sources.scratch import shared_dir

#: States after which a job needs no further run.
TERMINAL = ("success", "failed")
_FAR = "2200-01-01"


def events(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table's files as a stream."""
    path = f"{sf_dir}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{sf_dir}/{name}.parque*")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def _is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def _exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder for a stream's results and checkpoint."""
    return f"{shared_dir(spark)}/quillspan/stream-{label}-{uuid.uuid4().hex}"


def end_of_input(stream: DataFrame, folder: str, time: str = "ts") -> DataFrame:
    """stream with one more row, at a time far in the future and null in all other columns: once it is read, the watermark
    is past everything. What it makes has a null key, to be dropped from the files: a filter in the stream would be moved
    before the watermark."""
    spark, path = stream.sparkSession, f"{folder}/end"
    if not _exists(spark, path):
        kinds = {f.name: f.dataType for f in stream.schema.fields}
        row = spark.range(1).select(*(F.lit(_FAR if c == time else None).cast(t).alias(c) for c, t in kinds.items()))
        row.write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def append(stream: DataFrame, folder: str) -> DataFrame:
    """Runs the stream over what is there now, adding its rows to files; returns all rows of all runs."""
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")


def versions(stream: DataFrame, folder: str) -> DataFrame:
    """Runs an aggregating stream over what is there now; each batch's changed rows go to a folder of that batch."""
    spark = stream.sparkSession

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/versions/batch={batch}")

    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", f"{folder}/versions").schema(f"{_ddl(stream)}, batch bigint").parquet(f"{folder}/versions")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def latest(versions_: DataFrame, keys: list[str]) -> DataFrame:
    """The last version of each key."""
    rest = [c for c in versions_.columns if c not in (*keys, "batch")]
    return versions_.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_v")).select(*keys, "_v.*")


def resume(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Appends new rows to files; a second run goes on where the first ended."""
    stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def worker(jobs: DataFrame, folder: str, key: str, work: Callable[[DataFrame], DataFrame], name: str = "run") -> DataFrame:
    """Runs work() over jobs that no earlier batch or run has done, each key once, and adds its rows, which have the key,
    to files; returns all rows. name tells runs with checkpoints of their own apart; jobs that another of these, or a
    changed input, brings again are passed over, and a batch that failed half-way is done anew as a whole."""
    spark, path = jobs.sparkSession, f"{folder}/results"

    def one(rows: DataFrame, batch: int) -> None:
        todo, mine = rows.dropDuplicates([key]), f"{name}-{batch}"
        if _exists(spark, path):
            done = rows.sparkSession.read.option("basePath", path).parquet(path).filter(F.col("batch") != mine)
            todo = todo.join(done.select(key), key, "left_anti")
        work(todo).write.mode("overwrite").parquet(f"{path}/batch={mine}")

    jobs.writeStream.foreachBatch(one).option("checkpointLocation", f"{folder}/checkpoint-{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def timed(stream: DataFrame, late: str) -> DataFrame:
    """stream with ts as a timestamp with a watermark."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling_counts(stream: DataFrame, width: str, late: str) -> DataFrame:
    return timed(stream, late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_events(stream: DataFrame, key: list[str]) -> DataFrame:
    """The least event of each key; state is as many rows as there are keys, which are the result."""
    return stream.groupBy(*key).agg(F.min("event_id").alias("first_event"))


def once(stream: DataFrame, key: list[str], late: str) -> DataFrame:
    """stream without rows whose key came before within the watermark: repeated deliveries and retries."""
    return timed(stream, late).dropDuplicatesWithinWatermark(key)


def sessions(rows: DataFrame, gap: str) -> DataFrame:
    """Sessions of a table, or of a stream with a watermark, which gives each once it can't grow any more."""
    return rows.groupBy("user_id", F.session_window("ts", gap).alias("session")).agg(F.count("*").alias("n"))


def released(jobs: DataFrame, markers: DataFrame, key: str, within: str, late: str) -> DataFrame:
    """Jobs that wait for a marker of their key that comes after them, in the given time: job_id, marker_id. Both are
    streams with ts and an id column event_id; each side's rows stay in state as long as a partner may still come."""
    j = timed(jobs, late).select(F.col(key), F.col("event_id").alias("job_id"), F.col("ts").alias("job_ts"))
    m = timed(markers, late).select(F.col(key).alias("_key"), F.col("event_id").alias("marker_id"), F.col("ts").alias("marker_ts"))
    return j.join(m, F.expr(f"`{key}` = _key and marker_ts >= job_ts and marker_ts <= job_ts + interval {within}")).drop("_key")


def attempts(log: DataFrame, key: str, begins: list[str], succeeds: list[str], fails: list[str], patience: int, state: str = "event_type") -> DataFrame:
    """Attempts of jobs from their log, a stream with a watermark, ts, event_id and state: key, attempt (from 1),
    started_at, ended_at, status. A row of a state in begins starts an attempt; the first success or failure ends it, a
    new start supersedes it, and after so many seconds without any it has expired, by a timer, even if no row ever
    comes again. What comes without an open attempt is passed over.

    Rows wait in their key's state until the watermark is past them and are taken in order of time and id then, so the
    result doesn't depend on how rows fell into batches. State is one key's rows within the watermark's delay."""
    kind = log.schema[key].dataType.simpleString()
    out = f"`{key}` {kind}, attempt int, started_at timestamp, ended_at timestamp, status string"
    held = "waiting array<struct<us:bigint,id:bigint,state:string>>, attempt int, started bigint"

    def step(k: tuple, frames: Iterator[pd.DataFrame], state_: GroupState) -> Iterator[pd.DataFrame]:
        if pd.isna(k[0]):  # the end of the input
            return
        waiting, attempt, started = state_.get if state_.exists else ([], 0, None)
        waiting = [tuple(w) for w in waiting]
        for f in frames:
            waiting += zip(f["_us"].tolist(), f["event_id"].tolist(), f[state].tolist(), strict=True)
        now = state_.getCurrentWatermarkMs() * 1000
        ended = []

        def end(at: int, status: str) -> None:
            ended.append((k[0], attempt, pd.Timestamp(started, unit="us", tz="UTC"), pd.Timestamp(at, unit="us", tz="UTC"), status))

        waiting.sort()
        ready = sum(us <= now for us, _, _ in waiting)
        for us, _, s in waiting[:ready]:
            if started is not None and us > started + patience * 1_000_000:
                end(started + patience * 1_000_000, "expired")
                started = None
            if s in begins:
                if started is not None:
                    end(us, "superseded")
                attempt, started = attempt + 1, us
            elif started is not None and s in (*succeeds, *fails):
                end(us, "success" if s in succeeds else "failed")
                started = None
        waiting = waiting[ready:]
        due = started + patience * 1_000_000 if started is not None else None
        if due is not None and due <= now and not (waiting and waiting[0][0] <= due):
            end(due, "expired")
            started = due = None
        state_.update((waiting, attempt, started))
        times = [t for t in (due, waiting[0][0] if waiting else None) if t is not None]
        if times:
            state_.setTimeoutTimestamp(max(min(times) // 1000 + 1, state_.getCurrentWatermarkMs() + 1))
        if ended:
            yield pd.DataFrame(ended, columns=[key, "attempt", "started_at", "ended_at", "status"])

    rows = log.select(key, "ts", "event_id", state, F.unix_micros("ts").alias("_us"))
    return rows.groupBy(key).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def last_states(log: DataFrame, key: str, order: str, state: str = "status") -> DataFrame:
    """The last terminal state of every key."""
    return log.filter(F.col(state).isin(*TERMINAL)).groupBy(key).agg(F.max_by(state, order).alias(state))


def pending(jobs: DataFrame, log: DataFrame, key: str, order: str, retry_failed: bool = False) -> DataFrame:
    """Jobs that still have to run: those without a terminal state, and failed ones if they are to be tried again."""
    done = last_states(log, key, order)
    return jobs.join(done.filter("status = 'success'") if retry_failed else done, key, "left_anti")
