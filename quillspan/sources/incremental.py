"""Derived tables that are brought up to date partition by partition.

A partitioned folder's fingerprint is made of its files' names, sizes and times, without reading any. A manifest beside
the derived table remembers, for each partition, the fingerprint of what it was made from, that of what was written, and
the version of the derivation. A partition is derived anew if any of these differs, also if someone changed the output;
all others are left alone. Manifests are never changed: each run writes the next one, and a run that failed half-way
leaves the old one, so that its partitions are stale still.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "part string, source_print string, output_print string, version string"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)  # noqa: SLF001
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p  # noqa: SLF001


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def fingerprints(spark: SparkSession, folder: str, by: str) -> DataFrame:
    """part (the partition folder's value, as written in its path) and a print of its data files. Sums and exclusive ors
    of hashes don't depend on order, so a partition's files are never brought together."""
    if not exists(spark, folder):
        return spark.createDataFrame([], "part string, print string")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder).select("path", "length", "modificationTime")
    h = F.xxhash64(F.regexp_extract("path", r"([^/]+)$", 1), "length", F.unix_micros("modificationTime"))
    part = F.regexp_extract("path", rf"/{by}=([^/]*)/", 1)
    sums = [F.count("*").cast("string"), F.bit_xor(h).cast("string"), F.sum(F.shiftright(h, 20)).cast("string")]
    return files.groupBy(part.alias("part")).agg(F.concat_ws(":", *sums).alias("print"))


def _manifest(spark: SparkSession, folder: str) -> tuple[int, DataFrame]:
    """The number and rows of the last manifest that was written whole."""
    fs, p = _fs(spark, f"{folder}/manifest")
    runs = [int(s.getPath().getName()[4:]) for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))] if fs.exists(p) else []  # noqa: SLF001
    if not runs:
        return 0, spark.createDataFrame([], _SCHEMA)
    return max(runs), spark.read.schema(_SCHEMA).parquet(f"{folder}/manifest/run-{max(runs)}")


def derive(spark: SparkSession, source: str, by: str, folder: str, work: Callable[[DataFrame], DataFrame], version: str = "1") -> tuple[DataFrame, list[str]]:
    """The derived table, work() of each partition of the source folder, and the partitions that were derived in this run,
    their folder names' values (the list grows with partitions, not with rows). work() must keep the column ``by`` and may
    not mix partitions."""
    out = f"{folder}/rows"
    run, known = _manifest(spark, folder)
    now, have = fingerprints(spark, source, by), fingerprints(spark, out, by)
    now = now.withColumnRenamed("print", "source_now").join(have.withColumnRenamed("print", "output_now"), "part", "full").join(known, "part", "full")
    same = F.col("source_print").eqNullSafe(F.col("source_now")) & F.col("output_print").eqNullSafe(F.col("output_now")) & (F.col("version") == version)
    state = now.select("part", F.when(F.col("source_now").isNull(), "gone").when(F.coalesce(same, F.lit(False)), "same").otherwise("stale").alias("state"))
    todo = {r["part"]: r["state"] for r in state.filter("state <> 'same'").collect()}
    before = {r["part"]: r["print"] for r in have.withColumnRenamed("output_now", "print").collect()} if todo else {}
    stale, gone = (sorted(p for p, s in todo.items() if s == k) for k in ("stale", "gone"))
    kind = spark.read.option("basePath", source).parquet(source).schema
    if stale:
        rows = spark.read.option("basePath", source).parquet(*(f"{source}/{by}={p}" for p in stale))
        work(rows.select(*(F.col(f.name).cast(f.dataType) for f in kind))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(out)
        after = {r["part"]: r["print"] for r in fingerprints(spark, out, by).collect()}
        gone += [p for p in stale if p in before and before[p] == after.get(p)]  # nothing was derived from it any more
    for p in gone:
        fs, path = _fs(spark, f"{out}/{by}={p}")
        fs.delete(path, True)
    if todo:
        prints = fingerprints(spark, source, by).withColumnRenamed("print", "source_print").join(fingerprints(spark, out, by).withColumnRenamed("print", "output_print"), "part", "left")
        prints.select("part", "source_print", "output_print", F.lit(version).alias("version")).write.mode("overwrite").parquet(f"{folder}/manifest/run-{run + 1}")
    return spark.read.option("basePath", out).parquet(out), stale


def drop(spark: SparkSession, folder: str) -> None:
    """Delete a folder."""
    fs, p = _fs(spark, folder)
    fs.delete(p, True)
