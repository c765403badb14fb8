"""Integrity checks: alignment, coverage, accounting. Each gives a table of violations or of named checks and states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def missing_keys(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """key and why: 'missing' (expected only) or 'unexpected' (actual only)."""
    a = expected.select(*key).distinct().join(actual.select(*key), key, "left_anti").withColumn("why", F.lit("missing"))
    b = actual.select(*key).distinct().join(expected.select(*key), key, "left_anti").withColumn("why", F.lit("unexpected"))
    return a.unionByName(b)


def require_empty(violations: DataFrame, what: str) -> None:
    """ValueError with an example if there are violations."""
    if found := violations.head(1):
        raise ValueError(f"{what}: {found[0].asDict()}")


def union_shards(shards: list[DataFrame], key: list[str], jobs: DataFrame | None = None, position: str = "position") -> DataFrame:
    """Disjoint shards as one table. Repeated keys are an error; with jobs (key, position), missing and unknown keys are
    too, and rows get the jobs' position."""
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s)
    require_empty(duplicate_keys(out, key), "repeated in shards")
    if jobs is None:
        return out
    require_empty(missing_keys(jobs, out, key), "shards and jobs differ")
    return out.join(jobs.select(*key, position), key)


def replace_by_key(rows: DataFrame, newer: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: newer rows in the place of those with their key, and those of new keys."""
    return rows.join(newer.select(*key), key, "left_anti").unionByName(newer)


def aligned(left: DataFrame, right: DataFrame, position: str, fields: list[str]) -> DataFrame:
    """Positions at which two ordered tables differ, or that one of them lacks."""
    l_, r = left.select(position, F.struct(*fields).alias("l")), right.select(position, F.struct(*fields).alias("r"))
    return l_.join(r, position, "full").filter(~F.col("l").eqNullSafe(F.col("r")))


def violations(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """rows with reasons: the names of the checks that don't hold (null counts as not holding); rows without any go."""
    why = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return rows.withColumn("reasons", why).filter(F.size("reasons") > 0)


def count_checks(counts: DataFrame) -> DataFrame:
    """Count triplets that can't be: correct over gold or predicted, or negative."""
    return violations(counts, {"negative": F.least("gold", "predicted", "correct") >= 0, "correct_over_gold": F.col("correct") <= F.col("gold"), "correct_over_predicted": F.col("correct") <= F.col("predicted")})


def accounting(jobs: DataFrame, log: DataFrame, key: str, state: str = "status", order: str = "position") -> DataFrame:
    """jobs, success, failed, pending: the last state that the log has of every job."""
    last = log.groupBy(key).agg(F.max_by(state, order).alias("_s"))
    x = jobs.select(key).join(last, key, "left")
    return x.agg(F.count("*").alias("jobs"), F.count_if(F.col("_s") == "success").alias("success"), F.count_if(F.col("_s") == "failed").alias("failed"), F.count_if(F.col("_s").isNull() | ~F.col("_s").isin("success", "failed")).alias("pending"))


def run_checks(spark, checks: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """name, status, detail: every check gives a table of violations; one that breaks is a failed row, not the end."""
    rows = []
    for name, check in checks.items():
        try:
            bad = check().limit(1).collect()
            rows.append((name, "failed" if bad else "passed", str(bad[0].asDict())[:500] if bad else None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "failed", f"{type(e).__name__}: {e}"[:500]))
    return spark.createDataFrame(rows, "name string, status string, detail string")


def forbidden_fields(df: DataFrame, names: set[str]) -> list[str]:
    """Paths of the schema's fields, nested ones too, with a forbidden name."""
    found: list[str] = []

    def walk(kind, path: str) -> None:
        for f in getattr(kind, "fields", []):
            at = f"{path}.{f.name}".lstrip(".")
            if f.name in names:
                found.append(at)
            walk(f.dataType, at)
        for part in ("elementType", "valueType"):
            if hasattr(kind, part):
                walk(getattr(kind, part), path)

    walk(df.schema, "")
    return found


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, with repetitions, and which one."""
    return a.exceptAll(b).withColumn("only_in", F.lit("left")).unionByName(b.exceptAll(a).withColumn("only_in", F.lit("right")))


def manifest(files: DataFrame) -> DataFrame:
    """path, size and SHA-256 of binaryFile rows."""
    return files.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"))


def gate(baseline_f1: float, candidate_f1: float, margin: float = 0.01) -> bool:
    """Whether a candidate may be promoted: at most the margin below the baseline."""
    return candidate_f1 - baseline_f1 >= -margin - 1e-12
