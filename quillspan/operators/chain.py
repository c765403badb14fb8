"""Contracts of a run, from its inputs to its metrics: all rules of a stage are told in one pass.

Every part (expected jobs, log, partial and complete results, audits) is reduced to narrow rows of one form, brought
together once by job, and each rule is a predicate over a job's row. What comes out is one table of violations: rule and
job. A clean run gives none. Positions are those of the files' rows, given as a column.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def _broken(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule and key for each predicate that holds; a null one doesn't."""
    named = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items())))
    return rows.select(F.explode(named).alias("rule"), F.col(key).cast("string").alias("job"))


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has the metrics once an action on them has run: counts without a pass of their own."""
    o = Observation(name)
    return rows.observe(o, *(c.alias(k) for k, c in metrics.items())), o


def input_faults(jobs: DataFrame, gold: DataFrame, index: DataFrame, segments: DataFrame) -> DataFrame:
    """Faults of frozen inputs. jobs: position, job_id, document_id. gold: position, document_id. index: position,
    job_id, record_index. segments: job_id, segment_id, text, start, end.

    Rules: the three files go together row by row (missing_job, missing_gold, missing_index, wrong_index_job,
    wrong_record_index, wrong_document), job ids begin with their document's id (wrong_prefix) and are unique
    (repeated_job), as are the segment ids of a job (repeated_segment), and a segment ends where its text does
    (wrong_segment_end); no job is without segments (no_segments)."""
    sides = [jobs.select("position", F.lit("job").alias("side"), F.col("job_id").cast("string").alias("job_id"), F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast("long").alias("record_index")), gold.select("position", F.lit("gold").alias("side"), F.lit(None).cast("string").alias("job_id"), F.col("document_id").cast("string").alias("document_id"), F.lit(None).cast("long").alias("record_index")), index.select("position", F.lit("index").alias("side"), F.col("job_id").cast("string").alias("job_id"), F.lit(None).cast("string").alias("document_id"), F.col("record_index").cast("long").alias("record_index"))]
    of = lambda side, c: F.max(F.when(F.col("side") == side, F.col(c)))
    has = lambda side: F.max(F.col("side") == side)
    rows = reduce(DataFrame.unionByName, sides).groupBy("position").agg(has("job").alias("j"), has("gold").alias("g"), has("index").alias("x"), of("job", "job_id").alias("job_id"), of("index", "job_id").alias("index_job"), of("job", "document_id").alias("document_id"), of("gold", "document_id").alias("gold_document"), of("index", "record_index").alias("record_index"))
    rows = rows.withColumn("job", F.coalesce("job_id", "index_job", F.concat(F.lit("#"), "position")))
    by_row = _broken(rows, "job", {"missing_job": ~F.col("j"), "missing_gold": ~F.col("g"), "missing_index": ~F.col("x"), "wrong_index_job": F.col("job_id") != F.col("index_job"), "wrong_record_index": F.col("record_index") != F.col("position"), "wrong_document": F.col("document_id") != F.col("gold_document"), "wrong_prefix": ~F.col("job_id").startswith(F.concat("document_id", F.lit("_")))})
    per_segment = segments.groupBy(F.col("job_id").cast("string").alias("job_id"), "segment_id").agg(F.count("*").alias("n"), F.count_if(F.col("end") != F.col("start") + F.length("text")).alias("wrong")).groupBy("job_id").agg(F.max(F.col("n") > 1).alias("repeated"), (F.sum("wrong") > 0).alias("wrong"))
    per_job = jobs.groupBy(F.col("job_id").cast("string").alias("job_id")).agg(F.count("*").alias("n")).join(per_segment, "job_id", "full")
    by_job = _broken(per_job, "job_id", {"repeated_job": F.col("n") > 1, "unknown_segment_job": F.col("n").isNull(), "repeated_segment": F.col("repeated"), "wrong_segment_end": F.col("wrong"), "no_segments": F.col("repeated").isNull()})
    return by_row.unionByName(by_job)


def run_faults(expected: DataFrame, log: DataFrame, partial: DataFrame, complete: DataFrame, audits: DataFrame, counted: dict[str, int] | None = None) -> DataFrame:
    """Faults of a run. expected: position, job. log: job, status (one terminal row for each job). partial: job, digest
    (of the results of successes). complete: position, job, digest, n_items (all jobs in order; failures without items).
    audits: job. counted: by name, the jobs that a metric says it counted.

    Rules, by job: repeated_expected, log_missing, log_repeated, log_unknown, log_status (neither success nor failed),
    partial_unknown, partial_repeated, partial_not_success, success_not_partial, complete_missing, complete_unknown,
    complete_repeated, complete_order, complete_differs (from the partial result), failure_has_items, audit_unknown; and
    denominator:<name> where a metric counted more or fewer jobs than were expected."""
    none = {"position": "long", "status": "string", "digest": "string", "n_items": "long"}

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col("job").cast("string").alias("job"), F.lit(name).alias("side"), *((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in none.items()))

    parts = reduce(DataFrame.unionByName, [side(df, n) for n, df in (("expected", expected), ("log", log), ("partial", partial), ("complete", complete), ("audit", audits))])
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    n = {s: F.count_if(F.col("side") == s).alias(f"n_{s}") for s in ("expected", "log", "partial", "complete", "audit")}
    j = parts.groupBy("job").agg(*n.values(), of("log", "status").alias("status"), of("expected", "position").alias("position"), of("complete", "position").alias("at"), of("partial", "digest").alias("partial_digest"), of("complete", "digest").alias("digest"), of("complete", "n_items").alias("n_items"))
    c, known = F.col, F.col("n_expected") > 0
    rules = {
        "repeated_expected": c("n_expected") > 1,
        "log_missing": known & (c("n_log") == 0),
        "log_repeated": c("n_log") > 1,
        "log_status": ~c("status").isin("success", "failed"),
        "partial_repeated": c("n_partial") > 1,
        "partial_not_success": (c("n_partial") > 0) & (F.coalesce("status", F.lit("")) != "success"),
        "success_not_partial": (c("status") == "success") & (c("n_partial") == 0),
        "complete_missing": known & (c("n_complete") == 0),
        "complete_repeated": c("n_complete") > 1,
        "complete_order": known & (c("at") != c("position")),
        "complete_differs": (c("n_partial") > 0) & (c("n_complete") > 0) & ~c("partial_digest").eqNullSafe(c("digest")),
        "failure_has_items": (c("status") == "failed") & (c("n_items") > 0),
    }
    rules |= {f"{s}_unknown": ~known & (c(f"n_{s}") > 0) for s in ("log", "partial", "complete", "audit")}
    out = _broken(j, "job", rules)
    for name, said in (counted or {}).items():
        total = expected.agg(F.countDistinct("job").alias("n")).filter(F.col("n") != said)
        out = out.unionByName(total.select(F.lit(f"denominator:{name}").alias("rule"), F.lit(None).cast("string").alias("job")))
    return out


def provenance_faults(expected: DataFrame, rows: DataFrame, method: str) -> DataFrame:
    """Faults of contexts that a method made. expected: position, job. rows: position, job, document_id, method_name,
    train_graph_only, leave_current_document_out, source_documents (array). Rules: missing, unknown, repeated, order,
    method_name, train_graph_only, leave_current_document_out, and uses_own_document, whatever the flag says."""
    e = expected.select(F.col("job").alias("job"), F.col("position").alias("_at"))
    x = e.join(rows.withColumn("_n", F.count("*").over(_by_job())), "job", "full")
    return _broken(
        x,
        "job",
        {
            "missing": F.col("_n").isNull(),
            "unknown": F.col("_at").isNull(),
            "repeated": F.col("_n") > 1,
            "order": F.col("_at") != F.col("position"),
            "method_name": F.col("_n").isNotNull() & ~F.col("method_name").eqNullSafe(F.lit(method)),
            "train_graph_only": F.col("_n").isNotNull() & ~F.coalesce("train_graph_only", F.lit(False)),
            "leave_current_document_out": F.col("_n").isNotNull() & ~F.coalesce("leave_current_document_out", F.lit(False)),
            "uses_own_document": F.array_contains("source_documents", F.col("document_id")),
        },
    ).distinct()


def _by_job():
    from pyspark.sql import Window

    return Window.partitionBy("job")


def native_faults(native: DataFrame, jobs: DataFrame, gold: DataFrame) -> DataFrame:
    """Faults of rows in a model's own form. native: job, tokens, entities (array of start, end, type in tokens),
    relations (array of head, tail, type). jobs: job, text. gold: job, entities (array of start, end, type in
    characters), relations (array of source, target, type, by position of the entities).

    Rules: missing_native, missing_job, missing_gold, text (tokens joined by blanks), entities and relations, each in
    order. A token's place is the length of all before it and their blanks."""
    ends = F.transform(F.sequence(F.lit(1), F.size("tokens")), lambda k: F.length(F.array_join(F.slice("tokens", F.lit(1), k), " ")))
    places = F.when(F.size("tokens") > 0, ends).otherwise(F.array().cast("array<int>"))
    n = native.select("job", F.array_join("tokens", " ").alias("joined"), "tokens", places.alias("_ends"), F.col("entities").alias("_e"), F.col("relations").alias("_r"))
    spans = F.transform("_e", lambda e: F.concat_ws(":", F.when(e["start"] == 0, F.lit(0)).otherwise(F.get("_ends", e["start"] - 1) + 1), F.get("_ends", e["end"] - 1), e["type"]))
    n = n.select("job", "joined", spans.alias("spans"), F.transform("_r", lambda r: F.concat_ws(":", r["head"], r["tail"], r["type"])).alias("pairs"), F.lit(True).alias("_n"))
    j = jobs.select("job", "text", F.lit(True).alias("_j"))
    g = gold.select("job", F.transform("entities", lambda e: F.concat_ws(":", e["start"], e["end"], e["type"])).alias("gold_spans"), F.transform("relations", lambda r: F.concat_ws(":", r["source"], r["target"], r["type"])).alias("gold_pairs"), F.lit(True).alias("_g"))
    x = n.join(j, "job", "full").join(g, "job", "full")
    both = F.col("_n") & F.col("_g")
    return _broken(x, "job", {"missing_native": F.col("_n").isNull(), "missing_job": F.col("_j").isNull(), "missing_gold": F.col("_g").isNull(), "text": F.col("joined") != F.col("text"), "entities": both & ~F.col("spans").eqNullSafe(F.col("gold_spans")), "relations": both & ~F.col("pairs").eqNullSafe(F.col("gold_pairs"))})
