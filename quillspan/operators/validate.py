"""Validation of annotations: schema, offsets and segments, quality issues, review queues, rendered context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import before_marker, norm, slice_text
from quillspan.operators.contracts import violations
from quillspan.operators.gate import contains_both, with_endpoints


def entity_schema_errors(entities: DataFrame, types: list[str], statuses: list[str]) -> DataFrame:
    """Entities that break the record schema, with the checks that fail."""
    return violations(entities, {"id": F.col("id").rlike("^E[0-9]+$"), "text": F.length("text") > 0, "type": F.col("type").isin(types), "confidence": F.col("confidence").between(0, 1), "review_status": F.col("review_status").isin(statuses), "evidence": F.size("evidence") > 0})


def relation_schema_errors(relations: DataFrame, types: list[str], claims: list[str]) -> DataFrame:
    return violations(relations, {"id": F.col("id").rlike("^R[0-9]+$"), "type": F.col("type").isin(types), "claim_status": F.col("claim_status").isin(claims), "confidence": F.col("confidence").between(0, 1), "evidence": F.size("evidence") >= 1})


def repeated_ids(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "id").agg(F.count("*").alias("n")).filter("n > 1")


def evidence_errors(items: DataFrame, documents: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """Evidence (by, id, text, segment_id, start, end) that doesn't lie in its document's text or in no segment of it.

    documents: by, doc_text; segments: by, segment_id. The base of a segment id ends at its first dot.
    """
    base = F.split_part("segment_id", F.lit("."), F.lit(1))
    known = segments.select(*by, F.split_part("segment_id", F.lit("."), F.lit(1)).alias("_base")).distinct().withColumn("_known", F.lit(True))
    x = items.withColumn("_base", base).join(known, [*by, "_base"], "left").join(documents.select(*by, "doc_text"), by, "left")
    out = violations(x, {"document": F.col("doc_text").isNotNull(), "segment": F.col("_known"), "offsets": (F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= F.length("doc_text")), "text": slice_text("doc_text", "start", "end") == F.col("text")})
    return out.select(*items.columns, "reasons")


def quality_issues(relations: DataFrame, entities: DataFrame, signatures: DataFrame, claims: list[str], segments: DataFrame, by: list[str]) -> DataFrame:
    """by, id, issue: one row for each issue of an entity or relation. segments: by, segment_id, text."""
    quotes = entities.select(*by, "id", "text", F.explode_outer("evidence").alias("v")).select(*by, "id", "text", F.col("v.segment_id").alias("segment_id"), F.col("v.text").alias("quote"))
    seen = quotes.join(segments.select(*by, "segment_id", F.col("text").alias("_seg")), [*by, "segment_id"], "left")
    good = F.coalesce(F.contains(norm("_seg"), norm("quote")) & (norm("quote") != ""), F.lit(False))
    ent = seen.groupBy(*by, "id").agg(F.max(good).alias("ok"), F.max(F.coalesce(F.contains(norm("_seg"), norm("text")), F.lit(False))).alias("found"))
    e_issues = F.array_compact(F.array(F.when(~F.col("ok"), "entity_evidence_invalid"), F.when(~F.col("found"), "entity_text_not_found")))
    known = [r[0] for r in signatures.select("relation").distinct().collect()]  # ontology size
    x = with_endpoints(relations, entities, by)
    legal = signatures.select(F.col("relation").alias("type"), "source_type", "target_type").withColumn("_legal", F.lit(True))
    x = x.join(F.broadcast(legal), ["type", "source_type", "target_type"], "left")
    both = F.col("source_known").isNotNull() & F.col("target_known").isNotNull()
    has = F.coalesce(F.exists("evidence", lambda v: norm(v["text"]) != ""), F.lit(False))
    r_issues = F.array_compact(F.array(
        F.when(~both, "relation_entity_reference_invalid"),
        F.when(~F.col("type").isin(known), "unknown_relation_type"),
        F.when(both & F.col("type").isin(known) & F.col("_legal").isNull(), "illegal_relation_signature"),
        F.when(~F.coalesce(F.col("claim_status").isin(claims), F.lit(False)), "claim_status_invalid"),
        F.when(~has, "relation_evidence_invalid"),
        F.when(both & has & ~contains_both("evidence", "source_text", "target_text"), "relation_evidence_missing_entity"),
    ))
    return ent.select(*by, "id", F.explode(e_issues).alias("issue")).unionByName(x.select(*by, "id", F.explode(r_issues).alias("issue")))


def review_queue(issues: DataFrame, rejected: DataFrame, by: str) -> DataFrame:
    """Jobs with issue and rejection counts and a priority, high ones first."""
    a = issues.groupBy(by).agg(F.count("*").alias("issue_count"))
    b = rejected.groupBy(by).agg(F.count("*").alias("relation_rejected_count"))
    x = a.join(b, by, "full").fillna(0, ["issue_count", "relation_rejected_count"])
    x = x.withColumn("priority", F.when((F.col("issue_count") > 0) | (F.col("relation_rejected_count") > 0), "high").otherwise("normal"))
    return x.orderBy(F.col("priority") != "high", by)


def renumber_annotation(entities: DataFrame, relations: DataFrame, by: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """Ids E1.., R1.. in order; relations name their endpoints by the new ids, and those without a known one go."""
    ids = entities.withColumn("new_id", F.concat(F.lit("E"), F.row_number().over(Window.partitionBy(*by).orderBy(order))))
    x = relations
    for side in ("source_id", "target_id"):
        x = x.join(ids.select(*by, F.col("id").alias(side), F.col("new_id").alias(f"_{side}")), [*by, side])
    x = x.withColumn("id", F.concat(F.lit("R"), F.row_number().over(Window.partitionBy(*by).orderBy(order)))).withColumn("source_id", F.col("_source_id")).withColumn("target_id", F.col("_target_id"))
    return ids.withColumn("id", F.col("new_id")).drop("new_id"), x.select(relations.columns)


def rebind_instructions(windows: DataFrame, parents: DataFrame, key: str = "parent_job_id", field: str = "system_instruction") -> DataFrame:
    """Windows with their parent job's instruction."""
    p = parents.select(F.col("job_id").alias(key), F.col(field).alias("_f"))
    return windows.drop(field).join(p, key).withColumnRenamed("_f", field)


def stamp_review(status: str, evidence_field: str = "review_status"):
    """A function for transform(): items with this review status."""
    return lambda e: e.withField(evidence_field, F.lit(status))


def render_context(anchors: Column | str, edges: Column | str, instruction: Column | str) -> Column:
    """An instruction with lines for anchors (text, type) and edges (source, relation, target) after its marker."""
    a = F.transform(anchors, lambda x: F.concat(F.lit("- "), x["type"], F.lit(": "), x["text"]))
    e = F.transform(edges, lambda x: F.concat(F.lit("- "), x["source"], F.lit(" --"), x["relation"], F.lit("--> "), x["target"]))
    return F.concat_ws("\n", F.concat(before_marker(instruction), F.lit("\n\nKG_RULES:")), F.concat_ws("\n", a), F.concat_ws("\n", e))


def quarantine_context(jobs: DataFrame, matches: DataFrame, key: str, channels: list[str]) -> DataFrame:
    """Jobs with empty context channels where the job's text is in the other side, and a flag."""
    x = jobs.join(matches.select(key).distinct().withColumn("quarantined", F.lit(True)), key, "left").withColumn("quarantined", F.coalesce("quarantined", F.lit(False)))
    for c in channels:
        x = x.withColumn(c, F.when(F.col("quarantined"), F.array().cast(jobs.schema[c].dataType)).otherwise(F.col(c)))
    return x


def encode_budget(rows: DataFrame, prompt: str, answer: str, limit: int) -> DataFrame:
    """Rows with the answer whole if it fits and the prompt cut to what is left; rows without room for a prompt go."""
    a = F.slice(F.col(answer), F.lit(1), F.least(F.size(answer), F.lit(limit)))
    room = F.lit(limit) - F.size(answer)
    return rows.filter(room > 0).withColumn(answer, a).withColumn(prompt, F.slice(F.col(prompt), F.lit(1), F.least(F.size(prompt), room)))
