"""Relation verification, repair and the fusion of two candidate sets. Frames are long: one row per entity or relation.

Entities: the group columns, id, text, type, evidence. Relations: the group columns, id, source_id, type, target_id,
claim_status, evidence. ``by`` names the group columns (a job). Joins are equi-joins on the group and an id, so a group
is hashed once and its partitioning is used again.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import bound, col, norm
from quillspan.sources.scratch import written

VERIFY_REASONS = [
    "unknown_entity_reference",
    "self_relation",
    "unknown_relation_type",
    "illegal_entity_type_signature",
    "missing_or_unknown_claim_status",
    "missing_or_malformed_relation_evidence",
    "malformed_source_entity_evidence",
    "malformed_target_entity_evidence",
    "entities_not_co_present_in_relation_evidence",
]


def well_formed(evidence: Column | str) -> Column:
    """At least one item, and each with a text and a segment."""
    e = col(evidence)
    solid = lambda t: t.substr(1, 32).rlike(r"(?U)\S") | t.rlike(r"(?U)\S")  # noqa: E731  of most texts the begin tells
    ok = F.forall(e, lambda v: F.coalesce(solid(v["text"]), F.lit(False)) & v["segment_id"].isNotNull())
    return F.coalesce((F.size(e) > 0) & ok, F.lit(False))


def segment_ids(evidence: Column | str) -> Column:
    return F.coalesce(F.array_sort(F.array_distinct(F.array_compact(F.transform(col(evidence), lambda v: v["segment_id"])))), F.array().cast("array<string>"))


def hold_both(texts: Column | str, a: Column | str, b: Column | str) -> Column:
    """One of the normalized texts holds both normalized texts, which aren't empty."""
    both = bound(F.struct(norm(a).alias("x"), norm(b).alias("y")), lambda s: (s["x"] != "") & (s["y"] != "") & F.exists(texts, lambda t: F.contains(t, s["x"]) & F.contains(t, s["y"])))
    return F.coalesce(both, F.lit(False))


def contains_both(evidence: Column | str, a: Column | str, b: Column | str) -> Column:
    """One item holds both texts, normalized and not empty."""
    return bound(F.transform(col(evidence), lambda v: norm(v["text"])), lambda t: hold_both(t, a, b))


def with_endpoints(relations: DataFrame, entities: DataFrame, by: list[str], fields: tuple[str, ...] = ("text", "type")) -> DataFrame:
    """relations with source_* and target_* of the entities; null where an id is unknown. Of entities that share an id
    one row is used."""
    own = entities.dropDuplicates([*by, "id"])
    for side in ("source", "target"):
        e = own.select(*by, F.col("id").alias(f"{side}_id"), F.lit(True).alias(f"{side}_known"), *(F.col(f).alias(f"{side}_{f}") for f in fields))
        relations = relations.join(e, [*by, f"{side}_id"], "left")
    return relations


def is_legal(signatures: DataFrame) -> DataFrame:
    """Signatures as the small side of verify(): relation types and type pairs. Bounded by the ontology."""
    return signatures.select(F.col("relation").alias("type"), F.col("source_type"), F.col("target_type")).distinct().withColumn("legal", F.lit(True))


def verify_relations(relations: DataFrame, entities: DataFrame, signatures: DataFrame, claims: list[str], by: list[str], cooccurrence: bool = True) -> DataFrame:
    """relations with reasons (all that apply, in the order of VERIFY_REASONS, else 'accepted'), accepted, and the sorted
    segment ids of both entities and the relation.

    Evidence doesn't go through the joins with entities: many relations of a text share one line. Each distinct evidence
    of a group is judged and normalized once, and meets its relations by 96 bits of hashes at the end."""
    known = [r[0] for r in signatures.select("relation").distinct().collect()]  # ontology size
    ends = entities.select(*by, "id", "text", "type", well_formed("evidence").alias("ok"), segment_ids("evidence").alias("segments"))
    mark = {"_h": F.xxhash64("evidence"), "_h2": F.hash("evidence")}
    judged = relations.select(*by, "evidence").distinct().select(*by, *(c.alias(k) for k, c in mark.items()), "evidence", well_formed("evidence").alias("_well"), segment_ids("evidence").alias("relation_segment_ids"), F.transform("evidence", lambda v: norm(v["text"])).alias("_texts"))
    x = with_endpoints(relations.withColumns(mark).drop("evidence"), ends, by, ("text", "type", "ok", "segments")).join(F.broadcast(is_legal(signatures)), ["type", "source_type", "target_type"], "left")
    key = {c: f"_{c}_judged" for c in (*by, *mark)}
    x = x.join(judged.withColumnsRenamed(key), reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(k)) for c, k in key.items())))
    has_s, has_t = F.col("source_known").isNotNull(), F.col("target_known").isNotNull()
    type_known = F.coalesce(F.col("type").isin(known), F.lit(False))
    checks = [
        ~(has_s & has_t),
        has_s & has_t & (F.col("source_id") == F.col("target_id")),
        ~type_known,
        type_known & has_s & has_t & F.col("legal").isNull(),
        ~F.coalesce(F.col("claim_status").isin(claims), F.lit(False)),
        ~F.col("_well"),
        has_s & ~F.col("source_ok"),
        has_t & ~F.col("target_ok"),
        has_s & has_t & F.col("_well") & ~hold_both("_texts", "source_text", "target_text") & F.lit(cooccurrence),
    ]
    reasons = F.array_compact(F.array(*(F.when(c, F.lit(r)) for c, r in zip(checks, VERIFY_REASONS, strict=True))))
    out = x.withColumn("reasons", reasons).withColumn("accepted", F.size("reasons") == 0)
    out = out.withColumn("reasons", F.when(F.col("accepted"), F.array(F.lit("accepted"))).otherwise(F.col("reasons")))
    none = F.array().cast("array<string>")
    out = out.withColumns({"source_segment_ids": F.coalesce("source_segments", none), "target_segment_ids": F.coalesce("target_segments", none)})
    return out.select(*relations.columns, "source_text", "source_type", "target_text", "target_type", "accepted", "reasons", "source_segment_ids", "target_segment_ids", "relation_segment_ids")


def repair_direction(relations: DataFrame, entities: DataFrame, signatures: DataFrame, by: list[str], repair: bool = True) -> DataFrame:
    """relations with direction: 'legal', 'repaired' (source and target swapped, since only that is legal) or 'rejected'."""
    legal = is_legal(signatures)
    x = with_endpoints(relations, entities, by, ("type",)).join(F.broadcast(legal), ["type", "source_type", "target_type"], "left")
    back = legal.select("type", F.col("source_type").alias("target_type"), F.col("target_type").alias("source_type"), F.col("legal").alias("legal_back"))
    x = x.join(F.broadcast(back), ["type", "source_type", "target_type"], "left")
    swap = F.col("legal").isNull() & F.col("legal_back").isNotNull() & F.lit(repair)
    direction = F.when(F.col("legal").isNotNull(), "legal").when(swap, "repaired").otherwise("rejected")
    s, t = F.when(swap, F.col("target_id")).otherwise(F.col("source_id")), F.when(swap, F.col("source_id")).otherwise(F.col("target_id"))
    return x.withColumn("direction", direction).withColumn("_s", s).withColumn("_t", t).select(*(F.col("_s").alias("source_id") if c == "source_id" else F.col("_t").alias("target_id") if c == "target_id" else F.col(c) for c in relations.columns), "direction")


def fuse_entities(v1: DataFrame, v2: DataFrame, verified: DataFrame, anchors: DataFrame | None, by: list[str], order: str) -> DataFrame:
    """v2 entities with accepted and reasons. An entity is accepted if V1 has its normalized text and type, an anchor of
    the job has, or it is an endpoint of a verified relation; of equal ones the first in order is, later ones are
    duplicates. anchors: the group columns, name, type. verified: relations with source_* and target_* text and type."""
    key = [*by, "name", "type"]
    keyed = v2.withColumn("name", norm("text"))
    flags = v1.select(*by, norm("text").alias("name"), "type").distinct().withColumn("agree", F.lit(True))
    ends = verified.select(*by, F.explode(F.array(F.struct(norm("source_text").alias("name"), F.col("source_type").alias("type")), F.struct(norm("target_text").alias("name"), F.col("target_type").alias("type")))).alias("e")).select(*by, "e.*").distinct().withColumn("endpoint", F.lit(True))
    x = keyed.join(flags, key, "left").join(ends, key, "left")
    if anchors is not None:
        x = x.join(anchors.select(*key).filter("name <> ''").distinct().withColumn("anchor", F.lit(True)), key, "left")
    else:
        x = x.withColumn("anchor", F.lit(None).cast("boolean"))
    why = F.array_compact(F.array(F.when(F.col("agree"), F.lit("v1_v2_exact_agreement")), F.when(F.col("anchor"), F.lit("source_gated_anchor_type_match")), F.when(F.col("endpoint"), F.lit("verified_relation_endpoint"))))
    x = x.withColumn("why", why)
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    accepted = (F.size("why") > 0) & (nth == 1)
    later = (F.size("why") > 0) & (nth > 1)
    reasons = F.when(later, F.array_append("why", F.lit("duplicate_normalized_text_and_type"))).when(F.size("why") == 0, F.array(F.lit("no_acceptance_signal"))).otherwise(F.col("why"))
    return x.withColumn("accepted", accepted).withColumn("reasons", reasons).select(*v2.columns, "name", "accepted", "reasons")


def surviving_relations(relations: DataFrame, accepted: DataFrame, by: list[str]) -> DataFrame:
    """Relations both of whose endpoints are accepted entities."""
    for side in ("source_id", "target_id"):
        relations = relations.join(accepted.select(*by, F.col("id").alias(side)), [*by, side], "left_semi")
    return relations


def candidate_pairs(mentions: DataFrame, signatures: DataFrame, by: list[str], segment: str = "seg") -> DataFrame:
    """Ordered pairs of different entities of one segment with a legal signature: one row per pair and relation type."""
    a = mentions.select(*by, segment, F.col("id").alias("source_id"), F.col("type").alias("source_type"))
    b = mentions.select(*by, segment, F.col("id").alias("target_id"), F.col("type").alias("target_type"))
    pairs = a.join(b, [*by, segment]).filter("source_id <> target_id")
    return pairs.join(F.broadcast(is_legal(signatures)), ["source_type", "target_type"]).groupBy(*by, "source_id", "source_type", "type", "target_id", "target_type").agg(F.min(segment).alias(segment))


def merge_reasons(*columns: Column) -> Column:
    """Reasons in order, each once."""
    return F.array_distinct(F.concat(*columns))


def risk_reasons(reasons: Column | str, claim: Column | str, confidence: Column | str, low: float = 0.8) -> Column:
    """Why a relation needs a second look: what the verifier found, a claim that isn't explicit, low confidence."""
    own = F.filter(F.coalesce(col(reasons), F.array().cast("array<string>")), lambda r: r != "accepted")
    claim_risk = F.when(col(claim).isin("inferred", "uncertain"), F.array(F.concat(F.lit("claim_status:"), col(claim)))).otherwise(F.array().cast("array<string>"))
    weak = F.when(col(confidence) < low, F.array(F.lit("low_confidence"))).otherwise(F.array().cast("array<string>"))
    return merge_reasons(own, claim_risk, weak)


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of every key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def renumber(rows: DataFrame, by: list[str], order: list[str], prefix: str, id_col: str = "id") -> DataFrame:
    """Adds new_id: prefix and the position in the group, from 1."""
    return rows.withColumn("new_id", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy(*by).orderBy(*order))))


def keep_best(rows: DataFrame, key: list[str], score: str, tie: str) -> DataFrame:
    """The row with the highest score of every key; of equal ones the least tie."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), tie))).filter("_n = 1").drop("_n")


#: Sources of one segment that are paired by one row.
SOURCES = 256


def best_pairs(mentions: DataFrame, signatures: DataFrame, by: list[str], score: Callable[[Column], Column], least: float, segment: str = "seg") -> DataFrame:
    """Of candidate_pairs() the relation type with the highest score of each ordered pair, of equal ones the least type, if
    the score is least or more: by, source_id, target_id, type, score. score: of a type, over these columns.

    Only mentions are shuffled. A segment's are one row, and so many sources of it meet all its mentions in a row; a pair's
    types are scored in the pair's row. Pairs of an id with several mentions may come up again; these alone are
    grouped."""
    m = mentions.select(*by, segment, "id", "type").dropna().repartition(*by)
    m = m.withColumn("many", F.count("*").over(Window.partitionBy(*by, "id")) > 1)
    lines = m.groupBy(*by, segment).agg(F.collect_list(F.struct("id", "type", "many")).alias("_all")).filter(F.size("_all") > 1)
    starts = F.explode(F.sequence(F.lit(1), F.size("_all"), F.lit(SOURCES)))
    rows = written(lines.withColumn("_at", starts).withColumn("_own", F.slice("_all", F.col("_at"), SOURCES)).select(*by, "_own", "_all"), "pair-sources")
    legal = signatures.groupBy("source_type", "target_type").agg(F.array_sort(F.collect_set("relation")).alias("_types"))
    most = legal.agg(F.coalesce(F.max(F.size("_types")), F.lit(0))).first()[0]  # ontology size

    def pairs(rows: DataFrame) -> DataFrame:
        x = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).select(*by, "_all", F.explode("_own").alias("_s")).select(*by, "_s", F.explode("_all").alias("_t"))
        x = x.select(*by, F.col("_s.id").alias("source_id"), F.col("_t.id").alias("target_id"), F.col("_s.type").alias("source_type"), F.col("_t.type").alias("target_type"), (F.col("_s.many") | F.col("_t.many")).alias("_many"))
        x = x.filter("source_id <> target_id").join(F.broadcast(legal), ["source_type", "target_type"])
        # Types are in order, so of equal scores the first is of the least one. A generated row, as a condition on it isn't
        # computed a second time before it is made.
        each = F.array(*(F.when(F.size("_types") > k, F.struct(score(F.get("_types", F.lit(k))).alias("score"), F.lit(-k).alias("k"))) for k in range(max(most, 1))))
        x = x.withColumn("_best", F.explode(F.array(F.array_max(each)))).filter(F.col("_best.score") >= least)
        return x.select(*by, "source_id", "target_id", F.get("_types", -F.col("_best.k")).alias("type"), F.col("_best.score").alias("score"), "_many")

    once = pairs(rows).filter("not _many")
    again = pairs(rows.filter(F.exists("_all", lambda e: e["many"]))).filter("_many")
    return once.unionByName(keep_best(again, [*by, "source_id", "target_id"], "score", "type")).drop("_many")
