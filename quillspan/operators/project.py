"""Projections of annotations: envelopes, compact and public forms, defaults, label aliases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.text import col


def unwrap(rows: DataFrame, envelope: str = "annotation") -> DataFrame:
    """The envelope's fields in place of the row's own where it isn't null; rows without the column stay."""
    if envelope not in rows.columns:
        return rows
    inner = rows.schema[envelope].dataType.fieldNames()
    outer = [c for c in rows.columns if c != envelope]
    return rows.select(*(F.when(F.col(envelope).isNotNull(), F.col(envelope)[c]).otherwise(F.col(c) if c in outer else F.lit(None)).alias(c) for c in inner), *(c for c in outer if c not in inner))


def compact_entities(entities: Column | str) -> Column:
    """id, text and type of each."""
    return F.transform(col(entities), lambda e: F.struct(e["id"].alias("id"), e["text"].alias("text"), e["type"].alias("type")))


def compact_relations(relations: Column | str) -> Column:
    return F.transform(col(relations), lambda r: F.struct(*(r[c].alias(c) for c in ("id", "source_id", "type", "target_id", "claim_status"))))


def public(rows: DataFrame) -> DataFrame:
    """Without private fields, those whose name begins with an underscore, in nested structs and arrays too."""

    def clean(x: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            kept = F.struct(*(clean(x[f.name], f.dataType).alias(f.name) for f in kind if not f.name.startswith("_")))
            return F.when(x.isNotNull(), kept)
        return F.transform(x, lambda v: clean(v, kind.elementType)) if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType) else x

    return rows.select(*(clean(F.col(f.name), f.dataType).alias(f.name) for f in rows.schema if not f.name.startswith("_")))


def payload_digest(items: Column | str) -> Column:
    return F.sha2(F.to_json(col(items)), 256)


def entities_only(rows: DataFrame, entities: str = "entities", relations: str = "relations") -> DataFrame:
    """rows without relations; before and after are the entity payload's digests, which must be equal."""
    out = rows.withColumn("before", payload_digest(entities)).withColumn(relations, F.slice(F.col(relations), 1, 0))
    return out.withColumn("after", payload_digest(entities))


def with_defaults(rows: DataFrame, **defaults: object) -> DataFrame:
    """Missing columns added and nulls filled."""
    for name, value in defaults.items():
        rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in rows.columns else F.lit(value))
    return rows


def alias_labels(label: Column | str, aliases: dict[str, str]) -> Column:
    """The canonical label of an alias; null for what is none. ValueError if two aliases share a label."""
    if len(set(aliases.values())) != len(aliases):
        raise ValueError("aliases must be one to one")
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in aliases.items() for x in pair)), col(label))


def joint_score(logits: Column | str, k: Column | str, other: Column | str) -> Column:
    """Geometric mean of another probability and the softmax of logits at k."""
    z = col(logits)
    low = F.array_max(z)
    total = F.aggregate(F.transform(z, lambda v: F.exp(v - low)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(F.exp(F.get(z, col(k)) - low) / total * col(other))
