"""Identifiers, digests and small numeric functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import canonical_text, col


def document_id(path: Column | str) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.sha2(col(path), 256), 1, 16))


def concept_id(lang: Column | str, kind: Column | str, name: Column | str) -> Column:
    return F.concat(F.lit("concept_"), F.substring(F.sha1(F.concat_ws("|", col(lang), col(kind), canonical_text(name))), 1, 16))


def record_digest(*fields: str, bits: int = 256) -> Column:
    """Digest of the fields as JSON with sorted keys; null fields are left out."""
    return F.sha2(F.to_json(F.struct(*sorted(fields))), bits)


def relation_id(*fields: str) -> Column:
    return F.concat(F.lit("relation_"), F.substring(F.sha1(F.to_json(F.struct(*sorted(fields)))), 1, 20))


def hash_rank_key(seed: int | str, ident: Column | str) -> Column:
    """What deterministic samples are ordered by."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), col(ident).cast("string")), 256)


def confidence(x: Column | str) -> Column:
    """A number in [0, 1]; what is none or not finite is 0."""
    v = col(x).try_cast("double")
    v = F.when(F.isnan(v) | v.isNull() | (F.abs(v) == float("inf")), 0.0).otherwise(v)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))


def ratio(n: Column | str, d: Column | str, digits: int = 4) -> Column:
    """n / d, 0 for an empty denominator, rounded."""
    return F.round(F.when(col(d) == 0, 0.0).otherwise(col(n) / col(d)), digits)


def f1(gold: Column | str, predicted: Column | str, correct: Column | str, digits: int | None = 4) -> Column:
    total = col(gold) + col(predicted)
    v = F.when(total == 0, 0.0).otherwise(2.0 * col(correct) / total)
    return F.round(v, digits) if digits is not None else v


def h16(x: Column) -> Column:
    """An integer below 65536 from the first four hex digits of an MD5."""
    return F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("int")


def h16b(x: Column) -> Column:
    """The same of the next four digits."""
    return F.conv(F.substring(F.md5(x), 5, 4), 16, 10).cast("int")
