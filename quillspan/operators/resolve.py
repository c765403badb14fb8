"""Places of annotated texts: spans in segments, n-th occurrences, keys of spans and of what has none."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import matching_spans, matching_spans_in
from quillspan.functions.text import col


def _places(segments: list[dict], asked: list[dict]) -> Iterator[tuple[str, int | None, int | None]]:
    """resolve_spans() for one job: each segment is looked up by name, and all are searched as one text."""
    segments = sorted(segments, key=lambda s: s["start"])
    texts = {s["segment_id"]: (s["start"], s["text"]) for s in segments}
    whole, borders = "\0".join(s["text"] for s in segments), []
    at = 0
    for s in segments:
        borders.append(at)
        at += len(s["text"]) + 1
    for e in asked:
        text, given = e["text"] or "", e["given_start"]
        start, local = texts.get(e["segment_id"], (0, ""))
        if text and given is not None and given >= start and local.startswith(text, given - start):
            yield "resolved", given, given + len(text)
            continue
        found = [(start + x, start + y) for x, y in matching_spans(local, text)]
        if not found:
            for x, y in matching_spans(whole, text):
                k = bisect_right(borders, x) - 1
                found.append((segments[k]["start"] + x - borders[k], segments[k]["start"] + y - borders[k]))
        yield ("resolved", *found[0]) if len(found) == 1 else ("ambiguous" if found else "not_found", None, None)


def resolve_spans(entities: DataFrame, segments: DataFrame, by: list[str]) -> DataFrame:
    """entities with status (resolved, ambiguous, not_found), start and end.

    entities: by, text, segment_id and given_start, both null if unknown. segments: by, segment_id, start, text.
    A given place counts if the text is there; else the only match in the named segment; else the only one in all of the
    job's. Matches are exact, else with any white space between words. A job's entities are one row, and so are its
    segments, which its text bounds; rows come to Python in batches, and the entities' other columns stay away from it.
    """

    @F.arrow_udf("array<struct<status:string,start:int,end:int>>")
    def run(segs: pa.Array, asked: pa.Array) -> pa.Array:
        ends, out = [0], []
        for s, a in zip(segs, asked, strict=True):
            out += _places(s.as_py() or [], a.as_py())
            ends.append(len(out))
        status, start, end = zip(*out, strict=True) if out else ((), (), ())
        columns = [pa.array(status, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["status", "start", "end"]))

    own = entities.groupBy(*by).agg(F.collect_list(F.struct(*entities.columns)).alias("_own"))
    held = segments.groupBy(*by).agg(F.collect_list(F.struct("segment_id", "start", "text")).alias("_segs"))
    asked = F.transform("_own", lambda e: F.struct(e["text"].alias("text"), e["segment_id"].alias("segment_id"), e["given_start"].alias("given_start")))
    x = own.join(held, by, "left").select("_own", run("_segs", asked).alias("_places"))
    return x.select(F.explode(F.arrays_zip("_own", "_places")).alias("_e")).select("_e._own.*", "_e._places.*")


def nth_occurrence(uses: DataFrame, by: list[str], text: str, source: str, order: str) -> DataFrame:
    """uses with start: the k-th use of a text in a group gets its k-th place in the source (places don't overlap), the
    last one for all later uses; null if there is none."""
    w = Window.partitionBy(*by, text).orderBy(order)
    starts = F.transform(matching_spans_in(source, text), lambda m: m["start"])
    x = uses.withColumn("_k", F.row_number().over(w)).withColumn("_starts", starts)
    return x.withColumn("start", F.get("_starts", F.least(F.col("_k"), F.size("_starts")) - 1)).drop("_k", "_starts")


def hull(source: Column | str, *spans: tuple[str, str]) -> Column:
    """start, end and text of the least span that holds all of these."""
    low, high = F.least(*(F.col(a) for a, _ in spans)), F.greatest(*(F.col(b) for _, b in spans))
    return F.struct(low.alias("start"), high.alias("end"), F.substring(col(source), (low + 1).cast("int"), (high - low).cast("int")).alias("text"))


def span_keys(rows: DataFrame, by: list[str], side: str, position: str) -> DataFrame:
    """by and key: start, end and type; a row without a valid span has a key of its own, which nothing equals."""
    valid = F.coalesce((F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("type") != ""), F.lit(False))
    good = F.concat_ws(":", F.lit("span"), "start", "end", "type")
    return rows.select(*by, F.when(valid, good).otherwise(F.concat_ws(":", F.lit(side), F.lit("invalid"), F.col(position))).alias("key"))


def document_keys(rows: DataFrame, document: str, window: str, position: str, offset: str) -> DataFrame:
    """document and key of window predictions: places in the document, each once whatever windows have it; one without a
    place is a key by its window and position. rows: start and end in the window, null if unresolved, and type."""
    good = F.concat_ws(":", F.lit("span"), F.col("start") + F.col(offset), F.col("end") + F.col(offset), "type")
    return rows.select(document, F.when(F.col("start").isNotNull(), good).otherwise(F.concat_ws(":", F.lit("unresolved"), F.col(window), F.col(position))).alias("key")).distinct()


def unique_lookup(ends: DataFrame, mentions: DataFrame, key: list[str], concept: str) -> DataFrame:
    """ends with the concept that all mentions of their key have; null if there is none or more than one."""
    one = mentions.groupBy(*key).agg(F.min(concept).alias("_low"), F.max(concept).alias("_high")).filter("_low = _high")
    return ends.join(one.select(*key, F.col("_low").alias(concept)), key, "left")
