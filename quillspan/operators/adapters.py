"""Outputs of other systems as annotation rows, with a reason for every item that is dropped or doubtful.

Three forms come in: spans of token numbers, lists of names and types, and compact annotations without places. Each gives
the same tables: entities (job, id, text, type, start, end), relations (job, id, source_id, type, target_id, start, end:
the hull of both ends) and issues (job, kind, position, detail). Jobs are equi-joined; what is done in order within one
job (taking the next unused place) is one group of that job's mentions.

Defined results: null arrays are empty; null or blank texts are never found. Ids are made from positions, so that an item
that is dropped leaves a gap, or are the ones given; of equal given ids the last counts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import mention_spans
from quillspan.functions.text import bound, col, norm
from quillspan.operators.chunking import place_array

PLACES = "array<struct<start:int,end:int>>"
UNKNOWN = "UNKNOWN"
_HYPHEN_GAP = re.compile(r"(?<=-)\s+")


# --- places -----------------------------------------------------------------------------------------------------------


def align(text: str, tokens: Sequence[str]) -> list[tuple[int, int]] | None:
    """Places of the tokens in a text that has the same characters but for white space; None if it hasn't."""
    solid = np.array([k for k, c in enumerate(text) if not c.isspace()], int)
    parts = ["".join((t or "").split()) for t in tokens]
    if "".join(parts) != "".join(text.split()):
        return None
    ends = np.cumsum([len(p) for p in parts], dtype=int)
    out, last = [], 0
    for p, end in zip(parts, ends.tolist(), strict=True):
        if p:
            out.append((int(solid[end - len(p)]), int(solid[end - 1]) + 1))
            last = out[-1][1]
        else:
            out.append((last, last))
    return out


_BLANKS = np.zeros(0x3002, bool)  # white space by number of the character; the last entry stands for all that follow
_BLANKS[[k for k in range(0x3001) if chr(k).isspace()]] = True


def _aligned(text: str, joined: str, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """align() by arrays. joined: the tokens without anything between; borders: where each begins in it, and its length."""
    own, other = (np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in (text, joined))
    solid, inked = np.flatnonzero(~_BLANKS[np.minimum(own, 0x3001)]), ~_BLANKS[np.minimum(other, 0x3001)]
    if not np.array_equal(own[solid], other[inked]):
        return None
    counts = np.append(0, np.cumsum(inked))[borders]
    after = np.append(0, solid + 1)
    ends = after[counts[1:]]
    return np.where(counts[1:] > counts[:-1], np.append(solid, 0)[counts[:-1]], ends), ends


def aligned_tokens(text: Column | str, tokens: Column | str) -> Column:
    """align() as an array of structs start and end; null where text and tokens differ."""

    @F.arrow_udf(PLACES)
    def run(texts: pa.Array, parts: pa.Array) -> pa.Array:
        at, values = parts.offsets.to_numpy(), pc.fill_null(parts.values, "")
        sizes = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
        starts, ends, counts, gone = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [0], []
        for k, t in enumerate(texts):
            first, stop = at[k], at[k + 1]
            joined = "".join(values[first:stop].to_pylist())
            got = _aligned(t.as_py() or "", joined, np.append(0, np.cumsum(sizes[first:stop])))
            gone.append(got is None)
            if got is not None:
                starts.append(got[0])
                ends.append(got[1])
            counts.append(0 if got is None else len(got[0]))
        number = lambda x: pa.array(np.concatenate(x).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(np.cumsum(counts).astype(np.int32)), pa.StructArray.from_arrays([number(starts), number(ends)], ["start", "end"]), mask=pa.array(gone, pa.bool_()))

    return run(text, tokens)


class FoldedText:
    """A text with white space as single blanks and none after hyphens, and for each character its place in the text."""

    def __init__(self, text: str) -> None:
        self.text, chars, at = text, [], []
        gap = False
        for k, c in enumerate(text):
            if c.isspace():
                gap = True
                continue
            if gap and chars and chars[-1] != "-":
                chars.append(" ")
                at.append(k - 1)
            gap = False
            chars.append(c)
            at.append(k)
        self.folded, self.at = "".join(chars), at

    def spans(self, needle: str) -> list[tuple[int, int]]:
        """Places of the needle that don't overlap; its blanks may be any white space, its hyphens may have white space
        after them. Where the needle itself has white space after a hyphen, the text must have some."""
        want = _HYPHEN_GAP.sub("", " ".join(needle.split()))
        gaps = [m.start() - k for k, m in enumerate(re.finditer(r"(?<=-) ", " ".join(needle.split())))]
        out, k = [], self.folded.find(want) if want else -1
        while k >= 0:
            good = all(self.at[k + g] > self.at[k + g - 1] + 1 for g in gaps)
            if good:
                out.append((self.at[k], self.at[k + len(want) - 1] + 1))
            k = self.folded.find(want, k + (len(want) if good else 1))
        return out


def tolerant_places(text: Column | str, needles: Column | str) -> Column:
    """For each of the needles (an array), its places in the text (FoldedText.spans), the text being folded once: an array
    of structs needle, start, end."""

    @F.pandas_udf("array<struct<needle:string,start:int,end:int>>")
    def run(texts: pd.Series, wanted: pd.Series) -> pd.Series:
        out = []
        for t, needles_ in zip(texts, wanted, strict=True):
            folded = FoldedText(t or "")
            out.append([{"needle": n, "start": a, "end": b} for n in ([] if needles_ is None else needles_) if n for a, b in folded.spans(n)])
        return pd.Series(out)

    return run(text, needles)


def located(uses: DataFrame, segments: DataFrame, by: list[str], text: str = "text", order: str = "position") -> DataFrame:
    """uses with segment_id, start, end: the k-th use of a text in a job takes its k-th place in the job's segments, the
    last one for all later uses, tolerant of white space and hyphens; null if it has none. segments: by, index, segment_id,
    start, text. Every segment is looked through once for all texts of its job."""
    needles = uses.groupBy(*by).agg(F.collect_set(text).alias("_needles"))
    hits = segments.select(*by, "index", "segment_id", F.col("start").alias("_at"), F.col("text").alias("_source")).join(needles, by)
    hits = hits.select(*by, "index", "segment_id", "_at", F.explode(tolerant_places("_source", "_needles")).alias("_p"))
    hits = hits.select(*by, F.col("_p.needle").alias(text), "segment_id", (F.col("_at") + F.col("_p.start")).alias("start"), (F.col("_at") + F.col("_p.end")).alias("end"), F.row_number().over(Window.partitionBy(*by, "_p.needle").orderBy("index", "_p.start")).alias("_k"))
    counts = hits.groupBy(*by, text).agg(F.max("_k").alias("_n"))
    nth = F.row_number().over(Window.partitionBy(*by, text).orderBy(order))
    x = uses.withColumn("_k", nth).join(counts, [*by, text], "left").withColumn("_k", F.least("_k", "_n")).drop("_n")
    return x.join(hits, [*by, text, "_k"], "left").drop("_k")


def _unused(body: str, names: Sequence[str | None]) -> Iterator[tuple[int | None, int | None]]:
    places = {t: mention_spans(body, t) if t else [] for t in set(names)}
    at, taken = dict.fromkeys(places, 0), set()
    for t in names:
        while at[t] < len(places[t]) and places[t][at[t]] in taken:
            at[t] += 1
        span = places[t][at[t]] if at[t] < len(places[t]) else (None, None)
        taken.add(span)
        yield span


def unused_places(source: Column | str, names: Column | str) -> Column:
    """For each of the names (an array), in order, the first place in the source, exact or else but for case, that no
    earlier one has taken: an array of structs start, end, null where there is none left."""

    @F.arrow_udf(PLACES)
    def run(sources: pa.Array, wanted: pa.Array) -> pa.Array:
        ends, out = [0], []
        for s, n in zip(sources, wanted, strict=True):
            out += _unused(s.as_py() or "", n.as_py() or [])
            ends.append(len(out))
        start, end = zip(*out, strict=True) if out else ((), ())
        columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32())]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, names=["start", "end"]))

    return run(source, names)


def placed_in(uses: DataFrame, sources: DataFrame, by: list[str], text: str, source: str, order: str) -> DataFrame:
    """uses with start, end and exact, the source's text there, as unused_places() gives them. sources: by, source, one row
    a job. A job's uses are one row, which meets the source once, and nothing is shuffled with a copy of the source."""
    own = uses.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in uses.columns if c != order)))).alias("_own"))
    x = own.join(sources.select(*by, F.col(source).alias("_source")), by, "left")
    x = x.select("_own", "_source", unused_places("_source", F.transform("_own", lambda e: e[text])).alias("_places"))
    x = x.select("_source", F.explode(F.arrays_zip("_own", "_places")).alias("_e")).select("_source", "_e._own.*", "_e._places.*")
    return x.select(*uses.columns, "start", "end", F.col("_source").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("exact"))


def next_unused(uses: DataFrame, by: list[str], text: str = "text", source: str = "source", order: str = "position") -> DataFrame:
    """uses, without source, with start and end: in order, each takes the first place of its text in the source, exact or
    else but for case, that no earlier one has taken; null if there is none left. Of a job's sources the first counts."""
    sources = uses.groupBy(*by).agg(F.min_by(source, F.when(F.col(source).isNotNull(), F.col(order))).alias(source))
    return placed_in(uses.drop(source), sources, by, text, source, order).drop("exact")


# --- labels -----------------------------------------------------------------------------------------------------------


def canonical_label(label: Column | str, allowed: list[str], fallback: str = UNKNOWN) -> Column:
    """struct (label, known): the allowed label with the same letters and digits, whatever case and marks; else the label
    as it is, or the fallback for a blank one."""
    fold = lambda x: re.sub(r"[^a-z0-9]+", "", x.casefold())
    known = F.create_map(*(F.lit(y) for a in {fold(a): a for a in allowed}.items() for y in a)) if allowed else F.expr("map('', cast(null as string))")
    raw = F.trim(F.coalesce(col(label), F.lit("")))
    hit = F.try_element_at(known, F.regexp_replace(F.lower(raw), "[^a-z0-9]+", ""))
    return F.struct(F.coalesce(hit, F.when(raw != "", raw), F.lit(fallback)).alias("label"), hit.isNotNull().alias("known"))


def _issue(rows: DataFrame, job: str, kind: Column | str, position: Column | str, detail: Column | str) -> DataFrame:
    return rows.select(job, (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), col(position).cast("int").alias("position"), col(detail).alias("detail"))


# --- adapters ---------------------------------------------------------------------------------------------------------


def from_token_spans(rows: DataFrame, job: str, types: list[str], relation_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From spans of token numbers. rows: job, text, tokens, entities (array of start, end, type), relations (array of
    head, tail, type, the ends by position of their entity). A job whose tokens aren't its text has no items but an issue;
    an entity with a span outside the tokens or of an unknown type goes, and relations with such an end go with it."""
    x = rows.select(job, "text", "entities", "relations", aligned_tokens("text", "tokens").alias("_at"))

    def placed(e: Column) -> Column:
        span = F.coalesce((e["start"] >= 0) & (e["start"] < e["end"]) & (e["end"] <= F.size("_at")), F.lit(False))
        fault = F.when(~span, "invalid_entity_span").when(~F.coalesce(e["type"].isin(types), F.lit(False)), "unknown_entity_type")
        detail = F.concat_ws(":", e["start"].cast("string"), e["end"].cast("string"), e["type"])
        at = F.when(fault.isNull(), F.struct(F.get("_at", e["start"])["start"].alias("start"), F.get("_at", e["end"] - 1)["end"].alias("end")))
        return F.struct(fault.alias("fault"), detail.alias("detail"), e["type"].alias("type"), at.alias("at"))

    def ended(r: Column, ents: Column) -> Column:
        head, tail = F.get(ents, r["head"])["at"], F.get(ents, r["tail"])["at"]
        fault = F.when(head.isNull() | tail.isNull(), "invalid_relation_endpoint").when(~F.coalesce(r["type"].isin(relation_types), F.lit(False)), "unknown_relation_type")
        detail = F.concat_ws(":", r["head"].cast("string"), r["tail"].cast("string"), r["type"])
        at = F.when(fault.isNull(), F.struct(F.least(head["start"], tail["start"]).alias("start"), F.greatest(head["end"], tail["end"]).alias("end")))
        return F.struct(fault.alias("fault"), detail.alias("detail"), r["head"].alias("head"), r["type"].alias("type"), r["tail"].alias("tail"), at.alias("at"))

    # Ends are looked up in the job's own array: no join, and one pass over the texts for each table that is asked for.
    both = bound(F.transform("entities", placed), lambda ents: F.struct(ents.alias("e"), F.transform("relations", lambda r: ended(r, ents)).alias("r")))
    x = x.select(job, "text", F.col("_at").isNull().alias("_lost"), F.when(F.col("_at").isNotNull(), both).alias("_x"))
    e = x.select(job, "text", F.posexplode("_x.e").alias("position", "e")).filter("e.fault is null").select(job, "text", "position", "e.type", "e.at.start", "e.at.end")
    entities = e.select(job, F.concat(F.lit("E"), F.col("position") + 1).alias("id"), F.col("text").substr(F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "type", "start", "end")
    r = x.select(job, F.posexplode("_x.r").alias("position", "r")).filter("r.fault is null")
    relations = r.select(job, F.concat(F.lit("R"), F.col("position") + 1).alias("id"), F.concat(F.lit("E"), F.col("r.head") + 1).alias("source_id"), "r.type", F.concat(F.lit("E"), F.col("r.tail") + 1).alias("target_id"), "r.at.start", "r.at.end")
    issue = lambda kind, position, detail: F.struct(kind.alias("kind"), position.cast("int").alias("position"), detail.cast("string").alias("detail"))
    lost = F.when(F.col("_lost"), F.array(issue(F.lit("tokens_differ_from_text"), F.lit(None), F.lit(None))))
    faults = lambda c: F.filter(F.transform(c, lambda y, k: issue(y["fault"], k, y["detail"])), lambda i: i["kind"].isNotNull())
    none = F.expr("cast(array() as array<struct<kind:string,position:int,detail:string>>)")
    issues = x.select(job, F.explode(F.concat(*(F.coalesce(c, none) for c in (lost, faults("_x.e"), faults("_x.r"))))).alias("i")).select(job, "i.*")
    return entities, relations, issues


def from_lists(rows: DataFrame, job: str, types: list[str], relation_types: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From lists of names. rows: job, text, entities (array of name, type), relations (array of head, relation, tail, the
    ends by name). Names take places in the text as unused_places() gives them; one without a place stays, with null places.
    An end that no entity is named by becomes one of unknown type. Labels may differ in case and marks."""
    e = rows.select(job, F.posexplode("entities").alias("position", "e")).select(job, F.struct(F.lit(0).alias("a"), F.col("position").alias("b")).alias("_o"), "position", F.trim(F.coalesce("e.name", F.lit(""))).alias("name"), F.col("e.type").alias("raw"), F.lit("ner").alias("origin"))
    r = rows.select(job, F.posexplode("relations").alias("position", "r")).select(job, "position", F.trim(F.coalesce("r.head", F.lit(""))).alias("head"), F.trim(F.coalesce("r.tail", F.lit(""))).alias("tail"), canonical_label("r.relation", relation_types).alias("_l"))
    ends = r.select(job, "position", F.explode(F.array(F.struct(F.lit(0).alias("role"), F.col("head").alias("name")), F.struct(F.lit(1).alias("role"), F.col("tail").alias("name")))).alias("x")).select(job, "position", "x.role", "x.name").withColumn("key", norm("name"))
    named = e.withColumn("key", norm("name"))
    place = F.struct((F.lit(1)).alias("a"), (F.col("position") * 2 + F.col("role")).alias("b"))
    missing = ends.join(named.select(job, "key").distinct(), [job, "key"], "left_anti").groupBy(job, "key").agg(F.min_by(F.struct("position", "role", "name"), place).alias("m")).select(job, "key", "m.*")
    added = missing.select(job, place.alias("_o"), "position", "name", F.lit(None).cast("string").alias("raw"), F.concat(F.lit("re_"), F.when(F.col("role") == 0, "head").otherwise("tail")).alias("origin"), "key")
    everyone = named.select(*added.columns).unionByName(added).withColumn("_n", F.row_number().over(Window.partitionBy(job).orderBy("_o"))).withColumn("_l", canonical_label("raw", types))
    flat = everyone.select(job, "_n", "position", "name", "key", "origin", F.col("_l.label").alias("type"), F.col("_l.known").alias("known"))
    spans = placed_in(flat, rows, [job], "name", "text", "_n")
    ident = F.concat(F.lit("E"), F.col("_n"))
    entities = spans.select(job, ident.alias("id"), F.coalesce("exact", "name").alias("text"), "type", "start", "end")
    first = spans.groupBy(job, "key").agg(F.min_by(F.struct("_n", "start", "end"), "_n").alias("f"))
    side = lambda p: first.select(job, F.col("key").alias(f"_{p}"), F.col("f._n").alias(f"{p}_n"), F.col("f.start").alias(f"{p}_start"), F.col("f.end").alias(f"{p}_end"))
    r = r.withColumn("_head", norm("head")).withColumn("_tail", norm("tail")).join(side("head"), [job, "_head"]).join(side("tail"), [job, "_tail"])
    both = F.col("head_start").isNotNull() & F.col("tail_start").isNotNull()
    relations = r.select(job, F.concat(F.lit("R"), F.col("position") + 1).alias("id"), F.concat(F.lit("E"), "head_n").alias("source_id"), F.col("_l.label").alias("type"), F.concat(F.lit("E"), "tail_n").alias("target_id"), F.when(both, F.least("head_start", "tail_start")).alias("start"), F.when(both, F.greatest("head_end", "tail_end")).alias("end"))
    orphans = ends.join(missing.select(job, "key", F.col("position").alias("_p"), F.col("role").alias("_r")), [job, "key"]).filter("position = _p and role = _r")
    issues = _issue(spans.filter("not known"), job, "unknown_entity_type", "position", "type")
    issues = issues.unionByName(_issue(spans.filter("start is null"), job, "unresolved_entity_span", "position", "name"))
    issues = issues.unionByName(_issue(orphans, job, "relation_endpoint_missing", "position", "name")).unionByName(_issue(r.filter("not _l.known"), job, "unknown_relation_type", "position", "_l.label"))
    return entities, relations, issues


def from_compact(rows: DataFrame, segments: DataFrame, job: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From compact annotations. rows: job, entities (array of id, text, type), relations (array of id, source_id, type,
    target_id). An entity needs all its fields and a place, as located() gives it; a relation needs both its entities."""
    e = rows.select(job, F.posexplode("entities").alias("position", "e")).select(job, "position", "e.id", "e.text", "e.type")
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    lacking = F.concat_ws(",", *(F.when(blank(c), c) for c in ("id", "text", "type")))
    e = e.withColumn("lacking", lacking)
    found = located(e.filter("lacking = ''"), segments, [job])
    kept = found.filter("start is not null")
    entities = kept.select(job, "id", "text", "type", "segment_id", "start", "end")
    last = kept.groupBy(job, "id").agg(F.max_by(F.struct("start", "end"), "position").alias("s"))
    r = rows.select(job, F.posexplode("relations").alias("position", "r")).select(job, "position", "r.id", "r.source_id", "r.type", "r.target_id")
    for p in ("source", "target"):
        r = r.join(last.select(job, F.col("id").alias(f"{p}_id"), F.col("s.start").alias(f"{p}_start"), F.col("s.end").alias(f"{p}_end")), [job, f"{p}_id"], "left")
    fault = F.when(blank("source_id") | blank("target_id"), "missing_endpoint_id").when(F.col("source_start").isNull() | F.col("target_start").isNull(), "endpoint_rejected")
    r = r.withColumn("fault", fault)
    relations = r.filter("fault is null").select(job, "id", "source_id", "type", "target_id", F.least("source_start", "target_start").alias("start"), F.greatest("source_end", "target_end").alias("end"))
    issues = _issue(e.filter("lacking <> ''"), job, "missing_fields", "position", "lacking").unionByName(_issue(found.filter("start is null"), job, "not_located", "position", "text")).unionByName(_issue(r.filter("fault is not null"), job, F.col("fault"), "position", "id"))
    return entities, relations, issues


# --- negative spans ---------------------------------------------------------------------------------------------------

#: Fixed primes, larger than any number of spans of a chunk: steps of the seeded permutations.
STEPS = [1_000_000_007, 1_000_000_009, 1_000_000_021, 1_000_000_033, 1_000_000_087, 1_000_000_093, 1_000_000_097, 1_000_000_103]


def span_count(n: Column, width: int) -> Column:
    """How many spans of at most so many tokens n tokens have: full rows of ``width`` spans, then a triangle."""
    full = F.greatest(n - width + 1, F.lit(0)).cast("long")
    tip = F.least(n, F.lit(width - 1)).cast("long")
    return full * width + F.floor(tip * (tip + 1) / 2)


def unrank(k: Column, n: Column, width: int) -> Column:
    """struct (start, width) of the k-th span (from 0) by start, then width: in the full rows by division; in the triangle,
    whose rows get shorter by one, by the row at which the spans still to come number as many."""
    full = F.greatest(n - width + 1, F.lit(0)).cast("long")
    behind = span_count(n, width) - k  # this span and those after it: more than row(row - 1) / 2, at most row(row + 1) / 2
    guess = F.ceil((F.sqrt(8.0 * behind + 1.0) - 1.0) / 2.0).cast("long")
    row = F.when(F.floor(guess * (guess + 1) / 2) < behind, guess + 1).when(F.floor(guess * (guess - 1) / 2) >= behind, guess - 1).otherwise(guess)
    in_full = k < full * width
    start = F.when(in_full, F.floor(k / width)).otherwise(n - row)
    size = F.when(in_full, k % width + 1).otherwise(F.floor(row * (row + 1) / 2) - behind + 1)
    return F.struct(start.cast("int").alias("start"), size.cast("int").alias("width"))


def negative_spans(chunks: DataFrame, n: str, positives: str, key: Column, width: int, ratio: float = 4.0, least: int = 8, seed: int = 0) -> DataFrame:
    """chunks with negatives: an array of spans (start, width) of at most so many tokens that aren't among the positives
    (an array of the same structs, each once): ratio times as many as these, ``least`` at least, or all there are. The
    spans are the first of a permutation of all, by a step and an offset that the seed and the chunk's key give; as many
    of it are looked at as are wanted and may be rejected, so work grows with the sample, not with the chunk's square."""
    total = span_count(F.col(n), width)
    held = F.size(F.filter(F.coalesce(F.col(positives), F.array()), lambda p: (p["width"] <= width) & (p["start"] + p["width"] <= F.col(n))))
    wanted = F.least(F.greatest(F.ceil(F.size(F.coalesce(F.col(positives), F.array())) * F.lit(float(ratio))).cast("long"), F.lit(least).cast("long")), total - held)
    h = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("long")
    x = chunks.withColumns({"_total": total, "_wanted": wanted, "_held": held.cast("long"), "_h": h})
    x = x.withColumn("_step", F.get(F.array(*map(F.lit, STEPS)), (F.col("_h") % len(STEPS)).cast("int"))).withColumn("_from", F.floor(F.col("_h") / len(STEPS)) % F.greatest("_total", F.lit(1)))
    ranks = F.when(F.col("_wanted") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("_wanted") + F.col("_held") - 1), lambda j: (F.col("_step").cast("long") * j + F.col("_from")) % F.col("_total"))).otherwise(F.array().cast("array<bigint>"))
    spans = F.transform(ranks, lambda k: unrank(k, F.col(n), width))
    taken = F.coalesce(F.transform(positives, lambda p: p["start"].cast("long") * (width + 1) + p["width"]), F.expr("cast(array() as array<bigint>)"))
    free = bound(taken, lambda held_: F.filter(spans, lambda s: ~F.array_contains(held_, s["start"].cast("long") * (width + 1) + s["width"])))
    return x.withColumn("negatives", F.slice(free, F.lit(1), F.greatest(F.col("_wanted"), F.lit(0)).cast("int"))).drop("_total", "_wanted", "_held", "_h", "_step", "_from")
