"""Overlapping chunks of tokens, and entities of whole texts from the labels of their chunks.

A model that labels tokens sees at most ``size`` of them, so texts are cut into chunks that share ``stride`` tokens. A
chunk owns the tokens up to the middle of what it shares with its neighbours; near its borders, where it lacks context,
the neighbour's labels count. Owned labels put together are as many as the text has tokens, so an entity of any length
that a border cuts is whole again, and no two chunks report it. Everything is a column expression over arrays, but for
the tokens' places.

Defined results: a null or empty text has no tokens and one chunk without any. A token that is empty or null has a null
label and is passed over. Equal rows are texts of their own as long as the key tells them apart.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import choose_spans
from quillspan.functions.text import bound, norm

SPAN = "struct<start:int,end:int>"
GROUP = 1 << 19  # characters, or tokens, whose arrays are held at once


def place_array(rows: Iterator[Iterable[tuple[int, int]] | None]) -> pa.Array:
    """One array of SPAN structs for each item, null for None; places are held as two lists of numbers, not as objects."""
    starts, ends, borders, gone = array("i"), array("i"), array("i", [0]), []
    for places in rows:
        for a, b in places or ():
            starts.append(a)
            ends.append(b)
        borders.append(len(starts))
        gone.append(places is None)
    number = lambda x: pa.array(np.frombuffer(x, np.int32) if len(x) else [], pa.int32())
    values = pa.StructArray.from_arrays([number(starts), number(ends)], ["start", "end"])
    return pa.ListArray.from_arrays(number(borders), values, mask=pa.array(gone, pa.bool_()))


def token_places(text: Column | str, pattern: str = r"\S+") -> Column:
    """Places of the pattern's matches, as an array of structs start and end."""
    found = re.compile(pattern)

    @F.arrow_udf(f"array<{SPAN}>")
    def run(texts: pa.Array) -> pa.Array:
        return place_array((m.span() for m in found.finditer(t.as_py() or "")) for t in texts)

    return run(text)


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes come to about GROUP, which bounds what is held at once beside a batch."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        stop = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + GROUP, side="right"))
        yield first, max(stop, first + 1)
        first = max(stop, first + 1)


def _lists(x: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The borders and the values of a list array."""
    return x.offsets.to_numpy(), x.values


def _ints(x: pa.Array, field: str, missing: int) -> np.ndarray:
    return pc.fill_null(pc.struct_field(x, field).cast(pa.int64()), missing).to_numpy(zero_copy_only=False)


def _word_places(texts: pa.Array, separators: str) -> pa.Array:
    marks = [ord(c) for c in separators]
    values = pc.fill_null(texts, "")
    sizes = pc.utf8_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    starts, ends, counts = [], [], []
    for first, stop in _groups(sizes):
        chars = np.frombuffer(separators[0].join(values[first:stop].to_pylist()).encode("utf-32-le"), np.uint32)
        gap = np.zeros(len(chars), bool)
        for m in marks:
            gap |= chars == m
        breaks = np.flatnonzero(gap)
        a, b = np.append(0, breaks + 1), np.append(breaks, len(chars))
        held = b > a
        a, b = a[held], b[held]
        at = np.cumsum(sizes[first:stop] + 1) - sizes[first:stop] - 1  # where each text begins
        own = np.searchsorted(at, a, side="right") - 1
        starts.append((a - at[own]).astype(np.int32))
        ends.append((b - at[own]).astype(np.int32))
        counts.append(np.bincount(own, minlength=stop - first))
    joined = lambda x: np.concatenate(x) if x else np.zeros(0, np.int32)
    borders = np.append(0, np.cumsum(joined(counts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(borders), pa.StructArray.from_arrays([pa.array(joined(starts)), pa.array(joined(ends))], ["start", "end"]))


def word_places(text: Column | str, separators: str = " \n") -> Column:
    """token_places() of the words between these characters: texts are numbers in an array, many at once."""

    @F.arrow_udf(f"array<{SPAN}>")
    def run(texts: pa.Array) -> pa.Array:
        return _word_places(texts, separators)

    return run(text)


def _owners(row: np.ndarray, ts: np.ndarray, te: np.ndarray, span_row: np.ndarray, ss: np.ndarray, se: np.ndarray) -> np.ndarray:
    """For each token the first span of its row that holds it, or -1. Tokens of a row whose starts and ends don't fall are
    held by a span as one range of them; other rows are compared with all their spans."""
    owner = np.full(len(ts), -1, np.int64)
    if not len(ts) or not len(ss):
        return owner
    same = row[1:] == row[:-1]
    odd = np.unique(np.append(row[1:][same & ((ts[1:] < ts[:-1]) | (te[1:] < te[:-1]))], row[ts < 0]))
    big = int(max(te.max(), ts.max(), 0)) + 3
    lo = np.searchsorted(ts + row * big, np.clip(ss, 0, big - 1) + span_row * big, side="left")
    hi = np.searchsorted(te + row * big, np.clip(se, -1, big - 2) + span_row * big, side="right")
    if len(odd):
        hi = np.where(np.isin(span_row, odd), lo, hi)
    k = np.flatnonzero(hi > lo)[::-1]  # the first span is put down last
    n = hi[k] - lo[k]
    owner[np.repeat(lo[k] - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.repeat(k, n)
    for r in odd.tolist():
        mine, spans = np.flatnonzero(row == r), np.flatnonzero(span_row == r)
        for k in spans[::-1].tolist():
            owner[mine[(ts[mine] >= ss[k]) & (te[mine] <= se[k])]] = k
    return owner


def _token_labels(places: pa.Array, named: pa.Array) -> pa.Array:
    t_at, t = _lists(places)
    s_at, s = _lists(named)
    kinds = pc.struct_field(s, "type").dictionary_encode()
    kind = pc.fill_null(kinds.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    names = pa.array(["O", *(b + k for k in kinds.dictionary.to_pylist() for b in ("B-", "I-"))], pa.string())
    unknown = named.is_null().to_numpy(zero_copy_only=False)
    ts, te = _ints(t, "start", 0), _ints(t, "end", 0)
    ss, se = _ints(s, "start", 1 << 40), _ints(s, "end", -1)
    codes = []
    for first, stop in _groups(np.diff(t_at)):
        a, b, c, d = t_at[first], t_at[stop], s_at[first], s_at[stop]
        row = np.repeat(np.arange(stop - first), np.diff(t_at[first : stop + 1]))
        span_row = np.repeat(np.arange(stop - first), np.diff(s_at[first : stop + 1]))
        own = _owners(row, ts[a:b], te[a:b], span_row, ss[c:d], se[c:d])
        code, hit = np.zeros(b - a, np.int64), own >= 0
        k = own[hit] + c
        code[hit] = np.where(kind[k] < 0, -1, 1 + 2 * kind[k] + (ts[a:b][hit] != ss[k]))
        code[(te[a:b] <= ts[a:b]) | unknown[first:stop][row]] = -1
        codes.append(code.astype(np.int32))
    code = np.concatenate(codes) if codes else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array((t_at - t_at[0]).astype(np.int32)), names.take(pa.array(code, mask=code < 0)), mask=places.is_null())


def token_labels(tokens: Column | str, spans: Column | str) -> Column:
    """decode.bio_label() of all of a text's tokens (start, end) and spans (start, end, type), without comparing each with
    each: null for a token that is empty or null, and for all if the spans are null."""

    @F.arrow_udf("array<string>")
    def run(places: pa.Array, named: pa.Array) -> pa.Array:
        return _token_labels(places, named)

    return run(tokens, spans)


def word_labels(docs: DataFrame, text: str, spans: str, labels: str, separators: str = " \n") -> DataFrame:
    """docs with token_labels() of the text's word_places(), which don't leave the worker, in place of text and spans."""
    keep = [f for f in docs.schema.fields if f.name not in (text, spans, labels)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = _token_labels(_word_places(b.column(text), separators), b.column(spans))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), found], names=[*(f.name for f in keep), labels])

    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep), f"`{labels}` array<string>"]))


def subword_places(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """docs with the ids and places of a tokenizer file's tokens: an array of structs start, end, id."""
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != tokens]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        for f in frames:
            got = tok.encode_batch([t or "" for t in f[text]], add_special_tokens=False)
            yield f.assign(**{tokens: [[{"start": a, "end": b, "id": i} for (a, b), i in zip(g.offsets, g.ids, strict=True)] for g in got]})

    return docs.drop(tokens).mapInPandas(run, ", ".join([*fields, f"`{tokens}` array<struct<start:int,end:int,id:int>>"]))


def overlapping_chunks(docs: DataFrame, tokens: str, size: int, stride: int) -> DataFrame:
    """docs with chunk (from 0), first (its first token's number), its own tokens in place of all, and own_from and
    own_end, the tokens, counted in the chunk, that it owns."""
    if not 0 <= stride < size:
        raise ValueError("stride must be in [0, size)")
    step, n = size - stride, F.col("_n")
    x = docs.withColumn("_n", F.size(F.coalesce(F.col(tokens), F.array()))).withColumn("_last", F.greatest(F.ceil((n - size) / step).cast("int"), F.lit(0)))
    x = x.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("_last")))).withColumn("first", F.col("chunk") * step)
    own_from = F.when(F.col("chunk") == 0, 0).otherwise(stride // 2)
    own_end = F.when(F.col("chunk") == F.col("_last"), n - F.col("first")).otherwise(step + stride // 2)
    return x.withColumn(tokens, F.slice(tokens, F.col("first") + 1, F.lit(size))).withColumns({"own_from": own_from, "own_end": own_end}).drop("_n", "_last")


def labelled(chunks: DataFrame, tokens: str, spans: str) -> DataFrame:
    """chunks with labels, by the spans (start, end, type) that hold their tokens, mended()."""
    return mended(chunks.withColumn("_raw", token_labels(tokens, spans)), "_raw").drop("_raw")


def mended(chunks: DataFrame, raw: str) -> DataFrame:
    """chunks with labels, and repaired, how many of the raw ones were I- without one of its type before in this chunk and
    became B-: a chunk can't go on with what another began."""
    kind = lambda label: F.substring(label, 3, 1000)

    def step(acc: Column, label: Column) -> Column:
        alone = label.startswith("I-") & (kind(label) != acc["kind"])
        out = F.when(alone, F.concat(F.lit("B-"), kind(label))).otherwise(label)
        last = F.when(label.isNull(), acc["kind"]).when(label == "O", "").otherwise(kind(label))
        return F.struct(F.concat(acc["labels"], F.array(out)).alias("labels"), last.alias("kind"))

    def count(seen: Column) -> Column:
        return F.size(F.filter(seen, lambda label, i: label.startswith("I-") & (F.coalesce(kind(F.get(seen, i - 1)), F.lit("")) != kind(label))))

    start = F.struct(F.array().cast("array<string>").alias("labels"), F.lit("").alias("kind"))
    labels = F.aggregate(raw, start, step)["labels"]
    return chunks.withColumns({"labels": labels, "repaired": bound(F.filter(raw, lambda x: x.isNotNull()), count)})


def stitched(chunks: DataFrame, by: list[str], *columns: str) -> DataFrame:
    """by and the named array columns of whole texts: what each chunk owns, in order. A text's chunks are one group, as
    large as the text."""
    own = [F.slice(c, F.col("own_from") + 1, F.greatest(F.col("own_end") - F.col("own_from"), F.lit(0))).alias(c) for c in columns]
    parts = F.array_sort(F.collect_list(F.struct("chunk", *own)))
    whole = chunks.groupBy(*by).agg(parts.alias("_parts"))
    return whole.select(*by, *(F.flatten(F.transform("_parts", lambda p: p[c])).alias(c) for c in columns))  # noqa: B023


def _runs(z: pa.Array, row: np.ndarray, gap: int) -> tuple[np.ndarray, list[pa.Array]]:
    """runs() of the items (t, l, s) of many rows: the rows' numbers, and start, end, type and score."""
    token, label, score = (pc.struct_field(z, f) for f in "tls")
    ts, te = _ints(token, "start", 0), _ints(token, "end", 0)
    coded = label.dictionary_encode()
    code = pc.fill_null(coded.indices, -1).to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_pylist()
    kinds = {n[2:]: k for k, n in enumerate(names)}
    kind_of, is_o, is_i = np.array([kinds[n[2:]] for n in names], int), np.array([n == "O" for n in names], bool), np.array([n.startswith("I-") for n in names], bool)
    seen = np.flatnonzero((te > ts) & (code >= 0))
    if not len(seen):
        return seen, [pa.array([], pa.int32()), pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], score.type)]
    ts, te, code, row = ts[seen], te[seen], code[seen], row[seen]
    inside, kind = ~is_o[code], kind_of[code]
    goes = np.append(False, (row[1:] == row[:-1]) & inside[:-1] & is_i[code[1:]] & (kind[1:] == kind[:-1]) & (ts[1:] <= te[:-1] + gap))
    begins, ends = np.flatnonzero(inside & ~goes), np.flatnonzero(inside & ~np.append(goes[1:], False))
    value = np.append(pc.fill_null(score.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)[seen], np.nan)
    given = np.append(score.is_valid().to_numpy(zero_copy_only=False)[seen], False)
    cuts = np.stack([begins, ends + 1], axis=1).ravel()
    least = np.fmin.reduceat(value, cuts)[::2] if len(cuts) else np.zeros(0)
    some = np.add.reduceat(given.astype(int), cuts)[::2] if len(cuts) else np.zeros(0, int)
    types = pa.array([n[2:] for n in names], pa.string()).take(pa.array(code[begins]))
    return row[begins], [pa.array(ts[begins].astype(np.int32)), pa.array(te[ends].astype(np.int32)), types, pa.array(least, pa.float64(), mask=some == 0).cast(score.type)]


def runs(texts: DataFrame, tokens: str = "tokens", labels: str = "labels", scores: str = "scores", gap: int = 1) -> DataFrame:
    """texts' other columns with start, end, type and score of each run of labels of one type that no B- and no gap of
    more characters interrupts; the score is the least of the run's. Begins and ends of runs are found by themselves, in
    the arrays of many texts at once: the k-th begin and the k-th end belong together."""
    keep = [f for f in texts.schema.fields if f.name not in (tokens, labels, scores)]
    names = [f.name for f in keep]
    x = texts.select(*names, F.arrays_zip(F.col(tokens).alias("t"), F.col(labels).alias("l"), F.col(scores).alias("s")).alias("_z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, z = _lists(b.column("_z"))
            for first, stop in _groups(np.diff(at)):
                row, found = _runs(z[at[first] : at[stop]], np.repeat(np.arange(first, stop), np.diff(at[first : stop + 1])), gap)
                yield pa.RecordBatch.from_arrays([*(b.column(n).take(pa.array(row, pa.int64())) for n in names), *found], names=[*names, "start", "end", "type", "score"])

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return x.mapInArrow(run, f"{kinds}start int, end int, type string, score {texts.schema[scores].dataType.elementType.simpleString()}")


def consolidated(spans: DataFrame, by: list[str], mode: str = "confidence") -> DataFrame:
    """by, start, end, type, score: of spans of one text, from chunks that report some twice or in part, those that
    choose_spans() keeps. For models whose chunks give spans, not labels. One text's spans are one row, and many texts
    one batch."""
    distinct = spans.groupBy(*by, "start", "end", "type").agg(F.max("score").cast("double").alias("score"))
    own = distinct.groupBy(*by).agg(F.collect_list(F.struct("start", "end", "type", "score")).alias("_s"))
    names = ["start", "end", "type", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, z = _lists(b.column("_s"))
            columns = [pc.struct_field(z, n).to_pylist() for n in names]
            columns[3] = [float("nan") if x is None else x for x in columns[3]]
            kept, row = [], []
            for k, (first, stop) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                got = choose_spans(list(zip(*(c[first:stop] for c in columns), strict=True)), mode)
                kept += got
                row += [k] * len(got)
            parts = list(zip(*kept, strict=True)) or [()] * 4
            data = [pa.array(p, t) for p, t in zip(parts, (pa.int32(), pa.int32(), pa.string(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(row, pa.int64())) for c in by), *data], names=[*by, *names])

    fields = ", ".join(f"`{c}` {spans.schema[c].dataType.simpleString()}" for c in by)
    return own.mapInArrow(run, f"{fields}, start int, end int, type string, score double")


def entity_rows(spans: DataFrame, by: list[str], text: str = "text", offset: Column | None = None, created_by: str = "token-classifier") -> DataFrame:
    """Annotation rows of spans in a text: without white space at their ends, the first of each (name, type) of a job,
    numbered E1, E2, ... by place; evidence carries places in the document, the text's own place (offset) added."""
    raw = F.col(text).substr(F.col("start") + 1, F.col("end") - F.col("start"))
    left = F.regexp_replace(raw, r"(?U)^\s+", "")
    x = spans.withColumn("_left", left).withColumn("_text", F.regexp_replace("_left", r"(?U)\s+$", ""))
    x = x.withColumn("start", F.col("end") - F.length("_left")).withColumn("end", F.col("start") + F.length("_text")).withColumn("_name", norm("_text")).filter("_name <> ''")
    once = x.withColumn("_k", F.row_number().over(Window.partitionBy(*by, "_name", "type").orderBy("start", "end"))).filter("_k = 1")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("start", "end", "type"))
    at = offset if offset is not None else F.lit(0)
    evidence = F.array(F.struct(F.col("_text").alias("text"), (F.col("start") + at).alias("start"), (F.col("end") + at).alias("end")))
    return once.select(*by, F.concat(F.lit("E"), number).alias("id"), F.col("_text").alias("text"), "type", "start", "end", evidence.alias("evidence"), F.round("score", 6).alias("confidence"), F.lit(created_by).alias("created_by"))
