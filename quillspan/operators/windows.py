"""Windows over segments: fixed, budgeted and semantic parts. Parts of one text need only that text, so nothing is
shuffled for them; windows over a document's segments group by document."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.spans import focus, semantic_parts


def split_fixed(segments: DataFrame, size: int = 1500, overlap: int = 150, text: str = "text") -> DataFrame:
    """segments with part (from 1), local_start, local_end and the part's text; native."""
    n, step = F.length(text), size - overlap
    starts = F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step)))
    x = segments.select("*", F.posexplode(starts).alias("_k", "local_start"))
    x = x.withColumn("part", F.col("_k") + 1).withColumn("local_end", F.least(F.col("local_start") + size, n))
    return x.withColumn("part_text", F.substring(F.col(text), F.col("local_start") + 1, F.lit(size))).drop("_k")


def split_semantic(segments: DataFrame, size: int = 800, overlap: int = 160, text: str = "text", protect: str | None = None) -> DataFrame:
    """segments with part, local_start, local_end, part_text; parts end at sentences and never inside the protected
    spans (an array column of structs start, end)."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in enumerate(f[text]):
                spans = [(p["start"], p["end"]) for p in f[protect].iloc[i]] if protect else ()
                rows += [(i, k, a, b, t[a:b]) for k, (a, b) in enumerate(semantic_parts(t or "", size, overlap, spans), 1)]
            at = [r[0] for r in rows]
            out = f.iloc[at].reset_index(drop=True)
            for n, name in enumerate(("part", "local_start", "local_end", "part_text"), 1):
                out[name] = [r[n] for r in rows]
            yield out

    return segments.mapInPandas(run, f"{fields}, part int, local_start int, local_end int, part_text string")


def focused(rows: DataFrame, needles: str, size: int = 480, text: str = "text") -> DataFrame:
    """rows with local_start and local_end of a crop around the needles (an array column)."""

    @F.pandas_udf("struct<local_start:int,local_end:int>")
    def crop(texts: pd.Series, wanted: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([focus(t or "", list(n) if n is not None else [], size) for t, n in zip(texts, wanted, strict=True)], columns=["local_start", "local_end"])

    return rows.withColumn("_c", crop(text, needles)).select(*rows.columns, "_c.local_start", "_c.local_end")


def budget_ranges(costs: np.ndarray, budgets: Sequence[int], overlap: int = 1) -> list[tuple[int, int]]:
    """Half-open ranges of segments, each as long as every cost's sum stays in its budget (one segment at least), the
    next one beginning so many segments before a range's end. costs: one row for each budget. Where each range could end
    is found for all starts at once, in the running sums."""
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    n = costs.shape[1]
    reach = np.full(n, n)
    for row, most in zip(costs, budgets, strict=True):
        total = np.concatenate([[0], np.cumsum(row)])
        reach = np.minimum(reach, np.searchsorted(total, total[:-1] + most, side="right") - 1)
    reach = np.maximum(reach, np.arange(1, n + 1)).tolist()
    out, at = [], 0
    while at is not None and n:
        out.append((at, reach[at]))
        at = max(at + 1, reach[at] - overlap) if reach[at] < n else None
    return out


def budgeted_windows(segments: DataFrame, by: str, order: str, budgets: dict[str, int], overlap: int = 1) -> DataFrame:
    """by, window (from 1), first and end position, oversize: as many segments as all budgets (by cost column, none of
    them negative) allow, one at least; oversize if that one is beyond a budget by itself. Null costs are 0. One document's
    segments are one group."""
    names = list(budgets)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        costs = f.sort_values(order)[names].fillna(0).to_numpy().T
        ranges = budget_ranges(costs, list(budgets.values()), overlap)
        over = [b - a == 1 and any(costs[k, a] > budgets[c] for k, c in enumerate(names)) for a, b in ranges]
        return pd.DataFrame({by: [f[by].iloc[0]] * len(ranges), "window": range(1, len(ranges) + 1), "first": [a for a, _ in ranges], "end": [b for _, b in ranges], "oversize": over})

    return segments.select(by, order, *names).groupBy(by).applyInPandas(run, f"`{by}` {segments.schema[by].dataType.simpleString()}, window int, first int, end int, oversize boolean")


def segment_windows(segments: DataFrame, by: str, order: str, cost: str, budget: int, overlap: int = 1) -> DataFrame:
    """by, window (from 1), first and end position: budgeted_windows() of one cost."""
    return budgeted_windows(segments, by, order, {cost: budget}, overlap).drop("oversize")


def rescue_windows(relations: DataFrame, segments: DataFrame, by: list[str], budget: int, cost: str = "cost", crop: int | None = None, overhead: int = 0) -> DataFrame:
    """by, id, status, indices, tokens: for each relation the cheapest set of segments that holds its source, its target
    and some evidence: fewest segments, then fewest tokens (the overhead and all costs), then the first by indices.

    relations: by, id, source_text, source_segment, target_text, target_segment, evidence (array of text, segment_id).
    segments: by, index, segment_id (several parts may have one), text, and their cost, unless crop is given: then a
    segment counts as the words of a crop of about so many characters around what it is chosen for. An end is held where
    its segment has its text; evidence where its segment has its quote, or in all parts of it if none has. A relation
    without any evidence segment needs its ends only. status: ok, endpoint_absent, or over_budget.

    A segment may serve for source, target and evidence together, for two or one of them. Of each such purpose only the
    three cheapest segments can be in the best set, since at most two others are taken; so sets are put together from 21
    candidates at most, however many segments there are."""
    keys = [*by, "id"]
    seg = segments.select(*by, "index", "segment_id", F.col("text").alias("_seg_text"), F.col(cost if crop is None else "index").alias("_cost"))
    ends = [relations.select(*keys, F.lit(bit).alias("bit"), F.col(f"{p}_segment").alias("segment_id"), F.col(f"{p}_text").alias("needle")) for bit, p in ((1, "source"), (2, "target"))]
    held = ends[0].unionByName(ends[1]).join(seg, [*by, "segment_id"]).filter((F.col("needle") != "") & F.expr("contains(_seg_text, needle)"))
    quotes = relations.select(*keys, F.posexplode("evidence").alias("_e", "_ev")).select(*keys, "_e", F.lit(4).alias("bit"), F.col("_ev.segment_id").alias("segment_id"), F.coalesce("_ev.text", F.lit("")).alias("needle"))
    quoted = quotes.join(seg, [*by, "segment_id"]).withColumn("_q", (F.col("needle") != "") & F.expr("contains(_seg_text, needle)"))
    quoted = quoted.withColumn("_any", F.max("_q").over(Window.partitionBy(*keys, "_e"))).filter("_q or not _any").drop("_q", "_any", "_e")
    per = held.unionByName(quoted).groupBy(*keys, "index").agg(F.bit_or("bit").alias("bits"), F.first("_seg_text").alias("_seg_text"), F.first("_cost").alias("_cost"), F.collect_set(F.struct("bit", "needle")).alias("_needles"))
    purposes = F.filter(F.array(*(F.lit(k) for k in range(1, 8))), lambda k: k.bitwiseAND(F.col("bits")) == k)
    x = per.withColumn("purpose", F.explode(purposes))
    if crop is not None:
        wanted = F.transform(F.filter("_needles", lambda e: e["bit"].bitwiseAND(F.col("purpose")) > 0), lambda e: e["needle"])
        x = focused(x.withColumn("_wanted", wanted), "_wanted", crop, "_seg_text")
        x = x.withColumn("_cost", F.size(F.filter(F.split(F.col("_seg_text").substr(F.col("local_start") + 1, F.col("local_end") - F.col("local_start")), r"\s+"), lambda w: w != "")))
    cheap = x.select(*keys, "purpose", F.col("_cost").cast("long").alias("tokens"), "index").withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "purpose").orderBy("tokens", "index"))).filter("_k <= 3")
    best = cheap.groupBy(*keys).agg(F.collect_list(F.struct("purpose", "tokens", "index")).alias("_best"))
    rows = relations.select(*keys).join(best, keys, "left").withColumn("_best", F.coalesce("_best", F.expr("cast(array() as array<struct<purpose:int,tokens:bigint,index:int>>)")))
    of = lambda k: F.filter("_best", lambda b: b["purpose"] == k)

    def sets(*parts: int) -> Column:
        """All sets of one segment for each purpose, no segment twice."""
        out = F.transform(of(parts[0]), lambda b: F.struct(b["tokens"].alias("tokens"), F.array(b["index"]).alias("indices")))
        for k in parts[1:]:
            out = F.flatten(F.transform(out, lambda s: F.transform(F.filter(of(k), lambda b: ~F.array_contains(s["indices"], b["index"])), lambda b: F.struct((s["tokens"] + b["tokens"]).alias("tokens"), F.concat(s["indices"], F.array(b["index"])).alias("indices")))))  # noqa: B023
        return F.transform(out, lambda s: F.struct(F.size(s["indices"]).alias("n"), (s["tokens"] + overhead).alias("tokens"), F.array_sort(s["indices"]).alias("indices")))

    evident = F.size(F.filter("_best", lambda b: b["purpose"].bitwiseAND(F.lit(4)) > 0)) > 0
    whole = F.when(evident, F.concat(sets(7), sets(3, 4), sets(5, 2), sets(6, 1), sets(1, 2, 4))).otherwise(F.concat(sets(3), sets(1, 2)))
    chosen = rows.withColumn("_absent", (F.size(of(1)) == 0) | (F.size(of(2)) == 0)).withColumn("_c", F.array_min(F.filter(whole, lambda s: s["tokens"] <= budget)))
    status = F.when(F.col("_absent"), "endpoint_absent").when(F.col("_c").isNull(), "over_budget").otherwise("ok")
    return chosen.select(*keys, status.alias("status"), F.col("_c.indices").alias("indices"), F.col("_c.tokens").alias("tokens"))


def window_gold(entities: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """Entities of a job that lie in its windows: an equi-join on the job with a range condition."""
    return entities.join(windows, by).filter("start >= window_start AND end <= window_end")

