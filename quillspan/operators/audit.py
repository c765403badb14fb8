"""Audits: numbering and shards, unions that refuse overlaps, accounting of runs, graph provenance, guards of metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.ids import hash_rank_key, ratio
from quillspan.functions.text import col, norm
from quillspan.sources.scratch import written


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with position from 0 in the order. Sorted by ranges and numbered within them, so no task sees all rows; rows
    of equal order columns come in any order. Rows are written with their range's number, once: Spark joins ranges by
    their size when it reads them, so another plan over the same rows numbers them otherwise."""
    ranged = written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("n")).collect()  # one row for each partition
    before, at = {}, 0
    for r in sorted(sizes, key=lambda r: r["_part"]):
        before[r["_part"]] = at
        at += r["n"]
    base = F.create_map(*(F.lit(x) for pair in before.items() for x in pair)) if before else F.create_map(F.lit(0), F.lit(0))
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.withColumn("position", (nth - 1 + F.element_at(base, F.col("_part"))).cast("bigint")).drop("_part")


def job_slice(rows: DataFrame, order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """The jobs from offset on, no more than limit, in order."""
    p = positions(rows, order).filter(F.col("position") >= offset)
    return p.filter(F.col("position") < offset + limit) if limit is not None else p


def job_shards(rows: DataFrame, order: list[str], workers: int) -> DataFrame:
    """rows with position and shard: equal chunks of ceil(n / workers) in order."""
    p = positions(rows, order)
    n = p.count()
    return p.withColumn("shard", F.floor(F.col("position") / max(1, -(-n // workers))).cast("int"))


def guarded_union(reviewed: DataFrame, batch: DataFrame, key: list[str], split: str, group: str) -> DataFrame:
    """Both tables' rows. ValueError if they share a key or a group's split differs."""
    if reviewed.join(batch.select(*key), key, "left_semi").limit(1).count():
        raise ValueError("the batch repeats reviewed rows")
    both = reviewed.unionByName(batch)
    if both.groupBy(group).agg(F.min(split).alias("a"), F.max(split).alias("b")).filter("a <> b").limit(1).count():
        raise ValueError("a group is in two splits")
    return both


def terminal_accounting(expected: DataFrame, done: DataFrame, failed: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many keys are expected, done, failed, both, neither and not expected."""
    mark = lambda df, c: df.select(*key).distinct().withColumn(c, F.lit(1))
    x = reduce(lambda a, b: a.join(b, key, "full"), (mark(expected, "e"), mark(done, "d"), mark(failed, "f")))
    e, d, f = (F.col(c).isNotNull() for c in "edf")
    return x.agg(F.count_if(e).alias("expected"), F.count_if(d).alias("done"), F.count_if(f).alias("failed"), F.count_if(d & f).alias("both"), F.count_if(e & ~d & ~f).alias("neither"), F.count_if(~e).alias("unexpected"))


def empty_failures(failed: DataFrame, rows: DataFrame, key: list[str], items: list[str]) -> DataFrame:
    """Failed keys whose materialized row isn't empty, or that have none."""
    x = failed.select(*key).distinct().join(rows, key, "left")
    full = reduce(lambda a, b: a | b, (F.coalesce(F.size(c) > 0, F.lit(True)) for c in items))
    return x.filter(full).select(*key)


def same_order(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str], key: str) -> DataFrame:
    """Positions where two tables' keys differ, or that one of them lacks."""
    a = positions(left, order_left).select("position", F.col(key).alias("left"))
    b = positions(right, order_right).select("position", F.col(key).alias("right"))
    return a.join(b, "position", "full").filter(~F.col("left").eqNullSafe(F.col("right")))


def strict_zip(left: DataFrame, right: DataFrame, order_left: list[str], order_right: list[str]) -> DataFrame:
    """Rows of both tables side by side, by position. ValueError unless they are as many."""
    a, b = positions(left, order_left), positions(right, order_right)
    if a.count() != b.count():
        raise ValueError("the tables differ in length")
    return a.join(b, "position")


def graph_faults(concepts: DataFrame, mentions: DataFrame, relations: DataFrame, concept: str = "concept_id", doc: str = "doc_id") -> DataFrame:
    """fault and id: repeated concepts, mentions or relation ends of unknown ones, concepts without a mention, and
    concepts whose documents aren't those of their mentions. concepts: concept, source_documents (sorted)."""
    ids = concepts.select(concept)
    own = mentions.groupBy(concept).agg(F.array_sort(F.collect_set(doc)).alias("_docs"))
    ends = relations.select(F.explode(F.array("source_concept", "target_concept")).alias(concept))
    tell = lambda df, fault: df.select(F.lit(fault).alias("fault"), F.col(concept).alias("id")).distinct()
    joined = concepts.join(own, concept)
    return reduce(
        DataFrame.unionByName,
        [
            tell(ids.groupBy(concept).count().filter("count > 1"), "duplicate_concept"),
            tell(mentions.join(ids, concept, "left_anti"), "orphan_mention"),
            tell(ends.join(ids, concept, "left_anti"), "orphan_relation"),
            tell(ids.join(own, concept, "left_anti"), "concept_without_mention"),
            tell(joined.filter("source_documents <> _docs"), "wrong_provenance"),
        ],
    )


def grounding_rates(entities: DataFrame, sources: DataFrame, key: list[str], by: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """Shares of entities whose text is in their source, as it is and case folded. A source is folded once, and each of
    its distinct texts looked up once."""
    folded = sources.select(*key, source, norm(source).alias("_folded"))
    texts = entities.groupBy(*key, *by, text).agg(F.count("*").alias("_n")).groupBy(*key, *by).agg(F.collect_list(F.struct(F.col(text).alias("t"), norm(text).alias("f"), F.col("_n").alias("n"))).alias("_texts"))
    x = texts.join(folded, key, "left")
    total = lambda hit: F.aggregate(F.filter("_texts", hit), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    own = x.select(*by, total(lambda s: F.lit(True)).alias("e"), total(lambda s: F.contains(F.col(source), s["t"])).alias("x"), total(lambda s: F.contains(F.col("_folded"), s["f"])).alias("f"))
    g = own.groupBy(*by).agg(F.sum("e").alias("entities"), F.sum("x").alias("exact"), F.sum("f").alias("folded"))
    return g.select(*by, "entities", ratio("exact", "entities").alias("exact"), ratio("folded", "entities").alias("folded"))


def coverage(source: DataFrame, covered: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """by, source, covered and missing: distinct keys of each job, and how many of them windows have."""
    have = covered.select(*by, *key).distinct().withColumn("_c", F.lit(1))
    x = source.select(*by, *key).distinct().join(have, [*by, *key], "left").groupBy(*by).agg(F.count("*").alias("source"), F.count("_c").alias("covered"))
    return x.withColumn("missing", F.col("source") - F.col("covered"))


def repeated_texts(entities: DataFrame, by: list[str], text: str, threshold: int) -> DataFrame:
    """by, text and n: texts that one output repeats that often, the mark of a generation loop."""
    return entities.groupBy(*by, norm(text).alias("text")).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)


def bad_metrics(metrics: DataFrame, name: str, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Metrics that aren't finite numbers in the range."""
    v = col(value).cast("double")
    return metrics.filter(v.isNull() | F.isnan(v) | (v < low) | (v > high)).select(name, value)


def is_safe(rates: DataFrame) -> Column:
    """Whether evidence rates allow a release: all relations covered and right, none unsupported or invalid."""
    return (F.col("coverage") == 1) & (F.col("correctness") == 1) & (F.col("unsupported_rate") == 0) & (F.col("invalid_rate") == 0)


def negative_chunks(chunks: DataFrame, positive: str, ratio_: float, seed: int | str, ident: str) -> DataFrame:
    """All chunks with a mention, and ratio times as many without, by hash."""
    wanted = -(-int(round(chunks.filter(positive).count() * ratio_ * 1_000_000)) // 1_000_000)
    rest = chunks.filter(f"NOT ({positive})").withColumn("_key", hash_rank_key(seed, ident)).orderBy("_key", ident).limit(wanted).drop("_key")
    return chunks.filter(positive).unionByName(rest)


def without_overlap(counts: DataFrame, overlapping: DataFrame, key: list[str]) -> DataFrame:
    """Rows of the units that don't occur elsewhere, to aggregate a metric again without them."""
    return counts.join(overlapping.select(*key).distinct(), key, "left_anti")


def quota_choice(rows: DataFrame, cluster: str, category: str, size: str, ident: str, target: int) -> DataFrame:
    """target rows, no two of a cluster: categories take turns, the longest row of each first. The longest row of every
    cluster is a candidate; ties go to the least id."""
    best = rows.withColumn("_n", F.row_number().over(Window.partitionBy(cluster).orderBy(F.desc(size), ident))).filter("_n = 1").drop("_n")
    turn = best.withColumn("turn", F.row_number().over(Window.partitionBy(category).orderBy(F.desc(size), ident)))
    return turn.orderBy("turn", category, ident).limit(target)
