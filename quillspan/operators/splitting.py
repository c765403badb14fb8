"""Deterministic samples and splits that keep groups together."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.ids import hash_rank_key
from quillspan.sources.scratch import written


def ranked(rows: DataFrame, by: list[str], seed: int | str, ident: str) -> DataFrame:
    """Adds rank (from 1) in the group by seeded hash, and n, the group's size."""
    rows = rows.withColumn("_key", hash_rank_key(seed, ident))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return rows.withColumn("rank", F.row_number().over(w.orderBy("_key", ident))).withColumn("n", F.count("*").over(w)).drop("_key")


def hash_top(rows: DataFrame, k: int, seed: int | str, ident: str) -> DataFrame:
    """A sample of k rows by seeded hash; a distributed top-k without a global sort."""
    return rows.withColumn("_key", hash_rank_key(seed, ident)).orderBy("_key", ident).limit(k).drop("_key")


def split_15_15_70(docs: DataFrame, group: str, ident: str, seed: int | str = 42) -> DataFrame:
    """Adds split: in each group the first 15 % by hash are test, the next validation, at least one each. Group sizes
    come from partial aggregates and ranks from hash parts of a group, so no group is one task."""
    parts = 64
    keyed = docs.withColumn("_key", hash_rank_key(seed, ident)).withColumn("_part", F.floor(F.conv(F.substring("_key", 1, 4), 16, 10).cast("int") / (65536 // parts)))
    sizes = keyed.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_total", F.sum("_n").over(w)).drop("_n")
    x = keyed.join(sizes, [group, "_part"]).withColumn("_rank", F.row_number().over(Window.partitionBy(group, "_part").orderBy("_key", ident)) + F.col("_before"))
    k = F.greatest(F.lit(1), F.bround(F.col("_total") * 0.15))
    split = F.when(F.col("_rank") <= k, "test").when(F.col("_rank") <= 2 * k, "validation").otherwise("train")
    return x.withColumn("split", split).select(*docs.columns, "split")


def median_picks(rows: DataFrame, by: list[str], size: str, ident: str, per_group: int = 2, least: int = 2000) -> DataFrame:
    """Rows at evenly spread places of the group's order by size; of rows with the least size if there are any."""
    w = Window.partitionBy(*by)
    x = rows.withColumn("_big", F.col(size) >= least).withColumn("_any", F.max(F.col(size) >= least).over(w)).filter("_big OR NOT _any")
    x = x.withColumn("_i", F.row_number().over(w.orderBy(size, ident)) - 1).withColumn("_n", F.count("*").over(w))
    places = F.array(F.floor(F.col("_n") / 2)) if per_group == 1 else F.array(*(F.bround(F.lit(k + 1) * (F.col("_n") - 1) / F.lit(per_group + 1)).cast("bigint") for k in range(per_group)))
    return x.filter(F.array_contains(places, F.col("_i").cast("bigint"))).select(*rows.columns)


def label_cover(rows: DataFrame, labels: str, ident: str, limit: int, seed: int | str = 42) -> DataFrame:
    """At most limit rows: for each label the first row by hash, then the first of all others. labels: an array."""
    keyed = rows.withColumn("_key", hash_rank_key(seed, ident))
    cover = keyed.select(ident, "_key", F.explode(labels).alias("_l")).groupBy("_l").agg(F.min_by(F.struct("_key", ident), "_key").alias("m")).select(F.col(f"m.{ident}").alias(ident)).distinct().withColumn("_c", F.lit(0))
    return keyed.join(cover, ident, "left").orderBy(F.coalesce("_c", F.lit(1)), "_key").limit(limit).drop("_key", "_c")


def dev_from_train(rows: DataFrame, ident: str, fraction: float = 0.1, seed: int | str = 42) -> DataFrame:
    """Adds split: dev for the first n x fraction (rounded down) by hash, else train."""
    r = ranked(rows, [], seed, ident)
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(F.col("n") * fraction), "dev").otherwise("train")).drop("rank", "n")


def leakage(rows: DataFrame, docs: str, splits: DataFrame) -> DataFrame:
    """Rows that name a document outside the training split, with these documents. docs: an array of ids."""
    other = splits.filter("split <> 'train'").select(F.col("doc_id").alias("_d"))
    named = rows.withColumn("_d", F.explode(docs)).join(other, "_d")
    return named.groupBy(*(c for c in rows.columns if c != docs)).agg(F.array_sort(F.collect_set("_d")).alias("outside"))


def negatives(pairs: DataFrame, by: list[str], positive: str, kind: Column, quota: dict[str, float], per_positive: int, seed: int | str, ident: str) -> DataFrame:
    """The positives and, for each, at most per_positive negatives of its group: of each kind its quota by hash."""
    p = pairs.filter(positive)
    n_pos = p.groupBy(*by).agg((F.count("*") * per_positive).alias("_limit"))
    neg = pairs.filter(f"NOT ({positive})").withColumn("kind", kind).withColumn("_key", hash_rank_key(seed, ident)).join(n_pos, by)
    neg = neg.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "kind").orderBy("_key")))
    room = F.lit(0.0)
    for k, share in quota.items():
        room = F.when(F.col("kind") == k, F.ceil(F.col("_limit") * share)).otherwise(room)
    return p.withColumn("kind", F.lit("positive")).unionByName(neg.filter(F.col("_r") <= room).drop("_key", "_limit", "_r"))


def _tie(*parts: object) -> str:
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


#: A class's clusters are given out in so many steps at most, each as many clusters as the class has over this.
STEPS = 2000
#: Clusters of one class that are ranked by one task, about.
RANKED = 1_000_000


def plan_allocation(classes: pd.DataFrame, targets: dict[str, int], n_dimensions: int) -> pd.DataFrame:
    """class, first and end rank, split, and the class's step. classes: class, profile (pairs of kind and count), n (its clusters). The largest
    clusters first, of equal ones by class; a step's clusters go where the split lacks most of their kinds of documents,
    of equal ones where most room is left, then by hash. ValueError if a cluster fits nowhere."""
    names = list(targets)
    room = np.array([targets[s] for s in names], float)
    total: Counter[str] = Counter()
    for profile, n in zip(classes["profile"], classes["n"], strict=True):
        total.update({k: c * int(n) for k, c in profile})
    lacks = [{k: share * c for k, c in total.items()} for share in room / room.sum()]
    docs = [sum(c for _, c in p) / n_dimensions for p in classes["profile"]]
    out = []
    for k in sorted(range(len(classes)), key=lambda k: (-docs[k], classes["class"].iloc[k])):
        name, profile, left, rank = classes["class"].iloc[k], list(classes["profile"].iloc[k]), int(classes["n"].iloc[k]), 0
        step = -(-left // STEPS)
        while left:
            open_ = [s for s in range(len(names)) if room[s] >= docs[k]]
            if not open_:
                raise ValueError(f"clusters of {docs[k]:.0f} documents fit into no split")
            need = {s: sum(max(lacks[s][x], 0.0) for x, _ in profile) for s in open_}
            best = max(open_, key=lambda s: (round(need[s], 9), room[s], _tie(name, rank, names[s])))
            n = min(step, left, int(room[best] // docs[k]) if docs[k] else left)
            room[best] -= n * docs[k]
            for x, c in profile:
                lacks[best][x] -= n * c
            if out and out[-1][0] == name and out[-1][3] == names[best]:
                out[-1] = (name, out[-1][1], rank + n, names[best], step)
            else:
                out.append((name, rank, rank + n, names[best], step))
            rank, left = rank + n, left - n
    return pd.DataFrame(out, columns=["class", "first", "end", "split", "step"])


def allocate_clusters(clusters: DataFrame, targets: dict[str, int], dimensions: list[str]) -> DataFrame:
    """cluster and split: whole clusters are dealt to the splits by plan_allocation(). clusters: cluster and one row per
    document with the dimensions.

    Clusters with equal counts of every kind (a dimension's value) are one class, and each choice depends on all before,
    so one task plans over classes: their number grows with how clusters differ, not with clusters or documents. A
    cluster's place is its rank by hash in its class; ranks of large classes are made in salted parts. Profiles, classes and
    the plan are made once and written, as several branches read them."""
    kinds = F.explode(F.array(*(F.concat(F.lit(f"{d}="), F.coalesce(F.col(d).cast("string"), F.lit("\0"))) for d in dimensions)))
    counts = clusters.select("cluster", kinds.alias("kind")).groupBy("cluster", "kind").agg(F.count("*").alias("n"))
    profiles = counts.groupBy("cluster").agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("profile")).withColumn("class", F.sha2(F.to_json("profile"), 256))
    profiles = written(profiles, "cluster-profiles")
    classes = written(profiles.groupBy("class").agg(F.first("profile").alias("profile"), F.count("*").alias("n")), "cluster-classes")

    def run(f: pd.DataFrame) -> pd.DataFrame:
        pairs = [[(p["kind"], int(p["n"])) for p in profile] for profile in f["profile"]]
        return plan_allocation(f.assign(profile=pairs), targets, len(dimensions))

    plan = classes.withColumn("_g", F.lit(0)).groupBy("_g").applyInPandas(lambda f: run(f.drop(columns="_g")), "class string, first bigint, end bigint, split string, step bigint")
    plan = written(plan, "cluster-plan")
    most = classes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    salted = profiles.select("cluster", "class", F.pmod(F.xxhash64("cluster"), F.lit(max(1, -(-most // RANKED)))).alias("_part"))
    before = Window.partitionBy("class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = salted.groupBy("class", "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inner = F.row_number().over(Window.partitionBy("class", "_part").orderBy(F.xxhash64("cluster"), "cluster")) - 1
    ranked_ = salted.withColumn("_rank", inner).join(bases, ["class", "_part"]).withColumn("_rank", F.col("_rank") + F.col("_base"))
    steps = plan.groupBy("class").agg(F.first("step").alias("step"))
    blocks = plan.withColumn("_block", F.explode(F.expr("sequence(first div step, (end - 1) div step)"))).drop("step")  # a few ranges each
    placed = ranked_.join(steps, "class").withColumn("_block", F.expr("_rank div step")).join(blocks, ["class", "_block"])
    return placed.filter("_rank >= first and _rank < end").select("cluster", "split")
