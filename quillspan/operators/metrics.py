"""Evaluation: counts of gold, predicted and correct keys, rates, error classes, distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.ids import f1, ratio
from quillspan.functions.text import col


def key_counts(gold: DataFrame, predicted: DataFrame, unit: list[str], key: list[str]) -> DataFrame:
    """unit, gold, predicted, correct over distinct keys. One shuffle: both sides are grouped together by unit and key."""
    flags = gold.select(*unit, *key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*unit, *key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    per_key = flags.groupBy(*unit, *key).agg(F.max("g").alias("g"), F.max("p").alias("p"))
    return per_key.groupBy(*unit).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.col("g") * F.col("p")).alias("correct"))


def multiset_counts(gold: DataFrame, predicted: DataFrame, unit: list[str], key: list[str]) -> DataFrame:
    """The same over lists: equal keys match one to one, so a key counts the smaller of its two numbers."""
    flags = gold.select(*unit, *key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*unit, *key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    per_key = flags.groupBy(*unit, *key).agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return per_key.groupBy(*unit).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.sum(F.least("g", "p")).alias("correct"))


def prf(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and f1, rounded to 4 digits; 0 for empty denominators."""
    return counts.withColumn("precision", ratio("correct", "predicted")).withColumn("recall", ratio("correct", "gold")).withColumn("f1", f1("gold", "predicted", "correct"))


def micro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    return prf(counts.groupBy(*(by or [])).agg(*(F.sum(c).alias(c) for c in ("gold", "predicted", "correct"))))


def macro(counts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Means of the units' rounded rates."""
    return prf(counts).groupBy(*(by or [])).agg(F.count("*").alias("units"), *(F.round(F.avg(c), 4).alias(c) for c in ("precision", "recall", "f1")))


def micro_with_total(counts: DataFrame, by: str, total: str = "all") -> DataFrame:
    """Rates by one column and overall, in one pass by grouping sets."""
    g = counts.rollup(by).agg(*(F.sum(c).alias(c) for c in ("gold", "predicted", "correct")), F.grouping(by).alias("_all"))
    return prf(g.withColumn(by, F.when(F.col("_all") == 1, F.lit(total)).otherwise(F.col(by))).drop("_all"))


def with_missing_as_empty(units: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """Every unit with the number of its rows, 0 where it has none."""
    return units.join(rows.groupBy(*key).agg(F.count("*").alias("n_rows")), key, "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0).cast("bigint"))).withColumn("missing", F.col("n_rows") == 0)


def jaccard(a: Column | str, b: Column | str, digits: int = 4) -> Column:
    """Of two arrays as sets; 1 if both are empty."""
    n = F.size(F.array_union(col(a), col(b)))
    return F.round(F.when(n == 0, 1.0).otherwise(F.size(F.array_intersect(col(a), col(b))) / n), digits)


def evidence_rates(verified: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Shares of relations with well-formed evidence, with both endpoints in it, without support, and invalid."""
    malformed = F.array_contains("reasons", "missing_or_malformed_relation_evidence")
    apart = F.array_contains("reasons", "entities_not_co_present_in_relation_evidence")
    g = verified.groupBy(*(by or [])).agg(F.count("*").alias("relations"), F.count_if(~malformed).alias("covered"), F.count_if(~malformed & ~apart).alias("supported"), F.count_if(~F.col("accepted")).alias("invalid"))
    return g.select(*(by or []), "relations", ratio("covered", "relations").alias("coverage"), ratio("supported", "relations").alias("correctness"), ratio(F.col("relations") - F.col("supported"), F.col("relations")).alias("unsupported_rate"), ratio("invalid", "relations").alias("invalid_rate"))


def _known(side: str) -> list[Column]:
    """Whether the names of a relation's end are among a job's entities, with its type and at all."""
    typed = F.struct(F.col(f"{side}_name").alias("name"), F.col(f"{side}_type").alias("type"))
    return [F.array_contains("typed", typed).alias(f"{side}_exact"), F.array_contains("named", F.col(f"{side}_name")).alias(f"{side}_named")]


def _with_other_side(rows: DataFrame, other: DataFrame, entities: DataFrame, by: list[str]) -> DataFrame:
    """rows with what the other side has for their job, as sets: edges, pairs of names, entities. All three tables are
    grouped by job and so meet in one shuffle each; a job's annotations are bounded by its text."""
    edge = F.struct("s_name", "s_type", "type", "t_name", "t_type")
    sets = other.groupBy(*by).agg(F.collect_set(edge).alias("edges"), F.collect_set(F.struct("s_name", "t_name")).alias("pairs"), F.collect_set(F.struct("s_name", "t_name", "type")).alias("typed_pairs"))
    ents = entities.groupBy(*by).agg(F.collect_set(F.struct("name", "type")).alias("typed"), F.collect_set("name").alias("named"))
    x = rows.join(sets, by, "left").join(ents, by, "left")
    back = F.struct(F.col("t_name").alias("s_name"), F.col("s_name").alias("t_name"))
    back_typed = F.struct(F.col("t_name").alias("s_name"), F.col("s_name").alias("t_name"), "type")
    flags = [
        F.array_contains("edges", edge).alias("strict"),
        F.array_contains("pairs", F.struct("s_name", "t_name")).alias("directed"),
        F.array_contains("pairs", back).alias("backward"),
        F.array_contains("typed_pairs", back_typed).alias("backward_type"),
        *_known("s"),
        *_known("t"),
    ]
    x = x.select(*(F.col(c) for c in rows.columns), *flags)
    return x.fillna(False, ["strict", "directed", "backward", "backward_type", "s_exact", "s_named", "t_exact", "t_named"])


def classify_predicted(pred: DataFrame, gold: DataFrame, gold_entities: DataFrame, by: list[str]) -> DataFrame:
    """pred with a class. pred, gold: by, s_name, s_type, type, t_name, t_type. gold_entities: by, name, type."""
    x = _with_other_side(pred, gold, gold_entities, by)
    both, some = F.col("s_exact") & F.col("t_exact"), F.col("s_named") | F.col("t_named")
    category = (
        F.when(F.col("strict"), "strict_match")
        .when(~both & some, "entity_type_or_boundary_error")
        .when(~both, "unsupported_or_hallucinated_endpoint")
        .when(F.col("directed"), "wrong_relation_type")
        .when(F.col("backward") & F.col("backward_type"), "reversed_direction")
        .when(F.col("backward"), "reversed_direction_and_type")
        .otherwise("unsupported_entity_pair")
    )
    return x.select(*pred.columns, category.alias("category"))


def classify_missed(gold: DataFrame, pred: DataFrame, pred_entities: DataFrame, by: list[str]) -> DataFrame:
    """The gold relations that were not predicted, with a class."""
    x = _with_other_side(gold, pred, pred_entities, by).filter(~F.col("strict"))
    both = F.col("s_exact") & F.col("t_exact")
    category = (
        F.when(both & F.col("directed"), "wrong_relation_type_or_claim")
        .when(both & F.col("backward"), "direction_error")
        .when(both, "relation_type_or_pair_error_with_recalled_entities")
        .when(F.col("s_named") | F.col("t_named"), "partial_entity_boundary_or_type_error")
        .otherwise("entity_recall_bottleneck")
    )
    return x.select(*gold.columns, category.alias("category"))


def describe(rows: DataFrame, value: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """Count, mean, median, population deviation, coefficient of variation, min, p90, p95, max, interquartile range."""
    v = F.col(value).cast("double")
    p = lambda q: F.percentile(v, F.lit(q))
    g = rows.groupBy(*(by or [])).agg(F.count(v).alias("count"), F.avg(v).alias("mean"), p(0.5).alias("median"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), p(0.9).alias("p90"), p(0.95).alias("p95"), F.max(v).alias("max"), (p(0.75) - p(0.25)).alias("iqr"))
    g = g.withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.col("mean")))
    return g.select(*(by or []), "count", *(F.round(c, digits).alias(c) for c in ("mean", "median", "std", "cv", "min", "p90", "p95", "max", "iqr")))


def label_distribution(rows: DataFrame, label: str, by: list[str] | None = None, digits: int = 4) -> DataFrame:
    """total, labels, singletons, their share, the top five's share, entropy in bits and normalized. Labels are counted
    before anything is ranked, so windows see one row per label."""
    by = by or []
    n = rows.groupBy(*by, label).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    n = n.withColumn("total", F.sum("n").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("n"), label)))
    p = F.col("n") / F.col("total")
    g = n.groupBy(*by).agg(F.max("total").alias("total"), F.count("*").alias("labels"), F.count_if(F.col("n") == 1).alias("singletons"), F.sum(F.when(F.col("rank") <= 5, F.col("n")).otherwise(0)).alias("top"), F.sum(-p * F.log2(p)).alias("h"))
    return g.select(*by, "total", "labels", "singletons", ratio("singletons", "labels", digits).alias("singleton_share"), ratio("top", "total", digits).alias("top5_share"), F.round("h", digits).alias("entropy"), F.round(F.when(F.col("labels") > 1, F.col("h") / F.log2("labels")).otherwise(0.0), digits).alias("normalized_entropy"))


def threshold_sweep(scored: DataFrame, thresholds: list[float], inclusive: bool = False) -> DataFrame:
    """threshold, tp, fp, fn, precision, recall, f1. scored: score, positive. All thresholds are counted in one pass."""
    hit = lambda t: (F.col("score") >= t) if inclusive else (F.col("score") > t)
    aggs = []
    for k, t in enumerate(thresholds):
        aggs += [F.count_if(hit(t) & F.col("positive")).alias(f"tp{k}"), F.count_if(hit(t) & ~F.col("positive")).alias(f"fp{k}"), F.count_if(~hit(t) & F.col("positive")).alias(f"fn{k}")]
    one = scored.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"tp{k}").alias("tp"), F.col(f"fp{k}").alias("fp"), F.col(f"fn{k}").alias("fn")) for k, t in enumerate(thresholds))))
    x = one.select(rows.alias("r")).select("r.*")
    return x.withColumn("precision", ratio("tp", F.col("tp") + F.col("fp"))).withColumn("recall", ratio("tp", F.col("tp") + F.col("fn"))).withColumn("f1", f1(F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp"), F.col("tp")))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row with the highest f1, then recall, precision, fewest predictions, highest threshold."""
    order = F.struct("f1", "recall", "precision", (-(F.col("tp") + F.col("fp"))).alias("few"), "threshold")
    return sweep.agg(F.max_by(F.struct(*sweep.columns), order).alias("r")).select("r.*")


def class_weights(rows: DataFrame, label: str, labels: list, mode: str = "per_label_sqrt", cap: float = 8.0) -> DataFrame:
    """label, n, weight for every label of the list, the first of which is the outside class.

    none: all 1. binary_sqrt: the outside class weighs the root of inside per outside rows, the others 1.
    per_label_sqrt: the root of total / (labels x own rows), divided by the weights' mean, at most cap.
    """
    counts = [F.greatest(F.count_if(F.col(label) == F.lit(v)), F.lit(0)).alias(f"n{k}") for k, v in enumerate(labels)]
    one = rows.agg(*counts)  # one row: the labels are a short fixed list
    n = [F.greatest(F.col(f"n{k}"), F.lit(1)) for k in range(len(labels))]
    if mode == "per_label_sqrt":
        total = sum((F.col(f"n{k}") for k in range(len(labels))), F.lit(0))
        raw = [F.sqrt(total / (len(labels) * c)) for c in n]
        mean = sum(raw, F.lit(0.0)) / len(labels)
        weights = [F.least(r / mean, F.lit(cap)) for r in raw]
    elif mode == "binary_sqrt":
        inside = F.greatest(sum((F.col(f"n{k}") for k in range(1, len(labels))), F.lit(0)), F.lit(1))
        weights = [F.sqrt(inside / n[0]), *(F.lit(1.0) for _ in n[1:])]
    else:
        weights = [F.lit(1.0) for _ in n]
    each = F.array(*(F.struct(F.lit(v).alias(label), F.col(f"n{k}").alias("n"), F.round(w, 4).alias("weight")) for k, (v, w) in enumerate(zip(labels, weights, strict=True))))
    return one.select(F.explode(each).alias("r")).select("r.*")


def sample_spread(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and sample deviation of repeated runs."""
    return rows.groupBy(*by).agg(F.count("*").alias("runs"), F.round(F.avg(value), 4).alias("mean"), F.round(F.stddev_samp(value), 4).alias("sd"))


def trailing_mean(rows: DataFrame, value: str, by: list[str], order: list[str], width: int = 10) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(width - 1), 0)
    return rows.withColumn("trailing_mean", F.round(F.avg(value).over(w), 6))
