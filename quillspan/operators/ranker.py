"""Ranking of candidate relations: features from the text and from a training graph, a score for each label, the best label
of each pair of entities, and a threshold chosen on documents held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import norm
from quillspan.operators import learn, metrics

CONTEXT_CHARS = 1600


def graph_facts(relations: DataFrame, doc: str) -> tuple[DataFrame, DataFrame]:
    """Edges (lang, source, relation, target) and patterns (relation, source_type, target_type) of a training graph, each
    with whether several documents have it and one that does. relations: doc, lang, source, source_type, relation,
    target, target_type, the names normalized."""
    def facts(keys: list[str]) -> DataFrame:
        return relations.groupBy(*keys).agg((F.min(doc) != F.max(doc)).alias("several"), F.min(doc).alias("witness"))

    return facts(["lang", "source", "relation", "target"]), facts(["relation", "source_type", "target_type"])


def graph_features(candidates: DataFrame, edges: DataFrame, patterns: DataFrame, doc: str) -> DataFrame:
    """candidates with edge_prior and semantic_pattern: whether the training graph has this edge, or an edge of this label
    between these types, from another document than the candidate's own. candidates: doc, lang, source_text, source_type,
    relation, target_text, target_type."""
    other = F.coalesce(F.col("several") | (F.col("witness") != F.col(doc)), F.lit(False))
    x = candidates.withColumns({"source": norm("source_text"), "target": norm("target_text")})
    x = x.join(edges, ["lang", "source", "relation", "target"], "left").withColumn("edge_prior", other).drop("several", "witness")
    x = x.join(patterns, ["relation", "source_type", "target_type"], "left").withColumn("semantic_pattern", other).drop("several", "witness")
    return x.select(*candidates.columns, "edge_prior", "semantic_pattern")


def feature_text(context: Column | str | None = None, graph: bool = True) -> Column:
    """What a text classifier sees of a candidate: named fields, the graph's flags if asked for, and the begin of its
    segment (so many characters are a model's input, as in other systems of this kind)."""
    flag = lambda name, c: F.concat(F.lit(f"{name}="), F.when(F.col(c), "yes").otherwise("no"))
    named = lambda name, c: F.concat(F.lit(f"{name}="), F.coalesce(c, F.lit("")))
    fields = [named("language", F.col("lang")), named("source_type", F.col("source_type")), named("source", norm("source_text")), named("relation", F.col("relation")), named("target_type", F.col("target_type")), named("target", norm("target_text"))]
    if graph:
        fields += [flag("kg_edge_prior", "edge_prior"), flag("kg_semantic_pattern", "semantic_pattern")]
    if context is not None:
        fields.append(named("context", F.substring(norm(context), 1, CONTEXT_CHARS)))
    return F.concat_ws(" | ", *fields)


def linear_score(weights: dict[str, float], bias: float = 0.0) -> Column:
    """The logistic function of a weighted sum of columns; flags count as 0 and 1, nulls as 0."""
    z = F.lit(float(bias))
    for name, w in weights.items():
        z = z + F.lit(float(w)) * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def best_of_pair(scored: DataFrame, pair: list[str], label: str = "relation", score: str = "score") -> DataFrame:
    """The label with the highest score of each pair; of equal ones the first."""
    return scored.withColumn("_k", F.row_number().over(Window.partitionBy(*pair).orderBy(F.desc(score), label))).filter("_k = 1").drop("_k")


def choose_threshold(scored: DataFrame, thresholds: list[float], score: str = "score") -> float:
    """The threshold with the best F1 on these rows (score, positive), then by recall, precision, fewest predictions, the
    highest. One pass over the rows, one row to the driver."""
    sweep = metrics.threshold_sweep(scored.select(F.col(score).alias("score"), "positive"), thresholds)
    return metrics.best_threshold(sweep).first()["threshold"]


def train_and_rank(train: DataFrame, dev: DataFrame, test: DataFrame, pair: list[str], thresholds: list[float], context: str | None = None, graph: bool = True) -> DataFrame:
    """test's best label of each pair with score and accepted. A logistic regression on character n-grams of feature
    texts is fitted on train, and the threshold chosen on the best labels of dev. All three: the columns of
    graph_features() and, but for test, positive."""
    text = lambda df: df.withColumn("_text", feature_text(context, graph))
    model = learn.text_classifier(text(train).withColumn("_y", F.col("positive").cast("double")), "_text", "_y")
    scored = lambda df: best_of_pair(learn.text_scores(model, text(df), "_text"), pair).drop("_text", "prediction")
    at = choose_threshold(scored(dev), thresholds)
    return scored(test).withColumn("accepted", F.col("score") >= at)
