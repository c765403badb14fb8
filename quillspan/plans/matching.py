"""Queries of relaxed matching and of the linear-chain CRF, with equal SQL."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.ids import h16
from quillspan.operators import decode, ranker, relaxed
from quillspan.plans import fixtures as fx
from quillspan.plans.fixtures import DUCK, MARKUP_PAIRS, _hk, duck_norm, duck_strip
from quillspan.plans.queries import _NAMED, _named_relations, query
from quillspan.sources.scratch import written

_BY = ["doc_id"]
_WRAP = MARKUP_PAIRS[4]  # []


def _entities(m: DataFrame, which: str) -> DataFrame:
    """Mentions; those of v2 are put into brackets by hash."""
    e = fx.entities(m, which)
    if which == "v2":
        wrap = h16(F.concat(F.lit("br:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"))) % 8 == 0
        e = e.withColumn("text", F.when(wrap, F.concat(F.lit(_WRAP[0]), "text", F.lit(_WRAP[1]))).otherwise(F.col("text")))
    return e


_SIDES = f"""{DUCK}, ge AS MATERIALIZED (SELECT doc_id, id, type, name, {duck_strip('name')} AS bare FROM gold), pe AS MATERIALIZED (SELECT doc_id, id, type, {duck_norm('t')} AS name, {duck_strip(duck_norm('t'))} AS bare FROM (SELECT *, CASE WHEN {_hk('br:')} % 8 = 0 THEN '{_WRAP[0]}' || text || '{_WRAP[1]}' ELSE text END AS t FROM v2))"""
_LEAST = "SELECT '{mode}' AS mode, doc_id, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS predicted, sum(least(g, p))::BIGINT AS matched FROM (SELECT doc_id, k, sum(g) AS g, sum(p) AS p FROM ({rows}) GROUP BY doc_id, k) GROUP BY doc_id"


def _entity_sql(mode: str) -> str:
    unique, key = {"strict": ("doc_id, name, type", "name || '|' || type"), "text": ("doc_id, name", "name"), "outer_markup": ("doc_id, name, type, bare", "bare || '|' || type")}[mode]
    rows = f"SELECT doc_id, {key} AS k, 1 AS g, 0 AS p FROM (SELECT DISTINCT {unique} FROM ge) UNION ALL SELECT doc_id, {key}, 0, 1 FROM (SELECT DISTINCT {unique} FROM pe)"
    return _LEAST.format(mode=mode, rows=rows)


@query(f"{_SIDES} {' UNION ALL '.join(map(_entity_sql, relaxed.EQUAL_MODES))}")
def relaxed_entities(spark, sf):
    """Entities matched strictly, by text, and without outer markup."""
    m = fx.mentions(spark, sf)
    got = [relaxed.entity_matches(_entities(m, "gold"), _entities(m, "v2"), _BY, mode).select(F.lit(mode).alias("mode"), "*") for mode in relaxed.EQUAL_MODES]
    return reduce(DataFrame.unionByName, got)


def _relations(m: DataFrame, which: str) -> DataFrame:
    r, e = fx.relations(m, which).select("doc_id", "type", "source_id", "target_id"), _entities(m, which).select("doc_id", "id", "text", F.col("type").alias("kind"))
    for p in ("source", "target"):
        r = r.join(e.select("doc_id", F.col("id").alias(f"{p}_id"), F.col("text").alias(f"{p}_text"), F.col("kind").alias(f"{p}_type")), ["doc_id", f"{p}_id"])
    return r


def _relation_sql(mode: str) -> str:
    end = {"strict": "{0}.name || '|' || {0}.type", "text": "{0}.name", "outer_markup": "{0}.bare || '|' || {0}.type"}[mode]
    one = "SELECT r.doc_id, r.type || '>' || " + end.format("s") + " || '>' || " + end.format("t") + " AS k, {g} AS g, {p} AS p FROM {r} r JOIN {e} s ON s.doc_id = r.doc_id AND s.id = r.source_id JOIN {e} t ON t.doc_id = r.doc_id AND t.id = r.target_id"
    return _LEAST.format(mode=mode, rows=one.format(g=1, p=0, r="rgold", e="ge") + " UNION ALL " + one.format(g=0, p=1, r="rv2", e="pe"))


@query(f"{_SIDES} {' UNION ALL '.join(map(_relation_sql, relaxed.EQUAL_MODES))}")
def relaxed_relations(spark, sf):
    m = fx.mentions(spark, sf)
    gold, pred = (written(_relations(m, which), f"relations-{which}") for which in ("gold", "v2"))  # read by each mode
    got = [relaxed.relation_matches(gold, pred, _BY, mode).select(F.lit(mode).alias("mode"), "*") for mode in relaxed.EQUAL_MODES]
    return reduce(DataFrame.unionByName, got)


@query()
def boundary_match(spark, sf):
    """Entities of one type, one of whose names lies in the other: the most one-to-one matches."""
    m = fx.mentions(spark, sf)
    return relaxed.entity_matches(_entities(m, "gold"), _entities(m, "v2"), _BY, "boundary_type")


@query()
def boundary_relations(spark, sf):
    m = fx.mentions(spark, sf)
    return relaxed.relation_matches(_relations(m, "gold"), _relations(m, "v2"), _BY, "boundary_text")


# --- CRF --------------------------------------------------------------------------------------------------------------

#: Fixed weights of three labels, in eighths.
CRF = decode.Crf(np.array([[4, -2, 1], [0, 3, -5], [2, 1, 0]]) / 8, np.array([1, 0, -3]) / 8, np.array([0, 2, -1]) / 8)
_T, _S, _E = ([[float(x) for x in r] for r in CRF.transitions.tolist()], CRF.start.tolist(), CRF.end.tolist())


def _logsum(x: str) -> str:
    return f"list_transform([{x}], lambda v: list_max(v) + ln(list_sum(list_transform(v, lambda u: exp(u - list_max(v))))))[1]"


_FORWARD = f"list_transform([1, 2, 3], lambda j: {_logsum(f'list_transform([1, 2, 3], lambda i: w.a[i] + ({_T}::DOUBLE[][])[i][j])')} + x.e[j])"
_BEST = f"list_transform([1, 2, 3], lambda j: list_max(list_transform([1, 2, 3], lambda i: w.b[i] + ({_T}::DOUBLE[][])[i][j])) + x.e[j])"


@query(f"""WITH RECURSIVE {DUCK.strip()[5:]}, x AS MATERIALIZED (SELECT doc_id, seg, row_number() OVER (PARTITION BY doc_id, seg ORDER BY i) AS t, count(*) OVER (PARTITION BY doc_id, seg) AS n, [{_hk('c0:')} % 64 / 16.0, {_hk('c1:')} % 64 / 16.0, {_hk('c2:')} % 64 / 16.0]::DOUBLE[] AS e, ({_hk('cy:')} % 3 + 1)::INT AS y FROM m),
w AS (SELECT doc_id, seg, t, n, list_transform([1, 2, 3], lambda j: ({_S}::DOUBLE[])[j] + x.e[j]) AS a, list_transform([1, 2, 3], lambda j: ({_S}::DOUBLE[])[j] + x.e[j]) AS b, ({_S}::DOUBLE[])[y] + e[y] AS g, y FROM x WHERE t = 1
UNION ALL SELECT x.doc_id, x.seg, x.t, x.n, {_FORWARD}, {_BEST}, w.g + ({_T}::DOUBLE[][])[w.y][x.y] + x.e[x.y], x.y FROM w JOIN x ON x.doc_id = w.doc_id AND x.seg = w.seg AND x.t = w.t + 1),
f AS (SELECT doc_id, seg, n, {_logsum(f'list_transform([1, 2, 3], lambda j: a[j] + ({_E}::DOUBLE[])[j])')} AS z, list_max(list_transform([1, 2, 3], lambda j: b[j] + ({_E}::DOUBLE[])[j])) AS best, g + ({_E}::DOUBLE[])[y] AS g FROM w WHERE t = n)
SELECT doc_id, seg::INT AS seg, n::INT AS n, round(z, 6) AS log_partition, round(best, 6) AS best, round(g, 6) AS gold_score, round(z - g, 6) AS nll FROM f""")
def crf_scores(spark, sf):
    """Lines' mentions as sequences, with emissions and labels by hash: partition, best path's and gold scores, and NLL."""
    h = lambda tag: h16(F.concat(F.lit(tag), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")))
    one = F.struct("i", F.array(*(h(f"c{k}:") % 64 / 16.0 for k in range(3))).alias("e"), (h("cy:") % 3).alias("y"))
    s = fx.mentions(spark, sf).groupBy("doc_id", "seg").agg(F.array_sort(F.collect_list(one)).alias("s"))
    rows = s.select("doc_id", "seg", F.size("s").alias("n"), F.transform("s", lambda x: x["e"]).alias("e"), F.transform("s", lambda x: x["y"]).alias("y"))
    got = decode.crf_sequences(rows, "e", "y", CRF)
    return got.select("doc_id", "seg", "n", *(F.round(c, 6).alias(c) for c in ("log_partition", "best", "gold_score", "nll")))


# --- ranking ----------------------------------------------------------------------------------------------------------

THRESHOLDS = [0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
_WEIGHTS = {"edge_prior": 1.5, "semantic_pattern": 0.75, "noise": 0.03125}


def _candidates(spark, sf, m: DataFrame) -> DataFrame:
    """Neighbouring mentions of a line with every label that is legal between them, with graph features of gold."""
    e = fx.entities(m, "v2")
    w = fx.Window.partitionBy("doc_id", "seg").orderBy("i")
    p = e.select("doc_id", "lang", "i", F.col("id").alias("source_id"), F.col("text").alias("source_text"), F.col("type").alias("source_type"), *(F.lead(c).over(w).alias(f"target_{c}") for c in ("id", "text", "type"))).filter("target_id is not null")
    c = p.join(F.broadcast(fx.signatures(spark)), ["source_type", "target_type"])
    gold = _named_relations(m, "gold").select("doc_id", "lang", F.col("s_name").alias("source"), F.col("s_type").alias("source_type"), F.col("type").alias("relation"), F.col("t_name").alias("target"), F.col("t_type").alias("target_type"))
    edges, patterns = ranker.graph_facts(gold, "doc_id")
    x = ranker.graph_features(c, edges, patterns, "doc_id").withColumn("noise", h16(F.concat(F.lit("rk:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"), F.lit(":"), "relation")) % 64 - 32)
    right = fx.relations(m, "gold").select("doc_id", "source_id", F.col("type").alias("relation"), "target_id").distinct().withColumn("positive", F.lit(True))
    return x.join(right, ["doc_id", "source_id", "relation", "target_id"], "left").withColumn("positive", F.coalesce("positive", F.lit(False)))


_RANKED = f"""{_NAMED}, c AS (SELECT v.doc_id, v.lang, v.i, 'E' || v.i AS source_id, 'E' || v.j AS target_id, v.type AS st, b.type AS tt, v.name AS sn, b.name AS tn, sig.relation FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, seg ORDER BY i) AS j FROM v2) v JOIN v2 b ON b.doc_id = v.doc_id AND b.i = v.j JOIN sig ON sig.source_type = v.type AND sig.target_type = b.type),
f AS (SELECT c.*, EXISTS (SELECT 1 FROM gr g WHERE g.doc_id <> c.doc_id AND g.lang = c.lang AND g.s_name = sn AND g.t_name = tn AND g.type = relation) AS edge_prior, EXISTS (SELECT 1 FROM (SELECT type, s_type, t_type, min(doc_id) AS lo, max(doc_id) AS hi FROM gr GROUP BY ALL) g WHERE g.type = relation AND g.s_type = st AND g.t_type = tt AND (lo <> c.doc_id OR hi <> c.doc_id)) AS pattern,
('0x' || substr(md5('rk:' || doc_id || ':' || i || ':' || relation), 1, 4))::INT % 64 - 32 AS noise, EXISTS (SELECT 1 FROM rgold r WHERE r.doc_id = c.doc_id AND r.source_id = c.source_id AND r.target_id = c.target_id AND r.type = relation) AS positive FROM c),
s AS (SELECT *, 1 / (1 + exp(-(-0.5 + 1.5 * edge_prior::INT + 0.75 * pattern::INT + 0.03125 * noise))) AS score FROM f), b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY doc_id, source_id, target_id ORDER BY score DESC, relation) = 1),
n AS (SELECT th, count(*) FILTER (WHERE positive AND score >= th) AS tp, count(*) FILTER (WHERE NOT positive AND score >= th) AS fp, count(*) FILTER (WHERE positive AND score < th) AS fn FROM b, (SELECT unnest({THRESHOLDS}) AS th) WHERE doc_id % 2 = 0 GROUP BY th),
o AS (SELECT th FROM n ORDER BY round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 4) DESC, round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fn) END, 4) DESC, round(CASE WHEN tp = 0 THEN 0 ELSE tp / (tp + fp) END, 4) DESC, tp + fp, th DESC LIMIT 1)"""


@query(f"""{_RANKED} SELECT doc_id, source_id, target_id, relation, edge_prior, pattern AS semantic_pattern, round(score, 6) AS score, positive, score >= th AS accepted FROM b, o WHERE doc_id % 2 = 1""")
def ranked_relations(spark, sf):
    """The best label of each pair by fixed weights; documents of even ids choose the threshold for those of odd ones."""
    x = written(_candidates(spark, sf, fx.mentions(spark, sf)).withColumn("score", ranker.linear_score(_WEIGHTS, -0.5)), "candidates")
    best = ranker.best_of_pair(x, ["doc_id", "source_id", "target_id"])
    at = ranker.choose_threshold(best.filter("doc_id % 2 = 0"), THRESHOLDS)
    out = best.filter("doc_id % 2 = 1").withColumn("accepted", F.col("score") >= at)
    return out.select("doc_id", "source_id", "target_id", "relation", "edge_prior", "semantic_pattern", F.round("score", 6).alias("score"), "positive", "accepted")


@query(f"""{_RANKED} SELECT doc_id, source_id, target_id, relation, md5('language=' || lang || ' | source_type=' || st || ' | source=' || sn || ' | relation=' || relation || ' | target_type=' || tt || ' | target=' || tn || ' | kg_edge_prior=' || CASE WHEN edge_prior THEN 'yes' ELSE 'no' END || ' | kg_semantic_pattern=' || CASE WHEN pattern THEN 'yes' ELSE 'no' END) AS text_md5 FROM f""")
def candidate_features(spark, sf):
    x = _candidates(spark, sf, fx.mentions(spark, sf))
    return x.select("doc_id", "source_id", "target_id", "relation", F.md5(ranker.feature_text()).alias("text_md5"))
