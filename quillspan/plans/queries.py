"""Queries over the driver tables, by name, with equal SQL for DuckDB where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import text as T
from quillspan.functions.ids import concept_id, document_id, f1, h16, ratio
from quillspan.operators import contracts, corpus, decode, gate, graph, kg, metrics, resample, splitting, windows
from quillspan.operators.audit import positions
from quillspan.plans import fixtures as fx
from quillspan.plans.fixtures import DUCK, duck_norm, duck_strip
from quillspan.sources.readers import plain_text
from quillspan.sources.scratch import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
ITERATIONS = 20_000  # of resampling


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- corpus ---------------------------------------------------------------------------------------------------------


@query("""SELECT doc_id, 'doc_' || substr(sha256(source || '/' || doc_id), 1, 16) AS document_id, sha256(text) AS sha256,
CASE WHEN min(doc_id) OVER (PARTITION BY sha256(text)) <> doc_id THEN min(doc_id) OVER (PARTITION BY sha256(text)) END AS duplicate_of FROM documents""")
def first_occurrence_dup(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", document_id(F.concat_ws("/", "source", "doc_id")).alias("document_id"), F.sha2("text", 256).alias("sha256"))
    return corpus.mark_duplicates(d, "sha256", "doc_id")


@query("SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY ALL HAVING count(*) > 1")
def exact_dup_documents(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return d.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).filter("n > 1")


_LINES = """SELECT doc_id, k - 1 AS k, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "start"
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)"""


@query(f"""SELECT doc_id, 'S' || (k + 1) AS segment_id, "start", "start" + length(line) AS "end", md5(line) AS text_md5 FROM ({_LINES}) WHERE line <> ''""")
def segments_offsets(spark, sf):
    s = corpus.line_segments(read(spark, sf, "documents"))
    return s.select("doc_id", "segment_id", "start", "end", F.md5("text").alias("text_md5"))


@query("""SELECT doc_id, 'S' || row_number() OVER (PARTITION BY doc_id ORDER BY k) AS segment_id,
coalesce(sum(length(t) + 2) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "start", length(t) AS n
FROM (SELECT doc_id, k, trim(line, chr(32)||chr(9)||chr(13)) AS t FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)) WHERE t <> ''""")
def make_segments(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return corpus.make_segments(d, ["doc_id"], "k").select("doc_id", "segment_id", "start", F.length("text").alias("n"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list(length(line) ORDER BY k) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) GROUP BY doc_id),
r AS (SELECT doc_id, n, 0 AS i, 0 AS chunk, 1201 AS size FROM l
UNION ALL SELECT doc_id, n, i + 1, CASE WHEN size + n[i + 1] <= 1200 THEN chunk ELSE chunk + 1 END, CASE WHEN size + n[i + 1] <= 1200 THEN size + n[i + 1] WHEN n[i + 1] > 1200 THEN 1201 ELSE n[i + 1] END FROM r WHERE i < len(n))
SELECT doc_id, max(chunk)::BIGINT AS chunks, count(*)::BIGINT - 1 AS segments FROM r GROUP BY doc_id""")
def chunk_positions(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", corpus.chunk_numbers(F.transform(F.split("text", "\n"), F.length), 1200).alias("c"))
    return d.select("doc_id", F.array_max("c").cast("bigint").alias("chunks"), F.size("c").cast("bigint").alias("segments"))


@query("""SELECT doc_id, unnest(CASE WHEN n <= 5 THEN range(0, n) ELSE [(p * (n - 1) + 2) // 4 for p in range(0, 5)] END)::BIGINT AS position FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)""")
def representative_chunks(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))
    return d.select("doc_id", F.explode(corpus.representative_positions(F.col("n"), 5)).alias("position"))


@query("""SELECT lang, hint, count(*) AS n FROM (SELECT lang, CASE WHEN cjk >= 10 AND cjk >= greatest(letters, 1) * 0.2 THEN 'zh' WHEN letters >= 10 THEN 'en' ELSE 'unknown' END AS hint
FROM (SELECT lang, length(regexp_replace(text, '[^\\x{4E00}-\\x{9FFF}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters FROM documents)) GROUP BY ALL""")
def language_hint_stats(spark, sf):
    return read(spark, sf, "documents").select("lang", T.language_hint("text").alias("hint")).groupBy("lang", "hint").agg(F.count("*").alias("n"))


_CATEGORIES = {"licence": "licen[cs]e|rights reserved", "contact": "@|token", "table": " [|] ", "shout": "[A-Z]{4,}!!"}
_CASE = " ".join(f"WHEN regexp_matches(text, '(?i){p}') THEN '{k}'" for k, p in _CATEGORIES.items())


@query(f"SELECT category, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT text, CASE {_CASE} ELSE 'other' END AS category FROM documents) GROUP BY category")
def category_classify(spark, sf):
    d = read(spark, sf, "documents").select("text", T.first_category("text", _CATEGORIES).alias("category"))
    return d.groupBy("category").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("SELECT lang, count(*) AS n, sum(length(regexp_replace(text, '[^A-Za-z0-9_]+', '', 'g')))::BIGINT AS ascii_words FROM documents GROUP BY lang")
def content_length_stats(spark, sf):
    d = read(spark, sf, "documents").select("lang", T.content_length(F.regexp_replace("text", "[^\\x00-\\x7F]", "")).alias("n"))
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").alias("ascii_words"))


@query(f"SELECT doc_id, md5({duck_norm('text')}) AS norm_md5, md5(CASE WHEN length(text) <= 180 THEN text ELSE rtrim(text[:179], ' ' || chr(10)) || '…' END) AS clip_md5 FROM documents")
def normalized_texts(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(T.norm("text")).alias("norm_md5"), F.md5(T.clip("text")).alias("clip_md5"))


@query(f"""SELECT doc_id, list(item_id ORDER BY item_id) AS items FROM documents d JOIN benchmark b ON contains({duck_norm('d.text')}, {duck_norm('b.text')}) GROUP BY doc_id""")
def benchmark_contamination(spark, sf):
    b = read(spark, sf, "benchmark").select(F.lit("x").alias("lang"), T.norm("text").alias("name"), "item_id")
    d = read(spark, sf, "documents").select("doc_id", F.lit("x").alias("lang"), "text")
    found = kg.names_in_segments(b, d, ["doc_id"]).join(b, ["lang", "name"])
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_list("item_id")).alias("items"))


@query(f"""SELECT a.doc_id, list(DISTINCT b.doc_id ORDER BY b.doc_id) AS matches FROM documents a JOIN documents b ON {duck_norm('a.text')} = {duck_norm('b.text')} WHERE a.doc_id % 2 = 0 AND b.doc_id % 2 = 1 GROUP BY a.doc_id""")
def exact_overlap_quarantine(spark, sf):
    """Even ids play the training side, odd ones the evaluation side; both whole."""
    d = read(spark, sf, "documents").select("doc_id", "text")
    return corpus.overlap_quarantine(d.filter("doc_id % 2 = 0"), d.filter("doc_id % 2 = 1"), "doc_id", "doc_id")


_FP = f"""WITH s AS (SELECT doc_id, length(text) AS n_chars, {duck_norm('text')} AS t FROM documents),
g AS (SELECT DISTINCT doc_id, n_chars, substr(t, i::INT, 5) AS g FROM (SELECT doc_id, n_chars, t, unnest(range(1, greatest(length(t) - 3, 2), 3)) AS i FROM s)),
h AS (SELECT doc_id, n_chars, ('0x' || substr(md5(g), 1, 8))::BIGINT AS hi, ('0x' || substr(md5(g), 9, 8))::BIGINT AS lo FROM g),
v AS (SELECT doc_id, n_chars, b, sum(CASE WHEN (CASE WHEN b < 32 THEN lo >> b ELSE hi >> (b - 32) END) & 1 = 1 THEN 1 ELSE -1 END) AS vote FROM h, (SELECT unnest(range(0, 64)) AS b) GROUP BY ALL),
f AS (SELECT doc_id, n_chars, sum(CASE WHEN vote >= 0 THEN (1::HUGEINT << b) ELSE 0 END) AS u FROM v GROUP BY ALL),
fp AS MATERIALIZED (SELECT doc_id, n_chars, u, (CASE WHEN u >= 9223372036854775808 THEN u - 18446744073709551616 ELSE u END)::BIGINT AS fingerprint FROM f)"""


@query(f"{_FP} SELECT doc_id, n_chars, fingerprint FROM fp")
def simhash_fingerprints(spark, sf):
    return corpus.simhash(read(spark, sf, "documents"))


_PAIRS = """c AS (SELECT min(doc_id) AS id, n_chars, u, fingerprint FROM fp GROUP BY n_chars, u, fingerprint),
p AS (SELECT a.id AS a, b.id AS b, bit_count(xor(a.fingerprint, b.fingerprint))::INT AS distance FROM c a JOIN c b ON a.id < b.id
WHERE ((a.u % 65536) = (b.u % 65536) OR (a.u // 65536 % 65536) = (b.u // 65536 % 65536) OR (a.u // 4294967296 % 65536) = (b.u // 4294967296 % 65536) OR (a.u // 281474976710656) = (b.u // 281474976710656))
AND bit_count(xor(a.fingerprint, b.fingerprint)) <= 8 AND least(a.n_chars, b.n_chars) >= 0.35 * greatest(a.n_chars, b.n_chars))"""


@query(f"{_FP}, {_PAIRS} SELECT a, b, distance FROM p")
def simhash_band_pairs(spark, sf):
    return corpus.simhash_pairs(corpus.simhash(read(spark, sf, "documents")))


@query(f"""{_FP.replace('WITH s', 'WITH RECURSIVE s')}, {_PAIRS}, e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT id AS node, id AS root FROM c UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node)
SELECT fp.doc_id, min(r.root) AS cluster FROM fp JOIN c ON fp.fingerprint = c.fingerprint AND fp.n_chars = c.n_chars JOIN r ON r.node = c.id GROUP BY fp.doc_id""")
def near_dup_clusters(spark, sf):
    return corpus.near_clusters(corpus.simhash(read(spark, sf, "documents")))


# --- verification and fusion ------------------------------------------------------------------------------------------

_BY = ["doc_id"]
_REASONS = """list_filter([
  CASE WHEN s.id IS NULL OR t.id IS NULL THEN 'unknown_entity_reference' END,
  CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL AND r.source_id = r.target_id THEN 'self_relation' END,
  CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM sig WHERE sig.relation = r.type AND sig.source_type = s.type AND sig.target_type = t.type) THEN 'illegal_entity_type_signature' END,
  CASE WHEN r.claim_status IS NULL OR r.claim_status NOT IN ('explicit', 'inferred') THEN 'missing_or_unknown_claim_status' END,
  CASE WHEN {ev} = '' THEN 'missing_or_malformed_relation_evidence' END,
  CASE WHEN s.id IS NOT NULL AND t.id IS NOT NULL AND {ev} <> '' AND NOT (contains({ev}, s.name) AND contains({ev}, t.name)) THEN 'entities_not_co_present_in_relation_evidence' END], lambda x: x IS NOT NULL)""".format(ev=duck_norm("r.ev_text"))
_VER = f"""{DUCK}, ver AS MATERIALIZED (SELECT r.*, s.name AS s_name, s.type AS s_type, t.name AS t_name, t.type AS t_type, {_REASONS} AS why
FROM rv2 r LEFT JOIN v2 s ON s.doc_id = r.doc_id AND s.id = r.source_id LEFT JOIN v2 t ON t.doc_id = r.doc_id AND t.id = r.target_id)"""


def _verified(spark, sf, m=None):
    m = m if m is not None else fx.mentions(spark, sf)
    return gate.verify_relations(fx.relations(m, "v2"), fx.entities(m, "v2"), fx.signatures(spark), fx.CLAIMS, _BY)


@query(f"{_VER} SELECT doc_id, id, len(why) = 0 AS accepted, CASE WHEN len(why) = 0 THEN 'accepted' ELSE array_to_string(why, ';') END AS reasons, ev_seg AS segments FROM ver")
def verify_relations(spark, sf):
    v = _verified(spark, sf)
    return v.select("doc_id", "id", "accepted", F.array_join("reasons", ";").alias("reasons"), F.array_join("relation_segment_ids", ";").alias("segments"))


@query(f"{_VER} SELECT reason, count(*) AS n FROM (SELECT unnest(CASE WHEN len(why) = 0 THEN ['accepted'] ELSE why END) AS reason FROM ver) GROUP BY reason")
def verify_reason_histogram(spark, sf):
    return _verified(spark, sf).select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""{_VER}, d AS (SELECT doc_id, id, source_id, target_id, EXISTS (SELECT 1 FROM sig WHERE relation = ver.type AND source_type = s_type AND target_type = t_type) AS ok,
EXISTS (SELECT 1 FROM sig WHERE relation = ver.type AND source_type = t_type AND target_type = s_type) AS back FROM ver)
SELECT doc_id, id, CASE WHEN NOT ok AND back THEN target_id ELSE source_id END AS source_id, CASE WHEN NOT ok AND back THEN source_id ELSE target_id END AS target_id, CASE WHEN ok THEN 'legal' WHEN back THEN 'repaired' ELSE 'rejected' END AS direction FROM d""")
def inverse_repair(spark, sf):
    m = fx.mentions(spark, sf)
    return gate.repair_direction(fx.relations(m, "v2"), fx.entities(m, "v2"), fx.signatures(spark), _BY).select("doc_id", "id", "source_id", "target_id", "direction")


@query(f"{DUCK} SELECT DISTINCT doc_id, relation FROM (SELECT DISTINCT a.doc_id, sig.relation FROM v2 a JOIN sig ON sig.source_type = a.type JOIN v2 b ON b.doc_id = a.doc_id AND b.id <> a.id AND b.type = sig.target_type)")
def legal_types(spark, sf):
    """Relation types for which a job has an ordered pair of two entities. Types are counted per job, not paired."""
    e = fx.entities(fx.mentions(spark, sf), "v2").groupBy("doc_id", "type").agg(F.count("*").alias("n"))
    s = fx.signatures(spark)
    a = e.join(F.broadcast(s), F.col("type") == F.col("source_type")).select("doc_id", "relation", "source_type", "target_type")
    b = e.select("doc_id", F.col("type").alias("target_type"), "n")
    return a.join(b, ["doc_id", "target_type"]).filter("source_type <> target_type OR n > 1").select("doc_id", "relation").distinct()


@query(f"{DUCK} SELECT a.doc_id, a.id AS source_id, sig.relation AS type, b.id AS target_id, min(a.seg)::INT AS seg FROM v2 a JOIN v2 b ON a.doc_id = b.doc_id AND a.seg = b.seg AND a.id <> b.id JOIN sig ON sig.source_type = a.type AND sig.target_type = b.type GROUP BY ALL")
def candidate_pairs(spark, sf):
    e = fx.entities(fx.mentions(spark, sf), "v2")
    return gate.candidate_pairs(e, fx.signatures(spark), _BY).select("doc_id", "source_id", "type", "target_id", "seg")


_FUSE = f"""{_VER}, cat AS (SELECT lang, name, type, count(*) AS n FROM gold GROUP BY ALL), anch AS (SELECT lang, name, type FROM (SELECT *, row_number() OVER (PARTITION BY lang, name ORDER BY n DESC, type) AS k FROM cat) WHERE k = 1 AND n >= 20),
ends AS (SELECT doc_id, s_name AS name, s_type AS type FROM ver WHERE len(why) = 0 UNION SELECT doc_id, t_name, t_type FROM ver WHERE len(why) = 0),
flags AS (SELECT v.*, EXISTS (SELECT 1 FROM v1 WHERE v1.doc_id = v.doc_id AND v1.name = v.name AND v1.type = v.type) AS agree, EXISTS (SELECT 1 FROM anch WHERE anch.lang = v.lang AND anch.name = v.name AND anch.type = v.type) AS anchor,
EXISTS (SELECT 1 FROM ends WHERE ends.doc_id = v.doc_id AND ends.name = v.name AND ends.type = v.type) AS endpoint, row_number() OVER (PARTITION BY doc_id, name, type ORDER BY i) AS nth FROM v2 v),
fused AS MATERIALIZED (SELECT *, (agree OR anchor OR endpoint) AND nth = 1 AS accepted,
CASE WHEN NOT (agree OR anchor OR endpoint) THEN ['no_acceptance_signal'] ELSE list_filter([CASE WHEN agree THEN 'v1_v2_exact_agreement' END, CASE WHEN anchor THEN 'source_gated_anchor_type_match' END, CASE WHEN endpoint THEN 'verified_relation_endpoint' END, CASE WHEN nth > 1 THEN 'duplicate_normalized_text_and_type' END], lambda x: x IS NOT NULL) END AS reasons FROM flags)"""


def _fused(spark, sf):
    m = fx.mentions(spark, sf)
    v = written(_verified(spark, sf, m).drop("evidence"), "verified")  # read by several branches, and so is the result
    c = fx.entities(m, "gold").withColumn("name", T.norm("text")).groupBy("lang", "name", "type").agg(F.count("*").alias("n"))
    best = kg.top_k(c, ["lang", "name"], [F.desc("n"), "type"], 1).filter("n >= 20")
    v2 = fx.entities(m, "v2").drop("evidence")  # a whole line for each mention, which nothing reads after verification
    anchors = v2.withColumn("name", T.norm("text")).join(best.select("lang", "name", "type"), ["lang", "name", "type"], "left_semi").select("doc_id", "name", "type")
    return m, v, written(gate.fuse_entities(fx.entities(m, "v1"), v2, v.filter("accepted"), anchors, _BY, "i"), "fused")


@query(f"{_FUSE} SELECT doc_id, id, accepted, array_to_string(reasons, ';') AS reasons FROM fused")
def fuse_entities(spark, sf):
    return _fused(spark, sf)[2].select("doc_id", "id", "accepted", F.array_join("reasons", ";").alias("reasons"))


@query(f"{_FUSE} SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM fused) GROUP BY reason")
def fusion_reason_counts(spark, sf):
    return _fused(spark, sf)[2].select(F.explode("reasons").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def _surviving(which: str) -> str:
    return f"{_FUSE} SELECT r.doc_id, r.id, r.type FROM ver r WHERE {'len(why) = 0 AND' if which == 'verified' else ''} EXISTS (SELECT 1 FROM fused f WHERE f.doc_id = r.doc_id AND f.id = r.source_id AND f.accepted) AND EXISTS (SELECT 1 FROM fused f WHERE f.doc_id = r.doc_id AND f.id = r.target_id AND f.accepted)"


@query(_surviving("verified"))
def fuse_pge(spark, sf):
    _, v, f = _fused(spark, sf)
    return gate.surviving_relations(v.filter("accepted"), f.filter("accepted"), _BY).select("doc_id", "id", "type")


@query(_surviving("raw"))
def fuse_cfe(spark, sf):
    m, _, f = _fused(spark, sf)
    return gate.surviving_relations(fx.relations(m, "v2"), f.filter("accepted"), _BY).select("doc_id", "id", "type")


_PRF = """round(CASE WHEN predicted = 0 THEN 0 ELSE correct / predicted END, 4)::DOUBLE AS precision, round(CASE WHEN gold = 0 THEN 0 ELSE correct / gold END, 4)::DOUBLE AS recall, round(CASE WHEN gold + predicted = 0 THEN 0 ELSE 2.0 * correct / (gold + predicted) END, 4)::DOUBLE AS f1"""


def _counts(gold: str, pred: str, unit: str, key: str, dedup: bool = True) -> str:
    both = f"SELECT {unit}, {key}, 1 AS g, 0 AS p FROM {gold} UNION ALL SELECT {unit}, {key}, 0, 1 FROM {pred}"
    agg = "max(g) AS g, max(p) AS p" if dedup else "sum(g) AS g, sum(p) AS p"
    return f"SELECT {unit}, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS predicted, sum(least(g, p))::BIGINT AS correct FROM (SELECT {unit}, {key}, {agg} FROM ({both}) GROUP BY ALL) GROUP BY ALL"


_SPAN = '"start", "end", type'


@query(f"""{_FUSE}, pge AS (SELECT r.* FROM ver r WHERE len(why) = 0 AND EXISTS (SELECT 1 FROM fused f WHERE f.doc_id = r.doc_id AND f.id = r.source_id AND f.accepted) AND EXISTS (SELECT 1 FROM fused f WHERE f.doc_id = r.doc_id AND f.id = r.target_id AND f.accepted)),
rel AS (SELECT r.doc_id, r.lang, 'relation' AS field, s.start || ':' || s.end || ':' || s.type || '|' || r.type || '|' || t.start || ':' || t.end || ':' || t.type AS k, 1 AS g, 0 AS p FROM rgold r JOIN gold s ON s.doc_id = r.doc_id AND s.id = r.source_id JOIN gold t ON t.doc_id = r.doc_id AND t.id = r.target_id
UNION ALL SELECT r.doc_id, r.lang, 'relation', s.start || ':' || s.end || ':' || s.type || '|' || r.type || '|' || t.start || ':' || t.end || ':' || t.type, 0, 1 FROM pge r JOIN v2 s ON s.doc_id = r.doc_id AND s.id = r.source_id JOIN v2 t ON t.doc_id = r.doc_id AND t.id = r.target_id),
ent AS (SELECT doc_id, lang, 'entity' AS field, "start" || ':' || "end" || ':' || type AS k, 1 AS g, 0 AS p FROM gold UNION ALL SELECT doc_id, lang, 'entity', "start" || ':' || "end" || ':' || type, 0, 1 FROM fused WHERE accepted),
per AS (SELECT field, lang, doc_id, k, max(g) AS g, max(p) AS p FROM (SELECT * FROM rel UNION ALL SELECT * FROM ent) GROUP BY ALL),
c AS (SELECT field, CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, sum(g)::BIGINT AS gold, sum(p)::BIGINT AS predicted, sum(g * p)::BIGINT AS correct FROM per GROUP BY GROUPING SETS ((field, lang), (field)))
SELECT field, lang, gold, predicted, correct, {_PRF} FROM c""")
def flagship_pge_f1(spark, sf):
    """Verification, fusion, survival of relations, and strict span F1 by language and overall."""
    m, v, f = _fused(spark, sf)
    acc = f.filter("accepted")
    pge = gate.surviving_relations(v.filter("accepted"), acc, _BY)
    span = F.concat_ws(":", "start", "end", "type")
    ents = lambda e: e.select("doc_id", "lang", F.lit("entity").alias("field"), span.alias("k"))

    def rels(r, e):
        k = e.select("doc_id", "id", span.alias("span"))
        x = r.join(k.withColumnsRenamed({"id": "source_id", "span": "s"}), ["doc_id", "source_id"]).join(k.withColumnsRenamed({"id": "target_id", "span": "t"}), ["doc_id", "target_id"])
        return x.select("doc_id", "lang", F.lit("relation").alias("field"), F.concat_ws("|", "s", "type", "t").alias("k"))

    gold = ents(fx.entities(m, "gold")).unionByName(rels(fx.relations(m, "gold"), fx.entities(m, "gold")))
    pred = ents(acc).unionByName(rels(pge, fx.entities(m, "v2")))
    per_doc = metrics.key_counts(gold, pred, ["field", "lang", "doc_id"], ["k"])
    sets = per_doc.select("field", "gold", "predicted", "correct", F.explode(F.array("lang", F.lit("all"))).alias("lang"))
    return metrics.micro(sets, ["field", "lang"])


@query(f"{DUCK}, c AS ({_counts('gold', 'v2', 'doc_id', _SPAN)}), t AS (SELECT sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c) SELECT gold, predicted, correct, {_PRF} FROM t")
def span_f1_micro(spark, sf):
    m = fx.mentions(spark, sf)
    return metrics.micro(metrics.key_counts(fx.entities(m, "gold"), fx.entities(m, "v2"), _BY, ["start", "end", "type"]))


@query(f"{DUCK}, c AS ({_counts('gold', 'v2', 'doc_id', _SPAN)}), s AS (SELECT {_PRF} FROM c) SELECT count(*) AS units, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(f1), 4) AS f1 FROM s")
def span_f1_macro(spark, sf):
    m = fx.mentions(spark, sf)
    return metrics.macro(metrics.key_counts(fx.entities(m, "gold"), fx.entities(m, "v2"), _BY, ["start", "end", "type"]))


@query(f"{DUCK}, c AS ({_counts('gold', 'v1', 'lang, doc_id', _SPAN)}), t AS (SELECT CASE WHEN grouping(lang) = 1 THEN 'all' ELSE lang END AS lang, sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c GROUP BY ROLLUP (lang)) SELECT lang, gold, predicted, correct, {_PRF} FROM t")
def f1_by_language_rollup(spark, sf):
    m = fx.mentions(spark, sf)
    return metrics.micro_with_total(metrics.key_counts(fx.entities(m, "gold"), fx.entities(m, "v1"), ["lang", "doc_id"], ["start", "end", "type"]), "lang")


@query(f"{DUCK}, c AS ({_counts('gold', 'v2', 'doc_id', 'name, type')}), t AS (SELECT sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c) SELECT gold, predicted, correct, {_PRF} FROM t")
def text_f1(spark, sf):
    m = fx.mentions(spark, sf)
    named = lambda w: fx.entities(m, w).withColumn("name", T.norm("text"))
    return metrics.micro(metrics.key_counts(named("gold"), named("v2"), _BY, ["name", "type"]))


@query(f"{DUCK}, c AS ({_counts('gold', 'v2', 'doc_id', 'name', False)}), t AS (SELECT sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c) SELECT gold, predicted, correct, {_PRF} FROM t")
def relaxed_text_f1(spark, sf):
    """One-to-one matches of equal normalized texts, types aside: lists, not sets."""
    m = fx.mentions(spark, sf)
    named = lambda w: fx.entities(m, w).withColumn("name", T.norm("text"))
    return metrics.micro(metrics.multiset_counts(named("gold"), named("v2"), _BY, ["name"]))


@query(f"{DUCK}, c AS ({_counts('rgold', 'rv2', 'doc_id', 'source_id, type, target_id, claim_status')}), t AS (SELECT sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c) SELECT gold, predicted, correct, {_PRF} FROM t")
def claim_f1(spark, sf):
    m = fx.mentions(spark, sf)
    return metrics.micro(metrics.key_counts(fx.relations(m, "gold"), fx.relations(m, "v2"), _BY, ["source_id", "type", "target_id", "claim_status"]))


@query(f"""{_VER}, g AS (SELECT lang, count(*) AS relations, count(*) FILTER (WHERE NOT list_contains(why, 'missing_or_malformed_relation_evidence')) AS covered, count(*) FILTER (WHERE NOT list_contains(why, 'missing_or_malformed_relation_evidence') AND NOT list_contains(why, 'entities_not_co_present_in_relation_evidence')) AS supported, count(*) FILTER (WHERE len(why) > 0) AS invalid FROM ver GROUP BY lang)
SELECT lang, relations, round(covered / relations, 4) AS coverage, round(supported / relations, 4) AS correctness, round((relations - supported) / relations, 4) AS unsupported_rate, round(invalid / relations, 4) AS invalid_rate FROM g""")
def evidence_rates(spark, sf):
    return metrics.evidence_rates(_verified(spark, sf), ["lang"])


def _named_relations(m, which):
    e = fx.entities(m, which)
    x = gate.with_endpoints(fx.relations(m, which), e, _BY, ("text", "type")).filter("source_known AND target_known")
    return x.select("doc_id", "lang", T.norm("source_text").alias("s_name"), F.col("source_type").alias("s_type"), "type", T.norm("target_text").alias("t_name"), F.col("target_type").alias("t_type"))


def _duck_named(rel: str, ent: str) -> str:
    return f"SELECT r.doc_id, r.lang, s.name AS s_name, s.type AS s_type, r.type, t.name AS t_name, t.type AS t_type FROM {rel} r JOIN {ent} s ON s.doc_id = r.doc_id AND s.id = r.source_id JOIN {ent} t ON t.doc_id = r.doc_id AND t.id = r.target_id"


_NAMED = f"{DUCK}, gr AS MATERIALIZED ({_duck_named('rgold', 'gold')}), pr AS MATERIALIZED ({_duck_named('rv2', 'v2')})"


@query(f"""{_NAMED}, c AS (SELECT CASE
 WHEN EXISTS (SELECT 1 FROM gr g WHERE g.doc_id = p.doc_id AND g.s_name = p.s_name AND g.s_type = p.s_type AND g.type = p.type AND g.t_name = p.t_name AND g.t_type = p.t_type) THEN 'strict_match'
 WHEN NOT (EXISTS (SELECT 1 FROM gold e WHERE e.doc_id = p.doc_id AND e.name = p.s_name AND e.type = p.s_type) AND EXISTS (SELECT 1 FROM gold e WHERE e.doc_id = p.doc_id AND e.name = p.t_name AND e.type = p.t_type)) THEN
   CASE WHEN EXISTS (SELECT 1 FROM gold e WHERE e.doc_id = p.doc_id AND (e.name = p.s_name OR e.name = p.t_name)) THEN 'entity_type_or_boundary_error' ELSE 'unsupported_or_hallucinated_endpoint' END
 WHEN EXISTS (SELECT 1 FROM gr g WHERE g.doc_id = p.doc_id AND g.s_name = p.s_name AND g.t_name = p.t_name) THEN 'wrong_relation_type'
 WHEN EXISTS (SELECT 1 FROM gr g WHERE g.doc_id = p.doc_id AND g.s_name = p.t_name AND g.t_name = p.s_name AND g.type = p.type) THEN 'reversed_direction'
 WHEN EXISTS (SELECT 1 FROM gr g WHERE g.doc_id = p.doc_id AND g.s_name = p.t_name AND g.t_name = p.s_name) THEN 'reversed_direction_and_type'
 ELSE 'unsupported_entity_pair' END AS category FROM pr p) SELECT 'predicted' AS side, category, count(*) AS n FROM c GROUP BY ALL
UNION ALL SELECT 'missed', category, count(*) FROM (SELECT CASE
 WHEN EXISTS (SELECT 1 FROM v2 e WHERE e.doc_id = p.doc_id AND e.name = p.s_name AND e.type = p.s_type) AND EXISTS (SELECT 1 FROM v2 e WHERE e.doc_id = p.doc_id AND e.name = p.t_name AND e.type = p.t_type) THEN
   CASE WHEN EXISTS (SELECT 1 FROM pr g WHERE g.doc_id = p.doc_id AND g.s_name = p.s_name AND g.t_name = p.t_name) THEN 'wrong_relation_type_or_claim'
   WHEN EXISTS (SELECT 1 FROM pr g WHERE g.doc_id = p.doc_id AND g.s_name = p.t_name AND g.t_name = p.s_name) THEN 'direction_error' ELSE 'relation_type_or_pair_error_with_recalled_entities' END
 WHEN EXISTS (SELECT 1 FROM v2 e WHERE e.doc_id = p.doc_id AND (e.name = p.s_name OR e.name = p.t_name)) THEN 'partial_entity_boundary_or_type_error' ELSE 'entity_recall_bottleneck' END AS category
 FROM gr p WHERE NOT EXISTS (SELECT 1 FROM pr g WHERE g.doc_id = p.doc_id AND g.s_name = p.s_name AND g.s_type = p.s_type AND g.type = p.type AND g.t_name = p.t_name AND g.t_type = p.t_type)) GROUP BY ALL""")
def relation_error_taxonomy(spark, sf):
    m = fx.mentions(spark, sf)
    gold, pred = _named_relations(m, "gold"), _named_relations(m, "v2")
    ents = lambda w: fx.entities(m, w).select("doc_id", T.norm("text").alias("name"), "type")
    a = metrics.classify_predicted(pred, gold, ents("gold"), _BY).select(F.lit("predicted").alias("side"), "category")
    b = metrics.classify_missed(gold, pred, ents("v2"), _BY).select(F.lit("missed").alias("side"), "category")
    return a.unionByName(b).groupBy("side", "category").agg(F.count("*").alias("n"))


@query(f"""{_NAMED}, ge AS (SELECT doc_id, list(DISTINCT s_name || '|' || type || '|' || t_name) AS e FROM gr GROUP BY doc_id), pe AS (SELECT doc_id, list(DISTINCT s_name || '|' || type || '|' || t_name) AS e FROM pr GROUP BY doc_id),
gn AS (SELECT doc_id, list(DISTINCT name) AS n FROM gold GROUP BY doc_id), pn AS (SELECT doc_id, list(DISTINCT name) AS n FROM v2 GROUP BY doc_id), d AS (SELECT DISTINCT doc_id FROM m WHERE in_gold OR in_v2)
SELECT d.doc_id, round(CASE WHEN len(list_distinct(list_concat(coalesce(gn.n, []), coalesce(pn.n, [])))) = 0 THEN 1 ELSE len(list_intersect(coalesce(gn.n, []), coalesce(pn.n, []))) / len(list_distinct(list_concat(coalesce(gn.n, []), coalesce(pn.n, [])))) END, 4)::DOUBLE AS node_jaccard,
round(CASE WHEN len(list_distinct(list_concat(coalesce(ge.e, []), coalesce(pe.e, [])))) = 0 THEN 1 ELSE len(list_intersect(coalesce(ge.e, []), coalesce(pe.e, []))) / len(list_distinct(list_concat(coalesce(ge.e, []), coalesce(pe.e, [])))) END, 4)::DOUBLE AS edge_jaccard
FROM d LEFT JOIN ge USING (doc_id) LEFT JOIN pe USING (doc_id) LEFT JOIN gn USING (doc_id) LEFT JOIN pn USING (doc_id)""")
def graph_jaccard(spark, sf):
    m = fx.mentions(spark, sf)
    sets = {w: graph.node_edge_sets(fx.entities(m, w).withColumn("name", T.norm("text")), _named_relations(m, w), _BY) for w in ("gold", "v2")}
    x = sets["gold"].join(sets["v2"].withColumnsRenamed({"nodes": "nodes2", "edges": "edges2"}), "doc_id", "full")
    e = F.array().cast("array<string>")
    for c in ("nodes", "edges", "nodes2", "edges2"):
        x = x.withColumn(c, F.coalesce(c, e))
    return x.select("doc_id", metrics.jaccard("nodes", "nodes2").alias("node_jaccard"), metrics.jaccard("edges", "edges2").alias("edge_jaccard"))


@query(f"""{_NAMED}, c AS ({_counts("(SELECT * FROM gr WHERE type = 'linked_to')", "(SELECT * FROM pr WHERE type = 'linked_to')", 'doc_id', 's_name, t_name')}), t AS (SELECT sum(gold)::BIGINT AS gold, sum(predicted)::BIGINT AS predicted, sum(correct)::BIGINT AS correct FROM c) SELECT gold, predicted, correct, {_PRF} FROM t""")
def causal_edge_f1(spark, sf):
    """F1 over the edges of one family of relation types."""
    m = fx.mentions(spark, sf)
    own = lambda w: _named_relations(m, w).filter("type = 'linked_to'")
    return metrics.micro(metrics.key_counts(own("gold"), own("v2"), _BY, ["s_name", "t_name"]))


@query(f"{DUCK} SELECT d.doc_id, coalesce(n, 0) AS n_rows, n IS NULL AS missing FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n FROM v1 GROUP BY doc_id) USING (doc_id)")
def missing_as_empty(spark, sf):
    m = fx.mentions(spark, sf)
    return metrics.with_missing_as_empty(read(spark, sf, "documents").select("doc_id"), fx.entities(m, "v1"), _BY)


@query("SELECT DISTINCT doc_id, 'missing' AS why FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT DISTINCT doc_id, 'unexpected' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def anti_unknown_ids(spark, sf):
    return contracts.missing_keys(read(spark, sf, "documents"), read(spark, sf, "labels"), ["doc_id"])


@query("SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def duplicate_job_ids(spark, sf):
    return contracts.duplicate_keys(read(spark, sf, "conversations"), ["conv_id"])


@query("SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS position, md5(text) AS h FROM documents")
def shard_union_order(spark, sf):
    """Three disjoint shards as one table in the jobs' order."""
    d = read(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"))
    jobs = positions(d.select("doc_id", (-F.col("doc_id")).alias("o")), ["o"]).select("doc_id", (F.col("position") + 1).cast("int").alias("position"))
    return contracts.union_shards([d.filter(F.col("doc_id") % 3 == k) for k in (2, 0, 1)], ["doc_id"], jobs)


# --- knowledge graph --------------------------------------------------------------------------------------------------


_CANON = f"{DUCK}, canon AS MATERIALIZED (SELECT * REPLACE ({duck_strip('name')} AS name) FROM gold)"


@query(f"{_CANON} SELECT lang, type, name AS canonical_name, count(*) AS mention_count, list(DISTINCT doc_id ORDER BY doc_id) AS source_documents, 'concept_' || substr(sha1(lang || '|' || type || '|' || name), 1, 16) AS concept_id FROM canon GROUP BY lang, type, name")
def concept_agg(spark, sf):
    e = fx.entities(fx.mentions(spark, sf), "gold")
    return kg.build_concepts(e).select("lang", "type", "canonical_name", "mention_count", "source_documents", "concept_id")


_CAT = f"""{_CANON}, k AS (SELECT lang, type, name, count(*) AS n, list(DISTINCT doc_id ORDER BY doc_id) AS docs FROM canon WHERE name <> '' GROUP BY ALL), cat AS MATERIALIZED (SELECT lang, name, type, round(n / total, 4)::DOUBLE AS purity, n AS support, docs FROM (SELECT *, sum(n) OVER (PARTITION BY lang, name) AS total, row_number() OVER (PARTITION BY lang, name ORDER BY n DESC, type) AS rk FROM k) WHERE rk = 1)"""


def _catalog(m):
    c = fx.concepts(m).select("lang", "type", F.col("name").alias("canonical_name"), "mention_count", F.col("docs").alias("source_documents"))
    return kg.anchor_catalog(c)


@query(f"{_CAT} SELECT lang, name, type, purity, support::BIGINT AS support, docs FROM cat")
def type_purity_anchors(spark, sf):
    return _catalog(fx.mentions(spark, sf))


@query(f"""{_NAMED}, c AS (SELECT * REPLACE ({duck_strip('s_name')} AS s_name, {duck_strip('t_name')} AS t_name) FROM gr) SELECT lang, s_name AS source, s_type AS source_type, type AS relation, t_name AS target, t_type AS target_type, count(*) AS support, list(DISTINCT doc_id ORDER BY doc_id) AS docs FROM c WHERE s_name <> t_name AND s_name <> '' AND t_name <> '' GROUP BY ALL""")
def edge_support(spark, sf):
    m = fx.mentions(spark, sf)
    con = kg.build_concepts(fx.entities(m, "gold").withColumn("text", T.norm("text")))
    key = lambda p: concept_id("lang", f"{p}_type", f"{p}_name")
    r = _named_relations(m, "gold").select("doc_id", "type", key("s").alias("source_concept"), key("t").alias("target_concept"))
    return kg.edge_catalog(r, con)


_WORDS = "list_filter(string_split_regex({}, '[^\\pL\\pN]+'), x -> x <> '')"


@query()
def leave_one_doc_out_anchors(spark, sf):
    m = fx.mentions(spark, sf)
    seg = read(spark, sf, "documents").select("doc_id", "lang", F.explode(F.split("text", "\n")).alias("text"))
    return kg.exact_anchors(seg, _catalog(m))


@query(f"{_CANON}, k AS (SELECT lang, type, name, count(*) AS n FROM canon GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang, type ORDER BY n DESC, name) AS round FROM k), q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY round, type) AS rank FROM r) SELECT lang, type, name, n, rank FROM q WHERE rank <= 20")
def round_robin_topk(spark, sf):
    k = fx.concepts(fx.mentions(spark, sf)).select("lang", "type", "name", F.col("mention_count").alias("n"))
    return kg.round_robin(k, ["lang"], "type", [F.desc("n"), "name"], 20).drop("round")


@query(f"{_NAMED} SELECT type AS relation, list(DISTINCT s_type ORDER BY s_type) AS source_types, list(DISTINCT t_type ORDER BY t_type) AS target_types, count(*) AS n FROM gr GROUP BY type")
def train_ontology(spark, sf):
    r = _named_relations(fx.mentions(spark, sf), "gold")
    return r.groupBy(F.col("type").alias("relation")).agg(F.array_sort(F.collect_set("s_type")).alias("source_types"), F.array_sort(F.collect_set("t_type")).alias("target_types"), F.count("*").alias("n"))


_SPLIT = """(SELECT doc_id, CASE WHEN k <= q THEN 'test' WHEN k <= 2 * q THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('42:' || doc_id), doc_id) AS k, greatest(1, round_even(count(*) OVER (PARTITION BY source) * 0.15::DOUBLE, 0)) AS q FROM documents))"""


def _splits(spark, sf):
    return splitting.split_15_15_70(read(spark, sf, "documents").select("doc_id", "source"), "source", "doc_id").select("doc_id", "split")


@query(f"SELECT doc_id, split FROM {_SPLIT}")
def hash_split(spark, sf):
    return _splits(spark, sf)


@query(f"""{DUCK}, sp AS {_SPLIT}, tr AS (SELECT DISTINCT lang, type, name FROM gold JOIN sp USING (doc_id) WHERE split = 'train')
SELECT split, count(*) AS mentions, round(avg(CASE WHEN tr.name IS NULL THEN 0 ELSE 1 END), 4) AS known FROM gold g JOIN sp USING (doc_id) LEFT JOIN tr ON tr.lang = g.lang AND tr.type = g.type AND tr.name = g.name GROUP BY split""")
def kg_coverage(spark, sf):
    e = fx.entities(fx.mentions(spark, sf), "gold").select("doc_id", "lang", "type", T.norm("text").alias("name")).join(_splits(spark, sf), "doc_id")
    known = e.filter("split = 'train'").select("lang", "type", "name").distinct().withColumn("hit", F.lit(1))
    return e.join(known, ["lang", "type", "name"], "left").groupBy("split").agg(F.count("*").alias("mentions"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("known"))


@query(f"""{_CANON}, sp AS {_SPLIT}, k AS (SELECT lang, type, name, unnest(list(DISTINCT doc_id)) AS doc_id FROM canon GROUP BY lang, type, name) SELECT lang, type, name, list(doc_id ORDER BY doc_id) AS outside FROM k JOIN sp USING (doc_id) WHERE split <> 'train' GROUP BY lang, type, name""")
def leakage_audit(spark, sf):
    c = fx.concepts(fx.mentions(spark, sf)).select("lang", "type", "name", "docs")
    return splitting.leakage(c, "docs", _splits(spark, sf))


@query(f"""{DUCK}, e AS (SELECT DISTINCT doc_id, source_id AS id FROM rgold UNION SELECT doc_id, target_id FROM rgold), g AS (SELECT lang, count(*) AS entities, count(*) FILTER (WHERE e.id IS NULL) AS alone FROM gold LEFT JOIN e ON e.doc_id = gold.doc_id AND e.id = gold.id GROUP BY lang),
r AS (SELECT lang, count(*) AS relations FROM rgold GROUP BY lang) SELECT g.lang, entities, relations, alone, round(alone / entities, 4) AS isolated_share, round(relations / entities, 4) AS relation_ratio FROM g JOIN r ON g.lang = r.lang""")
def isolated_share(spark, sf):
    m = fx.mentions(spark, sf)
    e, r = fx.entities(m, "gold"), fx.relations(m, "gold")
    lone = graph.isolated(e, r, _BY, "id", "source_id", "target_id").groupBy("lang").agg(F.count("*").alias("alone"))
    g = e.groupBy("lang").agg(F.count("*").alias("entities")).join(r.groupBy("lang").agg(F.count("*").alias("relations")), "lang").join(lone, "lang", "left").fillna(0, ["alone"])
    return g.select("lang", "entities", "relations", "alone", ratio("alone", "entities").alias("isolated_share"), ratio("relations", "entities").alias("relation_ratio"))


# --- sampling and statistics ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, source, rank FROM (SELECT d.doc_id, source, row_number() OVER (PARTITION BY source, quality ORDER BY sha256('7:' || d.doc_id), d.doc_id) AS rank, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id) WHERE rank <= 3""")
def stratified_sample(spark, sf):
    d = read(spark, sf, "documents").select("doc_id", "source").join(read(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return splitting.ranked(d, ["source", "quality"], 7, "doc_id").filter("rank <= 3").select("doc_id", "source", "rank")


@query("SELECT doc_id, lang FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50")
def hash_topn(spark, sf):
    return splitting.hash_top(read(spark, sf, "documents").select("doc_id", "lang"), 50, 42, "doc_id")


@query("""SELECT doc_id, source, lang, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars, doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, lang) AS n FROM (SELECT *, max(n_chars >= 2000) OVER (PARTITION BY source, lang) AS has_big FROM documents) WHERE n_chars >= 2000 OR NOT has_big)
WHERE i IN (round_even((n - 1) / 3, 0), round_even(2 * (n - 1) / 3, 0))""")
def median_pick(spark, sf):
    return splitting.median_picks(read(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), ["source", "lang"], "n_chars", "doc_id")


@query("""SELECT lang, count(n) AS count, round(avg(n), 4) AS mean, round(quantile_cont(n, 0.5), 4) AS median, round(stddev_pop(n), 4) AS std, round(stddev_pop(n) / avg(n), 4) AS cv, round(min(n), 4)::DOUBLE AS min, round(quantile_cont(n, 0.9), 4) AS p90, round(quantile_cont(n, 0.95), 4) AS p95, round(max(n), 4)::DOUBLE AS max, round(quantile_cont(n, 0.75) - quantile_cont(n, 0.25), 4) AS iqr FROM (SELECT lang, n_chars::DOUBLE AS n FROM documents) GROUP BY lang""")
def describe_stats(spark, sf):
    return metrics.describe(read(spark, sf, "documents"), "n_chars", ["lang"])


_DIST = """n AS (SELECT {by} AS g, {label} AS l, count(*) AS n FROM {t} GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY g) AS total, row_number() OVER (PARTITION BY g ORDER BY n DESC, l) AS r FROM n)
SELECT g AS {by}, max(total)::BIGINT AS total, count(*) AS labels, count(*) FILTER (WHERE n = 1) AS singletons, round(count(*) FILTER (WHERE n = 1) / count(*), 4) AS singleton_share, round(sum(n) FILTER (WHERE r <= 5) / max(total), 4)::DOUBLE AS top5_share, round(sum(-(n / total) * log2(n / total)), 4) AS entropy, round(CASE WHEN count(*) > 1 THEN sum(-(n / total) * log2(n / total)) / log2(count(*)) ELSE 0 END, 4) AS normalized_entropy FROM t GROUP BY g"""


@query("WITH " + _DIST.format(by="l_returnflag", label="l_partkey", t="lineitem"))
def label_entropy(spark, sf):
    return metrics.label_distribution(read(spark, sf, "lineitem"), "l_partkey", ["l_returnflag"])


@query("WITH " + _DIST.format(by="event_type", label="user_id", t="events"))
def top5_share(spark, sf):
    return metrics.label_distribution(read(spark, sf, "events"), "user_id", ["event_type"])


@query(f"""{DUCK}, n AS (SELECT type, count(*) AS n FROM gold GROUP BY type), w AS (SELECT type, n, sqrt(sum(n) OVER () / (4 * n)) AS r FROM n) SELECT type, n, round(least(r / avg(r) OVER (), 8), 4) AS weight FROM w""")
def class_weights(spark, sf):
    return metrics.class_weights(fx.entities(fx.mentions(spark, sf), "gold"), "type", fx.TYPES)


def _units(spark, sf):
    m = fx.mentions(spark, sf)
    count = lambda w: metrics.key_counts(fx.entities(m, "gold"), fx.entities(m, w), _BY, ["start", "end", "type"])
    a, b = count("v1"), count("v2")
    x = a.withColumnsRenamed({"predicted": "pred_a", "correct": "correct_a"}).join(b.select("doc_id", F.col("gold").alias("_g"), F.col("predicted").alias("pred_b"), F.col("correct").alias("correct_b")), "doc_id", "full")
    return x.select("doc_id", F.coalesce("gold", "_g", F.lit(0).cast("bigint")).alias("gold"), *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("pred_a", "correct_a", "pred_b", "correct_b")))


_UNITS = f"""{DUCK}, ca AS ({_counts('gold', 'v1', 'doc_id', _SPAN)}), cb AS ({_counts('gold', 'v2', 'doc_id', _SPAN)}), u AS MATERIALIZED (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS k, * FROM (SELECT coalesce(ca.doc_id, cb.doc_id) AS doc_id, coalesce(ca.gold, cb.gold) AS gold, coalesce(ca.predicted, 0) AS pa, coalesce(ca.correct, 0) AS xa, coalesce(cb.predicted, 0) AS pb, coalesce(cb.correct, 0) AS xb FROM ca FULL JOIN cb ON ca.doc_id = cb.doc_id)), n AS (SELECT count(*) AS n FROM u)"""
_F1AB = "CASE WHEN g + pb = 0 THEN 0 ELSE 2.0 * xb / (g + pb) END - CASE WHEN g + pa = 0 THEN 0 ELSE 2.0 * xa / (g + pa) END"


@query(f"""{_UNITS}, d AS (SELECT iter, ((('0x' || substr(md5('b:' || iter || ':' || d), 1, 4))::BIGINT * 65536 + ('0x' || substr(md5('b2:' || iter || ':' || d), 1, 4))::BIGINT) % n) AS k FROM (SELECT unnest(range(0, 50)) AS iter), (SELECT unnest(range(0, n)) AS d, n FROM n)),
s AS (SELECT iter, sum(gold)::BIGINT AS g, sum(pa)::BIGINT AS pa, sum(xa)::BIGINT AS xa, sum(pb)::BIGINT AS pb, sum(xb)::BIGINT AS xb FROM d JOIN u USING (k) GROUP BY iter), f AS (SELECT {_F1AB} AS diff FROM s) SELECT round(quantile_cont(diff::DOUBLE, 0.025), 4) AS lower, round(quantile_cont(diff::DOUBLE, 0.975), 4) AS upper FROM f""")
def bootstrap_ci(spark, sf):
    return resample.interval(resample.bootstrap(_units(spark, sf), "doc_id", 50), "diff")


@query(f"""{_UNITS}, x AS (SELECT iter, u.*, ('0x' || substr(md5('p:' || iter || ':' || k), 1, 4))::INT % 2 = 1 AS sw FROM u, (SELECT unnest(range(0, 50)) AS iter)),
s AS (SELECT iter, sum(gold)::BIGINT AS g, sum(CASE WHEN sw THEN pb ELSE pa END)::BIGINT AS pa, sum(CASE WHEN sw THEN xb ELSE xa END)::BIGINT AS xa, sum(CASE WHEN sw THEN pa ELSE pb END)::BIGINT AS pb, sum(CASE WHEN sw THEN xa ELSE xb END)::BIGINT AS xb FROM x GROUP BY iter), f AS (SELECT {_F1AB} AS diff FROM s),
o AS (SELECT {_F1AB} AS obs FROM (SELECT sum(gold)::BIGINT AS g, sum(pa)::BIGINT AS pa, sum(xa)::BIGINT AS xa, sum(pb)::BIGINT AS pb, sum(xb)::BIGINT AS xb FROM u)) SELECT round((count(*) FILTER (WHERE abs(diff) >= abs(obs)) + 1) / (count(*) + 1), 5) AS p FROM f, o""")
def permutation_p(spark, sf):
    u = _units(spark, sf)
    s = u.agg(*(F.sum(c).alias(c) for c in resample.COUNTS)).select((f1("gold", "pred_b", "correct_b", None) - f1("gold", "pred_a", "correct_a", None)).alias("d")).first()
    return resample.p_value(resample.permutation(u, "doc_id", 50), s["d"])


@query()
def bootstrap_ci_full(spark, sf):
    """With the reference's iterations; bootstrap_ci has those that its SQL can do."""
    return resample.interval(resample.bootstrap_many(_units(spark, sf), ITERATIONS), "diff")


@query()
def permutation_p_full(spark, sf):
    """With the reference's iterations; permutation_p has those that its SQL can do."""
    u = _units(spark, sf)
    s = u.agg(*(F.sum(c).alias(c) for c in resample.COUNTS)).select((f1("gold", "pred_b", "correct_b", None) - f1("gold", "pred_a", "correct_a", None)).alias("d")).first()
    return resample.p_value(resample.permutation_many(u, ITERATIONS), s["d"])


_SCORED = "SELECT doc_id, quality = 1 AS positive, (('0x' || substr(md5('s:' || doc_id), 1, 4))::INT % 1000 + CASE WHEN quality = 1 THEN 300 ELSE 0 END) / 1300.0 AS score FROM labels"


def _scored(spark, sf):
    l_ = read(spark, sf, "labels")
    return l_.select("doc_id", (F.col("quality") == 1).alias("positive"), ((h16(F.concat(F.lit("s:"), "doc_id")) % 1000 + F.when(F.col("quality") == 1, 300).otherwise(0)) / F.lit(1300.0)).alias("score"))


_SWEEP = f"""WITH s AS ({_SCORED}), t AS (SELECT threshold, count(*) FILTER (WHERE score > threshold AND positive) AS tp, count(*) FILTER (WHERE score > threshold AND NOT positive) AS fp, count(*) FILTER (WHERE NOT score > threshold AND positive) AS fn FROM s, (SELECT unnest([0.1, 0.25, 0.5, 0.65, 0.8])::DOUBLE AS threshold) GROUP BY threshold),
w AS (SELECT *, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 4)::DOUBLE AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 4)::DOUBLE AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 4)::DOUBLE AS f1 FROM t)"""


@query(f"{_SWEEP} SELECT * FROM w")
def threshold_sweep(spark, sf):
    return metrics.threshold_sweep(_scored(spark, sf), [0.1, 0.25, 0.5, 0.65, 0.8])


@query(f"{_SWEEP} SELECT * FROM w ORDER BY f1 DESC, recall DESC, precision DESC, tp + fp, threshold DESC LIMIT 1")
def best_threshold(spark, sf):
    return metrics.best_threshold(metrics.threshold_sweep(_scored(spark, sf), [0.1, 0.25, 0.5, 0.65, 0.8]))


@query(f"{DUCK}, s AS (SELECT doc_id, source_id, target_id, type, ('0x' || substr(md5(doc_id || source_id || type || target_id), 1, 4))::INT AS score FROM (SELECT a.doc_id, a.id AS source_id, b.id AS target_id, sig.relation AS type FROM v1 a JOIN v1 b ON a.doc_id = b.doc_id AND a.seg = b.seg AND a.id <> b.id JOIN sig ON sig.source_type = a.type AND sig.target_type = b.type)) SELECT doc_id, source_id, target_id, type, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, source_id, target_id ORDER BY score DESC, type) AS n FROM s) WHERE n = 1 AND score >= 32768")
def best_per_pair(spark, sf):
    score = lambda kind: h16(F.concat(F.col("doc_id").cast("string"), "source_id", kind, "target_id"))
    best = gate.best_pairs(fx.entities(fx.mentions(spark, sf, once=True), "v1"), fx.signatures(spark), _BY, score, 32768)
    return best.select("doc_id", "source_id", "target_id", "type", "score")


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query("""SELECT query, rank, round(score, 4) AS score FROM (SELECT q.vec_id AS query, list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0) WHERE rank <= 4""")
def cosine_topk(spark, sf):
    v = _vectors(spark, sf)
    return kg.cosine_topk(v.filter("id % 20 = 0"), v, 4).select("query", "rank", F.round("score", 4).alias("score"))


@query("""WITH r AS (SELECT q.vec_id AS query, q.label = b.label AS same, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 20 = 0), f AS (SELECT query, min(CASE WHEN same THEN rank END) AS first FROM r WHERE rank <= 20 GROUP BY query)
SELECT k, round(avg(CASE WHEN first <= k THEN 1 ELSE 0 END), 4) AS recall FROM f, (SELECT unnest([1, 5, 10, 20]) AS k) GROUP BY k""")
def topk_recall(spark, sf):
    v = _vectors(spark, sf)
    lab = v.select("id", "label")
    r = kg.cosine_topk(v.filter("id % 20 = 0"), v, 20).join(lab.withColumnsRenamed({"id": "query", "label": "want"}), "query").join(lab.withColumnsRenamed({"id": "match", "label": "got"}), "match")
    first = r.groupBy("query").agg(F.min(F.when(F.col("want") == F.col("got"), F.col("rank"))).alias("first"))
    return first.select("first", F.explode(F.array(*map(F.lit, (1, 5, 10, 20)))).alias("k")).groupBy("k").agg(F.round(F.avg(F.when(F.col("first") <= F.col("k"), 1).otherwise(0)), 4).alias("recall"))


# --- events, pages, conversations, star schema ------------------------------------------------------------------------


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS trailing_mean FROM events")
def trailing_mean(spark, sf):
    return metrics.trailing_mean(read(spark, sf, "events"), "value", ["user_id"], ["ts", "event_id"]).select("event_id", "trailing_mean")


@query("SELECT event_id, user_id, event_type, 'E' || row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS new_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 1")
def dedup_first_wins(spark, sf):
    e = gate.first_wins(read(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"])
    return gate.renumber(e, ["user_id"], ["ts", "event_id"], "E").select("event_id", "user_id", "event_type", "new_id")


@query("SELECT event_id, len(json_keys(props)) AS n_keys FROM events WHERE json_valid(props)")
def event_json_props(spark, sf):
    return read(spark, sf, "events").filter(F.try_parse_json("props").isNotNull()).select("event_id", F.size(F.json_object_keys("props")).cast("bigint").alias("n_keys"))


@query("""SELECT n_name, r_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def kg_star_join(spark, sf):
    o = read(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("t"))
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    n = read(spark, sf, "nation").join(F.broadcast(read(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return o.join(c, "o_custkey").join(F.broadcast(n), "n_nationkey").groupBy("n_name", "r_name").agg(F.sum("n").alias("orders"), F.round(F.sum("t"), 2).alias("total"))


@query("""WITH w AS (SELECT conv_id, turn, length(text) AS n FROM conversations) SELECT conv_id, count(*) AS turns, sum(n)::BIGINT AS chars, max(n)::BIGINT AS longest FROM w GROUP BY conv_id""")
def conversation_sizes(spark, sf):
    return read(spark, sf, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("bigint").alias("longest"))


@query("""WITH RECURSIVE c AS (SELECT conv_id, k, n, sum(n) OVER (PARTITION BY conv_id ORDER BY k) AS upto, count(*) OVER (PARTITION BY conv_id) AS total FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, length(coalesce(text, '')) AS n FROM conversations)),
e AS MATERIALIZED (SELECT a.conv_id, a.k, a.total, greatest(a.k + 1, max(b.k) + 1) AS stop FROM c a LEFT JOIN c b ON b.conv_id = a.conv_id AND b.k >= a.k AND b.upto - a.upto + a.n <= 600 GROUP BY a.conv_id, a.k, a.total),
w AS (SELECT conv_id, 1 AS "window", k AS "first", stop AS "end", total FROM e WHERE k = 0 UNION ALL SELECT w.conv_id, w."window" + 1, e.k, e.stop, w.total FROM w JOIN e ON e.conv_id = w.conv_id AND e.k = greatest(w."first" + 1, w."end" - 1) WHERE w."end" < w.total)
SELECT conv_id, "window"::INT AS "window", "first"::INT AS "first", "end"::INT AS "end" FROM w""")
def conversation_windows(spark, sf):
    c = read(spark, sf, "conversations").select("conv_id", "turn", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return windows.segment_windows(c, "conv_id", "turn", "n", 600, 1)


@query()
def html_text_strip(spark, sf):
    t = plain_text(F.coalesce("html", F.lit("")))
    return read(spark, sf, "pages").select("page_id", F.length(t).alias("n"), F.md5(t).alias("text_md5"))


@query("""SELECT doc_id, part, local_start, least(local_start + 1500, n)::INT AS local_end FROM (SELECT doc_id, n, unnest(CASE WHEN n <= 1500 THEN [0] ELSE range(0, greatest(n - 150, 1), 1350) END)::INT AS local_start, unnest(range(1, CASE WHEN n <= 1500 THEN 2 ELSE len(range(0, greatest(n - 150, 1), 1350)) + 1 END))::INT AS part FROM (SELECT doc_id, length(text) AS n FROM documents))""")
def fixed_windows(spark, sf):
    return windows.split_fixed(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "part", "local_start", "local_end")


@query()
def semantic_split(spark, sf):
    return windows.split_semantic(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "part", "local_start", "local_end")


_BIO = f"""{DUCK}, t AS (SELECT doc_id, seg, i, "start", "start" + length(tok) AS "end", CASE WHEN {fx._hk('bio:')} % 3 = 0 THEN 'O' WHEN {fx._hk('bio:')} % 3 = 1 THEN 'B-' || type_gold ELSE 'I-' || type_gold END AS label, {fx._hk('sc:')} / 65536.0 AS score FROM m)"""


def _bio(spark, sf):
    m = fx.mentions(spark, sf)
    h = h16(F.concat(F.lit("bio:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")))
    s = h16(F.concat(F.lit("sc:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string")))
    label = F.when(h % 3 == 0, "O").when(h % 3 == 1, F.concat(F.lit("B-"), "type_gold")).otherwise(F.concat(F.lit("I-"), "type_gold"))
    return m.select("doc_id", "seg", "i", "start", (F.col("start") + F.length("tok")).alias("end"), label.alias("label"), (s / F.lit(65536.0)).alias("score"))


@query(f"""{_BIO}, b AS (SELECT *, label <> 'O' AND (label[1] = 'B' OR NOT coalesce(lag(CASE WHEN label <> 'O' THEN label[3:] END) OVER w = label[3:], false) OR "start" > lag("end") OVER w + 1000) AS begins FROM t WINDOW w AS (PARTITION BY doc_id, seg ORDER BY i)),
r AS (SELECT *, sum(begins::INT) OVER (PARTITION BY doc_id, seg ORDER BY i) AS run FROM b) SELECT doc_id, seg, min(label[3:]) AS type, min("start") AS "start", max("end") AS "end", round(min(score), 6)::DOUBLE AS score FROM r WHERE label <> 'O' GROUP BY doc_id, seg, run""")
def bio_decode(spark, sf):
    return decode.decode_bio(_bio(spark, sf), ["doc_id", "seg"], "i", gap=1000).withColumn("score", F.round("score", 6))


@query(f"""{_BIO} SELECT doc_id, i, CASE WHEN label[1] = 'I' AND NOT coalesce(lag(label) OVER (PARTITION BY doc_id, seg ORDER BY i)[3:] = label[3:], false) THEN 'B-' || label[3:] ELSE label END AS repaired FROM t""")
def bio_repair(spark, sf):
    return decode.repair_bio(_bio(spark, sf), ["doc_id", "seg"], "i").select("doc_id", "i", "repaired")


@query()
def viterbi_decode(spark, sf):
    m = fx.mentions(spark, sf)
    labels = ["O", "B-X", "I-X"]
    lg = F.array(*(h16(F.concat(F.lit(f"l{k}:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"))) / F.lit(16384.0) for k in range(3)))
    return decode.viterbi_tokens(m.withColumn("logits", lg), ["doc_id", "seg"], "i", "logits", labels)


@query()
def split_allocator(spark, sf):
    d = read(spark, sf, "documents")
    d = d.select("doc_id", "source", "lang").join(corpus.near_clusters(corpus.simhash(d)), "doc_id")
    n = d.count()
    return splitting.allocate_clusters(d.select("cluster", "source", "lang"), {"train": n, "validation": n // 5, "test": n // 5}, ["source", "lang"])
