"""Queries of adapters, tolerant places and negative spans, with equal SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspan.functions.ids import h16
from quillspan.operators import adapters, chunking
from quillspan.plans import fixtures as fx
from quillspan.plans.fixtures import DUCK, RELATIONS, TYPES, _hk
from quillspan.plans.queries import query, read
from quillspan.plans.windowing import SIZE, STRIDE
from quillspan.sources.scratch import written

WIDTH, SEED = 12, 7
_STEP = SIZE - STRIDE


@query(f"""{DUCK}, n AS (SELECT doc_id, len(list_filter(string_split_regex(coalesce(text, ''), '[ \\n]'), lambda x: x <> '')) AS n FROM documents), c0 AS (SELECT doc_id, n AS all_n, unnest(range(0, greatest(ceil((n - {SIZE}) / {_STEP}), 0)::BIGINT + 1)) AS chunk FROM n),
c AS (SELECT doc_id, chunk, least(all_n - chunk * {_STEP}, {SIZE}) AS n FROM c0),
w AS (SELECT doc_id, pos, t, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS g FROM (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]')) AS t, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS pos FROM documents) WHERE t <> ''),
pos AS (SELECT c.doc_id, chunk, g - chunk * {_STEP} AS s FROM c JOIN (SELECT w.doc_id, g FROM w JOIN gold ON gold.doc_id = w.doc_id AND gold.i = w.pos - 1) x ON x.doc_id = c.doc_id AND g >= chunk * {_STEP} AND g < chunk * {_STEP} + n),
np AS (SELECT doc_id, chunk, count(*) AS held FROM pos GROUP BY ALL),
e AS (SELECT doc_id, chunk, s, unnest(range(1, least({WIDTH}, n - s) + 1)) AS width FROM (SELECT doc_id, chunk, n, unnest(range(0, n)) AS s FROM c)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY s, width) - 1 AS k, count(*) OVER (PARTITION BY doc_id, chunk) AS total FROM e),
h AS (SELECT c.doc_id, c.chunk, coalesce(held, 0) AS held, ('0x' || substr(md5('{SEED}:' || c.doc_id || ':' || c.chunk), 1, 12))::BIGINT AS h FROM c LEFT JOIN np USING (doc_id, chunk)),
j AS (SELECT doc_id, chunk, held, total, h, unnest(range(0, total)) AS j FROM h JOIN (SELECT DISTINCT doc_id, chunk, total FROM k) USING (doc_id, chunk)),
p AS (SELECT doc_id, chunk, held, total, j, (({adapters.STEPS}::BIGINT[])[h % 8 + 1] * j + (h // 8) % total) % total AS k FROM j),
f AS (SELECT p.doc_id, p.chunk, s, width, row_number() OVER (PARTITION BY p.doc_id, p.chunk ORDER BY j) AS r, held, p.total FROM p JOIN k USING (doc_id, chunk, k) WHERE NOT EXISTS (SELECT 1 FROM pos WHERE pos.doc_id = p.doc_id AND pos.chunk = p.chunk AND pos.s = k.s AND width = 1))
SELECT doc_id, chunk::INT AS chunk, s::INT AS "start", width::INT AS width FROM f WHERE r <= least(greatest(held * 4, 8), total - held)""")
def negative_spans(spark, sf):
    """For each chunk, spans that are none of its mentions, four times as many, eight at least."""
    d = read(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tokens", chunking.token_places("text", "[^ \n]+"))
    starts = fx.entities(fx.mentions(spark, sf), "gold").groupBy("doc_id").agg(F.collect_set("start").alias("starts"))
    c = chunking.overlapping_chunks(d.select("doc_id", "tokens").join(starts, "doc_id", "left"), "tokens", SIZE, STRIDE)
    c = c.withColumn("n", F.size("tokens")).withColumn("starts", F.coalesce("starts", F.expr("cast(array() as array<int>)")))
    at = F.filter(F.transform("tokens", lambda t, i: F.when(F.array_contains("starts", t["start"]), F.struct(i.alias("start"), F.lit(1).alias("width")))), lambda p: p.isNotNull())
    got = adapters.negative_spans(written(c.select("doc_id", "chunk", "n", at.alias("positives")), "positives"), "n", "positives", F.concat_ws(":", "doc_id", "chunk"), WIDTH, 4, 8, SEED)
    return got.select("doc_id", "chunk", F.explode("negatives").alias("s")).select("doc_id", "chunk", "s.start", "s.width")


_HYPHENS = """replace({}, 'th', 't- ' || chr(10) || 'h')"""


@query(f"""{DUCK}, u AS (SELECT doc_id, i, replace(tok, 'th', 't-h') AS needle, row_number() OVER (PARTITION BY doc_id, tok ORDER BY i) AS k FROM v2 JOIN (SELECT doc_id, i, tok FROM m) USING (doc_id, i)),
x AS (SELECT u.*, {_HYPHENS.format('d.text')} AS t, replace(regexp_escape(needle), '\\-', '-\\s*') AS pat FROM u JOIN documents d USING (doc_id)),
y AS (SELECT doc_id, i, needle, k, string_split_regex(t, pat) AS gaps, regexp_extract_all(t, pat) AS hits FROM x), z AS (SELECT *, least(k, len(hits)) AS n FROM y)
SELECT doc_id, i, (list_sum(list_transform(gaps[1:n], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:n - 1], lambda g: length(g))), 0))::INT AS "start", (list_sum(list_transform(gaps[1:n], lambda g: length(g))) + list_sum(list_transform(hits[1:n], lambda g: length(g))))::INT AS "end" FROM z WHERE n > 0""")
def tolerant_locate(spark, sf):
    """Mentions in texts whose th are broken at a hyphen: the k-th use of a mention has its k-th place."""
    uses = fx.mentions(spark, sf).filter("in_v2").select("doc_id", F.col("i").alias("position"), F.regexp_replace("tok", "th", "t-h").alias("text"))
    broken = read(spark, sf, "documents").select("doc_id", F.lit(0).alias("index"), F.lit("S1").alias("segment_id"), F.lit(0).alias("start"), F.regexp_replace("text", "th", "t- \nh").alias("text"))
    return adapters.located(uses, broken, ["doc_id"]).filter("start is not null").select("doc_id", F.col("position").alias("i"), "start", "end")


def _native(spark, sf):
    """What a span model may give for a document: mentions by number of their token, some out of range or of no type."""
    h = lambda tag, m: h16(F.concat(F.lit(tag), F.col("doc_id").cast("string"), F.lit(":"), m["i"].cast("string")))
    kinds = F.array(*map(F.lit, [*RELATIONS, "other"]))
    ent = lambda m: F.struct(F.when(h("ns:", m) % 16 == 0, -1).otherwise(m["i"]).alias("start"), (m["i"] + 1).alias("end"), F.when(h("nt:", m) % 16 == 0, "THING").otherwise(m["type"]).alias("type"))
    rel = lambda m, k: F.struct(k.alias("head"), (k + 1).alias("tail"), F.get(kinds, h("nr:", m) % 4).alias("type"))
    d = fx.texts_with_mentions(spark, sf, "v1").filter(F.size("items") > 0)
    return d.select("doc_id", "text", F.split("text", "[ \n]", -1).alias("tokens"), F.transform("items", ent).alias("entities"), F.transform("items", rel).alias("relations"))


_NATIVE = f"""{DUCK}, ne AS (SELECT doc_id, "start", "end", text, {_hk('ns:')} % 16 = 0 AS out, {_hk('nt:')} % 16 = 0 AS odd, type, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, ([{', '.join(repr(r) for r in RELATIONS)}, 'other'])[{_hk('nr:')} % 4 + 1] AS kind FROM v1)"""


@query(f"""{_NATIVE} SELECT doc_id, 'E' || k AS id, text, type, "start", "end" FROM ne WHERE NOT out AND NOT odd""")
def adapt_span_entities(spark, sf):
    return adapters.from_token_spans(_native(spark, sf), "doc_id", TYPES, RELATIONS)[0]


@query(f"""{_NATIVE}, r AS (SELECT a.doc_id, a.k, a.kind, a."start" AS s, b."end" AS e, NOT a.out AND NOT a.odd AND coalesce(NOT b.out AND NOT b.odd, false) AS good FROM ne a LEFT JOIN ne b ON b.doc_id = a.doc_id AND b.k = a.k + 1)
SELECT doc_id, 'R' || k AS id, 'E' || k AS source_id, kind AS type, 'E' || (k + 1) AS target_id, s AS "start", e AS "end" FROM r WHERE good AND kind <> 'other'""")
def adapt_span_relations(spark, sf):
    return adapters.from_token_spans(_native(spark, sf), "doc_id", TYPES, RELATIONS)[1]


@query(f"""{_NATIVE}, r AS (SELECT a.doc_id, a.kind, NOT a.out AND NOT a.odd AND coalesce(NOT b.out AND NOT b.odd, false) AS good FROM ne a LEFT JOIN ne b ON b.doc_id = a.doc_id AND b.k = a.k + 1)
SELECT doc_id, kind, count(*) AS n FROM (SELECT doc_id, CASE WHEN out THEN 'invalid_entity_span' ELSE 'unknown_entity_type' END AS kind FROM ne WHERE out OR odd UNION ALL SELECT doc_id, CASE WHEN NOT good THEN 'invalid_relation_endpoint' ELSE 'unknown_relation_type' END FROM r WHERE NOT good OR kind = 'other') GROUP BY ALL""")
def adapt_span_issues(spark, sf):
    return adapters.from_token_spans(_native(spark, sf), "doc_id", TYPES, RELATIONS)[2].groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query()
def adapt_list_entities(spark, sf):
    """Names of mentions, some in capitals, with their labels in another case; each takes the next unused place."""
    d = read(spark, sf, "documents").filter("text is not null").select("doc_id", "text")
    m = fx.mentions(spark, sf).filter("in_v1")
    loud = h16(F.concat(F.lit("up:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"))) % 8 == 0
    one = F.struct("i", F.struct(F.when(loud, F.upper("tok")).otherwise(F.col("tok")).alias("name"), F.lower("type_v1").alias("type")).alias("e"))
    rows = d.join(m.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("_e")).select("doc_id", F.transform("_e", lambda x: x["e"]).alias("entities")), "doc_id")
    rows = rows.withColumn("relations", F.expr("cast(array() as array<struct<head:string,relation:string,tail:string>>)"))
    return adapters.from_lists(rows, "doc_id", TYPES, RELATIONS)[0]
