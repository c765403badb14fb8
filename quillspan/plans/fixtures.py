"""Annotation tables derived from ``documents``, the same in Spark and in the SQL of ``DUCK``.

Mentions are tokens (text split at blanks and line ends) chosen by MD5. Three sets overlap: gold, pred_v1 and pred_v2.
A mention's segment is its line. Relations join neighbouring mentions of a line. Only the chosen tokens leave the arrays
of a document, so no exploded table of all tokens exists.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions.digests import md5_second_bytes
from quillspan.functions.ids import h16
from quillspan.functions.text import MARKUP_PAIRS, bound, canonical_text, norm
from quillspan.sources.scratch import spread, written

TYPES = ["PER", "ORG", "LOC", "MISC"]
RELATIONS = ["works_for", "located_in", "linked_to"]
SIGNATURES = {
    "works_for": (["PER", "ORG"], ["ORG", "LOC"]),
    "located_in": (["PER", "LOC", "MISC"], ["PER", "LOC"]),
    "linked_to": (["ORG", "MISC"], ["PER", "MISC", "ORG"]),
}
CLAIMS = ["explicit", "inferred"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


SETS = ["gold", "v1", "v2"]
TEXTS, SIZE = 256, 1 << 20  # texts, and bytes, whose tokens are held at once; a longer text is held alone
_MENTION = pa.struct([("i", pa.int32()), ("tok", pa.string()), ("start", pa.int32()), *((f"in_{s}", pa.bool_()) for s in SETS), *((f"next_{s}", pa.int32()) for s in SETS), ("odd_v1", pa.bool_()), ("odd_v2", pa.bool_())])
_LINE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("seg", pa.int32()), ("seg_text", pa.string()), ("items", pa.list_(_MENTION))])


def _slices(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    first = size = 0
    for k, n in enumerate(pc.binary_length(whole.column(2)).to_pylist()):
        if k > first and (k - first == TEXTS or size + n > SIZE):
            yield whole.slice(first, k - first)
            first, size = k, 0
        size += n
    if whole.num_rows:
        yield whole.slice(first)


def _chosen(batches: Iterator[pa.RecordBatch], sets: Sequence[str] = SETS, whole_texts: bool = False) -> Iterator[pa.RecordBatch]:
    """Lines with mentions: each line once, its mentions as an array. next_*: i of the set's next mention in the line;
    odd_*: whether the set has it with another type. Only mentions of the named sets are chosen, and only these sets'
    hashes made. whole_texts: each text once, with or without mentions, as one line.

    A set is chosen by the first two bytes of an MD5 modulo a power of two, which the second byte decides. Tokens are
    numbers in arrays until they are chosen."""

    for part in (p for whole in batches for p in _slices(whole)):
        docs, langs, texts = (c.to_pylist() for c in part.columns)
        tokens, lines, first_line = [], [], 0  # tokens: doc, i, start, end, line; lines: start and end
        for k, text in enumerate(texts):
            chars = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            breaks = np.flatnonzero((chars == 32) | (chars == 10))
            starts, ends = np.append(0, breaks + 1), np.append(breaks, len(chars))
            i = np.flatnonzero(ends - starts >= 3)
            nl = breaks[chars[breaks] == 10]
            lines.append(np.stack([np.full(len(nl) + 1, k), np.arange(len(nl) + 1), np.append(0, nl + 1), np.append(nl, len(chars))]))
            tokens.append(np.stack([np.full(len(i), k), i, starts[i], ends[i], first_line + np.searchsorted(nl, starts[i])]))
            first_line += len(nl) + 1
        doc, i, start, end, line = np.concatenate(tokens, axis=1)
        ids = np.array(docs, np.int64)
        byte = lambda tag, rows: md5_second_bytes(tag, ids[doc[rows]], i[rows])
        gold = byte(b"", slice(None)) & 15 == 0
        held = [gold, np.zeros(len(i), bool), np.zeros(len(i), bool)]
        inside, outside = np.flatnonzero(gold), np.flatnonzero(~gold)
        if "gold" not in sets:
            held[0] = np.zeros(len(i), bool)
        for k in (k for k in (1, 2) if SETS[k] in sets):
            held[k][inside] = byte(b"v%d:" % k, inside) & 7 > 0
            held[k][outside] = byte(b"x%d:" % k, outside) & 63 == 0
        kept = np.flatnonzero(held[0] | held[1] | held[2])
        doc, i, start, end, line = (x[kept] for x in (doc, i, start, end, line))
        held = [h[kept] for h in held]
        columns = [pa.array(i, pa.int32()), pa.array([texts[d][a:b] for d, a, b in zip(doc.tolist(), start.tolist(), end.tolist(), strict=True)], pa.string()), pa.array(start, pa.int32()), *map(pa.array, held)]
        for h in held:
            own, after = np.flatnonzero(h), np.full(len(i), -1)
            same = line[own[1:]] == line[own[:-1]]
            after[own[:-1][same]] = i[own[1:][same]]
            columns.append(pa.array(after, pa.int32(), mask=after < 0))
        columns += [pa.array(byte(b"t%d:" % k, slice(None)) & 15 == 0 if SETS[k] in sets else np.zeros(len(i), bool)) for k in (1, 2)]
        if whole_texts:
            ends = pa.array(np.searchsorted(doc, np.arange(len(docs) + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([0] * len(docs), pa.int32()), part.column(2), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_MENTION)))], schema=_LINE)
            continue
        used, begins = np.unique(line, return_index=True)
        rows = np.concatenate(lines, axis=1)[:, used].T.tolist()
        ends = pa.array(np.append(begins, len(i)), pa.int32())
        heads = [[docs[d] for d, *_ in rows], [langs[d] for d, *_ in rows], [s for _, s, *_ in rows], [texts[d][a:b] for d, _, a, b in rows]]
        yield pa.RecordBatch.from_arrays([*(pa.array(h, f.type) for h, f in zip(heads, _LINE, strict=False)), pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, fields=list(_MENTION)))], schema=_LINE)


_LINES = "doc_id bigint, lang string, seg int, seg_text string, items array<struct<i:int,tok:string,start:int,in_gold:boolean,in_v1:boolean,in_v2:boolean,next_gold:int,next_v1:int,next_v2:int,odd_v1:boolean,odd_v2:boolean>>"


def _lines(docs: DataFrame, sets: Sequence[str] = SETS, whole_texts: bool = False) -> DataFrame:
    """What _chosen() finds in doc_id, lang and text, which isn't null, with types: doc_id, lang, seg, seg_text, items."""
    chosen = spread(docs).mapInArrow(partial(_chosen, sets=sets, whole_texts=whole_texts), _LINES)
    names = F.array(*map(F.lit, TYPES))

    def typed(x):
        digit = F.position(F.substring(F.md5(F.lower(x["tok"])), 8, 1), F.lit("0123456789abcdef")) - 1  # h16b() % 4 needs only its last one
        return bound(digit % 4, lambda kind: with_types(x, kind))

    def with_types(x, kind):
        flip = lambda which: F.when(x[f"odd_{which}"], (kind + 1) % 4).otherwise(kind)
        types = [F.get(names, k).alias(n) for k, n in ((kind, "type_gold"), (flip("v1"), "type_v1"), (flip("v2"), "type_v2"))]
        return F.struct(*(x[f.name].alias(f.name) for f in _MENTION if not f.name.startswith("odd_")), *types)

    return chosen.select("doc_id", "lang", "seg", "seg_text", F.transform("items", typed).alias("items"))


def mentions(spark: SparkSession, sf_dir: str, once: bool = False, sets: Sequence[str] = SETS) -> DataFrame:
    """doc_id, lang, i, tok, start, seg, seg_text; in_gold, in_v1, in_v2, the types there, and the next mention's i of each
    set in the line.

    One pass over each text chooses and places its mentions; they are written once and read by all branches of a query.
    A line is written once, with all its mentions, and read only by what needs its text. once: for a query of one branch;
    nothing is written. sets: those that the query uses; mentions of no other are there.
    """
    lines = _lines(documents(spark, sf_dir).select("doc_id", "lang", "text").filter("text is not null"), sets)
    lines = lines if once else written(lines, "mentions")
    return lines.select("doc_id", "lang", "seg", "seg_text", F.explode("items").alias("_m")).select("doc_id", "lang", "seg", "seg_text", "_m.*")


def neighbours(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """doc_id, lang, i, next_<which>, tok and next_tok of neighbouring mentions of a set in a line, from one pass over the
    texts: a set's own mentions stand beside each other in a line's array, so no join is needed."""
    lines = _lines(documents(spark, sf_dir).select("doc_id", "lang", "text").filter("text is not null"), [which])
    pairs = lambda x: F.transform(x, lambda m, k: F.struct(m["i"].alias("i"), m[f"next_{which}"].alias(f"next_{which}"), m["tok"].alias("tok"), F.get(x, k + 1)["tok"].alias("next_tok")))
    p = lines.select("doc_id", "lang", F.explode(pairs(F.col("items"))).alias("_p")).select("doc_id", "lang", "_p.*")
    return p.filter(F.col(f"next_{which}").isNotNull())


def texts_with_mentions(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """doc_id, lang, text (empty if null) and items, the set's mentions in order (i, tok, start, type), one row a text:
    what needs a text and its mentions together gets both from one pass, without a join or a shuffle."""
    d = documents(spark, sf_dir).select("doc_id", "lang", F.coalesce("text", F.lit("")).alias("text"))
    item = lambda m: F.struct(m["i"].alias("i"), m["tok"].alias("tok"), m["start"].alias("start"), m[f"type_{which}"].alias("type"))
    return _lines(d, [which], True).select("doc_id", "lang", F.col("seg_text").alias("text"), F.transform("items", item).alias("items"))


def entities(m: DataFrame, which: str) -> DataFrame:
    """Entities of gold, v1 or v2: doc_id, lang, id, i, text, type, seg, start, end, evidence."""
    ev = F.array(F.struct(F.col("seg_text").alias("text"), F.concat(F.lit("S"), F.col("seg") + 1).alias("segment_id"), "start", (F.col("start") + F.length("tok")).alias("end")))
    return m.filter(f"in_{which}").select("doc_id", "lang", F.concat(F.lit("E"), "i").alias("id"), "i", F.col("tok").alias("text"), F.col(f"type_{which}").alias("type"), "seg", "start", (F.col("start") + F.length("tok")).alias("end"), ev.alias("evidence"))


def gold_relation_type() -> Column:
    """The type of the relation that begins at mention i of doc_id."""
    return F.get(F.array(*map(F.lit, RELATIONS)), h16(F.concat(F.lit("r:"), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"))) % 3)


def relations(m: DataFrame, which: str) -> DataFrame:
    """Relations of gold or v2; those of v2 have wrong types, directions, claims, loops and evidence by hash."""
    r = m.filter(f"in_{which} and next_{which} is not null").withColumn("j", F.col(f"next_{which}"))
    key = lambda tag: F.concat(F.lit(tag), F.col("doc_id").cast("string"), F.lit(":"), F.col("i").cast("string"))
    kind = h16(key("r:")) % 3
    names = F.array(*map(F.lit, RELATIONS))
    claim = F.when(h16(key("rk:")) % 4 == 0, "inferred").otherwise("explicit")
    src, tgt, text = F.col("i"), F.col("j"), F.col("seg_text")
    if which != "gold":
        kind = F.when(h16(key("rt:")) % 8 == 0, (kind + 1) % 3).otherwise(kind)
        swap = h16(key("rr:")) % 16 == 0
        src, tgt = F.when(swap, F.col("j")).otherwise(F.col("i")), F.when(swap, F.col("i")).otherwise(F.col("j"))
        tgt = F.when(h16(key("rs:")) % 32 == 0, src).otherwise(tgt)
        claim = F.when(h16(key("rc:")) % 16 == 0, F.lit(None).cast("string")).otherwise(claim)
        text = F.when(h16(key("re:")) % 16 == 0, F.lit("")).otherwise(text)
    ev = F.array(F.struct(text.alias("text"), F.concat(F.lit("S"), F.col("seg") + 1).alias("segment_id")))
    return r.select("doc_id", "lang", F.concat(F.lit("R"), "i").alias("id"), F.col("i").alias("pos"), F.concat(F.lit("E"), src).alias("source_id"), F.get(names, kind).alias("type"), F.concat(F.lit("E"), tgt).alias("target_id"), claim.alias("claim_status"), ev.alias("evidence"))


def signatures(spark: SparkSession) -> DataFrame:
    """The ontology's legal (relation, source_type, target_type)."""
    rows = ", ".join(f"('{r}', '{a}', '{b}')" for r, (s, t) in SIGNATURES.items() for a in s for b in t)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS t(relation, source_type, target_type)")


def concepts(m: DataFrame, which: str = "gold") -> DataFrame:
    """Mentions by language, type and canonical text: name, mention_count, docs."""
    e = entities(m, which).withColumn("name", canonical_text("text"))
    return e.groupBy("lang", "type", "name").agg(F.count("*").alias("mention_count"), F.array_sort(F.collect_set("doc_id")).alias("docs"))


_H = "('0x' || substr(md5({}), 1, 4))::INT"
_H4 = "('0x' || substr(md5({}), 5, 4))::INT"


def _hk(tag: str, i: str = "i") -> str:
    return _H.format(f"'{tag}' || doc_id || ':' || {i}")


_T = "(['PER','ORG','LOC','MISC'])[{}+1]"
_R = "(['works_for','located_in','linked_to'])[{}+1]"
_NORM = r"replace(lower(trim(regexp_replace({}, '\s+', ' ', 'g'))), 'ß', 'ss')"
_SIG = ", ".join(f"('{r}','{a}','{b}')" for r, (s, t) in SIGNATURES.items() for a in s for b in t)


def duck_norm(x: str) -> str:
    return _NORM.format(x)


def duck_strip(x: str) -> str:
    """Outer markup off a normalized text: of nested pairs as many layers as the text can have is beyond one expression,
    so four, more than any token of the tables has; blanks inside tokens there are none."""
    pairs = " OR ".join(f"(t[1] = '{p[0]}' AND t[-1] = '{p[1]}')" for p in MARKUP_PAIRS)
    for _ in range(4):
        x = f"list_transform([{x}], lambda t: CASE WHEN length(t) >= 2 AND ({pairs}) THEN trim(t[2:-2]) ELSE t END)[1]"
    return x


def _duck_entities(which: str) -> str:
    return f"SELECT doc_id, lang, 'E' || i AS id, i, tok AS text, type_{which} AS type, seg, \"start\", \"start\" + length(tok) AS \"end\", seg_text, {duck_norm('tok')} AS name FROM m WHERE in_{which}"


def _duck_relations(which: str) -> str:
    kind, claim, src, tgt, text = f"({_hk('r:')} % 3)", f"CASE WHEN {_hk('rk:')} % 4 = 0 THEN 'inferred' ELSE 'explicit' END", "i", "j", "seg_text"
    if which != "gold":
        kind = f"(CASE WHEN {_hk('rt:')} % 8 = 0 THEN ({kind} + 1) % 3 ELSE {kind} END)"
        src, tgt = f"(CASE WHEN {_hk('rr:')} % 16 = 0 THEN j ELSE i END)", f"(CASE WHEN {_hk('rr:')} % 16 = 0 THEN i ELSE j END)"
        tgt = f"(CASE WHEN {_hk('rs:')} % 32 = 0 THEN {src} ELSE {tgt} END)"
        claim = f"CASE WHEN {_hk('rc:')} % 16 = 0 THEN NULL ELSE {claim} END"
        text = f"CASE WHEN {_hk('re:')} % 16 = 0 THEN '' ELSE seg_text END"
    return f"SELECT doc_id, lang, 'R' || i AS id, i AS pos, 'E' || {src} AS source_id, {_R.format(kind)} AS type, 'E' || {tgt} AS target_id, {claim} AS claim_status, {text} AS ev_text, 'S' || (seg + 1) AS ev_seg FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id, seg ORDER BY i) AS j FROM m WHERE in_{which}) WHERE j IS NOT NULL"


#: CTEs for the same tables: m, gold, v1, v2, rgold, rv2, sig.
DUCK = f"""
WITH tok AS (
  SELECT doc_id, lang, text, pos - 1 AS i, t AS tok,
         coalesce(sum(length(t) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::INT AS "start"
  FROM (SELECT doc_id, lang, text, unnest(string_split_regex(text, '[ \\n]')) AS t, generate_subscripts(string_split_regex(text, '[ \\n]'), 1) AS pos FROM documents)
), flagged AS (
  SELECT *, {_hk('')} % 16 = 0 AS in_gold, {_H4.format('lower(tok)')} % 4 AS k0 FROM tok WHERE length(tok) >= 3
), m AS MATERIALIZED (
  SELECT doc_id, lang, i, tok, "start", length(text[:"start"]) - length(replace(text[:"start"], chr(10), '')) AS seg,
         string_split(text, chr(10))[length(text[:"start"]) - length(replace(text[:"start"], chr(10), '')) + 1] AS seg_text,
         in_gold, in_v1, in_v2, {_T.format('k0')} AS type_gold, {_T.format('k1')} AS type_v1, {_T.format('k2')} AS type_v2
  FROM (SELECT *, CASE WHEN in_gold THEN {_hk('v1:')} % 8 <> 0 ELSE {_hk('x1:')} % 64 = 0 END AS in_v1, CASE WHEN in_gold THEN {_hk('v2:')} % 8 <> 0 ELSE {_hk('x2:')} % 64 = 0 END AS in_v2,
               CASE WHEN {_hk('t1:')} % 16 = 0 THEN (k0 + 1) % 4 ELSE k0 END AS k1, CASE WHEN {_hk('t2:')} % 16 = 0 THEN (k0 + 1) % 4 ELSE k0 END AS k2 FROM flagged)
  WHERE in_gold OR in_v1 OR in_v2
), gold AS MATERIALIZED ({_duck_entities('gold')}), v1 AS MATERIALIZED ({_duck_entities('v1')}), v2 AS MATERIALIZED ({_duck_entities('v2')}),
rgold AS MATERIALIZED ({_duck_relations('gold')}), rv2 AS MATERIALIZED ({_duck_relations('v2')}),
sig(relation, source_type, target_type) AS (VALUES {_SIG})
"""
