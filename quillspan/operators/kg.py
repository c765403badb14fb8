"""Knowledge-graph operators: catalogs with provenance, and context for jobs that leaves the job's document out."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.ids import concept_id
from quillspan.functions.text import content_length, norm, strip_markup
from quillspan.sources.scratch import written


TILE = 1024  # queries, and base rows, whose similarities are held at once


def build_concepts(mentions: DataFrame, lang: str = "lang", kind: str = "type", text: str = "text", doc: str = "doc_id") -> DataFrame:
    """concept_id, lang, type, canonical_name, mention_count, source_documents (sorted)."""
    m = mentions.withColumn("canonical_name", strip_markup(norm(text)))
    g = m.groupBy(F.col(lang).alias("lang"), F.col(kind).alias("type"), "canonical_name").agg(F.count("*").alias("mention_count"), F.array_sort(F.collect_set(doc)).alias("source_documents"))
    return g.withColumn("concept_id", concept_id("lang", "type", "canonical_name"))


def anchor_catalog(concepts: DataFrame) -> DataFrame:
    """lang, name, type, purity, support, docs: the type with most mentions of each name, of equal ones the least."""
    name = strip_markup(norm("canonical_name"))
    w = Window.partitionBy("lang", "name")
    c = concepts.select("lang", name.alias("name"), "type", F.greatest(F.coalesce("mention_count", F.lit(1)), F.lit(1)).alias("weight"), F.col("source_documents").alias("docs")).filter("name <> '' AND type <> ''")
    per_type = c.groupBy("lang", "name", "type").agg(F.sum("weight").alias("support"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("docs")))).alias("docs"))
    ranked = per_type.withColumn("total", F.sum("support").over(w)).withColumn("rank", F.row_number().over(w.orderBy(F.desc("support"), "type")))
    return ranked.filter("rank = 1").select("lang", "name", "type", F.round(F.col("support") / F.col("total"), 4).alias("purity"), "support", "docs")


def edge_catalog(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """lang, source, source_type, relation, target, target_type, support, docs. relations: source_concept, type,
    target_concept, doc_id. Both ends have one language and different names."""
    side = lambda p: concepts.select(F.col("concept_id").alias(f"{p}_concept"), F.col("lang").alias(f"{p}_lang"), strip_markup(norm("canonical_name")).alias(p), F.col("type").alias(f"{p}_type"))
    x = relations.join(side("source"), "source_concept").join(side("target"), "target_concept").filter("source_lang = target_lang AND source <> '' AND target <> '' AND source <> target")
    g = x.groupBy(F.col("source_lang").alias("lang"), "source", "source_type", F.col("type").alias("relation"), "target", "target_type")
    return g.agg(F.count("*").alias("support"), F.array_sort(F.collect_set("doc_id")).alias("docs"))


def names_in_segments(names: DataFrame, segments: DataFrame, by: list[str], lang: str = "lang", block: int = 200_000) -> DataFrame:
    """by, lang, name of every name that is part of a normalized text of its language, or of any if its own is unknown.

    names: lang, name. Texts are never compared with names one by one: an automaton finds all names of a block in one
    pass over a text. Blocks have about so many names, which bounds what is broadcast; texts are read once for each.
    """
    spark = segments.sparkSession
    wanted = names.select(lang, "name").distinct().filter("name <> ''")
    parts = max(1, -(-wanted.count() // block))
    fields = ", ".join(f"`{c}` {segments.schema[c].dataType.simpleString()}" for c in by)
    texts = segments.select(*by, F.col(lang).alias("_lang"), norm("text").alias("_text"))

    def search(rows: list[tuple[str, str]]) -> DataFrame:
        sent = spark.sparkContext.broadcast(rows)

        def run(frames):
            import ahocorasick
            import pandas as pd

            machines: dict = {}
            for own, name in sent.value:
                machines.setdefault(own, ahocorasick.Automaton()).add_word(name, name)
            for m in machines.values():
                m.make_automaton()
            for f in frames:
                out = []
                for row in f.itertuples(index=False):
                    for own in dict.fromkeys((row[-2], "unknown")):
                        if own in machines and row[-1]:
                            out += [(*row[:-2], own, name) for name in {v for _, v in machines[own].iter(row[-1])}]
                yield pd.DataFrame(out, columns=[*by, lang, "name"])

        return texts.mapInPandas(run, f"{fields}, `{lang}` string, name string")

    found = None
    for k in range(parts):
        rows = [(r[0], r[1]) for r in wanted.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()]
        one = search(rows)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def anchors_in_segments(anchors: DataFrame, segments: DataFrame, per_type: int, block: int = 200_000) -> DataFrame:
    """doc_id, lang, name, type, purity, support, chars of the anchors in a normalized text of their language (of any if
    their own is unknown) that can be among the first per_type of a type in its document, and that another document
    supports. anchors: lang, name, type, purity, support, _several, _witness.

    An automaton finds a block's names in one pass over a text, as in names_in_segments(); anchors are numbered in order
    of rank, so a text's first ones are known before they leave the task. A block is written before the next is sent.
    """
    spark = segments.sparkSession
    wanted = anchors.select("lang", "name", "type", "purity", "support", content_length("name").alias("chars"), "_several", "_witness").filter("lang is not null")
    parts = max(1, -(-wanted.count() // block))
    texts = segments.select("doc_id", F.col("lang").alias("_lang"), norm("text").alias("_text"))
    fields = [segments.schema["doc_id"], *wanted.schema.fields[:-2]]
    names, kinds = [f.name for f in fields], ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)

    def search(sent) -> DataFrame:
        def run(frames):
            import ahocorasick
            import pandas as pd

            rows, ranks, machines = sent.value, {}, {}
            for k, r in enumerate(rows):
                ranks.setdefault(r[:2], []).append(k)
            for (own, name), ks in ranks.items():
                machines.setdefault(own, ahocorasick.Automaton()).add_word(name, tuple(ks))
            for m in machines.values():
                m.make_automaton()
            for f in frames:
                out = []
                for doc, lang, text in f.itertuples(index=False, name=None):
                    for own in dict.fromkeys((lang, "unknown")):
                        taken: dict = {}
                        for k in sorted(k for ks in {ks for _, ks in machines[own].iter(text)} for k in ks) if own in machines and text else ():
                            *row, several, witness = rows[k]
                            n = taken.get(row[2], 0)
                            if n < per_type and (several or witness != doc):
                                taken[row[2]] = n + 1
                                out.append((doc, *row))
                yield pd.DataFrame(out, columns=names)

        return texts.mapInPandas(run, kinds)

    found = None
    for k in range(parts):
        rows = [tuple(r) for r in wanted.filter(F.pmod(F.xxhash64("name"), F.lit(parts)) == k).collect()]
        rows.sort(key=lambda r: (-r[5], -r[3], -r[4], r[2], r[1]))
        sent = spark.sparkContext.broadcast(rows)
        one = written(search(sent).distinct(), "anchors")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def exact_anchors(jobs: DataFrame, catalog: DataFrame, limit: int = 12, per_type: int = 2, min_purity: float = 0.8, min_chars: int = 4, min_chars_zh: int = 2) -> DataFrame:
    """doc_id, rank and the anchor, for jobs (doc_id, lang, text by segment): names of enough length and purity that
    other documents support and a segment holds, the longest first, not too many of a type."""
    least = F.when(F.col("lang") == "zh", min_chars_zh).otherwise(min_chars)
    fit = catalog.filter((content_length("name") >= least) & (F.col("purity") >= min_purity))
    fit = fit.withColumn("_several", F.size("docs") > 1).withColumn("_witness", F.get("docs", F.lit(0))).drop("docs")
    found = anchors_in_segments(written(fit, "catalog"), jobs, per_type)
    order = [F.desc("chars"), F.desc("purity"), F.desc("support"), "type", "name"]
    x = found.withColumn("of_type", F.row_number().over(Window.partitionBy("doc_id", "type").orderBy(*order))).filter(F.col("of_type") <= per_type)
    x = x.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("rank") <= limit)
    return x.select("doc_id", "rank", "name", "type", "purity", "support")


def round_robin(rows: DataFrame, by: list[str], kind: str, order: list, limit: int) -> DataFrame:
    """The first of each kind, then the second of each, and so on, up to the limit."""
    x = rows.withColumn("round", F.row_number().over(Window.partitionBy(*by, kind).orderBy(*order)))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("round", kind))).filter(F.col("rank") <= limit)


def top_k(rows: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def leave_one_out(rows: DataFrame, docs: str, doc: str) -> DataFrame:
    """Rows that some document other than doc supports; their support stays as it is."""
    return rows.filter(F.size(F.array_except(docs, F.array(doc))) > 0)


def cosine(a: str, b: str):
    """Of two arrays; 0 if one has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm2 = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = norm2(a) * norm2(b)
    return F.when(d == 0, 0.0).otherwise(dot / d)


def cosine_topk(queries: DataFrame, base: DataFrame, k: int, threshold: float = -1.0, block: int = 20_000) -> DataFrame:
    """query, match, score, rank: for a stated set of queries, the k most similar base rows of another id.

    queries, base: id, vec. Queries go to the base rows in blocks of about so many rows, which bounds what is broadcast;
    a partition keeps the best k of each query that it has seen, and only these are ranked together. Similarities are held
    for TILE queries and TILE base rows at once, whatever the numbers of both.
    """
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession

    def unit(vecs) -> np.ndarray:
        m = np.array(vecs.tolist(), np.float64)
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

    def search(ids: np.ndarray, mat: np.ndarray):
        sent = spark.sparkContext.broadcast((ids, mat))

        def run(frames):
            q, mat = sent.value
            best, names = np.full((len(q), k), -2.0), np.full((len(q), k), np.iinfo(np.int64).max)
            for f in frames:
                for at in range(0, len(f), TILE):
                    part = f.iloc[at : at + TILE]
                    own, vec = part["id"].to_numpy(np.int64), unit(part["vec"]).T
                    for r in range(0, len(q), TILE):
                        rows = slice(r, r + TILE)
                        s = mat[rows] @ vec
                        s[q[rows, None] == own[None, :]] = -2
                        s, n = np.hstack([best[rows], s]), np.hstack([names[rows], np.broadcast_to(own, s.shape)])
                        order = np.lexsort((n, -s), axis=1)[:, :k]
                        best[rows], names[rows] = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
            out = pd.DataFrame({"query": np.repeat(q, k), "match": names.ravel(), "score": best.ravel()})
            yield out[out["score"] > max(-1.5, threshold - 1e-12)]

        return base.select("id", "vec").mapInPandas(run, "query bigint, match bigint, score double")

    parts = max(1, -(-queries.count() // block))
    found = None
    for b in range(parts):
        q = queries.filter(F.pmod(F.xxhash64("id"), F.lit(parts)) == b).select("id", "vec").toPandas()
        if len(q):
            one = search(q["id"].to_numpy(), unit(q["vec"]))
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = spark.createDataFrame([], "query bigint, match bigint, score double")
    return top_k(found, ["query"], [F.desc("score"), "match"], k)
