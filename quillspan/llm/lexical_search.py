"""Ranked search by words: postings as a table bucketed by term, joined with the items' terms and summed.

A posting has a term, its document, the occurrences there and the document's length. Postings are written in folders by
a hash of the term, so that a search reads the buckets of its terms only; a bucket that a frequent term makes large is
dealt over several files. Documents enter as rows of the empty term, which no text has, so that the same table tells how
many documents and terms there are.

Weights and impacts are whole numbers, as the ranking is defined: a term's share of a document's score depends on the
posting alone and is worked out once. Postings of the items' terms are then dealt by document, in narrow rows, and joined
with the items of their term there: matches, many times as many, are summed by item and document where they arise. Row
numbers choose the best, each task's own first, before anything is brought together by item. The items' side of the joins
is a written table; Spark broadcasts it if its files are below the session's threshold, and shuffles otherwise.

Defined results: a null or empty text has no terms, an item without terms no results; rows of one document id are
documents of their own, told apart by their place; rows of one item id are one item, its terms counted once. A null id is
an id. Equal scores go by id, then by place. Empty tables give no rows. Extra columns are left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.llm.common import stash, table

#: Folders of the postings, and postings that leave a worker at once.
BUCKETS, FLUSH = 64, 100_000
TOP = 10
#: A-Z in lower case; what no term holds, as a blank. Bytes from 128 on belong to terms.
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def terms(text: str) -> list[bytes]:
    """A text's terms in order, as UTF-8: runs of ASCII letters, digits and all that isn't ASCII; A-Z lower-cased."""
    return text.encode("utf-8").translate(_FOLD).split()


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def item_terms(items: DataFrame, text: str = "text", id_col: str = "item_id") -> DataFrame:
    """id_col and term, each pair once."""
    kind = items.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [list(dict.fromkeys(terms(t or ""))) for t in b.column(text).to_pylist()]
            rows = [i for i, f in enumerate(found) for _ in f]
            yield pa.RecordBatch.from_arrays([b.column(id_col).take(pa.array(rows, pa.int64())), pa.array([w for f in found for w in f], pa.binary()).cast(pa.string())], names=[id_col, "term"])

    return items.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, term string").distinct()


def postings(docs: DataFrame, wanted: DataFrame | None = None, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The index, written by bucket: doc_id, place, term, tf, n, and bucket. With wanted (a column term), only these terms' postings.

    Each document also has a row of the empty term with its length n."""
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 40
        for b in batches:
            rows, found, tf, n, places = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                ids = b.column(id_col).take(pa.array(rows, pa.int64()))  # noqa: B023
                out = pa.RecordBatch.from_arrays([ids, pa.array(places, pa.int64()), pa.array(found, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "place", "term", "tf", "n"])  # noqa: B023
                for x in (rows, found, tf, n, places):  # noqa: B023
                    x.clear()
                return out

            for i in range(b.num_rows):
                words = terms(b.column(text)[i].as_py() or "")
                c = Counter(words)
                k = len(c) + 1
                rows += [i] * k
                places += [place] * k
                found.append(b"")
                found += c
                tf.append(0)
                tf += c.values()
                n += [len(words)] * k
                place += 1
                if len(rows) > FLUSH:
                    yield flush()
            if rows:
                yield flush()

    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(c, t) for c, t in (("place", T.LongType()), ("term", T.StringType()), ("tf", T.LongType()), ("n", T.LongType())))])
    made = docs.select(id_col, text).mapInArrow(run, schema)
    if wanted is not None:
        made = made.join(wanted.select(F.explode(F.array("term", F.lit(""))).alias("term")).distinct(), "term", "left_semi")
    made = made.withColumn("bucket", _bucket(F.col("term")))
    return stash(made.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "place"), "postings", by="bucket")


def weights(index: DataFrame, n_docs: int) -> DataFrame:
    """term, bucket, its weight w: floor(1000 ln((2 N + 2) / (2 df + 1))), and a number for it, term_no."""
    w = F.floor(1000 * F.log(F.lit(float(2 * n_docs + 2)) / (2 * F.col("df") + 1).cast("double"))).cast("long")
    return stash(index.groupBy("term", "bucket").agg(F.count("*").alias("df")).select("term", "bucket", w.alias("w"), F.monotonically_increasing_id().alias("term_no")), "weights")


def search(index: DataFrame, items: DataFrame, id_col: str = "item_id", top: int = TOP) -> DataFrame:
    """id_col, rank, doc_id, score: the top documents of each item; items: id_col, term."""
    n_docs, n_terms = index.filter(F.col("bucket") == _bucket(F.lit(""))).filter("term = '' and n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = items.select(id_col, "term").withColumn("bucket", _bucket(F.col("term")))
    w = weights(index.filter("term <> ''").join(asked.select("term", "bucket").distinct(), ["term", "bucket"], "left_semi"), n_docs)
    of_item = stash(asked.join(w, ["term", "bucket"]).select("term_no", id_col), "item-term-numbers")
    impact = index.withColumn("m", F.expr(f"100 - 90 + ((90 * n * {n_docs}L) div {max(1, n_terms)}L)")).withColumn("impact", F.expr("(1000000000L * tf) div (1000 * tf + 8 * m)"))
    shares = impact.join(w, ["term", "bucket"]).select("place", "doc_id", "term_no", (F.col("w") * F.col("impact")).alias("share"))
    scores = shares.repartition("place").join(of_item, "term_no").groupBy(id_col, "place", "doc_id").agg(F.sum("share").alias("score")).filter("score > 0")
    order = Window.partitionBy(id_col).orderBy(F.desc("score"), "doc_id", "place")
    return scores.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(id_col, "rank", "doc_id", "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item; the index holds the items' terms of all whole documents."""
    items = stash(item_terms(table(spark, sf_dir, "benchmark")), "item-terms")
    return search(postings(table(spark, sf_dir, "documents"), items), items)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
ORACLE_SQL = {
    "op12_lexical_search": f"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_TERM}') AS w FROM documents),
s AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, sum(len(w))::BIGINT AS n_terms FROM t),
p AS MATERIALIZED (SELECT doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM t) GROUP BY doc_id, term),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_TERM}')) AS term FROM benchmark),
x AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
v AS (SELECT p.doc_id, term, (1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)) AS impact FROM p, s WHERE term IN (SELECT term FROM i)),
r AS (SELECT item_id, doc_id, sum(w * impact)::BIGINT AS score FROM v JOIN i USING (term) JOIN x USING (term) GROUP BY ALL)
SELECT item_id, "rank"::INT AS "rank", doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS "rank" FROM r WHERE score > 0) WHERE "rank" <= {TOP}"""
}
