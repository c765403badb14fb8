"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of hashed runs of five words. Rows with equal sets are one class of copies. Each class has a signature
of ``TREES`` labels of ``DEPTH`` minimum hashes, a path in as many prefix tries. The paths of all tries are sorted
together, so that neighbours share the longest prefixes. A class is joined to the first one below the trie node that it
shares with its neighbour, by an edge of that node's depth.

Edges of the full depth come first. They join classes into components, whose pairs are verified with the exact sets. The
links found tell how many others of their similarity that depth has missed. While that is more than the target recall
allows, matched prefixes are shortened by one label, components that grew are verified again, and the recall is estimated
anew from all links known by then. Large components are dealt into blocks, by the first trie's order of prefixes as far as
these are rare enough. Two blocks compare only those of their classes that share a prefix with one of the other block. A
task counts its blocks' links and returns sums and a spanning forest, never the pairs.

Defined results: texts of one to four words have one shingle, the whole text's words; texts without a word are copies of
each other. A row is a document: repeated rows are copies, and rows that share an id but not the text have classes of
their own, by the same name if both are named after this id. A null id counts as a negative number made from the text, so
null-id rows with different texts stay apart. Extra columns are left out. Sets are told apart by 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm.common import MaybeIn, drop_stash, stash, table, texts
from quillspan.llm.components import connected_components

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5  # similarity of at least 4/5
TREES, DEPTH, LEAST_DEPTH, RECALL = 16, 5, 3, 0.9995
#: Classes and shingles in a block of a component, about (half as many again at most).
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_500_000
#: A join key of more rows than this is dealt into parts of about so many; at most one key in so many rows is.
PART_ROWS = 1_000_000
#: Similarities of links are counted by hundredths.
BINS = 100
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(20240501).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NODE = "coalesce(try_cast({0} as bigint), -4611686018427387904 - pmod(xxhash64(coalesce({1}, '')), 2305843009213693952))"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of so many words."""
    ws = text.encode("utf-8").split()
    if not ws:
        return np.zeros(0, np.uint64)
    if len(ws) <= words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(ws))], np.uint64)
    known = {w: xxhash.xxh3_64_intdigest(w) for w in set(ws)}
    h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
    n = len(ws) - words + 1
    run = h[:n]
    for k in range(1, words):
        run = run * _P + h[k : k + n]
    return np.unique(_mix(run))


def signature(sh: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum hashes, 16 bits of each."""
    if not len(sh):
        return np.zeros((TREES, DEPTH), np.uint16)
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(sh), 8192):
        np.minimum(least, np.multiply.outer(_FACTORS, sh[k : k + 8192]).min(axis=1), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16).reshape(TREES, DEPTH)


def met(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Share of the pairs of this similarity that have a prefix of this depth in common in some trie."""
    return 1 - (1 - similarity**depth) ** TREES


def recall(links: np.ndarray, depth: int) -> float:
    """Estimated from the links found, by similarity in hundredths: each stands for others that weren't met."""
    some = np.flatnonzero(links)
    return float(links.sum() / (links[some] / met(some / BINS, depth)).sum()) if len(some) else float(met(np.array([NUMERATOR / DENOMINATOR]), depth)[0])


def class_of(sh: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(sh.tobytes()) - (1 << 63)


def signatures(docs: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The id, node, set (its hash), n (shingles) and paths (TREES x DEPTH labels of two bytes, that sort as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in texts(b, text_col)]
            paths = [signature(sh).astype(">u2").tobytes() for sh in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(map(class_of, sets), pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(paths, pa.binary())], names=["id", "node", "set", "n", "paths"])

    return docs.select(F.col(id_col).alias("id"), "node", text_col).mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, node long, set long, n long, paths binary")


def neighbours(classes: DataFrame) -> DataFrame:
    """Edges (a, b, depth) of each trie, and the table that they are in.

    All tries are sorted as one range-partitioned table; no prefix, however frequent, is in one task. What the tasks'
    first and last rows share is looked at on the driver, one pair for each task.
    """
    spark = classes.sparkSession
    width = 2 * DEPTH
    rows = classes.filter("n > 0").select("set", "paths", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("set", "tree", F.expr(f"substring(paths, tree * {width} + 1, {width})").alias("path"))
    ordered = rows.repartitionByRange("tree", "path", "set").sortWithinPartitions("tree", "path", "set")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last = TaskContext.get().partitionId(), None, None
        tops = np.zeros(DEPTH + 1, np.int64)  # by depth: the first class below the last row's trie node
        for b in batches:
            if not b.num_rows:
                continue
            set_, tree = (b.column(c).to_numpy() for c in ("set", "tree"))
            path = np.frombuffer(b"".join(b.column("path").to_pylist()), np.uint8).reshape(-1, width)
            first = first or (int(set_[0]), int(tree[0]), path[0].tobytes())
            before = np.r_[np.frombuffer(last[2], np.uint8)[None] if last else path[:1], path[:-1]]
            same = (path == before).reshape(-1, DEPTH, 2).all(2)
            depth = np.where(tree == np.r_[last[1] if last else -1, tree[:-1]], np.cumprod(same, axis=1).sum(1), 0)
            last = (int(set_[-1]), int(tree[-1]), path[-1].tobytes())
            top = set_.copy()
            for k in range(LEAST_DEPTH, DEPTH + 1):
                begin = np.maximum.accumulate(np.where(depth < k, np.arange(len(set_)), -1))
                own = np.where(begin >= 0, set_[begin], tops[k])
                top = np.where(depth == k, own, top)
                tops[k] = own[-1]
            at = np.flatnonzero(depth >= LEAST_DEPTH)
            yield pa.RecordBatch.from_arrays([pa.array(set_[at]), pa.array(top[at]), pa.array(depth[at].astype(np.int32)), pa.nulls(len(at), pa.int32()), pa.nulls(len(at), pa.binary())], names=["a", "b", "depth", "part", "path"])
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in (first, last)]), pa.array([x[1] for x in (first, last)], pa.int64()), pa.array([0, 1], pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([x[2] for x in (first, last)])], names=["a", "b", "depth", "part", "path"])

    out = stash(ordered.mapInArrow(walk, "a long, b long, depth int, part int, path binary"), "tries")
    ends = sorted(out.filter("part is not null").collect(), key=lambda r: (r["part"], r["depth"]))
    across = []
    for x, y in zip(ends[1::2], ends[2::2], strict=False):
        same = [x["path"][k : k + 2] == y["path"][k : k + 2] for k in range(0, width, 2)]
        depth = (same + [False]).index(False)
        if x["b"] == y["b"] and depth >= LEAST_DEPTH:
            across.append((x["a"], y["a"], depth))
    return out.filter("part is null").select("a", "b", "depth").unionByName(spark.createDataFrame(across, "a long, b long, depth int")), out


def dealt_join(rows: DataFrame, ones: DataFrame, key: str, counts: DataFrame, by: str) -> DataFrame:
    """rows, each with the row of its key in ones (one row a key), if there is one. counts: key and n, how many rows have
    it. Rows of a key with more than PART_ROWS are dealt by their column ``by`` into parts, each with a copy of that one."""
    frequent = counts.filter(F.col("n") > PART_ROWS).select(key, F.ceil(F.col("n") / PART_ROWS).alias("_parts"))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(F.broadcast(frequent), key, "left").withColumn("_part", F.pmod(F.xxhash64(by), parts)).drop("_parts")
    copied = ones.join(F.broadcast(frequent), key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return dealt.join(copied, [key, "_part"], "left").drop("_part")


def linked(sizes_a: np.ndarray, sizes_b: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Pairs of at least the similarity: common / (a + b - common) >= NUMERATOR / DENOMINATOR, in integers."""
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (sizes_a[:, None] + sizes_b[None, :])


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every set of a with every set of b."""
    out = np.zeros((len(a), len(b)), np.float32)
    va, vb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(va, vb)
    if len(shared):
        rows = []
        for v, sets in ((va, a), (vb, b)):
            at = np.minimum(np.searchsorted(shared, v), len(shared) - 1)
            hit = shared[at] == v
            rows.append((np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]))
        for k in range(0, len(shared), 2048):
            width = min(2048, len(shared) - k)
            part = []
            for (doc, col), n in zip(rows, (len(a), len(b)), strict=True):
                here = (col >= k) & (col < k + width)
                m = np.zeros((n, width), np.float32)
                m[doc[here], col[here] - k] = 1
                part.append(m)
            out += part[0] @ part[1].T
    return out


def _labels(link: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Component labels of rows and columns; row i and column i are one node if same."""
    n, m = link.shape
    rows, cols = np.arange(n), np.arange(m) + (0 if same else n)
    while True:
        big = n + m
        new_rows = np.minimum(rows, np.where(link, cols[None, :], big).min(axis=1, initial=big))
        new_cols = new_rows if same else np.minimum(cols, np.where(link, new_rows[:, None], big).min(axis=0, initial=big))
        if (new_rows == rows).all() and (new_cols == cols).all():
            return rows, cols
        rows, cols = new_rows, new_cols


def verify_block(left: list[tuple], right: list[tuple] | None) -> Iterator[tuple[int | None, int, int]]:
    """Rows (set, links, other). left, right: (set, copies, shingles); right is None for the pairs within left.

    links: how many documents that aren't copies it is linked to here; other: a set of its component here. Rows without
    a set: how many pairs are linked (links) at a similarity of so many hundredths (other).
    """
    other = right if right is not None else left
    sizes = [np.array([len(x[2]) for x in side], np.int64) for side in (left, other)]
    common = common_counts([x[2] for x in left], [x[2] for x in other]).astype(np.int64)
    link = linked(sizes[0], sizes[1], common)
    if right is None:
        np.fill_diagonal(link, False)
    i, j = np.nonzero(np.triu(link) if right is None else link)
    seen = np.bincount(BINS * common[i, j] // (sizes[0][i] + sizes[1][j] - common[i, j]), minlength=1)
    yield from ((None, int(seen[k]), int(k)) for k in np.flatnonzero(seen))
    copies = [np.array([x[1] for x in side], np.int64) for side in (left, other)]
    rows, cols = _labels(link, right is None)
    name = [x[0] for x in left] + ([] if right is None else [x[0] for x in right])
    yield from ((x[0], int(n), name[k]) for x, n, k in zip(left, link @ copies[1], rows, strict=True) if n)
    if right is not None:
        yield from ((x[0], int(n), name[k]) for x, n, k in zip(right, copies[0] @ link, cols, strict=True) if n)


def placed(members: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Members (set, component) with copies, blocks (1: a component of one block) and block.

    In larger components classes with the same first prefix come into one block; one that is too frequent for a block is
    spread over several by the hash of the set."""
    fill = F.greatest(F.count("*") / BLOCK_DOCS, F.sum("n") / BLOCK_SHINGLES)
    parts = F.greatest(F.lit(1), F.round(fill)).cast("long")
    sized = members.join(classes.select("set", "copies", "n", "paths"), "set")
    sized = sized.join(sized.groupBy("component").agg(parts.alias("blocks")), "component")
    small = sized.filter("blocks = 1").withColumn("block", F.lit(0).cast("long"))  # most components
    bucket = F.pmod(F.xxhash64(F.substring("paths", 1, 2 * depth)), F.col("blocks"))
    large = sized.filter("blocks > 1").withColumn("bucket", bucket)
    spread = large.groupBy("component", "bucket").agg(parts.alias("_parts"))
    large = large.join(spread, ["component", "bucket"])
    large = large.withColumn("block", F.col("bucket") * (1 << 24) + F.pmod(F.xxhash64("set"), F.col("_parts"))).drop("bucket", "_parts")
    return small.unionByName(large)


def verified(members: DataFrame, sets: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """set, links, other: what verify_block() gives, and its component. members: set, component; sets: set, shingles."""
    at = stash(placed(members, classes, depth), "placed")
    units = at.select("set", "component", "copies", "block").join(sets, "set")
    large = at.filter("blocks > 1")
    if large.limit(1).count():
        # The other blocks with a class below one of this class's trie nodes.
        prefixes = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda k: F.xxhash64("component", k, F.substring(F.col("paths"), k * 2 * DEPTH + 1, F.lit(2 * depth))))
        nodes = large.select("set", "block", F.explode(prefixes).alias("prefix"))
        shared = stash(nodes.groupBy("prefix").agg(F.collect_set("block").alias("together"), F.count("*").alias("n")).filter("size(together) > 1"), "nodes")
        met_ = dealt_join(nodes, shared.select("prefix", "together"), "prefix", shared.select("prefix", "n"), "set").filter("together is not null")
        met_ = met_.select("set", F.explode(F.filter("together", lambda x: x != F.col("block"))).alias("with")).distinct()
        units = units.join(met_.groupBy("set").agg(F.collect_list("with").alias("with")), "set", "left")  # fewer than the blocks
    else:
        units = units.withColumn("with", F.lit(None).cast("array<long>"))
    other = F.explode(F.concat(F.array("block"), F.coalesce("with", F.array().cast("array<long>"))))
    units = units.withColumn("other", other).select("component", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set", "copies", "shingles")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by component and pair of blocks; one pair of blocks is held at a time."""
        at, held = None, {}

        def done() -> list[tuple]:
            one = [x[1:] for x in held.values() if x[0] == at[1]] if at else []
            two = [x[1:] for x in held.values() if x[0] == at[2]] if at and at[1] != at[2] else None
            return [(*x, at[0]) for x in verify_block(one, two)] if one and (two or two is None) and len(held) > 1 else []

        def rows(out: list) -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["set", "links", "other", "component"])

        for b in batches:
            out = []
            for component, i, j, block, set_, copies, sh in zip(*(b.column(c).to_pylist() for c in ("component", "i", "j", "block", "set", "copies", "shingles")), strict=True):
                if at != (component, i, j):
                    out += done()
                    at, held = (component, i, j), {}
                held[set_] = (block, set_, copies, np.frombuffer(sh, np.uint64))  # repeated rows: once
            yield rows(out)
        yield rows(done())

    return units.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(check, "set long, links long, other long, component long")


def sets_of(own: DataFrame, wanted: DataFrame, text_col: str) -> DataFrame:
    """set and shingles of the wanted classes (set, rep), from one row of each or more."""

    maybe = MaybeIn(wanted, "rep")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(maybe.mask(b.column("hash").to_numpy())))
            sets = [shingles(t) for t in texts(some, text_col)]
            yield pa.RecordBatch.from_arrays([pa.array(map(class_of, sets), pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["set", "shingles"])

    rows = own.select(MaybeIn.hashed(F.col("node")).alias("hash"), text_col)
    return rows.mapInArrow(make, "set long, shingles binary").join(wanted.select("set"), "set", "left_semi")


def by_similarity(counts: DataFrame) -> np.ndarray:
    """Links by their similarity in hundredths."""
    seen = np.zeros(BINS + 1)
    for r in counts.groupBy("other").agg(F.sum("links").alias("n")).collect():
        seen[r["other"]] = r["n"]
    return seen


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The id column, node (the id, or a negative number for a null one), class_id (the least node of the documents that
    links connect) and n_links (documents, copies included, with at least the similarity), for every row. The result is
    in the shared folder; drop_stash() removes it."""
    own = docs.select(F.col(id_col), F.col(text_col), F.expr(NODE.format(f"`{id_col}`", f"`{text_col}`")).alias("node"))
    signed = stash(signatures(own, text_col, id_col), "signatures")
    classes = stash(signed.groupBy("set").agg(F.min("node").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("paths").alias("paths")), "classes")
    edges, tries = neighbours(classes)
    old = [signed, classes, tries]

    def check(members: DataFrame, fresh: DataFrame, sets: DataFrame | None, depth: int) -> tuple[DataFrame, DataFrame]:
        """The links within these components, and the sets known; fresh: members whose sets aren't."""
        wanted = stash(classes.select("set", "rep").join(fresh.select(F.col("node").alias("set")), "set", "left_semi"), "wanted")
        new = stash(sets_of(own, wanted, text_col), "sets")
        sets = new if sets is None else sets.unionByName(new)
        found = stash(verified(members.withColumnRenamed("node", "set"), sets, classes, depth).withColumn("round", F.lit(DEPTH - depth)), "links")
        old.extend([wanted, new, found])
        return found, sets

    depth, grouped = DEPTH, connected_components(edges.filter(F.col("depth") == DEPTH))
    links, sets = check(grouped, grouped, None, depth)
    counts = links.filter("set is null")
    old.append(grouped)
    while depth > LEAST_DEPTH and recall(by_similarity(counts), depth) < RECALL:
        depth -= 1
        # Components are single nodes now, so what a hot prefix has joined is one already.
        name = grouped.withColumnsRenamed({"node": "a", "component": "ca"})
        more = stash(edges.filter(F.col("depth") == depth).select("a", "b").distinct(), "shorter")
        named = dealt_join(more, name.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", more.groupBy("b").agg(F.count("*").alias("n")), "a")
        named = named.join(name, "a", "left")
        merged = connected_components(named.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
        grown = merged.select(F.col("node").alias("component"), F.col("component").alias("now"))
        new_ones = merged.join(grouped, "node", "left_anti")
        again = stash(grouped.join(grown, "component").select("node", F.col("now").alias("component")).unionByName(new_ones), "grown")
        found, sets = check(again, new_ones, sets, depth)
        counts = counts.join(grown, "component", "left_anti").unionByName(found.filter("set is null"))
        links = links.unionByName(found)
        grouped = grouped.join(grown, "component", "left_anti").select("node", "component").unionByName(again)
        old.extend([more, merged, again])
    links = links.filter("set is not null")
    groups = connected_components(links.select(F.col("set").alias("a"), F.col("other").alias("b")))
    old.append(groups)
    sums = links.groupBy("set", "round").agg(F.sum("links").alias("links")).groupBy("set").agg(F.max_by("links", "round").alias("links"))
    of = classes.select("set", "rep", "copies").join(groups.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    names = of.groupBy("component").agg(F.min("rep").alias("class_id"))
    of_set = of.join(names, "component").join(sums, "set", "left").select("set", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = dealt_join(signed.select("id", "node", "set"), of_set, "set", classes.select("set", F.col("copies").alias("n")), "node")
    out = stash(out.select(F.col("id").alias(id_col), "node", "class_id", "n_links"), "near")
    for df in old:
        drop_stash(df)
    return out


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class and number of links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def stage_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: that with the least id; of several rows with this id, the one whose text has the
    least hash. Null ids, empty texts, repeated rows as in near_duplicates(); an empty table stays empty; columns of any
    name stay as they are. Texts are shuffled only of rows that go or share an id."""
    found = near_duplicates(docs.select("doc_id", "text"))
    nodes = found.groupBy("node").agg(F.max((F.col("node") == F.col("class_id")).cast("int")).alias("_stays"), F.count("*").alias("_n"))
    special = stash(nodes.filter("_stays = 0 or _n > 1").select("node", "_stays"), "special")
    drop_stash(found)
    names = docs.columns
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("node", F.expr(NODE.format("row.doc_id", "row.text")))
    held = held.withColumn("maybe", MaybeIn(special, "node")(F.col("node")))
    rare = held.filter("maybe").join(special, "node", "left").filter("coalesce(_stays, 1) = 1")
    one = rare.groupBy("node").agg(F.min_by("row", F.xxhash64("row.text")).alias("row"))
    return held.filter("not maybe").select("row").unionByName(one.select("row")).select("row.*")
