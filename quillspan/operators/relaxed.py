"""Relaxed matching of annotations: one-to-one matches under a looser equality than type and text.

In the modes strict, text and outer_markup two items match if their keys are equal. Then the most matches are, key by key,
the smaller of the two sides' counts: an aggregation, no matching. In boundary_type and boundary_text one name may lie in
the other; a job's names are matched by Hopcroft and Karp's phases of shortest augmenting paths.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Sequence
from itertools import islice

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import norm, strip_markup

EQUAL_MODES, MODES = ("strict", "text", "outer_markup"), ("strict", "text", "outer_markup", "boundary_type", "boundary_text")
#: Fixed value: the least share of the longer name that the shorter one has.
LEAST_SHARE = 0.5
#: Names up to so many characters are looked up by all their parts; longer ones are compared with names near in length.
SHORT = 48


def unique_entities(entities: DataFrame, by: list[str], mode: str) -> DataFrame:
    """by, name (normalized), type: each once, regardless of type in the modes of text alone; blank names too. Of several
    types of a name then the first counts."""
    x = entities.select(*by, F.coalesce(norm("text"), F.lit("")).alias("name"), F.col("text").alias("raw"), "type")
    if mode in ("text", "boundary_text"):
        return x.groupBy(*by, "name").agg(F.min("type").alias("type"), F.min("raw").alias("raw"))
    return x.groupBy(*by, "name", "type").agg(F.min("raw").alias("raw"))


def _key(mode: str, name: Column, kind: Column) -> Column:
    if mode == "outer_markup":
        name = strip_markup(name)
    return F.when(name != "", name if mode == "text" else F.concat_ws("\x01", name, F.coalesce(kind, F.lit("\x02"))))


def _by_counts(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """by, gold, predicted, matched of rows by, key; null keys count on their side and never match."""
    both = gold.select(*by, "key", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predicted.select(*by, "key", F.lit(0).alias("g"), F.lit(1).alias("p")))
    per = both.groupBy(*by, "key").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    return per.groupBy(*by).agg(F.sum("g").alias("gold"), F.sum("p").alias("predicted"), F.coalesce(F.sum(F.when(F.col("key").isNotNull(), F.least("g", "p"))), F.lit(0)).alias("matched"))


def entity_matches(gold: DataFrame, predicted: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    """by, gold, predicted, matched: unique entities of each side, and how many match one to one. rows: by, text, type."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    sides = [unique_entities(x, by, mode) for x in (gold, predicted)]
    if mode in EQUAL_MODES:
        return _by_counts(*(s.select(*by, _key(mode, F.col("name"), F.col("type")).alias("key")) for s in sides), by)
    one = F.lit("") if mode == "boundary_text" else F.coalesce("type", F.lit("\x02"))
    return _matched(*(s.select(*by, F.array("name").alias("names"), F.array(one).alias("kinds")) for s in sides), by)


def relation_matches(gold: DataFrame, predicted: DataFrame, by: list[str], mode: str = "strict") -> DataFrame:
    """by, gold, predicted, matched of relations, every row for itself: they match if their types are equal and both ends
    match. rows: by, type, source_text, source_type, target_text, target_type."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    ends = [(F.coalesce(norm(f"{p}_text"), F.lit("")), F.col(f"{p}_type")) for p in ("source", "target")]
    if mode in EQUAL_MODES:
        keys = [_key(mode, *e) for e in ends]
        key = F.when(keys[0].isNotNull() & keys[1].isNotNull(), F.concat_ws("\x03", F.coalesce("type", F.lit("\x02")), *keys))
        return _by_counts(*(x.select(*by, key.alias("key")) for x in (gold, predicted)), by)
    kinds = [F.coalesce("type", F.lit("\x02"))] + ([] if mode == "boundary_text" else [F.coalesce(k, F.lit("\x02")) for _, k in ends])
    return _matched(*(x.select(*by, F.array(*(n for n, _ in ends)).alias("names"), F.array(*kinds).alias("kinds")) for x in (gold, predicted)), by)


def overlaps(a: str, b: str) -> bool:
    """Whether the shorter name lies in the longer one and is at least half as long."""
    short, long = sorted((a, b), key=len)
    return bool(short) and len(short) >= LEAST_SHARE * len(long) and short in long


def near_names(left: Sequence[str], right: Sequence[str]) -> dict[str, list[str]]:
    """For each of the left names those right ones that overlap it, without comparing all: the parts of a short name that
    are long enough are looked up among the other side's names; a long name is compared with names near in length."""
    out: dict[str, list[str]] = {n: [] for n in left}

    def inside(whole: Sequence[str], parts: Sequence[str], add) -> None:
        known, by_length = set(parts), defaultdict(list)
        for p in known:
            by_length[len(p)].append(p)
        for w in whole:
            least = max(1, -(-len(w) // 2))
            if len(w) <= SHORT:
                found = {w[i : i + n] for n in range(least, len(w) + 1) if n in by_length for i in range(len(w) - n + 1)} & known
            else:
                found = {p for n, ps in by_length.items() if least <= n <= len(w) for p in ps if p in w}
            for p in found:
                add(w, p)

    inside(set(left), right, lambda w, p: out[w].append(p))
    inside(set(right), left, lambda w, p: out[p].append(w) if w != p else None)
    return out


def most_matches(n_left: int, n_right: int, edges: Sequence[Sequence[int]]) -> int:
    """Size of a maximum matching. Each phase finds the lengths of the shortest augmenting paths by breadth and then as
    many disjoint ones of them as there are by depth, on a stack of its own."""
    of_left, of_right, size = [-1] * n_left, [-1] * n_right, 0
    while True:
        level = [0 if m < 0 else -1 for m in of_left]
        queue, free = deque(u for u in range(n_left) if of_left[u] < 0), False
        while queue:
            u = queue.popleft()
            for v in edges[u]:
                w = of_right[v]
                if w < 0:
                    free = True
                elif level[w] < 0:
                    level[w] = level[u] + 1
                    queue.append(w)
        if not free:
            return size
        todo = [iter(e) for e in edges]
        for root in range(n_left):
            if of_left[root] >= 0:
                continue
            path: list[tuple[int, int]] = []  # left nodes with the right one tried
            u = root
            while u >= 0:
                for v in todo[u]:
                    w = of_right[v]
                    if w < 0:
                        for a, b in [*path, (u, v)]:
                            of_left[a], of_right[b] = b, a
                        size, u = size + 1, -1
                        break
                    if level[w] == level[u] + 1:
                        path.append((u, v))
                        u = w
                        break
                else:
                    level[u] = -1
                    u = path.pop()[0] if path else -1


def _most(rows: list[tuple[int, tuple, tuple]]) -> int:
    """Most one-to-one matches of a job's rows: side (0 gold, 1 predicted), names, kinds."""
    sides = [[(names, kinds) for s, names, kinds in rows if s == side] for side in (0, 1)]
    at: dict[tuple, list[int]] = defaultdict(list)  # gold by kinds and first name
    for j, (names, kinds) in enumerate(sides[0]):
        at[kinds, names[0]].append(j)
    near = near_names([n[0] for n, _ in sides[1]], [n[0] for n, _ in sides[0]])
    edges = [[j for first in near[names[0]] for j in at.get((kinds, first), ()) if all(map(overlaps, names[1:], sides[0][j][0][1:]))] for names, kinds in sides[1]]
    return most_matches(len(sides[1]), len(sides[0]), edges)


def _matched(gold: DataFrame, predicted: DataFrame, by: list[str]) -> DataFrame:
    """by, gold, predicted, matched of rows by, names, kinds (arrays of one size each): rows match if all kinds are equal
    and all names overlap. One job's annotations are one row, and many jobs come to Python at once."""

    @F.arrow_udf("bigint")
    def run(jobs: pa.Array) -> pa.Array:
        items, sizes = jobs.flatten(), pc.list_value_length(jobs).to_pylist()

        def tuples(field: str) -> list[tuple]:
            lists = items.field(field)
            width = len(lists[0]) if len(lists) else 1
            return list(zip(*[iter(lists.flatten().to_pylist())] * width, strict=True))

        rows = zip(items.field("side").to_pylist(), tuples("names"), tuples("kinds"), strict=True)
        return pa.array([_most(list(islice(rows, n))) for n in sizes], pa.int64())

    both = gold.withColumn("side", F.lit(0)).unionByName(predicted.withColumn("side", F.lit(1)))
    jobs = both.groupBy(*by).agg(F.count_if(F.col("side") == 0).alias("gold"), F.count_if(F.col("side") == 1).alias("predicted"), F.collect_list(F.struct("side", "names", "kinds")).alias("_rows"))
    return jobs.select(*by, "gold", "predicted", run("_rows").alias("matched"))
