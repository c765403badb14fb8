"""Filter cascades that count every exit: rows keep the name of the step that dropped them, so that what is kept and why
the rest is not come from the same pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.operators.chunking import _word_places


def cascade(rows: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """rows with exit: the first step (by name) whose condition doesn't hold, null if all do. A null condition doesn't."""
    out = F.when(F.lit(False), "")
    for name, holds in steps.items():
        out = out.when(~F.coalesce(holds, F.lit(False)), name)
    return rows.withColumn("exit", out)


def keep_best(rows: DataFrame, keys: list[str], order: list[Column], name: str, top: int = 1) -> DataFrame:
    """Of the rows that are left, only the first ``top`` of each key stay; the others leave by this name. Rows that left
    before take no part."""
    rank = F.row_number().over(Window.partitionBy(*keys, F.col("exit").isNull()).orderBy(*order))
    return rows.withColumn("_r", rank).withColumn("exit", F.when(F.col("exit").isNull() & (F.col("_r") > top), name).otherwise(F.col("exit"))).drop("_r")


def diagnostics(rows: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """by, raw, one count for each exit, and kept: exits in the given order, zeros included."""
    counts = [F.count_if(F.col("exit") == n).alias(n) for n in names]
    return rows.groupBy(*by).agg(F.count("*").alias("raw"), *counts, F.count_if(F.col("exit").isNull()).alias("kept"))


def relation_candidates(raw: DataFrame, entities: DataFrame, by: list[str], signatures: DataFrame, labels: list[str], threshold: float = 0.5, top: int = 1) -> DataFrame:
    """raw (by, source_id, label, target_id, score) with exit: relations of known labels between two entities (by, id,
    type), of a legal signature (relation, source_type, target_type; few rows), each once with its best score, and of each
    pair of entities the ``top`` best labels."""
    x = raw.withColumn("score", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl("score", F.lit(0.0)), F.lit(0.0)))))
    for p in ("source", "target"):
        x = x.join(entities.select(*by, F.col("id").alias(f"{p}_id"), F.col("type").alias(f"{p}_type")), [*by, f"{p}_id"], "left")
    legal = F.broadcast(signatures.select(F.col("relation").alias("label"), "source_type", "target_type", F.lit(True).alias("_legal")))
    x = x.join(legal, ["label", "source_type", "target_type"], "left")
    ends = F.col("source_type").isNotNull() & F.col("target_type").isNotNull() & (F.col("source_id") != F.col("target_id"))
    x = cascade(x, {"below_threshold": F.col("score") >= threshold, "dropped_label": F.col("label").isin(labels), "dropped_endpoint": ends, "dropped_signature": F.col("_legal")}).drop("_legal")
    x = keep_best(x, [*by, "source_id", "label", "target_id"], [F.desc("score")], "deduplicated")
    return keep_best(x, [*by, "source_id", "target_id"], [F.desc("score"), F.col("label")], "below_top", top)


RELATION_EXITS = ["below_threshold", "dropped_label", "dropped_endpoint", "dropped_signature", "deduplicated", "below_top"]
ENTITY_EXITS = ["below_threshold", "dropped_label", "dropped_span", "deduplicated"]


#: White space as Java's (?U)\\s has it.
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace() and not 0x1C <= ord(c) <= 0x1F)


def _exits(text: str | None, begins: set, ends: set, rows: list[tuple]) -> list[tuple]:
    """(start, end, exit) of one text's candidates (start, end, predicted, label, score, exit so far)."""
    out: list[tuple] = []
    best: dict = {}  # by span: rank and place of the best that is left
    for a, b, said, label, score, gone in rows:
        good = text is not None and a is not None and b is not None and 0 <= a < b <= len(text)
        if good:
            cut = text[a:b]
            a += len(cut) - len(cut.lstrip(_SPACES))
            name = cut.strip(_SPACES)
            b = a + len(name)
            good = name != "" and (said is None or said == name) and a in begins and b in ends
        exit_ = gone or (None if good else "dropped_span")
        if exit_ is None:
            rank = (score != score, score, label)  # not a number is above all
            if (old := best.get((a, b))) is None or rank > old[0]:
                if old is not None:
                    out[old[1]] = (a, b, "deduplicated")
                best[a, b] = rank, len(out)
            else:
                exit_ = "deduplicated"
        out.append((a, b, exit_))
    return out


def entity_candidates(jobs: DataFrame, candidates: str, text: str, by: list[str], labels: list[str], threshold: float = 0.5, separators: str = " \n") -> DataFrame:
    """by, start, end, label, score and exit of each of the jobs' candidates (an array of start, end, label, score,
    predicted), the span without white space at its ends: spans inside the text, equal to what was predicted if that is
    given, that begin and end with tokens, the words between separators; of equal spans the best score stays, then the last
    label. A job is one row: its text and tokens are met once, and leave it with no candidate."""
    first = lambda c: F.when(~F.coalesce(c["score"] >= threshold, F.lit(False)), "below_threshold").when(~F.coalesce(c["label"].isin(labels), F.lit(False)), "dropped_label")
    fields = ("start", "end", "predicted", "label", "score")
    rows = F.transform(F.coalesce(candidates, F.array()), lambda c: F.struct(c["start"].cast("int").alias("start"), c["end"].cast("int").alias("end"), c["predicted"].alias("predicted"), c["label"].alias("label"), c["score"].cast("double").alias("score"), first(c).alias("exit")))
    x = jobs.select(*by, F.col(text).alias("_text"), rows.alias("_c"))
    keep = [f for f in x.schema.fields if f.name in by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, found = b.column("_text"), b.column("_c")
            at, c = found.offsets.to_pylist(), found.values
            columns = [pc.struct_field(c, f).to_pylist() for f in (*fields, "exit")]
            places = _word_places(texts, separators)
            t_at, t = places.offsets.to_pylist(), places.values
            begins, ends = t.field("start").to_numpy(), t.field("end").to_numpy()
            out: list[tuple] = []
            for k, body in enumerate(texts.to_pylist()):
                if at[k + 1] > at[k]:
                    own = slice(t_at[k], t_at[k + 1])
                    out += _exits(body, set(begins[own].tolist()), set(ends[own].tolist()), list(zip(*(v[at[k] : at[k + 1]] for v in columns), strict=True)))
            start, end, exit_ = zip(*out, strict=True) if out else ((), (), ())
            jobs_ = pa.array(np.repeat(np.arange(b.num_rows), np.diff(found.offsets.to_numpy())))
            inner = slice(at[0], at[-1])
            data = [*(b.column(f.name).take(jobs_) for f in keep), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(columns[3][inner], pa.string()), pa.array(columns[4][inner], pa.float64()), pa.array(exit_, pa.string())]
            yield pa.RecordBatch.from_arrays(data, names=[*(f.name for f in keep), "start", "end", "label", "score", "exit"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return x.mapInArrow(run, f"{kinds}, start int, end int, label string, score double, exit string")
