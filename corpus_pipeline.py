"""A training corpus from raw documents: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm.common import stash, table
from quillspan.llm.line_dedup import stage_line_dedup
from quillspan.llm.near_dup import stage_near_duplicates
from quillspan.llm.packing import stage_best_fit_packing
from quillspan.llm.quality_classifier import stage_quality_classifier
from quillspan.llm.quality_rules import stage_quality_rules

STAGES = [
    ("quality rules", stage_quality_rules),
    ("quality classifier", stage_quality_classifier),
    ("line dedup", stage_line_dedup),
    ("n-gram Jaccard join", stage_near_duplicates),
    ("best-fit packing", stage_best_fit_packing),
]
#: Token ids and fitted models are beyond SQL; tests/llm compares run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
