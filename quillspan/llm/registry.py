"""Queries of the training-data operators, by name, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_MODULES = ["media", "quality_rules", "quality_classifier", "line_dedup", "packing", "warc", "sentencepiece_codec", "language_model", "near_dup", "licenses", "filter_audit", "lexical_search", "differencing"]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    mods = [import_module(f"quillspan.llm.{m}") for m in _MODULES]
    return {k: v for m in mods for k, v in vars(m).items() if k.startswith("op") and k[2:3].isdigit() and callable(v)}


def oracle_sql() -> dict[str, str]:
    mods = [import_module(f"quillspan.llm.{m}") for m in _MODULES]
    return {k: v for m in mods for k, v in getattr(m, "ORACLE_SQL", {}).items()}
