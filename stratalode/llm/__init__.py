"""Operators for training-data pipelines. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from stratalode.session import share_code

#: Query name -> module; the SQL, where there is any, is the module's ORACLE_SQL.
_QUERIES = {
    "op1_decontamination": "decontamination",
    "op2_quality_classifier": "quality_classifier",
    "op3_packing": "packing",
    "op4_quality_rules": "quality_rules",
    "op5_suffix_dedup": "suffix_dedup",
    "op6_substring_dedup": "substring_dedup",
    "op7_near_dedup": "near_dedup",
    "op8_chat_formatting": "chat_formatting",
    "op9_sharding": "sharding",
    "op10_html_extraction": "html_extraction",
    "op11_hard_negatives": "hard_negatives",
    "op12_simhash": "simhash",
    "op13_source_divergence": "source_divergence",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    found = {name: getattr(import_module(f"stratalode.llm.{module}"), name) for name, module in _QUERIES.items()}
    found["pipeline"] = corpus_pipeline.run
    return {name: lambda spark, sf_dir, f=f: f(share_code(spark), sf_dir) for name, f in found.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"stratalode.llm.{module}"), "ORACLE_SQL", None) for name, module in _QUERIES.items()}
    return {name: sql for name, sql in found.items() if sql}
