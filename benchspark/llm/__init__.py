"""Operators of a training-data pipeline and their queries; nothing else in the library imports this package."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: query -> module; a module holds ``ORACLES`` where SQL can state its query.
QUERIES = {
    "op1_bpe": "bpe",
    "op2_toxicity": "toxicity",
    "op3_jaccard": "jaccard",
    "op4_html": "html_extract",
    "op5_sharding": "sharding",
    "op6_quality": "quality",
    "op7_langid": "langid",
    "op8_decontaminate": "decontaminate",
    "op9_ann": "ann",
    "op10_licenses": "licenses",
    "op11_whitening": "whitening",
    "op12_runs": "runs",
    "op13_mixing": "mixing",
}


def _module(name: str):
    return import_module(f"benchspark.llm.{QUERIES[name]}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(_module(name), name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(_module(name), "ORACLES", {}).get(name) for name in QUERIES}
    return {name: sql for name, sql in found.items() if sql}
