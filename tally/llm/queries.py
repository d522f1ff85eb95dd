"""The registered queries of the training-data operators."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: query name -> module of this package that holds query() and perhaps ORACLE_SQL
MODULES = {
    "op1_lines": "lines",
    "op2_urls": "urls",
    "op3_chat": "chat",
    "op4_languages": "languages",
    "op5_mixing": "mixing",
    "op6_substrings": "substrings",
    "op7_quality": "quality",
    "op8_suffixes": "suffixes",
    "op9_sharding": "sharding",
    "op10_simhash": "simhash",
    "op11_resampling": "resampling",
    "op12_phrases": "phrases",
    "op13_tokens": "tokens",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: importlib.import_module(f"tally.llm.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(importlib.import_module(f"tally.llm.{module}"), "ORACLE_SQL", None) for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
