"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, media, mixing, pii_crf, quality_ledger, secret_novelty, sentencepiece_spans, setsketch, sharding, style_tree

MODULES = (quality_ledger, secret_novelty, mixing, media, style_tree, setsketch, pii_crf, language_id, sentencepiece_spans, sharding)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}
