"""Queries over the text tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import q_text
from tidemark.session import configure


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def ready(fn):
        return lambda spark, sf_dir: fn(configure(spark), sf_dir)

    return {n: ready(f) for n, f in {**q_text.QUERIES, "pipeline": corpus_pipeline.run}.items()}


def oracles() -> dict[str, str]:
    return dict(q_text.ORACLES)
