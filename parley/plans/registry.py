"""All queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parley.plans import audio, documents, library, live, prompts, recordings, streams, transcripts, vectors

MODULES = (transcripts, documents, streams, vectors, prompts, live, audio, recordings, library)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {query.__name__: query for module in MODULES for query in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}
