"""Matching statistics of a stream of queries against a fixed collection of texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.operators.matching import AUTOMATON_CHARS, ms_vectors


def score_stream(texts: DataFrame, queries: DataFrame, keys: Sequence[str], query_col: str = "text") -> DataFrame:
    """keys, n, max_ms, sum_ms of each query that arrives; queries is a streaming DataFrame.

    Each query is scored by itself, so there is no state and no watermark, and a restart
    from the checkpoint repeats no work. The texts are read when the stream starts; they
    may have AUTOMATON_CHARS code points at most.
    """
    size = texts.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    if size > AUTOMATON_CHARS:
        raise ValueError(f"a stream is scored against {AUTOMATON_CHARS} code points at most, not {size}")
    found = ms_vectors(texts, queries, keys, query_col=query_col)
    return found.select(*keys, F.size("ms").alias("n"), F.array_max("ms").alias("max_ms"), F.aggregate("ms", F.lit(0).cast("long"), lambda s, x: s + x).alias("sum_ms"))
