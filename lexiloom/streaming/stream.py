"""Matching of literals as they come: stream-static joins, which keep no state, and whole cascades by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import findings as O
from ..operators import match as M


def exact_stream(rows: DataFrame, catalog: DataFrame, min_length: int = 8) -> DataFrame:
    """file, line, column, literal, key, value of streamed rows (file, line, column, raw) that a translation has."""
    lit = O.select_literals(rows, min_length).drop("lit_id")
    return lit.join(catalog.select("key", "value", "norm_value"), F.col("norm") == F.col("norm_value")).select("file", "line", "column", "literal", "key", "value")


def pattern_stream(rows: DataFrame, patterns: DataFrame, min_length: int = 8) -> DataFrame:
    """As exact_stream, for patterns, in the same equi-join as for tables."""
    lit = O.select_literals(rows, min_length).drop("lit_id")
    return lit.withColumn("need", F.explode(M._keys("norm"))).join(M._keyed(patterns), "need").filter(M.FITS).select("file", "line", "column", "literal", "key", "value")


def cascade_stream(rows: DataFrame, catalog: DataFrame, patterns: DataFrame, sink: Callable[[DataFrame, int], None], mode: str = "source", similarity: bool = False, min_length: int = 8) -> DataStreamWriter:
    """A writer that gives sink the findings of each micro-batch of rows and its number: exact, pattern and, if asked for, similarity.

    Similarity ranks words by their frequency, which takes a whole batch; a finding depends on its own literal and the
    catalog alone, so how rows are split into batches changes nothing.
    """

    def one(batch: DataFrame, n: int) -> None:
        lit = O.select_literals(batch, min_length)
        sink(O.to_findings(M.cascade(lit, catalog, patterns, mode, similarity)), n)

    return rows.writeStream.foreachBatch(one)
