"""Literals of files: a table function in Python, as no built-in parses JavaScript."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lexer import SyntaxProblem, literals

MARKER = "lexiloom-ignore"
_RAW = "file string, line int, column int, kind string, raw string, error string"


_ARROW = pa.schema([("file", pa.string()), ("line", pa.int32()), ("column", pa.int32()), ("kind", pa.string()), ("raw", pa.string()), ("error", pa.string())])
#: Literals after which those at hand are given on: what a task holds are these and one file's, however many files come together.
ROWS = 1024


def _batches(it: Iterator[pa.RecordBatch], marker: str) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []

    def batch(some: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), _ARROW.types)], schema=_ARROW)

    for b in it:
        for i in range(b.num_rows):  # a file at a time becomes Python's
            path = b.column(0)[i].as_py()
            try:
                rows += [(path, f.line, f.column, f.kind, f.raw, None) for f in literals(path, b.column(1)[i].as_py(), marker)]
            except (SyntaxProblem, RecursionError) as e:
                rows.append((path, None, None, None, None, f"{path}: {e}"))
            if len(rows) >= ROWS:
                yield batch(rows)
                rows = []
    if rows:
        yield batch(rows)


def raw_literals(files: DataFrame, marker: str = MARKER) -> DataFrame:
    """file, line, column, kind, raw of the literals in files (path, content); for a file that can't be read, a row with its error."""
    files = files.filter("path IS NOT NULL AND content IS NOT NULL").select("path", "content")
    return files.mapInArrow(lambda it: _batches(it, marker), _RAW)


def extract(files: DataFrame, min_length: int = 8, marker: str = MARKER) -> DataFrame:
    """file, line, column, kind, literal, norm, lit_id, error: collapsed literals that are long enough, and files' errors."""
    out = raw_literals(files, marker).withColumn("literal", X.collapse_whitespace("raw")).withColumn("norm", X.lower_each("literal"))
    out = out.filter(F.col("error").isNotNull() | (X.collapsed_length("literal") >= min_length) & (F.col("norm") != ""))
    return out.select("file", "line", "column", "kind", "literal", "norm", F.struct("file", "line", "column").alias("lit_id"), "error")
