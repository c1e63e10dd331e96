"""Single texts against a catalog, for interactive use."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import catalog as C
from . import match as M


def _one(catalog: DataFrame, value: str) -> DataFrame:
    return catalog.sparkSession.createDataFrame([(value,)], "raw string").select(F.lit(0).alias("lit_id"), X.normalize("raw").alias("norm"))


def _matches(df: DataFrame) -> list[Row]:
    got = M.nested(df).first()
    return list(got.matches) if got else []


def lookup(catalog: DataFrame, value: str) -> list[Row]:
    """Entries whose normalised value is the text's."""
    return _matches(M.exact(_one(catalog, value), catalog))


def lookup_pattern(catalog: DataFrame, value: str) -> list[Row]:
    """Entries with a pattern that the text fits."""
    return _matches(M.by_pattern(_one(catalog, value), C.patterns(catalog)))


def lookup_similar(catalog: DataFrame, value: str) -> list[Row]:
    """The three most similar entries."""
    return _matches(M.similar(_one(catalog, value), catalog))
