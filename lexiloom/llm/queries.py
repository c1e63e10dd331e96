"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blockjoin, epsjoin, langid, licenses, minhash, mixing, sentencepieces, suffix, tokenfiles, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_epsjoin": epsjoin.op1_epsjoin,
    "op2_suffix": suffix.op2_suffix,
    "op3_sentencepiece": sentencepieces.op3_sentencepiece,
    "op4_token_files": tokenfiles.op4_token_files,
    "op5_minhash": minhash.op5_minhash,
    "op6_neighbours": blockjoin.op6_neighbours,
    "op7_language": langid.op7_language,
    "op8_licenses": licenses.op8_licenses,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_mixing": mixing.op10_mixing,
}
ORACLE: dict[str, str] = {"op1_epsjoin": epsjoin.SQL, "op6_neighbours": blockjoin.SQL}
