"""From raw documents to encoded training text: each stage's result is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lexiloom.llm import minhash, mixing, sentencepieces, suffix, toxicity
from lexiloom.llm.common import remove, shared_dir, sweep, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are toxic go (operator 9); all others stay as they are, with all columns, whatever their names.

    Null texts, empty texts and those whose score equals the threshold stay, rows with a null id like any other; rows
    that repeat are told alike; texts are scored whole. An empty table gives an empty one, and without labels of both
    kinds nothing goes.
    """
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (operator 5), that with the least doc_id, with all columns.

    Of equal ids the least hash of the text decides, nulls come last, and of rows that repeat id and text one stays.
    Null texts and those without words stay. Texts are compared whole. An empty table gives an empty one.
    """
    return minhash.without_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has are cut out (operator 2), by id, then hash of id and text, nulls last.

    Only text changes, and n_chars, which is counted anew. A row of which nothing but white space is left goes; null
    and empty texts stay, rows that repeat are cut alike, texts of any length are compared whole. An empty table gives
    an empty one.
    """
    return suffix.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks are drawn by the sources' target weights (operator 10); a row for each piece of a document in a drawn block.

    A long text becomes several pieces; a source above its weight loses blocks, one below it has some more than once.
    Null texts and those without words have nothing to draw; a null source is one of its own; a null id stays. Pieces
    have doc_id, text, lang and source of their document, and n_chars anew; other columns are there but null, as a block
    has nothing of them. An empty table gives an empty one.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids with their byte spans, and whether they decode to the text (operator 3): a row for each row, none merged.

    A null text has null pieces and an empty one none; a null id stays; columns but doc_id and text are left behind.
    """
    return sentencepieces.encoded(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Compression lengths, hashed signatures and pseudorandom draws aren't to be had in SQL; tests/llm/test_pipeline.py does every stage again by brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    to = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{to}/{k}-{name}")
        sweep(spark)
        if k:  # what this stage has read is of no use any more
            remove(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
