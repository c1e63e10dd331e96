"""Tables in Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Bytes below which a table is spread over all cores, if its files are fewer than they.
SMALL = 256 << 20


def spread(df: DataFrame) -> DataFrame:
    """df, shuffled once if it is a small table in few files, which few tasks would read however much there is to do with a row.

    Large tables, and those of many files, are read as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= SMALL or len(df.inputFiles()) >= cores:
        return df
    return df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
