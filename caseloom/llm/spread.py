"""Even parallelism for Python stages."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition df by keys where its scan has fewer partitions than the cluster has cores.

    A parquet file with few row groups would leave most cores idle in a stage
    that computes in Python; one shuffle of the rows is cheaper. Keys should be
    (nearly) unique, so that no value is hot.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(2 * cores, *keys)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """As spread, for what comes out of a shuffle: to ask for its partitions would run all that stands before it."""
    spark = df.sparkSession
    return df.repartition(max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)
