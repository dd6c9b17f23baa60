"""Parquet table access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def spread(scan: DataFrame) -> DataFrame:
    """Redistribute a file scan that has fewer splits than the cluster has cores.

    That is only ever a small table in few files. A large one has more splits
    than cores and is read where it lies, without a shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet"))
