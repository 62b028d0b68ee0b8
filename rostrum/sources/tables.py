"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` under `folder` (any store that Spark reads)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """`df` dealt by a key of many values over as many tasks as a shuffle has, or as there are cores. A Parquet file is read by one task for each of
    its row groups, so a table of few groups leaves most cores idle in whatever follows without a shuffle."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)
