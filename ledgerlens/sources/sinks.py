"""Layer sink/re-scan (A2) and CSV result sinks (A3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_layer(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Write a panel layer as parquet.  At scale partition by ``year`` so the
    temporal split and per-year filters prune files."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)


def rewrite_partitions(df: DataFrame, path: str, partition_by: str) -> None:
    """Replace only the partitions that ``df`` holds rows of; the files of the
    others stay as they are."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))


def read_layer(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """Scan a layer; a condition on the partition column prunes its files."""
    df = spark.read.parquet(path)
    return df if where is None else df.where(where)


def write_csv(df: DataFrame, path: str, sort_cols: list[str] | None = None) -> None:
    """Header CSV without an index column; rows sorted inside each file."""
    if sort_cols:
        df = df.sortWithinPartitions(*sort_cols)
    df.write.mode("overwrite").option("header", True).csv(path)
