"""Driver tables (one parquet file or folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# Text tables carry the CPU-heavy per-row work (regex chains, tokenising).
TEXT_KEYS = {"documents": "doc_id", "pages": "page_id", "conversations": "conv_id",
             "benchmark": "item_id"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read a driver table; column pruning and filters reach the parquet scan."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name in TEXT_KEYS:
        df = spread(df, TEXT_KEYS[name])
    return df


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give per-row CPU work at least one task per core.

    A scan yields one partition per file split / row group. Large inputs have
    thousands and are returned untouched (no shuffle). A small input packed in
    a few row groups would run all text work in a few tasks; only then it is
    hash-partitioned by its key (deterministic on retry, unlike round robin).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.rdd().getNumPartitions() >= target:
        return df
    return df.repartition(target, key)
