"""Relational steps of the workload (J1-J14) and distributed row positions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..session import materialize


def union_parts(*parts: DataFrame) -> DataFrame:
    """Concatenate metadata parts; ``part`` records which came first."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def first_wins(df: DataFrame, key: str, order: tuple[str, ...], values: tuple[str, ...]) -> DataFrame:
    """One row per ``key``, the first by ``order`` (deterministic drop_duplicates).

    Written as ``min(struct(order..., values...))`` per key: a plain aggregate
    with map-side partial aggregation, so a key holding a large share of the
    rows is pre-reduced in every task instead of landing in one window task.
    """
    packed = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in values])).alias("_m")
    agg = df.groupBy(key).agg(packed)
    return agg.select(key, *[F.col("_m")[c].alias(c) for c in values])


def row_positions(df: DataFrame, order: list[Column], out: str = "row_no") -> DataFrame:
    """0-based position of each row in a global order, without a one-partition window.

    The data is range-partitioned by the order and checkpointed (reliable
    checkpoint in ``spark.checkpoint.dir``), so both passes see the same
    partitioning; per-partition counts (one row per partition) give offsets.
    """
    sorted_df = materialize(df.orderBy(*order)
                            .withColumn("_pid", F.spark_partition_id())
                            .withColumn("_mid", F.monotonically_increasing_id()))
    counts = sorted_df.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    # one row per partition: size bounded by the partition count
    joined = sorted_df.join(F.broadcast(offsets), "_pid")
    pos = F.col("_off") + (F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33))
    return joined.withColumn(out, pos).drop("_pid", "_mid", "_off")


def fixed_order(df: DataFrame, key: str, partitions: int = 64) -> DataFrame:
    """Rows dealt to a fixed number of partitions by key and sorted by it.

    Sampling in a model fit follows partitions and their order; these depend on
    the key alone, not on shuffle settings, cores or what AQE coalesces.
    """
    return df.repartition(partitions, key).sortWithinPartitions(key)


def prefix_rows(df: DataFrame, order: list[Column], share: float) -> DataFrame:
    """V4: the first ``floor(share * n)`` rows in ``order``."""
    n = df.count()
    k = int(share * n)
    return row_positions(df, order).where(F.col("row_no") < k).drop("row_no")


def sum_arrays(parts: DataFrame, row: str, part: str, values: str, shape: tuple[int, int]) -> np.ndarray:
    """A matrix of a bounded ``shape`` from partial sums: the arrays of each ``row`` added up in the order of ``part``.

    Spark adds; one array a row comes back. Rows without a partial sum are zero.
    """
    listed = F.array_sort(F.collect_list(F.struct(F.col(part).alias("p"), F.col(values).alias("s"))))
    total = F.aggregate(listed, F.array_repeat(F.lit(0.0), shape[1]), lambda acc, x: F.zip_with(acc, x["s"], lambda a, b: a + b))
    rows = parts.groupBy(F.col(row).alias("row")).agg(total.alias("s")).toArrow()
    out = np.zeros(shape)
    if rows.num_rows:
        out[rows.column("row").to_numpy()] = rows.column("s").combine_chunks().flatten().to_numpy().reshape(-1, shape[1])
    return out
