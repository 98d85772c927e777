"""Helpers shared by the training-data operators: staging, keys, size-checked broadcast."""

from __future__ import annotations

import gc
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path

#: Java / Python regex of a run of the six ASCII white space characters.
WHITE = r"[\x20\x09-\x0D]+"
#: ... and of a word: everything between them.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id where one must sort: after all others.
LAST_ID = 2**63 - 1

#: A side is broadcast only when its written table is proven to be at most this large ...
BROADCAST_BYTES = 8 << 20
#: ... which holds for this many narrow rows.
BROADCAST_ROWS = 65_536


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once below the shared checkpoint folder and read it back.

    Cuts the lineage: later steps read the files, so a lost executor costs at
    most the stage that runs, and a value that depends on the order of rows
    (a row number) is fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_scratch", None)
        if path:
            sc = t.sparkSession.sparkContext
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def release_shuffles(spark: SparkSession, settle_s: float = 0.0) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps.

    They go when the driver collects the objects that stand for them, which a
    driver with a large heap may not do for hours. Python's own references are
    handed back a little later; ``settle_s`` waits for that, where the files
    are large.
    """
    for wait in (settle_s, settle_s) if settle_s else (0.0,):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table`` with a broadcast hint when its checked row count is small; otherwise as it is.

    Only for written tables (the count reads file footers) of narrow rows.
    Beyond the bound the join is a shuffle join, whose hot keys AQE splits:
    both sides come through an exchange of their own.
    """
    return F.broadcast(table) if table.count() <= rows else table


def text_of(col: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def doc_key(text: str = "text") -> Column:
    """A hash of the text that, with doc_id, names a document in joins.

    Rows that repeat both doc_id and text are one document to the operators
    that use it and get the same result; rows that share only the doc_id stay
    apart, and a null doc_id does not gather all its rows under one key.
    """
    return F.xxhash64(F.lit(7), text_of(text))
