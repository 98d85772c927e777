"""Incremental clean-filing job.

New submission files landing in a folder are cleaned as they arrive. The
clean-up is a stateless per-file map (see ``operators.filings.clean_filings``),
so the stream needs no state store and no watermark; exactly-once output comes
from the file sink plus the checkpoint under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.filings import clean_filings
from ..sources.readers import drop_undecodable
from ..session import scratch_path
from ..functions.edgar import clean_output_name


def start_clean_filings_stream(spark: SparkSession, in_dir: str, out_dir: str,
                               checkpoint: str | None = None, available_now: bool = True,
                               max_files_per_trigger: int = 1000) -> StreamingQuery:
    """Read ``in_dir/*.txt`` as whole files, clean, append (out_name, text) parquet rows."""
    schema = StructType([StructField("value", StringType())])
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .text(in_dir.rstrip("/") + "/*.txt", wholetext=True))
    files = src.select(F.regexp_extract(F.col("_metadata.file_path"), "([^/]*)$", 1).alias("source_file"),
                       drop_undecodable(F.col("value")).alias("raw"))
    cleaned = clean_filings(files, keep=("source_file",)).select(
        clean_output_name(F.col("source_file")).alias("out_name"), F.col("clean_text").alias("text"))
    # a stream's checkpoint belongs to its sink: one sub-folder per output path
    ckpt = checkpoint or scratch_path(
        spark, "streams/clean_filings-" + hashlib.sha1(out_dir.encode()).hexdigest()[:16])
    writer = (cleaned.writeStream.format("parquet").option("path", out_dir)
              .option("checkpointLocation", ckpt).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
