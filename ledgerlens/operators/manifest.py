"""Manifest resolution and outcome reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.edgar import clean_output_name

OUTCOMES = ("OK", "NO MATCH", "MISSING", "FAILED")  # fixed values: outcome labels


def normalize_manifest(df: DataFrame) -> DataFrame:
    """A manifest must have ``path``, or ``fname`` which is renamed to ``path``."""
    cols = df.columns
    if "path" not in cols and "fname" in cols:
        df = df.withColumnRenamed("fname", "path")
    if "path" not in df.columns:
        raise ValueError(f"manifest must contain column 'path' or 'fname'. Found: {cols}")
    return df


def resolve(manifest: DataFrame, mapping: DataFrame) -> DataFrame:
    """S2 + J9 + J8: mapping rows for the distinct manifest paths, left-joined back.

    The lookup is a semi join (no IN-list size limit); every manifest row,
    duplicates included, keeps its own result row.
    """
    paths = manifest.select("path").distinct()
    hits = mapping.join(paths, mapping.fname == paths.path, "left_semi")
    return manifest.join(hits, manifest.path == hits.fname, "left").select("path", "archive_path")


def outcomes(resolved: DataFrame, listing: DataFrame) -> DataFrame:
    """OK / NO MATCH / MISSING / FAILED per manifest row, plus the output name.

    ``listing`` has one row per file that is there: (archive_path, error), the
    error null when the file could be read. Paths decide, never contents.
    """
    there = listing.select(F.col("archive_path").alias("_there"), "error")
    j = resolved.join(there, F.col("archive_path") == F.col("_there"), "left")
    outcome = (F.when(F.col("archive_path").isNull(), F.lit("NO MATCH"))
               .when(F.col("_there").isNull(), F.lit("MISSING"))
               .when(F.col("error").isNotNull(), F.lit("FAILED"))
               .otherwise(F.lit("OK")))
    return j.select("path", "archive_path", outcome.alias("outcome"),
                    F.when(outcome == "OK", clean_output_name(F.col("archive_path"))).alias("out_name"))


def outcome_counts(rows: DataFrame) -> DataFrame:
    """J11 counts (duplicates count every time) and J12 distinct output files."""
    return rows.groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"),
                                       F.countDistinct("out_name").alias("files"))
