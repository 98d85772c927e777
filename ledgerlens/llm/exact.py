"""Exact dedup by distributed MSD radix partitioning of the texts' bytes.

Round by round, the documents of a group are split by their next digit: the
next bytes of the text. A document alone in its group is unique; a group whose
texts end in the same digit is a group of equal texts; all others go on with
the bytes that are left. Digits are short at first, when nearly all documents
part, and grow fourfold up to ``max_digit`` bytes, so a text of n bytes takes
about log4(n / 64) rounds and then n / max_digit. Equality is that of bytes;
no digest decides it.

A round counts its groups with map-side aggregation (a group of a third of all
rows costs one row a task), writes the groups of two or more, and joins them
back to the documents: a shuffle join of two exchanges, whose hot keys AQE
splits; in the first round a broadcast where the checked size allows it. No group is ever
gathered. Only the documents that are still in a group carry text into the
next round's table.

Defined results: null text counts as empty; all empty texts are equal. A null
doc_id keeps its row; a group's keep_id is its smallest doc_id, null only if
all are null. Rows that repeat a doc_id within a group count each in
group_size and share ``kept``; ``deduplicated`` keeps one row of those. No
rows: no rows. Extra columns are ignored (``documents``) or kept
(``deduplicated``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, WHITE, discard, release_shuffles, small, text_of, written


def normalised(text: str = "text"):
    """Each run of ASCII white space as one space."""
    return F.regexp_replace(text_of(text), WHITE, " ")


def exact_groups(docs: DataFrame, first_digit: int = 64, max_digit: int = 1 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    body = normalised().cast("binary")
    alive = docs.select(F.col("doc_id"), F.sha2(body, 256).alias("sha"), F.lit(0).cast("long").alias("grp"), body.alias("rest"))
    digit, done, previous = first_digit, [], None
    while True:
        now = alive.select("doc_id", "sha", "grp", F.substring("rest", 1, digit).alias("digit"),
                           F.substring("rest", digit + 1, 2**31 - 1).alias("rest"))
        groups = written(
            now.groupBy("grp", "digit").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("keep_id"))
            .where("size > 1").withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        # a row of it has at most the digit and five numbers: narrow in the first round, which
        # has all the text, and not in later ones, which have the text of what is left
        few = small(groups, BROADCAST_BYTES // (digit + 64)) if not done else groups
        split = now.join(few, ["grp", "digit"], "left")
        ended = F.length("digit") < digit
        open_ = F.col("size").isNotNull() & ~ended
        step = written(split.select(
            "doc_id", "sha", F.when(open_, F.col("next")).alias("grp"), F.when(open_, F.col("rest")).alias("rest"),
            F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
            F.coalesce("size", F.lit(1)).alias("size"), open_.alias("open")), "radix")
        discard(groups, *([previous] if previous is not None else []))
        release_shuffles(spark)
        done.append(step.where(~F.col("open")).select("doc_id", "sha", "keep_id", "size"))
        alive = step.where("open").select("doc_id", "sha", "grp", "rest")
        if alive.isEmpty():
            break
        if digit < max_digit:
            digit = min(4 * digit, max_digit)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "keep_id", F.col("size").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns: of equal texts the one with the smallest doc_id."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id",
                       F.sha2(normalised().cast("binary"), 256).alias("sha"))
    keep = written(exact_groups(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")), "kept")
    cond = rows["doc_id"].eqNullSafe(keep["doc_id"]) & (rows["sha"] == keep["text_sha256"])
    once = rows.join(keep, cond, "left_semi")
    return once.groupBy("doc_id", "sha").agg(F.first("row").alias("row")).select("row.*")
