"""Line dedup over a suffix array of line-ID sequences, built by prefix doubling.

A document is the sequence of its lines that have a word; a line's id is the
digest of its text without white space at either end. Suffixes are ranked by
their first line, then, doubling, by their first 2, 4, 8 ... lines: the rank
of a suffix at depth 2d is the place of the pair (its rank at depth d, the
rank of the suffix d lines on) in the sorted order of such pairs. Suffixes of
one rank share that many lines - an interval of the suffix array whose longest
common prefix is at least the depth - and a rank held once is dropped at once,
as no longer run repeats from there.

A run counts as repeated when it has at least ``min_words`` words. Every such
run is a union of its shortest parts with that many words: those that no line
can leave at the end (the shortest from a line on) and those that no line can
leave at the start (the shortest up to a line). A line with ``min_words`` words
from it to the run's end is in the first kind's part that starts there; any
other is within the second kind's part that ends where the run does. So both
kinds are looked up in the intervals of their length (by the two overlapping
ranks that cover them); if one also starts earlier, its lines are a later copy,
and all of them merged are all lines of all maximal repeated runs, of which all
copies but the first are deleted. No such part has more than ``min_words``
lines, which is the depth that the doubling needs.

Places are ordered by doc_id (nulls last), text hash and line, so a copy
inside its own document counts too. All counts of ids and pairs are
aggregated map-side; joins back to places have an exchange on either side, so
AQE can split a line that a third of the corpus repeats.

Defined results: null text stays null, blank lines stay where they are, and
neither is ever part of a run. Texts of any length are taken whole. Rows that
repeat doc_id and text are one document and get the same result. No rows: no
rows. Extra columns are ignored (``line_runs``) or kept (``deduplicated``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators.relational import row_positions

from .common import LAST_ID, discard, doc_key, release_shuffles, small, text_of, written

_SPACES = " \t\n\x0b\x0c\r"


def shortest_runs(words: list[int], least: int) -> tuple[list[int], list[int]]:
    """For each line the lengths, from and to, of the runs from it on that have ``least`` words and lose them without their last or their first line.

    The first is the shortest run from that line on (0: the text ends before), the others end where no later start has as many words.
    """
    need, most, end, total = [], [], 0, 0
    for i in range(len(words)):
        while total < least and end < len(words):
            total += words[end]
            end += 1
        need.append(end - i if total >= least else 0)
        total -= words[i]
    # the longest run from i on whose other lines have under ``least`` words ends before the shortest run from i + 1 on does
    for i, n in enumerate(need):
        last = len(words) - i if i + 1 == len(words) or not need[i + 1] else need[i + 1]
        most.append(max(n, last) if n else 0)
    return need, most


def line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """doc, key, i, id, need, most: one row a line with a word; need to most are the lengths of its ``shortest_runs``; written."""
    schema = pa.schema([("doc", pa.int64()), ("key", pa.int64()), ("i", pa.int32()), ("id", pa.binary()), ("need", pa.int32()), ("most", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines = [x for x in (y.strip(_SPACES).encode("utf-8", "surrogatepass") for y in text.split("\n")) if x]
                n = len(lines)
                values = ([doc] * n, [key] * n, range(n), [hashlib.blake2b(x, digest_size=16).digest() for x in lines],
                          *shortest_runs([len(x.split()) for x in lines], min_words))
                for c, v in zip(cols, values, strict=True):
                    c.extend(v)
                if len(cols[0]) >= 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), doc_key().alias("key"), text_of().alias("text"))
    return written(body.mapInArrow(run, "doc long, key long, i int, id binary, need int, most int"), "lines")


def _place() -> Column:
    return F.struct("doc", "key", "i")


def _at(col: str, lines_on: int) -> Column:
    """``col`` of the line so many lines on in the same document; null when that line is not there."""
    w = Window.partitionBy("doc", "key").orderBy("i").rangeBetween(lines_on, lines_on)
    return F.first(col).over(w)


def _ranks(keys: DataFrame, by: list[str], rank: str) -> DataFrame:
    """``by`` values held more than once, with their place in sorted order as ``rank``."""
    held = keys.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*by)
    return written(row_positions(held, [F.col(c) for c in by], rank), "ranks")


def later_runs(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """doc, key, i, need: the shortest runs, from a line on or up to one (lines i to i + need), that also start at an earlier place."""
    spark = docs.sparkSession
    lines = line_table(docs, min_words)
    rank = _ranks(lines.select("id"), ["id"], "r0")
    now = written(lines.join(small(rank), "id").select("doc", "key", "i", "need", "most", "r0"), "depth1")
    discard(lines, rank)
    release_shuffles(spark)
    longest = now.agg(F.max("most")).first()[0] or 0
    depth, level = 1, 0
    while 2 * depth <= longest:
        r, nxt = f"r{level}", f"r{level + 1}"
        pair = written(now.withColumn("on", _at(r, depth)), "pairs")
        rank = _ranks(pair.where(F.col(r).isNotNull() & F.col("on").isNotNull()).select(r, "on"), [r, "on"], nxt)
        new = written(pair.join(small(rank), [r, "on"], "left").drop("on"), f"depth{2 * depth}")
        discard(now, pair, rank)
        release_shuffles(spark)
        now, depth, level = new, 2 * depth, level + 1
    if not longest:
        return now.select("doc", "key", "i", "need").limit(0)
    # a run of n lines is covered by the ranks at depth d <= n < 2d of its first line and of the line n - d on
    cases = []
    for n in range(1, longest + 1):
        k = n.bit_length() - 1
        cases.append(F.struct(F.lit(n).alias("need"), F.col(f"r{k}").alias("head"), _at(f"r{k}", n - (1 << k)).alias("tail")))
    covers = F.filter(F.array(*cases), lambda x: x["need"].between(F.col("need"), F.col("most")) & x["head"].isNotNull() & x["tail"].isNotNull())
    # the ranges take two runs a line at most on average: one that starts and one that ends there
    runs = written(now.select("doc", "key", "i", "need", covers.alias("covers")).where("need > 0").select("doc", "key", "i", F.inline("covers")), "runs")
    discard(now)
    first = written(runs.groupBy("need", "head", "tail").agg(F.min(_place()).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "first")
    release_shuffles(spark)
    return runs.join(small(first), ["need", "head", "tail"]).where(F.col("first") < _place()).select("doc", "key", "i", "need")


def _merged(runs: list) -> list[tuple[int, int]]:
    """Maximal [from, to) intervals of the runs (i, need)."""
    out: list[tuple[int, int]] = []
    for i, n in sorted((r["i"], r["need"]) for r in runs):
        if out and i <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], i + n))
        else:
            out.append((i, i + n))
    return out


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without its lines in ``spans``, which count the lines that have a word; and the number of those lines."""
    gone = {i for a, z in spans for i in range(a, z)}
    kept, i = [], 0
    for line in text.split("\n"):
        if line.strip(_SPACES):
            if i not in gone:
                kept.append(line)
            i += 1
        else:
            kept.append(line)
    return "\n".join(kept), i


def _with_runs(docs: DataFrame, min_words: int) -> DataFrame:
    """``docs``' rows as ``row``, with their text and the list of runs to delete (null: none)."""
    runs = written(later_runs(docs, min_words).groupBy("doc", "key").agg(F.collect_list(F.struct("i", "need")).alias("runs")), "deleted")
    release_shuffles(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), doc_key().alias("key"))
    return rows.join(runs, ["doc", "key"], "left")


def line_runs(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed, removed (maximal [from, to) runs of those lines), kept_sha256 for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
        for b in batches:
            n, removed, spans, digests = [], [], [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                s = _merged(runs or [])
                kept, lines = _cut(text or "", s)
                n.append(lines)
                removed.append(sum(z - a for a, z in s))
                spans.append([{"from": a, "to": z} for a, z in s])
                digests.append(hashlib.sha256(kept.encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(spans, spans_type), pa.array(digests, pa.string())],
                                             names=["doc_id", "n_lines", "n_removed", "removed", "kept_sha256"])

    return (_with_runs(docs.select("doc_id", "text"), min_words).select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", "runs")
            .mapInArrow(run, "doc_id long, n_lines long, n_removed long, removed array<struct<from:long,to:long>>, kept_sha256 string"))


def deduplicated(docs: DataFrame, min_words: int = 6) -> DataFrame:
    """``docs`` with the later copies deleted from ``text``; all columns, and all rows but those left without any word."""
    fields = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new, keep = [], []
            for text, runs in zip(b.column("text").to_pylist(), b.column("runs").to_pylist(), strict=True):
                kept = _cut(text, _merged(runs))[0] if runs else text
                new.append(kept)
                keep.append(not runs or bool(kept.strip(_SPACES)))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(new, pa.string())], names=["row", "text"]).filter(pa.array(keep, pa.bool_()))

    body = _with_runs(docs, min_words).select(
        F.struct(*[F.col(f"row.`{c}`") for c in fields if c != "text"]).alias("row"), "text", "runs")
    out = body.mapInArrow(run, T.StructType([body.schema["row"], body.schema["text"]]))
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in fields])
