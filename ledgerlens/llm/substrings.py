"""Substring dedup: Rabin-Karp hashes of every window of words, counted in Spark.

Each task hashes its documents' words, rolls a polynomial hash over every
window of ``width`` words, and deals the windows out by hash: one row holds
the windows of a few thousand documents that fall into one bucket, packed as
hash, document and start. A bucket's task sorts its windows by hash, then by
place, and calls every window but the first of its hash repeated. Repeated
windows go back to their documents as lists of starts and merge into maximal
removal intervals, which are cut out of the text.

Buckets are ranges of the hash and their number follows the corpus, so each
holds about ``bucket_windows`` windows. Of a hash that recurs within a slice
of a task only its first place enters the bucket; the others are known to be
repeated and travel apart, dealt out evenly. So a window that fills a third
of the corpus is one entry a slice. Windows are compared by 64-bit hashes.
What is repeated goes back by documents, again many to a row, as many parts
as there are buckets.

Order of places: doc_id, nulls last, then the text's hash, then the start.
Rows that repeat doc_id and text are one document and get the same result.
Defined results: null or blank text has no words: nothing to remove, the
empty text's digest. Fewer than ``width`` words: no window. A text of any
length is taken whole, and its windows travel in many rows. No rows: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LAST_ID, doc_key, release_shuffles, text_of, written

_BASE = np.uint64(0xD6E8FEB86659FD93)
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Windows of a task that are hashed and dealt out at once.
_SLICE = 1 << 19


class _WordHashes(dict):
    """word -> 64-bit hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 11)
        return h


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes modulo 2 ** 64 of every window, mixed so that any bits may pick a bucket.

    hash(i) = sum of words[i + j] * BASE ** (width - 1 - j), rolled: the next is
    (hash - words[i] * BASE ** (width - 1)) * BASE + words[i + width]. Unrolled over an
    array that is Horner's rule, ``width`` multiplications of whole arrays.
    """
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = words[:n].copy()
    for j in range(1, width):
        h *= _BASE
        h += words[j:j + n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def _pack(h: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> bytes:
    """Windows in the order of documents: the run of each document once, then starts and hashes."""
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])])
    run = np.diff(np.r_[new, len(doc)]).astype("<u4")
    return b"".join((len(new).to_bytes(4, "little"), len(start).to_bytes(4, "little"), doc[new].astype("<i8").tobytes(),
                     key[new].astype("<i8").tobytes(), run.tobytes(), start.astype("<u4").tobytes(), h.astype("<u8").tobytes()))


def _unpack(blob) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    d, n = (int(x) for x in np.frombuffer(blob, "<u4", 2))
    at = 8
    doc = np.frombuffer(blob, "<i8", d, at)
    key = np.frombuffer(blob, "<i8", d, at := at + 8 * d)
    run = np.frombuffer(blob, "<u4", d, at := at + 8 * d)
    start = np.frombuffer(blob, "<u4", n, at := at + 4 * d)
    h = np.frombuffer(blob, "<u8", (len(blob) - at - 4 * n) // 8, at + 4 * n)  # none beside windows known to be repeated
    return h, np.repeat(doc, run), np.repeat(key, run), start


def _later(h: np.ndarray, doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Marks every window whose hash has an earlier place. Equal places (repeated rows) share the mark."""
    out = np.zeros(len(h), bool)
    if not len(h):
        return out
    s = np.sort(h)
    twice = np.unique(s[1:][s[1:] == s[:-1]])
    if not len(twice):
        return out
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h)
    at = at[np.lexsort((start[at], key[at], doc[at], h[at]))]
    fresh = np.r_[True, h[at][1:] != h[at][:-1]]
    first = at[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
    out[at] = (doc[at] != doc[first]) | (key[at] != key[first]) | (start[at] != start[first])
    return out


def document_part(doc: np.ndarray, key: np.ndarray, parts: int) -> np.ndarray:
    """The part of each document, from its id and text together: a text that very many documents share spreads over all parts."""
    mixed = (key.view(np.uint64) ^ doc.view(np.uint64) * _MIX) * _MIX
    return ((mixed >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _starts(doc: np.ndarray, key: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """(doc, key, starts) with one row a document."""
    order = np.lexsort((start, key, doc))
    doc, key, start = doc[order], key[order], start[order]
    if len(doc):
        fresh = np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (start[1:] != start[:-1])]
        doc, key, start = doc[fresh], key[fresh], start[fresh]
    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]) if len(doc) else np.zeros(0, np.int64)
    ends = np.r_[new, len(doc)]
    blobs = [start[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(doc[new], pa.int64()), pa.array(key[new], pa.int64()), pa.array(blobs, pa.binary())],
                                      names=["doc", "key", "starts"])


def repeated_starts(docs: DataFrame, width: int = 20, bucket_windows: int = 1 << 21) -> DataFrame:
    """doc, key, starts: the windows of a document that also start earlier, as sorted 32-bit starts; one row a document."""
    spark = docs.sparkSession
    body = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"), doc_key().alias("key"), text_of().alias("text"))
    # a word and its white space take two bytes or more, six or so in prose; only the buckets' size depends on it
    size = docs.agg(F.sum(F.octet_length(text_of()))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / 6 / bucket_windows))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, count, turn = _WordHashes(), [], 0, TaskContext.get().partitionId()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal turn
            h, doc, key, start = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            known = _later(h, doc, key, start)
            aside = _pack(h[:0], doc[known], key[known], start[known]) if known.any() else None
            h, doc, key, start = h[~known], doc[~known], key[~known], start[~known]
            # by the top 32 bits, scaled: no two buckets share them
            bucket = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            ids, blobs = [], []
            for b in range(buckets):
                at = order[ends[b]:ends[b + 1]]
                if len(at):
                    ids.append(b)
                    blobs.append(_pack(h[at], doc[at], key[at], start[at]))
            if aside:
                ids.append(buckets + turn % buckets)
                blobs.append(aside)
                turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "windows"])

        for b in batches:
            for doc, key, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                if len(words) < width:
                    continue
                h = window_hashes(np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words)), width)
                for i in range(0, len(h), _SLICE):
                    part = h[i:i + _SLICE]
                    held.append((part, np.full(len(part), doc, np.int64), np.full(len(part), key, np.int64),
                                 np.arange(i, i + len(part), dtype=np.uint32)))
                    count += len(part)
                    if count >= _SLICE:
                        yield from flush()
                        count = 0
        if held:
            yield from flush()

    def judge(bucket, rows):
        parts = [_unpack(x.as_buffer()) for x in rows.column("windows")]
        h, doc, key, start = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        if bucket[0].as_py() < buckets:
            at = np.flatnonzero(_later(h, doc, key, start))
            doc, key, start = doc[at], key[at], start[at]
        # back to the documents: a row for each part of them, so many as there are buckets
        order = np.lexsort((start, key, doc))
        doc, key, start = doc[order], key[order], start[order]
        part = document_part(doc, key, buckets)
        parts = np.unique(part)
        blobs = [_pack(h[:0], doc[part == p], key[part == p], start[part == p]) for p in parts]
        return pa.table({"part": pa.array(parts, pa.int32()), "windows": pa.array(blobs, pa.binary())})

    def gather(part, rows):
        found = [_unpack(x.as_buffer())[1:] for x in rows.column("windows")]
        return pa.Table.from_batches([_starts(*(np.concatenate(x) for x in zip(*found, strict=True)))])

    dealt = body.mapInArrow(deal, "bucket int, windows binary")
    return (dealt.groupBy("bucket").applyInArrow(judge, "part int, windows binary")
            .groupBy("part").applyInArrow(gather, "doc long, key long, starts binary"))


def removal_intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal [from, to) word intervals covered by the windows at ``starts``."""
    s = np.unique(starts).astype(np.int64)
    if not len(s):
        return []
    cut = np.flatnonzero(np.diff(s) > width) + 1
    return list(zip(s[np.r_[0, cut]].tolist(), (s[np.r_[cut - 1, len(s) - 1]] + width).tolist(), strict=True))


def deduplicate_substrings(docs: DataFrame, width: int = 20, bucket_windows: int = 1 << 21) -> DataFrame:
    """doc_id, n_words, n_removed, removed (list of [from, to) word intervals), kept_text, kept_sha256 for each row of ``docs``."""
    spark = docs.sparkSession
    found = written(repeated_starts(docs, width, bucket_windows), "repeats")
    release_shuffles(spark, settle_s=1.0)
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
                       doc_key().alias("key"), text_of().alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[] for _ in range(5)]
            for text, starts in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                spans = removal_intervals(np.frombuffer(starts, "<u4"), width) if starts else []
                kept, at = [], 0
                for a, z in spans:
                    kept += words[at:a]
                    at = z
                kept = b" ".join(kept + words[at:] if at else words)
                for c, v in zip(cols, (len(words), sum(z - a for a, z in spans), spans, kept.decode("utf-8", "surrogatepass"),
                                       hashlib.sha256(kept).hexdigest()), strict=True):
                    c.append(v)
            spans_type = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            spans = pa.array([[{"from": a, "to": z} for a, z in x] for x in cols[2]], spans_type)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), spans,
                 pa.array(cols[3], pa.string()), pa.array(cols[4], pa.string())],
                names=["doc_id", "n_words", "n_removed", "removed", "kept_text", "kept_sha256"])

    joined = body.join(found, ["doc", "key"], "left").select("doc_id", "text", "starts")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, removed array<struct<from:long,to:long>>, kept_text string, kept_sha256 string")
