"""Packing by lexical retrieval: neighbours found by BM25 fill each seed document's window.

1. Tokenise. Every full window of a document is a sequence of its own, cut out
   in the task that tokenises it; its last part, shorter than a window, is
   staged as 16-bit ids, beside the terms of the whole text with their counts
   where there is more of it than that part.
2. Lengths and document frequencies of the token ids over all whole documents:
   at most one row a vocabulary entry, the bound of what goes to the driver and
   workers.
3. Each part is routed by the two most telling terms of its whole document, and
   ranges of that order - hot terms split by document - are the shards, of about
   ``shard_tokens`` ids. Parts with the same telling terms meet in a shard.
4. In a shard an inverted index of the whole documents' terms, with the
   corpus-wide BM25 weights, returns the unused neighbours of each seed, best first. They fill the seed's window;
   the last is cut at its end and what is left of it is the next seed. Every
   window but the shard's last is full. The last is cut into sequences whose
   lengths are powers of two, which need no padding.

Terms in half of the documents or more have no weight (Robertson's idf is not
positive there), so they need no postings. Memory in a task: its shard.

Defined results: null text is a document of the end id alone. Texts of any
length are packed whole. Every row is packed, repeated rows and null ids too;
each of its ids is in exactly one piece. Ties go by order of document and
row. No rows: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release_shuffles, text_of, written
from .tokenizer import VOCABULARY, forget, pieces

END = (1).to_bytes(2, "little")
K1, BM25_B = 1.2, 0.75
_TERMS = 1 << 16
#: (terms, their counts, number of ids) of a whole document.
Bag = tuple[np.ndarray, np.ndarray, int]


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _bag_bytes(ids: np.ndarray) -> bytes:
    """The terms (16 bits each), then their counts (32 bits each)."""
    counts = np.bincount(ids)
    terms = np.flatnonzero(counts)
    return terms.astype("<u2").tobytes() + counts[terms].astype("<u4").tobytes()


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ids and how often each comes, as ``np.unique`` gives them; 16-bit ids go through a radix sort."""
    s = np.sort(ids, kind="stable")
    first = np.ones(len(s) + 1, bool)      # where another id begins, the end included
    np.not_equal(s[1:], s[:-1], out=first[1:-1])
    at = np.flatnonzero(first)
    return s[at[:-1]], np.diff(at)


def _bag(tail: np.ndarray, bag, n_tokens: int) -> Bag:
    """``bag`` as written by ``_bag_bytes``; null: the tail is the whole document."""
    if bag is None:
        return *_counted(tail), len(tail)
    n = len(bag) // 6
    return np.frombuffer(bag, "<u2", n), np.frombuffer(bag, "<u4", n, 2 * n), n_tokens


class Bags(NamedTuple):
    """Whole documents, one after the other: ``terms`` (rising within a document) and their ``counts``; those of document i
    begin at ``starts[i]`` (one more than documents); ``lengths`` are the numbers of ids."""

    terms: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.lengths)), np.diff(self.starts))


def _bags(tails: list[np.ndarray], bags: list, n_tokens: list[int]) -> Bags:
    """The documents of the columns tail, bag and n_tokens: those without a bag are counted together, by one sort of document and id."""
    size = np.array([len(t) if b is None else 0 for t, b in zip(tails, bags, strict=True)], np.int64)
    lengths = np.where([b is None for b in bags], size, np.array(n_tokens, np.int64))
    wide = np.uint32 if len(tails) <= 1 << 16 else np.uint64
    keys = np.repeat(np.arange(len(tails), dtype=wide) << wide(16), size)
    if len(keys):
        keys |= np.concatenate([t for t, b in zip(tails, bags, strict=True) if b is None])
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(first, append=len(keys))
    owner, terms = (keys[first] >> wide(16)).astype(np.int64), (keys[first] & wide(0xFFFF)).astype(np.uint16)
    given = [i for i, b in enumerate(bags) if b is not None]
    if given:
        read = [_bag(tails[i], bags[i], 0) for i in given]
        owner = np.concatenate([owner, np.repeat(given, [len(r[0]) for r in read])])
        order = np.argsort(owner, kind="stable")      # two rising runs: merged
        owner = owner[order]
        terms = np.concatenate([terms, *(r[0] for r in read)])[order]
        counts = np.concatenate([counts, *(r[1] for r in read)])[order]
    return Bags(terms, counts, np.searchsorted(owner, np.arange(len(tails) + 1)), lengths)


def _joined(bags: list[Bag]) -> Bags:
    """Documents one by one as they come, together."""
    size = [len(b[0]) for b in bags]
    terms, counts = (np.concatenate([np.zeros(0, np.uint16), *(b[i] for b in bags)]) for i in range(2))
    return Bags(terms, counts, np.cumsum([0, *size]), np.array([b[2] for b in bags], np.int64))


def _read_bags(b: pa.RecordBatch, at_once: int = 1 << 20) -> Iterator[Bags]:
    """The documents of a batch in order, those of about ``at_once`` ids or bytes together."""
    tails = [np.frombuffer(t.as_buffer(), "<u2") for t in b.column("tail")]
    bags, n_tokens = b.column("bag").to_pylist(), b.column("n_tokens").to_pylist()
    size = np.cumsum([len(t) if g is None else len(g) for t, g in zip(tails, bags, strict=True)])
    cuts = [0, *(np.flatnonzero(np.diff(size // at_once)) + 1).tolist(), len(tails)]
    for lo, hi in itertools.pairwise(cuts):
        if hi > lo:
            yield _bags(tails[lo:hi], bags[lo:hi], n_tokens[lo:hi])


def tokenised(docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY) -> DataFrame:
    """row, doc_id, n_tokens, full_crcs, first_sequence, tail (16-bit ids), bag: one written row a document.

    ``full_crcs`` has the CRC-32 of each full window, whose sequence ids are
    first_sequence, first_sequence + 2, ...: even ids, unique by task and count.
    ``bag`` has the terms of the whole document and their counts; null: the tail is the whole document.
    """
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("full_crcs", pa.list_(pa.int64())),
                        ("first_sequence", pa.int64()), ("tail", pa.binary()), ("bag", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pieces(vocabulary)
        base = TaskContext.get().partitionId() << 34
        row, sequence = base, base
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, held in zip(b.column(0).to_pylist(), cache.all_ids(b.column(1)), strict=True):
                ids = np.frombuffer(held + END, "<u2")
                n_full = len(ids) // window
                crcs = [_crc(ids[i * window:(i + 1) * window]) for i in range(n_full)]
                for c, v in zip(cols, (row, doc, len(ids), crcs, sequence * 2, ids[n_full * window:].tobytes(), _bag_bytes(ids) if n_full else None), strict=True):
                    c.append(v)
                row += 1
                sequence += n_full
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "row long, doc_id long, n_tokens long, full_crcs array<long>, first_sequence long, tail binary, bag binary"), "tokens")


def term_weights(docs: DataFrame) -> tuple[np.ndarray, float]:
    """(idf by token id, average length) over all whole documents of ``docs`` (tail, bag, n_tokens)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, total = np.zeros(_TERMS, np.int64), 0, 0
        for b in batches:
            for docs in _read_bags(b):
                df += np.bincount(docs.terms, minlength=_TERMS)
                n, total = n + len(docs.lengths), total + int(docs.lengths.sum())
        at = np.flatnonzero(df)
        # -1 and -2 stand for the number of documents and of ids
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, total]))], names=["term", "n"])

    rows = docs.select("tail", "bag", "n_tokens").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    found = {r["term"]: r["n"] for r in rows}
    n, total = found.pop(-1, 0), found.pop(-2, 0)
    idf = np.zeros(_TERMS, np.float64)
    for t, df in found.items():
        idf[t] = max(0.0, math.log((n - df + 0.5) / (df + 0.5)))
    return idf, total / max(n, 1)


def _bm25(docs: Bags, idf: np.ndarray, average: float) -> np.ndarray:
    """The weight of each term of each document; not positive: the term has none."""
    tf = docs.counts
    norm = np.repeat(K1 * (1 - BM25_B + BM25_B * docs.lengths / average), np.diff(docs.starts))
    return idf[docs.terms] * tf * (K1 + 1) / (tf + norm)


def _telling(docs: Bags, idf: np.ndarray, average: float) -> tuple[np.ndarray, np.ndarray]:
    """The heaviest and the next heaviest term of each document (ties: the smaller id); -1: none has weight."""
    weight = _bm25(docs, idf, average)
    begin = docs.starts[:-1]
    some = np.flatnonzero(np.diff(docs.starts))
    out = []
    for _ in range(2):
        top = np.full(len(begin), -1, np.int32)
        if len(some):
            best = np.maximum.reduceat(weight, begin[some])
            hit = np.flatnonzero(weight == np.repeat(best, np.diff(docs.starts)[some]))
            at = hit[np.searchsorted(hit, begin[some])]      # the first of each document
            top[some] = np.where(best > 0, docs.terms[at].astype(np.int32), -1)
            weight[at] = 0.0
        out.append(top)
    return out[0], out[1]


class ShardIndex:
    """Inverted BM25 index over the documents of the parts of one shard."""

    def __init__(self, bags: Bags, idf: np.ndarray, average: float):
        self.n = len(bags.lengths)
        weight = _bm25(bags, idf, average)
        at = np.flatnonzero(weight > 0)
        flat, owner, weight = bags.terms[at], bags.owner[at], weight[at]
        self.terms = np.split(flat, np.searchsorted(owner, np.arange(1, self.n)))
        order = np.argsort(flat, kind="stable")
        self.owner, self.weight = owner[order], weight[order]
        self.start = np.searchsorted(flat[order], np.arange(_TERMS + 1))

    def keep(self, documents: np.ndarray) -> None:
        """From now on only ``documents`` (a mask) have scores; what those are doesn't change."""
        stay = documents[self.owner]
        self.start = np.concatenate([[0], np.cumsum(stay)])[self.start]
        self.owner, self.weight = self.owner[stay], self.weight[stay]

    def scores(self, part: int) -> np.ndarray:
        """BM25 of every document of the shard that is kept for the query of the terms of ``part``'s."""
        terms = self.terms[part].astype(np.int64)
        lo, n = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(self.owner[at], self.weight[at], minlength=self.n)


def fill_windows(parts: list[np.ndarray], idf: np.ndarray, average: float, window: int, bags: Bags | list[Bag] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (part, start, length); all but the last ``window`` long. ``bags``: the whole documents, by default the parts."""
    if not isinstance(bags, Bags):
        bags = _joined(bags) if bags else _bags(parts, [None] * len(parts), [0] * len(parts))
    index = ShardIndex(bags, idf, average)
    done = np.zeros(len(parts), np.int64)  # ids of each part already packed
    size = np.array([len(p) for p in parts])
    free = np.ones(len(parts), bool)
    indexed = len(parts)        # parts whose documents have postings
    seed, scan = -1, 0
    while True:
        if seed < 0 or not free[seed]:
            while scan < len(parts) and not free[scan]:
                scan += 1
            if scan == len(parts):
                return
            seed = scan
        left = np.count_nonzero(free)
        if 5 * left <= 4 * indexed:     # postings of used parts go, a fifth of them at a time
            index.keep(free)
            indexed = left
        rank = np.where(free, index.scores(seed), -1.0)
        rank[seed] = np.inf
        out, room, ahead, cut = [], window, 8, -1
        while room:
            n = min(ahead, len(parts))
            best = np.argpartition(-rank, n - 1)[:n] if n < len(parts) else np.arange(n)
            best = best[np.lexsort((best, -rank[best]))]
            for p in best.tolist():
                if rank[p] < 0 or not room:
                    break
                take = min(room, int(size[p] - done[p]))
                out.append((p, int(done[p]), take))
                done[p] += take
                room -= take
                free[p] = done[p] < size[p]
                rank[p] = -1.0
                cut = p if free[p] else -1
            if n == len(parts) or not free.any() or rank.max() < 0:
                break
            ahead *= 4
        yield out
        seed = cut


def sequences(parts: list[np.ndarray], idf: np.ndarray, average: float, window: int, bags: Bags | list[Bag] | None = None) -> Iterator[list[tuple[int, int, int]]]:
    """As ``fill_windows``, the last window cut into lengths that are powers of two."""
    for seq in fill_windows(parts, idf, average, window, bags):
        total = sum(x[2] for x in seq)
        if total == window:
            yield seq
            continue
        queue = list(seq)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            out = []
            while room:
                p, s, n = queue.pop(0)
                take = min(n, room)
                out.append((p, s, take))
                room -= take
                if take < n:
                    queue.insert(0, (p, s + take, n - take))
            yield out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, window: int = 2048, vocabulary: str = VOCABULARY, shard_tokens: int = 1 << 20) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    docs_ = tokenised(docs, window, vocabulary)
    tails = docs_.where(F.octet_length("tail") > 0).select("row", "doc_id", "n_tokens", "tail", "bag")
    idf, average = term_weights(docs_)
    weights = spark.sparkContext.broadcast((idf, average))
    # ids to pack, or terms to index where those are more: either is held in a task
    total = tails.agg(F.sum(F.greatest(F.col("n_tokens") % window, F.octet_length("bag") / 6))).first()[0] or 0

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(vocabulary)
        idf, average = weights.value
        for b in batches:
            told = [_telling(docs, idf, average) for docs in _read_bags(b)]
            both = [np.concatenate([np.zeros(0, np.int32), *(t[i] for t in told)]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, both)], names=[*b.schema.names, "term1", "term2"])

    # written: the ranges are drawn from a sample of the terms alone, so no part is routed twice
    routed = written(tails.mapInArrow(route, "row long, doc_id long, n_tokens long, tail binary, bag binary, term1 int, term2 int"), "routed")
    shards = routed.repartitionByRange(max(1, math.ceil(total / shard_tokens)), "term1", "term2", "doc_id", "row")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        if t is None or not t.num_rows:
            return
        forget(vocabulary)
        t = t.sort_by([(c, "ascending") for c in ("term1", "term2", "doc_id", "row")])
        idf, average = weights.value
        parts = [np.frombuffer(x.as_buffer(), "<u2") for x in t.column("tail")]
        doc, tokens = t.column("doc_id").to_pylist(), t.column("n_tokens").to_pylist()
        sequence = TaskContext.get().partitionId() << 34
        cols: list[list] = [[] for _ in range(7)]
        for seq in sequences(parts, idf, average, window, _bags(parts, t.column("bag").to_pylist(), tokens)):
            offset = 0
            for p, s, n in seq:
                values = (doc[p], tokens[p] - len(parts[p]) + s, n, _crc(parts[p][s:s + n]), tokens[p], sequence * 2 + 1, offset)
                for c, v in zip(cols, values, strict=True):
                    c.append(v)
                offset += n
            sequence += 1
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[x.split()[0] for x in _PIECES.split(", ")])

    full = (docs_.select("doc_id", "n_tokens", "first_sequence", F.posexplode("full_crcs").alias("i", "crc"))
            .select("doc_id", (F.col("i").cast("long") * window).alias("start"), F.lit(window).cast("long").alias("length"),
                    F.col("crc").alias("ids_crc32"), F.col("n_tokens").alias("doc_tokens"),
                    (F.col("first_sequence") + 2 * F.col("i").cast("long")).alias("sequence_id"), F.lit(0).cast("long").alias("offset")))
    release_shuffles(spark)
    return full.unionByName(shards.mapInArrow(fill, _PIECES))
