"""Best-fit packing of whole documents after Martello and Toth's dominance reduction.

1. Tokenise. Only documents longer than a sequence are cut; every piece is one
   written row with its length, its task and its place among the task's pieces
   of that length.
2. Count the pieces by length. A length is at most ``capacity``, so this table
   has at most ``capacity`` rows however large the corpus is, and the whole
   instance of the packing problem is that table: pieces of one length are
   interchangeable.
3. Reduce (``dominating_sets``): a set of pieces that holds piece j and fits a
   sequence dominates if the others of any sequence with j can change places
   with pieces of the set; then some best packing has a sequence with just that
   set, and it is fixed for good. Sets of one, two and three pieces are looked
   for, as many equal ones at a time as there are pieces for, until no length
   has any. What is left goes best-fit decreasing, all pieces of one length at
   a time (``best_fit``). Both give patterns, (length, times) lists with a count.
4. Number the pieces of each length (pieces of it in earlier tasks, then the
   place in the task). Patterns take runs of these numbers, so a piece finds its
   sequence and offset by a binary search in the list of runs. That list depends
   on ``capacity`` alone: best fit splits a group of equal sequences at most
   twice a length, so there are a few thousand patterns.

No group of pieces is ever gathered: a length that a third of all documents
share is a number in the histogram and a run in the pattern list.

Defined results: null text is a document of the end id alone. Texts of any
length are packed whole. Every row is packed, repeated rows and null ids too.
Ties between pieces of one length go by task and place. No rows: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, text_of, written
from .tokenizer import VOCABULARY, pieces

END = (1).to_bytes(2, "little")
#: Sizes and how often each is in one sequence, and how many such sequences there are.
Pattern = tuple[tuple[tuple[int, int], ...], int]
_RANK_BITS = 40


def pieces_of(docs: DataFrame, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, nth (of the task's pieces of that length): one written row a piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), ("task", pa.int32()), ("nth", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, task = pieces(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for b in batches:
            cols: list[list] = [[] for _ in schema]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(cache.ids(text) + END, "<u2").astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    for c, v in zip(cols, (doc, i, start, len(part), zlib.crc32(part.tobytes()), task, int(seen[len(part)])), strict=True):
                        c.append(v)
                    seen[len(part)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"), "pieces")


class _Left:
    """The sizes not yet fixed: how often each is there, and the sorted list of those that are."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c}
        self.sizes = sorted(self.n)

    def take(self, chosen: tuple[int, ...], times: int) -> None:
        for s in chosen:
            self.n[s] -= times
        for s in set(chosen):
            if not self.n[s]:
                self.sizes.remove(s)

    def largest(self, most: int, without: Counter) -> int:
        """The largest size up to ``most`` of which one is left besides ``without``; 0: none."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.n[self.sizes[i]] <= without[self.sizes[i]]:
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def smallest(self, above: int, k: int, without: Counter) -> list[int]:
        """The ``k`` smallest sizes over ``above``, repeats included, besides ``without``; fewer if there are fewer."""
        out: list[int] = []
        for i in range(bisect_right(self.sizes, above), len(self.sizes)):
            s = self.sizes[i]
            out += [s] * min(k - len(out), self.n[s] - without[s])
            if len(out) == k:
                break
        return out

    def best_pair(self, room: int, without: Counter) -> int:
        """The largest sum of two sizes that fits ``room``; 0: none does."""
        best, lo, hi = 0, 0, bisect_right(self.sizes, room) - 1
        while lo <= hi:
            a, b = self.sizes[lo], self.sizes[hi]
            enough = (self.n[a] - without[a] >= 2) if lo == hi else self.n[a] > without[a] and self.n[b] > without[b]
            if a + b <= room and enough:
                best = max(best, a + b)
            if a + b > room or self.n[b] <= without[b]:
                hi -= 1
            else:
                lo += 1
        return best


def dominating_set(left: _Left, size: int, capacity: int) -> tuple[int, ...] | None:
    """A set with a piece of ``size`` that dominates all others with it, or None if none of up to three pieces is known to."""
    room, own = capacity - size, Counter([size])
    mate = left.largest(room, own)
    if not mate:
        return (size,)
    few = left.smallest(0, 3, own)
    fits = sum(total <= room for total in np.cumsum(few).tolist())  # so many others fit at most
    if fits == 1 or mate == room:
        return size, mate
    if fits != 2:
        return None
    # Sequences with the piece hold two others at most, none of them larger than the mate.
    if mate >= left.best_pair(room, own):
        return size, mate
    both = Counter([size, mate])
    third = left.largest(room - mate, both)
    # {size, x, y} with x >= y gives way unless y is larger than the third too; then x isn't the mate.
    if third and (len(next_two := left.smallest(third, 2, both)) < 2 or sum(next_two) > room):
        return size, mate, third
    return None


def dominating_sets(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """(the patterns that the reduction fixes, what is left of ``counts``)."""
    left, fixed, changed = _Left(counts), [], True
    while changed:
        changed = False
        for size in left.sizes[::-1]:
            while left.n[size] and (chosen := dominating_set(left, size, capacity)):
                each = Counter(chosen)
                times = min(left.n[s] // k for s, k in each.items())  # equal sets dominate in turn: taking one leaves fewer alternatives
                left.take(chosen, times)
                fixed.append((tuple(sorted(each.items(), reverse=True)), times))
                changed = True
    return fixed, {s: c for s, c in left.n.items() if c}


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each piece, largest first, into the open sequence with the least room that takes it."""
    groups: dict[int, list[Pattern]] = defaultdict(list)  # by room left
    rooms: list[int] = []

    def put(room: int, content: tuple, times: int) -> None:
        if times:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((content, times))

    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                content, times = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, content, times = capacity, (), -(-n // (capacity // size))
            each = room // size  # the next piece of this size fits the same sequence best
            full = min(times, n // each)
            rest = min(n - full * each, each - 1) if full < times else 0
            put(room - each * size, (*content, (size, each)), full)
            if rest:
                put(room - rest * size, (*content, (size, rest)), 1)
            put(room, content, times - full - (1 if rest else 0))
            n -= full * each + rest
    return [p for found in groups.values() for p in found]


def patterns(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """The packing of pieces of these sizes: what dominance fixes, then best fit for the rest."""
    fixed, left = dominating_sets(counts, capacity)
    return fixed + best_fit(left, capacity)


def runs(plan: list[Pattern]) -> np.ndarray:
    """Rows (size and first number as one key, pieces a sequence, first sequence, offset), sorted: which numbers of a size go where."""
    used: Counter = Counter()
    rows, sequence = [], 0
    for content, times in plan:
        offset = 0
        for size, each in content:
            rows.append((size << _RANK_BITS | used[size], each, sequence, offset))
            used[size] += each * times
            offset += each * size
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


_OUT = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack_whole(docs: DataFrame, capacity: int = 4096, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row a piece of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    cut = pieces_of(docs, capacity, vocabulary)
    counts = written(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(runs(patterns(histogram, capacity)))
    # a row a task in each window
    before = written(counts.select("length", "task", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before")), "piece-ranks")
    numbered = cut.join(small(before), ["length", "task"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, each, sequence, offset = plan.value.T
        for b in batches:
            if not b.num_rows:
                continue
            size, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(key, size << _RANK_BITS | rank, "right") - 1
            nth = rank - (key[at] & (1 << _RANK_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence[at] + nth // each[at]), pa.array(offset[at] + nth % each[at] * size)],
                                             names=[x.split()[0] for x in _OUT.split(", ")])

    return numbered.mapInArrow(place, _OUT)
