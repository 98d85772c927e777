"""Hard negatives by a residue-number-system matrix product.

1. Components become integers, floor(scale * x). The largest magnitude and the
   largest dimension bound every score; primes below 256 are taken until their
   product exceeds twice that bound, so scores are known from their residues.
2. Rows and anchors are packed into blocks of rows, and each pair of a row block
   and an anchor block is one group: the stated anchors against all rows.
3. ``scores``: for each prime, the residues (centred around 0) are multiplied as
   float32 matrices. Sums stay below 2^24, where float32 is exact; longer vectors
   are multiplied in pieces, reduced in between. Mixed-radix Chinese remaindering
   puts the signed scores together in 64-bit integers.
4. First pass: each pair of blocks gives each anchor its best rows of the same
   label, a window over the blocks' candidates the best of all: the positives.
   Second pass: with their scores known, each pair of blocks gives each anchor
   and positive its best rows of another label whose score is in the window that
   the positive's score sets, and again a window over the candidates decides.
   The best of all rows are among the best of their blocks, so nothing is lost.

Memory in a task: one block of each kind and a tile of scores. The work is
anchors times rows, as the method says; the candidates are a few per anchor
and row block. Skew in labels or vectors changes nothing: blocks are dealt by
row, and each pair of blocks is the same product.

Defined results: rows with a null label, a null vector, or a component that is
null or not finite take no part. Vectors of different lengths are compared as
if the shorter ended in zeros. A null vec_id is never an anchor, keeps its
label and comes last among ties. Repeated rows are rows of their own: each is
an anchor, and a positive or negative of the others. Scores that could leave
62 bits raise ValueError. No rows, no anchors or no positives: no rows. Extra
columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LAST_ID, release_shuffles, written

#: Rows and anchors in a block, anchors in a tile of scores.
ROW_BLOCK, ANCHOR_BLOCK, TILE = 8192, 2048, 256
_NONE = np.iinfo(np.int64).min


def primes_for(bound: int) -> list[int]:
    """The largest primes below 256 whose product exceeds all differences of scores up to ``bound`` in magnitude."""
    out: list[int] = []
    for p in range(255, 1, -1):
        if math.prod(out) > 2 * bound:
            return out or [251]
        if all(p % q for q in range(2, 16)) or p in (2, 3, 5, 7, 11, 13):
            if math.prod(out) * p >= 1 << 63:
                break
            out.append(p)
    raise ValueError(f"scores up to {bound} don't fit 62 bits")


def residues(ints: np.ndarray, primes: list[int]) -> list[np.ndarray]:
    """The components modulo each prime, centred around 0, as float32."""
    out = []
    for p in primes:
        r = ints % p
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def scores(left: list[np.ndarray], right: list[np.ndarray], primes: list[int]) -> np.ndarray:
    """Exact inner products of all rows of two sets of residues, as signed 64-bit integers."""
    x, base = np.zeros((len(left[0]), len(right[0])), np.int64), 1
    for a, b, p in zip(left, right, primes, strict=True):
        width = ((1 << 24) - 1) // max(1, p // 2) ** 2  # so many products add up exactly
        r = np.zeros(x.shape, np.int32)
        for k in range(0, a.shape[1], width):
            r += (a[:, k:k + width] @ b[:, k:k + width].T).astype(np.int32) % p
        # x is right modulo the primes so far; the next digit makes it right modulo p too
        x += (r - x % p) * pow(base, -1, p) % p * base
        base *= p
    return np.where(x > base // 2, x - base, x)


def vectors_of(rows: DataFrame, scale: float = 256.0) -> DataFrame:
    """uid, vec_id, label, ints, most (a bound on their magnitude): one written row a row of ``rows`` (vec_id, embedding, label) that takes part."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    e = F.transform("embedding", lambda x: x.cast("double"))
    good = rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), e.alias("e")).where(F.forall("e", finite))
    return written(good.select(F.monotonically_increasing_id().alias("uid"), "vec_id", "label",
                               F.transform("e", lambda x: F.floor(x * scale)).alias("ints"),
                               F.aggregate("e", F.lit(0.0), lambda m, x: F.greatest(m, F.abs(x * scale) + 1.0)).alias("most")), "vectors")


def _blocks(rows: DataFrame, block: Column, width: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """block, uids, ids, labels, ints (packed 64-bit integers, by vec_id and uid) and the ``extra`` list columns: one written row a block."""
    def pack(key, t):
        t = t.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
        flat, n = t.column("ints").combine_chunks(), t.num_rows
        at = np.diff(flat.offsets.to_numpy())
        ints = np.zeros((n, width), np.int64)
        ints[np.arange(width) < at[:, None]] = flat.flatten().to_numpy(zero_copy_only=False)
        blobs = [pa.array([t.column(c).to_numpy().astype("<i8").tobytes()], pa.binary()) for c in ("uid", "vec_id", "label")]
        lists = [pa.array([t.column(c).to_pylist()], pa.list_(pa.list_(pa.int64()))) for c in extra]
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), *blobs, pa.array([ints.astype("<i8").tobytes()], pa.binary()), *lists],
                                    names=["block", "uids", "ids", "labels", "ints", *extra])

    packed = rows.select(block.cast("int").alias("block"), "uid", F.coalesce("vec_id", F.lit(LAST_ID)).alias("vec_id"), "label", "ints", *extra)
    return written(packed.groupBy("block").applyInArrow(
        pack, "block int, uids binary, ids binary, labels binary, ints binary" + "".join(f", {c} array<array<long>>" for c in extra)), "blocks")


def _against(rows: DataFrame, anchors: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Both kinds of blocks, once for each pair (a, b) of an anchor block and a row block."""
    left = anchors.select(F.col("block").alias("a"), F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("b"), F.lit(0).alias("side"), *anchors.columns[1:])
    right = rows.select(F.explode(F.sequence(F.lit(0), F.lit(n_anchors - 1))).alias("a"), F.col("block").alias("b"), F.lit(1).alias("side"), *rows.columns[1:])
    return left.unionByName(right, allowMissingColumns=True).groupBy("a", "b")


class _Side:
    """One block, unpacked."""

    def __init__(self, t: pa.Table, row: int, width: int, primes: list[int]):
        self.uid, self.id, self.label = (np.frombuffer(t.column(c)[row].as_buffer(), "<i8") for c in ("uids", "ids", "labels"))
        self.residues = residues(np.frombuffer(t.column("ints")[row].as_buffer(), "<i8").reshape(len(self.uid), width), primes)


def _best(s: np.ndarray, k: int):
    """(rows, columns, values) of the ``k`` largest of each row that aren't ``_NONE``, first columns first among ties. Overwrites ``s``."""
    every = np.arange(len(s))
    for _ in range(min(k, s.shape[1])):
        at = s.argmax(axis=1)
        value = s[every, at]
        some = np.flatnonzero(value != _NONE)
        if not len(some):
            return
        yield some, at[some], value[some]
        s[every, at] = _NONE


def _columns(found: list[tuple], names: tuple[str, ...]) -> pa.Table:
    cols = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * len(names)
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(names))


def _first(candidates: DataFrame, by: tuple[str, ...], k: int) -> DataFrame:
    """The first ``k`` of each group, higher scores first, then smaller ids, numbered from 1 on as ``rank``."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc("vec_id"), F.asc("uid"))
    return candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``rows`` (vec_id, embedding, label).

    Anchors: rows whose vec_id ``every`` divides. A negative's score is ``low``
    to ``high`` per cent of the positive's.
    """
    spark = rows.sparkSession
    vectors = vectors_of(rows)
    anchors = vectors.where(F.col("vec_id") % every == 0)
    n, most, width = vectors.agg(F.count(F.lit(1)), F.max("most"), F.max(F.size("ints"))).first()
    width = max(width or 0, 1)
    primes = primes_for(width * math.ceil(most or 0) ** 2)
    n_rows, n_anchors = max(1, math.ceil(n / row_block)), max(1, math.ceil(anchors.count() / anchor_block))
    row_blocks = _blocks(vectors, F.pmod(F.xxhash64("uid"), F.lit(n_rows)), width)
    in_block = F.pmod(F.xxhash64("uid"), F.lit(n_anchors))

    def pair(t: pa.Table) -> tuple[_Side, _Side, int] | None:
        side = t.column("side").to_pylist()
        return (_Side(t, side.index(0), width, primes), _Side(t, side.index(1), width, primes), side.index(0)) if len(side) == 2 else None

    def alike(key, t):
        found: list[tuple] = []
        if p := pair(t):
            a, b, _ = p
            for i in range(0, len(a.uid), TILE):
                cut = slice(i, i + TILE)
                s = scores([r[cut] for r in a.residues], b.residues, primes)
                s[(a.label[cut, None] != b.label) | (a.uid[cut, None] == b.uid)] = _NONE
                found += [(a.uid[cut][r], b.id[c], b.uid[c], v) for r, c, v in _best(s, positives)]
        return _columns(found, ("anchor", "vec_id", "uid", "score"))

    def others(key, t):
        found: list[tuple] = []
        if p := pair(t):
            a, b, row = p
            wanted = t.column("positives")[row].as_py()
            for i in range(0, len(a.uid), TILE):
                cut = slice(i, i + TILE)
                s = scores([r[cut] for r in a.residues], b.residues, primes)
                s[a.label[cut, None] == b.label] = _NONE
                for j in range(positives):
                    at = np.array([k for k, x in enumerate(wanted[cut]) if len(x) > j], np.int64)
                    if not len(at):
                        break
                    lo = np.array([-(-low * wanted[i + k][j] // 100) for k in at], np.int64)[:, None]
                    hi = np.array([high * wanted[i + k][j] // 100 for k in at], np.int64)[:, None]
                    some = s[at]
                    some[(some < lo) | (some > hi)] = _NONE
                    found += [(a.uid[cut][at[r]], np.full(len(r), j + 1), b.id[c], b.uid[c], v) for r, c, v in _best(some, negatives)]
        return _columns(found, ("anchor", "nth", "vec_id", "uid", "score"))

    first = _against(row_blocks, _blocks(anchors, in_block, width), n_rows, n_anchors).applyInArrow(alike, "anchor long, vec_id long, uid long, score long")
    chosen = written(_first(first, ("anchor",), positives).select(
        "anchor", F.col("rank").cast("long").alias("nth"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    release_shuffles(spark)
    wanted = chosen.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("positives"))
    with_wanted = anchors.join(wanted, anchors["uid"] == wanted["anchor"])
    second = _against(row_blocks, _blocks(with_wanted, in_block, width, ("positives",)), n_rows, n_anchors).applyInArrow(
        others, "anchor long, nth long, vec_id long, uid long, score long")
    picked = written(_first(second, ("anchor", "nth"), negatives), "negatives")
    release_shuffles(spark)

    def shown(c: str) -> Column:
        return F.when(F.col(c) != LAST_ID, F.col(c))

    return (picked.select("anchor", "nth", F.col("rank").cast("int").alias("rank"), shown("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(chosen, ["anchor", "nth"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
            .select("anchor_id", shown("positive_id").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score"))


def relabelled(rows: DataFrame, every: int = 7, classes: int = 10) -> DataFrame:
    """``rows`` (vec_id, embedding, label), the label moved on by one class where ``every`` divides vec_id."""
    moved = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    return rows.select("vec_id", "embedding", F.when(moved, (F.col("label") + 1) % classes).otherwise(F.col("label")).alias("label"))
