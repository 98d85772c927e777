"""Nearest neighbours of dense vectors (the graph under T6) and nearest centroids.

``nearest`` is a self-join over several tables of random-projection buckets:
in each table a row's bucket is the signs of ``bits`` random projections of its
centred vector, so near rows often share one. Rows meet inside buckets only,
as blocks: a bucket is cut by a hash of the row into blocks of a ``SHARE``-th of all
buckets' rows (of ``BLOCK`` rows at least, at most ``BLOCKS`` of them unless a block would be beyond ``MOST`` rows), each pair of blocks of
one bucket is one group, its matrix products are made in tiles, and
only the best ``k`` of every row go on. A hot bucket is therefore many
tasks, a row is sent once for each block of its bucket, which is once where there are
many buckets of one size and ``BLOCKS`` times where there is one, and no list of all its pairs is ever made. A pair that several
tables find counts once; the best ``k`` by exact distance stay.

``bits=0`` puts all rows in one bucket of one table: the same plan is then the
exact search, in blocks. More tables find more of the true neighbours, more
bits make smaller buckets. Rows that no table brings together are missed, so
with ``bits > 0`` recall is a matter of the data (README has figures).

Vectors of different lengths are compared as if the shorter ended in zeros;
rows with a null key or vector, or a component that is null or not finite,
take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_once

#: Blocks of a bucket: how often each of its rows is sent out, and rows of a
#: block at least and at most. Two blocks, and ``TILE`` squared of their product, are what a task holds.
BLOCKS, BLOCK, MOST = 12, 2048, 65_536
TILE = 1024
#: Blocks that all buckets together are cut into, about: many buckets are tasks enough, and every further block of one is a further copy of its rows.
SHARE = 256


def usable(rows: DataFrame, key: str, features: str) -> DataFrame:
    """key (long), v (array<double>): the rows that can be compared."""
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    v = F.transform(features, lambda x: x.cast("double"))
    return rows.where(F.col(key).isNotNull() & F.col(features).isNotNull()).select(
        F.col(key).cast("long").alias("key"), v.alias("v")).where(F.forall("v", finite))


def matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """A list column as a matrix of ``width`` columns, short rows filled with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), width))
    out[np.arange(width) < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _mean(vectors: DataFrame, width: int) -> np.ndarray:
    """The mean vector: ``width`` sums a task, added up in Spark."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            total += matrix(b.column("v"), width).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], names=["i", "s"])

    rows = vectors.select("v").mapInArrow(sums, "i long, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["s"]
    return out


def buckets(vectors: DataFrame, width: int, tables: int, bits: int, seed: int = 1) -> DataFrame:
    """key, v, code (table and bucket): a row of ``vectors`` (key, v) once for each table."""
    if not bits:
        return vectors.select("key", "v", F.pmod("key", F.lit(1).cast("long")).alias("code"))
    n = vectors.count()
    mean = _mean(vectors, width) / max(n, 1)
    planes = np.random.default_rng(seed).normal(size=(width, tables * bits))

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, table = 1 << np.arange(bits, dtype=np.int64), np.arange(tables, dtype=np.int64) << bits
        for b in batches:
            above = ((matrix(b.column("v"), width) - mean) @ planes > 0).reshape(-1, tables, bits)
            found = above.astype(np.int64) @ weights + table
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found.tolist(), pa.list_(pa.int64()))], names=["key", "v", "codes"])

    coded = vectors.mapInArrow(codes, "key long, v array<double>, codes array<long>")
    return coded.select("key", "v", F.explode("codes").alias("code"))


def _block_pairs(rows: DataFrame, block: int) -> DataFrame:
    """Rows (key, v, code) grouped by pairs (a, b), a <= b, of blocks of one bucket, with the row's own block."""
    counts = rows.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    # a row a bucket: the tables times 2 ** bits at most
    size = F.greatest(F.lit(block), F.ceil(F.sum("n").over(Window.partitionBy()) / SHARE))
    blocks = F.greatest(F.least(F.ceil(F.col("n") / size), F.lit(BLOCKS)), F.ceil(F.col("n") / max(block, MOST)))
    sizes = counts.select("code", blocks.cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    # a row a bucket: the tables times 2 ** bits at most, so the rows themselves don't move for it
    dealt = rows.join(F.broadcast(sizes), "code").withColumn("own", own)
    with_pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return with_pairs.select("code", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "v").groupBy("code", "a", "b")


def _product_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances by a matrix product."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * (x @ y.T), 0)


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to rows, from their differences; nine places, so that what order sums were made in decides nothing."""
    return np.round(np.sqrt(((x - y) ** 2).sum(axis=1)), 9)


def _nearest_of(lk: np.ndarray, lx: np.ndarray, rk: np.ndarray, rx: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, exact distance): of each left row the ``k`` nearest right rows but itself; ties: the smaller key.

    The products are made in tiles; from each a row takes only what may be
    nearer than the ``k``-th it has, so no more than a tile is held.
    """
    squares = (rx * rx).sum(axis=1).max(initial=0)
    out = []
    for i in range(0, len(lk), TILE):
        keys, x = lk[i:i + TILE], lx[i:i + TILE]
        # a product is less exact than the differences
        slack = 1e-10 * (1 + (x * x).sum(axis=1) + squares)
        kth = np.full(len(x), np.inf)
        at, to, exact = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(rk), TILE):
            d = _product_distances(x, rx[j:j + TILE])
            bound = (kth + 1e-9) ** 2 + slack
            few = np.isinf(kth)
            if few.any():
                m = min(k + 1, d.shape[1])
                bound[few] = np.partition(d[few], m - 1, axis=1)[:, m - 1] + slack[few]
            a, t = np.nonzero(d <= bound[:, None])
            keep = keys[a] != rk[j + t]
            a, t = a[keep], t[keep] + j
            if not len(a):
                continue
            found = np.concatenate([exact_distances(x[a[s:s + 8192]], rx[t[s:s + 8192]]) for s in range(0, len(a), 8192)])
            at, to, exact = np.append(at, a), np.append(to, t), np.append(exact, found)
            sort = np.lexsort((rk[to], exact, at))
            sort = sort[np.arange(len(at)) - np.searchsorted(at[sort], at[sort]) < k]
            at, to, exact = at[sort], to[sort], exact[sort]
            last = np.searchsorted(at, np.arange(len(x)), "right") - 1
            full = np.bincount(at, minlength=len(x)) == k
            kth[full] = exact[last[full]]
        out.append((keys[at], rk[to], exact))
    return tuple(np.concatenate(c) for c in zip(*out))


def nearest(rows: DataFrame, key: str, features: str, k: int = 10, tables: int = 1, bits: int = 0, seed: int = 1, block: int = BLOCK) -> DataFrame:
    """u, rank (from 1 on), v, distance: the ``k`` nearest other rows of every row; ties: the smaller key. Written. ``key`` is unique."""
    vectors = write_once(usable(rows, key, features), "vectors")
    width = max(vectors.agg(F.max(F.size("v"))).first()[0] or 0, 1)

    def best(_, t):
        own, a = t.column("own").to_numpy(), t.column("a")[0].as_py()
        b = t.column("b")[0].as_py()
        keys, x = t.column("key").to_numpy(), matrix(t.column("v"), width)
        order = np.argsort(keys, kind="stable")
        keys, x, own = keys[order], x[order], own[order]
        found = []
        for left, right in ((a, b), (b, a)) if a != b else ((a, a),):
            lk, lx, rk, rx = keys[own == left], x[own == left], keys[own == right], x[own == right]
            if len(lk) and len(rk):
                found.append(_nearest_of(lk, lx, rk, rx, k))
        u, v, d = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64()), "distance": pa.array(d, pa.float64())})

    pairs = _block_pairs(buckets(vectors, width, tables, bits, seed), block).applyInArrow(best, "u long, v long, distance double")
    # dealt by u, pairs found in several tables meet and the ranks below need no second shuffle
    once = pairs.repartition("u").groupBy("u", "v").agg(F.min("distance").alias("distance"))
    w = Window.partitionBy("u").orderBy("distance", "v")
    return write_once(once.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("u", "rank", "v", "distance"), "nearest")


def recall(found: DataFrame, rows: DataFrame, key: str, features: str, k: int = 10, every: int = 20) -> float:
    """Share of the true ``k`` nearest of the rows whose key ``every`` divides that ``found`` (u, v) has."""
    true = nearest(rows, key, features, k).where(F.col("u") % every == 0)
    hits = true.join(found.select("u", "v", F.lit(1).alias("hit")), ["u", "v"], "left")
    n, hit = hits.agg(F.count(F.lit(1)), F.count("hit")).first()
    return hit / n if n else math.nan


def nearest_centroid(rows: DataFrame, centroids: list[tuple[int, list[float]]], key: str, features: str) -> DataFrame:
    """T8 for vectors: key, topic, score: each row's topic by the largest dot product with the topics' unit vectors; ties: the smaller topic.

    ``centroids`` is one vector a topic, so it goes to every task; a batch of
    rows is one matrix product. Scores are rounded to nine places before they
    are compared. Without a topic: -1 and a null score.
    """
    topics = np.array([t for t, _ in sorted(centroids)], np.int64)
    width = max((len(c) for _, c in centroids), default=1)
    table = np.zeros((len(topics), width))
    for i, (_, c) in enumerate(sorted(centroids)):
        table[i, :len(c)] = c
    length = np.linalg.norm(table, axis=1, keepdims=True)
    table = np.divide(table, length, out=np.zeros_like(table), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), max(width, int(np.diff(b.column("v").offsets.to_numpy()).max(initial=0))))[:, :width]
            if not len(topics):
                topic, score = pa.array(np.full(b.num_rows, -1, np.int32)), pa.nulls(b.num_rows, pa.float64())
            else:
                s = np.round(x @ table.T, 9)
                at = s.argmax(axis=1)
                topic, score = pa.array(topics[at].astype(np.int32)), pa.array(s[np.arange(len(at)), at])
            yield pa.RecordBatch.from_arrays([b.column("key"), topic, score], names=["key", "topic", "score"])

    return usable(rows, key, features).mapInArrow(run, "key long, topic int, score double").withColumnRenamed("key", key)


def centroids(rows: DataFrame, topic: str, features: str) -> list[tuple[int, list[float]]]:
    """(topic, mean vector) of every topic but the outliers: a row a topic and component is summed, a row a topic comes back."""
    parts = rows.where(F.col(topic) >= 0).select(F.col(topic).alias("t"), F.posexplode(features).alias("i", "x"))
    sums = parts.groupBy("t", "i").agg(F.sum(F.col("x").cast("double")).alias("s"))
    sizes = rows.where(F.col(topic) >= 0).groupBy(F.col(topic).alias("t")).agg(F.count(F.lit(1)).alias("n"))
    every = sums.join(F.broadcast(sizes), "t").groupBy("t").agg(F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("x")))).alias("xs"))
    return [(r["t"], [x["x"] for x in r["xs"]]) for r in every.collect()]
