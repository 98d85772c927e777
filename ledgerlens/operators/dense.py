"""Dense embedding of texts in the engine (V5): truncated SVD of sparse vectors by block power iteration.

The matrix ``A`` (a row a document) is never gathered. A round is one pass over
the documents: it sends a thin block ``W`` (terms by ``block`` columns) to the tasks,
each multiplies its documents by ``W`` and their transpose by the result,
and Spark adds up the rows of ``A^T A W``, one a term. The block joins
an orthonormal basis of directions seen so far; the driver solves the small problem
within it (Rayleigh-Ritz), measures how far each of the first ``rank`` vectors
is from being an eigenvector, and takes a QR of those remainders as the next block
(which reaches in some ten passes what plain powers of one block reach in a hundred).
When the basis is full, its best vectors stay. It ends when all remainders are
within ``tolerance`` of the largest eigenvalue; if ``max_rounds`` come first, that is an error.

The driver holds thin matrices alone, never a covariance of the terms:
the basis and its products have at most ``rank + 3 * block`` columns each, and ``keep_n``
of the dictionary bounds their length (80 000 x 160 numbers twice: 205 MB, filled in place;
a block, which each task holds with its product, is 20 MB).

Each vector's sign is such that its largest component is positive (ties: the
earlier term). Documents without terms, or with a null vector, embed as zeros.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..session import write_once
from .clusters import tfidf_embed
from .lda import entries, vector_width
from .relational import sum_arrays
from .variational import blocks

#: Entries of a block: times the columns of Q, what a task holds beside two thin matrices.
BLOCK = 20_000


@dataclass(frozen=True)
class Svd:
    """``values`` (falling) and right ``vectors`` (terms by rank); what is left after ``rounds`` passes, as a share of the largest eigenvalue."""

    values: np.ndarray
    vectors: np.ndarray
    residual: float
    rounds: int


def _products(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """``A^T A Q``: thin, at most one row a term comes back."""
    shared = rows.sparkSession.sparkContext.broadcast(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        thin = shared.value
        total = np.zeros(thin.shape)
        seen = np.zeros(len(thin), bool)
        for b in batches:
            for _, ids, x, starts in blocks(b.column("ids"), b.column("counts"), BLOCK):
                # one document's rows of the thin matrix stay in a core's cache; it has no term twice
                for a, b in itertools.pairwise(starts.tolist()):
                    own, times = ids[a:b], x[a:b]
                    total[own] += np.outer(times, times @ thin[own])
                seen[ids] = True
        term = np.nonzero(seen)[0]
        lists = pa.ListArray.from_arrays(np.arange(len(term) + 1, dtype=np.int32) * thin.shape[1], pa.array(total[term].ravel()))
        part = pa.array(np.full(len(term), TaskContext.get().partitionId(), np.int32))
        yield pa.RecordBatch.from_arrays([part, pa.array(term.astype(np.int32)), lists], names=["part", "term", "s"])

    parts = rows.select("ids", "counts").mapInArrow(run, "part int, term int, s array<double>")
    out = sum_arrays(parts, "term", "part", "s", q.shape)
    shared.destroy()
    return out


def _beyond(basis: np.ndarray, block: np.ndarray) -> np.ndarray:
    """An orthonormal block for what of ``block`` lies outside ``basis``."""
    for _ in range(2):                  # the second time takes off what rounding left
        block = block - basis @ (basis.T @ block)
        block = np.linalg.qr(block)[0]
    return block


def truncated_svd(vectors: DataFrame, features: str = "features", rank: int = 64, block: int = 32, seed: int = 1,
                  tolerance: float = 1e-8, max_rounds: int = 200) -> Svd:
    """The ``rank`` largest singular values and right vectors, fewer if the matrix is smaller."""
    spark = vectors.sparkSession
    width = vector_width(vectors, features)
    # as many parts as the session runs at once: each returns one thin matrix a round
    kept = entries(vectors, features).where(F.size("ids") > 0)
    rows = write_once(kept.repartition(spark.sparkContext.defaultParallelism), "svd-rows")
    rank = min(rank, width, rows.count())
    if not rank:
        return Svd(np.zeros(0), np.zeros((width, 0)), 0.0, 0)
    rng = np.random.default_rng(seed)
    room = min(rank + 3 * block, width)
    seen, made, m = np.zeros((width, room), order="F"), np.zeros((width, room), order="F"), 0
    w = np.linalg.qr(rng.normal(size=(width, min(block, width))))[0]
    for done in range(1, max_rounds + 1):
        seen[:, m:m + w.shape[1]], made[:, m:m + w.shape[1]] = w, _products(rows, w)
        m += w.shape[1]
        basis, products = seen[:, :m], made[:, :m]
        small = basis.T @ products
        eigen, turn = np.linalg.eigh((small + small.T) / 2)
        eigen, turn = eigen[::-1], turn[:, ::-1]
        first = min(rank, len(eigen))
        rest = products @ turn[:, :first]
        rest -= basis @ (turn[:, :first] * eigen[:first])
        off = np.linalg.norm(rest, axis=0) / max(eigen[0], 1e-300)
        residual = float(off.max())
        if first == rank and residual <= tolerance:
            break
        if room < width and m + block > room:
            stay = turn[:, :rank + block]
            m = stay.shape[1]
            for full in (seen, made):
                full[:, :m] = full[:, :len(eigen)] @ stay
            basis = seen[:, :m]
        w = rest[:, off > tolerance / 10][:, :block]
        few = min(block, width - m) - w.shape[1]
        if few > 0:                     # fewer remainders than a block: new directions beside them
            w = np.hstack([w, rng.normal(size=(width, few)) * max(eigen[0], 1e-300)])
        w = _beyond(basis, w[:, :width - m])
    else:
        raise RuntimeError(f"{rank} singular vectors not within {tolerance} after {max_rounds} passes ({residual:.1e})")
    v = basis @ turn[:, :rank]
    top = np.argmax(np.abs(v) >= np.abs(v).max(axis=0) * (1 - 1e-9), axis=0)
    v = v * np.where(v[top, np.arange(rank)] < 0, -1.0, 1.0)
    return Svd(np.sqrt(np.maximum(eigen[:rank], 0)), v, residual, done)


def project(svd: Svd, vectors: DataFrame, features: str = "features", out: str = "embedding", unit: bool = True) -> DataFrame:
    """``vectors`` with ``out`` (array<double>, one number a singular vector, nine places) in place of ``features``; ``unit``: of length one."""
    spark = vectors.sparkSession
    rank = svd.vectors.shape[1]
    shared = spark.sparkContext.broadcast(svd.vectors)
    others = [c for c in vectors.columns if c not in (features, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for b in batches:
            x = np.zeros((b.num_rows, rank))
            for rows, ids, counts, starts in blocks(b.column("ids"), b.column("counts"), BLOCK):
                x[rows] = np.add.reduceat(v[ids] * counts[:, None], starts[:-1], axis=0)
            if unit:
                length = np.linalg.norm(x, axis=1, keepdims=True)
                x = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
            x = np.round(x, 9) + 0.0
            lists = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * rank, pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("kept"), lists], names=["kept", "dense"])

    rows = entries(vectors.withColumn("kept", F.struct(*[F.col(c) for c in others])), features, "kept")
    kind = rows.schema["kept"].dataType.simpleString()
    dense = rows.mapInArrow(run, f"kept {kind}, dense array<double>")
    return dense.select(*[F.col("kept")[c].alias(c) for c in others], F.col("dense").alias(out))


def dense_embed(docs: DataFrame, tokens_col: str = "tokens", rank: int = 64, keep_n: int = L.DICT_KEEP_N,
                out: str = "embedding", **svd_kw) -> DataFrame:
    """V5: ``docs`` with a unit vector of ``rank`` numbers: unit TF-IDF rows over the pruned dictionary, projected.

    ``docs`` are written once: counting them, the dictionary, the document frequencies and the vectors each read them.
    """
    docs = write_once(docs, "dense-docs")
    sparse = write_once(tfidf_embed(docs, tokens_col, keep_n, out="_sparse"), "tfidf")
    return project(truncated_svd(sparse, "_sparse", rank, **svd_kw), sparse, "_sparse", out)
