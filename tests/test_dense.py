"""The dense embedding against numpy's whole decomposition, its edge cases, and topics found through it."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ledgerlens.operators import clusters, dense, density, lda, neighbours
from ledgerlens.plans import catalog
from ledgerlens.plans.q_chunks import chunk_corpus_df
from tests.conftest import SF01

SCHEMA = StructType([StructField("key", LongType()), StructField("kept", StringType()), StructField("ids", LongType()), StructField("features", VectorUDT())])


def frame(spark, matrix):
    return spark.createDataFrame([(i, f"k{i}", -i, None if r is None else Vectors.dense(r) if i % 3 else Vectors.sparse(len(r), {j: x for j, x in enumerate(r) if x}))
                                  for i, r in enumerate(matrix)], SCHEMA)


def apart(want, got):
    """Sine of the largest angle between the spaces of two orthonormal bases."""
    return np.linalg.norm(want - got @ (got.T @ want), 2)


@pytest.mark.parametrize("shape, rank, block", [((300, 90), 10, 4), ((300, 90), 25, 32), ((40, 200), 12, 8), ((60, 7), 64, 32), ((5, 30), 64, 3)])
def test_svd_equals_numpy(spark, shape, rank, block):
    a = np.random.default_rng(2).gamma(0.3, 1, shape) * np.geomspace(1, 5, shape[1])
    svd = dense.truncated_svd(frame(spark, a.tolist()).repartition(4), rank=rank, block=block)
    _, d, v = np.linalg.svd(a, full_matrices=False)
    r = min(rank, *shape)
    assert svd.vectors.shape == (shape[1], r) and np.allclose(svd.values, d[:r], rtol=1e-7)
    assert np.allclose(svd.vectors.T @ svd.vectors, np.eye(r), atol=1e-10)
    assert apart(v[:r].T, svd.vectors) < 1e-6
    assert (svd.vectors.max(axis=0) >= -svd.vectors.min(axis=0) - 1e-12).all()       # the sign rule


def test_query_equals_numpy(spark):
    """The registered query over all chunks: the same inner products as numpy's projection, which no choice of signs changes."""
    key = ["source_file", "doc_type", "doc_filename", "chunk_id"]
    chunks = chunk_corpus_df(spark, SF01).withColumn("tokens", F.split("chunk", " "))
    rows = {tuple(r[k] for k in key): r["s"].toArray() for r in clusters.tfidf_embed(chunks, out="s").select(*key, "s").collect()}
    got = {tuple(r[k] for k in key): r["embedding"] for r in catalog.queries()["dense_chunks"](spark, SF01).collect()}
    assert set(got) == set(rows) and len(rows) == len(got)
    a, e = np.array([rows[k] for k in sorted(rows)]), np.array([got[k] for k in sorted(rows)])
    want = a @ np.linalg.svd(a, full_matrices=False)[2][:64].T
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-300)
    assert abs(e @ e.T - want @ want.T).max() < 1e-6


def test_the_texts_are_made_once(spark):
    """All steps of the embedding read written documents: a column that counts its rows is asked once a row."""
    made = spark.sparkContext.accumulator(0)

    def tokens(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    docs = spark.createDataFrame([(i, [f"w{(i + j) % 20}" for j in range(5)]) for i in range(40)], "key long, tokens array<string>")
    out = dense.dense_embed(docs.mapInArrow(tokens, docs.schema), rank=2)
    assert out.count() == 40 and made.value == 40


def test_products_of_every_block(spark, monkeypatch):
    """Documents of one entry and of many, in blocks of one document and more."""
    a = np.where(np.random.default_rng(5).random((60, 30)) < np.linspace(0.02, 1, 60)[:, None], 1.5, 0.0)
    rows = lda.entries(frame(spark, a.tolist()).repartition(3), "features").where(F.size("ids") > 0)
    q = np.random.default_rng(6).normal(size=(30, 4))
    for size in (1, 100, 20_000):
        monkeypatch.setattr(dense, "BLOCK", size)
        assert np.allclose(dense._products(rows, q), a.T @ (a @ q), atol=1e-10)


def test_edges(spark):
    a = [[1.0, 0, 0, 2], None, [0.0] * 4, [0, 3.0, 0, 0], [0, 3.0, 0, 0], [1.0, 0, 0, 2]]
    df = frame(spark, a)
    svd = dense.truncated_svd(df, rank=3)
    assert np.allclose(svd.values, [np.sqrt(18), np.sqrt(10), 0], atol=1e-6)
    out = dense.project(svd, df)
    assert out.columns == ["key", "kept", "ids", "embedding"]
    rows = {r["key"]: r for r in out.collect()}
    assert {k: (r["kept"], r["ids"]) for k, r in rows.items()} == {i: (f"k{i}", -i) for i in range(6)}
    assert rows[1]["embedding"] == rows[2]["embedding"] == [0, 0, 0]
    assert rows[3]["embedding"] == rows[4]["embedding"] and rows[0]["embedding"] == rows[5]["embedding"]
    assert np.allclose(rows[3]["embedding"][:2], [1, 0]) and np.allclose(rows[0]["embedding"][:2], [0, 1])
    empty = df.where("key < 0")
    assert dense.project(dense.truncated_svd(empty), empty).collect() == []
    null = df.where("key = 1")
    assert dense.project(dense.truncated_svd(null), null).first()["embedding"] == []


def test_a_fit_that_does_not_end_is_an_error(spark):
    a = np.random.default_rng(4).normal(size=(200, 80))
    with pytest.raises(RuntimeError, match="not within"):
        dense.truncated_svd(frame(spark, a.tolist()), rank=20, block=4, max_rounds=3)


def test_density_topics_of_texts(spark):
    """Texts -> dense embedding -> neighbour graph -> density clusters: the planted themes, each whole and alone."""
    rng = np.random.default_rng(9)
    texts = [(i, [f"t{i % 3}w{w}" for w in rng.integers(0, 12, 40)] + [f"all{w}" for w in rng.integers(0, 5, 4)]) for i in range(120)]
    docs = spark.createDataFrame(texts, "key long, tokens array<string>")
    e = dense.dense_embed(docs, rank=3)
    graph = neighbours.nearest(e, "key", "embedding", 15)
    got = {r["key"]: r["cluster"] for r in density.labels(e.select("key"), graph, min_size=10, min_samples=5).collect()}
    themes = {c: {k % 3 for k, x in got.items() if x == c} for c in set(got.values()) - {-1}}
    assert {min(t) for t in themes.values()} == {0, 1, 2} and all(len(t) == 1 for t in themes.values())
    assert sum(c == -1 for c in got.values()) < 24
