"""Neighbour graph, density clusters and reassignment of vectors against plain versions."""

import numpy as np
import pytest

from ledgerlens.operators import density, neighbours
from ledgerlens.plans import catalog
from tests import brute_density as brute
from tests.conftest import SF01

SCHEMA = "key long, e array<double>, u long, v string, code string, own int"


def frame(spark, vectors):
    return spark.createDataFrame([(int(k), [float(x) for x in v], 0, "v", "c", 1) for k, v in vectors.items()], SCHEMA)


def blobs():
    rng = np.random.default_rng(5)
    parts = [rng.normal(c, s, (n, 2)) for c, s, n in ((0, 0.3, 60), (5, 0.5, 40), (5.9, 0.2, 30), (-6, 1, 50), (0, 6, 60))]
    return dict(enumerate(np.concatenate(parts)))


def copies():
    """Many equal vectors: ties everywhere, distances of nought."""
    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (40, 3))
    return dict(enumerate(np.concatenate([x, x[:25], x[:25], np.repeat(x[:2], 30, axis=0)])))


def grid():
    """Equal distances everywhere."""
    return dict(enumerate(np.random.default_rng(1).integers(0, 12, (150, 2)).astype(float)))


def line():
    """Ever wider gaps: the tree is one long chain."""
    return dict(enumerate(np.cumsum(np.geomspace(0.01, 10, 120))[:, None]))


@pytest.mark.parametrize("make, k, min_size, min_samples, block", [(blobs, 12, 5, 5, 50), (copies, 8, 4, 4, 16), (grid, 6, 3, 2, 2048), (line, 5, 5, 3, 2048)])
def test_density_clusters(spark, make, k, min_size, min_samples, block):
    vectors = make()
    df = frame(spark, vectors)
    graph = neighbours.nearest(df, "key", "e", k, block=block)
    plain = sorted(tuple(r) for r in graph.collect())
    assert plain == sorted(brute.nearest(vectors, k))
    rounds = density.spanning_forest(density.mutual_reachability(graph, min_samples))
    assert sorted((r["w"], r["u"], r["v"]) for r in density.forest_edges(rounds).collect()) == brute.forest(plain, min_samples)
    got = {r["key"]: r["cluster"] for r in density.labels(df.select("key"), graph, min_size, min_samples).collect()}
    assert got == brute.density_clusters(list(vectors), plain, min_size, min_samples)
    assert make is line or len(set(got.values())) > 2


def test_density_query(spark):
    """The registered query over the whole table against the tree of all pairs."""
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{SF01}/embeddings.parquet").collect()}
    got = {r["vec_id"]: r["cluster"] for r in catalog.queries()["density_clusters"](spark, SF01).collect()}
    want = brute.density_clusters(list(vectors), brute.nearest(vectors, 15), 5, 5)
    assert got == want
    assert 0 < sum(c == density.NOISE for c in got.values()) < len(got)


def test_few_points(spark):
    """Without rows there is nothing, a point alone is noise, one group alone is the root and no cluster."""
    none = frame(spark, {0: [0.0]}).limit(0)
    assert neighbours.nearest(none, "key", "e").count() == 0
    for n in (1, 4, 9):
        vectors = {i: [float(i)] for i in range(n)}
        df = frame(spark, vectors)
        got = density.labels(df.select("key"), neighbours.nearest(df, "key", "e", 5), 5).collect()
        assert {r["key"]: r["cluster"] for r in got} == dict.fromkeys(vectors, density.NOISE)


def test_rows_that_cannot_be_compared(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (None, [1.0, 1.0]), (6, [0.0, float("inf")]), (7, [])]
    got = neighbours.nearest(spark.createDataFrame(rows, "key long, e array<float>"), "key", "e", 2).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, 0.0), (1, 2, 7, 1.0), (2, 1, 1, 0.0), (2, 2, 7, 1.0), (7, 1, 1, 1.0), (7, 2, 2, 1.0)]


def test_recall_of_the_buckets(spark):
    """At least nine tenths of the true neighbours of the rows whose id 20 divides."""
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    assert neighbours.recall(catalog.queries()["similar_vectors"](spark, SF01), e, "vec_id", "embedding") >= 0.9


def test_a_hot_bucket_is_many_groups(spark):
    """Rows of one bucket are spread over its blocks' pairs, and copies of one vector are no special case."""
    df = spark.range(3000).selectExpr("id AS key", "array(1.0D, 2.0D) AS v", "0L AS code")
    sizes = [r["count"] for r in neighbours._block_pairs(df, 300).count().collect()]
    assert len(sizes) == 55 and max(sizes) < 900
    got = neighbours.nearest(df.selectExpr("key", "v AS e"), "key", "e", 3, tables=3, bits=2, block=300)
    assert {(r["u"], r["distance"]) for r in got.collect()} == {(i, 0.0) for i in range(3000)} and got.count() == 9000


def test_rows_are_sent_out_in_proportion(spark):
    """Ten times the rows are ten times the rows sent out, until a block would be too large for a task."""
    def sent(n, block):
        df = spark.range(n).selectExpr("id AS key", "array(1.0D) AS v", "0L AS code")
        return sum(r["count"] for r in neighbours._block_pairs(df, block).count().collect())

    assert sent(3000, 10) == 3000 * neighbours.BLOCKS and sent(30000, 10) == 30000 * neighbours.BLOCKS


def test_rows_of_many_buckets_are_sent_out_once_each(spark):
    """Many buckets are tasks enough: a bucket is cut only where it is large beside all of them."""
    df = spark.range(32000).selectExpr("id AS key", "array(1.0D) AS v", "id % 320 AS code")
    assert sum(r["count"] for r in neighbours._block_pairs(df, 10).count().collect()) == 32000
    hot = df.selectExpr("key", "v", "if(key % 2 = 0, 0L, code) AS code")
    groups = neighbours._block_pairs(hot, 10).count().where("code = 0").collect()
    assert len(groups) == 78 and max(r["count"] for r in groups) < 4000


def test_tiles_find_the_nearest(monkeypatch):
    """Ties, copies and a row among its own neighbours, over tiles that cut them anywhere."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(neighbours, "TILE", 7)
    x = np.round(rng.normal(size=(40, 3)), 1)
    x[10:25] = x[3]
    keys = rng.permutation(40)
    order = np.argsort(keys)
    keys, x = keys[order], x[order]
    for k in (1, 4, 39, 60):
        u, v, d = neighbours._nearest_of(keys, x, keys, x, k)
        want = []
        for i in range(40):
            e = neighbours.exact_distances(np.repeat(x[i:i + 1], 40, axis=0), x)
            want += [(keys[i], keys[j], e[j]) for j in sorted((j for j in range(40) if j != i), key=lambda j: (e[j], keys[j]))[:k]]
        assert sorted(zip(u, v, d)) == sorted(want)


def test_nearest_centroid(spark):
    df = spark.createDataFrame([(1, [3.0, 0.1]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, []), (5, [0.0, 0.0, 9.0])], "key long, e array<double>")
    got = neighbours.nearest_centroid(df, [(7, [0.0, 5.0]), (4, [1.0, 0.0])], "key", "e").collect()
    assert sorted(map(tuple, got)) == [(1, 4, 3.0), (2, 7, 2.0), (3, 4, 1.0), (4, 4, 0.0), (5, 4, 0.0)]
    assert {tuple(r)[1:] for r in neighbours.nearest_centroid(df, [], "key", "e").collect()} == {(-1, None)}
