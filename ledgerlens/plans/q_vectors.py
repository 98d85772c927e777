"""Registered queries over dense vectors: dense embedding (V5), neighbour graph, density clusters (T6), reassignment."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from ..operators import dense
from ..operators import density as DE
from ..operators import neighbours as NB
from ..sources.tables import table
from .catalog import query
from .q_chunks import chunk_corpus_df

#: Neighbours of a row in the graph under the clusters, itself not counted.
GRAPH_K = 15


def _embeddings(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _nearest_sql() -> str:
    return f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
d AS (SELECT a.vec_id AS u, b.vec_id AS v, round(list_distance(a.x, b.x), 9) AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id)
SELECT u, rank::INT AS rank, v, distance FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY distance, v) AS rank FROM d) WHERE rank <= {GRAPH_K}"""


@query("nearest_vectors", ("T6",), _nearest_sql)
def nearest_vectors(spark, sf_dir):
    """The exact neighbour graph, in blocks."""
    return NB.nearest(_embeddings(spark, sf_dir), "vec_id", "embedding", GRAPH_K)


@query("similar_vectors", ("T6",))
def similar_vectors(spark, sf_dir):
    """The neighbour graph over random-projection buckets; the tests hold its recall."""
    return NB.nearest(_embeddings(spark, sf_dir), "vec_id", "embedding", 10, tables=20, bits=4)


@query("density_clusters", ("T6",))
def density_clusters(spark, sf_dir):
    e = _embeddings(spark, sf_dir)
    graph = NB.nearest(e, "vec_id", "embedding", GRAPH_K)
    return DE.labels(e.select(F.col("vec_id").alias("key")), graph, min_size=5).select(F.col("key").alias("vec_id"), "cluster")


def _vector_reassign_sql() -> str:
    return """WITH x AS (SELECT vec_id, vec_id % 9 AS topic, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
c AS (SELECT topic, i, avg(x) AS c FROM x GROUP BY 1, 2),
n AS (SELECT topic, sqrt(sum(c * c)) AS n FROM c GROUP BY 1),
s AS (SELECT vec_id, c.topic, round(sum(x * c) / any_value(n), 9) AS score FROM x JOIN c ON c.i = x.i JOIN n ON n.topic = c.topic GROUP BY 1, 2)
SELECT vec_id, arg_max(topic, (score, -topic))::INT AS topic, max(score) AS score FROM s GROUP BY 1"""


@query("vector_reassign", ("T8",), _vector_reassign_sql)
def vector_reassign(spark, sf_dir):
    """Every vector to the nearest of nine fixed groups' mean vectors."""
    e = _embeddings(spark, sf_dir)
    means = NB.centroids(e.withColumn("topic", F.col("vec_id") % 9), "topic", "embedding")
    return NB.nearest_centroid(e, means, "vec_id", "embedding")


# V5: truncated SVD ---------------------------------------------------------------------
@query("dense_chunks", ("V5",))
def dense_chunks(spark, sf_dir):
    """The chunk corpus with unit vectors of 64 numbers; the tests hold them against numpy's decomposition."""
    chunks = chunk_corpus_df(spark, sf_dir).select("source_file", "doc_type", "doc_filename", "chunk_id", F.split("chunk", " ").alias("tokens"))
    return dense.dense_embed(chunks, rank=64).drop("tokens")


def _whole(spark, sf_dir):
    e = NB.usable(_embeddings(spark, sf_dir), "vec_id", "embedding").select("key", array_to_vector("v").alias("features"))
    return e, dense.truncated_svd(e, rank=64)


def _usable_ctes() -> str:
    return """x AS (SELECT vec_id, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)"""


def _dense_lengths_sql() -> str:
    return f"WITH {_usable_ctes()} SELECT vec_id, round(sum(x * x), 6) AS square FROM x GROUP BY 1"


@query("dense_lengths", ("V5",), _dense_lengths_sql)
def dense_lengths(spark, sf_dir):
    """Projection on all 64 singular vectors of the given vectors keeps every length."""
    rows, svd = _whole(spark, sf_dir)
    out = dense.project(svd, rows, unit=False)
    square = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return out.select(F.col("key").alias("vec_id"), F.round(square, 6).alias("square"))


def _singular_moments_sql() -> str:
    return f"""WITH {_usable_ctes()},
g AS (SELECT a.i, b.i AS j, sum(a.x * b.x) AS g FROM x a JOIN x b ON a.vec_id = b.vec_id GROUP BY 1, 2)
SELECT 1 AS power, round(sum(g) FILTER (i = j), 6) AS moment FROM g UNION ALL SELECT 2, round(sum(g * g), 6) FROM g
UNION ALL SELECT 3, round(sum(a.g * b.g * c.g), 6) FROM g a JOIN g b ON b.i = a.j JOIN g c ON c.i = b.j AND c.j = a.i"""


@query("singular_moments", ("V5",), _singular_moments_sql)
def singular_moments(spark, sf_dir):
    """Sums of the second, fourth and sixth powers of the singular values, which are traces of powers of the components' products."""
    _, svd = _whole(spark, sf_dir)
    values = [(p, float((svd.values ** (2 * p)).sum())) for p in (1, 2, 3)]
    return spark.createDataFrame(values, "power int, moment double").withColumn("moment", F.round("moment", 6))
