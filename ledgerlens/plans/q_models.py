"""Registered queries: coherence, topic map, LDA and cluster topics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..operators import clusters as CL
from ..operators import coherence as CO
from ..operators import lda as LDA
from ..operators import relational as R
from ..operators import topic_map as TM
from ..operators import topic_tables as TT
from ..sources import derived, sinks
from ..sources.tables import table
from ..session import materialize, scratch_path, write_once
from . import speech as SP
from .catalog import query
from .q_chunks import _chunk_corpus_sql, chunk_corpus_df
from .q_speech import _bow_sql, _sample_ctes
from .q_topics import _ctfidf_ctes

W = L.COHERENCE_WINDOW


# T3 on fixed topic groups --------------------------------------------------------
def _coherence_sql() -> str:
    return f"""WITH {_ctfidf_ctes(L.COHERENCE_TOPN)},
tw AS (SELECT topic, term FROM cwords WHERE rank <= {L.COHERENCE_TOPN}),
vocab AS (SELECT DISTINCT term FROM tw),
docs AS (SELECT doc_id, tokens, greatest(1, len(tokens) - {W} + 1) AS nw FROM fixed_topics),
occ AS (SELECT * FROM (SELECT doc_id, nw, unnest(generate_series(0, len(tokens) - 1)) AS pos, unnest(tokens) AS term
                       FROM docs) x WHERE term IN (SELECT term FROM vocab)),
nwin AS (SELECT sum(nw)::DOUBLE AS n FROM (SELECT DISTINCT doc_id, nw FROM occ) r),
win AS (SELECT DISTINCT doc_id, unnest(generate_series(greatest(0, pos - {W} + 1), least(pos, nw - 1))) AS s, term FROM occ),
wcnt AS (SELECT term, count(*) AS c FROM win GROUP BY term),
pairs AS (SELECT DISTINCT x.term AS w1, y.term AS w2 FROM tw x JOIN tw y ON x.topic = y.topic AND x.term < y.term),
co AS (SELECT a.term AS w1, b.term AS w2, count(*) AS c12 FROM win a
       JOIN pairs p ON p.w1 = a.term JOIN win b ON a.doc_id = b.doc_id AND a.s = b.s AND b.term = p.w2 GROUP BY 1, 2),
off AS (SELECT p.w1, p.w2, coalesce(co.c12, 0) AS c12, c1.c AS c1, c2.c AS c2 FROM pairs p
        LEFT JOIN co ON co.w1 = p.w1 AND co.w2 = p.w2 JOIN wcnt c1 ON c1.term = p.w1 JOIN wcnt c2 ON c2.term = p.w2),
sym AS (SELECT w1, w2, c12, c1, c2 FROM off UNION ALL SELECT w2, w1, c12, c2, c1 FROM off
        UNION ALL SELECT term, term, c, c, c FROM wcnt),
m AS (SELECT w1, w2, ln((c12 / n + {L.EPSILON}) / ((c1 / n) * (c2 / n))) / (-ln(c12 / n + {L.EPSILON})) AS npmi
      FROM sym, nwin),
tm AS (SELECT a.topic, a.term AS w1, b.term AS w2, m.npmi FROM tw a JOIN tw b ON a.topic = b.topic
       JOIN m ON m.w1 = a.term AND m.w2 = b.term),
vs AS (SELECT topic, w2, sum(npmi) AS vs FROM tm GROUP BY 1, 2),
pw AS (SELECT tm.topic, tm.w1, sum(tm.npmi * vs.vs) AS dot, sqrt(sum(tm.npmi * tm.npmi)) AS n1
       FROM tm JOIN vs ON tm.topic = vs.topic AND tm.w2 = vs.w2 GROUP BY 1, 2),
ns AS (SELECT topic, sqrt(sum(vs * vs)) AS ns FROM vs GROUP BY 1)
SELECT pw.topic, round(avg(dot / (n1 * ns)), 6) AS cv FROM pw JOIN ns ON pw.topic = ns.topic GROUP BY pw.topic"""


@query("coherence_cv", ("T3",), _coherence_sql)
def coherence_cv(spark, sf_dir):
    ft = materialize(derived.fixed_topics(spark, sf_dir))
    words = TT.ctfidf(ft, top_n=L.COHERENCE_TOPN)
    cv = CO.coherence_cv(ft, words, "doc_id")
    return cv.select("topic", F.round("cv", 6).alias("cv"))


# T12 on fixed topic groups --------------------------------------------------------
def _map_ctes() -> str:
    return f"""{derived.fixed_topics_sql()},
mw AS (SELECT doc_id, topic, unnest(tokens) AS term FROM fixed_topics),
tf AS (SELECT topic, term, count(*) AS n FROM mw GROUP BY 1, 2),
phi AS (SELECT topic, term, n::DOUBLE / sum(n) OVER (PARTITION BY topic) AS p FROM tf),
lens AS (SELECT doc_id, topic, len(tokens) AS len FROM fixed_topics),
prev AS (SELECT topic, mass / sum(mass) OVER () AS share FROM (SELECT topic, sum(len)::DOUBLE AS mass FROM lens GROUP BY 1) x),
pj AS (SELECT phi.topic, phi.term, phi.p, prev.share FROM phi JOIN prev ON phi.topic = prev.topic),
pw AS (SELECT term, sum(share * p) AS pw FROM pj GROUP BY 1),
sal AS (SELECT pj.term, pw.pw * sum((share * p / pw.pw) * ln((share * p / pw.pw) / share)) AS saliency
        FROM pj JOIN pw ON pj.term = pw.term WHERE p > 0 GROUP BY pj.term, pw.pw)"""


def _topic_map_sql() -> str:
    return f"""WITH {_map_ctes()}
SELECT pj.topic, pj.term, round(pj.p, 9) AS p,
       round(0.6 * ln(pj.p) + 0.4 * ln(pj.p / pw.pw), 6) AS relevance, round(sal.saliency, 9) AS saliency
FROM pj JOIN pw ON pj.term = pw.term JOIN sal ON sal.term = pj.term WHERE pj.p > 0"""


def _fixed_phi_theta(spark, sf_dir):
    ft = materialize(derived.fixed_topics(spark, sf_dir))      # feeds phi, theta and lengths
    words = ft.select("topic", F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
    tf = words.groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    tot = tf.groupBy("topic").agg(F.sum("n").alias("tot"))
    phi = tf.join(F.broadcast(tot), "topic").select("topic", "term", (F.col("n") / F.col("tot")).alias("p"))
    theta = ft.select("doc_id", "topic", F.lit(1.0).alias("theta"))
    lens = ft.select("doc_id", F.size("tokens").alias("len"))
    return phi, theta, lens


@query("topic_map_terms", ("T12",), _topic_map_sql)
def topic_map_terms(spark, sf_dir):
    phi, theta, lens = _fixed_phi_theta(spark, sf_dir)
    st = TM.term_stats(phi, TM.prevalence(theta, lens, "doc_id"))
    return st.select("topic", "term", F.round("p", 9).alias("p"), F.round("relevance", 6).alias("relevance"),
                     F.round("saliency", 9).alias("saliency"))


def _topic_distance_sql() -> str:
    return f"""WITH {_map_ctes()},
sh AS (SELECT a.topic AS t1, b.topic AS t2, a.p AS p1, b.p AS p2 FROM phi a JOIN phi b ON a.term = b.term AND a.topic < b.topic
       WHERE a.p > 0 AND b.p > 0),
tot AS (SELECT topic, sum(p) AS tot FROM phi GROUP BY 1),
agg AS (SELECT t1, t2, sum(p1 * ln(2 * p1 / (p1 + p2)) + p2 * ln(2 * p2 / (p1 + p2))) AS kl, sum(p1) AS s1, sum(p2) AS s2
        FROM sh GROUP BY 1, 2)
SELECT a.topic AS t1, b.topic AS t2,
       round((coalesce(kl, 0) + ln(2) * (a.tot - coalesce(s1, 0) + b.tot - coalesce(s2, 0))) / 2, 9) AS js
FROM tot a JOIN tot b ON a.topic < b.topic LEFT JOIN agg ON agg.t1 = a.topic AND agg.t2 = b.topic"""


@query("topic_distance", ("T12",), _topic_distance_sql)
def topic_distance(spark, sf_dir):
    phi, _, _ = _fixed_phi_theta(spark, sf_dir)
    return TM.js_distance(phi).select("t1", "t2", F.round("js", 9).alias("js"))


def _scaling_sql() -> str:
    """Double centring and, for each axis, the leading eigenvector by squaring the matrix 24 times."""
    parts = [f"""{_map_ctes()},
sh AS (SELECT a.topic AS t1, b.topic AS t2, a.p AS p1, b.p AS p2 FROM phi a JOIN phi b ON a.term = b.term AND a.topic <> b.topic),
agg AS (SELECT t1, t2, sum(p1 * ln(2 * p1 / (p1 + p2)) + p2 * ln(2 * p2 / (p1 + p2))) AS kl, sum(p1) AS s1, sum(p2) AS s2 FROM sh GROUP BY 1, 2),
ts AS (SELECT DISTINCT topic FROM phi),
sq AS (SELECT a.topic AS i, b.topic AS j, CASE WHEN a.topic = b.topic THEN 0 ELSE
 pow((coalesce(kl, 0) + ln(2) * (2 - coalesce(s1, 0) - coalesce(s2, 0))) / 2, 2) END AS d
 FROM ts a CROSS JOIN ts b LEFT JOIN agg ON t1 = a.topic AND t2 = b.topic),
b1 AS MATERIALIZED (SELECT i, j, -(d - avg(d) OVER (PARTITION BY i) - avg(d) OVER (PARTITION BY j) + avg(d) OVER ()) / 2 AS b FROM sq)"""]
    for axis in (1, 2):
        parts.append(f"m{axis}_0 AS MATERIALIZED (SELECT i, j, b + CASE WHEN i = j THEN (SELECT sqrt(sum(b * b)) FROM b{axis}) ELSE 0 END AS m FROM b{axis})")
        for n in range(24):
            parts.append(f"m{axis}_{n + 1} AS MATERIALIZED (SELECT x.i, y.j, sum(x.m * y.m) / (SELECT sum(m * m) FROM m{axis}_{n}) AS m"
                         f" FROM m{axis}_{n} x JOIN m{axis}_{n} y ON y.i = x.j GROUP BY 1, 2)")
        last = f"m{axis}_24"
        parts.append(f"""c{axis} AS (SELECT i, m FROM {last} WHERE j = (SELECT arg_max(i, m) FROM {last} WHERE i = j)),
v{axis} AS MATERIALIZED (SELECT i, m / (SELECT sqrt(sum(m * m)) FROM c{axis}) AS v FROM c{axis}),
l{axis} AS MATERIALIZED (SELECT sum(p.v * b * q.v) AS l FROM b{axis} JOIN v{axis} p ON p.i = b{axis}.i JOIN v{axis} q ON q.i = b{axis}.j),
x{axis} AS (SELECT i, v * sqrt(greatest(l, 0)) * CASE WHEN (SELECT arg_max(v, (round(abs(v), 9), -i)) FROM v{axis}) < 0 THEN -1 ELSE 1 END AS x
 FROM v{axis}, l{axis})""")
        if axis == 1:
            parts.append("b2 AS MATERIALIZED (SELECT b1.i, b1.j, b - l * p.v * q.v AS b FROM b1 JOIN v1 p ON p.i = b1.i JOIN v1 q ON q.i = b1.j, l1)")
    return "WITH " + ",\n".join(parts) + "\nSELECT x1.i AS topic, round(x1.x, 6) AS x1, round(x2.x, 6) AS x2 FROM x1 JOIN x2 ON x1.i = x2.i"


@query("topic_coordinates", ("T12",), _scaling_sql)
def topic_coordinates(spark, sf_dir):
    phi, _, _ = _fixed_phi_theta(spark, sf_dir)
    topics = [r["topic"] for r in phi.select("topic").distinct().collect()]       # one row a topic
    out = TM.coordinates(TM.js_distance(phi), topics)
    return out.select("topic", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


def _token_shares_sql() -> str:
    return f"""WITH {_map_ctes()}
SELECT pj.term, pj.topic, round(pj.share * pj.p / pw.pw, 9) AS share FROM pj JOIN pw ON pj.term = pw.term"""


@query("topic_token_shares", ("T12",), _token_shares_sql)
def topic_token_shares(spark, sf_dir):
    phi, theta, lens = _fixed_phi_theta(spark, sf_dir)
    shares = TM.token_shares(phi, TM.prevalence(theta, lens, "doc_id"))
    return shares.select("term", "topic", F.round("share", 9).alias("share"))


def _rankings_sql() -> str:
    return f"""WITH {_map_ctes()},
r AS (SELECT x / 10.0::DOUBLE AS lam, pj.topic, pj.term,
 round((x / 10.0::DOUBLE) * ln(pj.p) + (1 - x / 10.0::DOUBLE) * ln(pj.p / pw.pw), 9) AS relevance
 FROM pj JOIN pw ON pj.term = pw.term, generate_series(0, 10) g(x))
SELECT lam, topic, rank::INT AS rank, term, relevance FROM (SELECT *, row_number() OVER (PARTITION BY lam, topic ORDER BY relevance DESC, term) AS rank FROM r) q
WHERE rank <= 30"""


@query("topic_rankings", ("T12",), _rankings_sql)
def topic_rankings(spark, sf_dir):
    phi, theta, lens = _fixed_phi_theta(spark, sf_dir)
    return TM.rankings(phi, TM.prevalence(theta, lens, "doc_id"))


# T1, T2, T11, P1, P2 on a fitted LDA model --------------------------------------------
# A model's numbers have no SQL twin; each query has one beside it that checks
# what must hold for any fit: which documents, how many topics, sums, ranges.
_corpora: dict = {}
_fits: dict = {}


def lda_corpus(spark, sf_dir):
    """(tokens, dictionary, vectors, terms), shared by the fits of a session."""
    at = (spark.sparkContext.applicationId, sf_dir)
    if at not in _corpora:
        # reliable checkpoints: dictionary, vectors and coherence never recompute the text job
        toks = materialize(R.fixed_order(SP.final_tokens(spark, sf_dir), "file_name"))
        vocab = materialize(SP.V.dictionary(toks, "file_name"))
        vectors, terms = LDA.vectorize(toks, vocab)
        _corpora.clear()
        _corpora[at] = (toks, vocab, materialize(vectors.select("file_name", "year", "features")), terms)
    return _corpora[at]


def lda_parts(spark, sf_dir, k: int | None = None):
    """(tokens, vectors, terms, model) of the fit with ``k`` topics, shared by the queries of a session; without ``k`` nothing is fitted."""
    toks, _, vectors, terms = lda_corpus(spark, sf_dir)
    if k is None:
        return toks, vectors, terms, None
    at = (spark.sparkContext.applicationId, sf_dir, k)
    if at not in _fits:
        _fits.clear()
        _fits[at] = LDA.fit_lda(vectors, k=k, order=("year", "file_name"))
    return toks, vectors, terms, _fits[at]


@query("lda_theta", ("T1", "T2", "D14"))
def lda_theta(spark, sf_dir):
    _, vectors, _, model = lda_parts(spark, sf_dir, L.LDA_K)
    return LDA.doc_topics(model, vectors, "file_name")


def _theta_sums_sql() -> str:
    return f"""SELECT file_name, 1.0::DOUBLE AS theta, {L.LDA_K}::BIGINT AS topics, 0 AS first_topic, {L.LDA_K - 1} AS last_topic
FROM (SELECT DISTINCT file_name FROM ({_bow_sql()}) b) d"""


@query("lda_theta_sums", ("T1", "T2", "D14"), _theta_sums_sql)
def lda_theta_sums(spark, sf_dir):
    """Exactly the documents with a vocabulary term, each with all topics and the sum 1."""
    return lda_theta(spark, sf_dir).groupBy("file_name").agg(
        F.round(F.sum("theta"), 6).alias("theta"), F.countDistinct("topic").alias("topics"),
        F.min("topic").alias("first_topic"), F.max("topic").alias("last_topic"))


@query("lda_topics", ("T1", "T11"))
def lda_topics(spark, sf_dir):
    _, _, terms, model = lda_parts(spark, sf_dir, L.LDA_K)
    words = LDA.topic_terms(model, terms, 10)
    return TT.keyword_string(words, n_words=10, fixed=True)


def _lda_topic_terms_sql() -> str:
    return f"""SELECT t::INT AS topic, 10::BIGINT AS terms, 10::BIGINT AS known, true AS falling
FROM generate_series(0, {L.LDA_K - 1}) g(t) WHERE (SELECT count(DISTINCT term_id) FROM ({_bow_sql()}) b) >= 10"""


@query("lda_topic_terms", ("T1", "T11"), _lda_topic_terms_sql)
def lda_topic_terms(spark, sf_dir):
    """Ten different words of the dictionary for each topic, their weights falling with the rank."""
    _, _, terms, model = lda_parts(spark, sf_dir, L.LDA_K)
    words = LDA.topic_terms(model, terms, 10)
    vocab = lda_corpus(spark, sf_dir)[1].select("term", F.lit(1).alias("known"))
    w = F.array_sort(F.collect_list(F.struct("rank", "weight")))
    falling = F.forall(F.sequence(F.lit(0), F.lit(8)), lambda i: F.get("w", i)["weight"] >= F.get("w", i + 1)["weight"])
    return (words.join(vocab, "term", "left").groupBy("topic")
            .agg(F.countDistinct("term").alias("terms"), F.count("known").alias("known"), w.alias("w"))
            .select("topic", "terms", "known", falling.alias("falling")))


@query("lda_dominant_topic", ("P1", "P2", "T2", "D17", "D18"))
def lda_dominant_topic(spark, sf_dir):
    toks, vectors, terms, model = lda_parts(spark, sf_dir, L.LDA_K)
    theta = LDA.doc_topics(model, vectors, "file_name")
    kw = LDA.topic_terms(model, terms, 10).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                 lambda x: x["term"]), ", ").alias("keywords"))
    return TT.dominant_topic(theta, "file_name", kw, docs=toks.select("file_name", F.array_join("tokens", " ").alias("text")))


def _lda_dominant_check_sql() -> str:
    return f"""WITH {_sample_ctes()}
SELECT s.file_name, b.file_name IS NOT NULL AS has_topic, CASE WHEN b.file_name IS NOT NULL THEN true END AS at_least_a_share
FROM sample s LEFT JOIN (SELECT DISTINCT file_name FROM ({_bow_sql()}) x) b ON s.file_name = b.file_name"""


@query("lda_dominant_check", ("P1", "T2"), _lda_dominant_check_sql)
def lda_dominant_check(spark, sf_dir):
    """Every document; a topic exactly for those with a vocabulary term, its share at least 1 / k."""
    d = lda_dominant_topic(spark, sf_dir)
    return d.select("file_name", F.col("dominant_topic").isNotNull().alias("has_topic"),
                    (F.col("perc_contribution") >= 1.0 / L.LDA_K - 1e-4).alias("at_least_a_share"))


# T4, T5: a small part of the grid -----------------------------------------------------
def _grid_sql() -> str:
    rows = ", ".join(f"('{c}', {k}, 'asymmetric', 'symmetric')" for c, _ in L.GRID_CORPORA for k in (2, 3))
    return f"""SELECT *, true AS in_range FROM (VALUES {rows}) g("Validation_Set", "Topics", "Alpha", "Beta")"""


_grids: dict = {}


def grid_scores(spark, sf_dir):
    """Two topic counts on both corpora of the grid (75 % in row order, and all), the default passes each, scored by C_V."""
    at = (spark.sparkContext.applicationId, sf_dir) if spark else None
    if at is None or at not in _grids:
        toks, vectors, terms, _ = lda_parts(spark, sf_dir)

        def score(model):
            return CO.model_coherence(CO.coherence_cv(toks, LDA.topic_terms(model, terms, L.COHERENCE_TOPN), "file_name"))

        _grids[at] = LDA.k_sweep(vectors, score, ks=(2, 3), alphas=("asymmetric",), betas=("symmetric",))
    return _grids[at]


@query("lda_grid", ("T4", "T5", "D16"), _grid_sql)
def lda_grid(spark, sf_dir):
    grid = grid_scores(spark, sf_dir)
    return grid.select("Validation_Set", "Topics", "Alpha", "Beta", F.col("Coherence").between(-1.0, 1.0).alias("in_range"))


@query("lda_tuning", ("T4", "T5", "D16", "S7"))
def lda_tuning(spark, sf_dir):
    """The tuning table with its scores, written as CSV and read back."""
    path = scratch_path(spark, f"tuning-{uuid.uuid4().hex}")
    sinks.write_csv(grid_scores(spark, sf_dir), path, order_by=("Validation_Set", "Topics", "Alpha", "Beta"))
    return spark.read.option("header", True).schema(LDA.GRID_SCHEMA).csv(path)


# T7, T8 on fixed groups: exact --------------------------------------------------------
def _vector_ctes() -> str:
    """The whole class-based TF-IDF vectors of the fixed groups."""
    return f"""{_ctfidf_ctes(10)},
vec AS (SELECT topic, term, weight FROM cscored),
norm AS (SELECT topic, sqrt(sum(weight * weight)) AS n FROM vec GROUP BY 1)"""


def _similarity_sql() -> str:
    return f"""WITH {_vector_ctes()},
dots AS (SELECT a.topic AS t1, b.topic AS t2, sum(a.weight * b.weight) AS dot FROM vec a JOIN vec b ON a.term = b.term AND a.topic < b.topic
         GROUP BY 1, 2)
SELECT x.topic AS t1, y.topic AS t2, round(coalesce(dot, 0) / (x.n * y.n), 9) AS sim
FROM norm x JOIN norm y ON x.topic < y.topic LEFT JOIN dots ON t1 = x.topic AND t2 = y.topic"""


@query("fixed_topic_similarity", ("T7",), _similarity_sql)
def fixed_topic_similarity(spark, sf_dir):
    v = CL.topic_vectors(materialize(derived.fixed_topics(spark, sf_dir)))
    return CL.topic_similarity(materialize(v)).select("t1", "t2", F.round("sim", 9).alias("sim"))


def _reassign_sql() -> str:
    return f"""WITH {_vector_ctes()},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(tokens) AS term FROM fixed_topics) x GROUP BY 1, 2),
score AS (SELECT doc_id, vec.topic, round(sum(tf * weight / n), 9) AS s FROM tf JOIN vec ON tf.term = vec.term JOIN norm ON norm.topic = vec.topic
          GROUP BY 1, 2),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, topic) AS r FROM score) q WHERE r = 1)
SELECT d.doc_id, coalesce(best.topic, -1)::INT AS topic, round(best.s, 6) AS score FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id"""


@query("fixed_reassign", ("T8",), _reassign_sql)
def fixed_reassign(spark, sf_dir):
    # columns in compressed files: a checkpoint keeps a token in some 24 bytes
    ft = write_once(derived.fixed_topics(spark, sf_dir).select("doc_id", "tokens", "topic"), "fixed-topics")
    return CL.reassign(ft, CL.topic_vectors(ft), "doc_id").select("doc_id", "topic", F.round("score", 6).alias("score"))


# V5, T6-T8, T10, T13 cluster topics ----------------------------------------------------
_CHUNK_KEY = ("source_file", "doc_type", "doc_filename", "chunk_id")


def cluster_rows(spark, sf_dir):
    ch = chunk_corpus_df(spark, sf_dir).withColumn("tokens", F.split("chunk", " "))
    ch = materialize(R.row_positions(ch, [F.col(c) for c in _CHUNK_KEY], "row"))
    return CL.cluster_topics(ch, nr_topics=10, k0=20, min_topic_size=5)


@query("cluster_topics", ("V5", "T6", "T7", "T8", "T13", "D7", "D15"))
def cluster_topics(spark, sf_dir):
    r = cluster_rows(spark, sf_dir)
    return r.select("source_file", "doc_type", "doc_filename", "chunk_id", "chunk_chars", "topic")


def _cluster_check_sql() -> str:
    return f"""SELECT source_file, doc_type, doc_filename, chunk_id, 1::BIGINT AS n, true AS in_range FROM ({_chunk_corpus_sql()}) c"""


@query("cluster_topic_check", ("V5", "T6", "T7", "T8", "T13"), _cluster_check_sql)
def cluster_topic_check(spark, sf_dir):
    """Every chunk exactly once, its topic among the target's."""
    r = cluster_topics(spark, sf_dir)
    return r.groupBy(*_CHUNK_KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.col("topic").between(-1, 9)).alias("in_range")).withColumn(
        "chunk_id", F.col("chunk_id").cast("bigint"))


@query("cluster_topic_info", ("T9", "T10", "T11", "T13"))
def cluster_topic_info(spark, sf_dir):
    r = materialize(cluster_rows(spark, sf_dir))
    words = materialize(TT.ctfidf(r, "topic", "tokens", top_n=20))
    info = TT.topic_info(r, words)
    kw = TT.keyword_string(words, n_words=20)
    return info.join(F.broadcast(kw.withColumnRenamed("topic", "topic_id")), "topic_id", "left")


@query("embedding_clusters", ("V5", "T6"))
def embedding_clusters(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return CL.cluster(e, k0=10, min_topic_size=5, key="vec_id").select("vec_id", "cluster")


@query("embedding_cluster_check", ("V5", "T6"), lambda: "SELECT vec_id, 1::BIGINT AS n, true AS in_range FROM embeddings")
def embedding_cluster_check(spark, sf_dir):
    """Every vector exactly once, in one of ten clusters or none."""
    return embedding_clusters(spark, sf_dir).groupBy("vec_id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.col("cluster").between(-1, 9)).alias("in_range"))
