"""Topic-map statistics (T12): prevalence, relevance, saliency, inter-topic distance, coordinates, token shares, rankings.

Given topic-term distributions ``phi(topic, term, p)`` and per-document topic
weights ``theta(doc, topic, w)`` with document lengths, the data part of an
interactive topic map [Sievert & Shirley 2014; Chuang et al. 2012]. Every
table is an aggregate or a join on (topic, term); the topic x topic distance
table has k^2 rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topic_tables import top_n_per_group


def prevalence(theta: DataFrame, lengths: DataFrame, key: str) -> DataFrame:
    """(topic, share): sum over documents of theta * length, normalised."""
    j = theta.join(lengths, key)
    s = j.groupBy("topic").agg(F.sum(F.col("theta") * F.col("len")).alias("mass"))
    total = s.agg(F.sum("mass")).scalar()
    return s.select("topic", (F.col("mass") / total).alias("share"))


def term_stats(phi: DataFrame, prev: DataFrame, lam: float = 0.6) -> DataFrame:
    """(topic, term, p, relevance, saliency).

    p(w) = sum_t p(t) phi(t, w); lift = phi / p(w);
    relevance = lam * ln(phi) + (1 - lam) * ln(lift);
    saliency(w) = p(w) * sum_t p(t|w) ln(p(t|w) / p(t)), p(t|w) = p(t) phi(t, w) / p(w).
    """
    # one row a topic: bounded by k
    j = phi.where(F.col("p") > 0).join(F.broadcast(prev), "topic")
    sp = F.col("share") * F.col("p")
    # saliency in one pass: p(w) sum_t p(t|w) ln(p(t|w) / p(t)) = sum_t p(t) phi ln(phi) - p(w) ln p(w)
    w = j.groupBy("term").agg(F.sum(sp).alias("pw"), F.sum(sp * F.log("p")).alias("plp"))
    w = w.select("term", "pw", (F.col("plp") - F.col("pw") * F.log("pw")).alias("saliency"))
    return j.join(w, "term").select(
        "topic", "term", "p",
        (F.lit(lam) * F.log("p") + F.lit(1 - lam) * F.log(F.col("p") / F.col("pw"))).alias("relevance"),
        "saliency")


def js_distance(phi: DataFrame) -> DataFrame:
    """(t1, t2, js): Jensen-Shannon divergence between topic-term distributions (t1 < t2).

    Terms present in only one of the two topics contribute ``p * ln 2``, so
    only shared terms are joined (term-keyed join, no topic cross product):
    JS = 1/2 [sum_shared (p1 ln(2 p1 / (p1 + p2)) + p2 ln(2 p2 / (p1 + p2)))
              + ln 2 * (P1 - S1 + P2 - S2)], with P the topic's total mass and
    S its mass on shared terms. Every pair has a row; one without a shared term
    has S = 0, so JS = ln 2.
    """
    ln2 = math.log(2.0)
    tot = phi.groupBy("topic").agg(F.sum("p").alias("tot"))
    a = phi.where(F.col("p") > 0).select(F.col("topic").alias("t1"), "term", F.col("p").alias("p1"))
    b = phi.where(F.col("p") > 0).select(F.col("topic").alias("t2"), "term", F.col("p").alias("p2"))
    j = a.join(b, "term").where(F.col("t1") < F.col("t2"))
    s = F.col("p1") + F.col("p2")
    shared = j.groupBy("t1", "t2").agg(
        F.sum(F.col("p1") * F.log(2 * F.col("p1") / s) + F.col("p2") * F.log(2 * F.col("p2") / s)).alias("kl"),
        F.sum("p1").alias("s1"), F.sum("p2").alias("s2"))
    # all pairs from the list of topics: k values, and k (k - 1) / 2 rows
    topics = tot.agg(F.array_sort(F.collect_list(F.struct("topic", "tot"))).alias("ts"))
    one = topics.select("ts", F.explode("ts").alias("x")).select("x", F.explode("ts").alias("y"))
    every = one.where(F.col("x.topic") < F.col("y.topic")).select(
        F.col("x.topic").alias("t1"), F.col("y.topic").alias("t2"), F.col("x.tot").alias("P1"), F.col("y.tot").alias("P2"))
    r = every.join(shared, ["t1", "t2"], "left").na.fill(0.0, ["kl", "s1", "s2"])
    js = (F.col("kl") + F.lit(ln2) * (F.col("P1") - F.col("s1") + F.col("P2") - F.col("s2"))) / 2
    return r.select("t1", "t2", js.alias("js"))


def coordinates(distances: DataFrame, topics: list[int], dims: int = 2) -> DataFrame:
    """(topic, x1 .. x_dims): the topics' places by classical scaling of (t1, t2, js) [Torgerson 1952].

    The squared distances, centred by rows and columns, and their largest
    eigenvectors times the roots of the eigenvalues (0 for one that is not
    positive). Of each axis the component that is farthest out is positive (ties: the
    smaller topic). The table of pairs has k (k - 1) / 2 rows, for k topics.
    """
    spark = distances.sparkSession
    at = {t: i for i, t in enumerate(sorted(topics))}
    d = np.zeros((len(at), len(at)))
    for r in distances.select("t1", "t2", "js").collect():
        d[at[r["t1"]], at[r["t2"]]] = d[at[r["t2"]], at[r["t1"]]] = r["js"]
    squares = d * d
    mean = squares.mean(axis=0) if at else squares
    eigen, vectors = np.linalg.eigh(-(squares - mean - mean[:, None] + (mean.mean() if at else 0)) / 2)
    places = np.zeros((len(at), dims))
    for c, j in enumerate(range(len(at) - 1, max(len(at) - 1 - dims, -1), -1)):
        x = vectors[:, j] * math.sqrt(max(eigen[j], 0.0))
        places[:, c] = -x if x[np.argmax(np.round(np.abs(x), 9))] < 0 else x
    rows = [(t, *(float(v) for v in places[i])) for t, i in at.items()]
    return spark.createDataFrame(rows, "topic int, " + ", ".join(f"x{c + 1} double" for c in range(dims)))


def token_shares(phi: DataFrame, prev: DataFrame) -> DataFrame:
    """(term, topic, share): of all uses of the term that the model expects, the share of the topic."""
    # one row a topic: bounded by k
    j = phi.where(F.col("p") > 0).join(F.broadcast(prev), "topic").withColumn("mass", F.col("share") * F.col("p"))
    total = j.groupBy("term").agg(F.sum("mass").alias("total"))
    return j.join(total, "term").select("term", "topic", (F.col("mass") / F.col("total")).alias("share"))


def rankings(phi: DataFrame, prev: DataFrame, lams: tuple[float, ...] = tuple(i / 10 for i in range(11)), top_n: int = 30) -> DataFrame:
    """(lam, topic, rank, term, relevance): for each weight, each topic's ``top_n`` terms by relevance to nine places; ties: the earlier term.

    Totals and logarithms are computed once for all weights.
    """
    # one row a topic: bounded by k
    j = phi.where(F.col("p") > 0).join(F.broadcast(prev), "topic")
    total = j.groupBy("term").agg(F.sum(F.col("share") * F.col("p")).alias("pw"))
    both = j.join(total, "term").select("topic", "term", F.log("p").alias("own"), F.log(F.col("p") / F.col("pw")).alias("lift"))
    rows = both.withColumn("lam", F.explode(F.array(*[F.lit(float(x)) for x in lams])))
    relevance = F.round(F.col("lam") * F.col("own") + (1 - F.col("lam")) * F.col("lift"), 9) + F.lit(0.0)
    rows = rows.select("lam", "topic", "term", relevance.alias("relevance"))
    return top_n_per_group(rows, ["lam", "topic"], [F.desc("relevance"), F.asc("term")], top_n, salt_col="term").select(
        "lam", "topic", "rank", "term", "relevance")
