"""Dump goldens, topic tables, relational helpers and model invariants."""

import os

from pyspark.sql import functions as F

from ledgerlens.operators import dump as D
from ledgerlens.operators import relational as R
from ledgerlens.operators import topic_tables as TT
from ledgerlens.sources.readers import read_topic_dumps
from tests.conftest import SF001

FIX = os.path.join(os.path.dirname(__file__), "fixtures")


def _parsed(spark):
    dumps = read_topic_dumps(spark, FIX)
    return dumps, D.parse_any(D.dump_lines(dumps))


def test_dump_goldens(spark):
    dumps, parsed = _parsed(spark)
    mw = {(r.file, r.topic): (round(r.max_weight, 4), round(r.s, 4)) for r in
          parsed.groupBy("file", "topic").agg(F.max("weight").alias("max_weight"), F.sum("weight").alias("s")).collect()}
    a = {t: v for (f, t), v in mw.items() if f == "dump_format_a.txt"}
    b = {t: v for (f, t), v in mw.items() if f == "dump_format_b.txt"}
    # topics without terms have no row, the last line of an id counts, ties keep their order
    assert a == {0: (0.21, 0.62), 1: (0.25, 0.6), 4: (0.9, 1.3)}
    assert b == {0: (0.3, 0.54), 3: (0.4, 0.45)}
    names = {(r.file, r.topic): r.topic_name for r in TT.topic_names(parsed).collect()}
    assert names == {("dump_format_a.txt", 0): "river, bridge, boat", ("dump_format_a.txt", 1): "rye, oats, barn",
                     ("dump_format_a.txt", 4): "snow, ice", ("dump_format_b.txt", 0): "sail, harbour, rope",
                     ("dump_format_b.txt", 3): "lamp, oil"}


def test_duplicate_and_empty_topic_lines(spark):
    text = "(1, '0.2*\"a\" + 0.5*\"b\"')\n(2, 'none')\n(1, '0.1*\"c\" + 0.1*\"d\"')"
    dumps = spark.createDataFrame([("f.txt", text)], "file string, text string")
    rows = D.parse_any(D.dump_lines(dumps)).orderBy("topic", "rank").collect()
    assert [(r.topic, r.term) for r in rows] == [(1, "c"), (1, "d")]   # last wins, ties keep order


def test_summary_and_categories(spark):
    dumps, parsed = _parsed(spark)
    s = {r.file: r.topic_summary for r in TT.topic_summary(parsed, dumps).collect()}
    assert s["dump_format_a.txt"].startswith("Topic 4: snow:0.900, ice:0.400\nTopic 1: rye:0.250")
    cat = TT.categorize(parsed, dumps).collect()
    assert all(0.0 <= r.Confidence <= 1.0 for r in cat)
    assert [r.Document for r in sorted(cat, key=lambda r: r.FileName)] == [0, 1]


def test_row_positions_and_first_wins(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    pos = R.row_positions(df.repartition(7), [F.col("k")]).collect()
    assert sorted((r.row_no, r.k) for r in pos) == [(i, i) for i in range(1000)]
    m = spark.createDataFrame([("a", 1, 5, "x"), ("a", 0, 9, "y"), ("b", 1, 1, "z")],
                              "file_name string, part int, pos int, speaker string")
    out = {r.file_name: r.speaker for r in R.first_wins(m, "file_name", ("part", "pos"), ("speaker",)).collect()}
    assert out == {"a": "y", "b": "z"}


def test_lda_invariants(spark):
    from ledgerlens.plans.q_models import lda_parts
    from ledgerlens.operators.lda import doc_topics
    toks, vectors, terms, model = lda_parts(spark, SF001, k=4)
    th = doc_topics(model, vectors, "file_name")
    sums = th.groupBy("file_name").agg(F.sum("theta").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-6 for r in sums)
    assert {r.topic for r in th.select("topic").distinct().collect()} <= set(range(4))


def test_stage_row_counts(spark):
    from ledgerlens.plans import speech as SP
    obs = {}
    n = SP.speech_sample(spark, SF001, obs).count()
    assert obs["sample_rows"].get["rows"] == n
    assert obs["meta_rows"].get["rows"] >= obs["meta_distinct_rows"].get["rows"] >= obs["meta_dated_rows"].get["rows"]


def test_k_sweep_small_grid(spark):
    from ledgerlens.operators import coherence as CO
    from ledgerlens.operators import lda as LDA
    from ledgerlens.plans.q_models import lda_parts
    toks, vectors, terms, _ = lda_parts(spark, SF001, k=2)

    def score(model):
        words = LDA.topic_terms(model, terms, 20)
        return CO.model_coherence(CO.coherence_cv(toks, words, "file_name"))

    grid = LDA.k_sweep(vectors, score, ks=(2, 3), alphas=("symmetric",), betas=("symmetric",), passes=2)
    rows = grid.collect()
    assert len(rows) == 4 and {r.Topics for r in rows} == {2, 3}
    assert all(-1.0 <= r.Coherence <= 1.0 for r in rows)


def test_classifier_hook(spark):
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(TT.CATEGORY_SCHEMA)
    def by_length(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"category": ["long" if len(x) > 200 else "short" for x in s],
                             "confidence": [0.5] * len(s), "rationale": ["length"] * len(s)})

    dumps, parsed = _parsed(spark)
    rows = TT.categorize_with(parsed, dumps, by_length).collect()
    assert len(rows) == 2 and {r.Category for r in rows} <= {"long", "short"}
    assert all(r.Confidence == 0.5 for r in rows)


def test_keyword_strings_hold_twenty_terms(spark):
    from ledgerlens.sources import derived
    r = derived.fixed_topics(spark, SF001)
    kw = TT.keyword_string(TT.ctfidf(r, "topic", "tokens", top_n=20), n_words=20).collect()
    assert kw and all(len(k.keywords.split(" + ")) == 20 for k in kw)


def test_merge_plan_reaches_the_target():
    from ledgerlens.operators.clusters import merge_plan
    ids = list(range(15))
    none = [(a, b, 0.0) for a in ids for b in ids if a < b]
    assert len(set(merge_plan(none, ids, 10).values())) == 10
    # average, not single, linkage: 2 is close to 1 alone, 3 is fairly close to both
    sims = {(0, 1): 0.9, (0, 2): 0.0, (1, 2): 0.7, (0, 3): 0.5, (1, 3): 0.5, (2, 3): 0.1}
    plan = merge_plan([(a, b, s) for (a, b), s in sims.items()], [0, 1, 2, 3], 2)
    assert plan == {0: 0, 1: 0, 3: 0, 2: 2}


def test_disjoint_topics_outliers_and_reassignment(spark):
    from ledgerlens.operators import clusters as CL
    rows = [(t * 10 + i, [f"w{t}_{j}" for j in range(4)] * 2, t) for t in range(15) for i in range(6)]
    rows += [(900, ["w3_0", "w3_1", "w3_2"], -1), (901, ["w3_0", "w4_0"], 7), (902, ["nothing", "known"], -1), (903, [], -1)]
    docs = spark.createDataFrame(rows, "row long, tokens array<string>, cluster int")
    v = CL.topic_vectors(docs, "cluster")
    sims = CL.topic_similarity(v).collect()
    assert len(sims) == 15 * 14 // 2 and all(0.0 <= r.sim < 0.1 for r in sims)
    far = {r.row: r.cluster for r in CL.far_outliers(docs, v, "row", min_cosine=0.5).collect()}
    assert far[901] == -1 and all(far[t * 10] == t for t in range(15))
    near = {r.row: r.topic for r in CL.reassign(docs, v, "row").collect()}
    assert near[900] == 3 and near[902] == -1 and near[903] == -1 and all(near[t * 10] == t for t in range(15))
    out = CL.reduce_topics(docs, 10, "row").collect()
    assert len(out) == len(rows) and len({r.topic for r in out if r.topic >= 0}) == 9
    sizes = [sum(r.topic == t for r in out) for t in range(9)]
    assert sizes == sorted(sizes, reverse=True)


def test_clusters_do_not_depend_on_the_partitioning(spark):
    from ledgerlens.operators import clusters as CL
    e = spark.read.parquet(f"{SF001}/embeddings.parquet").select("vec_id", "embedding")
    one, other = ({r.vec_id: r.cluster for r in CL.cluster(e.repartition(n), 10, key="vec_id").collect()} for n in (2, 8))
    assert one == other


def test_topic_distance_of_disjoint_topics(spark):
    import math

    from ledgerlens.operators import topic_map as TM
    phi = spark.createDataFrame([(0, "a", 0.5), (0, "b", 0.5), (1, "c", 1.0), (2, "a", 0.5), (2, "b", 0.5)], "topic int, term string, p double")
    got = {(r.t1, r.t2): round(r.js, 9) for r in TM.js_distance(phi).collect()}
    ln2 = round(math.log(2), 9)
    assert got == {(0, 1): ln2, (0, 2): 0.0, (1, 2): ln2}


def test_every_document_has_a_dominant_topic_row(spark):
    theta = spark.createDataFrame([("a", 0, 0.25), ("a", 1, 0.75)], "file_name string, topic int, theta double")
    docs = spark.createDataFrame([("a", 0, "text a"), ("b", 1, "")], "file_name string, document long, text string")
    kw = spark.createDataFrame([(0, "x"), (1, "y")], "topic int, keywords string")
    rows = sorted(map(tuple, TT.dominant_table(docs, theta, kw).collect()))
    assert rows == [(0, "a", 1, 0.75, "y", "text a"), (1, "b", None, None, None, "")]


def test_no_silent_checkpoint_folder():
    import pytest

    from ledgerlens.session import ensure_checkpoint_dir

    class Context:
        master = "spark://elsewhere:7077"

        def getConf(self):
            return {}

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_grid_fits_take_the_operators_passes(monkeypatch):
    """lda_grid may run few points of the grid, but each as the grid has it."""
    from ledgerlens.plans import q_models

    class Seen(Exception):
        pass

    def k_sweep(vectors, score, **kw):
        raise Seen(kw)

    monkeypatch.setattr(q_models, "lda_parts", lambda spark, sf_dir: (None,) * 4)
    monkeypatch.setattr(q_models.LDA, "k_sweep", k_sweep)
    try:
        q_models.lda_grid(None, "")
    except Seen as seen:
        assert "passes" not in seen.args[0]
    else:
        raise AssertionError("no sweep")


def test_coordinates_keep_plane_distances(spark):
    """Points of a plane come back up to turns; signs by rule; one topic and none."""
    import numpy as np

    from ledgerlens.operators import topic_map as TM
    p = np.random.default_rng(8).normal(size=(7, 2)) * (3, 1)
    pairs = [(i, j, float(np.linalg.norm(p[i] - p[j]))) for i in range(7) for j in range(i + 1, 7)]
    rows = TM.coordinates(spark.createDataFrame(pairs, "t1 int, t2 int, js double"), list(range(7))).orderBy("topic").collect()
    x = np.array([(r.x1, r.x2) for r in rows])
    assert all(abs(np.linalg.norm(x[i] - x[j]) - d) < 1e-9 for i, j, d in pairs)
    assert (x[np.abs(x).argmax(axis=0), [0, 1]] > 0).all() and x[:, 0].var() > x[:, 1].var()
    none = spark.createDataFrame([], "t1 int, t2 int, js double")
    assert [tuple(r) for r in TM.coordinates(none, [4]).collect()] == [(4, 0.0, 0.0)]
    assert TM.coordinates(none, []).collect() == []


def test_rankings_and_token_shares(spark):
    from ledgerlens.operators import topic_map as TM
    phi = spark.createDataFrame([(0, "a", 0.8), (0, "b", 0.2), (1, "a", 0.5), (1, "c", 0.5), (1, "d", 0.0)], "topic int, term string, p double")
    prev = spark.createDataFrame([(0, 0.25), (1, 0.75)], "topic int, share double")
    got = {(r.term, r.topic): round(r.share, 9) for r in TM.token_shares(phi, prev).collect()}
    assert got == {("a", 0): round(0.2 / 0.575, 9), ("a", 1): round(0.375 / 0.575, 9), ("b", 0): 1.0, ("c", 1): 1.0}
    first = {(r.lam, r.topic): r.term for r in TM.rankings(phi, prev, (0.0, 1.0), 1).collect()}
    assert first == {(0.0, 0): "b", (1.0, 0): "a", (0.0, 1): "c", (1.0, 1): "a"}       # by lift, by share; a and c tie in topic 1


def test_scores_do_not_depend_on_how_terms_meet(spark, monkeypatch):
    """Few weights go to the terms, many meet them by a shuffle; a document's terms move in the second case alone."""
    from ledgerlens.operators import clusters as CL
    rows = [(i % 40 or None, [f"w{j % 13}" for j in range(i, i + 9)] * (1 + i % 2), i % 4 - 1) for i in range(60)] + [(77, [], 0), (78, None, 1)]
    docs = spark.createDataFrame(rows, "row long, tokens array<string>, cluster int")
    v = CL.topic_vectors(docs, "cluster")
    got, moved = [], []
    for most in (10**6, 0):
        monkeypatch.setattr(CL, "MOST_WEIGHTS", most)
        scores = CL.topic_scores(docs, v, "row")
        got.append(sorted((r["row"] or 0, r["topic"], round(r["score"], 9)) for r in scores.collect()))
        moved.append(scores._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
    assert got[0] == got[1] and len(got[0]) > 100 and moved[0] < moved[1]


def test_many_weights_go_to_the_documents_in_parts(spark, monkeypatch):
    """No term of a document is shuffled, and the parts of the terms make the sums that all of them make."""
    from ledgerlens.operators import clusters as CL
    rows = [(i % 40 or None, [f"w{j % 13}" for j in range(i, i + 9)] * (1 + i % 2), i % 4 - 1) for i in range(60)] + [(77, [], 0), (78, None, 1)]
    docs = spark.createDataFrame(rows, "row long, tokens array<string>, cluster int")
    v = CL.topic_vectors(docs, "cluster")
    want = sorted((r["row"] or 0, r["topic"], round(r["score"], 9)) for r in CL.topic_scores(docs, v, "row").collect())
    written, write = [], CL.write_once
    monkeypatch.setattr(CL, "write_once", lambda df, name: (written.append((name, df.columns)), write(df, name))[1])
    monkeypatch.setattr(CL, "MOST_WEIGHTS", 5)
    got = CL.topic_scores(docs, v, "row")
    assert sorted((r["row"] or 0, r["topic"], round(r["score"], 9)) for r in got.collect()) == want and len(want) > 100
    assert {n for n, _ in written} == {"term-topics", "topic-sums"} and len(written) > 3
    assert all(c == ["row", "topic", "score"] for n, c in written if n == "topic-sums")


def test_terms_of_documents_are_shuffled_by_document_alone(spark):
    """One count by document and term serves dictionary and bag; no row a term is shuffled by document and term. Keys repeat or are null."""
    from ledgerlens.operators import vocab as V
    docs = spark.createDataFrame([("x", ["a", "b", "a"]), ("x", ["a"]), (None, ["b", "c"]), (None, ["c"]), ("y", []), ("z", None)], "k string, tokens array<string>")
    counts = V.document_terms(docs, "k")
    assert sorted(((r.k or "", r.term, r.tf) for r in counts.collect())) == [("", "b", 1), ("", "c", 2), ("x", "a", 3), ("x", "b", 1)]
    assert counts._jdf.queryExecution().sparkPlan().toString().count("REPARTITION_BY_COL") == 1
    assert "ENSURE_REQUIREMENTS" not in counts._jdf.queryExecution().executedPlan().toString()
    kw = {"no_below": 1, "no_above": 1.0}
    vocab = V.dictionary(docs, "k", **kw)
    assert vocab.collect() == V.dictionary(docs, "k", counts=counts, n_docs=6, **kw).collect()
    for bag in (V.bag_of_words(docs, vocab, "k"), V.bag_of_words(docs, vocab, "k", counts=counts)):
        names = {r.term_id: r.term for r in vocab.collect()}
        assert sorted((r.k or "", names[r.term_id], r.n) for r in bag.collect()) == [("", "b", 1), ("", "c", 2), ("x", "a", 3), ("x", "b", 1)]


def test_the_grid_fits_its_own_points_alone(spark, monkeypatch):
    """lda_grid scores four fits of two and three topics; the model of the other queries isn't fitted for it."""
    from ledgerlens.plans import q_models
    fitted, fit = [], q_models.LDA.fit_lda
    monkeypatch.setattr(q_models.LDA, "fit_lda", lambda vectors, k, **kw: (fitted.append(k), fit(vectors, k=k, **{**kw, "passes": 1}))[1])
    monkeypatch.setattr(q_models, "_grids", {})
    monkeypatch.setattr(q_models, "_fits", {})
    assert q_models.lda_grid(spark, SF001).count() == 4
    assert sorted(fitted) == [2, 2, 3, 3]
