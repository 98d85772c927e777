"""End-to-end jobs for the three entry points of the workload.

Each job wires existing operators; nothing here holds rows on the driver.

* ``clean_filings_job``  manifest CSV + mapping table + archive folder ->
  clean-text parquet + per-row outcomes (S1, S2, S3, E15, S6, J8, J11, J12).
* ``topic_analysis_job`` corpus CSV + metadata CSVs -> topic text, dominant
  topic and proportion CSVs (S4, J4-J7, K10-K13, V1-V3, T1-T3, S7, S8, P1, P2).
* ``topic_summary_job``  folder of topic dumps -> categorised and long CSVs
  (S5, P3-P12, S7).
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.tokens import exclude_words, preprocess_speech
from ..operators import coherence as CO
from ..operators import dump as D
from ..operators import lda as LDA
from ..operators import manifest as M
from ..operators import phrases as PH
from ..operators import relational as R
from ..operators import topic_tables as TT
from ..operators import vocab as V
from ..operators.filings import clean_filings
from ..session import materialize
from ..sources import readers, sinks


def clean_filings_job(spark: SparkSession, manifest_csv: str, mapping: DataFrame, archive_root: str,
                      out_dir: str, keep_header: bool = True, batch: int = 10_000) -> DataFrame:
    """Resolve, read, clean and write; returns the outcome counts.

    ``mapping`` has (fname, archive_path), the path below ``archive_root``:
    that exact file is opened, whatever other files share its name. Outcomes
    are resolved on a listing of paths; content is read for the wanted files
    that are there, each once, ``batch`` files a job, and goes through a
    narrow map straight into the sink. Only paths pass the driver, a batch at
    a time. A listed file that gives no row could not be read: FAILED.
    """
    resolved = materialize(M.resolve(readers.read_manifest(spark, manifest_csv), mapping))
    wanted = resolved.select("archive_path").where(F.col("archive_path").isNotNull()).distinct()
    there = materialize(readers.list_files(spark, archive_root).join(wanted, "archive_path", "left_semi"))
    mode = "overwrite"
    paths = (r["archive_path"] for r in there.toLocalIterator())
    while some := list(itertools.islice(paths, batch)):
        cleaned = clean_filings(readers.read_archive(spark, archive_root, some), keep_header=keep_header, keep=("archive_path",))
        sinks.write_clean_filings(cleaned, out_dir, mode=mode)
        mode = "append"
    if mode == "overwrite":
        return M.outcome_counts(M.outcomes(resolved, there.withColumn("error", F.lit(None).cast("string"))))
    read = spark.read.parquet(out_dir).select(F.col("source").alias("archive_path"), F.lit(True).alias("_read"))
    listing = there.join(read, "archive_path", "left").select(
        "archive_path", F.when(F.col("_read").isNull(), F.lit("unreadable")).alias("error"))
    return M.outcome_counts(M.outcomes(resolved, listing))


def topic_analysis_job(spark: SparkSession, corpus_csv: str, meta_csvs: list[str], out_dir: str,
                       k: int = L.LDA_K) -> dict[str, DataFrame]:
    """Corpus -> tokens -> phrases -> dictionary -> LDA -> topic tables (written as CSV)."""
    speeches = readers.read_corpus(spark, corpus_csv)
    parts = [readers.read_metadata(spark, p) for p in meta_csvs]
    meta = R.first_wins(R.union_parts(*parts), "file_name", ("part", "pos"), ("date", "speaker"))
    meta = meta.where(F.col("date") > F.lit(L.SPEECH_DATE_AFTER).cast("date"))
    sample = speeches.join(meta, "file_name", "inner")
    # the text goes along to the dominant-topic table; the row number is the corpus order
    sample = R.row_positions(sample, [F.col("year"), F.col("file_name")], "document")
    sample = materialize(sample.select("file_name", "document", "date", "text"))
    toks = materialize(sample.select("file_name", preprocess_speech(F.col("text")).alias("tokens")))
    final = PH.apply_phrases(toks, PH.phrase_scores(toks), "file_name")
    final = materialize(R.fixed_order(final.withColumn("tokens", exclude_words(F.col("tokens"))), "file_name"))
    vocab = V.dictionary(final, "file_name")
    vectors, terms = LDA.vectorize(final, vocab)
    vectors = materialize(vectors.select("file_name", "features"))
    model = LDA.fit_lda(vectors, k=k)
    LDA.save_model(model, terms, f"{out_dir}/model")
    words = LDA.topic_terms(model, terms, 100)
    theta = LDA.doc_topics(model, vectors, "file_name")
    kw10 = words.where(F.col("rank") <= 10).groupBy("topic").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))),
                                 lambda x: x["term"]), ", ").alias("keywords"))
    dominant = TT.dominant_table(sample, theta, kw10)
    export = TT.export_table(sample, theta)
    coherence = CO.coherence_cv(final, words, "file_name")
    sinks.write_topic_text(TT.keyword_string(words, n_words=100, fixed=True), f"{out_dir}/topics_text")
    sinks.write_csv(dominant, f"{out_dir}/dominant_topic", order_by=("Document_No",))
    sinks.write_csv(export, f"{out_dir}/topic_proportions", order_by=("Document", "Topic"))
    return {"dominant": dominant, "proportions": export, "coherence": coherence, "topics": words}


def topic_summary_job(spark: SparkSession, dump_folder: str, out_dir: str) -> dict[str, DataFrame]:
    """Topic dumps -> categorised documents and long topic proportions (CSV)."""
    dumps = materialize(readers.read_topic_dumps(spark, dump_folder))
    parsed = materialize(D.parse_any(D.dump_lines(dumps)))
    categorized = TT.categorize(parsed, dumps)
    long = TT.long_proportions(parsed, dumps)
    sinks.write_csv(categorized, f"{out_dir}/categorized_documents", order_by=("Document",))
    sinks.write_csv(long, f"{out_dir}/topic_proportions", order_by=("Document", "Topic"))
    return {"categorized": categorized, "long": long}
