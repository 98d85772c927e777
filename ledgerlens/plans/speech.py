"""Speech corpus job: metadata reconciliation -> tokens -> phrases -> vocabulary.

Every step is a DataFrame function; this module only wires them in the order
of the topic-analysis workload.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.tokens import exclude_words, preprocess_speech
from ..operators import phrases as PH
from ..operators import relational as R
from ..operators import vocab as V  # noqa: F401  (re-exported for plans)
from ..session import materialize, write_once
from ..sources import derived


def _observed(df: DataFrame, name: str, observations: dict | None) -> DataFrame:
    """Row count of a stage as an observed metric (no extra job)."""
    if observations is None:
        return df
    obs = Observation(name)
    observations[name] = obs
    return df.observe(obs, F.count(F.lit(1)).alias("rows"))


def speech_sample(spark: SparkSession, sf_dir: str, observations: dict | None = None) -> DataFrame:
    """Speeches joined to first-wins metadata dated after the cut-off.

    With ``observations`` (a dict), the row counts of each stage are recorded
    as ``Observation`` metrics filled by the first action (J14).
    """
    pre, post = derived.meta_parts(spark, sf_dir)
    meta = _observed(R.union_parts(pre, post), "meta_rows", observations)
    meta = _observed(R.first_wins(meta, "file_name", ("part", "pos"), ("date", "speaker")),
                     "meta_distinct_rows", observations)
    meta = _observed(meta.where(F.col("date") > F.lit(L.SPEECH_DATE_AFTER).cast("date")),
                     "meta_dated_rows", observations)
    sp = _observed(derived.speeches(spark, sf_dir).select("file_name", "text", "year"),
                   "speech_rows", observations)
    return _observed(sp.join(meta, "file_name", "inner"), "sample_rows", observations)


def speech_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K10 tokens (K8: the token list) of the speech sample."""
    s = speech_sample(spark, sf_dir)
    return s.select("file_name", "year", "date", preprocess_speech(F.col("text")).alias("tokens"))


def phrase_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PH.phrase_scores(materialize(speech_tokens(spark, sf_dir)))


def final_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K12 then K13: phrase-joined tokens without the analyst exclusion list."""
    # the token table feeds six branches (counts, vocabulary size, pairs, join):
    # written once, read six times
    toks = materialize(speech_tokens(spark, sf_dir))
    applied = PH.apply_phrases(toks, PH.phrase_scores(toks), "file_name")
    return applied.withColumn("tokens", exclude_words(F.col("tokens")))


def _dictionary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tokens, terms of each document, dictionary): the text job runs once, for the written terms; documents are counted on the way."""
    seen = Observation()
    toks = final_tokens(spark, sf_dir).observe(seen, F.count(F.lit(1)).alias("rows"))
    counts = write_once(V.document_terms(toks, "file_name"), "document-terms")
    return toks, counts, V.dictionary(toks, "file_name", counts=counts, n_docs=seen.get["rows"])


def speech_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dictionary(spark, sf_dir)[2]


def speech_bow(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks, counts, vocab = _dictionary(spark, sf_dir)
    return V.bag_of_words(toks, vocab, "file_name", counts=counts)
