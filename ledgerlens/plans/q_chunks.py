"""Registered queries: HTML cleaners, normalisation, sentences, chunks, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import lexicons as L
from ..functions import tokens as T
from ..functions.markup import pages_to_text
from ..operators import chunks as C
from ..operators import filings as FL
from ..sources import derived
from ..sources.tables import table
from .catalog import query
from .q_edgar import _submission_blocks_ctes, _submission_blocks_df


# H1 + N1-N4 on web pages: the element scanner against a regex chain in SQL, equal on well-formed pages
def _html_text_sql() -> str:
    return f"SELECT page_id, {H.html_to_text_sql('html')} AS text FROM pages"


@query("html_text", ("H1", "N1", "N2", "N3", "N4"), _html_text_sql)
def html_text(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return pages_to_text(p.select("page_id", F.col("html").alias("text")), "text")


def _html_flat_sql() -> str:
    return f"SELECT page_id, {H.html_flat_sql('html')} AS text FROM pages"


@query("html_flat", ("H2",), _html_flat_sql)
def html_flat(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", H.html_flat(F.col("html")).alias("text"))


# N5, N6, N7 on documents ------------------------------------------------------
def _boilerplate_sql() -> str:
    return f"""SELECT doc_id, {H.strip_numbers_sql(H.strip_boilerplate_sql('text'))} AS text,
  {H.looks_like_table_sql('text')} AS table_like FROM documents"""


@query("boilerplate_numbers", ("N5", "N6", "N7"), _boilerplate_sql)
def boilerplate_numbers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", H.strip_numbers(H.strip_boilerplate(F.col("text"))).alias("text"),
                    H.looks_like_table(F.col("text")).alias("table_like"))


# N8 ------------------------------------------------------------------------
def _sentences_sql() -> str:
    return f"""SELECT doc_id, unnest(generate_series(0, len(s) - 1)) AS sent_no, unnest(s) AS sentence
FROM (SELECT doc_id, {H.split_sentences_sql('text')} AS s FROM documents) t"""


@query("sentences", ("N8",), _sentences_sql)
def sentences(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    s = d.select("doc_id", F.posexplode_outer(H.split_sentences(F.col("text"))).alias("sent_no", "sentence"))
    return s.where(F.col("sentence").isNotNull()).select(
        "doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "sentence")


# N9, N10, N12 on raw document text ------------------------------------------
def _sentence_chunks_sql() -> str:
    return f"""SELECT doc_id, unnest(generate_series(0, len(c) - 1)) AS chunk_id, unnest(c) AS chunk,
  length(unnest(c)) AS chunk_chars
FROM (SELECT doc_id, {C.chunk_text_sql('text')} AS c FROM documents) t"""


@query("sentence_chunks", ("N8", "N9", "N10", "N12"), _sentence_chunks_sql)
def sentence_chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", C.chunk_text(F.col("text")).alias("chunks"))
    r = C.explode_chunks(d, "chunks", ("doc_id",))
    return r.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), "chunk",
                    F.col("chunk_chars").cast("bigint").alias("chunk_chars"))


# N13 = E3/E5/E10/E11 + H2/N5/N6/K9 + N11 + N9/N10 + N7 + N12 -------------------
def _chunk_corpus_sql() -> str:
    from ..functions.regexkit import sql_str
    pref = ", ".join(sql_str(p) for p in L.PREFERRED_TYPES)
    return f"""WITH {_submission_blocks_ctes()},
pb AS (SELECT * FROM lb WHERE doc_type IN ({pref})
       OR NOT (SELECT coalesce(bool_or(doc_type IN ({pref})), false) FROM lb)),
cl AS (SELECT source_file, doc_type, doc_filename, {C.finance_clean_text_sql('raw_text')} AS cleaned FROM pb),
ch AS (SELECT source_file, doc_type, doc_filename, {C.chunk_text_sql('cleaned')} AS c
       FROM cl WHERE length(cleaned) >= {L.MIN_CLEANED_CHARS}),
rows AS (SELECT source_file, doc_type, doc_filename, unnest(generate_series(0, len(c) - 1)) AS chunk_id,
                unnest(c) AS chunk FROM ch)
SELECT source_file, doc_type, doc_filename, chunk_id, length(chunk) AS chunk_chars, md5(chunk) AS chunk_md5
FROM rows WHERE NOT {H.looks_like_table_sql('chunk', L.TABLE_MIN_CHARS, L.TABLE_DIGIT_RATIO)}"""


def chunk_corpus_df(spark, sf_dir):
    return C.chunk_corpus(FL.preferred_blocks(_submission_blocks_df(spark, sf_dir)))


@query("chunk_corpus", ("N7", "N11", "N12", "N13", "E11", "K9"), _chunk_corpus_sql)
def chunk_corpus(spark, sf_dir):
    r = chunk_corpus_df(spark, sf_dir)
    return r.select("source_file", "doc_type", "doc_filename",
                    F.col("chunk_id").cast("bigint").alias("chunk_id"),
                    F.col("chunk_chars").cast("bigint").alias("chunk_chars"),
                    F.md5("chunk").alias("chunk_md5"))


# N14 -----------------------------------------------------------------------
def _dates_sql() -> str:
    return f"WITH {derived.dated_text_sql()}\nSELECT id, {T.extract_date_sql('text')} AS date FROM dated_text"


@query("extract_dates", ("N14",), _dates_sql)
def extract_dates(spark, sf_dir):
    d = derived.dated_text(spark, sf_dir)
    return d.select("id", T.extract_date(F.col("text")).alias("date"))
