"""Registered queries: EDGAR submissions (E1-E15) and the clean-text output name."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import edgar as E
from ..functions import lexicons as L
from ..functions.html import html_to_text_sql
from ..functions.regexkit import py_strip_sql, sql_str
from ..operators import filings as FL
from ..sources import derived
from .catalog import query

NL2 = "chr(10) || chr(10)"


def _blocks_sql(lenient: bool = False) -> str:
    return f"""blk AS (
  SELECT f, primary_form, unnest(generate_series(0, len(l) - 1)) AS seq, unnest(l) AS block
  FROM (SELECT f, {E.primary_form_sql('raw')} AS primary_form,
               {E.document_blocks_sql('raw', lenient)} AS l FROM filings) s
)"""


# E2-E10, E13 ---------------------------------------------------------------
def _edgar_blocks_sql() -> str:
    return f"""WITH {derived.filings_sql()}, {_blocks_sql()},
b2 AS (SELECT *, {E.doc_type_strict_sql('block')} AS doc_type,
              {E.text_body_greedy_sql('block')} AS body_greedy,
              {E.text_body_lazy_sql('block')} AS body_lazy FROM blk)
SELECT f, seq, primary_form, doc_type,
  {E.tag_value_sql('block', 'TYPE', L.UNKNOWN_TYPE)} AS type_lenient,
  {E.tag_value_sql('block', 'FILENAME', '')} AS filename,
  {E.is_junk_type_sql('doc_type')} AS is_junk,
  {E.is_xbrl_aux_sql('doc_type')} AS is_xbrl_aux,
  {E.keep_block_sql('doc_type', 'primary_form')} AS keep,
  length(body_greedy) AS greedy_len, md5(body_greedy) AS greedy_md5,
  length(body_lazy) AS lazy_len,
  {E.looks_like_html_sql('body_greedy')} AS is_html
FROM b2"""


@query("edgar_blocks", ("E2", "E3", "E4", "E5", "E6", "E7", "E8", "E9", "E10", "E13"),
       _edgar_blocks_sql)
def edgar_blocks(spark, sf_dir):
    b = FL.block_fields(FL.document_blocks(derived.filings(spark, sf_dir)))
    return b.select(
        "f", F.col("seq").cast("bigint").alias("seq"), "primary_form", "doc_type", "type_lenient",
        "filename", "is_junk", "is_xbrl_aux", "keep",
        F.length("body_greedy").cast("bigint").alias("greedy_len"),
        F.md5("body_greedy").alias("greedy_md5"),
        F.length("body_lazy").cast("bigint").alias("lazy_len"),
        E.looks_like_html(F.col("body_greedy")).alias("is_html"))


# E1, E2 --------------------------------------------------------------------
def _edgar_header_sql() -> str:
    return f"""WITH {derived.filings_sql()}
SELECT f, {E.sec_header_sql('raw')} AS header, {E.primary_form_sql('raw')} AS primary_form
FROM filings"""


@query("edgar_header", ("E1", "E2"), _edgar_header_sql)
def edgar_header(spark, sf_dir):
    fl = derived.filings(spark, sf_dir)
    return fl.select("f", E.sec_header(F.col("raw")).alias("header"),
                     E.primary_form(F.col("raw")).alias("primary_form"))


# E6-E9, E12, E13, H1 on kept blocks ------------------------------------------
def _clean_body_sql(expr: str) -> str:
    return py_strip_sql(f"CASE WHEN {E.looks_like_html_sql(expr)} THEN {html_to_text_sql(expr)} "
                        f"ELSE {expr} END")


def _kept_sections_ctes() -> str:
    return f"""{derived.filings_sql()}, {_blocks_sql()},
typed AS (SELECT f, seq, primary_form, block, {E.doc_type_strict_sql('block')} AS doc_type FROM blk),
kept AS (SELECT f, seq, doc_type, {E.text_body_greedy_sql('block')} AS body0 FROM typed
         WHERE {E.keep_block_sql('doc_type', 'primary_form')}),
cut AS (SELECT f, seq, doc_type, {E.drop_leading_gunk_sql('body0')} AS body1 FROM kept),
sections AS (SELECT * FROM (SELECT f, seq, doc_type, {_clean_body_sql('body1')} AS body FROM cut) s
             WHERE body <> '')"""


def _kept_sections_sql() -> str:
    return f"WITH {_kept_sections_ctes()}\nSELECT f, seq, doc_type, body FROM sections"


@query("kept_sections", ("E6", "E7", "E8", "E9", "E12", "E13", "H1", "N1", "N2", "N3", "N4"),
       _kept_sections_sql)
def kept_sections(spark, sf_dir):
    s = FL.kept_sections(derived.filings(spark, sf_dir))
    return s.select("f", F.col("seq").cast("bigint").alias("seq"), "doc_type", "body")


# E14, E15 ------------------------------------------------------------------
def _clean_filings_sql() -> str:
    banner = (f"{sql_str(L.SECTION_BANNER_PREFIX)} || doc_type || {sql_str(L.SECTION_BANNER_SUFFIX)}")
    return f"""WITH {_kept_sections_ctes()},
agg AS (SELECT f, string_agg({banner} || chr(10) || body, {NL2} ORDER BY seq) AS s
        FROM sections GROUP BY f)
SELECT fl.f, {py_strip_sql(f"concat_ws({NL2}, {E.sec_header_sql('fl.raw')}, coalesce(agg.s, ''))")} AS clean_text
FROM filings fl LEFT JOIN agg ON fl.f = agg.f"""


@query("clean_filings", ("E1", "E14", "E15", "H1"), _clean_filings_sql)
def clean_filings(spark, sf_dir):
    return FL.clean_filings(derived.filings(spark, sf_dir))


# E3 lenient, E5, E10 -----------------------------------------------------------
def _submission_blocks_ctes() -> str:
    return f"""{derived.filings_sql()},
lb0 AS (
  SELECT f || '.txt' AS source_file, unnest(generate_series(0, len(l) - 1)) AS seq, unnest(l) AS block
  FROM (SELECT f, {E.document_blocks_sql('raw', True)} AS l FROM filings) s
),
lb AS (
  SELECT source_file, seq, {E.tag_value_sql('block', 'TYPE', L.UNKNOWN_TYPE)} AS doc_type,
         {E.tag_value_sql('block', 'FILENAME', '')} AS doc_filename,
         {E.text_body_lazy_sql('block')} AS raw_text
  FROM lb0 WHERE {E.has_text_tag_sql('block')}
)"""


def _submission_blocks_sql() -> str:
    return f"""WITH {_submission_blocks_ctes()}
SELECT source_file, seq, doc_type, doc_filename, length(raw_text) AS text_len, md5(raw_text) AS text_md5
FROM lb"""


def _submission_blocks_df(spark, sf_dir):
    fl = derived.filings(spark, sf_dir).withColumn("source_file", F.concat(F.col("f"), F.lit(".txt")))
    return FL.submission_blocks(fl)


@query("submission_blocks", ("E3", "E5", "E10"), _submission_blocks_sql)
def submission_blocks(spark, sf_dir):
    b = _submission_blocks_df(spark, sf_dir)
    return b.select("source_file", F.col("seq").cast("bigint").alias("seq"), "doc_type", "doc_filename",
                    F.length("raw_text").cast("bigint").alias("text_len"),
                    F.md5("raw_text").alias("text_md5"))


def _preferred_sql() -> str:
    pref = ", ".join(sql_str(p) for p in L.PREFERRED_TYPES)
    return f"""WITH {_submission_blocks_ctes()}
SELECT source_file, seq, doc_type FROM lb
WHERE doc_type IN ({pref}) OR NOT (SELECT coalesce(bool_or(doc_type IN ({pref})), false) FROM lb)"""


@query("preferred_blocks", ("E11", "J9", "J10"), _preferred_sql)
def preferred_blocks(spark, sf_dir):
    b = FL.preferred_blocks(_submission_blocks_df(spark, sf_dir))
    return b.select("source_file", F.col("seq").cast("bigint").alias("seq"), "doc_type")


# E12 -----------------------------------------------------------------------
def _gunk_sql() -> str:
    return f"""WITH {derived.gunk_text_sql()}
SELECT doc_id, md5(t) AS text_md5, length(t) AS text_len, left(t, 40) AS head
FROM (SELECT doc_id, {E.drop_leading_gunk_sql('text')} AS t FROM gunk_text) s"""


@query("gunk_cut", ("E12",), _gunk_sql)
def gunk_cut(spark, sf_dir):
    g = derived.gunk_text(spark, sf_dir)
    t = E.drop_leading_gunk(F.col("text"))
    return g.select("doc_id", F.md5(t).alias("text_md5"), F.length(t).cast("bigint").alias("text_len"),
                    F.substring(t, 1, 40).alias("head"))
