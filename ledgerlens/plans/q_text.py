"""Registered queries: text reports, EDGAR parsing, cleaning, chunking, tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.html import decode_entities
from ..functions.regexkit import sql_str
from ..operators import report
from ..sources import derived
from ..sources.tables import table
from .catalog import query


# ---------------------------------------------------------------------------
# K9 + K14: top words with share of all words (flagship)
# ---------------------------------------------------------------------------
def _word_frequency_sql() -> str:
    return f"""WITH {derived.doc_tokens_sql()},
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM doc_tokens) GROUP BY term)
SELECT term, n, round(n * 100.0::DOUBLE / (SELECT sum(n)::DOUBLE FROM counts), 4) AS pct
FROM counts ORDER BY n DESC, term ASC LIMIT {L.TOP_WORDS_REPORT}"""


@query("word_frequency", ("K9", "K14", "H2", "N5", "N6"), _word_frequency_sql)
def word_frequency(spark, sf_dir):
    return report.word_frequency(derived.doc_tokens(spark, sf_dir))


def _theme_distribution_sql() -> str:
    rows = ", ".join(f"('{w}', '{t}')" for t, ws in L.THEMES.items() for w in dict.fromkeys(ws))
    return f"""WITH {derived.doc_tokens_sql()},
counts AS (SELECT term, count(*) AS n FROM (SELECT unnest(tokens) AS term FROM doc_tokens) GROUP BY term),
lex(word, theme) AS (VALUES {rows})
SELECT t.theme, coalesce(w.words, 0)::BIGINT AS words,
       round(coalesce(w.words, 0) * 100.0::DOUBLE / (SELECT sum(n)::DOUBLE FROM counts), 4) AS pct
FROM (SELECT DISTINCT theme FROM lex) t LEFT JOIN (
  SELECT theme, sum(n) AS words FROM counts JOIN lex ON counts.term = lex.word GROUP BY theme) w
ON t.theme = w.theme"""


@query("theme_distribution", ("K15",), _theme_distribution_sql)
def theme_distribution(spark, sf_dir):
    return report.theme_distribution(derived.doc_tokens(spark, sf_dir))


# ---------------------------------------------------------------------------
# H1/H2: references of every kind. The text carries a reference in Spark and
# what it stands for in DuckDB, so the two sides share no decoding step.
# ---------------------------------------------------------------------------
# FIXED VALUES: references and the code points that they stand for.
REFERENCES = (
    ("&#8226;", (8226,)), ("&#8211;", (8211,)), ("&#146;", (8217,)), ("&#x92;", (8217,)), ("&eacute;", (233,)),
    ("&euro;", (8364,)), ("&#x2014;", (8212,)), ("&#X2014", (8212,)), ("&#8212", (8212,)), ("&copy", (169,)),
    ("&notit;", (172, 105, 116, 59)), ("&notin;", (8713,)), ("&amp;lt;", (38, 108, 116, 59)), ("&AMP;", (38,)),
    ("&nosuchname;", tuple(map(ord, "&nosuchname;"))), ("&#0;", (65533,)), ("&#xD800;", (65533,)),
    ("&#99999999999;", (65533,)), ("&#1;", ()), ("&#129;", (129,)), ("&fjlig;", (102, 106)), ("&NotEqualTilde;", (8770, 824)),
    ("&#x1F4C8;", (128200,)), ("&ampx", (38, 120)), ("&", (38,)), ("&&lt;", (38, 60)), ("&nbsp;", (160,)),
)


def _entity_text_sql() -> str:
    rows = ", ".join(f"({i}, {' || '.join(f'chr({c})' for c in to) or sql_str('')})" for i, (_, to) in enumerate(REFERENCES))
    return f"""WITH refs(i, decoded) AS (VALUES {rows})
SELECT doc_id, md5(replace(text, '&', '+') || '[' || decoded || '] ' || lang) AS text_md5
FROM documents JOIN refs ON doc_id % {len(REFERENCES)} = i"""


@query("entity_text", ("H1", "H2"), _entity_text_sql)
def entity_text(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    ref = F.get(F.array(*[F.lit(a) for a, _ in REFERENCES]), (F.col("doc_id") % len(REFERENCES)).cast("int"))
    page = F.concat(F.replace("text", F.lit("&"), F.lit("+")), F.lit("["), ref, F.lit("] "), "lang")
    return d.select("doc_id", F.md5(decode_entities(page)).alias("text_md5"))
