"""Derived views built from the driver tables (Spark builder + SQL twin).

The driver ships generic tables; the workload needs EDGAR submissions, a path
manifest, an archive mapping, a speech corpus with metadata, dated text and
topic dumps. Each view is derived deterministically from the driver tables, so
its size grows with them. The SQL twin is the same rule for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as L
from ..functions.regexkit import sql_str
from ..functions.tokens import preprocess_finance, preprocess_finance_sql
from .tables import table

NL = "\n"


def _case_by_index(idx: Column, values) -> Column:
    expr = None
    for i, v in enumerate(values):
        expr = F.when(idx == i, F.lit(v)) if expr is None else expr.when(idx == i, F.lit(v))
    return expr


def _case_by_index_sql(idx: str, values) -> str:
    return "CASE " + " ".join(f"WHEN {idx} = {i} THEN {sql_str(v)}" for i, v in enumerate(values)) + " END"


# ---------------------------------------------------------------------------
# filings(f, raw): one EDGAR submission per group of four documents
# ---------------------------------------------------------------------------
def filing_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    d = (docs.withColumn("f", F.floor(F.col("doc_id") / 4).cast("bigint"))
         .withColumn("q", (F.col("doc_id") % 4).cast("int")))
    d = d.join(pages, (d.f == pages.page_id) & (d.q == 1), "left")
    form = _case_by_index(F.col("f") % 5, L.VIEW_FORMS)
    dtype = (F.when(F.col("q") == 0, form)
             .when(F.col("q") == 1, F.lit(L.VIEW_EXHIBIT_99))
             .when(F.col("q") == 2, F.lit(L.VIEW_EXHIBIT_10))
             .otherwise(_case_by_index(F.col("f") % 4, L.VIEW_AUX_TYPES)))
    body = F.when(F.col("q") == 1, F.coalesce(F.col("html"), F.col("text"))).otherwise(F.col("text"))
    fname = F.concat(F.lit("d"), F.col("f"), F.lit("-"), F.col("q"),
                     F.when(F.col("q") == 1, F.lit(".htm")).otherwise(F.lit(".txt")))
    block = F.concat(F.lit("<DOCUMENT>\n<TYPE>"), dtype, F.lit("\n<SEQUENCE>"), F.col("q") + 1,
                     F.lit("\n<FILENAME>"), fname, F.lit("\n<TEXT>\n"), body,
                     F.lit("\n</TEXT>\n</DOCUMENT>"))
    return d.select("f", "q", form.alias("form"), block.alias("block"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = filing_blocks(spark, sf_dir)
    g = b.groupBy("f").agg(
        F.first("form").alias("form"),
        F.array_sort(F.collect_list(F.struct("q", "block"))).alias("bs"))
    header = F.concat(F.lit("<SEC-DOCUMENT>"), F.col("f"), F.lit(".txt\n<SEC-HEADER>"), F.col("f"),
                      F.lit(".hdr.sgml\nACCESSION NUMBER:\t\t"), F.lpad(F.col("f").cast("string"), 10, "0"),
                      F.lit("\nCONFORMED SUBMISSION TYPE:\t"), F.col("form"),
                      F.lit("\nPUBLIC DOCUMENT COUNT:\t\t4\n</SEC-HEADER>\n"))
    raw = F.concat(header, F.array_join(F.transform("bs", lambda s: s["block"]), NL),
                   F.lit("\n</SEC-DOCUMENT>\n"))
    return g.select("f", raw.alias("raw"))


def filings_sql() -> str:
    form = _case_by_index_sql("f % 5", L.VIEW_FORMS)
    aux = _case_by_index_sql("f % 4", L.VIEW_AUX_TYPES)
    return f"""filing_blocks AS (
  SELECT f, q, form,
    '<DOCUMENT>' || chr(10) || '<TYPE>' ||
      CASE q WHEN 0 THEN form WHEN 1 THEN {sql_str(L.VIEW_EXHIBIT_99)} WHEN 2 THEN {sql_str(L.VIEW_EXHIBIT_10)} ELSE {aux} END
      || chr(10) || '<SEQUENCE>' || (q + 1) || chr(10) || '<FILENAME>d' || f || '-' || q ||
      CASE WHEN q = 1 THEN '.htm' ELSE '.txt' END || chr(10) || '<TEXT>' || chr(10) ||
      CASE WHEN q = 1 THEN coalesce(html, text) ELSE text END ||
      chr(10) || '</TEXT>' || chr(10) || '</DOCUMENT>' AS block
  FROM (SELECT d.doc_id // 4 AS f, (d.doc_id % 4)::INT AS q, d.text, p.html,
               {form.replace('f % 5', '(d.doc_id // 4) % 5')} AS form
        FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id // 4 AND d.doc_id % 4 = 1) s
),
filings AS (
  SELECT f,
    '<SEC-DOCUMENT>' || f || '.txt' || chr(10) || '<SEC-HEADER>' || f || '.hdr.sgml' || chr(10) ||
    'ACCESSION NUMBER:' || chr(9) || chr(9) || lpad(f::VARCHAR, 10, '0') || chr(10) ||
    'CONFORMED SUBMISSION TYPE:' || chr(9) || first(form) || chr(10) ||
    'PUBLIC DOCUMENT COUNT:' || chr(9) || chr(9) || '4' || chr(10) || '</SEC-HEADER>' || chr(10) ||
    string_agg(block, chr(10) ORDER BY q) || chr(10) || '</SEC-DOCUMENT>' || chr(10) AS raw
  FROM filing_blocks GROUP BY f
)"""


# ---------------------------------------------------------------------------
# manifest(fname) and mapping(fname, archive_path)
# ---------------------------------------------------------------------------
def _filing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).cast("bigint").alias("f"))
            .distinct())


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _filing_keys(spark, sf_dir)
    once = keys.select(F.concat(F.lit("edgar/"), F.col("f"), F.lit(".txt")).alias("fname"))
    again = keys.where(F.col("f") % 3 == 0).select(
        F.concat(F.lit("edgar/"), F.col("f"), F.lit(".txt")).alias("fname"))
    return once.unionAll(again)


def manifest_sql() -> str:
    return """filing_keys AS (SELECT DISTINCT doc_id // 4 AS f FROM documents),
manifest AS (
  SELECT 'edgar/' || f || '.txt' AS fname FROM filing_keys
  UNION ALL SELECT 'edgar/' || f || '.txt' FROM filing_keys WHERE f % 3 = 0
)"""


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _filing_keys(spark, sf_dir).where(F.col("f") % 7 != 0)
    target = F.when(F.col("f") % 11 == 0, F.col("f") + 1000000).otherwise(F.col("f"))
    return keys.select(F.concat(F.lit("edgar/"), F.col("f"), F.lit(".txt")).alias("fname"),
                       F.concat(F.lit("archive/"), target, F.lit(".txt")).alias("archive_path"))


def mapping_sql() -> str:
    return """mapping AS (
  SELECT 'edgar/' || f || '.txt' AS fname,
         'archive/' || CASE WHEN f % 11 = 0 THEN f + 1000000 ELSE f END || '.txt' AS archive_path
  FROM filing_keys WHERE f % 7 <> 0
)"""


def archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive: filings addressed by their archive path."""
    return filings(spark, sf_dir).select(
        F.concat(F.lit("archive/"), F.col("f"), F.lit(".txt")).alias("archive_path"), "raw")


def archive_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(archive_path, error): the paths of the archive without contents; every 13th can't be read."""
    return _filing_keys(spark, sf_dir).select(
        F.concat(F.lit("archive/"), F.col("f"), F.lit(".txt")).alias("archive_path"),
        F.when(F.col("f") % 13 == 0, F.lit("unreadable")).alias("error"))


def archive_listing_sql() -> str:
    return """archive_listing AS (SELECT 'archive/' || f || '.txt' AS archive_path,
  CASE WHEN f % 13 = 0 THEN 'unreadable' END AS error FROM filing_keys)"""


def archive_sql() -> str:
    return "archive AS (SELECT 'archive/' || f || '.txt' AS archive_path, raw FROM filings)"


# ---------------------------------------------------------------------------
# speeches(file_name, text, year, source), meta_pre / meta_post
# ---------------------------------------------------------------------------
def _speech_date(doc_id):
    return F.date_add(F.lit("1996-01-01").cast("date"), ((doc_id * 13) % 9000).cast("int"))


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat(F.lit("speech_"), F.col("doc_id")).alias("file_name"), "text",
                    F.year(_speech_date(F.col("doc_id"))).alias("year"), "source", "doc_id")


def meta_parts(spark: SparkSession, sf_dir: str):
    """(meta_pre, meta_post) with a ``pos`` column giving the row order in each part."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    base = d.select(F.concat(F.lit("speech_"), F.col("doc_id")).alias("file_name"),
                    _speech_date(F.col("doc_id")).alias("date"), F.col("source").alias("speaker"),
                    "doc_id")
    pre_c = F.col("date") < F.lit("2011-01-01").cast("date")
    copies = base.where(F.col("doc_id") % 10 == 0).withColumn(
        "speaker", F.concat(F.lit("alt_"), F.col("speaker")))
    pre = base.where(pre_c).unionByName(copies.where(~pre_c))
    post = base.where(~pre_c).unionByName(copies.where(pre_c))
    return (pre.select("file_name", "date", "speaker", F.col("doc_id").alias("pos")),
            post.select("file_name", "date", "speaker", F.col("doc_id").alias("pos")))


def speeches_sql() -> str:
    return """speech_base AS (
  SELECT doc_id, 'speech_' || doc_id AS file_name, text, source,
         DATE '1996-01-01' + ((doc_id * 13) % 9000)::INT AS date
  FROM documents
),
speeches AS (SELECT file_name, text, year(date)::INT AS year, source, doc_id FROM speech_base),
meta_pre AS (
  SELECT file_name, date, source AS speaker, doc_id AS pos FROM speech_base WHERE date < DATE '2011-01-01'
  UNION ALL SELECT file_name, date, 'alt_' || source, doc_id FROM speech_base
    WHERE doc_id % 10 = 0 AND date >= DATE '2011-01-01'
),
meta_post AS (
  SELECT file_name, date, source AS speaker, doc_id AS pos FROM speech_base WHERE date >= DATE '2011-01-01'
  UNION ALL SELECT file_name, date, 'alt_' || source, doc_id FROM speech_base
    WHERE doc_id % 10 = 0 AND date < DATE '2011-01-01'
)"""


# ---------------------------------------------------------------------------
# dated_text(id, text): order dates rendered in several layouts
# ---------------------------------------------------------------------------
def dated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    d = F.col("o_orderdate").cast("date")
    ymd = F.date_format(d, "yyyy-MM-dd")
    ymd_s = F.date_format(d, "yyyy/MM/dd")
    mdy_s = F.date_format(d, "MM/dd/yyyy")
    mdy_d = F.date_format(d, "MM-dd-yyyy")
    k = F.col("o_orderkey") % 6
    text = (F.when(k == 0, F.concat(F.lit("Filed on "), ymd, F.lit(" by the registrant.")))
            .when(k == 1, F.concat(F.lit("Report date "), ymd_s, F.lit(".")))
            .when(k == 2, F.concat(F.lit("As of "), mdy_s, F.lit(", the board approved.")))
            .when(k == 3, F.concat(F.lit("Dated "), mdy_d, F.lit(" at New York.")))
            .when(k == 4, F.concat(F.lit("No date was given for order "), F.col("o_orderkey"), F.lit(".")))
            .otherwise(F.concat(F.lit("Signed "), mdy_s, F.lit(" and recorded "), ymd, F.lit("."))))
    return o.select(F.col("o_orderkey").alias("id"), text.alias("text"))


def dated_text_sql() -> str:
    return """dated_text AS (
  SELECT o_orderkey AS id,
    CASE o_orderkey % 6
      WHEN 0 THEN 'Filed on ' || strftime(o_orderdate, '%Y-%m-%d') || ' by the registrant.'
      WHEN 1 THEN 'Report date ' || strftime(o_orderdate, '%Y/%m/%d') || '.'
      WHEN 2 THEN 'As of ' || strftime(o_orderdate, '%m/%d/%Y') || ', the board approved.'
      WHEN 3 THEN 'Dated ' || strftime(o_orderdate, '%m-%d-%Y') || ' at New York.'
      WHEN 4 THEN 'No date was given for order ' || o_orderkey || '.'
      ELSE 'Signed ' || strftime(o_orderdate, '%m/%d/%Y') || ' and recorded ' || strftime(o_orderdate, '%Y-%m-%d') || '.'
    END AS text
  FROM orders
)"""


# ---------------------------------------------------------------------------
# fixed_topics(doc_id, topic) and fixed_theta(doc_id, topic, theta)
# ---------------------------------------------------------------------------
def doc_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finance tokens (B-style preprocessing) of every document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return d.select("doc_id", "lang", "source", preprocess_finance(F.col("text")).alias("tokens"))


def doc_tokens_sql() -> str:
    return f"""doc_tokens AS (
  SELECT doc_id, lang, source, {preprocess_finance_sql('text')} AS tokens FROM documents
)"""


def fixed_topics(spark: SparkSession, sf_dir: str, k: int = L.LDA_K) -> DataFrame:
    return doc_tokens(spark, sf_dir).select("doc_id", "lang", "source", "tokens",
                                            (F.col("doc_id") % k).cast("int").alias("topic"))


def fixed_topics_sql(k: int = L.LDA_K) -> str:
    return (doc_tokens_sql() + f""",
fixed_topics AS (SELECT doc_id, lang, source, tokens, (doc_id % {k})::INT AS topic FROM doc_tokens)""")


def fixed_theta(spark: SparkSession, sf_dir: str, k: int = L.LDA_K) -> DataFrame:
    """theta(d, t) = share of d's tokens whose length is t modulo k."""
    t = (doc_tokens(spark, sf_dir).select("doc_id", F.explode_outer("tokens").alias("w"))
         .where(F.col("w").isNotNull()))
    c = t.groupBy("doc_id", (F.length("w") % k).cast("int").alias("topic")).agg(
        F.count(F.lit(1)).alias("cnt"))
    # document total from the (at most k) rows of the same document: one pass
    tot = F.sum("cnt").over(Window.partitionBy("doc_id"))
    return c.select("doc_id", "topic", (F.col("cnt") / tot).alias("theta"))


def fixed_theta_sql(k: int = L.LDA_K) -> str:
    return (doc_tokens_sql() + f""",
theta_words AS (SELECT doc_id, unnest(tokens) AS w FROM doc_tokens),
fixed_theta AS (
  SELECT c.doc_id, c.topic, c.cnt::DOUBLE / t.n AS theta
  FROM (SELECT doc_id, (length(w) % {k})::INT AS topic, count(*) AS cnt FROM theta_words GROUP BY 1, 2) c
  JOIN (SELECT doc_id, count(*) AS n FROM theta_words GROUP BY 1) t USING (doc_id)
)""")


# ---------------------------------------------------------------------------
# gunk_text(doc_id, text): documents with leading machine junk before a marker
# ---------------------------------------------------------------------------
def gunk_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    prefix = (F.when(k == 0, F.concat(F.lit("<ix:header>ref "), F.col("doc_id"),
                                      F.lit("</ix:header>\nFORM 10-K\n")))
              .when(k == 1, F.lit("preamble line\nCurrent Report\nUnited States\n"))
              .when(k == 2, F.lit("\nSCHEDULE 14A\n"))
              .otherwise(F.lit("")))
    return d.select("doc_id", F.concat(prefix, F.col("text")).alias("text"))


def gunk_text_sql() -> str:
    return """gunk_text AS (
  SELECT doc_id, CASE doc_id % 4
      WHEN 0 THEN '<ix:header>ref ' || doc_id || '</ix:header>' || chr(10) || 'FORM 10-K' || chr(10)
      WHEN 1 THEN 'preamble line' || chr(10) || 'Current Report' || chr(10) || 'United States' || chr(10)
      WHEN 2 THEN chr(10) || 'SCHEDULE 14A' || chr(10)
      ELSE '' END || text AS text
  FROM documents
)"""


# ---------------------------------------------------------------------------
# topic_dump(file, text): topic keyword dumps in the two legacy text formats,
# built from the top words of the fixed topic groups of each language.
# ---------------------------------------------------------------------------
DUMP_B_HEADER = "--- words of each topic ---"
# FIXED VALUE: the bullet that the second dump format starts a topic with.
DUMP_B_BULLET = "\U0001F539 Topic "


def topic_group_words(spark: SparkSession, sf_dir: str, k: int = L.LDA_K, top: int = 10) -> DataFrame:
    """(lang, topic, rank, term, weight): top words of each (language, fixed topic)."""
    ft = fixed_topics(spark, sf_dir, k)
    words = ft.select("lang", "topic", F.explode_outer("tokens").alias("term")).where(
        F.col("term").isNotNull())
    cnt = words.groupBy("lang", "topic", "term").agg(F.count(F.lit(1)).alias("n"))
    tot = words.groupBy("lang", "topic").agg(F.count(F.lit(1)).alias("tot"))
    # one language may hold most of the corpus: salted two-stage top-n
    from ..operators.topic_tables import top_n_per_group
    ranked = top_n_per_group(cnt, ["lang", "topic"], [F.desc("n"), F.asc("term")], top, salt_col="term")
    return ranked.join(tot, ["lang", "topic"]).select(
        "lang", "topic", "rank", "term", F.round(F.col("n") / F.col("tot"), 4).alias("weight"))


def topic_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = topic_group_words(spark, sf_dir)
    wtxt = F.format_string("%.4f", F.col("weight"))
    a_item = F.concat(wtxt, F.lit('*"'), F.col("term"), F.lit('"'))
    b_item = F.concat(F.lit("   "), F.col("term"), F.lit(" ("), wtxt, F.lit(")"))
    per_topic = g.groupBy("lang", "topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", a_item.alias("a"), b_item.alias("b")))).alias("items"))
    a_body = F.array_join(F.transform("items", lambda x: x["a"]), " + ")
    a_line = F.concat(F.lit("("), F.col("topic"), F.lit(", '"), a_body, F.lit("')"))
    b_block = F.concat(F.lit(DUMP_B_BULLET), F.col("topic"), F.lit(":\n"),
                       F.array_join(F.transform("items", lambda x: x["b"]), "\n"))
    a_dup = F.concat(F.lit("("), F.col("topic"), F.lit(", '"),
                     F.array_join(F.transform(F.slice("items", 1, 3), lambda x: x["a"]), " + "), F.lit("')"))
    lines = per_topic.select("lang", "topic", a_line.alias("a_line"), b_block.alias("b_block"),
                             a_dup.alias("a_dup"))
    files = lines.groupBy("lang").agg(
        F.array_sort(F.collect_list(F.struct("topic", "a_line", "b_block", "a_dup"))).alias("t"))
    a_text = F.array_join(F.transform("t", lambda x: x["a_line"]), "\n")
    b_text = F.array_join(F.transform("t", lambda x: x["b_block"]), "\n\n")
    first_dup = F.element_at(F.col("t"), 1)["a_dup"]
    text = (F.when(F.col("lang") == "en", F.concat(F.lit("Topics generated 2023-07-24\n"), a_text,
                                                    F.lit("\n"), first_dup))
            .when(F.col("lang") == "fr", F.concat(a_text, F.lit("\n(99, 'none')")))
            .when(F.col("lang") == "de", F.concat(F.lit(DUMP_B_HEADER + "\nRun of 07/24/2023\n\n"), b_text))
            .otherwise(F.concat(F.lit(DUMP_B_HEADER + "\n\n"), b_text, F.lit("\n"))))
    return files.select(F.concat(F.lit("topics_"), F.col("lang"), F.lit(".txt")).alias("file"),
                        text.alias("text"))


def topic_dump_sql() -> str:
    nl = "chr(10)"
    return fixed_topics_sql() + f""",
tg_words AS (SELECT lang, topic, unnest(tokens) AS term FROM fixed_topics),
tg_cnt AS (SELECT lang, topic, term, count(*) AS n FROM tg_words GROUP BY 1, 2, 3),
tg_tot AS (SELECT lang, topic, count(*) AS tot FROM tg_words GROUP BY 1, 2),
topic_group_words AS (
  SELECT c.lang, c.topic, c.rank, c.term, round(c.n / t.tot, 4) AS weight
  FROM (SELECT *, row_number() OVER (PARTITION BY lang, topic ORDER BY n DESC, term ASC) AS rank FROM tg_cnt) c
  JOIN tg_tot t ON c.lang = t.lang AND c.topic = t.topic WHERE c.rank <= 10),
tg_lines AS (
  SELECT lang, topic,
    '(' || topic || ', ''' || string_agg(printf('%.4f', weight) || '*"' || term || '"', ' + ' ORDER BY rank) || ''')' AS a_line,
    {sql_str(DUMP_B_BULLET)} || topic || ':' || {nl} || string_agg('   ' || term || ' (' || printf('%.4f', weight) || ')', {nl} ORDER BY rank) AS b_block,
    '(' || topic || ', ''' || string_agg(printf('%.4f', weight) || '*"' || term || '"', ' + ' ORDER BY rank) FILTER (WHERE rank <= 3) || ''')' AS a_dup
  FROM topic_group_words GROUP BY lang, topic),
tg_files AS (
  SELECT lang, string_agg(a_line, {nl} ORDER BY topic) AS a_text, string_agg(b_block, {nl} || {nl} ORDER BY topic) AS b_text,
         arg_min(a_dup, topic) AS first_dup
  FROM tg_lines GROUP BY lang),
topic_dump AS (
  SELECT 'topics_' || lang || '.txt' AS file,
    CASE lang WHEN 'en' THEN 'Topics generated 2023-07-24' || {nl} || a_text || {nl} || first_dup
              WHEN 'fr' THEN a_text || {nl} || '(99, ''none'')'
              WHEN 'de' THEN {sql_str(DUMP_B_HEADER)} || {nl} || 'Run of 07/24/2023' || {nl} || {nl} || b_text
              ELSE {sql_str(DUMP_B_HEADER)} || {nl} || {nl} || b_text || {nl} END AS text
  FROM tg_files)"""
