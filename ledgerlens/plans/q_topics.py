"""Registered queries: topic words, document-topic tables, topic dumps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.regexkit import sql_str
from ..functions.tokens import extract_date_sql
from ..operators import dump as D
from ..operators import relational as R
from ..operators import topic_tables as TT
from ..session import materialize
from ..sources import derived
from ..sources.tables import table
from .catalog import query


# T9-T11 on the fixed topic groups -------------------------------------------
def _ctfidf_ctes(top_n: int = 10) -> str:
    return f"""{derived.fixed_topics_sql()},
cw AS (SELECT topic, unnest(tokens) AS term FROM fixed_topics),
ctf AS (SELECT topic, term, count(*) AS tf FROM cw GROUP BY 1, 2),
csize AS (SELECT topic, sum(tf) AS size FROM ctf GROUP BY 1),
cfreq AS (SELECT term, sum(tf) AS f FROM ctf GROUP BY 1),
cavg AS (SELECT floor(avg(size)) AS a FROM csize),
cscored AS (SELECT ctf.topic, ctf.term, (ctf.tf::DOUBLE / csize.size) * ln(1 + (SELECT a FROM cavg) / cfreq.f) AS weight
            FROM ctf JOIN csize ON ctf.topic = csize.topic JOIN cfreq ON ctf.term = cfreq.term WHERE ctf.topic <> -1),
cwords AS (SELECT topic, rank, term, weight FROM (
   SELECT *, row_number() OVER (PARTITION BY topic ORDER BY weight DESC, term ASC) AS rank FROM cscored) r
   WHERE rank <= {top_n})"""


def _ctfidf_sql() -> str:
    return f"WITH {_ctfidf_ctes()}\nSELECT topic, rank, term, round(weight, 6) AS weight FROM cwords"


def _ctfidf_df(spark, sf_dir, top_n=10):
    return TT.ctfidf(derived.fixed_topics(spark, sf_dir), top_n=top_n)


@query("ctfidf_words", ("T9", "J13"), _ctfidf_sql)
def ctfidf_words(spark, sf_dir):
    return _ctfidf_df(spark, sf_dir).select("topic", "rank", "term", F.round("weight", 6).alias("weight"))


def _topic_info_sql() -> str:
    return f"""WITH {_ctfidf_ctes(12)},
cnt AS (SELECT topic, count(*) AS count FROM fixed_topics WHERE topic <> -1 GROUP BY 1),
nm AS (SELECT topic, topic::VARCHAR || '_' || string_agg(term, '_' ORDER BY rank) FILTER (WHERE rank <= 4) AS auto_name,
              string_agg(term, ', ' ORDER BY rank) AS top_words FROM cwords GROUP BY topic)
SELECT cnt.topic AS topic_id, count, auto_name, top_words FROM cnt JOIN nm ON cnt.topic = nm.topic"""


@query("topic_info", ("T10",), _topic_info_sql)
def topic_info(spark, sf_dir):
    ft = derived.fixed_topics(spark, sf_dir)
    return TT.topic_info(ft, TT.ctfidf(ft, top_n=12))


def _keywords_sql() -> str:
    return f"""WITH {_ctfidf_ctes(20)}
SELECT topic, string_agg(round(weight, 3)::VARCHAR || '*"' || term || '"', ' + ' ORDER BY rank) AS keywords
FROM cwords GROUP BY topic"""


@query("topic_keywords", ("T11",), _keywords_sql)
def topic_keywords(spark, sf_dir):
    return TT.keyword_string(_ctfidf_df(spark, sf_dir, 20), n_words=20)


# P1, P2 on fixed proportions --------------------------------------------------
def _dominant_sql() -> str:
    return f"""WITH {derived.fixed_theta_sql()}
SELECT d.doc_id, topic AS dominant_topic, round(theta, 4) AS perc_contribution FROM documents d LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY theta DESC, topic ASC) AS r FROM fixed_theta) t
ON d.doc_id = t.doc_id AND r = 1"""


@query("dominant_topic", ("P1", "J3"), _dominant_sql)
def dominant_topic(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return TT.dominant_topic(derived.fixed_theta(spark, sf_dir), "doc_id", docs=docs).select(
        "doc_id", "dominant_topic", "perc_contribution")


# the same as the analyst's tables: row number, file name, date, keywords, text
def _doc_ctes() -> str:
    return f"""{derived.fixed_theta_sql()},
kw AS (SELECT topic, string_agg(term, ', ' ORDER BY n DESC, term) AS keywords FROM (
  SELECT *, row_number() OVER (PARTITION BY topic ORDER BY n DESC, term) AS r FROM (
    SELECT (length(w) % {L.LDA_K})::INT AS topic, w AS term, count(*) AS n FROM theta_words GROUP BY 1, 2) c) q
  WHERE r <= 10 GROUP BY topic),
docs AS (SELECT doc_id, 'speech_' || doc_id AS file_name, text, DATE '1996-01-01' + ((doc_id * 13) % 9000)::INT AS date,
                row_number() OVER (ORDER BY doc_id) - 1 AS document FROM documents)"""


def _doc_frames(spark, sf_dir):
    theta = materialize(derived.fixed_theta(spark, sf_dir).withColumn("file_name", F.concat(F.lit("speech_"), F.col("doc_id"))))
    d = derived.speeches(spark, sf_dir).select("doc_id", "file_name", "text", derived._speech_date(F.col("doc_id")).alias("date"))
    return R.row_positions(d, [F.col("doc_id")], "document"), theta.select("file_name", "topic", "theta")


def _dominant_table_sql() -> str:
    return f"""WITH {_doc_ctes()}
SELECT document AS "Document_No", file_name AS "File Name", t.topic AS "Dominant_Topic", round(theta, 4) AS "Topic_Perc_Contrib",
       keywords AS "Keywords", text AS "Text"
FROM docs LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY theta DESC, topic ASC) AS r FROM fixed_theta) t
  ON docs.doc_id = t.doc_id AND r = 1 LEFT JOIN kw ON kw.topic = t.topic"""


@query("dominant_topic_table", ("P1", "J3", "D17"), _dominant_table_sql)
def dominant_topic_table(spark, sf_dir):
    docs, theta = _doc_frames(spark, sf_dir)
    words = (derived.doc_tokens(spark, sf_dir).select(F.explode_outer("tokens").alias("term")).where(F.col("term").isNotNull())
             .groupBy((F.length("term") % L.LDA_K).cast("int").alias("topic"), "term").agg(F.count(F.lit(1)).alias("n")))
    top = TT.top_n_per_group(words, ["topic"], [F.desc("n"), F.asc("term")], 10, salt_col="term")
    kw = top.groupBy("topic").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("keywords"))
    return TT.dominant_table(docs, theta, kw)


def _export_table_sql() -> str:
    return f"""WITH {_doc_ctes()}
SELECT document AS "Document", file_name AS "FileName", date AS "Date", topic AS "Topic", round(theta, 6) AS "Proportion"
FROM docs JOIN fixed_theta t ON docs.doc_id = t.doc_id WHERE theta >= 0.01"""


@query("doc_topic_table", ("P2", "D18"), _export_table_sql)
def doc_topic_table(spark, sf_dir):
    docs, theta = _doc_frames(spark, sf_dir)
    return TT.export_table(docs, theta).withColumn("Proportion", F.round("Proportion", 6))


def _export_sql() -> str:
    return f"""WITH {derived.fixed_theta_sql()}
SELECT doc_id, topic, round(theta, 6) AS proportion FROM fixed_theta WHERE theta >= 0.01"""


@query("doc_topic_export", ("P2",), _export_sql)
def doc_topic_export(spark, sf_dir):
    e = TT.doc_topic_export(derived.fixed_theta(spark, sf_dir), "doc_id")
    return e.select("doc_id", "topic", F.round("proportion", 6).alias("proportion"))


# P3-P12 on topic dumps --------------------------------------------------------
def _parsed_ctes() -> str:
    return f"""{derived.topic_dump_sql()},
{D.lines_sql()},
{D.parse_any_sql()}"""


def _parsed_df(spark, sf_dir):
    # a handful of dump files (one per language); every table below reads them
    # several times, so they are written once instead of re-tokenising the corpus
    dumps = materialize(derived.topic_dump(spark, sf_dir))
    return dumps, D.parse_any(D.dump_lines(dumps))


def _dump_terms_sql() -> str:
    return f"WITH {_parsed_ctes()}\nSELECT file, topic, rank, term, weight FROM parsed"


@query("dump_terms", ("P3", "P4", "P5", "J3"), _dump_terms_sql)
def dump_terms(spark, sf_dir):
    _, parsed = _parsed_df(spark, sf_dir)
    return parsed.select("file", F.col("topic").cast("int").alias("topic"), "rank", "term", "weight")


def _scores_sql() -> str:
    return f"""WITH {_parsed_ctes()}
SELECT p.file, p.topic, max(weight) AS max_weight, round(sum(weight), 6) AS sum_weight,
       sum(weight) > {L.SUM_WEIGHT_MIN} AS kept,
       string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 3) AS topic_name
FROM parsed p GROUP BY p.file, p.topic"""


@query("topic_scores", ("P7", "P8", "P9"), _scores_sql)
def topic_scores(spark, sf_dir):
    _, parsed = _parsed_df(spark, sf_dir)
    s = parsed.groupBy("file", "topic").agg(F.max("weight").alias("max_weight"),
                                            F.sum("weight").alias("sw"))
    kept = TT.sum_weight(parsed).select("file", "topic", F.lit(True).alias("k"))
    j = s.join(kept, ["file", "topic"], "left").join(TT.topic_names(parsed), ["file", "topic"])
    return j.select("file", F.col("topic").cast("int").alias("topic"), "max_weight",
                    F.round("sw", 6).alias("sum_weight"), F.coalesce("k", F.lit(False)).alias("kept"),
                    "topic_name")


def _summary_ctes() -> str:
    return f"""{_parsed_ctes()},
mw AS (SELECT file, topic, max(weight) AS max_weight FROM parsed GROUP BY 1, 2),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY max_weight DESC, topic ASC) AS trank FROM mw) x
         WHERE trank <= {L.TOPIC_SUMMARY_TOPICS}),
tl AS (SELECT p.file, p.topic, string_agg(term || ':' || printf('%.3f', round(weight, 3)), ', ' ORDER BY rank) AS items
       FROM parsed p WHERE rank < {L.TOPIC_SUMMARY_TERMS} GROUP BY 1, 2),
summ AS (SELECT t.file, string_agg('Topic ' || t.topic || ': ' || tl.items, chr(10) ORDER BY trank) AS s
         FROM tops t JOIN tl ON t.file = tl.file AND t.topic = tl.topic GROUP BY t.file),
files AS (SELECT file, text, (row_number() OVER (ORDER BY file) - 1)::BIGINT AS document FROM topic_dump),
file_summary AS (SELECT f.file, coalesce(s.s, {sql_str(L.NO_TOPICS_TEXT)}) AS topic_summary
                 FROM files f LEFT JOIN summ s ON f.file = s.file)"""


def _summary_sql() -> str:
    return f"WITH {_summary_ctes()}\nSELECT file, topic_summary FROM file_summary"


@query("topic_summary", ("P6",), _summary_sql)
def topic_summary(spark, sf_dir):
    dumps, parsed = _parsed_df(spark, sf_dir)
    return TT.topic_summary(parsed, dumps.select("file"))


def _long_sql() -> str:
    return f"""WITH {_summary_ctes()},
names AS (SELECT file, topic, string_agg(term, ', ' ORDER BY rank) AS topic_name FROM parsed WHERE rank < 3 GROUP BY 1, 2)
SELECT f.document AS "Document", f.file AS "FileName", {extract_date_sql('f.text')} AS "Date",
       mw.topic AS "Topic", n.topic_name AS "TopicName", mw.max_weight AS "Proportion"
FROM mw JOIN names n ON mw.file = n.file AND mw.topic = n.topic JOIN files f ON f.file = mw.file"""


@query("long_proportions", ("P10", "N14"), _long_sql)
def long_proportions(spark, sf_dir):
    dumps, parsed = _parsed_df(spark, sf_dir)
    r = TT.long_proportions(parsed, dumps)
    return r.withColumn("Topic", F.col("Topic").cast("int"))


def _main_sql() -> str:
    d = extract_date_sql("f.text")
    return f"""WITH {_summary_ctes()},
sw AS (SELECT file, topic, sum(weight) AS s FROM parsed GROUP BY 1, 2 HAVING sum(weight) > {L.SUM_WEIGHT_MIN})
SELECT sw.topic AS "Topic ID", coalesce(nullif(sw.file, ''), 'Unknown') AS "FileName",
       coalesce(nullif({d}, ''), 'Unknown') AS "Date", sw.topic AS "Topic Number",
       round(sw.s, 6) AS "Topic Proportion"
FROM sw JOIN files f ON f.file = sw.file"""


@query("main_table", ("P8", "P11"), _main_sql)
def main_table(spark, sf_dir):
    dumps, parsed = _parsed_df(spark, sf_dir)
    r = TT.main_table(parsed, dumps)
    return r.select(F.col("Topic ID").cast("int").alias("Topic ID"), "FileName", "Date",
                    F.col("Topic Number").cast("int").alias("Topic Number"), "Topic Proportion")


def _key_sql() -> str:
    return f"""WITH {_parsed_ctes()}
SELECT file, topic AS "Topic Number",
  string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 3) AS "Topic Name",
  'Topic characterised by the terms: ' || string_agg(term, ', ' ORDER BY rank) FILTER (WHERE rank < 5) || '.' AS "Topic Description"
FROM parsed GROUP BY file, topic"""


@query("key_table", ("P9", "P11"), _key_sql)
def key_table(spark, sf_dir):
    _, parsed = _parsed_df(spark, sf_dir)
    r = TT.key_table(parsed)
    return r.withColumn("Topic Number", F.col("Topic Number").cast("int"))


def _categorized_sql() -> str:
    rows = ", ".join(f"('{w}', '{t}')" for t, ws in L.THEMES.items() for w in dict.fromkeys(ws))
    return f"""WITH {_summary_ctes()},
lex(word, theme) AS (VALUES {rows}),
sc AS (SELECT p.file, l.theme, sum(p.weight) AS score, list_sort(list_distinct(list(p.term))) AS terms
       FROM parsed p JOIN lex l ON p.term = l.word GROUP BY 1, 2),
tot AS (SELECT file, sum(score) AS total FROM sc GROUP BY 1),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY score DESC, theme ASC) AS r FROM sc) x WHERE r = 1),
cnt AS (SELECT file, count(DISTINCT topic) AS c FROM parsed GROUP BY 1)
SELECT f.document AS "Document", f.file AS "FileName", {extract_date_sql('f.text')} AS "Date",
       coalesce(cnt.c, 0)::BIGINT AS "ParsedTopicCount", fs.topic_summary AS "TopicSummary",
       coalesce(b.theme, 'Uncategorized') AS "Category",
       coalesce(round(b.score / t.total, 4), 0.0) AS "Confidence",
       coalesce(array_to_string(b.terms, ', '), '') AS "Rationale"
FROM files f JOIN file_summary fs ON f.file = fs.file LEFT JOIN cnt ON cnt.file = f.file
LEFT JOIN best b ON b.file = f.file LEFT JOIN tot t ON t.file = f.file"""


@query("categorized_documents", ("P12", "P6", "S5", "D20"), _categorized_sql)
def categorized_documents(spark, sf_dir):
    dumps, parsed = _parsed_df(spark, sf_dir)
    return TT.categorize(parsed, dumps)
