"""Topic-dump parsing (P3-P5): legacy keyword dumps -> (file, topic, rank, term, weight).

Dumps are read as lines (one row per line, ``posexplode`` of the file text);
format B's "which header does this line belong to" is a carry-forward window
partitioned by file. Per-topic term lists are sorted by weight descending,
ties in input order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.regexkit import WS, java_re, re2_re, sql_str

# FIXED VALUES: dump line patterns (format A tuple lines, format B header and term lines).
LINE_A = r"^\(" + WS + r"*([0-9]+)" + WS + r"*," + WS + r"*'(.+)'" + WS + r"*\)" + WS + r"*$"
TOKEN_A = r'([0-9]+(?:[.][0-9]+)?)' + WS + r'*[*]' + WS + r'*"([^"]+)"'
HEADER_B = r"(?i)^" + WS + "*(?:\U0001F539" + WS + r"*)?Topic" + WS + r"+([0-9]+)" + WS + r"*:" + WS + r"*$"
TOKEN_B = r"^" + WS + r"*([A-Za-z0-9_]+)" + WS + r"*\(([0-9]+(?:[.][0-9]+)?)\)" + WS + r"*$"


def dump_lines(dumps: DataFrame, file_col: str = "file", text_col: str = "text") -> DataFrame:
    out = dumps.select(F.col(file_col).alias("file"),
                       F.posexplode_outer(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    return out.where(F.col("line").isNotNull())


def _sorted_terms(terms: Column) -> Column:
    """Stable sort of (term, weight) structs by weight descending."""
    keyed = F.transform(terms, lambda x, i: F.struct((-x["weight"]).alias("k"), i.alias("i"),
                                                     x["term"].alias("term"), x["weight"].alias("weight")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["term"].alias("term"),
                                                                x["weight"].alias("weight")))


def _explode_terms(df: DataFrame) -> DataFrame:
    r = df.select("file", "topic", F.posexplode(_sorted_terms(F.col("terms"))).alias("rank", "t"))
    return r.select("file", "topic", F.col("rank").cast("bigint").alias("rank"),
                    F.col("t.term").alias("term"), F.col("t.weight").alias("weight"))


def parse_format_a(lines: DataFrame) -> DataFrame:
    """``(id, 'w*"term" + ...')`` lines; the last line of an id with terms wins."""
    la = java_re(LINE_A)
    ta = java_re(TOKEN_A)
    hits = lines.where(F.col("line").rlike(la)).select(
        "file", "line_no", F.regexp_extract("line", la, 1).cast("int").alias("topic"),
        F.regexp_extract("line", la, 2).alias("body"))
    terms = F.arrays_zip(F.regexp_extract_all("body", F.lit(ta), 2).alias("term"),
                         F.regexp_extract_all("body", F.lit(ta), 1).alias("w"))
    t = hits.select("file", "line_no", "topic",
                    F.transform(terms, lambda x: F.struct(x["term"].alias("term"),
                                                          x["w"].cast("double").alias("weight")))
                    .alias("terms")).where(F.size("terms") > 0)
    last = t.groupBy("file", "topic").agg(F.max_by("terms", "line_no").alias("terms"))
    return _explode_terms(last)


def parse_format_b(lines: DataFrame) -> DataFrame:
    """``Topic n:`` header then ``term (w)`` lines until the next header."""
    hb, tb = java_re(HEADER_B), java_re(TOKEN_B)
    marked = lines.select(
        "file", "line_no", "line",
        F.when(F.col("line").rlike(hb), F.regexp_extract("line", hb, 1).cast("int")).alias("hdr_topic"),
        F.when(F.col("line").rlike(hb), F.col("line_no")).alias("hdr_line"))
    w = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = marked.select(
        "file", "line_no", "line",
        F.last("hdr_topic", ignorenulls=True).over(w).alias("topic"),
        F.last("hdr_line", ignorenulls=True).over(w).alias("block"))
    toks = carried.where(F.col("topic").isNotNull() & F.col("line").rlike(tb)).select(
        "file", "topic", "block", "line_no",
        F.struct(F.regexp_extract("line", tb, 1).alias("term"),
                 F.regexp_extract("line", tb, 2).cast("double").alias("weight")).alias("t"))
    blocks = toks.groupBy("file", "topic", "block").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "t"))).alias("items"))
    blocks = blocks.select("file", "topic", "block", F.transform("items", lambda x: x["t"]).alias("terms"))
    last = blocks.groupBy("file", "topic").agg(F.max_by("terms", "block").alias("terms"))
    return _explode_terms(last)


def parse_any(lines: DataFrame) -> DataFrame:
    """P5: format B for files where it finds topics, format A for the others."""
    b = parse_format_b(lines)
    a = parse_format_a(lines).join(b.select("file").distinct(), "file", "left_anti")
    return b.unionByName(a)


# ---------------------------------------------------------------------------
# SQL twins
# ---------------------------------------------------------------------------
def lines_sql(src: str = "topic_dump") -> str:
    return f"""dump_lines AS (
  SELECT file, unnest(generate_series(0, len(l) - 1)) AS line_no, unnest(l) AS line
  FROM (SELECT file, string_split(text, chr(10)) AS l FROM {src}) s)"""


def _explode_terms_sql(src: str) -> str:
    return f"""SELECT file, topic, (unnest(generate_series(0, len(st) - 1)))::BIGINT AS rank,
       unnest(list_transform(st, lambda x: x.term)) AS term, unnest(list_transform(st, lambda x: x.weight)) AS weight
FROM (SELECT file, topic, list_transform(list_sort(list_transform(terms, lambda x, i: struct_pack(k := -x.weight, i := i, term := x.term, weight := x.weight))),
                                         lambda x: struct_pack(term := x.term, weight := x.weight)) AS st
      FROM {src}) z"""


def parse_a_sql() -> str:
    la, ta = sql_str(re2_re(LINE_A)), sql_str(re2_re(TOKEN_A))
    return f"""pa_hits AS (
  SELECT file, line_no, regexp_extract(line, {la}, 1)::INT AS topic, regexp_extract(line, {la}, 2) AS body
  FROM dump_lines WHERE regexp_matches(line, {la})),
pa_terms AS (
  SELECT file, line_no, topic,
    list_transform(generate_series(1, len(ts)), lambda i: struct_pack(term := ts[i], weight := ws[i]::DOUBLE)) AS terms
  FROM (SELECT file, line_no, topic, regexp_extract_all(body, {ta}, 2) AS ts,
               regexp_extract_all(body, {ta}, 1) AS ws FROM pa_hits) q),
pa_last AS (SELECT file, topic, arg_max(terms, line_no) AS terms FROM pa_terms WHERE len(terms) > 0 GROUP BY 1, 2),
parsed_a AS ({_explode_terms_sql('pa_last')})"""


def parse_b_sql() -> str:
    hb, tb = sql_str(re2_re(HEADER_B)), sql_str(re2_re(TOKEN_B))
    return f"""pb_marked AS (
  SELECT file, line_no, line,
    CASE WHEN regexp_matches(line, {hb}) THEN regexp_extract(line, {hb}, 1)::INT END AS hdr_topic,
    CASE WHEN regexp_matches(line, {hb}) THEN line_no END AS hdr_line
  FROM dump_lines),
pb_carried AS (
  SELECT file, line_no, line,
    last_value(hdr_topic IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS topic,
    last_value(hdr_line IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS block
  FROM pb_marked),
pb_blocks AS (
  SELECT file, topic, block,
    list(struct_pack(term := regexp_extract(line, {tb}, 1), weight := regexp_extract(line, {tb}, 2)::DOUBLE) ORDER BY line_no) AS terms
  FROM pb_carried WHERE topic IS NOT NULL AND regexp_matches(line, {tb}) GROUP BY 1, 2, 3),
pb_last AS (SELECT file, topic, arg_max(terms, block) AS terms FROM pb_blocks GROUP BY 1, 2),
parsed_b AS ({_explode_terms_sql('pb_last')})"""


def parse_any_sql() -> str:
    return f"""{parse_a_sql()},
{parse_b_sql()},
parsed AS (SELECT * FROM parsed_b
           UNION ALL SELECT * FROM parsed_a WHERE file NOT IN (SELECT DISTINCT file FROM parsed_b))"""
