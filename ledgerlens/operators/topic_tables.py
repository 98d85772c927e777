"""Post-model tables (P1, P2, P6-P12) and topic-word tables.

Inputs are long tables: parsed or fitted topic terms ``(file, topic, rank,
term, weight)`` and document-topic proportions ``(doc, topic, theta)``. All
rankings are windows partitioned by a document or a topic, or salted two-stage
top-n where one group may be very large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import lexicons as L
from ..functions.tokens import extract_date
from ..session import materialize
from .report import explode_tokens


def top_n_per_group(df: DataFrame, group: list[str], order: list[Column], n: int,
                    out: str = "rank", salt_buckets: int = 16, salt_col: str | None = None) -> DataFrame:
    """Top ``n`` rows per group (1-based ``rank``), skew-safe.

    Stage 1 ranks within (group, salt) so a huge group is split over
    ``salt_buckets`` tasks and keeps only n rows per bucket; stage 2 ranks the
    at most ``n * salt_buckets`` survivors of each group.
    """
    salt = F.abs(F.hash(F.col(salt_col))) % salt_buckets if salt_col else F.lit(0)
    w1 = Window.partitionBy(*group, "_salt").orderBy(*order)
    pre = df.withColumn("_salt", salt).withColumn("_r1", F.row_number().over(w1)).where(F.col("_r1") <= n)
    w2 = Window.partitionBy(*group).orderBy(*order)
    return (pre.withColumn(out, F.row_number().over(w2)).where(F.col(out) <= n)
            .drop("_salt", "_r1"))


# ---------------------------------------------------------------------------
# Class-based TF-IDF topic words
# ---------------------------------------------------------------------------
def ctfidf(docs: DataFrame, topic_col: str = "topic", tokens_col: str = "tokens",
           top_n: int = 10, outlier: int = -1) -> DataFrame:
    """(topic, rank, term, weight) with weight = tf/|class| * ln(1 + A / f_term).

    A is the mean number of words per class (integer part), f the term's
    frequency over all classes [Grootendorst 2022]. The outlier class is
    excluded from the ranking but counts towards A and f, as in the fit.
    """
    words = explode_tokens(docs, tokens_col, "term", keep=(topic_col,))
    # (topic, term) counts feed four branches (class size, term frequency, the
    # mean class size and the join): written once, at most topics x vocabulary rows
    tf = materialize(words.groupBy(topic_col, "term").agg(F.count(F.lit(1)).alias("tf")))
    size = tf.groupBy(topic_col).agg(F.sum("tf").alias("size"))
    freq = tf.groupBy("term").agg(F.sum("tf").alias("f"))
    avg = size.agg(F.floor(F.avg("size"))).scalar()
    j = tf.join(F.broadcast(size), topic_col).join(freq, "term")    # one row a topic
    wgt = (F.col("tf") / F.col("size")) * F.log(1 + avg / F.col("f"))
    scored = j.where(F.col(topic_col) != outlier).select(topic_col, "term", wgt.alias("weight"))
    top = top_n_per_group(scored, [topic_col], [F.desc("weight"), F.asc("term")], top_n,
                          salt_col="term")
    return top.select(F.col(topic_col).alias("topic"), F.col("rank").cast("bigint").alias("rank"),
                      "term", "weight")


def topic_info(docs: DataFrame, words: DataFrame, topic_col: str = "topic",
               n_name: int = 4, n_words: int = 12, outlier: int = -1) -> DataFrame:
    """(topic_id, count, auto_name, top_words); outliers excluded, size order at the sink."""
    counts = docs.where(F.col(topic_col) != outlier).groupBy(F.col(topic_col).alias("topic_id")).agg(
        F.count(F.lit(1)).alias("count"))
    lists = words.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
    names = lists.select(
        "topic",
        F.concat_ws("_", F.col("topic").cast("string"),
                    F.array_join(F.transform(F.slice("w", 1, n_name), lambda x: x["term"]), "_"))
        .alias("auto_name"),
        F.array_join(F.transform(F.slice("w", 1, n_words), lambda x: x["term"]), ", ").alias("top_words"))
    return counts.join(names, counts.topic_id == names.topic).select(
        "topic_id", "count", "auto_name", "top_words")


def keyword_string(words: DataFrame, n_words: int = 20, decimals: int = 3,
                   fixed: bool = False) -> DataFrame:
    """One ``(topic, '0.027*"word" + ...')`` string per topic.

    ``fixed=False``: weights rounded to ``decimals`` and printed in shortest
    form (trailing zeros vanish, as for cluster topics); ``fixed=True``: fixed
    decimals (LDA form).
    """
    num = (F.format_string(f"%.{decimals}f", F.col("weight")) if fixed
           else F.round("weight", decimals).cast("string"))
    item = F.concat(num, F.lit('*"'), F.col("term"), F.lit('"'))
    g = words.where(F.col("rank") <= n_words).groupBy("topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("it")))).alias("items"))
    return g.select("topic", F.array_join(F.transform("items", lambda x: x["it"]), " + ").alias("keywords"))


# ---------------------------------------------------------------------------
# Document-topic tables from proportions theta
# ---------------------------------------------------------------------------
def dominant_topic(theta: DataFrame, key: str, keywords: DataFrame | None = None, nth: int = 1,
                   decimals: int = 4, docs: DataFrame | None = None) -> DataFrame:
    """The n-th largest topic of each document (ties: lower topic id).

    With ``docs`` (the key and any columns to carry along) every document has
    a row; one without proportions, such as one without a vocabulary term, has
    a null topic. ``keywords`` has one row a topic, so it is broadcast.
    """
    w = Window.partitionBy(key).orderBy(F.desc("theta"), F.asc("topic"))
    r = theta.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == nth)
    out = r.select(key, F.col("topic").alias("dominant_topic"),
                   F.round("theta", decimals).alias("perc_contribution"))
    if docs is not None:
        out = docs.join(out, key, "left")
    if keywords is not None:
        out = out.join(F.broadcast(keywords.withColumnRenamed("topic", "dominant_topic")), "dominant_topic", "left")
    return out


def dominant_table(docs: DataFrame, theta: DataFrame, keywords: DataFrame, key: str = "file_name",
                   text_col: str = "text") -> DataFrame:
    """P1 as D17: Document_No, File Name, Dominant_Topic, Topic_Perc_Contrib, Keywords, Text.

    ``docs`` has the key, its row number ``document`` and the text; every row appears.
    """
    d = dominant_topic(theta, key, keywords, docs=docs.select(key, "document", text_col))
    return d.select(F.col("document").alias("Document_No"), F.col(key).alias("File Name"),
                    F.col("dominant_topic").alias("Dominant_Topic"), F.col("perc_contribution").alias("Topic_Perc_Contrib"),
                    F.col("keywords").alias("Keywords"), F.col(text_col).alias("Text"))


def doc_topic_export(theta: DataFrame, key: str, min_p: float = 0.01) -> DataFrame:
    """Long (document, topic, proportion) rows at or above ``min_p``."""
    return theta.where(F.col("theta") >= min_p).select(key, "topic", F.col("theta").alias("proportion"))


def export_table(docs: DataFrame, theta: DataFrame, key: str = "file_name", min_p: float = 0.01) -> DataFrame:
    """P2 as D18: Document, FileName, Date, Topic, Proportion; ``docs`` has the key, ``document`` and ``date``."""
    e = doc_topic_export(theta, key, min_p).join(docs.select(key, "document", "date"), key)
    return e.select(F.col("document").alias("Document"), F.col(key).alias("FileName"), F.col("date").alias("Date"),
                    F.col("topic").alias("Topic"), F.col("proportion").alias("Proportion"))


# ---------------------------------------------------------------------------
# P6-P12 on parsed topic dumps
# ---------------------------------------------------------------------------
def max_weight(parsed: DataFrame) -> DataFrame:
    """Strongest term weight per (file, topic)."""
    return parsed.groupBy("file", "topic").agg(F.max("weight").alias("max_weight"))


def sum_weight(parsed: DataFrame, min_sum: float = L.SUM_WEIGHT_MIN) -> DataFrame:
    """Sum of all term weights per (file, topic), kept when above ``min_sum``."""
    s = parsed.groupBy("file", "topic").agg(F.sum("weight").alias("sum_weight"))
    return s.where(F.col("sum_weight") > min_sum)


def topic_names(parsed: DataFrame, n: int = 3) -> DataFrame:
    """First ``n`` terms joined by ', '."""
    g = parsed.where(F.col("rank") < n).groupBy("file", "topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("t"))
    return g.select("file", "topic", F.array_join(F.transform("t", lambda x: x["term"]), ", ")
                    .alias("topic_name"))


def topic_summary(parsed: DataFrame, files: DataFrame, top_topics: int = L.TOPIC_SUMMARY_TOPICS,
                  top_terms: int = L.TOPIC_SUMMARY_TERMS) -> DataFrame:
    """Per file, the strongest topics with their strongest terms as text.

    Weights print with three decimals after rounding half-up to three places.
    """
    mw = max_weight(parsed)
    w = Window.partitionBy("file").orderBy(F.desc("max_weight"), F.asc("topic"))
    tops = mw.withColumn("trank", F.row_number().over(w)).where(F.col("trank") <= top_topics)
    item = F.concat(F.col("term"), F.lit(":"), F.format_string("%.3f", F.round("weight", 3)))
    terms = parsed.where(F.col("rank") < top_terms).groupBy("file", "topic").agg(
        F.array_sort(F.collect_list(F.struct("rank", item.alias("it")))).alias("items"))
    lines = tops.join(terms, ["file", "topic"]).select(
        "file", "trank", F.concat(F.lit("Topic "), F.col("topic"), F.lit(": "),
                                  F.array_join(F.transform("items", lambda x: x["it"]), ", ")).alias("line"))
    per_file = lines.groupBy("file").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("trank", "line"))),
                                 lambda x: x["line"]), "\n").alias("topic_summary"))
    return files.select("file").join(per_file, "file", "left").select(
        "file", F.coalesce("topic_summary", F.lit(L.NO_TOPICS_TEXT)).alias("topic_summary"))


def file_index(files: DataFrame) -> DataFrame:
    """0-based position of each file in name order (one row per file).

    Distributed positions (range partitioning + per-partition offsets), so a
    folder with millions of files never meets in one task.
    """
    from .relational import row_positions
    return row_positions(files.select("file").distinct(), [F.col("file")], "document")


def long_proportions(parsed: DataFrame, dumps: DataFrame) -> DataFrame:
    """P10: Document, FileName, Date, Topic, TopicName, Proportion (= max weight)."""
    idx = file_index(dumps.select("file"))
    dates = dumps.select("file", extract_date(F.col("text")).alias("Date"))
    j = max_weight(parsed).join(topic_names(parsed), ["file", "topic"]).join(idx, "file").join(dates, "file")
    return j.select(F.col("document").alias("Document"), F.col("file").alias("FileName"), "Date",
                    F.col("topic").alias("Topic"), F.col("topic_name").alias("TopicName"),
                    F.col("max_weight").alias("Proportion"))


def main_table(parsed: DataFrame, dumps: DataFrame) -> DataFrame:
    """P11 main table: topics with summed weight > 0.01; missing name/date -> 'Unknown'."""
    dates = dumps.select("file", extract_date(F.col("text")).alias("d"))
    s = sum_weight(parsed).join(dates, "file")
    unknown = F.lit(L.UNKNOWN_TEXT)
    return s.select(F.col("topic").alias("Topic ID"),
                    F.coalesce(F.nullif(F.col("file"), F.lit("")), unknown).alias("FileName"),
                    F.coalesce(F.nullif(F.col("d"), F.lit("")), unknown).alias("Date"),
                    F.col("topic").alias("Topic Number"),
                    F.round("sum_weight", 6).alias("Topic Proportion"))


def key_table(parsed: DataFrame, n_desc: int = 5) -> DataFrame:
    """P11 key table: Topic Number, Topic Name (first three terms), Topic Description."""
    names = topic_names(parsed)
    desc = topic_names(parsed, n_desc).withColumnRenamed("topic_name", "terms")
    j = names.join(desc, ["file", "topic"])
    return j.select("file", F.col("topic").alias("Topic Number"), F.col("topic_name").alias("Topic Name"),
                    F.concat(F.lit("Topic characterised by the terms: "), F.col("terms"), F.lit("."))
                    .alias("Topic Description"))


def categorize(parsed: DataFrame, dumps: DataFrame) -> DataFrame:
    """One row per file with a lexicon-based category.

    score(theme) = sum of weights of the file's parsed terms found in the theme
    lexicon; category = best theme (ties: name order), confidence = its share
    of all theme scores, rationale = matched terms in name order.
    """
    spark = parsed.sparkSession
    from .report import theme_table
    lex = F.broadcast(theme_table(spark))  # fixed-size lexicon
    hits = parsed.join(lex, parsed.term == lex.word)
    scores = hits.groupBy("file", "theme").agg(F.sum("weight").alias("score"),
                                               F.array_sort(F.collect_set("term")).alias("terms"))
    w = Window.partitionBy("file").orderBy(F.desc("score"), F.asc("theme"))
    tot = scores.groupBy("file").agg(F.sum("score").alias("total"))
    best = scores.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1).join(tot, "file")
    counts = parsed.groupBy("file").agg(F.countDistinct("topic").alias("ParsedTopicCount"))
    idx = file_index(dumps.select("file"))
    dates = dumps.select("file", extract_date(F.col("text")).alias("Date"))
    summ = topic_summary(parsed, dumps.select("file"))
    j = (idx.join(dates, "file").join(summ, "file").join(counts, "file", "left")
         .join(best.select("file", "theme", "score", "total", "terms"), "file", "left"))
    return j.select(
        F.col("document").alias("Document"), F.col("file").alias("FileName"), "Date",
        F.coalesce("ParsedTopicCount", F.lit(0)).cast("bigint").alias("ParsedTopicCount"),
        F.col("topic_summary").alias("TopicSummary"),
        F.coalesce("theme", F.lit("Uncategorized")).alias("Category"),
        F.coalesce(F.round(F.col("score") / F.col("total"), 4), F.lit(0.0)).alias("Confidence"),
        F.coalesce(F.array_join("terms", ", "), F.lit("")).alias("Rationale"))


CATEGORY_SCHEMA = "category string, confidence double, rationale string"


def categorize_with(parsed: DataFrame, dumps: DataFrame, classifier) -> DataFrame:
    """P12 with a user's own classifier in place of the lexicon rule.

    ``classifier`` is an Arrow-batched ``pandas_udf`` mapping the topic-summary
    strings to ``struct<category, confidence, rationale>`` (D20). It runs once
    per file on the summary text only; confidence outside [0, 1] fails the job.
    """
    base = categorize(parsed, dumps).drop("Category", "Confidence", "Rationale")
    res = base.withColumn("_r", classifier(F.col("TopicSummary")))
    conf = F.col("_r.confidence")
    checked = F.when(conf.between(0.0, 1.0), conf).otherwise(
        F.raise_error(F.lit("confidence must be within [0, 1]")))
    return res.select(*[c for c in base.columns], F.col("_r.category").alias("Category"),
                      checked.alias("Confidence"), F.col("_r.rationale").alias("Rationale"))
