"""Word-frequency and theme reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L


def explode_tokens(docs: DataFrame, tokens_col: str = "tokens", out: str = "term",
                   keep=()) -> DataFrame:
    """One row per token.

    ``explode_outer`` + a null filter instead of ``explode``: for a plain
    ``explode`` Catalyst infers a ``size(tokens) > 0`` filter below the
    generator and so evaluates the whole tokenising expression twice.
    """
    return (docs.select(*keep, F.explode_outer(tokens_col).alias(out))
            .where(F.col(out).isNotNull()))


def term_counts(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """(term, n): partial aggregation runs map-side before the shuffle on term."""
    return (explode_tokens(docs, tokens_col, "term")
            .groupBy("term").agg(F.count(F.lit(1)).alias("n")))


def word_frequency(docs: DataFrame, tokens_col: str = "tokens",
                   top_n: int = L.TOP_WORDS_REPORT) -> DataFrame:
    """Top words with count and percent of all words (ties: term ascending).

    The total is an uncorrelated scalar subquery over the already aggregated
    counts, so no single-partition window is needed over the vocabulary.
    """
    counts = term_counts(docs, tokens_col)
    total = counts.agg(F.sum("n")).scalar()
    top = counts.orderBy(F.desc("n"), F.asc("term")).limit(top_n)
    return top.select("term", "n", F.round(F.col("n") * 100.0 / total, 4).alias("pct"))


def theme_table(spark) -> DataFrame:
    """The theme lexicon as a small (word, theme) table, fixed size."""
    rows = [(w, theme) for theme, words in L.THEMES.items() for w in dict.fromkeys(words)]
    return spark.createDataFrame(rows, "word string, theme string")


def theme_distribution(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """Words per theme and percent of all words.

    The lexicon has a fixed, small size (see ``lexicons.THEMES``), so it is
    broadcast; the corpus side is aggregated per word before the join.
    """
    spark = docs.sparkSession
    counts = term_counts(docs, tokens_col)
    total = counts.agg(F.sum("n")).scalar()
    lex = F.broadcast(theme_table(spark))
    joined = counts.join(lex, counts.term == lex.word, "inner")
    per_theme = joined.groupBy("theme").agg(F.sum("n").alias("words"))
    # every theme is reported, with 0 words when none of its words occurs
    themes = F.broadcast(theme_table(spark).select("theme").distinct())
    out = themes.join(per_theme, "theme", "left").select(
        "theme", F.coalesce("words", F.lit(0)).cast("bigint").alias("words"))
    return out.select("theme", "words", F.round(F.col("words") * 100.0 / total, 4).alias("pct"))
