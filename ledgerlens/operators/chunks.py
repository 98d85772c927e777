"""Sentence chunking and the chunk corpus.

The greedy chunker is a per-document ``aggregate()`` fold over the sentence
array: state = (emitted chunks, buffer, buffer length). It runs inside the
projection of each partition — documents are never grouped or shuffled, and
a document of any length is handled by the same fold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions.html import looks_like_table, split_sentences, split_sentences_sql
from ..functions.regexkit import py_strip, py_strip_sql
from ..functions.tokens import preprocess_finance, preprocess_finance_sql


def _empty() -> Column:
    return F.array().cast("array<string>")


def _flush(chunks: Column, buf: Column, blen: Column, min_chars: int) -> Column:
    emit = (blen > 0) & (blen - 1 >= min_chars)
    return F.when(emit, F.concat(chunks, F.array(buf))).otherwise(chunks)


def _hard_split(s: Column, min_chars: int, max_chars: int) -> Column:
    starts = F.sequence(F.lit(0), F.length(s) - 1, F.lit(max_chars))
    parts = F.transform(starts, lambda i: py_strip(F.substring(s, i + 1, max_chars)))
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def chunk_sentences(sentences: Column, min_chars: int = L.MIN_CHUNK_CHARS,
                    target_chars: int = L.TARGET_CHUNK_CHARS,
                    max_chars: int = L.MAX_CHUNK_CHARS) -> Column:
    """N9 + N10: pack stripped sentences up to ``target``; short buffers are dropped."""
    clean = F.filter(F.transform(sentences, py_strip), lambda s: s != "")
    init = F.struct(_empty().alias("chunks"), F.lit("").alias("buf"), F.lit(0).alias("blen"))

    def step(st, s):
        n = F.length(s)
        flushed = _flush(st["chunks"], st["buf"], st["blen"], min_chars)
        hard = F.struct(F.concat(flushed, _hard_split(s, min_chars, max_chars)).alias("chunks"),
                        F.lit("").alias("buf"), F.lit(0).alias("blen"))
        grow = F.struct(st["chunks"].alias("chunks"),
                        F.when(st["blen"] == 0, s).otherwise(F.concat(st["buf"], F.lit(" "), s))
                        .alias("buf"),
                        (st["blen"] + n + 1).alias("blen"))
        restart = F.struct(flushed.alias("chunks"), s.alias("buf"), (n + 1).alias("blen"))
        return (F.when(n > max_chars, hard)
                .when(st["blen"] + n + 1 <= target_chars, grow)
                .otherwise(restart))

    return F.aggregate(clean, init, step,
                       lambda st: _flush(st["chunks"], st["buf"], st["blen"], min_chars))


def chunk_sentences_sql(expr: str, min_chars: int = L.MIN_CHUNK_CHARS,
                        target_chars: int = L.TARGET_CHUNK_CHARS,
                        max_chars: int = L.MAX_CHUNK_CHARS) -> str:
    clean = f"list_filter(list_transform({expr}, lambda s: {py_strip_sql('s')}), lambda s: s <> '')"

    def flush(st):
        return (f"CASE WHEN {st}.blen > 0 AND {st}.blen - 1 >= {min_chars} "
                f"THEN list_concat({st}.chunks, [{st}.buf]) ELSE {st}.chunks END")

    hard = (f"list_filter(list_transform(generate_series(0, length(s) - 1, {max_chars}), "
            f"lambda i: {py_strip_sql(f'substring(s, i + 1, {max_chars})')}), "
            f"lambda p: length(p) >= {min_chars})")
    step = (f"CASE WHEN length(s) > {max_chars} THEN "
            f"struct_pack(chunks := list_concat({flush('st')}, {hard}), buf := '', blen := 0) "
            f"WHEN st.blen + length(s) + 1 <= {target_chars} THEN "
            f"struct_pack(chunks := st.chunks, buf := CASE WHEN st.blen = 0 THEN s ELSE st.buf || ' ' || s END, "
            f"blen := st.blen + length(s) + 1) "
            f"ELSE struct_pack(chunks := {flush('st')}, buf := s, blen := length(s) + 1) END")
    init = "struct_pack(chunks := []::VARCHAR[], buf := '', blen := 0)"
    folded = f"list_reduce({clean}, lambda st, s: {step}, {init})"
    return f"(SELECT {flush('r')} FROM (SELECT {folded} AS r))"


def chunk_text(text: Column, **kw) -> Column:
    """N8 + N9 + N10 on one text column."""
    return chunk_sentences(split_sentences(text), **kw)


def chunk_text_sql(expr: str, **kw) -> str:
    return chunk_sentences_sql(split_sentences_sql(expr), **kw)


def explode_chunks(df: DataFrame, chunks_col: str, keep) -> DataFrame:
    """One row per chunk with ``chunk_id`` (position among emitted chunks)."""
    out = df.select(*keep, F.posexplode_outer(chunks_col).alias("chunk_id", "chunk"))
    return out.where(F.col("chunk").isNotNull()).withColumn(
        "chunk_chars", F.length("chunk"))


def finance_clean_text(text: Column) -> Column:
    """B-style ``preprocess_text`` output as one space-joined string.

    The second boilerplate pass of the original runs on this string, which only
    holds lower-case [a-z]{4,} tokens separated by single spaces; none of its
    patterns (a two-letter word, digits, a dash) can occur there, so it is the
    identity and is not repeated.
    """
    return F.array_join(preprocess_finance(text), " ")


def finance_clean_text_sql(expr: str) -> str:
    return f"array_to_string({preprocess_finance_sql(expr)}, ' ')"


def chunk_corpus(blocks: DataFrame, min_cleaned: int = L.MIN_CLEANED_CHARS) -> DataFrame:
    """N13 after E11: clean, length gate (N11), chunk, drop table-like chunks.

    ``blocks`` has source_file, doc_type, doc_filename, raw_text.
    """
    cleaned = blocks.select("source_file", "doc_type", "doc_filename",
                            finance_clean_text(F.col("raw_text")).alias("cleaned"))
    gated = cleaned.where(F.length("cleaned") >= min_cleaned)
    chunked = gated.select("source_file", "doc_type", "doc_filename",
                           chunk_text(F.col("cleaned")).alias("chunks"))
    rows = explode_chunks(chunked, "chunks", ("source_file", "doc_type", "doc_filename"))
    return rows.where(~looks_like_table(F.col("chunk"), L.TABLE_MIN_CHARS, L.TABLE_DIGIT_RATIO))
