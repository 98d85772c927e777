"""EDGAR submission operators.

A filing is one row holding the whole submission text. Two shapes are offered:

* ``clean_filings`` keeps one row per filing and does the whole clean-up inside
  it: array higher-order functions split, filter by type and assemble, the
  element scanner (``functions.markup``) reads the kept HTML bodies in Arrow
  batches. It is a narrow map: no shuffle, no re-grouping of cleaned text,
  which at scale is a full copy of the corpus avoided.
* ``document_blocks`` / ``kept_sections`` explode blocks into rows (one per
  ``<DOCUMENT>``) for block-level tables and downstream chunking.

Type tests run before any body regex, so dropped blocks cost no HTML work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import edgar as E
from ..functions import lexicons as L
from ..functions.html import decode_entities, normalize_lines
from ..functions.markup import scan_markup
from ..functions.regexkit import let, py_strip
from ..session import write_once


def _scannable(body: Column, doc_type: Column) -> Column:
    """(t, page, body): E9 output after the E12 gunk cut; when E13 says HTML, ``page`` is set and references are decoded."""
    def parts(cut: Column) -> Column:
        page = E.looks_like_html(cut)
        return F.struct(doc_type.alias("t"), page.alias("page"), F.when(page, decode_entities(cut)).otherwise(cut).alias("body"))
    return let(E.drop_leading_gunk(body), parts)


def _tidy(scanned: Column, page: Column) -> Column:
    """N1-N4 on what was a page, then strip."""
    return py_strip(F.when(page, normalize_lines(scanned)).otherwise(scanned))


def _banner(t: Column) -> Column:
    label = F.when(t == "", F.lit(L.UNKNOWN_TYPE)).otherwise(t)
    return F.concat(F.lit(L.SECTION_BANNER_PREFIX), label, F.lit(L.SECTION_BANNER_SUFFIX))


def clean_filings(filings: DataFrame, raw_col: str = "raw", keep_header: bool = True,
                  keep=("f",)) -> DataFrame:
    """One clean text per filing (header, then banner + body per kept block).

    The primary form is bound once per filing (``let``): referenced directly
    inside the per-block filter it would be re-extracted for every block.
    """
    raw = F.col(raw_col)

    def sections_for(form: Column) -> Column:
        typed = F.transform(E.document_blocks(raw),
                            lambda b: F.struct(E.doc_type_strict(b).alias("t"), b.alias("b")))
        kept = F.filter(typed, lambda s: E.keep_block(s["t"], form))
        return F.transform(kept, lambda s: _scannable(E.text_body_greedy(s["b"]), s["t"]))

    header = E.sec_header(raw) if keep_header else F.lit(None).cast("string")
    cut = filings.select(*keep, header.alias("_header"), let(E.primary_form(raw), sections_for).alias("_sections"))
    cut = cut.select(*keep, "_header", *[F.col(f"_sections.{c}").alias(f"_{c}") for c in ("t", "page", "body")])
    cleaned = F.transform(F.arrays_zip("_t", "_page", "_body"), lambda s: F.struct(
        s["_t"].alias("t"), _tidy(s["_body"], s["_page"]).alias("body")))
    nonempty = F.filter(cleaned, lambda s: s["body"] != "")
    sections = F.array_join(F.transform(nonempty, lambda s: F.concat(_banner(s["t"]), F.lit("\n"), s["body"])), "\n\n")
    text = py_strip(F.concat_ws("\n\n", "_header", sections))
    return scan_markup(cut, "_body", "_page").select(*keep, text.alias("clean_text"))


def document_blocks(filings: DataFrame, raw_col: str = "raw", keep=("f",),
                    lenient: bool = False) -> DataFrame:
    """One row per <DOCUMENT> block with its 0-based position ``seq``.

    ``posexplode_outer`` + null filter keeps Catalyst from evaluating the block
    regex twice (see ``report.explode_tokens``).
    """
    out = filings.select(*keep, E.primary_form(F.col(raw_col)).alias("primary_form"),
                         F.posexplode_outer(E.document_blocks(F.col(raw_col), lenient))
                         .alias("seq", "block"))
    return out.where(F.col("block").isNotNull())


def block_fields(blocks: DataFrame) -> DataFrame:
    """E4-E10, E13 as columns of each block."""
    b = F.col("block")
    t = E.doc_type_strict(b)
    return blocks.select(
        "*",
        t.alias("doc_type"),
        E.tag_value(b, "TYPE", L.UNKNOWN_TYPE).alias("type_lenient"),
        E.tag_value(b, "FILENAME", "").alias("filename"),
        E.is_junk_type(t).alias("is_junk"),
        E.is_xbrl_aux(t).alias("is_xbrl_aux"),
        E.keep_block(t, F.col("primary_form")).alias("keep"),
        E.text_body_greedy(b).alias("body_greedy"),
        E.text_body_lazy(b).alias("body_lazy"),
    )


def kept_sections(filings: DataFrame, raw_col: str = "raw", keep=("f",)) -> DataFrame:
    """(seq, doc_type, body) of every kept, non-empty section."""
    blocks = document_blocks(filings, raw_col, keep)
    t = E.doc_type_strict(F.col("block"))
    typed = blocks.select(*keep, "seq", "primary_form", "block", t.alias("doc_type"))
    kept = typed.where(E.keep_block(F.col("doc_type"), F.col("primary_form")))
    cut = kept.select(*keep, "seq", _scannable(E.text_body_greedy(F.col("block")), F.col("doc_type")).alias("_section"))
    cut = cut.select(*keep, "seq", F.col("_section.t").alias("doc_type"), F.col("_section.page").alias("_page"), F.col("_section.body").alias("_body"))
    out = scan_markup(cut, "_body", "_page").select(*keep, "seq", "doc_type", _tidy(F.col("_body"), F.col("_page")).alias("body"))
    return out.where(F.col("body") != "")


def submission_blocks(filings: DataFrame, raw_col: str = "raw", source_col: str = "source_file"
                      ) -> DataFrame:
    """B-style parser: lenient blocks (E3), TYPE/FILENAME tags (E5), lazy TEXT.

    Blocks without a <TEXT> section are skipped.
    """
    blocks = filings.select(F.col(source_col).alias("source_file"),
                            F.posexplode_outer(E.document_blocks(F.col(raw_col), lenient=True))
                            .alias("seq", "block")).where(F.col("block").isNotNull())
    b = F.col("block")
    return (blocks.where(E.has_text_tag(b))
            .select("source_file", "seq",
                    E.tag_value(b, "TYPE", L.UNKNOWN_TYPE).alias("doc_type"),
                    E.tag_value(b, "FILENAME", "").alias("doc_filename"),
                    E.text_body_lazy(b).alias("raw_text")))


def preferred_blocks(blocks: DataFrame, preferred=L.PREFERRED_TYPES) -> DataFrame:
    """Keep preferred types if any occurs anywhere in the input, else keep all.

    The blocks are written once, so the submissions are parsed once: the
    corpus-wide flag reads the type column alone. It is an uncorrelated scalar
    subquery (one boolean, a partial and a final aggregate), not a join.
    """
    blocks = write_once(blocks, "blocks")
    is_pref = F.col("doc_type").isin(*preferred)
    any_pref = blocks.agg(F.coalesce(F.max(is_pref), F.lit(False))).scalar()
    return blocks.where(is_pref | ~any_pref)
