"""EDGAR submission tags as column expressions.

Every function takes a string ``Column`` and returns a ``Column``; the ``*_sql``
twin renders the same rule as DuckDB SQL for the oracle. Case-insensitive
matching uses ``(?i)`` instead of upper-casing the text, so offsets are never
shifted by characters whose upper-case form is longer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .regexkit import (WS, WSC, java_re, let, py_lstrip, py_lstrip_sql, py_strip, py_strip_sql, re2_re,
                       sql_str)

UWS = WS

# FIXED VALUES: block and tag patterns.
DOC_BLOCK_STRICT = "(?is)<DOCUMENT>" + UWS + "*(.*?)</DOCUMENT>"
DOC_BLOCK_LENIENT = "(?is)<DOCUMENT>(.*?)</DOCUMENT>"
HEADER_RE = "(?is)^(.*?)(<SEC-HEADER>(.*?)</SEC-HEADER>)"  # anchored: linear when absent
SUBMISSION_TYPE_RE = "(?i)CONFORMED SUBMISSION TYPE:" + UWS + "*([A-Z0-9-]+)"
TYPE_STRICT_RE = "(?i)<TYPE>" + UWS + "*([^" + WSC + "<]+)"
TEXT_GREEDY_RE = "(?is)<TEXT>(.*)</TEXT>"
TEXT_LAZY_RE = "(?is)<TEXT>(.*?)</TEXT>"
HTML_HINT_RE = ("(?i)<" + UWS + "*(?:" + "|".join(L.HTML_HINT_TAGS) + ")(?:[" + WSC
                + "/>]|\\z)")
GUNK_RE = "(?i)\n(?:" + "|".join(L.GUNK_MARKERS) + ")\n"
HEADER_END_RE = "(?i)</SEC-HEADER>"


def lenient_tag_re(tag: str) -> str:
    return "(?i)<" + tag + ">" + UWS + "*([^\n<]+)"


# E3 ------------------------------------------------------------------------
def document_blocks(raw: Column, lenient: bool = False) -> Column:
    return F.regexp_extract_all(raw, F.lit(java_re(DOC_BLOCK_LENIENT if lenient else DOC_BLOCK_STRICT)), 1)


def document_blocks_sql(expr: str, lenient: bool = False) -> str:
    pat = DOC_BLOCK_LENIENT if lenient else DOC_BLOCK_STRICT
    return f"regexp_extract_all({expr}, {sql_str(re2_re(pat))}, 1)"


# E1 ------------------------------------------------------------------------
def _header_ok(raw: Column) -> Column:
    prefix = F.regexp_extract(raw, java_re(HEADER_RE), 1)
    inner = F.regexp_extract(raw, java_re(HEADER_RE), 3)
    return raw.rlike(java_re(HEADER_RE)) & ~prefix.rlike(java_re(HEADER_END_RE)) & (F.length(inner) > 0)


def _header_ok_sql(expr: str) -> str:
    p = sql_str(re2_re(HEADER_RE))
    return (f"(regexp_matches({expr}, {p}) AND NOT regexp_matches(regexp_extract({expr}, {p}, 1), "
            f"{sql_str(re2_re(HEADER_END_RE))}) AND length(regexp_extract({expr}, {p}, 3)) > 0)")


def sec_header(raw: Column) -> Column:
    """First header block, trimmed; NULL when absent or malformed."""
    return F.when(_header_ok(raw), py_strip(F.regexp_extract(raw, java_re(HEADER_RE), 2)))


def sec_header_sql(expr: str) -> str:
    return (f"CASE WHEN {_header_ok_sql(expr)} THEN "
            f"{py_strip_sql(f'regexp_extract({expr}, {sql_str(re2_re(HEADER_RE))}, 2)')} END")


# E2 ------------------------------------------------------------------------
def primary_form(raw: Column) -> Column:
    inner = F.regexp_extract(raw, java_re(HEADER_RE), 3)
    return F.when(_header_ok(raw), F.upper(F.regexp_extract(inner, java_re(SUBMISSION_TYPE_RE), 1))
                  ).otherwise(F.lit(""))


def primary_form_sql(expr: str) -> str:
    inner = f"regexp_extract({expr}, {sql_str(re2_re(HEADER_RE))}, 3)"
    return (f"CASE WHEN {_header_ok_sql(expr)} THEN upper(regexp_extract({inner}, "
            f"{sql_str(re2_re(SUBMISSION_TYPE_RE))}, 1)) ELSE '' END")


# E4 / E5 -------------------------------------------------------------------
def doc_type_strict(block: Column) -> Column:
    return F.upper(py_strip(F.regexp_extract(block, java_re(TYPE_STRICT_RE), 1)))


def doc_type_strict_sql(expr: str) -> str:
    return f"upper({py_strip_sql(f'regexp_extract({expr}, {sql_str(re2_re(TYPE_STRICT_RE))}, 1)')})"


def tag_value(block: Column, tag: str, default: str) -> Column:
    v = py_strip(F.regexp_extract(block, java_re(lenient_tag_re(tag)), 1))
    return let(v, lambda x: F.when(x == "", F.lit(default)).otherwise(x))


def tag_value_sql(expr: str, tag: str, default: str) -> str:
    v = py_strip_sql(f"regexp_extract({expr}, {sql_str(re2_re(lenient_tag_re(tag)))}, 1)")
    return f"CASE WHEN {v} = '' THEN {sql_str(default)} ELSE {v} END"


# E6 / E7 / E8 --------------------------------------------------------------
def is_junk_type(t: Column) -> Column:
    return t.isin(*L.SKIP_TYPES)


def is_junk_type_sql(t: str) -> str:
    return f"({t} IN ({', '.join(sql_str(x) for x in L.SKIP_TYPES)}))"


def is_xbrl_aux(t: Column) -> Column:
    return t.startswith(L.XBRL_AUX_PREFIX) | t.isin(*L.XBRL_AUX_EXACT)


def is_xbrl_aux_sql(t: str) -> str:
    return (f"(starts_with({t}, {sql_str(L.XBRL_AUX_PREFIX)}) OR {t} IN "
            f"({', '.join(sql_str(x) for x in L.XBRL_AUX_EXACT)}))")


def keep_doc_type(t: Column, form: Column) -> Column:
    prefixes = None
    for p in L.KEEP_PREFIXES:
        c = t.startswith(p)
        prefixes = c if prefixes is None else prefixes | c
    return (t != "") & (((form != "") & (t == form)) | prefixes)


def keep_doc_type_sql(t: str, form: str) -> str:
    pre = " OR ".join(f"starts_with({t}, {sql_str(p)})" for p in L.KEEP_PREFIXES)
    return f"({t} <> '' AND (({form} <> '' AND {t} = {form}) OR {pre}))"


def keep_block(t: Column, form: Column) -> Column:
    """E6 + E7 + E8 in the order of the clean-filing job."""
    return ~is_junk_type(t) & ~is_xbrl_aux(t) & keep_doc_type(t, form)


def keep_block_sql(t: str, form: str) -> str:
    return f"(NOT {is_junk_type_sql(t)} AND NOT {is_xbrl_aux_sql(t)} AND {keep_doc_type_sql(t, form)})"


# E9 / E10 ------------------------------------------------------------------
def text_body_greedy(block: Column) -> Column:
    """First <TEXT> to last </TEXT>, else the whole block; trimmed."""
    return py_strip(F.when(block.rlike(java_re(TEXT_GREEDY_RE)), F.regexp_extract(block, java_re(TEXT_GREEDY_RE), 1))
                    .otherwise(block))


def text_body_greedy_sql(expr: str) -> str:
    p = sql_str(re2_re(TEXT_GREEDY_RE))
    return py_strip_sql(f"CASE WHEN regexp_matches({expr}, {p}) THEN regexp_extract({expr}, {p}, 1) "
                        f"ELSE {expr} END")


def has_text_tag(block: Column) -> Column:
    return block.rlike(java_re(TEXT_LAZY_RE))


def has_text_tag_sql(expr: str) -> str:
    return f"regexp_matches({expr}, {sql_str(re2_re(TEXT_LAZY_RE))})"


def text_body_lazy(block: Column) -> Column:
    """First <TEXT> to first </TEXT>, untrimmed; NULL when there is none."""
    return F.when(has_text_tag(block), F.regexp_extract(block, java_re(TEXT_LAZY_RE), 1))


def text_body_lazy_sql(expr: str) -> str:
    return (f"CASE WHEN {has_text_tag_sql(expr)} THEN regexp_extract({expr}, "
            f"{sql_str(re2_re(TEXT_LAZY_RE))}, 1) END")


# E12 -----------------------------------------------------------------------
_GUNK_PREFIX_RE = "(?s)^(.*?)" + GUNK_RE


def drop_leading_gunk(text: Column) -> Column:
    """Cut everything before the earliest header marker when it is not at 0."""
    def cut(t: Column) -> Column:
        pos = F.length(F.regexp_extract(t, java_re(_GUNK_PREFIX_RE), 1))
        hit = t.rlike(java_re(GUNK_RE)) & (pos > 0)
        return F.when(hit, py_lstrip(F.substring(t, pos + 1, 2147483647))).otherwise(t)
    return let(text, cut)


def drop_leading_gunk_sql(expr: str) -> str:
    pos = f"length(regexp_extract({expr}, {sql_str(re2_re(_GUNK_PREFIX_RE))}, 1))"
    return (f"CASE WHEN regexp_matches({expr}, {sql_str(re2_re(GUNK_RE))}) AND {pos} > 0 "
            f"THEN {py_lstrip_sql(f'substring({expr}, {pos} + 1)')} ELSE {expr} END")


# E13 -----------------------------------------------------------------------
def looks_like_html(text: Column) -> Column:
    return text.rlike(java_re(HTML_HINT_RE)) | text.contains("</")


def looks_like_html_sql(expr: str) -> str:
    return f"(regexp_matches({expr}, {sql_str(re2_re(HTML_HINT_RE))}) OR contains({expr}, '</'))"


# S6 ------------------------------------------------------------------------
def clean_output_name(path: Column) -> Column:
    """Basename + "_clean.txt": lower-case ".txt" replaced everywhere in the name."""
    base = F.regexp_extract(path, "([^/]*)$", 1)
    return F.when(F.lower(base).endswith(".txt"), F.replace(base, F.lit(".txt"), F.lit(L.CLEAN_SUFFIX))
                  ).otherwise(F.concat(base, F.lit(L.CLEAN_SUFFIX)))


def clean_output_name_sql(expr: str) -> str:
    base = f"regexp_extract({expr}, '([^/]*)$', 1)"
    return (f"CASE WHEN ends_with(lower({base}), '.txt') THEN replace({base}, '.txt', "
            f"{sql_str(L.CLEAN_SUFFIX)}) ELSE {base} || {sql_str(L.CLEAN_SUFFIX)} END")
