"""Flat HTML cleaning and text normalisation as column expressions (H2, N1-N8), and H1's SQL.

The chains are JVM regex replacements, so they run inside the executor's
codegen'd projection with no Python round trip. Each chain has a SQL rendering
used by the DuckDB oracle. H1 needs a page's elements: ``markup.pages_to_text``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexkit import (HWS, WS, Guard, Lit, Re, apply_chain, chain_sql, py_strip, py_strip_sql,
                       let, sql_str)
from .entities import unescape, unknown_reference

UWS = WS
# Line boundaries that Python's ``str.splitlines`` recognises besides "\n".
LINE_BREAKS = r"[\x{0B}\f\r\x{1C}-\x{1E}\x{85}\x{2028}\x{2029}]"

# FIXED VALUES: the references that nearly all pages keep to, decoded by a chain
# of plain replacements; texts with any other take ``entities.unescape``.
# "&amp;" is decoded last so that "&amp;lt;" yields "&lt;" (single pass).
ENTITIES = (
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&#x27;", "'"), ("&nbsp;", " "), ("&#160;", " "), ("&middot;", "·"),
    ("&copy;", "©"), ("&reg;", "®"), ("&trade;", "™"), ("&mdash;", "—"),
    ("&ndash;", "–"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"),
    ("&rdquo;", "”"), ("&hellip;", "…"), ("&bull;", "•"), ("&sect;", "§"),
    ("&#8217;", "’"), ("&#8220;", "“"), ("&#8221;", "”"), ("&#8212;", "—"),
    ("&amp;", "&"),
)
ENTITY_STEPS = (Guard("&", tuple(Lit(a, b) for a, b in ENTITIES)),)

_TAG_TAIL = "(?:[^A-Za-z0-9_>][^>]*)?>"


def _drop_element(name: str) -> Re:
    return Re("(?is)<" + name + _TAG_TAIL + ".*?</" + name + UWS + "*>", " ")


# Whitespace normalisation that keeps line structure.
N1_STEPS = (Re("[ \t]+", " "),)
N2_STEPS = (Re("([0-9]+(?:[.][0-9]+)?)" + UWS + "*\n" + UWS + "*%" + UWS + "*", "$1% "),)
N3_STEPS = (Re("\n" + UWS + "*\n" + UWS + "*\n+", "\n\n"),)
N4_STEPS = (Lit("\r\n", "\n"), Re(LINE_BREAKS, "\n"), Re(HWS + "+\n", "\n"))

# H1 in SQL, the oracle of ``markup.pages_to_text``. Entities first, so escaped markup becomes markup.
H1_NO_TEXT_STEPS = (Guard("<", (
    _drop_element("script"), _drop_element("style"), _drop_element("noscript"),
    _drop_element("svg"),
    Re("(?s)<!--.*?-->", " "),
    Re("<[!?][^>]*>", " "),
    Re("(?i)<p" + _TAG_TAIL, "<p>"),
)),)
H1_TAG_STEPS = (Guard("<", (
    Re("(?i)<img" + _TAG_TAIL, " "),
    Re("(?i)<br" + _TAG_TAIL, " \n "),
    Re("(?i)</(?:p|div|tr|li|h[1-6]|table)" + UWS + "*>", " \n "),
    Re("</?[A-Za-z][^>]*>", " "),
)),)
#: Tags before which a paragraph ends that has no end tag of its own.
P_ENDERS = "article|aside|blockquote|body|div|dl|fieldset|footer|form|h[1-6]|header|hr|li|main|nav|ol|pre|section|table|td|ul"

# H2: flat cleaner. Tags first, entities after, every whitespace run -> one space.
H2_TAG_STEPS = (Guard("<", (
    Re("(?is)<script.*?>.*?</script>", " "),
    Re("(?is)<style.*?>.*?</style>", " "),
    Re("<[^>]+>", " "),
)),)
H2_TIDY_STEPS = (Lit("\u0000", " "), Re(UWS + "+", " "))
H2_STEPS = H2_TAG_STEPS + ENTITY_STEPS + H2_TIDY_STEPS

# Boilerplate strip; N6: numbers and amounts.
N5_STEPS = (
    Re(r"(?i)\btable of contents\b", " "),
    Guard("S-", (Re(r"\bS-[0-9]+\b", " "),)),
    Guard("Page", (Re(r"\bPage" + UWS + r"+[0-9]+\b", " "),)),
    Re(UWS + "+", " "),
)
N6_STEPS = (Re(r"\$?[0-9][0-9,.%]*", " "),)


UNKNOWN_REFERENCE = unknown_reference(tuple(a for a, _ in ENTITIES))


def decode_entities(col: Column) -> Column:
    """All character references: by the short chain where that knows them all, else in full."""
    return let(col, lambda v: F.when(~v.contains("&"), v)
               .when(v.rlike(UNKNOWN_REFERENCE), unescape(v)).otherwise(apply_chain(v, ENTITY_STEPS)))


def html_to_text_sql(expr: str) -> str:
    """H1 + N1-N4 for pages that leave out no end tags but those of paragraphs: each gets its own, then a chain of replacements."""
    cut = f"string_split({chain_sql(expr, ENTITY_STEPS + H1_NO_TEXT_STEPS)}, '<p>')"
    ended = (f"[CASE WHEN regexp_matches(x, '(?i)</p') THEN x ELSE regexp_replace(x, '(?i)(</?(?:{P_ENDERS})[ \t\r\n/>]|$)', '</p>\\1') END"
             " for x in pieces[2:]]")
    whole = f"(SELECT array_to_string(list_prepend(pieces[1], {ended}), '<p>') FROM (SELECT {cut} AS pieces) one)"
    return py_strip_sql(chain_sql(whole, H1_TAG_STEPS + N1_STEPS + N2_STEPS + N3_STEPS + N4_STEPS))


def html_flat(col: Column) -> Column:
    """H2: tags to spaces, decode entities, collapse all whitespace."""
    return py_strip(apply_chain(decode_entities(apply_chain(col, H2_TAG_STEPS)), H2_TIDY_STEPS))


def html_flat_sql(expr: str) -> str:
    return py_strip_sql(chain_sql(expr, H2_STEPS))


def normalize_lines(col: Column) -> Column:
    """N1-N4 on plain text."""
    return py_strip(apply_chain(col, N1_STEPS + N2_STEPS + N3_STEPS + N4_STEPS))


def normalize_lines_sql(expr: str) -> str:
    return py_strip_sql(chain_sql(expr, N1_STEPS + N2_STEPS + N3_STEPS + N4_STEPS))


def strip_boilerplate(col: Column) -> Column:
    return py_strip(apply_chain(col, N5_STEPS))


def strip_boilerplate_sql(expr: str) -> str:
    return py_strip_sql(chain_sql(expr, N5_STEPS))


def strip_numbers(col: Column) -> Column:
    return apply_chain(col, N6_STEPS)


def strip_numbers_sql(expr: str) -> str:
    return chain_sql(expr, N6_STEPS)


# Table-like predicate.
def looks_like_table(col: Column, min_chars: int = 200, ratio: float = 0.18) -> Column:
    n = F.length(col)
    digits = F.length(F.regexp_replace(col, "[^0-9]+", ""))
    return (n < min_chars) | ((digits / F.greatest(n, F.lit(1))) > ratio)


def looks_like_table_sql(expr: str, min_chars: int = 200, ratio: float = 0.18) -> str:
    n = f"length({expr})"
    digits = f"length(regexp_replace({expr}, '[^0-9]+', '', 'g'))"
    return f"(({n}) < {min_chars} OR ({digits})::DOUBLE / greatest({n}, 1) > {ratio})"


# Sentence split after . ! ? followed by whitespace. Neither engine's split
# has look-behind in common, so a marker character is inserted first.
SENTENCE_MARK = "\u0001"
SENTENCE_STEPS = (Re("([.!?])" + UWS + "+", "$1" + SENTENCE_MARK),)


def split_sentences(col: Column) -> Column:
    return F.split(apply_chain(col, SENTENCE_STEPS), SENTENCE_MARK)


def split_sentences_sql(expr: str) -> str:
    return f"string_split({chain_sql(expr, SENTENCE_STEPS)}, {sql_str(SENTENCE_MARK)})"
