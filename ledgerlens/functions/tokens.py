"""Token rules as array-column expressions (K1-K10, K13) and dates.

Tokens stay in an ``ARRAY<STRING>`` column and are edited with JVM higher-order
functions (``filter``/``transform``), so a document is never exploded just to
drop or rewrite words. Word tables are literal ``IN`` lists that Catalyst turns
into hash-set lookups.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L
from .html import H2_STEPS, N5_STEPS, N6_STEPS, html_flat_sql
from .regexkit import STRIP_CHARS, WS, Re, apply_chain, chain_sql, java_re, let, py_strip, py_strip_sql, re2_re, sql_str

FIN_STOPWORDS = tuple(dict.fromkeys(L.BASE_STOPWORDS + L.FIN_EXTRA_STOPWORDS))
SPEECH_STOPWORDS = tuple(w for w in L.ENGLISH_STOPWORDS if w not in L.KEEP_NEGATIONS)
EXCLUSIONS = tuple(dict.fromkeys(L.EXCLUSION_LIST))
#: Letters of the shortest word that K6 and K7 keep: only an exception of K6 makes a word longer.
SHORTEST = min([L.MIN_WORD_LEN, *(len(k) for k, v in L.LEMMA_EXCEPTIONS.items() if len(v) >= L.MIN_WORD_LEN)])
#: A run of the white space that H2 collapses, as ranges: in a pattern with this, letters and word ends mean what they do without.
SPACES = "[" + "".join(f"\\x{{{ord(c):X}}}" for c in STRIP_CHARS) + "]+"


def _in_list_sql(var: str, words) -> str:
    return f"{var} IN ({', '.join(sql_str(w) for w in words)})"


# K9 ------------------------------------------------------------------------
def finance_tokens(text: Column) -> Column:
    """K9 on already-cleaned text: [A-Za-z]+ of lower text, > 3 chars, not a stop word."""
    # a run is matched whole, so the least length in the pattern leaves out the short runs
    words = F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{L.FIN_MIN_TOKEN_LEN},}}"), 0)
    return F.filter(words, lambda t: ~t.isin(*FIN_STOPWORDS))


def finance_tokens_sql(expr: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({expr}), '[a-z]+', 0), lambda t: "
            f"length(t) >= {L.FIN_MIN_TOKEN_LEN} AND NOT ({_in_list_sql('t', FIN_STOPWORDS)}))")


def preprocess_finance(text: Column) -> Column:
    """B-style ``preprocess_text``: H2, N5, N6, then K9 tokens.

    The token output only depends on the [a-z]+ runs of the lower-cased text.
    The whitespace collapses of H2 and N5, the final strips and the N6 number strip
    only rewrite non-letters into spaces, so they cannot change those runs and
    are skipped here (four fewer passes per document); N5's title, which names
    single spaces, is matched with runs of white space instead. The SQL twin keeps the
    complete chain, so the oracle re-checks this equivalence on every run.
    """
    title, *others = N5_STEPS[:-1]
    spaced = Re(title.pattern.replace(" ", SPACES), title.repl)
    return finance_tokens(apply_chain(text, (*H2_STEPS[:-1], spaced, *others)))


def preprocess_finance_sql(expr: str) -> str:
    cleaned = chain_sql(py_strip_sql(chain_sql(html_flat_sql(expr), N5_STEPS)), N6_STEPS)
    return finance_tokens_sql(cleaned)


# K1-K7 (K10) ---------------------------------------------------------------
def _contraction_case(var_col: Column) -> Column:
    expr = None
    for k, v in L.CONTRACTIONS.items():
        expr = (F.when(var_col == k, F.lit(v)) if expr is None
                else expr.when(var_col == k, F.lit(v)))
    return expr.otherwise(var_col)


def _contraction_case_sql(var: str) -> str:
    branches = " ".join(f"WHEN {sql_str(k)} THEN {sql_str(v)}" for k, v in L.CONTRACTIONS.items())
    return f"CASE {var} {branches} ELSE {var} END"


def lemma(t: Column) -> Column:
    """Own noun-lemma rule: exception table, then plural suffix rules.

    The first branch lets most words (no trailing "s", not an exception) out
    after one suffix test and one hash-set lookup.
    """
    n = F.length(t)
    keep = None
    for e in L.LEMMA_KEEP_ENDINGS:
        c = t.endswith(e)
        keep = c if keep is None else keep | c
    expr = F.when(~t.endswith("s") & ~t.isin(*L.LEMMA_EXCEPTIONS), t)
    for k, v in L.LEMMA_EXCEPTIONS.items():
        expr = expr.when(t == k, F.lit(v))
    return (expr
            .when((n > 4) & t.endswith("ies"), F.concat(F.substring(t, 1, n - 3), F.lit("y")))
            .when((n > 4) & t.endswith("sses"), F.substring(t, 1, n - 2))
            .when((n > 3) & t.endswith("s") & ~keep, F.substring(t, 1, n - 1))
            .otherwise(t))


def lemma_sql(t: str) -> str:
    exc = " ".join(f"WHEN {t} = {sql_str(k)} THEN {sql_str(v)}" for k, v in L.LEMMA_EXCEPTIONS.items())
    keep = " OR ".join(f"ends_with({t}, {sql_str(e)})" for e in L.LEMMA_KEEP_ENDINGS)
    n = f"length({t})"
    return (f"CASE {exc} "
            f"WHEN {n} > 4 AND ends_with({t}, 'ies') THEN substring({t}, 1, {n} - 3) || 'y' "
            f"WHEN {n} > 4 AND ends_with({t}, 'sses') THEN substring({t}, 1, {n} - 2) "
            f"WHEN {n} > 3 AND ends_with({t}, 's') AND NOT ({keep}) THEN substring({t}, 1, {n} - 1) "
            f"ELSE {t} END")


def preprocess_speech(text: Column) -> Column:
    """K10 = K1 lower/normalise, K2 contractions, K3 punctuation delete,
    K4 letters only, K5 stop words (keeping not/no), K6 lemma, K7 length >= 3."""
    # K1 + K2. Only words with an apostrophe can be contractions, and the
    # split/re-join round trip changes nothing but whitespace, which K4 ignores:
    # texts without an apostrophe skip it, other words skip the lookup.
    def expand(low: Column) -> Column:
        words = F.split(py_strip(low), java_re(WS + "+"))                                  # K1
        fixed = F.transform(words, lambda w: F.when(w.contains("'"), _contraction_case(w))
                            .otherwise(w))
        return F.when(low.contains("'"), F.array_join(fixed, " ")).otherwise(low)         # K2
    expanded = let(F.lower(text), expand)
    no_punct = F.translate(expanded, L.ASCII_PUNCTUATION, "")              # K3
    letters = F.regexp_extract_all(no_punct, F.lit(f"[a-zA-Z]{{{SHORTEST},}}"), 0)     # K4, without what K7 drops whatever K6 makes of it
    kept = F.filter(letters, lambda t: ~t.isin(*SPEECH_STOPWORDS))         # K5
    lemmas = F.transform(kept, lemma)                                      # K6
    return F.filter(lemmas, lambda t: F.length(t) >= L.MIN_WORD_LEN)       # K7


def preprocess_speech_sql(expr: str) -> str:
    words = f"string_split_regex({py_strip_sql(f'lower({expr})')}, {sql_str(re2_re(WS + '+'))})"
    expanded = f"array_to_string(list_transform({words}, lambda w: {_contraction_case_sql('w')}), ' ')"
    no_punct = f"translate({expanded}, {sql_str(L.ASCII_PUNCTUATION)}, '')"
    letters = f"regexp_extract_all({no_punct}, '[a-zA-Z]+', 0)"
    kept = f"list_filter({letters}, lambda t: NOT ({_in_list_sql('t', SPEECH_STOPWORDS)}))"
    lemmas = f"list_transform({kept}, lambda t: {lemma_sql('t')})"
    return f"list_filter({lemmas}, lambda t: length(t) >= {L.MIN_WORD_LEN})"


# K13 -----------------------------------------------------------------------
def exclude_words(tokens: Column, words=EXCLUSIONS) -> Column:
    return F.filter(tokens, lambda t: ~t.isin(*words))


def exclude_words_sql(expr: str, words=EXCLUSIONS) -> str:
    return f"list_filter({expr}, lambda t: NOT ({_in_list_sql('t', words)}))"


# N14 -----------------------------------------------------------------------
# FIXED VALUES: date patterns (ISO-like first, then month-first).
ISO_DATE_RE = r"\b(20[0-9]{2})[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12][0-9]|3[01])\b"
US_DATE_RE = r"\b(0[1-9]|1[0-2])[/-](0[1-9]|[12][0-9]|3[01])[/-](20[0-9]{2})\b"


def extract_date(text: Column) -> Column:
    """First ISO-like date anywhere, else first month-first date; 'YYYY-MM-DD' or ''."""
    iso = F.concat_ws("-", *[F.regexp_extract(text, ISO_DATE_RE, i) for i in (1, 2, 3)])
    us = F.concat_ws("-", *[F.regexp_extract(text, US_DATE_RE, i) for i in (3, 1, 2)])
    return (F.when(text.rlike(ISO_DATE_RE), iso)
            .when(text.rlike(US_DATE_RE), us)
            .otherwise(F.lit("")))


def extract_date_sql(expr: str) -> str:
    iso = " || '-' || ".join(f"regexp_extract({expr}, {sql_str(ISO_DATE_RE)}, {i})" for i in (1, 2, 3))
    us = " || '-' || ".join(f"regexp_extract({expr}, {sql_str(US_DATE_RE)}, {i})" for i in (3, 1, 2))
    return (f"CASE WHEN regexp_matches({expr}, {sql_str(ISO_DATE_RE)}) THEN {iso} "
            f"WHEN regexp_matches({expr}, {sql_str(US_DATE_RE)}) THEN {us} ELSE '' END")
