"""Regex chains shared by the Spark operators and their SQL oracles.

A chain is a list of steps applied in order to one string column. Each step is
rendered either as a Spark ``Column`` (JVM ``regexp_replace`` / ``replace``)
or as DuckDB SQL text for the oracle. Patterns are templates: ``@WS@`` is the
whitespace set of Python's ``str.isspace``, ``@HWS@`` the same without the
newline, ``@WSC@`` its bare class content (to embed in a larger class).

* Java rendering: ``(?U)\\s`` plus U+001C-U+001F. The Unicode flag makes
  ``\\s`` one property test per character, about 3x faster than a class of
  explicit ranges.
* RE2 (DuckDB) rendering: the explicit ranges, since RE2 has no ``(?U)``.

Only syntax common to both engines is used otherwise: no look-around and no
back-references.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: the characters Python's str.isspace() accepts.
STRIP_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
               + "".join(chr(c) for c in range(0x2000, 0x200B))
               + "    　")

_RE2_WSC = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
_RE2_HWSC = (r"\t\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
_JAVA_WSC = r"\s\x{1C}-\x{1F}"

# Placeholders usable in pattern templates.
WS = "@WS@"
HWS = "@HWS@"
WSC = "@WSC@"


def java_re(template: str) -> str:
    out = (template.replace(HWS, "[" + _JAVA_WSC + r"&&[^\n]]")
           .replace(WS, "[" + _JAVA_WSC + "]").replace(WSC, _JAVA_WSC))
    return "(?U)" + out if out != template else out


def re2_re(template: str) -> str:
    return (template.replace(HWS, "[" + _RE2_HWSC + "]")
            .replace(WS, "[" + _RE2_WSC + "]").replace(WSC, _RE2_WSC))


@dataclass(frozen=True)
class Re:
    """Global regex replacement; ``repl`` uses Java group syntax (``$1``)."""
    pattern: str
    repl: str


@dataclass(frozen=True)
class Lit:
    """Literal (non-regex) replacement of every occurrence."""
    search: str
    repl: str


@dataclass(frozen=True)
class Guard:
    """Run ``steps`` only on values containing ``needle`` (Spark side).

    Pure optimisation: every guarded step is the identity on values without
    the needle, so the SQL twin renders the steps unguarded.
    """
    needle: str
    steps: tuple


def sql_str(value: str) -> str:
    """Quote a Python string as a SQL literal (DuckDB keeps backslashes literal)."""
    return "'" + value.replace("'", "''") + "'"


def _sql_repl(repl: str) -> str:
    out = []
    i = 0
    while i < len(repl):
        ch = repl[i]
        if ch == "$" and i + 1 < len(repl) and repl[i + 1].isdigit():
            out.append("\\" + repl[i + 1])
            i += 2
            continue
        out.append("\\\\" if ch == "\\" else ch)
        i += 1
    return "".join(out)


def apply_chain(col: Column, steps) -> Column:
    for step in steps:
        if isinstance(step, Re):
            col = F.regexp_replace(col, java_re(step.pattern), step.repl)
        elif isinstance(step, Lit):
            col = F.replace(col, F.lit(step.search), F.lit(step.repl))
        else:
            col = let(col, _guarded(step))
    return col


def _guarded(step: Guard):
    def fn(v: Column) -> Column:
        return F.when(v.contains(step.needle), apply_chain(v, step.steps)).otherwise(v)
    return fn


def let(col: Column, fn) -> Column:
    """Evaluate ``col`` once and pass it to ``fn`` as a lambda variable.

    A conditional that names its input twice (test, then branch) would make
    Catalyst evaluate the whole upstream expression twice per guard, which
    compounds along a chain; binding through a one-element ``transform``
    evaluates it exactly once.
    """
    return F.element_at(F.transform(F.array(col), fn), 1)


def chain_sql(expr: str, steps) -> str:
    for step in steps:
        if isinstance(step, Re):
            expr = (f"regexp_replace({expr}, {sql_str(re2_re(step.pattern))}, "
                    f"{sql_str(_sql_repl(step.repl))}, 'g')")
        elif isinstance(step, Lit):
            expr = f"replace({expr}, {sql_str(step.search)}, {sql_str(step.repl)})"
        else:
            expr = chain_sql(expr, step.steps)
    return expr


def rx(col: Column, template: str) -> Column:
    """``rlike`` with a template pattern."""
    return col.rlike(java_re(template))


def rx_extract(col: Column, template: str, group: int) -> Column:
    return F.regexp_extract(col, java_re(template), group)


def rx_sql(expr: str, template: str) -> str:
    return f"regexp_matches({expr}, {sql_str(re2_re(template))})"


def rx_extract_sql(expr: str, template: str, group: int) -> str:
    return f"regexp_extract({expr}, {sql_str(re2_re(template))}, {group})"


def py_strip(col: Column) -> Column:
    """``str.strip()``: trim the Python whitespace set from both ends."""
    return F.trim(col, F.lit(STRIP_CHARS))


def py_strip_sql(expr: str) -> str:
    return f"trim({expr}, {sql_str(STRIP_CHARS)})"


def py_lstrip(col: Column) -> Column:
    return F.ltrim(col, F.lit(STRIP_CHARS))


def py_lstrip_sql(expr: str) -> str:
    return f"ltrim({expr}, {sql_str(STRIP_CHARS)})"
