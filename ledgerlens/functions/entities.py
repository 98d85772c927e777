"""Character references in full, as column expressions (the rule of HTML 5).

References after which a text differs from the short table of ``html.ENTITIES``
are decoded here: every public name, decimal and hexadecimal numbers with the
Windows-1252 meaning of 128-159, names of the old form without a semicolon.
The names come from Python's standard library when the plan is built; nothing
is transcribed. The text is cut at its ampersands and each piece decodes its
own reference once, so nothing is decoded twice.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .regexkit import let

_OLD = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
OLD_NAME = "^(" + "|".join(_OLD) + ")"
NAME = r"^([^\t\n\f <&#;]{1,32};)"
DECIMAL = "^#0*([0-9]+);?"
HEX = "^#[xX]0*([0-9a-fA-F]+);?"


def windows_1252() -> dict[int, int]:
    """What the code points 128-159 stand for, where that is defined."""
    out = {}
    for b in range(128, 160):
        try:
            out[b] = ord(bytes([b]).decode("cp1252"))
        except UnicodeDecodeError:
            pass
    return out


def unknown_reference(known: tuple[str, ...]) -> str:
    """Pattern of an ampersand that may begin a reference which is not in ``known`` (``&lt;`` and so on)."""
    return "&(?!(?:" + "|".join(k[1:-1] for k in known) + ");)(?:#[0-9xX]|[A-Za-z])"


def _char(code: Column) -> Column:
    """The character of a code point, with the exceptions of HTML 5."""
    moved = F.create_map(*[F.lit(x) for kv in windows_1252().items() for x in kv])
    code = F.coalesce(moved[code.cast("int")].cast("bigint"), code)
    bad = (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    none = (code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF) | ((code % 0x10000) >= 0xFFFE))
    # 128-159 without another meaning stay as they are
    utf32 = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(bad, F.lit("\ufffd")).when(none, F.lit("")).otherwise(utf32)


def _number(digits: Column, base: int) -> Column:
    """The value of a run of digits without leading zeros; beyond Unicode when it is long."""
    return F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.conv(digits, base, 10).cast("bigint")).cast("bigint")


def _piece(piece: Column, names: Column) -> Column:
    """The text after an ampersand, with the ampersand or what its reference stands for."""
    dec, hexa = F.regexp_extract(piece, DECIMAL, 1), F.regexp_extract(piece, HEX, 1)
    name, old = F.regexp_extract(piece, NAME, 1), F.regexp_extract(piece, OLD_NAME, 1)
    number = F.when(dec != "", _number(dec, 10)).when(hexa != "", _number(hexa, 16))
    rest = F.regexp_replace(piece, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", "")
    named = names[name]
    return (F.when(number.isNotNull(), F.concat(let(number, _char), rest))
            .when(named.isNotNull(), F.concat(named, F.substring(piece, F.length(name) + 1, F.length(piece))))
            .when(old != "", F.concat(names[old], F.substring(piece, F.length(old) + 1, F.length(piece))))
            .otherwise(F.concat(F.lit("&"), piece)))


def unescape(col: Column) -> Column:
    """Every reference of a text decoded once."""
    names = F.from_json(F.lit(json.dumps(html5)), "map<string,string>")
    pieces = F.split(col, "&")
    rest = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: _piece(p, names))
    return F.concat(F.get(pieces, F.lit(0)), F.array_join(rest, ""))
