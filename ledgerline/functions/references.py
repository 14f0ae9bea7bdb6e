"""Character references of HTML, named and numeric, as one column expression.

A text is cut into references and what is between them. A name is looked up in a
constant of 256 small maps, told apart by the name's CRC, so a look-up meets about
nine names; the table comes from the standard library when the plan is made. A name
without its semicolon takes the longest beginning that is one of the short list
of names that may stand without it.
"""

from __future__ import annotations

import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.arrays import let

BUCKETS = 256
#: Longest part of a reference after the ampersand.
_NAME = r"[^\t\n\f <&#;]{1,32};?"
PIECES = rf"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|{_NAME})|[^&]+|&"
#: Lengths of the names that may stand without a semicolon.
BARE = sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True)


@cache
def _buckets() -> str:
    out: list[dict[str, str]] = [{} for _ in range(BUCKETS)]
    for name, plain in html5.items():
        out[zlib.crc32(name.encode()) % BUCKETS][name] = plain
    return json.dumps(out)


def _named(name: Column) -> Column:
    table = F.from_json(F.lit(_buckets()), "array<map<string,string>>")
    return F.get(table, (F.crc32(name.cast("binary")) % BUCKETS).cast("int"))[name]


def _code_point(n: Column) -> Column:
    """The text of a code point as references give it: the second half of Latin-1's control range as in Windows' table, nothing for other controls and for points that are no characters."""
    windows = [bytes([b]).decode("cp1252", errors="ignore") or chr(b) for b in range(0x80, 0xA0)]
    text = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    no_character = n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when(n == 0, "�").when(n.between(0x80, 0x9F), F.get(F.array(*map(F.lit, windows)), (n - 0x80).cast("int")))
        .when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(no_character, "").otherwise(text)
    )


def _numbered(digits: Column, base: int, most: int) -> Column:
    """The text of a reference by number; more digits than ``most`` (leading zeros apart) are beyond all code points."""
    bare = F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.lit("0"))
    return F.when(F.char_length(bare) > most, "�").otherwise(_code_point(F.conv(bare, base, 10).cast("long")))


def _plain(piece: Column) -> Column:
    name = F.substring(piece, F.lit(2), F.char_length(piece))
    digits = F.rtrim(name, F.lit(";"))
    begun = [F.when(F.char_length(name) > k, F.concat(_named(F.substring(name, 1, k)), F.substring(name, F.lit(k + 1), F.char_length(name)))) for k in BARE]
    return (
        F.when(~F.startswith(piece, F.lit("&")) | (piece == "&"), piece)
        .when(name.rlike("^#[xX]"), _numbered(F.substring(digits, F.lit(3), F.char_length(digits)), 16, 6))
        .when(F.startswith(name, F.lit("#")), _numbered(F.substring(digits, F.lit(2), F.char_length(digits)), 10, 7))
        .otherwise(F.coalesce(_named(name), *begun, piece))
    )


def unescape(text: Column) -> Column:
    """``text`` with every character reference replaced, once; text without an ampersand is left as it is."""
    pieces = F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, lambda p: let(p, _plain)), "")).otherwise(text)
