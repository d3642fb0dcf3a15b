"""Character references of HTML, decoded in one pass as a column expression."""

from __future__ import annotations

import json
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What may follow an ampersand: a decimal or hexadecimal number, or up to 32 characters of a name, each with or without its semicolon.
_REFERENCE = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: Numbers above which there is no character, between which there are only halves of one, and of a range that stands for the characters of an older code.
_LAST, _HALVES, _OLD = 0x10FFFF, (0xD800, 0xDFFF), (0x80, 0x9F)


@lru_cache(maxsize=1)
def _names() -> str:
    """The standard's names by first letter, as JSON."""
    by: dict[str, dict[str, str]] = {}
    for name, chars in html5.items():
        by.setdefault(name[0], {})[name] = chars
    return json.dumps(by)


@lru_cache(maxsize=1)
def _open_lengths() -> tuple[int, ...]:
    """Lengths of the names that need no semicolon, the longest first."""
    return tuple(sorted({len(n) for n in html5 if not n.endswith(";")}, reverse=True))


def _older(n: int) -> str:
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


def _named(name: Column) -> Column:
    """The characters of a name, else of its longest beginning that needs no semicolon, with what is left of it; else the name after its ampersand."""
    known = F.from_json(F.lit(_names()), "map<string, map<string, string>>")
    of = lambda s: F.try_element_at(F.try_element_at(known, F.substring(s, 1, 1)), s)
    begun = [F.when(F.length(name) > k, F.concat(of(F.substring(name, 1, k)), F.substr(name, F.lit(k + 1)))) for k in _open_lengths()]
    return F.coalesce(of(name), *begun, F.concat(F.lit("&"), name))


def _numbered(reference: Column) -> Column:
    """The character of a number: none for what no text may hold, a replacement for what is no character."""
    digits = F.regexp_extract(reference, "^#[xX]?([0-9a-fA-F]+);?$", 1)
    digits = F.regexp_replace(digits, "^0+(?=.)", "")
    number = F.when(F.substring(reference, 2, 1).isin("x", "X"), F.conv(digits, 16, 10)).otherwise(digits).cast("long")
    return F.get(F.transform(F.array(F.when(F.length(digits) > 9, _LAST + 1).otherwise(number)), _character), F.lit(0))


def _character(n: Column) -> Column:
    old = F.get(F.array(*[F.lit(_older(i)) for i in range(_OLD[0], _OLD[1] + 1)]), (n - _OLD[0]).cast("int"))
    barred = n.between(0x1, 0x8) | n.between(0xE, 0x1F) | (n == 0xB) | n.between(0x7F, 0x9F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")  # its four bytes, the highest first
    return F.when((n == 0) | n.between(*_HALVES) | (n > _LAST), "\ufffd").when(n.between(*_OLD), old).when(n == 0xD, "\r").when(barred, "").otherwise(plain)


def unescape(c: Column) -> Column:
    """The text with every character reference replaced, as the HTML standard reads it outside attributes; each place is read once, so what comes out is never read again."""
    parts = F.split(c, "&")

    def one(part: Column) -> Column:
        found = F.regexp_extract(part, _REFERENCE, 1)
        value = F.when(found == "", "&").when(found.startswith("#"), _numbered(found)).otherwise(_named(found))
        return F.concat(value, F.substr(part, F.length(found) + 1))

    decoded = F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), one), ""))
    return F.when(c.contains("&"), decoded).otherwise(c)


#: The references that pages are written with; the ampersand last, so that what comes out is never read again.
COMMON = {"nbsp": "\xa0", "lt": "<", "gt": ">", "quot": '"', "copy": "©", "middot": "·", "amp": "&"}


def unescape_common(c: Column) -> Column:
    """The text with the common named references replaced, where they end in a semicolon; all others stay as they are."""
    for name, char in COMMON.items():
        c = F.replace(c, F.lit(f"&{name};"), F.lit(char))
    return c
