"""Character references of HTML (&name; and &#number;) resolved as a column expression."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names in use come first: a lookup goes through a map in its order.
FIRST = ("amp;", "nbsp;", "quot;", "lt;", "gt;", "apos;", "rsquo;", "lsquo;", "rdquo;", "ldquo;", "mdash;", "ndash;", "hellip;")
NAMES = {n: html5[n] for n in (*FIRST, *(n for n in html5 if n not in FIRST))}
#: Names that count without a semicolon, and before other letters too, the longest first.
BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))


def _control(n: int) -> str:
    """What the numbers 128 to 159 stand for: the characters that Windows has there."""
    try:
        return bytes([n]).decode("cp1252")
    except UnicodeDecodeError:
        return chr(n)


SPECIAL = {0: "\ufffd", 13: "\r"} | {n: _control(n) for n in range(128, 160)}


def _map(values: dict, kind: str) -> Column:
    """A constant map, folded into one literal."""
    return F.from_json(F.lit(json.dumps({str(k): v for k, v in values.items()})), f"map<{kind},string>")


def _numbered(digits: Column, base: int) -> Column:
    """The character of a number. Surrogates and numbers beyond the last one are U+FFFD; those that no text may hold are nothing."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    n = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("long")).otherwise(F.lit(1 << 40))
    nothing = n.between(1, 8) | n.between(14, 31) | n.between(0xFDD0, 0xFDEF) | (n == 11) | (n == 127) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    special = F.element_at(F.array(*[F.lit(SPECIAL[k]) for k in range(128, 160)]), (n - 127).cast("int"))
    return (
        F.when(n == 0, SPECIAL[0]).when(n == 13, SPECIAL[13]).when(n.between(128, 159), special)
        .when((n > 0x10FFFF) | n.between(0xD800, 0xDFFF), "\ufffd").when(nothing, "").otherwise(char)
    )


def unescape(text: Column) -> Column:
    """The text with its character references resolved once, named (all of HTML, also those that need no semicolon) and numeric; an unknown one stays as it is.

    The text is cut at every `&`; what follows one is a number, a name, or neither. Null stays null. A text without `&` is passed through.
    """
    names = _map(NAMES, "string")

    def piece(p: Column) -> Column:
        number, hexed = F.regexp_extract(p, "^#([0-9]+);?", 1), F.regexp_extract(p, "^#[xX]([0-9a-fA-F]+);?", 1)
        whole = F.regexp_extract(p, r"^[^\t\n\f <&#;]{1,32};", 0)
        bare = F.regexp_extract(p, f"^(?:{'|'.join(BARE)})", 0)
        after = lambda used: F.substr(p, F.length(used) + 1)
        rest = F.regexp_replace(p, "^#[xX]?[0-9a-fA-F]+;?", "")
        decimal = F.regexp_replace(p, "^#[0-9]+;?", "")
        known = F.element_at(names, whole)
        return (
            F.when(number != "", F.concat(_numbered(number, 10), decimal))
            .when(hexed != "", F.concat(_numbered(hexed, 16), rest))
            .when((whole != "") & known.isNotNull(), F.concat(known, after(whole)))
            .when(bare != "", F.concat(F.element_at(names, bare), after(bare)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    parts = F.split(text, "&", -1)
    resolved = F.concat(F.element_at(parts, 1), F.array_join(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), piece), ""))
    return F.when(F.contains(text, F.lit("&")), resolved).otherwise(text)
