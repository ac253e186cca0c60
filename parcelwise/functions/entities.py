"""Character references of HTML in plain column expressions."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

REPLACEMENT = "�"

# Numbers that browsers read as Windows characters, by the rule of the standard.
WINDOWS = {n: bytes([n]).decode("cp1252") for n in range(0x80, 0xA0) if bytes([n]).decode("cp1252", "ignore")}

# Names that count without a semicolon too; a longer name comes before its beginnings.
OPEN_NAMES = sorted((name for name in html5 if not name.endswith(";")), key=len, reverse=True)


def _looked_up(names: dict[str, str], key: Column) -> Column:
    """A constant map, which the optimiser builds once from one literal."""
    return F.element_at(F.from_json(F.lit(json.dumps(names)), "map<string,string>"), key)


def _character(code: Column) -> Column:
    """The character of a code point; what is none becomes the replacement character."""
    wrong = code.isNull() | (code == 0) | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF)
    windows = _looked_up({str(n): c for n, c in WINDOWS.items()}, code.cast("string"))
    named = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    return F.when(wrong, REPLACEMENT).when(code.between(0x80, 0x9F), F.coalesce(windows, named)).otherwise(named)


def _decoded(part: Column) -> Column:
    """The text behind an ampersand, with the reference it starts with resolved."""
    decimal, hexadecimal = F.regexp_extract(part, "^#0*([0-9]+);?", 1), F.regexp_extract(part, "^#[xX]0*([0-9a-fA-F]+);?", 1)
    closed, open_ = F.regexp_extract(part, "^([0-9A-Za-z]+;)", 1), F.regexp_extract(part, f"^({'|'.join(OPEN_NAMES)})", 1)

    def number(digits: Column, base: int) -> Column:
        # More digits than any code point has would overflow.
        return F.when(F.length(digits) <= 8, F.conv(digits, base, 10).cast("long"))

    def rest(pattern: str) -> Column:
        return F.regexp_replace(part, pattern, "")

    def behind(name: Column) -> Column:
        return F.substr(part, F.length(name) + 1)

    names = {name: text for name, text in html5.items() if name.endswith(";")}
    short = {name: html5[name] for name in OPEN_NAMES}
    by_name = _looked_up(names, closed)
    return (
        F.when(decimal != "", F.concat(_character(number(decimal, 10)), rest("^#[0-9]+;?")))
        .when(hexadecimal != "", F.concat(_character(number(hexadecimal, 16)), rest("^#[xX][0-9a-fA-F]+;?")))
        .when((closed != "") & by_name.isNotNull(), F.concat(by_name, behind(closed)))
        .when(open_ != "", F.concat(_looked_up(short, open_), behind(open_)))
        .otherwise(F.concat(F.lit("&"), part))
    )


def decoded_entities(text: Column) -> Column:
    """``text`` with every character reference resolved: numbers of any code point, and all names of HTML.

    As browsers do, a number may lack its semicolon, some names too; what is no reference stays as it is.
    """
    parts = F.split(text, "&", -1)
    first, others = F.get(parts, F.lit(0)), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.concat(first, F.array_join(F.transform(others, _decoded), ""))
