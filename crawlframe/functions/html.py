"""Anchor scanning with one regular expression that follows HTML tokenisation.

Every quantifier is possessive or lazy over single characters, so matching
neither recurses nor backtracks on long documents. A tag that never ends takes
the rest of the document, as the HTML standard has it, so no part is scanned
again and again.
"""

from __future__ import annotations

import html.entities
import json

from crawlframe.functions.sql import text

WS = r"\t\n\f\r "
GAP = rf"[{WS}/]++"
NAME_END = rf"(?=[{WS}/>=]|\z)"
VALUE = rf"""(?:"[^"]*+"|'[^']*+'|[^{WS}>"'][^{WS}>]*+|(?=>|\z))"""
ASSIGN = rf"(?:[{WS}]*+=[{WS}]*+{VALUE}|(?![{WS}]*+=))"
ATTRIBUTE = rf"[^{WS}/>][^{WS}/>=]*+{ASSIGN}"

# Elements whose content is text, so tags in it do not count.
RAW_TEXT = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"


def _other_than(name: str) -> str:
    return rf"(?:{GAP}|(?!{name}{NAME_END}){ATTRIBUTE})*+"


ANY_ATTRIBUTES = rf"(?:{GAP}|{ATTRIBUTE})*+"
ANCHOR = rf"a(?=[{WS}/>])({_other_than('href')}href{NAME_END}{ASSIGN}{ANY_ATTRIBUTES})>"
TOKEN = (
    r"(?is)<(?:"
    rf"{ANCHOR}"
    r"|!--(?:-?>|.*?(?:--!?>|\z))"
    r"|[!?][^>]*+(?:>|\z)"
    r"|/[^a-z>][^>]*+(?:>|\z)"
    rf"|({RAW_TEXT})(?=[{WS}/>]){ANY_ATTRIBUTES}>.*?(?:</\2(?=[{WS}/>])|\z)"
    rf"|/?[a-z][^{WS}/>]*+{ANY_ATTRIBUTES}>"
    r"|/?[a-z].*)"
)
ANCHOR_GROUP = 1


def anchor_attributes(document: str) -> str:
    """Attribute text of every ``<a>`` that has an href, in document order."""
    found = f"regexp_extract_all({document}, {text(TOKEN)}, {ANCHOR_GROUP})"
    return f"filter({found}, a -> a <> '')"


def attribute(attributes: str, name: str) -> str:
    """Undecoded value of the first attribute of that name, NULL where there is none."""
    before = rf"(?is)^{_other_than(name)}{name}{NAME_END}"
    value = rf"""(?:"([^"]*+)"|'([^']*+)'|([^{WS}>"'][^{WS}>]*+)|\z)"""
    whole = rf"{before}(?:[{WS}]*+=[{WS}]*+{value})?+.*$"
    return f"""CASE WHEN {attributes} RLIKE {text(before)}
        THEN regexp_replace({attributes}, {text(whole)}, '$1$2$3') END"""


# What the HTML standard makes of the numbers 128 to 159.
WINDOWS_1252 = {
    0x80: 0x20AC, 0x82: 0x201A, 0x83: 0x0192, 0x84: 0x201E, 0x85: 0x2026, 0x86: 0x2020,
    0x87: 0x2021, 0x88: 0x02C6, 0x89: 0x2030, 0x8A: 0x0160, 0x8B: 0x2039, 0x8C: 0x0152,
    0x8E: 0x017D, 0x91: 0x2018, 0x92: 0x2019, 0x93: 0x201C, 0x94: 0x201D, 0x95: 0x2022,
    0x96: 0x2013, 0x97: 0x2014, 0x98: 0x02DC, 0x99: 0x2122, 0x9A: 0x0161, 0x9B: 0x203A,
    0x9C: 0x0153, 0x9E: 0x017E, 0x9F: 0x0178,
}

REFERENCE = r"&#[0-9]+;?|&#[xX][0-9a-fA-F]+;?|&[0-9A-Za-z]+;|&[0-9A-Za-z]+(?![0-9A-Za-z=;])|&|[^&]+"


def _named_reference(token: str) -> str:
    """Named references come from Python's own table of the HTML standard."""
    table = json.dumps({"&" + k: v for k, v in html.entities.html5.items()}, ensure_ascii=True)
    return f"""CASE {token} WHEN '&amp;' THEN '&' WHEN '&quot;' THEN '"'
        ELSE coalesce(try_element_at(from_json({text(table)}, 'map<string,string>'), {token}), {token})
        END"""


def _code_point(number: str) -> str:
    windows = text(json.dumps(WINDOWS_1252))
    return f"""decode(unhex(lpad(hex(CASE
        WHEN {number} IS NULL OR {number} = 0 OR {number} > 1114111
             OR {number} BETWEEN 55296 AND 57343 THEN 65533L
        WHEN {number} BETWEEN 128 AND 159 THEN coalesce(try_element_at(
             from_json({windows}, 'map<string,bigint>'), cast({number} AS string)), {number})
        ELSE {number} END), 8, '0')), 'UTF-32')"""


def _decode_token(token: str) -> str:
    decimal = text("^&#0*([0-9]{1,8});?$")
    hexadecimal = text("^&#[xX]0*([0-9a-fA-F]{1,7});?$")
    number = f"""try_cast(CASE WHEN {token} RLIKE '^&#[xX]'
        THEN conv(regexp_extract({token}, {hexadecimal}, 1), 16, 10)
        ELSE regexp_extract({token}, {decimal}, 1) END AS bigint)"""
    return f"""CASE WHEN NOT startswith({token}, '&') THEN {token}
        WHEN startswith({token}, '&#')
        THEN transform(array({number}), n -> {_code_point('n')})[0]
        ELSE {_named_reference(token)} END"""


def decode_references(value: str) -> str:
    """Decode character references once, left to right, by the attribute rules."""
    tokens = f"regexp_extract_all({value}, {text(REFERENCE)}, 0)"
    return f"""CASE WHEN contains({value}, '&')
        THEN array_join(transform({tokens}, t -> {_decode_token('t')}), '')
        ELSE {value} END"""
