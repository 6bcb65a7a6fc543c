"""robots.txt (RFC 9309) as SQL expressions over one body: no explode, no shuffle."""

from __future__ import annotations

from crawlframe.functions.sql import text
from crawlframe.functions.urls import percent_encode

RULES_TYPE = "array<struct<rx:string,len:int,allow:boolean,prefix:string,wild:boolean>>"
RETRY_SECONDS = 84000

COMMENT = r"#[^\r\n]*|^\x{FEFF}"
RULE_LINE = r"(?im)^[ \t]*(?:user-agent|allow|disallow)[ \t]*:[^\r\n]*"
SITEMAP_LINE = r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*([^\r\n]*)"
GROUP = r"(?:u:[^\n]*+\n)++(?:[ad]:[^\n]*+\n)*+"
META = r"([\\^$.|?*+()\[\]{}])"
PATTERN_UNSAFE = r"\x00-\x20\x7F-\x{10FFFF}"


def access(status: str) -> str:
    """What a robots.txt status means; anything but 200 and 4xx is unreachable."""
    return f"""CASE WHEN {status} = 200 THEN 'Ok'
        WHEN {status} BETWEEN 400 AND 499 THEN 'Unavailable' ELSE 'Unreachable' END"""


def plain_lines(body: str) -> str:
    """Rule lines only, one per line, as ``u:agent``, ``a:pattern`` or ``d:pattern``."""
    lines = f"regexp_extract_all(regexp_replace({body}, {text(COMMENT)}, ''), {text(RULE_LINE)}, 0)"
    kind = "lower(left(trim(BOTH ' \\t' FROM l), 1))"
    value = "trim(BOTH ' \\t' FROM substr(l, instr(l, ':') + 1))"
    line = f"concat({kind}, ':', CASE WHEN {kind} = 'u' THEN lower({value}) ELSE {value} END, '\\n')"
    return f"array_join(transform({lines}, l -> {line}), '')"


def group_score(bot: str) -> str:
    """2 if group ``g`` names the bot, 1 if it is for everyone, else 0."""
    mine, everyone = text(f"\nu:{bot.lower()}\n"), text("\nu:*\n")
    return f"""CASE WHEN contains(concat('\\n', g), {mine}) THEN 2
        WHEN contains(concat('\\n', g), {everyone}) THEN 1 ELSE 0 END"""


def rule_lines(lines: str, bot: str) -> str:
    """Non-empty rule lines of the groups that apply to ``bot``, merged in order."""
    groups = f"regexp_extract_all({lines}, {text(GROUP)}, 0)"
    scored = f"transform({groups}, g -> named_struct('g', g, 'score', {group_score(bot)}))"
    return f"""transform(array({scored}), s -> flatten(transform(
        filter(s, x -> x.score > 0 AND x.score = array_max(transform(s, y -> y.score))),
        x -> filter(split(x.g, '\\n'), l -> l RLIKE '^[ad]:.'))))[0]"""


def rule(line: str) -> str:
    """One rule line as a struct.

    ``prefix`` is the fixed start of the pattern; only patterns with ``*`` or a
    final ``$`` are ``wild`` and need ``rx``. Each ``*`` takes the first place
    where the next piece fits and never looks back, so matching is linear.
    """
    pieces = (
        f"transform(split(regexp_replace(p, '\\\\$$', ''), '\\\\*'),"
        f" e -> regexp_replace(e, {text(META)}, {text(chr(92) * 2 + '$1')}))"
    )
    rx = f"""transform(array({pieces}), q -> concat('^', array_join(transform(q, (e, i) -> CASE
        WHEN i = 0 THEN e
        WHEN i = size(q) - 1 AND p LIKE '%$' THEN concat('.*', e)
        ELSE concat('(?>.*?', e, ')') END), ''),
        CASE WHEN p LIKE '%$' THEN '\\\\z' ELSE '' END))[0]"""
    fields = f"""named_struct('rx', {rx}, 'len', length(p), 'allow', startswith({line}, 'a'),
        'prefix', regexp_extract(p, '^([^*]*?)(?:\\\\*|\\\\$$|$)', 1),
        'wild', p RLIKE '\\\\*|\\\\$$')"""
    pattern = percent_encode(f"substr({line}, 3)", PATTERN_UNSAFE)
    return f"transform(array({pattern}), p -> {fields})[0]"


def rules(lines: str, bot: str) -> str:
    return f"transform({rule_lines(lines, bot)}, l -> {rule('l')})"


def sitemaps(body: str) -> str:
    """Values of the Sitemap lines, which belong to no group."""
    found = f"regexp_extract_all(regexp_replace({body}, {text(COMMENT)}, ''), {text(SITEMAP_LINE)}, 1)"
    return f"filter(transform({found}, v -> trim(BOTH ' \\t' FROM v)), v -> v <> '')"


def allowed(rule_array: str, path_query: str) -> str:
    """Longest matching pattern wins, allow wins a tie, no match allows."""
    hits = f"""filter({rule_array}, r -> startswith({path_query}, r.prefix)
        AND (NOT r.wild OR {path_query} RLIKE r.rx))"""
    best = f"array_max(transform({hits}, r -> named_struct('len', r.len, 'allow', r.allow)))"
    return f"({path_query} = '/robots.txt' OR coalesce({best}.allow, true))"


def decision(access_column: str, rule_array: str, path_query: str) -> str:
    """Allowed, Disallowed or Retry; no robots.txt seen yet is Retry."""
    return f"""CASE WHEN {access_column} = 'Unavailable' THEN 'Allowed'
        WHEN {access_column} = 'Ok' THEN
            CASE WHEN {allowed(rule_array, path_query)} THEN 'Allowed' ELSE 'Disallowed' END
        ELSE 'Retry' END"""


def retry_seconds(access_column: str, decision_column: str) -> str:
    """84,000 s after an unreachable robots.txt, 0 where it was never fetched."""
    return f"""CASE WHEN {decision_column} = 'Retry' THEN
        CASE WHEN {access_column} IS NULL THEN 0 ELSE {RETRY_SECONDS} END END"""
