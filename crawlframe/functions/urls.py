"""SQL expressions on URL pieces."""

from __future__ import annotations

from crawlframe.functions.sql import text

# The characters that the URL standard percent-encodes in a path,
# in a query of a special scheme, and in user information. As regular-expression
# classes they list single characters, which match far faster than many ranges.
PATH_UNSAFE = r'\x00-\x20"<>`{}\x7F-\x{10FFFF}'
QUERY_UNSAFE = r"""\x00-\x20"#<>'\x7F-\x{10FFFF}"""
USERINFO_UNSAFE = r'\x00-\x20"#<>?`{}/:;=@\[\\\]^|\x7F-\x{10FFFF}'

# Code points that no host may hold.
HOST_FORBIDDEN = r'[\x00-\x20"#%/:<>?@\[\\\]^`{|}\x7F]'

# Letters that older rules replace and newer ones keep.
DEVIATING = r"[\u00DF\u03C2\u200C\u200D]"

# Parameters of Punycode (RFC 3492).
PUNY_BASE, PUNY_LOW, PUNY_HIGH, PUNY_SKEW, PUNY_DAMP = 36, 1, 26, 38, 700
PUNY_BIAS, PUNY_FIRST = 72, 128

# Fixed value: a link must be shorter than this, as sitemaps have it.
URL_LIMIT = 2048

BLANK = r"[\x00-\x20]"
OUTER_BLANK = r"^[\x00-\x20]+|[\x00-\x20]+$|[\t\n\r]"
SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
HOST_OF_PAIR = r"^(\[[^\]]*\]|[^:]*)(?::[0-9]*)?$"
PORT_OF_PAIR = r"^(?:\[[^\]]*\]|[^:]*):0*([0-9]+)$"
NUMBER_LABEL = r"^(?:[0-9]+|0x[0-9a-f]*)$"
BRACKETED = r"^\[[0-9a-f:.]*:[0-9a-f:.]*\]$"
DOT_SEGMENT = r"(?i)/(?:\.|%2e){1,2}(?:/|$)"
ONE_DOT = r"(?i)^(?:\.|%2e)$"
TWO_DOTS = r"(?i)^(?:\.|%2e){2}$"


def clean(raw: str) -> str:
    """Drop outer control characters and spaces, and tabs and line ends anywhere."""
    return f"""CASE WHEN {raw} RLIKE {text(BLANK)}
        THEN regexp_replace({raw}, {text(OUTER_BLANK)}, '') ELSE {raw} END"""


def ends_in_number(host: str) -> str:
    """Whether the last label is a number, which makes the host an IPv4 address."""
    label = f"substring_index(regexp_replace({host}, '\\\\.$', ''), '.', -1)"
    plain = f"substring_index({host}, '.', -1)"
    return f"""(CASE WHEN endswith({host}, '.') THEN {label} ELSE {plain} END
        RLIKE {text(NUMBER_LABEL)})"""


def not_ascii(host: str) -> str:
    """Whether a text has characters that take more than one byte."""
    return f"(octet_length({host}) <> length({host}))"


def punycoded(host: str) -> str:
    """The ASCII form of an international host name, NULL where it has none.

    Java's own converter does it, also for characters that came after the
    standard it follows. It is called for the hosts that need it alone. The
    letters that the newer rules keep apart (``DEVIATING``) get their own form.
    """
    java = f"lower(try_reflect('java.net.IDN', 'toASCII', {host}, 1))"
    return f"CASE WHEN {host} RLIKE {text(DEVIATING)} THEN {own_punycode(host)} ELSE {java} END"


def own_punycode(host: str) -> str:
    """ASCII form of a host whose labels are normalised but for lower case, label by label."""
    label = f"CASE WHEN {not_ascii('l')} THEN concat('xn--', {punycode('l')}) ELSE l END"
    labels = f"transform(split(normalized, '[.\\u3002\\uFF0E\\uFF61]'), l -> {label})"
    whole = f"array_join({labels}, '.')"
    fits = f"NOT exists({labels}, l -> length(l) > 63)"
    return f"transform(array({host}), normalized -> CASE WHEN {fits} THEN {whole} END)[0]"


def punycode(label: str) -> str:
    """Punycode of a text: its ASCII letters, then each other one as a distance in base 36.

    One fold over the distinct larger code points in ascending order, and in it
    one over the letters; a distance is at most seven digits.
    """
    code = "cast(conv(hex(encode(c, 'UTF-32')), 16, 10) AS bigint)"
    codes = f"transform(filter(split({label}, ''), c -> c <> ''), c -> {code})"
    plain = f"array_join(transform(filter({codes}, c -> c < {PUNY_FIRST}), c -> chr(c)), '')"
    digit = "substr('abcdefghijklmnopqrstuvwxyz0123456789', cast(d + 1 AS int), 1)"
    # The digits of a distance: the threshold grows with the place.
    step = f"""transform(array(least(greatest({PUNY_BASE} * k - s.bias, {PUNY_LOW}), {PUNY_HIGH})), t ->
        CASE WHEN v.done THEN v
             WHEN v.q < t THEN named_struct('q', 0L, 'text', concat(v.text, transform(array(v.q), d -> {digit})[0]), 'done', true)
             ELSE named_struct('q', (v.q - t) DIV ({PUNY_BASE} - t),
                 'text', concat(v.text, transform(array(t + (v.q - t) % ({PUNY_BASE} - t)), d -> {digit})[0]), 'done', false) END)[0]"""
    number = f"""aggregate(sequence(1, 7), named_struct('q', cast(s.delta AS bigint), 'text', '', 'done', false),
        (v, k) -> named_struct('q', cast({step}.q AS bigint), 'text', {step}.text, 'done', {step}.done), v -> v.text)"""
    scaled = f"(s.delta DIV CASE WHEN s.first THEN {PUNY_DAMP} ELSE 2 END)"
    spread = f"({scaled} + {scaled} DIV (s.seen + 1))"
    high = (PUNY_BASE - PUNY_LOW) * PUNY_HIGH // 2
    # How often the spread is divided until it is small: at most four times.
    adapted = f"""aggregate(sequence(1, 4), named_struct('x', cast({spread} AS bigint), 'k', 0L), (a, i) ->
        CASE WHEN a.x > {high} THEN named_struct('x', a.x DIV {PUNY_BASE - PUNY_LOW}, 'k', a.k + {PUNY_BASE}) ELSE a END,
        a -> a.k + ({PUNY_BASE - PUNY_LOW + 1} * a.x) DIV (a.x + {PUNY_SKEW}))"""
    state = "'text', {0}, 'delta', cast({1} AS bigint), 'bias', cast({2} AS bigint), 'seen', cast({3} AS bigint), 'first', {4}, 'n', cast({5} AS bigint)"
    hit = f"named_struct({state.format(f'concat(s.text, {number})', '0L', adapted, 's.seen + 1', 'false', 's.n')})"
    letter = f"""CASE WHEN c < m THEN named_struct({state.format('s.text', 's.delta + 1', 's.bias', 's.seen', 's.first', 's.n')})
        WHEN c = m THEN {hit} ELSE s END"""
    before = state.format("o.text", "o.delta + (m - o.n) * (o.seen + 1)", "o.bias", "o.seen", "o.first", "m")
    after = state.format("e.text", "e.delta + 1", "e.bias", "e.seen", "e.first", "m + 1")
    round_ = f"transform(array(aggregate(codes, named_struct({before}), (s, c) -> {letter})), e -> named_struct({after}))[0]"
    larger = f"array_sort(array_distinct(filter(codes, c -> c >= {PUNY_FIRST})))"
    count = f"size(filter(codes, c -> c < {PUNY_FIRST}))"
    start = state.format("CASE WHEN plain = '' THEN '' ELSE concat(plain, '-') END", "0", PUNY_BIAS, count, "true", PUNY_FIRST)
    fold = f"aggregate({larger}, named_struct({start}), (o, m) -> {round_}, o -> o.text)"
    return f"transform(array({plain}), plain -> transform(array({codes}), codes -> {fold})[0])[0]"


def percent_encode(value: str, unsafe: str) -> str:
    """Write every character of the class ``unsafe`` as the %XX of its UTF-8 bytes."""
    some, start = text(f"[{unsafe}]"), text(f"^[{unsafe}]")
    runs = text(f"[{unsafe}]+|[^{unsafe}]+")
    return f"""CASE WHEN {value} RLIKE {some} THEN array_join(transform(
        regexp_extract_all({value}, {runs}, 0),
        p -> CASE WHEN p RLIKE {start}
                  THEN regexp_replace(hex(encode(p, 'UTF-8')), '(..)', '%$1') ELSE p END), '')
        ELSE {value} END"""


def remove_dot_segments(path: str) -> str:
    """Resolve ``.`` and ``..`` in an absolute path, also when written %2e."""
    parts = f"split(substr({path}, 2), '/')"
    dot = f"element_at({parts}, -1) RLIKE {text(ONE_DOT)}"
    dots = f"element_at({parts}, -1) RLIKE {text(TWO_DOTS)}"
    return f"""CASE WHEN {path} RLIKE {text(DOT_SEGMENT)} THEN concat('/', array_join(concat(
        aggregate({parts}, cast(array() AS array<string>), (acc, p) -> CASE
            WHEN p RLIKE {text(TWO_DOTS)} THEN slice(acc, 1, greatest(size(acc) - 1, 0))
            WHEN p RLIKE {text(ONE_DOT)} THEN acc
            ELSE concat(acc, array(p)) END),
        CASE WHEN {dot} OR {dots} THEN array('') ELSE cast(array() AS array<string>) END), '/'))
        ELSE {path} END"""


def ipv4_number(part: str) -> str:
    """One part of an IPv4 host: hexadecimal, octal or decimal; NULL if neither."""
    return f"""cast(CASE WHEN {part} RLIKE '^0[xX]$' THEN '0'
        WHEN {part} RLIKE '^0[xX][0-9a-fA-F]{{1,12}}$' THEN conv(substr({part}, 3), 16, 10)
        WHEN {part} RLIKE '^0[0-7]{{1,14}}$' THEN conv({part}, 8, 10)
        WHEN {part} RLIKE '^(?:0|[1-9][0-9]{{0,12}})$' THEN {part} END AS bigint)"""


def ipv4_text(host: str) -> str:
    """Dotted form of a host that ends in a number; NULL where it is no address."""
    numbers = f"transform(split(regexp_replace({host}, '\\\\.$', ''), '\\\\.'), n -> {ipv4_number('n')})"
    value = f"""aggregate({numbers}, named_struct('i', 0, 'v', 0L), (s, n) -> named_struct(
        'i', s.i + 1,
        'v', CASE WHEN n IS NULL OR s.v IS NULL OR s.i > 3 THEN NULL
                  WHEN s.i = size({numbers}) - 1 AND n < shiftleft(1L, 8 * (4 - s.i)) THEN s.v + n
                  WHEN s.i < size({numbers}) - 1 AND n <= 255 THEN s.v + shiftleft(n, 8 * (3 - s.i))
             END), s -> s.v)"""
    octets = ", ".join(f"cast(shiftright(v, {shift}) & 255 AS string)" for shift in (24, 16, 8, 0))
    return f"transform(array({value}), v -> CASE WHEN v IS NOT NULL THEN concat_ws('.', {octets}) END)[0]"


def is_http(scheme: str) -> str:
    return f"{scheme} IN ('http', 'https')"


def is_domain_root(authority: str, path: str, query: str) -> str:
    """The main page of a site; the fragment does not matter."""
    return f"({authority} <> '' AND {path} IN ('', '/') AND {query} IS NULL)"


def with_path_only(scheme: str, authority: str, path: str) -> str:
    """A well-known URL of the same scheme and authority."""
    return f"concat({scheme}, '://', {authority}, {text('/' + path)})"


def target(path: str, query: str) -> str:
    """Path and query as one value; an empty query differs from no query."""
    return f"concat({path}, coalesce(concat('?', {query}), ''))"


def stored_url(domain: str, path: str, query: str) -> str:
    """The URL that a frontier row stands for: always https, no port, no fragment."""
    return f"concat('https://', {domain}, {target(path, query)})"


def frontier_key(name: str, path: str, query: str) -> str:
    """128 bits that stand for a frontier row; no query and an empty one differ, and it is never NULL."""
    return f"unhex(md5(to_json(named_struct('n', {name}, 'p', {path}, 'q', {query}))))"


def archive_key(u: str, raw: str) -> str:
    """Reversed host, path and query of a parsed URL; what cannot be parsed stands for itself, after all hosts."""
    host = f"coalesce(array_join(reverse(split({u}.domain, '\\\\.')), ','), regexp_replace({u}.authority, '^.*@|:[0-9]*$', ''))"
    return f"CASE WHEN {u}.error IS NULL THEN concat({host}, ')', {target(f'{u}.path', f'{u}.query')}) ELSE concat('~', {raw}) END"
