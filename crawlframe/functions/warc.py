"""SQL expressions for WARC 1.1 response records."""

from __future__ import annotations

from crawlframe.functions.sql import text

# Reason phrases of the registered HTTP status codes.
REASONS = {
    100: "Continue", 101: "Switching Protocols", 102: "Processing",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non Authoritative Information",
    204: "No Content", 205: "Reset Content", 206: "Partial Content", 207: "Multi-Status",
    208: "Already Reported", 226: "IM Used",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other",
    304: "Not Modified", 305: "Use Proxy", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden",
    404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable",
    407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone",
    411: "Length Required", 412: "Precondition Failed", 413: "Payload Too Large",
    414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable",
    417: "Expectation Failed", 418: "I'm a teapot", 421: "Misdirected Request",
    422: "Unprocessable Entity", 423: "Locked", 424: "Failed Dependency",
    426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway",
    503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported",
    506: "Variant Also Negotiates", 507: "Insufficient Storage", 508: "Loop Detected",
    510: "Not Extended", 511: "Network Authentication Required",
}
UNKNOWN_REASON = "<unknown status code>"


def status_line(version: str, status: str) -> str:
    cases = " ".join(f"WHEN {code} THEN {text(reason)}" for code, reason in REASONS.items())
    return (
        f"concat({version}, ' ', {status}, ' ',"
        f" CASE {status} {cases} ELSE {text(UNKNOWN_REASON)} END, '\\r\\n')"
    )


def header_block(headers: str) -> str:
    """Headers as received, in order, names repeated where they repeat."""
    lines = f"transform({headers}, h -> concat(h.name, ': ', h.value, '\\r\\n'))"
    return f"concat(array_join(coalesce({lines}, array()), ''), '\\r\\n')"


def warc_date(start: str) -> str:
    """RFC 3339 in UTC, whole seconds; truncates."""
    moment = f"to_utc_timestamp({start}, current_timezone())"
    return f"date_format({moment}, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def record_head(record_id: str, uri: str, length: str, date: str) -> str:
    """The WARC header block, up to and with its empty line."""
    start = (
        "WARC/1.1\r\nWARC-Type: response\r\n"
        "Content-Type: application/http; msgtype=response\r\nWARC-Record-ID: "
    )
    return f"""concat({text(start)}, {record_id}, '\\r\\nWARC-Target-URI: ', {uri},
        '\\r\\nContent-Length: ', {length}, '\\r\\nWARC-Date: ', {date}, '\\r\\n\\r\\n')"""
