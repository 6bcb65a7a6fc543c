"""SQL expressions on fetched bodies and on time."""

from __future__ import annotations


def body_text(body: str) -> str:
    """A body as text; bytes that are not UTF-8 become the replacement character."""
    return f"make_valid_utf8(cast({body} AS string))"


def age_seconds(since: str, now: str) -> str:
    """Whole seconds from ``since`` to ``now``; a time to come counts as 1."""
    gap = f"(unix_micros({now}) - unix_micros({since}))"
    return f"CASE WHEN {gap} < 0 THEN 1L ELSE {gap} DIV 1000000 END"


def older_than(since: str, now: str, seconds: int) -> str:
    return f"({age_seconds(since, now)} > {seconds})"
