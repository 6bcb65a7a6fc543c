"""Helpers for column expressions written as Spark SQL text.

The functions of this package take and return SQL expressions. A long plan
built from them needs one call into the JVM per select, not one per function.
"""

from __future__ import annotations


def text(value: str) -> str:
    """``value`` as a SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def null_text() -> str:
    return "cast(NULL AS string)"
