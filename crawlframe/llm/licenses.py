"""License scans: fuzzy search for short notices.

A notice of a given length may be found with k errors. Cut into k + 1 pieces, at
least one piece must stand in the text as it is (pigeonhole), so one pass of an
Aho-Corasick automaton over all pieces locates every candidate. Only there does
the regex library's bounded-error matching run; it verifies the edits and gives
the span. Texts are compared as words of letters and digits, joined by spaces.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The base phrases with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# Short notices with their labels, as words.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd license", "bsd"),
    ("this program is free software you can redistribute it and or modify it", "gpl"),
    ("licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("licensed under cc by nc", "cc-by-nc"),
    ("licensed under cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
TO_SPACE = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))


@dataclass(frozen=True)
class Rules:
    """One error is allowed for every ``per_error`` characters of a notice."""

    notices: tuple[tuple[str, str], ...] = NOTICES
    per_error: int = 12


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words of digits, letters a-z and all characters beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").lower().translate(TO_SPACE).split() if text else []


def errors_of(notice: str, rules: Rules) -> int:
    return len(notice) // rules.per_error


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): ``errors`` + 1 pieces of nearly equal length."""
    cuts = [len(notice) * k // (errors + 1) for k in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


class Searcher:
    def __init__(self, rules: Rules) -> None:
        self.rules = rules
        seeds: dict[str, list[tuple[int, int]]] = {}
        self.patterns = []
        for at, (notice, _) in enumerate(rules.notices):
            errors = errors_of(notice, rules)
            # Whole words only: the notice stands between spaces, which must match.
            self.patterns.append(regex.compile(rf"(?b)(?<= )(?:{regex.escape(notice, special_only=True)}){{e<={errors}}}(?= )"))
            for offset, piece in pieces(notice, errors):
                seeds.setdefault(piece, []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def regions(self, line: str) -> list[tuple[int, int, int]]:
        """(notice, first, last): merged places where a notice may stand."""
        found = []
        for end, (size, owners) in self.automaton.iter(line):
            for at, offset in owners:
                notice = self.rules.notices[at][0]
                slack = errors_of(notice, self.rules) + 2
                first = end + 1 - size - offset
                found.append((at, max(0, first - slack), first + len(notice) + slack))
        merged: list[list[int]] = []
        for at, first, last in sorted(found):
            if merged and merged[-1][0] == at and first <= merged[-1][2]:
                merged[-1][2] = max(merged[-1][2], last)
            else:
                merged.append([at, first, last])
        return [tuple(m) for m in merged]

    def matches(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, first, last, errors) in a line of words that starts and ends with a space."""
        out = []
        for at, first, last in self.regions(line):
            for m in self.patterns[at].finditer(line, first, min(last, len(line))):
                out.append((at, m.start(), m.end(), sum(m.fuzzy_counts)))
        return out


FOUND = (
    "n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"
)
SPANS = "array<struct<label:string,notice:string,first_word:bigint,last_word:bigint,errors:bigint>>"
KINDS = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64()]
NAMES = [part.split()[0] for part in FOUND.split(", ")]
SPAN_KIND = pa.list_(
    pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int64())])
)


def base_places(line: str, starts: list[int]) -> list[tuple[int, str]]:
    """(word, label) of every place of a base phrase."""
    out = []
    for phrase, label in BASE:
        at = line.find(f" {phrase} ")
        while at >= 0:
            out.append((bisect_right(starts, at + 1) - 1, label))
            at = line.find(f" {phrase} ", at + 1)
    return out


def search(text: str | None, searcher: Searcher) -> tuple:
    words = words_of(text)
    line = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    hits = searcher.matches(line)
    starts: list[int] = []
    if hits or any(f" {phrase} " in line for phrase, _ in BASE):
        at = 1
        for word in words:
            starts.append(at)
            at += len(word.decode("utf-8", "replace")) + 1
    base = base_places(line, starts) if starts else []
    places = [word for word, _ in base]
    labels, spans, score = {label for _, label in base}, [], 1.0 if base else 0.0
    for at, first, last, errors in hits:
        notice, label = searcher.rules.notices[at]
        labels.add(label)
        score = max(score, 1 - errors / len(notice))
        spans.append(
            {
                "label": label, "notice": notice, "errors": errors,
                "first_word": bisect_right(starts, first) - 1, "last_word": bisect_right(starts, max(first, last - 1)) - 1,
            }
        )
    return (
        len(words), len(base), min(places, default=None), max(places, default=None),
        ",".join(sorted({label for _, label in base})), ",".join(sorted(labels)), score, spans,
    )


def license_report(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: base places, labels, a score, and the spans of the notices.

    The score is 1 for an exact notice and less by the share of edited
    characters; 0 without any. A null text counts as empty. Repeated rows are
    searched one by one.
    """

    @F.arrow_udf(f"struct<{FOUND.replace(', ', ',').replace(' ', ':')},notices:{SPANS}>")
    def searched(texts: pa.Array) -> pa.Array:
        searcher = Searcher(rules)
        rows = [search(one, searcher) for one in texts.to_pylist()]
        columns = list(zip(*rows)) or [()] * 8
        arrays = [pa.array(c, k) for c, k in zip(columns, [*KINDS, SPAN_KIND])]
        return pa.StructArray.from_arrays(arrays, names=[*NAMES, "notices"])

    return docs.select(docs[key], searched(docs[text]).alias("_s")).select(key, "_s.*")
