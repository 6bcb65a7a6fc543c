"""Quality rules by compression bands.

A text is judged by the zstandard ratio (compressed bytes over raw bytes) of the
whole document and of fixed chunks. Repetitive text compresses too well, noise
too badly; what is normal depends on the length, so every length has its own
limits. No shuffle: the verdict is a function of one row.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import values, words_of

SYMBOLS = re.compile(r"[#*$%&|<>]")
MEASURES = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "base_failed boolean, ratio double, bad_chunk_share double, verdict string, kept boolean"
)
NAMES = [part.split()[0] for part in MEASURES.split(", ")]


@dataclass(frozen=True)
class Bands:
    """Limits of the compression rules.

    ``whole`` lists (bytes from, lowest ratio, highest ratio); texts below the
    first length are not judged by ratio, since a frame header dominates there.
    ``chunk`` bytes form a chunk, the last one counts from ``least_chunk`` bytes
    on, and at most ``bad_share`` of the judged bytes may lie outside the band.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (256, 0.30, 0.95),
        (512, 0.25, 0.90),
        (1024, 0.20, 0.85),
        (4096, 0.18, 0.80),
        (16384, 0.15, 0.75),
    )
    chunk: int = 4096
    least_chunk: int = 1024
    chunk_band: tuple[float, float] = (0.18, 0.85)
    bad_share: float = 0.3
    level: int = 3


def repeated_words(words: list[bytes]) -> int:
    """How many words stand in a 3-word window that the text holds twice or more."""
    if len(words) < 3:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    found = Counter(windows)
    if len(found) == len(windows):
        return 0
    covered, until = 0, 0
    for at, window in enumerate(windows):
        if found[window] > 1:
            covered += at + 3 - max(at, until)
            until = at + 3
    return covered


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in text.split("\n") if line.strip(" \t\n\v\f\r")]
    return len(lines) - len(set(lines))


def band_verdict(raw: bytes, bands: Bands, press: zstandard.ZstdCompressor) -> tuple[float, float, str]:
    """Ratio of the whole text, share of bad chunk bytes, and the verdict."""
    if not raw:
        return 0.0, 0.0, "ok"
    ratio = len(press.compress(raw)) / len(raw)
    low, high = next(((b[1], b[2]) for b in reversed(bands.whole) if len(raw) >= b[0]), (0.0, float("inf")))
    bad = judged = 0
    if len(raw) > bands.chunk:
        for at in range(0, len(raw), bands.chunk):
            piece = raw[at : at + bands.chunk]
            if len(piece) >= bands.least_chunk:
                judged += len(piece)
                inside = bands.chunk_band[0] <= len(press.compress(piece)) / len(piece) <= bands.chunk_band[1]
                bad += 0 if inside else len(piece)
    share = bad / judged if judged else 0.0
    if ratio < low:
        return ratio, share, "repetitive"
    if ratio > high:
        return ratio, share, "incompressible"
    return ratio, share, "bad_chunks" if share > bands.bad_share else "ok"


def judge(text: str | None, bands: Bands, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    repeats = repeated_words(words)
    chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    failed = len(words) < 50 or 100 * repeats > 50 * len(words)
    ratio, share, verdict = band_verdict(raw, bands, press)
    symbols = len(SYMBOLS.findall(text))
    return (
        len(words), chars, symbols, duplicate_lines(text), repeats,
        failed, ratio, share, verdict, not failed and verdict == "ok",
    )


def measures(text: Column, bands: Bands = Bands()) -> Column:
    """All measures of a text as one struct column; see ``MEASURES``."""

    @F.arrow_udf(f"struct<{MEASURES.replace(' ', ':').replace(',:', ',')}>")
    def measured(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=bands.level)
        rows = [judge(text, bands, press) for text in values(texts)]
        columns = list(zip(*rows)) or [()] * len(NAMES)
        kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.float64(), pa.string(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES)

    return measured(text)


def quality_report(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """One row per document: its key and the measures.

    A null text counts as empty and fails. Repeated rows are judged one by one,
    null keys are kept, other columns are ignored whatever their names.
    """
    return docs.select(docs[key], measures(docs[text], bands).alias("_m")).select(key, "_m.*")


def keep_good(docs: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns as they are."""
    return docs.filter(measures(docs[text], bands)["kept"])
