"""Benchmark decontamination by CGK embedding and bit-sampling LSH.

The CGK random walk copies a sequence into one three times as long: at every
step it writes the current symbol and then goes on to the next one or stays, by
a random bit that depends on the step and the symbol only. Two sequences at edit
distance k come out at a Hamming distance near k, so sampled positions of the
output are equal with good odds and serve as LSH keys. Symbols are words, edits
are word edits.

Windows as long as an item slide over every text. A window within the edit limit
keeps most of the item's word pairs (each edit breaks two at most); windows that
hold fewer pairs of any item are passed over, which loses nothing. All others are
embedded and looked up, and candidates are verified by their exact distance.

The walks of two edited copies drift apart with length, so an item of more than
``PIECE`` words is looked up by pieces that cover it. Of the edits within the
limit, some piece holds no more than its share, so that piece is within the limit
of an item of its own length. The whole item is then held against every window
that a hit of a piece allows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import lower_words_of, values

BLOCK = 8  # word pairs
WINDOWS = 256  # embedded at a time
PIECE = 64  # words; longer items are looked up by pieces of half that or more


@dataclass(frozen=True)
class Settings:
    """``edit_share`` of an item's words may be edited, rounded down.

    The number of tables follows from ``recall``: each samples ``sampled``
    positions, and a position of the embeddings of a pair at the limit differs
    with odds of at most ``differs`` (twice the edit share covers the walk's
    excess at up to ``PIECE`` words; a test measures it). ``least_words``:
    shorter items are matched whole only. ``item_bytes`` bounds the benchmark that is sent to every task.
    """

    edit_share: float = 0.15
    sampled: int = 2
    recall: float = 0.99
    differs: float = 0.45
    least_words: int = 8
    item_bytes: int = 64 << 20
    seed: int = 7

    def tables(self) -> int:
        hit = (1 - self.differs) ** self.sampled
        return math.ceil(math.log(1 - self.recall) / math.log(1 - hit))

    def limit(self, words: int) -> int:
        return int(words * self.edit_share) if words >= self.least_words else 0


def embed(windows: np.ndarray, steps: int | np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """CGK embeddings of equally long symbol sequences, one per row with its own seed; 0 pads the end.

    ``steps`` may be one number per row, falling from row to row: then each row
    is walked only so far, and the rest of it is 0.
    """
    rows, width = windows.shape
    padded = np.concatenate([windows, np.zeros((rows, 1), windows.dtype)], axis=1).astype(np.uint64).ravel()
    at = np.arange(rows) * (width + 1)
    ends = at + width
    each = np.broadcast_to(steps, rows)
    out = np.zeros((int(each.max(initial=0)), rows), np.uint64)
    walked = rows - np.searchsorted(each[::-1], np.arange(len(out)), side="right")  # rows that go on
    salt = seeds.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    for step, some in enumerate(walked):
        symbol = padded.take(at[:some], out=out[step, :some], mode="clip")
        mixed = symbol + salt[:some]
        mixed += np.uint64(step * 0x2545F491)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed >>= np.uint64(40)
        mixed &= np.uint64(1)
        at[:some] += mixed.view(np.int64)
        if step >= width - 1:
            np.minimum(at[:some], ends[:some], out=at[:some])
    return out.T.view(np.int64)


def distance(a: list[int], b: list[int], limit: int) -> int | None:
    """Edit distance if it is at most ``limit``."""
    longest = max(len(a), len(b))
    if abs(len(a) - len(b)) > limit or longest - (Counter(a) & Counter(b)).total() > limit:
        return None  # every word without a partner costs an edit
    edits = whole_distance(a, b)
    return edits if edits <= limit else None


def whole_distance(a: list[int], b: list[int]) -> int:
    """Edit distance by bit vectors, for long sequences; without a limit."""
    if not a:
        return len(b)
    where: dict[int, int] = {}
    for k, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << k
    every, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, edits = every, 0, len(a)
    for y in b:
        same = where.get(y, 0)
        side = same | down
        cross = (((same & up) + up) ^ up) | same
        more, less = down | (~(cross | up) & every), up & cross
        edits += bool(more & top) - bool(less & top)
        more, less = (more << 1 | 1) & every, less << 1 & every
        up, down = less | (~(side | more) & every), more & side
    return edits


def pieces(words: int) -> list[tuple[int, int]]:
    """(first word, words) of the pieces of an item, which do not overlap and cover it."""
    count = -(-words // PIECE)
    cuts = [words * k // count for k in range(count + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])]


@dataclass
class Index:
    """The benchmark as symbols, with its LSH tables by window length."""

    settings: Settings
    symbols: dict[bytes, int] = field(default_factory=dict)
    items: list[tuple[int, list[int]]] = field(default_factory=list)  # id, symbols
    pairs: np.ndarray | None = None
    parts: list[tuple[int, int, list[int]]] = field(default_factory=list)  # item, first word, symbols
    lengths: dict[int, list[int]] = field(default_factory=dict)  # the parts of each length
    masks: dict[int, np.ndarray] = field(default_factory=dict)  # which pairs stand in parts of a length
    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)  # places, keys, owners

    def __post_init__(self) -> None:
        self.base = len(self.symbols) + 1
        self.dense = BLOCK

    def least_in_block(self, length: int) -> int:
        """Known pairs that some BLOCK pairs of a window must hold, if it is within the limit."""
        return BLOCK - 2 * self.settings.limit(length) // ((length - 1) // BLOCK)

    @classmethod
    def of(cls, rows: list[tuple[int, str | None]], settings: Settings) -> Index:
        symbols: dict[bytes, int] = {}
        items = []
        for key, text in rows:
            words = lower_words_of(text)
            if words:
                items.append((key, [symbols.setdefault(w, len(symbols) + 1) for w in words]))
        made = cls(settings, symbols, items)
        coded = {x * made.base + y for _, s in items for x, y in zip(s, s[1:])}
        made.pairs = np.array(sorted(coded), np.int64)
        for at, (_, s) in enumerate(items):
            for first, size in pieces(len(s)):
                made.lengths.setdefault(size, []).append(len(made.parts))
                made.parts.append((at, first, s[first : first + size]))
        made.dense = min((made.least_in_block(n) for n in made.lengths if n > BLOCK), default=BLOCK)
        pick = np.random.default_rng(settings.seed)
        for length, members in made.lengths.items():
            grid = np.array([made.parts[k][2] for k in members], np.int64)
            own = (grid[:, :-1] * made.base + grid[:, 1:]).ravel()
            made.masks[length] = np.isin(made.pairs, own)
            # Positions come from where the walk still reads symbols of the part.
            size = min(settings.sampled, 2 * length)
            places = np.stack([pick.choice(2 * length, size=size, replace=False) for _ in range(settings.tables())])
            keys = made.keys(grid, places)
            order = np.argsort(keys, kind="stable")
            made.tables[length] = (places, keys[order], np.repeat(members, len(places))[order])
        return made

    def keys(self, windows: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The LSH keys of every window, one per table, window by window."""
        count, last = len(places), places.max(axis=1) + 1
        order = np.argsort(-last, kind="stable")  # each table is walked as far as it samples
        walks = embed(np.tile(windows, (count, 1)), np.repeat(last[order], len(windows)), np.repeat(order, len(windows)) + self.settings.seed)
        row = (np.argsort(order)[None] * len(windows) + np.arange(len(windows))[:, None]).ravel()
        table = np.tile(np.arange(count), len(windows))
        code = table.astype(np.uint64)
        for k in range(places.shape[1]):
            sampled = walks[row, places[table, k]]
            code = (code + sampled.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code

    def hits(self, coded: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, first word, words, edits): the best window of each item in a text."""
        n = len(coded)
        if not n or not self.items:
            return []
        left, right = coded[:-1], coded[1:]
        pair = left * self.base + right
        at = np.minimum(np.searchsorted(self.pairs, pair), max(len(self.pairs) - 1, 0))
        known = (self.pairs[at] == pair) & (left > 0) & (right > 0) if len(self.pairs) else np.zeros(n - 1, bool)
        total = np.concatenate([[0], np.cumsum(known)])
        # Spread over the blocks of a window, the broken pairs leave one block with few of them.
        dense = n > BLOCK and bool((total[BLOCK:] - total[:-BLOCK] >= self.dense).any())
        best: dict[int, tuple[int, int, int]] = {}
        long: dict[int, set[int]] = {}  # items of several parts, and the windows to hold them against
        spots = np.flatnonzero(known)
        which = at[spots]
        for length in self.lengths:
            limit = self.settings.limit(length)
            if n < length - limit or (n >= length > BLOCK and not dense):
                continue
            body = coded
            if n < length:  # a text that ends early is padded with unknown words
                body = np.concatenate([coded, np.zeros(length - n, np.int64)])
            if length == 1:
                starts = np.flatnonzero(coded)
            else:
                own = spots[self.masks[length][which]]
                least = max(1, length - 1 - 2 * limit)
                if len(own) < least:
                    continue
                first = np.arange(len(body) - length + 1)
                inside = np.searchsorted(own, first + length - 1) - np.searchsorted(own, first)
                starts = np.flatnonzero(inside >= least)
            tried: set[tuple[int, int]] = set()
            places, keys, owners = self.tables[length]
            for part in range(0, len(starts), WINDOWS):
                some = starts[part : part + WINDOWS]
                found = self.keys(body[some[:, None] + np.arange(length)], places)
                low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, side="right")
                for row in np.flatnonzero(high > low):
                    for owner in owners[low[row] : high[row]]:
                        tried.add((int(some[row // len(places)]), int(owner)))
            for start, part in sorted(tried):
                owner, offset, symbols = self.parts[part]
                words = len(self.items[owner][1])
                whole = words == length
                # A part may end a few words before or after its window, at one edit each.
                edits = distance(coded[start : start + length].tolist(), symbols, limit if whole else 2 * limit)
                if edits is None:
                    continue
                if not whole:
                    drift, last = self.settings.limit(words), max(0, n - words)
                    near = range(max(0, min(start - offset - drift, last)), min(max(start - offset + drift, 0), last) + 1)
                    long.setdefault(owner, set()).update(near)
                elif owner not in best or edits < best[owner][2]:
                    best[owner] = (start, min(length, n - start), edits)
        for owner, windows in long.items():
            symbols = self.items[owner][1]
            length = len(symbols)
            least, skipped = self.settings.limit(length) + 1, -1
            for start in sorted(windows):
                if start < skipped:
                    continue
                edits = whole_distance(symbols, coded[start : start + length].tolist())
                if edits < least:
                    best[owner], least = (start, min(length, n - start), edits), edits
                skipped = start + (edits - least) // 2 + 1  # one word on changes the distance by two at most
        return sorted((owner, *found) for owner, found in best.items())


HITS = "array<struct<item_id:bigint,first_word:bigint,n_words:bigint,edits:bigint>>"


def index_of(benchmark: DataFrame, item: str = "item_id", text: str = "text", settings: Settings = Settings()) -> Index:
    """Index the benchmark, whose size is checked: it goes to every task."""
    size = benchmark.agg(F.sum(F.octet_length(text))).first()[0] or 0
    if size > settings.item_bytes:
        raise ValueError(f"the benchmark has {size} bytes of text; split it into parts of at most {settings.item_bytes}")
    rows = benchmark.select(F.col(item).cast("bigint"), text).collect()
    return Index.of(sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")), settings)


def contamination(text: Column, index: Index) -> Column:
    """The items found in a text, as an array; see ``HITS``. Null or blank texts hold none."""
    @F.arrow_udf(HITS)
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        code = index.symbols.get
        kind = pa.list_(pa.struct([(name, pa.int64()) for name in ("item_id", "first_word", "n_words", "edits")]))
        for texts in batches:
            rows = []
            for one in values(texts):
                words = lower_words_of(one)
                coded = np.fromiter((code(w, 0) for w in words), np.int64, len(words))
                rows.append(
                    [
                        {"item_id": index.items[owner][0], "first_word": start, "n_words": length, "edits": edits}
                        for owner, start, length, edits in index.hits(coded)
                    ]
                )
            yield pa.array(rows, kind)

    return found(text)


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(key, item_id, first_word, n_words, edits): the best window of each item in each document.

    Repeated rows are reported once each. Items without words are never found;
    equal items are each reported. An empty benchmark finds nothing.
    """
    index = index_of(benchmark, settings=settings)
    found = contamination(docs[text], index)
    return docs.select(docs[key], F.explode(found).alias("_hit")).select(key, "_hit.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with their columns as they are."""
    return docs.filter(F.size(contamination(docs[text], index_of(benchmark, settings=settings))) == 0)

