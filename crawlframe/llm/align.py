"""Alignment of two tokenizers' tokens over the same bytes, Arrow arrays throughout.

Both tokenizers encode a text; the token lists of a chunk of documents are
flattened with a parent index per token, and a cumulative sum of token sizes,
reset at every document, gives each token's end in bytes. A hash join on
(document, end) finds the places where both have a token that ends there: these
cut the tokens into groups and are the links. A chunk counts its pairs of linked
ids with ``Table.group_by``; Spark adds the counts of all chunks and finds each
right-hand id's highest.

Every chunk keeps its links as places in its own list of distinct pairs, and gets
the corpus-wide counts of those pairs back by a join, one row per pair and chunk,
however often the pair occurs in it. A frequent pair is one row per chunk.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlframe.session import written

FOLDER = "/opt/tokenizers"
LEFT, RIGHT = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK_BYTES = 4 << 20  # of text; a longer document is a chunk of its own
CALL_BYTES = 1 << 18  # of text that a tokenizer gets in one call
STRETCHES = 20_000  # words that are put together for one call

# A blank between two characters that are no white space. Neither tokenizer has a
# token across it: a token holds a blank at its start only, or nothing but blanks.
SEAM = re.compile(r"(?<=\S) (?=\S)")

ENCODED = (
    "chunk bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, links array<int>, "
    "slot int, a int, b int, n bigint"
)
RESULT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
DOCUMENT = [c.split()[0] for c in ENCODED.split(", ")[:7]]


@dataclass
class Tokenizer:
    """Ids of texts, and the bytes that each id stands for."""

    encode: Callable[[list[str]], list[list[int]]]
    pieces: pa.Array

    def __post_init__(self) -> None:
        self.sizes = pc.binary_length(self.pieces).to_numpy().astype(np.int64)


def byte_letters() -> dict[str, int]:
    """How byte-level tokenizers spell bytes: printable ones as themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def byte_level(path: str) -> Tokenizer:
    """A byte-level BPE file; a text is encoded with one blank before it, special strings as plain text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer as Reader

    reader = Reader.from_file(path)
    reader.encode_special_tokens = True
    letters = byte_letters()
    pieces: list[bytes] = [b""] * reader.get_vocab_size()
    for piece, at in reader.get_vocab().items():
        known = all(c in letters for c in piece)
        pieces[at] = bytes(letters[c] for c in piece) if known else piece.encode()

    def encode(texts: list[str]) -> list[list[int]]:
        return [e.ids for e in reader.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]

    return Tokenizer(encode, pa.array(pieces, pa.binary()))


def piece_level(path: str) -> Tokenizer:
    """A sentence-piece file, which itself adds the blank before a text."""
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for at in range(reader.get_piece_size()):
        piece = reader.id_to_piece(at)
        pieces.append(bytes([int(piece[3:5], 16)]) if reader.is_byte(at) else piece.replace("▁", " ").encode())

    def encode(texts: list[str]) -> list[list[int]]:
        return reader.encode(texts, num_threads=1)

    return Tokenizer(encode, pa.array(pieces, pa.binary()))


def load(path: str) -> Tokenizer:
    return byte_level(path) if path.endswith(".json") else piece_level(path)


def segments(text: str, limit: int) -> list[str]:
    """A text cut at seams into pieces of about ``limit`` characters that encode like the whole.

    The blank at a cut is left out, as both tokenizers put one before each piece.
    A stretch without a seam stays whole, whatever its length.
    """
    if len(text) <= limit:
        return [text]
    found, start = [], 0
    while len(text) - start > limit:
        seam = SEAM.search(text, start + limit - 1)
        if not seam:
            break
        found.append(text[start : seam.start()])
        start = seam.end()
    return [*found, text[start:]]


def windows(texts: list[str], limit: int) -> Iterator[tuple[np.ndarray, pa.DictionaryArray]]:
    """The texts' stretches between seams, in order, as a dictionary, with the text that each is of.

    A window holds about ``limit`` characters, so the stretches of a very long
    text are never all in memory.
    """
    words: list[str] = []
    owners: list[tuple[int, int]] = []
    room = 0

    def window() -> tuple[np.ndarray, pa.DictionaryArray]:
        at, sizes = zip(*owners)
        return np.repeat(at, sizes), pc.dictionary_encode(pa.array(words, pa.string()))

    for at, text in enumerate(texts):
        for piece in segments(text, limit) if text else []:
            if words and room + len(piece) > limit:
                yield window()
                words, owners, room = [], [], 0
            parts = SEAM.split(piece)
            words += parts
            owners.append((at, len(parts)))
            room += len(piece)
    if words:
        yield window()


def stretch_ids(stretches: pa.StringArray, tokenizer: Tokenizer, limit: int) -> pa.ListArray:
    """Token ids of every stretch.

    Stretches that begin and end with no white space are put together again, with
    seams between them, and encoded in calls of about ``limit`` characters (an
    encoding takes far more room than its ids); the tokens' sizes tell whose they
    are. The others, and all of a call whose tokens do not give back its bytes,
    are encoded one by one.
    """
    texts = stretches.to_pylist()
    room_of = pc.binary_length(stretches).to_numpy()
    apart = [at for at, t in enumerate(texts) if not t or t != t.strip()]
    safe = np.setdiff1d(np.arange(len(texts)), apart)
    order, counts, flat = [], [], []
    for some in np.split(safe, range(STRETCHES, len(safe), STRETCHES)):
        lines = [" ".join(texts[at] for at in some[k : k + 200]) for k in range(0, len(some), 200)]
        ids = np.array([*chain.from_iterable(tokenizer.encode(lines))], np.int32)
        whole = b"".join(b" " + line.encode("utf-8", "surrogatepass") for line in lines)
        if joined_bytes(tokenizer, ids) != whole:
            apart += some.tolist()
            continue
        stops = np.searchsorted(np.cumsum(tokenizer.sizes[ids]), np.cumsum(room_of[some] + 1), "right")
        order.append(some)
        counts.append(np.diff(stops, prepend=0))
        flat.append(ids)
    room, start = 0, 0
    for k, at in enumerate(apart, 1):
        room += room_of[at]
        if room >= limit or k == len(apart):
            lists = tokenizer.encode([texts[w] for w in apart[start:k]])
            counts.append(np.array([len(one) for one in lists], np.int64))
            flat.append(np.array([*chain.from_iterable(lists)], np.int32))
            room, start = 0, k
    order.append(np.array(apart, np.int64))
    offsets = np.cumsum(np.concatenate([[0], *counts])).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat)) if flat else pa.array([], pa.int32()))
    return lists.take(pa.array(np.argsort(np.concatenate(order))))


def encoded(count: int, cut: list[tuple[np.ndarray, pa.DictionaryArray]], tokenizer: Tokenizer, limit: int) -> pa.ListArray:
    """Token ids per text. A stretch that a window repeats is encoded once."""
    flat, sizes = [pa.array([], pa.int32())], np.zeros(count, np.int64)
    for owners, stretches in cut:
        lists = stretch_ids(stretches.dictionary, tokenizer, limit).take(stretches.indices)
        flat.append(lists.flatten())
        sizes += np.bincount(owners, pc.list_value_length(lists).to_numpy(), count).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.concat_arrays(flat))


def joined_bytes(tokenizer: Tokenizer, ids: np.ndarray) -> bytes:
    pieces = tokenizer.pieces.take(pa.array(ids))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), pieces), b"")[0].as_py()


def bytes_equal(ids: pa.ListArray, tokenizer: Tokenizer, wanted: pa.Array) -> pa.Array:
    """Per document, whether its tokens' joined bytes are the wanted ones."""
    flat = tokenizer.pieces.take(ids.flatten())
    joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, flat), b"")
    return pc.equal(joined, wanted)


def ends_of(ids: pa.ListArray, sizes: pa.Array, name: str) -> pa.Table:
    """(doc, end, id, place) of every token: its document, and where in it the token's bytes end."""
    flat, doc = ids.flatten(), pc.list_parent_indices(ids)
    total = pc.cumulative_sum(sizes.take(flat))
    # Where a document starts, the running sum of all before it is taken off again.
    starts = pc.subtract(ids.offsets, 1)[:-1].take(doc)
    before = pc.if_else(pc.less(starts, 0), 0, total.take(pc.max_element_wise(starts, 0)))
    place = pa.array(np.arange(len(flat)))
    return pa.table({"doc": doc.cast(pa.int64()), "end": pc.subtract(total, before), name: flat, f"{name}_place": place})


def grouped(ids: pa.ListArray, last: np.ndarray) -> pa.Array:
    """Ids of each group as text, comma-joined; ``last`` are the places of the groups' last tokens."""
    offsets = pa.array(np.concatenate([[0], last + 1]).astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, ids.flatten().cast(pa.string())), ",")


def runs_of(ascending: np.ndarray) -> np.ndarray:
    """Distinct values of an ascending array."""
    return ascending[np.diff(ascending, prepend=-1) > 0]


def lists_by(parents: np.ndarray, count: int, values: pa.Array) -> pa.ListArray:
    """Values in lists by their ascending parents; a parent without any has an empty list."""
    offsets = np.searchsorted(parents, np.arange(count + 1), "left").astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def aligned(
    chunk: int, ids: pa.Array, texts: list[str], left: Tokenizer, right: Tokenizer, window: int, call: int
) -> pa.Table:
    """The rows of a chunk: one per document, and one per distinct pair of linked ids."""
    wanted = pa.array([b" " + t.encode("utf-8", "surrogatepass") if t else b"" for t in texts], pa.binary())
    cut = list(windows(texts, window))
    a, b = encoded(len(texts), cut, left, call), encoded(len(texts), cut, right, call)
    good = pc.and_(bytes_equal(a, left, wanted), bytes_equal(b, right, wanted))
    none = pa.scalar([], a.type)
    a, b = pc.if_else(good, a, none), pc.if_else(good, b, none)
    count = len(texts)
    ends = [ends_of(x, pa.array(t.sizes), n) for x, t, n in ((a, left, "a"), (b, right, "b"))]
    links = ends[0].join(ends[1], ["doc", "end"], join_type="inner", use_threads=False)
    links = links.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    last = [runs_of(links[f"{n}_place"].to_numpy()) for n in "ab"]
    of_a, of_b = grouped(a, last[0]), grouped(b, last[1])
    group_docs = ends[0]["doc"].to_numpy()[last[0]]
    groups = lists_by(group_docs, count, pc.binary_join_element_wise(of_a, of_b, "|"))
    spelled = pc.binary_join(groups, ";").to_pylist()
    pairs = pc.add(pc.shift_left(links["a"].cast(pa.int64()), pa.scalar(32, pa.int64())), links["b"].cast(pa.int64()))
    pairs = pairs.combine_chunks() if isinstance(pairs, pa.ChunkedArray) else pairs
    distinct = pc.dictionary_encode(pairs)
    per_slot = pa.table({"slot": distinct.indices}).group_by("slot", use_threads=False).aggregate([([], "count_all")])
    codes = distinct.dictionary.take(per_slot["slot"].combine_chunks())
    documents = pa.table(
        {
            "chunk": pa.array([chunk] * count, pa.int64()),
            "doc_id": ids,
            "n_a": pc.list_value_length(a).cast(pa.int64()),
            "n_b": pc.list_value_length(b).cast(pa.int64()),
            "n_groups": pc.list_value_length(groups).cast(pa.int64()),
            "groups_sha256": [hashlib.sha256(s.encode()).hexdigest() if s else "" for s in spelled],
            "links": lists_by(links["doc"].to_numpy(), count, distinct.indices),
        }
    )
    slots = pa.table(
        {
            "chunk": pa.array([chunk] * per_slot.num_rows, pa.int64()),
            "slot": per_slot["slot"],
            "a": pc.shift_right(codes, pa.scalar(32, pa.int64())).cast(pa.int32()),
            "b": pc.bit_wise_and(codes, pa.scalar(0xFFFFFFFF, pa.int64())).cast(pa.int32()),
            "n": per_slot["count_all"],
        }
    )
    return pa.concat_tables([documents, slots], promote_options="default").select([c.split()[0] for c in ENCODED.split(", ")])


def chunks_of(batch: pa.RecordBatch, limit: int) -> Iterator[tuple[pa.Array, list[str]]]:
    """Consecutive rows of a batch of about ``limit`` bytes of text together."""
    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
    start, room = 0, 0
    for at, size in enumerate(sizes):
        if at > start and room + size > limit:
            yield batch.column(0)[start:at], batch.column(1)[start:at].to_pylist()
            start, room = at, 0
        room += size
    if start < len(sizes):
        yield batch.column(0)[start:], batch.column(1)[start:].to_pylist()


def encode_all(docs: DataFrame, left: str, right: str, chunk_bytes: int, call_bytes: int) -> DataFrame:
    """All chunks' rows (``ENCODED``). Chunks are numbered by task and place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = load(left), load(right)
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for ids, texts in chunks_of(batch, chunk_bytes):
                rows = aligned(chunk, ids, [t or "" for t in texts], one, other, chunk_bytes, call_bytes)
                chunk += 1
                yield from rows.combine_chunks().to_batches()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, ENCODED)


def alignment(
    docs: DataFrame,
    left: str = f"{FOLDER}/{LEFT}",
    right: str = f"{FOLDER}/{RIGHT}",
    chunk_bytes: int = CHUNK_BYTES,
    call_bytes: int = CALL_BYTES,
) -> DataFrame:
    """One row per document (``RESULT``) for the tokenizer files ``left`` and ``right``.

    A text that is NULL or empty, or that either tokenizer does not give back byte
    by byte, has no tokens: zeros and an empty ``groups_sha256``. Rows are taken
    one by one, so repeated rows and ids, also NULL ones, give a row each; a count
    that several pairs of a right-hand id reach is the highest for all of them.
    Texts are encoded whole; long ones in pieces between words, which changes no
    token. Other columns play no part. Both files must be at their paths on every
    machine.

    The texts are read once. What leaves a chunk is written: a row per document,
    with its links as small numbers, and a row per distinct pair. The second step
    joins only the pair rows and brings both kinds of rows together by chunk.
    """
    rows = written(encode_all(docs, left, right, chunk_bytes, call_bytes), "encoded")
    counts = rows.filter("slot IS NOT NULL")
    totals = written(counts.groupBy("a", "b").agg(F.sum("n").alias("total")), "pairs")
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    known = totals.join(highest, "b").selectExpr("a", "b", "total", "total = highest AS best")
    answers = counts.select("chunk", "slot", "a", "b").join(known, ["a", "b"]).selectExpr("chunk AS home", "slot", "total", "best")

    def add(of_docs: pa.Table, of_slots: pa.Table) -> pa.Table:
        order = np.argsort(of_slots["slot"].to_numpy())
        total = of_slots["total"].to_numpy()[order]
        best = of_slots["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)
        links = of_docs["links"].combine_chunks()
        flat = links.flatten().to_numpy()
        bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(links).to_numpy())])

        def summed(values: np.ndarray) -> np.ndarray:
            running = np.concatenate([[0], np.cumsum(values[flat])])
            return running[bounds[1:]] - running[bounds[:-1]]

        sums = {
            "n_links": pa.array(np.diff(bounds), pa.int64()),
            "n_best": pa.array(summed(best), pa.int64()),
            "count_sum": pa.array(summed(total), pa.int64()),
        }
        return pa.table({c: sums[c] if c in sums else of_docs[c] for c in (x.split()[0] for x in RESULT.split(", "))})

    documents = rows.filter("slot IS NULL").select(*DOCUMENT)
    return documents.groupBy("chunk").cogroup(answers.groupBy("home")).applyInArrow(add, RESULT)
