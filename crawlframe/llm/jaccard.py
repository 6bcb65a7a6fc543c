"""Exact n-gram Jaccard join that skips work by the relations between sets.

Sets are word shingles. Three relations save work, and none loses a link:

* Equal sets form one class; only classes are compared.
* Index lists are cut into blocks of equal set size and position. A block whose
  size or position rules out the needed overlap is skipped as a whole.
* A set that links with the pivot of its list takes over the pivot's answers:
  both are in one group, so only pairs from different groups are compared later.

Tokens are ordered rarest first, the most frequent ones by a bounded list, the
others by hash. Any order gives the same links; this one keeps passages that
many documents share out of the prefixes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlframe.llm.common import ARROW_BYTES, BATCH_BYTES, lower_words_of, values
from crawlframe.llm.graph import components
from crawlframe.session import settings, written

WIDTH = 5  # words in a shingle
HOT_TOKENS = 1 << 18  # bound of the list of frequent tokens: 4 MB
LEAST_HOT = 8  # a token in fewer sets is not listed
BLOCK = 64  # sets in one block of an index list
CACHED_WORDS = 50_000
HELD_TOKENS = 6_000_000  # of which a task looks for repeated ones at a time: 48 MB
SENT_TOKENS = 1 << 16  # rows in one batch of them
PRIME = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)
SHIFT = np.uint64(32)


class WordHashes(dict):
    """64-bit hashes of words, kept for repeated words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles.

    Fewer words form one shingle as a whole; no words form an empty set.
    """
    n = len(words)
    if not n:
        return np.empty(0, np.int64)
    coded = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    width = min(n, WIDTH)
    total = coded[: n - width + 1].copy()
    for k in range(1, width):
        total *= PRIME
        total += coded[k : n - width + 1 + k]
    total += np.uint64(width * int(MIX) % (1 << 64))
    total ^= total >> SHIFT
    total *= MIX
    total ^= total >> SHIFT
    return np.unique(total.view(np.int64))


def repeated_tokens(held: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(token, n) of the tokens that stand in ``held`` twice or more; sorts it in place."""
    held.sort()
    same = held[1:] == held[:-1]
    first = np.flatnonzero(same & ~np.r_[False, same[:-1]])
    last = np.flatnonzero(same & ~np.r_[same[1:], False])
    for at in range(0, len(first), SENT_TOKENS):
        low, high = first[at : at + SENT_TOKENS], last[at : at + SENT_TOKENS]
        yield pa.RecordBatch.from_arrays([pa.array(held[low]), pa.array(high - low + 2)], ["token", "n"])


def frequent_tokens(docs: DataFrame, text: str, most: int = HOT_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, sorted, and their place in the order (1 for the rarest).

    Every task reports the tokens that it met in two different sets or more; any
    token in more sets than there are tasks is met so. The list only decides the
    order of tokens, never which sets link.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        # Sets lie in one array, whose pages are taken as they fill and given back at the end.
        held, size = np.empty(HELD_TOKENS + SENT_TOKENS, np.int64), 0
        for batch in batches:
            for one in values(batch.column(0)):
                tokens = shingles(lower_words_of(one), hashes)
                if (own := xxhash.xxh3_64_intdigest(tokens.tobytes())) in seen:
                    continue
                seen.add(own)
                if size + len(tokens) > len(held):
                    held = np.concatenate([held[:size], tokens])
                held[size : size + len(tokens)] = tokens
                size += len(tokens)
                if size > HELD_TOKENS:
                    yield from repeated_tokens(held[:size])
                    size, seen = 0, set()
        yield from repeated_tokens(held[:size])

    rows = (
        docs.select(text)
        .mapInArrow(repeated, "token bigint, n bigint")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= LEAST_HOT)
        .orderBy(F.desc("n"), "token")
        .limit(most)
        .toPandas()
    )
    tokens = rows["token"].to_numpy(np.int64)
    place = np.arange(len(tokens), 0, -1, dtype=np.int64)
    order = np.argsort(tokens)
    return tokens[order], place[order]


def document_sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text_key, n, print, prefix) per row: set size, fingerprint and rarest tokens.

    Two sets can only link if they share a token among their first n // 5 + 1.
    """
    hot, place = frequent_tokens(docs, text)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sizes, prints, prefixes = [], [], []
            for one in values(batch.column(2)):
                tokens = shingles(lower_words_of(one), hashes)
                n = len(tokens)
                sizes.append(n)
                prints.append(xxhash.xxh3_128_digest(tokens.tobytes()) if n else None)
                if len(hot) and n:
                    at = np.minimum(np.searchsorted(hot, tokens), len(hot) - 1)
                    rank = np.where(hot[at] == tokens, place[at], 0)
                    tokens = tokens[np.argsort(rank, kind="stable")]
                prefixes.append(tokens[: n // 5 + 1].copy())  # a slice would hold the whole set
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = np.concatenate(prefixes) if prefixes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(prints, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ],
                ["id", "text_key", "n", "print", "prefix"],
            )

    return docs.select(F.col(key).cast("bigint").alias("id"), F.xxhash64(text).alias("text_key"), text).mapInArrow(
        sets, "id bigint, text_key bigint, n bigint, print binary, prefix array<bigint>"
    )


def shared_lists(classes: DataFrame) -> DataFrame:
    """Index lists with two sets or more: (token, cid, n, at, pivot, pivot_n, pivot_at).

    A list is dealt by token and read as a stream. The pivot is the set of the
    same size band where the token comes earliest: an edited copy starts with
    tokens of its own, so that is the set with the fewest edits. Lists of two are
    dropped at once if size or position rule the pair out.
    """
    lists = (
        classes.select("cid", "n", F.posexplode("prefix").alias("at", "token"))
        .withColumn("band", F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int"))
        .repartition("token")
        .sortWithinPartitions("token", "band", "at", "cid")
        .select("token", "band", "cid", "n", "at")
    )
    names = ["token", "cid", "n", "at", "pivot", "pivot_n", "pivot_at"]

    def feasible(n, i, m, j):
        return (5 * np.minimum(n, m) >= 4 * np.maximum(n, m)) & (4 * (n + m) <= 9 * np.minimum(n - i, m - j))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last row, whose list may go on, and whether it is written
        pivot = None
        for batch in batches:
            if not batch.num_rows:
                continue
            token, band, cid, n, at = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(5))
            if kept is not None:
                token, band, cid, n, at = (np.concatenate([[old], new]) for old, new in zip(kept[:5], (token, band, cid, n, at)))
            size = len(token)
            same = token[1:] == token[:-1]
            first = np.r_[True, ~same | (band[1:] != band[:-1])]
            start = np.maximum.accumulate(np.where(first, np.arange(size), 0))
            lead = np.stack([cid[start], n[start], at[start]])
            if kept is not None and pivot is not None:
                lead[:, start == 0] = np.array(pivot)[:, None]
            in_list = np.r_[False, same] | np.r_[same, False]
            if kept is not None and kept[5]:
                in_list[0] = True
            pair = np.flatnonzero(in_list[:-1] & same & ~np.r_[False, same[:-1]] & ~np.r_[same[1:], False])
            pair = pair[(pair > 0) & (pair + 2 < size)]  # whole lists inside this batch
            bad = pair[~feasible(n[pair], at[pair], n[pair + 1], at[pair + 1])]
            in_list[bad] = in_list[bad + 1] = False
            done = in_list.copy()
            done[-1] = False  # decided with the next batch
            if done.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[done]) for x in (token, cid, n, at, *lead)], names
                )
            kept = (token[-1], band[-1], cid[-1], n[-1], at[-1], bool(in_list[-1]))
            pivot = tuple(lead[:, -1])
        if kept is not None and kept[5]:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (kept[0], *kept[2:5], *pivot)], names)

    return lists.mapInArrow(stream, ", ".join(f"{name} bigint" for name in names))


def linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (u, v) whose whole sets link: 100 * intersection >= 80 * union.

    Texts move compressed, once per pair and side, and the sets are made again
    from them: that is a third of the bytes of the sets themselves.
    """
    joined = pairs.join(texts.toDF("u", "u_text"), "u").join(texts.toDF("v", "v_text"), "v")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, opened = WordHashes(), zstandard.ZstdDecompressor()
        recent: dict[int, np.ndarray] = {}

        def tokens(node: int, packed: bytes) -> np.ndarray:
            if node not in recent:
                if len(recent) >= 32:
                    recent.pop(next(iter(recent)))
                recent[node] = shingles(opened.decompress(packed).split(), hashes)
            return recent[node]

        for batch in batches:
            keep = []
            for u, v, a, b in zip(*map(values, batch.columns)):
                x, y = tokens(v, b), tokens(u, a)
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= 80 * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return joined.select("u", "v", "u_text", "v_text").mapInArrow(check, "u bigint, v bigint")


def packed_texts(docs: DataFrame, key: str, text: str, wanted: DataFrame) -> DataFrame:
    """(cid, lower-cased text, compressed) of one document of each wanted class (cid, rep, rep_key)."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=1)
        return pa.array([press.compress(b" ".join(lower_words_of(one))) for one in values(texts)], pa.binary())

    rows = docs.select(F.col(key).cast("bigint").alias("rep"), F.xxhash64(text).alias("rep_key"), F.col(text).alias("text"))
    # Rows with the same id and text are the same to us.
    found = rows.join(wanted, rows["rep"].eqNullSafe(wanted["rep"]) & (rows["rep_key"] == wanted["rep_key"]))
    return found.select("cid", pack("text").alias("packed")).dropDuplicates(["cid"])


def other_pairs(lists: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs of sets from different groups that share a block pair no rule skips."""
    named = lists.select("token", "cid", "n", "at").join(
        roots.select(F.col("node").alias("cid"), "root"), "cid", "left"
    ).withColumn("root", F.coalesce("root", "cid"))
    mixed = named.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi")
    named = written(named.join(mixed.select("token"), "token", "left_semi"), "mixed_lists")
    largest = named.groupBy("token", "n", "at").count().agg(F.max("count")).first()[0] or 0
    salt = F.pmod(F.xxhash64("cid"), F.lit(1 + largest // BLOCK)).alias("salt")
    blocks = named.groupBy("token", "n", "at", salt).agg(F.collect_list(F.struct("cid", "root")).alias("sets"))
    left = blocks.select("token", *(F.col(c).alias(f"a_{c}") for c in ("n", "at", "salt", "sets")))
    right = blocks.select("token", *(F.col(c).alias(f"b_{c}") for c in ("n", "at", "salt", "sets")))
    kept = left.join(right, "token").filter(
        "struct(a_n, a_at, a_salt) <= struct(b_n, b_at, b_salt) and 5 * a_n >= 4 * b_n"
        " and 4 * (a_n + b_n) <= 9 * least(a_n - a_at, b_n - b_at)"
    )
    return (
        kept.select(F.explode("a_sets").alias("x"), "b_sets")
        .select("x", F.explode(F.expr("filter(b_sets, y -> y.root != x.root)")).alias("y"))
        .select(F.greatest("x.cid", "y.cid").alias("u"), F.least("x.cid", "y.cid").alias("v"))
        .distinct()
    )


def with_roots(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs (u, v) whose sets are in different groups so far."""
    for side in "uv":
        named = roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        pairs = pairs.join(named, side, "left").withColumn(f"{side}_root", F.coalesce(f"{side}_root", side))
    return pairs.filter("u_root != v_root").select("u", "v")


def all_links(lists: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (u, v) that connect all that link, and the groups they make.

    First every set is held against the pivot it meets most often, then against
    its other pivots unless it is in their group by now, and at last against all
    sets of other groups that no rule skips.
    """
    to_pivot = written(
        lists.filter(
            "cid != pivot and 5 * least(n, pivot_n) >= 4 * greatest(n, pivot_n)"
            " and 4 * (n + pivot_n) <= 9 * least(n - at, pivot_n - pivot_at)"
        )
        .groupBy("cid", "pivot")
        .agg(F.count(F.lit(1)).alias("shared")),
        "to_pivot",
    )
    pair = (F.greatest("cid", "pivot").alias("u"), F.least("cid", "pivot").alias("v"))
    best = to_pivot.groupBy("cid").agg(F.max(F.struct("shared", -F.col("pivot"))).alias("best"))
    tried = written(best.select("cid", (-F.col("best.col2")).alias("pivot")).select(*pair).distinct(), "tried")
    links = written(linked(tried, texts), "links")
    roots = written(components(links), "roots")
    others = to_pivot.select(*pair).distinct().join(tried, ["u", "v"], "left_anti")
    others = written(with_roots(others, roots), "tried")
    links = links.union(written(linked(others, texts), "links"))
    roots = written(components(links), "roots")
    rest = other_pairs(lists, roots).join(tried.union(others), ["u", "v"], "left_anti")
    links = links.union(written(linked(rest, texts), "links"))
    return links, components(links)


def rooted_groups(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``jaccard_groups`` with the ``root`` that names each group, also where ids do not; null for empty sets."""
    # Texts reach Python in batches of a bounded size, not of 10,000 rows.
    with settings(docs.sparkSession, {ARROW_BYTES: str(BATCH_BYTES)}):
        rows = written(document_sets(docs, key, text), "sets")
        grouped = (
            rows.filter("n > 0")
            .groupBy("print")
            .agg(
                F.min("id").alias("least_id"),
                F.min(F.struct("id", "text_key")).alias("rep"),
                F.first("n").alias("n"),
                F.first("prefix").alias("prefix"),
            )
            .withColumn("cid", F.monotonically_increasing_id())
        )
        classes = written(grouped, "classes")
        lists = written(shared_lists(classes), "lists")
        wanted = classes.join(lists.select("cid").distinct(), "cid", "left_semi").select("cid", "rep.id", "rep.text_key")
        texts = written(packed_texts(docs, key, text, wanted.toDF("cid", "rep", "rep_key")), "texts")

        _, roots = all_links(lists, texts)

    named = classes.select("print", "cid", "least_id").join(roots.withColumnRenamed("node", "cid"), "cid", "left")
    named = named.withColumn("root", F.coalesce("root", "cid"))
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    by_print = named.select("print", "root").join(least, "root").select("print", "component_id", "root")
    narrow = rows.select("id", "n", "text_key", "print")
    linked_rows = narrow.filter("n > 0").join(by_print, "print")
    columns = [F.col("id").alias(key), F.col("n").alias("n_shingles")]
    return linked_rows.select(*columns, "component_id", "text_key", "root").union(
        narrow.filter("n = 0").select(
            *columns, F.col("id").alias("component_id"), "text_key", F.lit(None).cast("bigint").alias("root")
        )
    )


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, text_key) per row of ``docs``.

    A null or blank text has an empty set and is linked with nothing; its
    component is its own id. The component id is the smallest id that links
    reach. Rows with a null id link like others but give no component id; a
    group without any id has a null one. Repeated rows are kept.
    """
    return rooted_groups(docs, key, text).drop("root")


def keep_one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` but only one of every group of linked documents.

    The row with the group's smallest id stays, the first of repeated rows.
    Rows without words are linked with nothing and stay, and so does one row of
    a group that has no id. Unlinked rows each stay, also if their ids are
    equal or null: groups are told apart by their roots.
    """
    groups = rooted_groups(docs, key, text).filter(F.col("n_shingles") > 0)
    least = groups.filter(F.col(key).eqNullSafe(F.col("component_id"))).groupBy("root", "component_id")
    chosen = least.agg(F.min("text_key").alias("text_key"))
    blank = ~F.coalesce(docs[text].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    # Names that no input column has. The join and the choice among repeated rows share one
    # partitioning, so the texts move once.
    on = unused(docs.columns, "none", "id", "print")

    def place(of: Column, hashed: Column) -> list[Column]:
        return [c.alias(n) for c, n in zip((F.isnull(of), F.coalesce(of, F.lit(0)), hashed), on)]

    keyed = docs.filter(~blank).select("*", *place(docs[key].cast("bigint"), F.xxhash64(docs[text])))
    one = chosen.select(*place(chosen["component_id"], chosen["text_key"]))
    kept = keyed.join(one, on, "left_semi").dropDuplicates(on)
    return kept.select(*(F.col(f"`{c}`") for c in docs.columns)).union(docs.filter(blank))


def unused(taken: list[str], *names: str) -> list[str]:
    """The names, each with underscores before it until no column has it."""
    lower = {t.lower() for t in taken}
    found = []
    for name in names:
        while name.lower() in lower:
            name = f"_{name}"
        found.append(name)
    return found
