"""The other operators against plain versions, with nulls, ties, repeats and clashing names."""

from __future__ import annotations

import collections
import math
import random
import zlib

import brute
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from crawlframe.llm import chat, decontaminate, graph, htmlmain, jaccard, maglev, mixing, quality, suffix_tree

LONG = " ".join(f"w{k}" for k in range(60_000))


def corpus(seed: int = 1) -> list[tuple]:
    """Odd rows, near copies at all distances, exact copies and a shared passage."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    texts: list[str | None] = [None, "", " \n ", "One two", "one  TWO", "a b c d", "x y z", LONG, LONG + " end"]
    for group in range(12):
        words = [f"g{group}w{rng.randrange(400)}" for _ in range(rng.randrange(20, 160))]
        if group % 3 == 0:
            words += passage
        for _ in range(8):
            copy = list(words)
            for _ in range(rng.randrange(0, max(1, len(words) // 12))):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += texts[9:15]
    rows = [(k * 3 % 401, text, f"s{k % 4}" if k % 7 else None) for k, text in enumerate(texts)]
    return rows + [rows[20], rows[20], (None, texts[30], "s1"), (None, "alone and without any id at all here", None)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*row, 1, "clash") for row in corpus()]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n bigint, kept string").repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, source string, n bigint, kept string")


def ordered(rows) -> list[tuple]:
    return sorted(map(tuple, rows), key=repr)


def test_jaccard_groups_equal_all_pairs(docs):
    got = jaccard.jaccard_groups(docs).drop("text_key").collect()
    assert ordered(got) == ordered(brute.jaccard([row[:2] for row in corpus()]))


def test_jaccard_links_across_every_list_and_block(spark):
    rng = random.Random(9)
    base = [[f"b{g}x{k}" for k in range(60)] for g in range(3)]
    rows = []
    for k in range(240):  # many sets at the border of linking, in few large lists
        words = list(base[k % 3])
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(60)] = f"n{rng.randrange(40)}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = jaccard.jaccard_groups(df).drop("text_key").collect()
    assert ordered(got) == ordered(brute.jaccard(rows))


def test_one_of_each_group_stays(docs):
    rows = corpus()
    kept = jaccard.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = collections.Counter(row["doc_id"] for row in kept.collect())
    want = collections.Counter()
    for key, n, component in brute.jaccard([row[:2] for row in rows]):
        if n == 0:
            want[key] += 1
        elif key == component:
            want[key] = 1
    assert ids == want


def test_unlinked_rows_stay_whatever_their_ids(spark):
    texts = {name: " ".join(f"{name}{k}" for k in range(30)) for name in "abcdefg"}
    rows = [(None, texts["a"]), (None, texts["b"]), (None, texts["c"]), (None, texts["c"] + " end"), (5, texts["d"]), (5, texts["e"])]
    rows += [(6, texts["f"]), (6, texts["f"]), (None, texts["g"]), (9, texts["g"]), (8, texts["g"] + " end"), (None, None), (None, " ")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    kept = [(r.doc_id, r.text) for r in jaccard.keep_one_of_each(df).collect()]
    third = [row for row in kept if row in rows[2:4]]
    assert len(third) == 1
    rest = [row for row in kept if row not in third]
    assert ordered(rest) == ordered([*rows[:2], *rows[4:7], rows[10], *rows[11:]])


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}


def plain_quality(text: str | None) -> tuple:
    text = text or ""
    words = brute.WORD.findall(text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    counts = collections.Counter(windows)
    covered = {k + d for k, w in enumerate(windows) if counts[w] > 1 for d in range(3)}
    seen, duplicates = set(), 0
    for line in text.split("\n"):
        if brute.WORD.search(line):
            duplicates += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    raw = text.encode()
    verdict = "ok"
    if raw:
        press = zstandard.ZstdCompressor(level=3)
        bands = quality.Bands()
        ratio = len(press.compress(raw)) / len(raw)
        low, high = ([(0, math.inf)] + [b[1:] for b in bands.whole if b[0] <= len(raw)])[-1]
        pieces = [raw[k : k + 4096] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
        pieces = [p for p in pieces if len(p) >= 1024]
        bad = sum(len(p) for p in pieces if not 0.18 <= len(press.compress(p)) / len(p) <= 0.85)
        if ratio < low:
            verdict = "repetitive"
        elif ratio > high:
            verdict = "incompressible"
        elif pieces and bad / sum(map(len, pieces)) > 0.3:
            verdict = "bad_chunks"
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered), failed, verdict, not failed and verdict == "ok"


def test_quality_equals_plain_rules(spark, docs):
    rng = random.Random(4)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(40)) for _ in range(220))
    half = " ".join(f"v{rng.randrange(10**6)}" for _ in range(1500)) + " " + "ab cd ef gh " * 680
    extra = [(900, noise, None), (901, "line one\n\nline one\n  \n" * 40, None), (902, half, None), (903, "# $ a b c a b c" * 9, None)]
    more = spark.createDataFrame([(*row, 1, "x") for row in extra], docs.schema)
    rows = quality.quality_report(docs.union(more)).collect()
    texts = collections.defaultdict(list)
    for key, text, _ in corpus() + extra:
        texts[key].append(plain_quality(text))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "verdict", "kept")
    got = collections.defaultdict(list)
    for row in rows:
        got[row.doc_id].append(tuple(row[name] for name in names))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}
    assert {"repetitive", "incompressible", "bad_chunks", "ok"} == {row.verdict for row in rows}
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.count() == sum(x[-1] for row in corpus() for x in [plain_quality(row[1])])


def test_decontamination_equals_all_windows(spark):
    rng = random.Random(6)
    vocabulary = [f"v{k}" for k in range(150)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice((3, 12, 20, 33))))) for k in range(25)]
    items += [(90, None), (91, " "), (92, items[0][1]), (93, "solo")]
    rows: list[tuple] = [(0, None), (1, ""), (2, "solo"), (3, LONG)]
    for k in range(4, 160):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 80))]
        item = rng.choice(items[:25])[1].split()
        for _ in range(rng.randrange(0, max(2, len(item) // 4))):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        if rng.random() < 0.2:
            item.insert(rng.randrange(len(item)), "new")
        at = rng.randrange(len(words))
        rows.append((k, " ".join(words[:at] + item + words[at:]).upper() if k % 5 == 0 else " ".join(words[:at] + item + words[at:])))
    settings = decontaminate.Settings()

    def edits(a: list[str], b: list[str]) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = set()
    for key, text in rows:
        if key == 3:
            continue
        words = [w for w in brute.WORD.findall((text or "").translate(brute.FOLD))]
        for item, wanted in items:
            target = (wanted or "").split()
            limit = settings.limit(len(target))
            if target and len(words) >= len(target) - limit and words:
                best = min(edits(words[s : s + len(target)], target) for s in range(max(1, len(words) - len(target) + 1)))
                if best <= limit:
                    want.add((key, item))
    docs = spark.createDataFrame([(k, t, 1) for k, t in rows], "doc_id bigint, text string, edits bigint")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontaminate.contaminated(docs, benchmark).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.97 * len(want) and len(found) == len(got)
    exact = {(k, i) for k, i in want for t in [dict(rows)[k].translate(brute.FOLD)] if f" {dict(items)[i]} " in f" {t} "}
    assert exact <= got
    clean = decontaminate.keep_clean(docs, benchmark)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in got}
    assert decontaminate.contaminated(docs, benchmark.filter("false")).count() == 0


def test_lsh_recall_at_the_edit_limit():
    rng, settings = random.Random(2), decontaminate.Settings()
    for length in (12, 25, 50):
        items = [[rng.randrange(1, 2000) for _ in range(length)] for _ in range(60)]
        index = decontaminate.Index.of([(k, " ".join(f"w{x}" for x in item)) for k, item in enumerate(items)], settings)
        hit = 0
        for k, item in enumerate(items):
            changed = list(item)
            for at in rng.sample(range(length), settings.limit(length)):
                changed[at] = 5000
            coded = np.array([index.symbols.get(b"w%d" % x, 0) for x in [6000] * 4 + changed + [6000] * 4])
            hit += any(found[0] == k for found in index.hits(coded))
        assert hit >= 0.95 * len(items)


@pytest.mark.parametrize("kind", ["substitutions", "insertions and deletions"])
@pytest.mark.parametrize("length", [59, 65, 100, 200, 400, 800])
def test_lsh_recall_of_long_items(length, kind):
    rng, settings = random.Random(length), decontaminate.Settings()
    items = [[rng.randrange(1, 2000) for _ in range(length)] for _ in range(30)]
    index = decontaminate.Index.of([(k, " ".join(f"w{x}" for x in item)) for k, item in enumerate(items)], settings)
    limit, hit = settings.limit(length), 0
    for k, item in enumerate(items):
        changed: list = list(item)
        if kind == "substitutions":
            for at in rng.sample(range(length), limit):
                changed[at] = 5000
        else:
            for at in sorted(rng.sample(range(length), limit // 2), reverse=True):
                del changed[at]
            for _ in range(limit // 2):
                changed.insert(rng.randrange(len(changed) + 1), 5000)
        coded = np.array([index.symbols.get(b"w%d" % x, 0) for x in [6000] * 40 + changed + [6000] * 40])
        found = {owner: rest for owner, *rest in index.hits(coded)}
        hit += k in found
        if k in found:
            start, size, edits = found[k]
            assert size == length and edits <= limit
            assert decontaminate.distance(coded[start : start + size].tolist(), index.items[k][1], limit) == edits
    assert hit >= 0.95 * len(items)


def test_long_items_take_their_best_window_and_short_texts():
    rng, settings = random.Random(12), decontaminate.Settings()
    item = [f"w{rng.randrange(300)}" for _ in range(150)]
    index = decontaminate.Index.of([(1, " ".join(item))], settings)
    for _ in range(20):
        words = [w for w in item if rng.random() > 0.06]
        for _ in range(rng.randrange(8)):
            words.insert(rng.randrange(len(words)), "new")
        for pad in (0, 30):
            coded = np.array([index.symbols.get(w.encode(), 0) for w in ["x"] * pad + words + ["x"] * pad])
            far = [decontaminate.distance(coded[s : s + 150].tolist(), index.items[0][1], 150) for s in range(max(1, len(coded) - 149))]
            want = [(0, far.index(min(far)), min(150, len(coded)), min(far))] if min(far) <= settings.limit(150) else []
            assert index.hits(coded) == want


def test_mixing_meets_targets(spark, docs):
    rows = [(k, " ".join(["w"] * (1 + k % 37)), f"s{k % 5}" if k % 11 else None) for k in range(6000)] + corpus()
    df = spark.createDataFrame([(*row, 1) for row in rows], "doc_id bigint, text string, source string, size bigint").repartition(7)
    out = mixing.mix_report(df).collect()
    assert len(out) == len(rows)
    sizes, caps = collections.Counter(), {}
    for _, text, source in rows:
        sizes[source] += len(brute.WORD.findall(text or ""))
    ranked = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(ranked)}
    total = 1.5 * sum(sizes.values())
    while True:
        free = [s for s in ranked if s not in caps]
        level = (total - sum(caps.values())) / sum(weights[s] for s in free)
        above = {s: 2.0 * sizes[s] for s in free if weights[s] * level > 2 * sizes[s]}
        if not above:
            break
        caps |= above
    want = {s: caps.get(s, weights[s] * level) for s in ranked}
    by_size = collections.defaultdict(set)
    for row in out:
        assert row["taken"] <= 2 * row["size"] and (row["size"] == 0 or row["taken"] % row["size"] == 0)
        by_size[round(row["target"], 6)].add(row["source_size"])
    assert {k: sorted(v) for k, v in by_size.items()} == {
        round(want[s], 6): sorted({sizes[t] for t in ranked if round(want[t], 6) == round(want[s], 6)}) for s in ranked
    }
    taken = collections.Counter()
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns
    for row in mixed.collect():
        taken[row["source"]] += len(brute.WORD.findall(row["text"] or ""))
    largest = max(len(brute.WORD.findall(text or "")) for _, text, _ in rows)
    for source in ranked:
        own = max(len(brute.WORD.findall(t or "")) for _, t, s in rows if s == source)
        assert abs(taken[source] - want[source]) <= min(2 * own, 2 * largest)
    assert sum(taken.values()) == sum(row["taken"] for row in out)
    assert ordered(mixing.mix_report(df.repartition(3)).collect()) == ordered(out)


def test_pivot_keeps_mass_and_expectation():
    units = [(size, 0.3) for size in (1, 2, 3, 5, 8, 13)]
    totals = np.zeros(len(units))
    for seed in range(3000):
        out = mixing.pivot(units, [seed * 100 + k for k in range(len(units))])
        assert sum(0 < x < 1 for x in out) <= 1
        assert abs(sum(m * x for (m, _), x in zip(units, out)) - 0.3 * 32) < 1e-6
        totals += out
    assert np.all(abs(totals / 3000 - 0.3) < 0.05)


def test_lookup_table_equals_turn_by_turn(spark):
    import hashlib

    for count, slots in ((1, 5), (3, 7), (10, 211)):
        names = maglev.shard_names(count)
        size = maglev.table_size(count, slots)
        number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        owner: dict[int, str] = {}
        places, turn = [0] * count, 0
        while len(owner) < size:
            k = turn % count
            while (slot := (number(f"start:{names[k]}") % size + places[k] * (number(f"step:{names[k]}") % (size - 1) + 1)) % size) in owner:
                places[k] += 1
            owner[slot] = names[k]
            turn += 1
        assert {r.slot: r.shard for r in maglev.lookup_table(spark, names, slots).collect()} == owner
    shares = collections.Counter(owner.values())
    assert max(shares.values()) - min(shares.values()) <= 1


def test_sharding_places_every_row(spark, docs, none):
    names = maglev.shard_names(5)
    slots = maglev.table_size(5)
    table = maglev.lookup_table(spark, names)
    placed = maglev.assign(docs.withColumn("shard", F.lit(1)), table, "doc_id", slots)
    assert placed.columns == [*docs.columns, "slot", "shard"] and placed.count() == docs.count()
    assert placed.groupBy("doc_id").agg(F.count_distinct("shard").alias("n")).filter("n != 1").count() == 0
    fewer = maglev.assign(docs, maglev.lookup_table(spark, names[:-1], slots), "doc_id", slots).select("doc_id", F.col("shard").alias("new"))
    moved = placed.join(fewer.distinct(), placed["doc_id"].eqNullSafe(fewer["doc_id"])).filter("shard != new and shard != 'shard-0004'").count()
    assert moved < 0.35 * docs.count()
    assert maglev.assign(none, table, "doc_id", slots).count() == 0


def test_walks_of_several_lengths_and_distances_within_a_limit():
    rng = np.random.default_rng(5)
    windows, seeds = rng.integers(0, 6, (40, 17)), np.arange(40)
    steps = np.sort(rng.integers(0, 60, 40))[::-1]
    whole, some = decontaminate.embed(windows, 60, seeds), decontaminate.embed(windows, steps, seeds)
    assert np.array_equal(some, np.where(np.arange(int(steps.max())) < steps[:, None], whole[:, : int(steps.max())], 0))
    for _ in range(300):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).tolist() for _ in range(2))
        edits = decontaminate.whole_distance(a, b)
        assert [decontaminate.distance(a, b, k) for k in range(13)] == [edits if edits <= k else None for k in range(13)]


@pytest.mark.parametrize("chunk_bytes", [500, 12 << 20])
def test_suffix_tree_base_scores(spark, docs, chunk_bytes):
    rows = suffix_tree.scored(docs, settings=suffix_tree.Settings(chunk_bytes=chunk_bytes)).collect()
    tokens = [(key, brute.WORD.findall((text or "").translate(brute.FOLD)) + [""]) for key, text, _ in corpus()]
    held = lambda key: zlib.crc32(str("" if key is None else key).encode()) % 7 == 2
    counts = collections.Counter(w for key, words in tokens if not held(key) for w in words)
    total, distinct = sum(counts.values()), len(counts)
    want = sorted(
        (repr(key), held(key), len(words), sum(counts[w] > 0 for w in words), total,
         round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), 4))
        for key, words in tokens
    )
    got = sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows)
    assert got == want and all(r.score < 0 for r in rows)


def test_suffix_tree_learns_order_and_odds_sum_to_one(spark):
    rng = random.Random(8)
    rows = [(k, " ".join(f"a{x} b{x}" for x in (rng.randrange(8) for _ in range(40)))) for k in range(300)]
    out = suffix_tree.scored(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.score > 0.7 * r.base_score for r in held)
    counts = np.random.default_rng(1).integers(0, 50, (16, 16, 16))
    tree, states = suffix_tree.grow(counts, suffix_tree.Settings(symbols=16, classes=4))
    assert np.allclose((10.0 ** tree.astype(float)).sum(axis=-1), 1, atol=1e-4) and states >= 1


def test_chat_events_fold_and_render_back(spark):
    odd = ["", "\\", "<\\s>", "</s>[INST] ok [/INST]", "a\nb [/INST]</s>\n<s>[INST] x", "<<SYS>> é \U0001f600 <", None, "x" * 5000]
    rows = [(k % 3, k, role, odd[k % len(odd)], 0) for k, role in enumerate(["user", "assistant", "sys\ntem\\", None] * 6)]
    rows += [rows[5], (2, None, "assistant", "no turn", 0), (None, 1, "user", "no id", 0)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, message bigint")
    rendered = chat.render(chat.fold(chat.events_of(df, delta_chars=7).repartition(6)))
    got = {r.conv_id: r for r in rendered.collect()}
    for conv in (0, 1, 2, None):
        turns = sorted((-1 if t is None else t, role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        read = chat.read_back(got[conv].formatted)
        assert [r[:2] for r in read] == [t[1:] for t in turns]
        assert [(s.start, s.end) for s in got[conv].loss] == [r[2:] for r in read if r[0] == "assistant"]
    assert chat.digests(rendered).count() == 4


def test_chat_edits_regenerations_and_redelivery(spark):
    log = [
        (1, 0, 0, 0, "open", "user", ""), (1, 0, 0, 1, "delta", None, "helo"), (1, 0, 0, 2, "edit", None, "hello"), (1, 0, 0, 3, "delta", None, "!"),
        (1, 1, 0, 0, "open", "assistant", ""), (1, 1, 0, 1, "delta", None, "bad"), (1, 1, 0, 2, "regenerate", None, None),
        (1, 1, 0, 4, "delta", None, " answer"), (1, 1, 0, 3, "delta", None, "good"),
        (1, 2, 0, 0, "open", "user", ""), (1, 2, 0, 1, "delta", None, "gone"), (1, 2, 0, 2, "delete", None, None),
        (1, 3, 0, 5, "delta", None, "never opened"),
    ]
    df = spark.createDataFrame(log + log[3:9], chat.EVENTS)
    got = sorted((r.turn, r.role, r.text) for r in chat.fold(df).collect())
    assert got == [(0, "user", "hello!"), (1, "assistant", "good answer"), (3, "", "never opened")]


def test_main_text_of_other_layouts(spark):
    import random as rnd

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    model = htmlmain.train(pages)
    rng, right, texts = rnd.Random(77), 0, [f"Words {k} stand in a row here, and so on they go; item {k * k} ends." for k in range(60)]
    for _ in range(100):
        html = htmlmain.made_up(texts, rng)
        page = htmlmain.Page(html.replace("@MAIN@", "").replace("@CUT@", ""))
        want = htmlmain.text_of(page, htmlmain.marked_labels(html) > 0)
        right += want == htmlmain.extract([html.replace("@MAIN@", "").replace("@CUT@", "")], model)[0]
    assert right >= 90
    odd = [(0, "u", None, 1), (1, "u", "", 1), (2, "u", "<article><p>a &amp; b\n c<br>d</p><p>e", 1), (3, None, "<p>" * 3000, 1), (3, None, "no tags", 1)]
    df = spark.createDataFrame(odd, "page_id bigint, url string, html string, text bigint")
    got = {r.page_id: r.text for r in htmlmain.main_text(df, model=model).collect()}
    assert got[0] == got[1] == "" and got[2] == "a & b c d e"
    assert htmlmain.main_text(df.filter("false")).count() == 0


def test_decoding_never_returns_to_a_cut_subtree():
    rng = np.random.default_rng(3)
    for _ in range(200):
        parents = [-1] + [int(rng.integers(0, k)) for k in range(1, 9)]
        odds = rng.normal(0, 2, 9)
        main = htmlmain.decode(parents, odds)
        yes, no = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)

        def allowed(bits: list[int]) -> bool:
            for k in range(1, 9):
                above, p = [], parents[k]
                while p >= 0:
                    above.append(bits[p])
                    p = parents[p]
                if bits[k] and above and not above[0] and any(above):
                    return False
            return True

        best = max(
            sum(yes[k] if b >> k & 1 else no[k] for k in range(9)) for b in range(512) if allowed([b >> k & 1 for k in range(9)])
        )
        assert allowed([int(m) for m in main]) and abs(sum(np.where(main, yes, no)) - best) < 1e-9


def test_empty_tables(spark, none):
    benchmark = spark.createDataFrame([(1, "some item text")], "item_id bigint, text string")
    assert jaccard.jaccard_groups(none).count() == 0 and jaccard.keep_one_of_each(none).count() == 0
    assert quality.quality_report(none).count() == 0
    assert decontaminate.contaminated(none, benchmark).count() == 0
    assert mixing.mix_report(none).count() == 0 and mixing.mix(none).count() == 0
    assert suffix_tree.scored(none).count() == 0
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.digests(chat.render(chat.fold(chat.events_of(empty)))).count() == 0
