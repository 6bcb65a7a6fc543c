"""The operators' queries, with DuckDB equivalents where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlframe.llm import align, chat, decontaminate, htmlmain, jaccard, licenses, maglev, mixing, quality, resample
from crawlframe.llm import secrets, suffix_tree, warcsource
from crawlframe.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(table(spark, sf_dir, "documents"))


def op3_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scored(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op7_quality_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.main_text(table(spark, sf_dir, "pages"))


CONTROLLED = "</s>[INST] ok [/INST]"


def op5_chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", CONTROLLED), (-7, 1, "assistant", CONTROLLED)], rows.schema)
    return chat.digests(chat.render(chat.fold(chat.events_of(rows.union(more)))))


def op6_mixing_pivotal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_decontamination_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_sharding_maglev(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = maglev.shard_names()
    slots = maglev.table_size(len(names))
    placed = maglev.assign(table(spark, sf_dir, "documents"), maglev.lookup_table(spark, names, slots), "doc_id", slots)
    return placed.select("doc_id", "slot", "shard")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_warc_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warcsource.archived(table(spark, sf_dir, "pages"))


def _sql_escaped(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for word in chat.CONTROL:
        text = f"replace({text}, '{word}', '{word[0]}\\{word[1:]}')"
    return text


OP5_SQL = f"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '{CONTROLLED}'
    UNION ALL SELECT -7, 1, 'assistant', '{CONTROLLED}'
)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    sum({len(chat.OPEN + chat.MID + chat.CLOSE)} + length(replace({_sql_escaped("role")}, chr(10), '\\n'))
        + length({_sql_escaped("text")}))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

# The fill is one recursion over the turns; "taken" marks claimed slots.
OP9_SQL = f"""
WITH RECURSIVE orders AS (
    SELECT k AS at, printf('shard-%04d', k) AS name,
        ('0x' || substr(md5('start:' || printf('shard-%04d', k)), 1, 8))::BIGINT % {maglev.table_size(maglev.SHARDS)} AS first,
        ('0x' || substr(md5('step:' || printf('shard-%04d', k)), 1, 8))::BIGINT % ({maglev.table_size(maglev.SHARDS)} - 1) + 1 AS step
    FROM range({maglev.SHARDS}) AS r(k)
), turns(t, slot, taken) AS (
    SELECT -1::BIGINT, -1::BIGINT, list_transform(range({maglev.table_size(maglev.SHARDS)}), lambda x: false)
    UNION ALL
    SELECT n.t, n.slot, list_transform(n.taken, lambda x, i: x OR i = n.slot + 1)
    FROM (
        SELECT turns.t + 1 AS t, turns.taken AS taken,
            list_filter(
                list_transform(range({maglev.table_size(maglev.SHARDS)}), lambda j: (o.first + j * o.step) % {maglev.table_size(maglev.SHARDS)}),
                lambda p: NOT turns.taken[p + 1]
            )[1] AS slot
        FROM turns JOIN orders AS o ON o.at = (turns.t + 1) % {maglev.SHARDS}
        WHERE turns.t < {maglev.table_size(maglev.SHARDS)} - 1
    ) AS n
), keyed AS (
    SELECT doc_id, ('0x' || substr(md5('key:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
        % {maglev.table_size(maglev.SHARDS)} AS slot
    FROM documents
)
SELECT doc_id, keyed.slot, o.name AS shard
FROM keyed JOIN turns ON turns.slot = keyed.slot JOIN orders AS o ON o.at = turns.t % {maglev.SHARDS}
"""

# CRC-32 byte by byte over each distinct word, with the table that its polynomial gives.
OP12_SQL = f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS t
), d AS (
    SELECT row_number() OVER () AS row, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws
    FROM documents
), dw AS (SELECT row, unnest(ws) AS w FROM d),
bw AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark
), h AS (SELECT w, hex(encode(w)) AS x FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
v AS (
    SELECT w, xor(4294967295, list_reduce(
        list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(crc.t[xor(c, b) % 256 + 1], c >> 8), 4294967295)) % {resample.BUCKETS} AS b
    FROM h, crc
), dc AS (SELECT b, count(*) AS s FROM dw JOIN v USING (w) GROUP BY b),
bc AS (SELECT b, count(*) AS t FROM bw JOIN v USING (w) GROUP BY b),
g AS (
    SELECT r.b, floor(1000 * ln(
        (coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM dc)::DOUBLE + {resample.BUCKETS})
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM bc)::DOUBLE + {resample.BUCKETS}))))::BIGINT AS gain
    FROM range({resample.BUCKETS}) AS r(b) LEFT JOIN dc USING (b) LEFT JOIN bc USING (b)
), total AS (SELECT row, sum(gain)::BIGINT AS gain FROM dw JOIN v USING (w) JOIN g USING (b) GROUP BY row),
scored AS (
    SELECT d.row, doc_id, len(ws)::BIGINT AS n_features,
        CASE WHEN len(ws) = 0 THEN 0 ELSE (gain - ((gain % len(ws)) + len(ws)) % len(ws)) // len(ws) END::BIGINT AS weight,
        floor(-1000 * ln(-ln((('0x' || substr(sha256('{resample.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
            / 4294967296)))::BIGINT AS noise
    FROM d LEFT JOIN total USING (row)
), fit AS (
    SELECT row, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= {resample.LEAST_WORDS}
)
SELECT doc_id, n_features, weight, weight + noise AS score,
    CASE WHEN place <= {resample.PERCENT} * n // 100 THEN place END AS rank
FROM scored LEFT JOIN fit USING (row)
"""

# SHA-1 digits in fours of ten, each turned into eight digits of base 32.
OP13_SQL = """
WITH p AS (
    SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h,
        min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
    FROM pages
)
SELECT page_id, payload_bytes,
    list_reduce(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        ((('0x' || substr(h, 10 * (k // 8) + 1, 10))::BIGINT >> (35 - 5 * (k % 8))) % 32 + 1)::INT, 1)),
        lambda a, b: a || b) AS payload_digest,
    CASE WHEN page_id <> first OR (page_id IS NULL AND first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id <> first OR (page_id IS NULL AND first IS NOT NULL) THEN first END AS refers_to
FROM p
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_license_scan": op2_license_scan,
    "op3_suffix_tree_scores": op3_suffix_tree_scores,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op5_chat_events": op5_chat_events,
    "op6_mixing_pivotal": op6_mixing_pivotal,
    "op7_quality_bands": op7_quality_bands,
    "op8_decontamination_cgk": op8_decontamination_cgk,
    "op9_sharding_maglev": op9_sharding_maglev,
    "op10_main_text": op10_main_text,
    "op11_token_alignment": op11_token_alignment,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_warc_source": op13_warc_source,
}

ORACLE: dict[str, str] = {
    "op5_chat_events": OP5_SQL, "op9_sharding_maglev": OP9_SQL,
    "op12_importance_resampling": OP12_SQL, "op13_warc_source": OP13_SQL,
}
