"""Fetch results as WARC records, and archives looked up by URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlframe.functions import urls as U
from crawlframe.functions import warc as W
from crawlframe.functions.bodies import body_text as body_text_sql
from crawlframe.operators.urls import parse_urls
from crawlframe.sources import warc


def warc_records(fetch_results: DataFrame) -> DataFrame:
    """Every fetch, whatever its status, as one ``response`` record. No shuffle."""
    rest = [c for c in fetch_results.columns if c == "page_id"]
    return fetch_results.selectExpr(
        *rest,
        f"concat({W.status_line('http_version', 'status')}, {W.header_block('headers')}) AS _head",
        "cast(octet_length(_head) + octet_length(body) AS bigint) AS content_length",
        "concat('urn:uuid:', uuid()) AS record_id",
        "url AS target_uri",
        f"{W.warc_date('start')} AS warc_date",
        f"""concat(encode({W.record_head('record_id', 'url', 'content_length', 'warc_date')}, 'UTF-8'),
            encode(_head, 'UTF-8'), body, encode('\\r\\n\\r\\n', 'UTF-8')) AS record""",
    ).drop("_head")


def body_text(fetch_results: DataFrame) -> DataFrame:
    """Length of each body as text, bad bytes replaced."""
    return fetch_results.selectExpr("page_id", f"length({body_text_sql('body')}) AS n_chars")


def with_archive_key(df: DataFrame, url: str = "url") -> DataFrame:
    """Add ``key``, under which an archive holds the captures of a URL.

    The host's labels come last first, then ``)``, path and query: a domain's
    URLs lie together, ordered by path, and its subdomains beside it. Like in
    the frontier, scheme, port, user information and fragment play no part. A
    URL that is no good http(s) one is its own key, after all others.
    """
    parsed = parse_urls(df, url, out="_u")
    return parsed.withColumn("key", F.expr(U.archive_key("_u", f"`{url}`"))).drop("_u")


def archive_records(fetch_results: DataFrame) -> DataFrame:
    """:func:`warc_records` with their ``key``, for :func:`crawlframe.sources.warc.write_sorted`."""
    return with_archive_key(warc_records(fetch_results), "target_uri")


def captures(spark: SparkSession, path: str, urls: Sequence[str], payload: bool = True) -> DataFrame:
    """All archived captures of a few URLs; only members under their keys are read."""
    warc.register(spark)
    asked = with_archive_key(spark.createDataFrame([(u,) for u in urls], "url string"))
    keys = sorted({r.key for r in asked.select("key").collect() if r.key is not None})
    archive = spark.read.format("warc").option("payload", payload).load(path)
    return archive.filter(F.col("key").isin(keys) if keys else F.lit(False))


def captures_of(wanted: DataFrame, path: str, url: str = "url", payload: bool = True) -> DataFrame:
    """All archived captures of the URLs in a table, of any size: each distinct key is looked up once.

    The index, which is far smaller than the archive, is joined with the keys;
    then only the members found are read. Both sides of the join are distinct
    per key and member, so a URL that is asked for very often is one row.
    """
    spark = wanted.sparkSession
    warc.register(spark)
    keys = with_archive_key(wanted.select(url), url).select("key").distinct()
    index = spark.read.format("warc").option("index", "true").load(path)
    return warc.fetch_members(index.join(keys, "key", "left_semi"), path, payload)


def captures_below(
    spark: SparkSession, path: str, domain: str, prefix: str = "/", subdomains: bool = False, payload: bool = True
) -> DataFrame:
    """All archived captures of a domain whose path and query start with ``prefix``.

    ``domain`` is a name in ASCII form or an address. ``prefix`` is compared as
    stored, percent-encoded. With ``subdomains`` the
    same path below every subdomain counts too; the range of keys is the whole
    domain's then, and the path is tested on the keys found.
    """
    warc.register(spark)
    archive = spark.read.format("warc").option("payload", payload).load(path)
    labels = domain.lower().split(".")
    host = domain if labels[-1].isdigit() else ",".join(reversed(labels))
    if not subdomains:
        return archive.filter(F.col("key").startswith(f"{host}){prefix}"))
    inside = F.col("key").startswith(host) & F.substring("key", len(host) + 1, 1).isin(",", ")")
    return archive.filter(inside & F.expr("substring(key, instr(key, ')') + 1)").startswith(prefix))
