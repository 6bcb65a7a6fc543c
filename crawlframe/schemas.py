"""Table schemas. Nothing is inferred: every reader names one of these."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXTS = ("Sitemap", "SitemapLink", "Feed", "FeedLink", "Other", "Img", "Style", "Script")

PAGES = "page_id bigint, url string, html string"

FETCH_RESULTS = (
    "url string, authority string, start timestamp, duration_us bigint, status int, "
    "http_version string, headers array<struct<name:string,value:string>>, "
    "body binary, context string"
)

FETCH_LOG = "authority string, event_id bigint, start timestamp, duration_us bigint, status int"

OUTLINKS = (
    "page_id bigint, pos int, base_url string, href string, url string, rel string, context string"
)

ROBOTS_FETCH = "authority string, start timestamp, status int, body string"

ROBOTS_RULES = (
    "authority string, access string, updated timestamp, "
    "rules array<struct<rx:string,len:int,allow:boolean,prefix:string,wild:boolean>>, "
    "sitemaps array<string>"
)

DOMAIN = "domain_id bigint, name string, batch_id bigint"

URL = (
    "url_id bigint, domain_id bigint, path string, query string, context string, "
    "crawl_depth smallint, crawl_priority float, http_etag string, "
    "http_last_modified timestamp, batch_id bigint"
)

REJECTS = "stage string, key string, reason string"

RETRIES = "url string, retry_s int, next_attempt timestamp"

WARC_RECORDS = (
    "record_id string, target_uri string, warc_date string, content_length bigint, record binary"
)

PARSED_URL = (
    "struct<scheme:string,authority:string,domain:string,path:string,query:string,"
    "fragment:string,url:string,error:string>"
)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """A table without rows, of known size to the optimizer."""
    fields = T.StructType.fromDDL(schema).fields
    return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
