"""DuckDB SQL that gives the same rows as the registered queries, from the same tables."""

from __future__ import annotations

PAGES = r"""
p AS (SELECT page_id, url, html,
        regexp_extract(url, '^([a-z]+)://', 1) AS scheme,
        regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS authority,
        regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path,
        CASE WHEN regexp_matches(url, '^[^#]*\?') THEN regexp_extract(url, '^[^?#]*\?([^#]*)', 1) END AS query,
        CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) END AS fragment
      FROM pages),
a0 AS (SELECT page_id, scheme, authority, url AS base,
        unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
        generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS pos FROM p),
a AS (SELECT *, replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS path,
        scheme || '://' || authority || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS url
      FROM a0)"""

KNOWN = PAGES + r""",
known AS (SELECT DISTINCT authority AS name, path, CAST(NULL AS VARCHAR) AS query
          FROM a WHERE base LIKE 'http:%'),
batch AS (SELECT DISTINCT authority AS name, path, CAST(NULL AS VARCHAR) AS query FROM a),
fresh AS (SELECT b.* FROM batch b WHERE NOT EXISTS (SELECT 1 FROM known k
          WHERE k.name = b.name AND k.path = b.path AND k.query IS NOT DISTINCT FROM b.query))"""

ROBOTS = r""",
r AS (SELECT DISTINCT authority,
        CASE length(authority) % 5 WHEN 0 THEN 'Unavailable' WHEN 1 THEN 'Unreachable' ELSE 'Ok' END AS access
      FROM p),
rule(rx, len, allow) AS (VALUES ('^/de', 3, false), ('^/der', 4, true), ('^/.*\.html\z', 8, false))"""


def gated(source: str) -> str:
    """Rows of ``source`` (authority, pq, …) with their robots decision."""
    return f"""SELECT {source}.*, CASE WHEN r.access = 'Unavailable' THEN 'Allowed'
        WHEN r.access = 'Unreachable' THEN 'Retry'
        WHEN (SELECT arg_max(allow, len) FROM rule WHERE regexp_matches({source}.pq, rx)) = false
        THEN 'Disallowed' ELSE 'Allowed' END AS decision
        FROM {source} JOIN r USING (authority)"""


LOG = PAGES + r""",
log AS (SELECT p.authority, e.event_id, epoch_us(e.ts) AS at_us,
        CAST(greatest(round(e.value * 10000), 0) AS BIGINT) AS duration_us,
        CASE e.event_type WHEN 'purchase' THEN 404 WHEN 'error' THEN 503 ELSE 200 END AS status
      FROM events e JOIN p ON p.page_id = e.user_id)"""

POLITE = LOG + r""",
ok AS (SELECT authority, event_id, at_us,
        CAST(sum(greatest(duration_us, 150000)) OVER w // count(*) OVER w AS BIGINT) AS avg_us
      FROM log WHERE status = 200
      WINDOW w AS (PARTITION BY authority ORDER BY at_us, event_id ROWS 9 PRECEDING)),
polite AS (SELECT l.authority, l.event_id, l.at_us,
        last_value(o.avg_us IGNORE NULLS) OVER v AS avg_us,
        last_value(o.at_us + 3 * o.avg_us IGNORE NULLS) OVER v AS until_us
      FROM log l LEFT JOIN ok o USING (authority, event_id)
      WINDOW v AS (PARTITION BY l.authority ORDER BY l.at_us, l.event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
last_polite AS (SELECT authority, arg_max(avg_us, (at_us, event_id)) AS avg_us,
        arg_max(until_us, (at_us, event_id)) AS until_us
      FROM polite WHERE until_us IS NOT NULL GROUP BY authority)"""

STATE = LOG + r""",
acc AS (SELECT *, CASE WHEN status = 200 THEN 'Ok' WHEN status BETWEEN 400 AND 499 THEN 'Unavailable'
                  ELSE 'Unreachable' END AS access FROM log),
isle AS (SELECT *, count(CASE WHEN access <> 'Unreachable' THEN 1 END)
                   OVER (PARTITION BY authority ORDER BY at_us, event_id) AS grp FROM acc),
run AS (SELECT *, min(CASE WHEN access = 'Unreachable' THEN at_us END)
                  OVER (PARTITION BY authority, grp) AS first_tried FROM isle),
fin AS (SELECT authority, arg_max(access, (at_us, event_id)) AS access, max(at_us) AS updated_us,
        arg_max(CASE WHEN access = 'Unreachable' THEN first_tried ELSE -1 END, (at_us, event_id)) AS f
      FROM run GROUP BY authority),
aged AS (SELECT *, CASE WHEN updated_us > n THEN 1 ELSE (n - updated_us) // 1000000 END AS age FROM (
        SELECT *, (1706659200 + 86400 * 20 * (length(authority) % 3)) * 1000000 AS n FROM fin))
SELECT authority, access, updated_us, nullif(f, -1) AS first_tried_us,
       CASE WHEN age <= 86400 THEN 'reuse' WHEN access = 'Unreachable' AND age > 30 * 86400 THEN 'unavailable'
            ELSE 'fetch' END AS verdict FROM aged"""

WITH_ROOTS = r""",
wr AS (SELECT url FROM pages UNION ALL SELECT DISTINCT scheme || '://' || authority || '/' FROM p)"""

SEEDS = r""",
seeds AS (SELECT DISTINCT authority, CASE WHEN length(authority) % 5 = 2
            THEN 'https://' || authority || '/sitemap_main.xml'
            ELSE scheme || '://' || authority || '/sitemap.xml' END AS url FROM p)"""

FETCH_HEAD = r"""(octet_length(encode('HTTP/1.1 200 OK' || chr(13) || chr(10)
    || 'content-type: text/html' || chr(13) || chr(10)
    || 'x-page: ' || page_id || chr(13) || chr(10)
    || 'x-page: ' || url || chr(13) || chr(10) || chr(13) || chr(10))))"""

LENGTH = f"CAST({FETCH_HEAD} + octet_length(encode(html)) AS BIGINT)"
DATE = r"strftime(make_timestamp((1704067200 + page_id) * 1000000), '%Y-%m-%dT%H:%M:%SZ')"

WAITING = KNOWN + r""",
w0 AS (SELECT name, path, query, row_number() OVER (PARTITION BY name ORDER BY path, query NULLS FIRST) AS rank
       FROM fresh),
w AS (SELECT *, count(*) OVER (PARTITION BY name) - rank + 1 AS turn FROM w0 WHERE rank <= 10)"""

ROUND = (
    KNOWN
    + ROBOTS
    + SEEDS
    + r""",
smap AS (SELECT authority, '/sitemap_' || page_id // 1000 || '.xml' AS pq, page_id, url FROM p),
fetched AS (
    SELECT 'p' AS kind, page_id, authority, path || coalesce('?' || query, '') AS pq FROM p
    UNION ALL SELECT DISTINCT 'r', -1, authority, '/' FROM p
    UNION ALL SELECT DISTINCT 's', page_id // 1000, authority, pq FROM smap
    UNION ALL SELECT DISTINCT 'i', -1, authority, '/sitemap_main.xml' FROM p WHERE length(authority) % 5 = 2),
fg AS ("""
    + gated("fetched")
    + r"""),
good AS (SELECT * FROM fg WHERE decision = 'Allowed'),
inlink AS (
    SELECT a.authority, a.path, CAST(NULL AS VARCHAR) AS query, 1 AS place, 'Other' AS context FROM a
      JOIN good g ON g.kind = 'p' AND g.page_id = a.page_id
    UNION SELECT p.authority, p.path, p.query, 0, 'SitemapLink' FROM p
      JOIN good g ON g.kind = 's' AND g.authority = p.authority AND g.page_id = p.page_id // 1000
    UNION SELECT authority, '/sitemap_0.xml', NULL, 0, 'Sitemap' FROM good WHERE kind = 'i'
    UNION SELECT s.authority, regexp_extract(s.url, '^[a-z]+://[^/]*(.*)$', 1), NULL, 2, 'Sitemap' FROM seeds s
      JOIN good g ON g.kind = 'r' AND g.authority = s.authority),
offer AS (SELECT authority, path, query, arg_min(context, place) AS context FROM inlink GROUP BY ALL),
links AS (SELECT *, path || coalesce('?' || query, '') AS pq FROM offer),
lg AS ("""
    + gated("links")
    + r""")
SELECT authority AS name, path, query, context FROM lg WHERE decision = 'Allowed' AND NOT EXISTS (
    SELECT 1 FROM known k WHERE k.name = lg.authority AND k.path = lg.path
    AND k.query IS NOT DISTINCT FROM lg.query)"""
)

TROUBLED = (
    PAGES
    + ROBOTS
    + r""",
fetched AS (SELECT page_id, url, authority, path || coalesce('?' || query, '') AS pq FROM p),
fg AS ("""
    + gated("fetched")
    + r"""),
good AS (SELECT * FROM fg WHERE decision = 'Allowed'),
links AS (SELECT DISTINCT a.authority, a.path AS pq, a.url FROM a JOIN good USING (page_id)),
lg AS ("""
    + gated("links")
    + """)"""
)

STREAM_FRONTIER = (
    PAGES
    + ROBOTS
    + r""",
fetched AS (SELECT page_id, authority, path || coalesce('?' || query, '') AS pq FROM p),
fg AS ("""
    + gated("fetched")
    + r"""),
links AS (SELECT DISTINCT a.authority, a.path, a.path AS pq FROM a JOIN fg USING (page_id)
          WHERE fg.decision = 'Allowed'),
lg AS ("""
    + gated("links")
    + r""")
SELECT authority AS name, path, CAST(NULL AS VARCHAR) AS query FROM lg WHERE decision = 'Allowed'"""
)

CAPTURES = (
    PAGES
    + f""",
c AS (SELECT url AS target_uri, authority, path, coalesce('?' || query, '') AS q, {DATE} AS warc_date, html AS body FROM p
      UNION ALL SELECT url, authority, path, coalesce('?' || query, ''), {DATE.replace("page_id)", "86400 + page_id)")},
             html || chr(10) FROM p)"""
)

def scored(base: str, hops: str, path: str, query: str, crowd: str) -> str:
    elements = f"len(list_filter(string_split({path}, '/'), lambda e: e <> ''))"
    parameters = f"len(list_filter(string_split(coalesce({query}, ''), '&'), lambda e: e <> ''))"
    return f"""{base} / (1::DOUBLE + 1.0::DOUBLE * {hops}) / (1::DOUBLE + 0.1::DOUBLE * {elements})
        / (1::DOUBLE + 0.3::DOUBLE * {parameters}) / (1::DOUBLE + 0.1::DOUBLE * ({crowd} / 100::DOUBLE))"""


GRAPH = (
    PAGES
    + r""",
n AS (SELECT count(*) AS n FROM pages),
jump AS (SELECT page_id, unnest([2 * page_id + 1, 2 * page_id + 2, page_id * page_id % n]) AS dest FROM p, n),
l AS (
    SELECT p.authority || p.path || coalesce('?' || p.query, '') AS src, p.authority AS site, p.scheme,
        a.authority AS name, a.path AS path, NULL::VARCHAR AS query, a.scheme AS to_scheme FROM a JOIN p USING (page_id)
    UNION ALL
    SELECT p.authority || p.path || coalesce('?' || p.query, ''), p.authority, p.scheme, t.authority, t.path, t.query, t.scheme
    FROM jump JOIN p USING (page_id) JOIN p AS t ON t.page_id = jump.dest),
k AS (SELECT *, name || path || coalesce('?' || query, '') AS dst FROM l
      WHERE NOT (src = name || path || coalesce('?' || query, '') AND scheme = to_scheme)),
e AS (SELECT DISTINCT src, dst, site <> name AS crossing FROM k WHERE src <> dst),
reach(key, h) AS (
    SELECT authority || path || coalesce('?' || query, ''), 0 FROM p WHERE url = (SELECT min(url) FROM pages)
    UNION
    SELECT e.dst, h + crossing::INT FROM reach JOIN e ON e.src = reach.key WHERE h + crossing::INT <= 3),
hop AS (SELECT key, min(h) AS hops FROM reach GROUP BY key),
crowd AS (SELECT src, count(*) AS crowd FROM k GROUP BY src),
u AS (SELECT dst AS key, name, path, query, min(crowd) AS crowd FROM k JOIN crowd USING (src) GROUP BY ALL),
told AS (SELECT authority || path || coalesce('?' || query, '') AS key,
        max(least(greatest(((page_id % 13) / 10)::DOUBLE, 0.01::DOUBLE), 1::DOUBLE)) AS base FROM p GROUP BY 1)"""
)

DATED = (
    PAGES
    + r""",
f(k, from_s, to_s) AS (VALUES (0, 1672531200.0, 1704067200.0), (1, 1704067200.0, 1706745600.0), (2, 1704067200.0, 1704153600.0),
    (3, 1704068400.0, 1704068400.0), (4, 1704068430.5, 1704068430.5), (5, NULL, NULL), (6, 1935360000.0, 1938038400.0)),
dated AS (SELECT p.*, CAST(from_s * 1000000 AS BIGINT) AS from_us, CAST(to_s * 1000000 AS BIGINT) AS to_us,
        least(greatest(((page_id % 13) / 10)::DOUBLE, 0.01::DOUBLE), 1::DOUBLE) AS priority
      FROM p JOIN f ON k = page_id % 7)"""
)

ORACLE: dict[str, str] = {
    "link_summary": f"WITH {PAGES} SELECT authority AS domain, CAST(count(*) AS BIGINT) AS n_links,"
    " CAST(count(DISTINCT url) AS BIGINT) AS n_targets FROM a GROUP BY authority",
    "url_parts": f"WITH {PAGES} SELECT page_id, scheme, authority, authority AS domain, path, query,"
    " fragment FROM p",
    "url_canonical": f"WITH {PAGES} SELECT page_id, 'https://' || authority || path ||"
    " coalesce('?' || query, '') AS url FROM p",
    "well_known_urls": f"WITH {PAGES} SELECT DISTINCT authority, scheme, scheme || '://' || authority ||"
    " '/robots.txt' AS robots_url, scheme || '://' || authority || '/sitemap.xml' AS sitemap_url FROM p",
    "domain_roots": f"WITH {PAGES}{WITH_ROOTS} SELECT url,"
    r" regexp_matches(url, '^[a-z]+://[^/?#]+/?(#.*)?$') AS is_root FROM wr",
    "body_text": "SELECT page_id, CAST(length(html) AS INTEGER) AS n_chars FROM pages",
    "outlinks_raw": f"WITH {PAGES} SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM a",
    "outlinks_resolved": f"WITH {PAGES} SELECT page_id, CAST(pos AS INTEGER) AS pos, url FROM a",
    "outlink_rejects": f"""WITH {PAGES},
        n AS (SELECT page_id, authority, url,
              len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS n FROM p)
        SELECT page_id, CAST(n AS INTEGER) AS pos, 'mailto:info@' || authority AS href,
               'not_http' AS reason FROM n
        UNION ALL SELECT page_id, CAST(n + 1 AS INTEGER), url, 'self_link' FROM n
        UNION ALL SELECT page_id, CAST(n + 2 AS INTEGER), 'http://' || authority || ':99999/',
               'unparsable' FROM n""",
    "outlink_counts": """SELECT page_id,
        CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS BIGINT) AS n_links FROM pages""",
    "outlinks_by_context": f"""WITH {PAGES}
        SELECT 'Other' AS context, CAST(count(*) AS BIGINT) AS n FROM a
        UNION ALL SELECT 'SitemapLink', count(*) FROM p
        UNION ALL SELECT 'Sitemap', count(DISTINCT authority) FROM p WHERE length(authority) % 5 = 2""",
    "frontier_new_domains": f"WITH {KNOWN} SELECT DISTINCT name FROM batch"
    " WHERE name NOT IN (SELECT name FROM known)",
    "frontier_insert": f"WITH {KNOWN} SELECT name, path, query FROM fresh",
    "frontier_rejects": f"""WITH {PAGES}
        SELECT 'http://10.' || ((page_id >> 16) & 255) || '.' || ((page_id >> 8) & 255) || '.'
               || (page_id & 255) || '/a' AS key, 'no_domain' AS reason FROM p
        UNION SELECT 'http://' || repeat('sub.', 64) || authority || '/b', 'too_long' FROM p""",
    "frontier_stats": f"WITH {KNOWN} SELECT (SELECT count(*) FROM a) AS offered, count(*) AS inserted FROM fresh",
    "frontier_integrity": f"WITH {KNOWN} SELECT count(*) AS n_orphans FROM batch"
    " WHERE name NOT IN (SELECT name FROM batch)",
    "frontier_select": f"WITH {WAITING} SELECT name, path, query, CAST(rank AS INTEGER) AS rank,"
    " CAST(turn AS INTEGER) AS turn FROM w",
    "frontier_keyed_insert": f"WITH {KNOWN} SELECT name, path, query FROM fresh",
    "frontier_keyed_select": f"""WITH {KNOWN},
        w0 AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY path, query NULLS FIRST) - 10 AS rank FROM batch),
        w AS (SELECT *, count(*) OVER (PARTITION BY name) - rank + 1 AS turn FROM w0 WHERE rank BETWEEN 1 AND 10)
        SELECT name, path, query, CAST(rank AS INTEGER) AS rank, CAST(turn AS INTEGER) AS turn FROM w""",
    "url_priority": f"""WITH RECURSIVE {GRAPH} SELECT name, path, query, hops,
        {scored("coalesce(base, 0.5::DOUBLE)", "coalesce(hops, 4)", "path", "query", "crowd")} AS priority
        FROM u LEFT JOIN hop USING (key) LEFT JOIN told USING (key)""",
    "next_by_priority": f"""WITH {KNOWN},
        v AS (SELECT *, ({scored("1::DOUBLE", "0", "path", "query", "length(path)")})::FLOAT AS crawl_priority
              FROM fresh WHERE length(path) % 7 <> 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY crawl_priority DESC, path, query NULLS FIRST) AS rank FROM v)
        SELECT name, path, query, crawl_priority, CAST(rank AS INTEGER) AS rank,
            row_number() OVER (ORDER BY rank, crawl_priority DESC, name) AS position FROM r WHERE rank <= 5""",
    "resource_links": f"""WITH {PAGES},
        more(context, href, path, reason) AS (VALUES ('Img', '/i.png', '/i.png', NULL), ('Img', '/i.png', '/i.png', NULL),
            ('Img', '/j,2.png', '/j,2.png', NULL), ('Script', '/s.js', '/s.js', NULL), ('Style', '/t.css', '/t.css', NULL),
            ('Img', '/b.png', '/b.png', NULL), ('Feed', '/feed?a&b', '/feed?a&b', NULL), ('Img', 'data:,x', NULL, 'not_http'))
        SELECT page_id, context, href, scheme || '://' || authority || more.path AS url, reason FROM p, more""",
    "feed_links": f"""WITH {PAGES} SELECT 'https://' || authority || '/feed' AS url,
        CAST(row_number() OVER (PARTITION BY authority ORDER BY page_id) - 1 AS INTEGER) AS pos,
        scheme || '://' || authority || path || coalesce('?' || query, '') AS link FROM p""",
    "canonical_urls": f"""WITH RECURSIVE {PAGES},
        q AS (SELECT page_id, scheme || '://' || authority || path || coalesce('?' || CASE
                WHEN query IS NULL OR len(list_filter(string_split(query, '&'), lambda x: NOT starts_with(x, 'utm_'))) = 0 THEN NULL
                ELSE array_to_string(list_filter(string_split(query, '&'), lambda x: NOT starts_with(x, 'utm_')), '&') END, '') AS url,
                page_id + CASE page_id % 10 WHEN 0 THEN NULL WHEN 7 THEN 1 WHEN 8 THEN 1 WHEN 9 THEN -2 ELSE -1 END AS dest FROM p),
        named AS (SELECT q.page_id, q.url, t.url AS target FROM q JOIN q AS t ON t.page_id = q.dest WHERE q.url <> t.url),
        nxt AS (SELECT url AS node, arg_min(target, page_id) AS next FROM named GROUP BY url),
        walk(node, here, step) AS (SELECT node, next, 1 FROM nxt
            UNION ALL SELECT walk.node, nxt.next, step + 1 FROM walk JOIN nxt ON nxt.node = walk.here WHERE step < 60),
        tail AS (SELECT walk.node, coalesce(max(CASE WHEN nxt.node IS NULL THEN here END), min(CASE WHEN step > 30 THEN here END)) AS fin
                 FROM walk LEFT JOIN nxt ON nxt.node = walk.here GROUP BY walk.node)
        SELECT page_id, url, coalesce(fin, url) AS canonical FROM q LEFT JOIN tail ON tail.node = q.url""",
    "long_links": f"""WITH {PAGES} SELECT page_id, 0 AS pos, 2047 AS n_chars, NULL AS reason FROM p
        UNION ALL SELECT page_id, 1, 2048, 'too_long' FROM p""",
    "sitemap_fields": f"""WITH {DATED} SELECT 'SitemapLink' AS context, url AS loc, from_us, to_us, priority FROM dated
        UNION ALL SELECT DISTINCT 'Sitemap', 'https://' || authority || '/sitemap_0.xml', NULL::BIGINT, NULL::BIGINT, 0.5::DOUBLE
        FROM p WHERE length(authority) % 5 = 2""",
    "recrawl_due": f"""WITH {DATED},
        e AS (SELECT scheme || '://' || authority || path || coalesce('?' || query, '') AS url, max(priority) AS priority,
                max(CASE WHEN from_us <= 1709251200000000 THEN least(to_us, 1709251200000000) END) AS changed,
                max(CASE WHEN scheme = 'http' THEN (1704067200 + page_id) * 1000000 END) AS last FROM dated GROUP BY 1),
        r AS (SELECT url, CASE WHEN last IS NULL THEN 'new' WHEN last < changed THEN 'changed' END AS reason, priority FROM e)
        SELECT * FROM r WHERE reason IS NOT NULL""",
    "robots_access": f"WITH {PAGES}{ROBOTS} SELECT authority, access FROM r",
    "robots_rules": f"WITH {PAGES}{ROBOTS} SELECT authority, rx, len, allow FROM r, rule WHERE access = 'Ok'",
    "robots_gate": f"WITH {PAGES}{ROBOTS}, t AS (SELECT DISTINCT authority, path AS pq, url FROM a)"
    f" SELECT url, decision FROM ({gated('t')})",
    "fetch_gate": f"WITH {PAGES}{ROBOTS}, t AS (SELECT page_id, authority,"
    f" path || coalesce('?' || query, '') AS pq FROM p) SELECT page_id, decision,"
    f" CASE WHEN decision = 'Retry' THEN 84000 END AS retry_s FROM ({gated('t')})",
    "robots_sitemaps": f"WITH {PAGES} SELECT DISTINCT authority, 'https://' || authority ||"
    " '/sitemap_main.xml' AS sitemap_url FROM p WHERE length(authority) % 5 = 2",
    "root_seeds": f"WITH {PAGES}{SEEDS} SELECT authority, url FROM seeds",
    "sitemap_entries": f"""WITH {PAGES} SELECT authority, 'SitemapLink' AS context, url AS loc FROM p
        UNION ALL SELECT DISTINCT authority, 'Sitemap', 'https://' || authority || '/sitemap_0.xml'
        FROM p WHERE length(authority) % 5 = 2""",
    "robots_state": f"WITH {STATE}",
    "politeness": f"WITH {POLITE} SELECT authority, event_id, avg_us, until_us FROM polite",
    "fetch_schedule": f"WITH {POLITE}, {WAITING[len(PAGES) + 1:]}{ROBOTS},"
    " t AS (SELECT *, name AS authority, path || coalesce('?' || query, '') AS pq FROM w)"
    " SELECT name, path, query, coalesce(until_us, 0) AS earliest_us FROM"
    f" ({gated('t')}) LEFT JOIN last_polite USING (authority) WHERE decision = 'Allowed'",
    "warc_records": f"""SELECT page_id, {LENGTH} AS content_length, {DATE} AS warc_date,
        CAST({LENGTH} + octet_length(encode('WARC/1.1xxWARC-Type: responsexxContent-Type: application/http;'
        || ' msgtype=responsexxWARC-Record-ID: xxWARC-Target-URI: ' || url || 'xxContent-Length: '
        || {LENGTH} || 'xxWARC-Date: ' || {DATE} || 'xxxxxxxx')) AS BIGINT) AS fixed_bytes FROM pages""",
    "warc_roundtrip": f"SELECT url AS target_uri, {LENGTH} AS content_length, {DATE} AS warc_date,"
    " html AS body FROM pages",
    "archive_by_url": f"""WITH {CAPTURES},
        asked AS (SELECT DISTINCT authority, path, q FROM c WHERE target_uri IN
                  (SELECT min(url) FROM pages UNION SELECT max(url) FROM pages))
        SELECT target_uri, warc_date, body FROM c JOIN asked USING (authority, path, q)""",
    "archive_by_table": f"""WITH {CAPTURES},
        asked AS (SELECT DISTINCT authority, path, q FROM c WHERE target_uri LIKE 'http:%')
        SELECT target_uri, warc_date, body FROM c JOIN asked USING (authority, path, q)""",
    "archive_below_path": f"""WITH {CAPTURES} SELECT target_uri, warc_date FROM c
        WHERE authority = (SELECT max(authority) FROM p) AND starts_with(path || q, '/en')
        UNION ALL SELECT target_uri, warc_date FROM c
        WHERE (authority = 'example.com' OR authority LIKE '%.example.com') AND starts_with(path || q, '/de')""",
    "idn_links": f"""WITH {PAGES}, h(pos, host) AS (VALUES (0, 'xn--bcher-kva'), (1, 'xn--bcher-kva'),
            (2, 'xn--wgv71a119e'), (3, 'xn--strae-oqa'), (4, NULL))
        SELECT page_id, pos, scheme || '://' || host || '.' || authority || '/x' AS url,
            host || '.' || authority AS domain, CASE WHEN host IS NULL THEN 'idn_host' END AS reason
        FROM p, h""",
    "crawl_round": f"WITH {ROUND}",
    "round_rejects": f"""WITH {TROUBLED}
        SELECT 'page' AS stage, url AS key, 'disallowed' AS reason FROM fg WHERE decision = 'Disallowed'
        UNION ALL SELECT DISTINCT 'page', 'http://' || authority || ':99999/', 'unparsable' FROM p
        UNION ALL SELECT 'extract', 'mailto:info@' || authority, 'not_http' FROM good
        UNION ALL SELECT 'extract', url, 'self_link' FROM good
        UNION ALL SELECT 'extract', 'http://' || authority || ':99999/', 'unparsable' FROM good
        UNION ALL SELECT 'robots', url, lower(decision) FROM lg WHERE decision <> 'Allowed'""",
    "round_retries": f"""WITH {TROUBLED} SELECT url, 84000 AS retry_s,
        CAST(1709251200 + 84000 AS BIGINT) * 1000000 AS next_attempt_us FROM fg WHERE decision = 'Retry'""",
    "sitemap_broken": f"""WITH {PAGES} SELECT 'SitemapLink' AS context, url AS loc FROM p
        UNION ALL SELECT DISTINCT 'Sitemap', 'https://' || authority || '/sitemap_0.xml'
        FROM p WHERE length(authority) % 5 = 2
        UNION ALL SELECT DISTINCT 'bad_xml', 'https://' || authority || '/sitemap_' || page_id // 1000 || '.xml' FROM p
        UNION ALL SELECT DISTINCT 'bad_xml', 'https://' || authority || '/sitemap_main.xml'
        FROM p WHERE length(authority) % 5 = 2""",
    "frontier_orphans": f"WITH {KNOWN} SELECT count(*) AS n_orphans FROM batch WHERE length(name) % 2 = 0",
    "frontier_select_named": f"""WITH {KNOWN},
        w0 AS (SELECT name, path, query, row_number() OVER (PARTITION BY name ORDER BY path) AS rank FROM batch
               WHERE name IN (SELECT min(authority) FROM p UNION SELECT max(authority) FROM p)),
        w AS (SELECT *, count(*) OVER (PARTITION BY name) - rank + 1 AS turn FROM w0 WHERE rank <= 10)
        SELECT name, path, query, CAST(rank AS INTEGER) AS rank, CAST(turn AS INTEGER) AS turn FROM w""",
    "outlinks_allowed_hosts": f"""WITH {PAGES} SELECT page_id, CAST(CASE WHEN authority IN
        (SELECT min(authority) FROM p UNION SELECT max(authority) FROM p)
        THEN len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) ELSE 0 END AS BIGINT) AS n_links FROM p""",
    "robots_from_fetches": f"WITH {PAGES}{ROBOTS} SELECT authority, access,"
    " CASE access WHEN 'Ok' THEN 3 ELSE 0 END AS n_rules FROM r",
    "stream_robots": f"WITH {STATE}",
    "stream_retries": f"""WITH {LOG},
        step AS (SELECT authority, at_us, status, at_us + 84000000000 AS due_us,
                 lead(at_us) OVER (PARTITION BY authority ORDER BY at_us, event_id) AS next_us FROM log)
        SELECT authority, at_us AS failed_us, due_us FROM step
        WHERE status = 503 AND (next_us IS NULL OR next_us > due_us)
            AND due_us <= (SELECT max(at_us) FROM log) // 1000 * 1000""",
    "stream_politeness": f"WITH {POLITE} SELECT authority, avg_us, until_us FROM last_polite",
    "stream_frontier": f"WITH {STREAM_FRONTIER}",
}
