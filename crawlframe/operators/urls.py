"""Parse and join URLs column-wise, by the rules of the URL standard for http(s)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crawlframe.functions import urls as U
from crawlframe.functions.sql import null_text, text

PARTS = ("scheme", "authority", "domain", "path", "query", "fragment")


def parse_urls(df: DataFrame, raw: str, out: str = "u", base: str | None = None) -> DataFrame:
    """Add struct column ``out`` with the parts of the URL in column ``raw``.

    Fields: scheme, authority, domain, path, query, fragment, url, error. ``url``
    has no fragment. ``domain`` is NULL for IP hosts. ``error`` is NULL for a
    good http(s) URL; otherwise all other fields are NULL. International host
    names are turned to their ASCII form; those without one have error
    ``idn_host``. With ``base`` (a
    struct column that this function made) relative references are joined to
    it; without, they have error ``relative``.

    The struct leaves through a one-row generator. That keeps the optimizer from
    copying the whole parse into each filter on its fields.
    """
    keep = [f"`{name}`" for name in df.columns if name != out]

    def of_base(field: str) -> str:
        return f"{base}.{field}" if base else null_text()

    pair = "substring_index(_auth, '@', -1)"
    steps = [
        f"{U.clean(raw)} AS _r",
        f"lower(regexp_extract(_r, {text(U.SCHEME)}, 1)) AS _s",
        f"{U.is_http('_s')} AS _web",
        "substring_index(_r, '#', 1) AS _n",
        "CASE WHEN contains(_r, '#') THEN substr(_r, instr(_r, '#') + 1) END AS _f",
        "CASE WHEN _web THEN substr(_n, length(_s) + 2) ELSE _n END AS _b",
        "translate(substring_index(_b, '?', 1), '\\\\', '/') AS _p",
        "CASE WHEN contains(_b, '?') THEN substr(_b, instr(_b, '?') + 1) END AS _q",
        "_web OR (_s = '' AND startswith(_p, '//')) AS _net",
        "CASE WHEN _net THEN ltrim('/', _p) END AS _rest",
        "substring_index(_rest, '/', 1) AS _auth",
        f"lower(regexp_extract({pair}, {text(U.HOST_OF_PAIR)}, 1)) AS _h",
        f"""CASE WHEN contains(_auth, ':')
            THEN regexp_extract({pair}, {text(U.PORT_OF_PAIR)}, 1) ELSE '' END AS _port""",
        "CASE WHEN contains(_auth, '@') THEN regexp_replace(_auth, '@[^@]*$', '') END AS _user",
        f"""CASE WHEN _net THEN substr(_rest, length(_auth) + 1)
            WHEN startswith(_p, '/') THEN _p
            WHEN _p = '' THEN {of_base('path')}
            ELSE concat(regexp_replace({of_base('path')}, '[^/]*$', ''), _p) END AS _raw_path""",
        "CASE WHEN _raw_path = '' THEN '/' ELSE _raw_path END AS _full_path",
        f"{U.remove_dot_segments('_full_path')} AS _plain_path",
        f"{U.percent_encode('_plain_path', U.PATH_UNSAFE)} AS _path",
        f"""CASE WHEN _q IS NOT NULL THEN {U.percent_encode('_q', U.QUERY_UNSAFE)}
            WHEN NOT _net AND _p = '' THEN {of_base('query')} END AS _query""",
        """CASE WHEN contains(_h, '%') THEN lower(try_url_decode(replace(_h, '+', '%2B')))
            ELSE _h END AS _name_host""",
        f"CASE WHEN {U.not_ascii('_name_host')} THEN {U.punycoded('_name_host')} ELSE _name_host END AS _host",
        f"{U.ends_in_number('_host')} AS _four",
        f"CASE WHEN _four THEN {U.ipv4_text('_host')} END AS _ip",
        "startswith(_host, '[') AS _six",
        f"CASE WHEN _web THEN _s ELSE {of_base('scheme')} END AS _scheme",
        "CASE WHEN _scheme = 'https' THEN '443' ELSE '80' END AS _default",
        "substring_index(_user, ':', 1) AS _name",
        "substr(_user, length(_name) + 2) AS _secret",
        f"""CASE WHEN _user IS NULL OR _user IN ('', ':') THEN '' ELSE concat(
            {U.percent_encode('_name', U.USERINFO_UNSAFE)},
            CASE WHEN _secret = '' THEN '' ELSE
                concat(':', {U.percent_encode('_secret', U.USERINFO_UNSAFE)}) END,
            '@') END AS _login""",
        f"""CASE WHEN _net THEN concat(_login, coalesce(_ip, _host),
            CASE WHEN _port IN ('', _default) THEN '' ELSE concat(':', _port) END)
            ELSE {of_base('authority')} END AS _authority""",
        f"""CASE WHEN NOT _net THEN {of_base('domain')}
            WHEN NOT _six AND NOT _four THEN _host END AS _domain""",
        f"""CASE WHEN _r IS NULL THEN 'missing'
            WHEN _s <> '' AND NOT _web THEN 'scheme'
            WHEN NOT _net THEN {f"CASE WHEN {base}.error IS NOT NULL THEN 'bad_base' END" if base else "'relative'"}
            WHEN _host IS NULL AND {U.not_ascii('_name_host')} THEN 'idn_host'
            WHEN coalesce(_host, '') = '' THEN 'bad_host'
            WHEN _six THEN CASE WHEN NOT _host RLIKE {text(U.BRACKETED)} THEN 'bad_host' END
            WHEN _host RLIKE {text(U.HOST_FORBIDDEN)} THEN 'bad_host'
            WHEN _four AND _ip IS NULL THEN 'bad_host'
            WHEN length(_port) > 5 OR lpad(_port, 5, '0') > '65535' THEN 'bad_port'
            END AS _error""",
    ]
    outcome = {name: f"_{name}" for name in PARTS} | {"fragment": "_f"}
    outcome["url"] = f"concat(_scheme, '://', _authority, {U.target('_path', '_query')})"
    fields = [
        f"'{name}', CASE WHEN _error IS NULL THEN {value} END" for name, value in outcome.items()
    ]
    struct = f"named_struct({', '.join(fields)}, 'error', _error)"
    return df.selectExpr(*keep, *steps).selectExpr(*keep, f"explode(array({struct})) AS {out}")


def url_parts(pages: DataFrame) -> DataFrame:
    """Scheme, authority, domain, path, query and fragment of each page URL."""
    parsed = parse_urls(pages.select("page_id", "url"), "url")
    return parsed.filter("u.error IS NULL").select("page_id", *[f"u.{name}" for name in PARTS])


def url_canonical(pages: DataFrame) -> DataFrame:
    """The URL as the frontier stores and reloads it."""
    parsed = parse_urls(pages.select("page_id", "url"), "url").filter("u.domain IS NOT NULL")
    return parsed.selectExpr("page_id", f"{U.stored_url('u.domain', 'u.path', 'u.query')} AS url")


def well_known_urls(pages: DataFrame) -> DataFrame:
    """robots.txt and sitemap.xml addresses of every site that occurs."""
    parsed = parse_urls(pages.select("url"), "url").filter("u.error IS NULL")
    return (
        parsed.select("u.scheme", "u.authority")
        .distinct()
        .selectExpr(
            "authority",
            "scheme",
            f"{U.with_path_only('scheme', 'authority', 'robots.txt')} AS robots_url",
            f"{U.with_path_only('scheme', 'authority', 'sitemap.xml')} AS sitemap_url",
        )
    )


def domain_roots(pages: DataFrame) -> DataFrame:
    """Flag the URLs that are the main page of their site."""
    parsed = parse_urls(pages.select("url"), "url").filter("u.error IS NULL")
    return parsed.selectExpr(
        "url", f"{U.is_domain_root('u.authority', 'u.path', 'u.query')} AS is_root"
    )
