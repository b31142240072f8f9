"""Addresses of visited pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import base_name, collapse, cut

# Hosts of sign-in pages.
SIGN_IN = r"(?i)^(accounts?|login|logon|auth|sso|oauth2?|signin|sign-in|id|idp|passport)\."
SIGN_IN_EXACT = ["accounts.google.com", "login.microsoftonline.com", "login.live.com", "appleid.apple.com", "passport.baidu.com", "open.weixin.qq.com"]
# Hosts, paths and parameters of search pages.
SEARCH = [
    (r"(?i)(^|\.)google\.[a-z.]+$", r"^/search", "q"),
    (r"(?i)(^|\.)bing\.com$", r"^/search", "q"),
    (r"(?i)(^|\.)baidu\.com$", r"^/s$", "wd"),
    (r"(?i)(^|\.)duckduckgo\.com$", r"^/$", "q"),
    (r"(?i)(^|\.)sogou\.com$", r"^/web", "query"),
    (r"(?i)(^|\.)so\.com$", r"^/s$", "q"),
    (r"(?i)(^|\.)github\.com$", r"^/search", "q"),
    (r"(?i)(^|\.)zhihu\.com$", r"^/search", "q"),
]


def search_term(url: Column) -> Column:
    """What was searched for on a search engine's page; null elsewhere."""
    host, path = F.try_parse_url(url, F.lit("HOST")), F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    found = [F.when(host.rlike(h) & path.rlike(p), F.nullif(F.trim(F.try_url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit(q)))), F.lit(""))) for h, p, q in SEARCH]
    return F.coalesce(*found)


def normalize_visits(visits: DataFrame, exclude_domains: tuple[str, ...] = (), self_titles: str | None = None) -> DataFrame:
    """Visits (ts, url, title, secs, term and more) with canonical url, host, title, term and secs; noise is left out."""
    url = F.trim(F.col("url"))
    protocol = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    raw = F.lower(F.try_parse_url(url, F.lit("HOST")))
    path = F.coalesce(F.nullif(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    origin = F.concat(protocol, F.lit("://"), F.regexp_replace(F.lower(F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://([^/?#]*)", 1), r"^[^@]*@", "")), F.when(protocol == "http", ":80$").otherwise(":443$"), F.lit("")))
    rows = visits.withColumns({"__file": protocol == "file", "__protocol": protocol, "__path": path, "__origin": origin, "__host": F.when(protocol == "file", "本地文件").otherwise(F.regexp_replace(raw, r"^www\.", ""))})
    host, is_file = F.col("__host"), F.col("__file")
    rows = rows.where(F.col("ts").isNotNull() & F.col("__protocol").isin("http", "https", "file") & (is_file | host.isNotNull()))
    rows = rows.where(is_file | ~(host.isin(SIGN_IN_EXACT) | host.rlike(SIGN_IN)))
    for d in (x.strip().lower() for x in exclude_domains):
        if d:  # equal, below it or any host that holds it: the last covers all
            rows = rows.where(~F.contains(host, F.lit(d)))
    own = F.nullif(F.trim(F.col("term")), F.lit("")) if "term" in visits.columns else F.lit(None).cast("string")
    rows = rows.withColumn("__term", F.coalesce(own, F.when(~is_file, search_term(url))))
    term = F.col("__term")
    decoded = F.coalesce(F.try_url_decode(F.replace(F.col("__path"), F.lit("+"), F.lit("%2B"))), F.col("__path"))
    local = F.regexp_replace(decoded, r"^/([A-Za-z]:/)", "$1")
    page = F.concat("__origin", "__path")
    title = collapse(F.col("title"))
    search_url = F.concat(page, F.lit("?q="), F.replace(F.url_encode(term), F.lit("+"), F.lit("%20")))
    title = F.when(is_file, F.when(title == "", base_name(local)).otherwise(title)).when(term.isNotNull(), F.concat(F.lit("搜索「"), term, F.lit("」"))).otherwise(title)
    title = F.when(title == "", F.concat(host, F.when(F.col("__path") == "/", "").otherwise(F.col("__path")))).otherwise(title)
    secs = F.greatest(F.lit(0.0), F.coalesce(F.col("secs").cast("double"), F.lit(0.0))) if "secs" in visits.columns else F.lit(0.0)
    rows = rows.withColumns({"url": F.when(is_file, local).when(term.isNotNull(), search_url).otherwise(page), "title": cut(title, 120), "secs": secs, "term": term, "host": host})
    if self_titles:
        rows = rows.where(~(host.rlike(r"^(localhost|127\.0\.0\.1|\[::1\])$") & F.col("title").rlike(self_titles)))
    return rows.drop("__file", "__protocol", "__path", "__origin", "__host", "__term")
