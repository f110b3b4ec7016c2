"""URL, route and link expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_segments(path: Column) -> Column:
    """Segments between slashes; slashes at either end don't count, empty ones inside stay."""
    body = F.regexp_replace(path, "^/+|/+$", "")
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, "/", -1))


def without_query(url: Column) -> Column:
    return F.substring_index(url, "?", 1)


def strip_leading_base(url: Column) -> Column:
    """``:p<n>/rest`` stands for a base URL: ``/rest``."""
    return F.regexp_replace(url, r"(?s)^:p\d+/", "/")


def has_trailing_slash(url: Column) -> Column:
    return F.regexp_replace(without_query(url), "^/+", "").endswith("/")


def is_param(segment: Column) -> Column:
    return segment.startswith(":")


def is_optional(segment: Column) -> Column:
    return segment.startswith(":") & segment.endswith("?")


def host_of(url: Column) -> Column:
    """The host of an absolute URL, lower case; null for anything else."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"[\[\]]", ""))


def external_host(url: Column) -> Column:
    """The host if the URL is one of the public internet, else null."""
    host = host_of(url)
    local = host.isin("localhost", "127.0.0.1", "0.0.0.0", "::1") | host.endswith(".local") | ~host.contains(".")
    private = host.startswith("10.") | host.startswith("192.168.") | host.startswith("172.") | host.startswith("169.254.")
    return F.when(~local & ~private, host)


def strip_prefix(url: Column, prefix: str) -> Column:
    """``url`` without a proxy prefix that ends at a segment border; null where it doesn't apply."""
    rest = F.substring(url, len(prefix) + 1, 1 << 30)
    applies = ~url.rlike("(?i)^https?://") & url.startswith(prefix) & (rest.rlike(r"^[/?]") | (rest == ""))
    return F.when(applies, F.when(rest == "", "/").when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest)))


#: Fixed: schemes of links that lead to no page.
_NO_PAGE = r"(?i)^(?:#|//|mailto:|tel:|javascript:|data:|blob:|sms:)"


def normal_href(href: Column) -> Column:
    """The page path that a link leads to, with a closing slash; null for links elsewhere."""
    x = F.trim(href)
    bad = (x == "") | x.rlike(_NO_PAGE) | x.contains("://") | x.contains("{{") | x.contains("{%") | ~x.startswith("/")
    path = F.regexp_replace(x, r"[?#].*$", "")
    path = F.regexp_replace(path, r"/index\.(?:html|htm|md|mdx|njk|liquid|hbs|ejs|pug)$", "/")
    return F.when(~bad, F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/"))))


def transform_url(url: Column, strip: str | None = None, add: str | None = None, replace: tuple[str, str] | None = None) -> Column:
    """A stitch rule's transform: strip, then add, then replace a prefix."""
    out = url
    if strip:
        rest = F.substring(out, len(strip) + 1, 1 << 30)
        out = F.when(out.startswith(strip), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))).otherwise(out)
    if add:
        out = F.concat(F.lit(add), out)
    if replace:
        old, new = replace
        out = F.when(out.startswith(old), F.concat(F.lit(new), F.substring(out, len(old) + 1, 1 << 30))).otherwise(out)
    return out
