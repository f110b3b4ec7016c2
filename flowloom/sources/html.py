"""HTML front-end: links, forms and inline handlers of pages, by built-in expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions import urls

_ATTR = r"""\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""


def _attr(tag, name: str):
    """The value of an attribute in a tag's text."""
    pattern = rf"(?is)\s{name}{_ATTR}"
    parts = [F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]
    return F.coalesce(*[F.when(p != "", p) for p in parts])


def _tags(column: str, name: str):
    bare = F.regexp_replace(column, r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", " ")
    return F.regexp_extract_all(bare, F.lit(rf"(?is)<{name}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"), F.lit(0))


def links(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, href, path): anchors, with the page they lead to where that is one of the site."""
    a = pages.select(key, F.explode(_tags(html, "a")).alias("tag")).select(key, _attr(F.col("tag"), "href").alias("href")).where("href IS NOT NULL")
    return a.withColumn("path", urls.normal_href(F.col("href")))


def forms(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, method, url): forms as callers; without a method it is GET, without an action the page itself."""
    f = pages.select(key, F.posexplode(_tags(html, "form")).alias("ord", "tag"))
    return f.select(key, "ord", F.upper(F.coalesce(_attr(F.col("tag"), "method"), F.lit("GET"))).alias("method"), F.coalesce(_attr(F.col("tag"), "action"), F.lit("")).alias("url"))


#: Fixed: words that look like calls and are none.
_KEYWORDS = ("if", "for", "while", "switch", "return", "function", "catch", "typeof", "new")


def handlers(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """(key, ord, event, function): functions named in on-event attributes."""
    found = F.regexp_extract_all(html, F.lit(r"""(?is)\son[a-z]+\s*=\s*(?:"[^"]*"|'[^']*')"""), F.lit(0))
    e = pages.select(key, F.posexplode(found).alias("ord", "x"))
    names = F.array_distinct(F.regexp_extract_all("x", F.lit(r"(?<![\w.$])([A-Za-z_$][\w$]*)\s*\("), F.lit(1)))
    e = e.select(key, "ord", F.lower(F.regexp_extract("x", r"(?i)\s(on[a-z]+)", 1)).alias("event"), F.explode(names).alias("function"))
    return e.where(~F.col("function").isin(*_KEYWORDS))


def resolve_handlers(found: DataFrame, functions: DataFrame) -> DataFrame:
    """Handlers joined to all functions of that name in their repository."""
    return found.join(functions.select("repository", F.col("name").alias("function"), "function_id"), ["repository", "function"])


def ssg_route(path):
    """The route of a static site's page from its file path."""
    x = F.regexp_replace(path, r"^(?:src/)?(?:pages|content|site|docs|_pages)/", "")
    x = F.regexp_replace(x, r"\.(?:html|htm|md|mdx|njk|liquid|hbs|ejs|astro|vue|svelte)$", "")
    x = F.regexp_replace(x, r"(?:^|/)index$", "")
    return F.when(x == "", "/").otherwise(F.concat(F.lit("/"), x, F.lit("/")))
