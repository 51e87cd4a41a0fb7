"""Allow and block rules for urls, with block decisions carried over redirects and canonical links.

A rule names a host and a start of a path; it fits the host and its subdomains and the longest that
fits decides. A page that no rule fits takes the decision of its equivalence class: the connected
component of urls over the redirects and canonical links that pages declare. One allowed member
allows such pages, else one blocked member blocks them. DataFrame functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, durable, renamed


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Pages declare another url of theirs in these tags.
LINK_TAG = r"(?is)<link\b[^>]*>"
CANONICAL = r"(?is)\brel\s*=\s*[\"']?canonical\b"
HREF = r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)"
META_TAG = r"(?is)<meta\b[^>]*>"
REFRESH = r"(?is)\bhttp-equiv\s*=\s*[\"']?refresh\b"
REFRESH_URL = r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)"
DECLARES = r"(?i)canonical|http-equiv"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; "" without one."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """What tells urls apart as nodes: host, path and query, without scheme and fragment."""
    query = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1), F.lit(""))
    return F.concat(host_of(url), path_of(url), query)


def fits(host: Column, path: Column, rule: Rule) -> Column:
    return ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)


def decided(host: Column, path: Column, rules: tuple[Rule, ...], what: str) -> Column:
    """``what`` ("text" or "verdict") of the longest rule that fits; null if none does. Equal lengths: the earlier."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.text)):
        hit, value = fits(host, path, rule), F.lit(getattr(rule, what))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return F.lit(None).cast("string") if out is None else out


def absolute(target: Column, url: Column) -> Column:
    """``target`` as a page at ``url`` means it."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    base = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
        .when(target.startswith("/"), F.concat(base, target))
        .otherwise(F.concat(base, folder, target))
    )


def declared(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(url, target): redirects and canonical links, as absolute urls; none for null urls or urls without a host."""
    text = F.col(html)
    links = F.filter(F.regexp_extract_all(text, F.lit(LINK_TAG), F.lit(0)), lambda t: t.rlike(CANONICAL))
    metas = F.filter(F.regexp_extract_all(text, F.lit(META_TAG), F.lit(0)), lambda t: t.rlike(REFRESH))
    found = F.concat(F.transform(links, lambda t: F.regexp_extract(t, HREF, 1)), F.transform(metas, lambda t: F.regexp_extract(t, REFRESH_URL, 1)))
    rows = pages.where(text.rlike(DECLARES) & (host_of(F.col(url)) != "")).select(F.col(url), F.explode(found).alias("_t")).where("_t <> ''")
    return rows.select(F.col(url), absolute(F.regexp_replace("_t", "&amp;", "&"), F.col(url)).alias("target"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """The id, host, path, rule (its text or null) and verdict, a row for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule, is an alias of nothing
    and is allowed. Null html declares nothing. Rows with null or repeated ids or urls are judged each by
    their own; pages of one url share its class. Other columns are ignored.
    """
    rows = renamed(pages, [id_column, url_column, html_column])
    url = F.col(f"in_{url_column}")
    host, path = host_of(url), path_of(url)
    out = rows.select(F.col(f"in_{id_column}").alias(id_column), host.alias("host"), path.alias("path"), decided(host, path, rules, "text").alias("rule"), decided(host, path, rules, "verdict").alias("_verdict"), address(url).alias("_node"))
    links = declared(rows, f"in_{url_column}", f"in_{html_column}")
    edges = durable(links.select(address(F.col(f"in_{url_column}")).alias("a"), address(F.col("target")).alias("b"), F.col(f"in_{url_column}").alias("ua"), F.col("target").alias("ub")).where("a <> b"))
    if edges.isEmpty():
        return out.select(id_column, "host", "path", "rule", F.coalesce("_verdict", F.lit("allow")).alias("verdict"))
    classes = components(edges)
    ends = edges.select(F.col("a").alias("node"), F.col("ua").alias("u")).union(edges.select("b", "ub")).dropDuplicates(["node"])
    ruled = ends.select("node", decided(host_of(F.col("u")), path_of(F.col("u")), rules, "verdict").alias("v"))
    member = durable(ruled.join(classes, "node"))
    of_class = member.groupBy("component").agg(F.when(F.max(F.col("v") == "allow"), "allow").when(F.max(F.col("v") == "block"), "block").alias("_class"))
    known = member.join(of_class, "component").select(F.col("node").alias("_node"), "_class").where("_class = 'block'")
    judged = out.join(known, "_node", "left")
    return judged.select(id_column, "host", "path", "rule", F.coalesce("_verdict", "_class", F.lit("allow")).alias("verdict"))
