"""URL filters by redirect equivalence, with DataFrame functions only.

A rule names a host and the beginning of a path, and fits that host and its subdomains; the longest
rule that fits decides.  URLs that redirect to each other or declare a common canonical address are
aliases: a URL without a rule of its own takes the decision of its aliases.  If one of them is
allowed by a rule it is allowed, else if one is blocked it is blocked, else it is allowed.

An alias edge joins a page's address to the target of its `<link rel="canonical">` or of its
`<meta http-equiv="refresh">`.  Addresses are compared in a plain form: without scheme, `#...`,
`utm_*` parameters and the slash at the end, host in lower case; pages that share it are aliases.
Relative targets are taken from the page's host.
A target that is no page of the table is judged, too, by its address as the link writes it.  Null or malformed URLs have an empty host and path
and no aliases.  Rows are judged one by one, so repeated rows repeat their result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sentivane.llm.components import components
from sentivane.session import stage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    verdict: str  # allow or block
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org"), UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"), UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def _rest(url: Column) -> Column:
    """What stands behind the first ://, null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    found = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def matched(host_col: Column, path_col: Column, rules=RULES) -> Column:
    """Name of the longest rule that fits, else null; the first of equally long ones."""
    out = None
    for rule in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host_col == rule.host) | F.endswith(host_col, F.lit("." + rule.host))) & \
            F.startswith(path_col, F.lit(rule.path))
        out = F.when(fits, rule.name) if out is None else out.when(fits, rule.name)
    return out if out is not None else F.lit(None).cast("string")


def plain(url: Column) -> Column:
    """The form in which addresses are compared; null where there is no host."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(
        F.split(query, "&"), lambda p: ~F.startswith(p, F.lit("utm_")) & (p != "")), "&")
    address = F.concat(host(url), F.regexp_replace(path(url), "/+$", ""),
                       F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(host(url) != "", address)


def _attribute(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(quoted, r"""^["']|["']$""", "")


def declared(html: Column) -> Column:
    """Targets of canonical links and of redirects in a page, as an array."""
    links = F.when(F.contains(F.lower(html), F.lit("canonical")), F.regexp_extract_all(
        html, F.lit(r"""(?i)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""), F.lit(0)))
    metas = F.when(F.contains(F.lower(html), F.lit("refresh")), F.regexp_extract_all(
        html, F.lit(r"""(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""), F.lit(0)))
    none = F.array().cast("array<string>")
    return F.concat(
        F.coalesce(F.transform(links, lambda t: _attribute(t, "href")), none),
        F.coalesce(F.transform(metas, lambda t: F.trim(F.regexp_extract(
            _attribute(t, "content"), r"(?i)url\s*=\s*'?([^']*)", 1))), none))


def _absolute(target: Column, url: Column) -> Column:
    site = F.concat(F.lit("http://"), host(url))
    folder = F.regexp_extract(path(url), r"^(.*/)", 1)
    return (
        F.when(target == "", None)
        .when(F.contains(target, F.lit("://")), target)
        .when(F.startswith(target, F.lit("//")), F.concat(F.lit("http:"), target))
        .when(F.startswith(target, F.lit("/")), F.concat(site, target))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), target)))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url",
          html_col: str | None = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row."""
    url = F.col(url_col)
    html = F.col(html_col) if html_col else F.lit(None).cast("string")
    known = stage(
        pages.select(F.col(id_col).alias("page_id"), url.alias("url"),
                     declared(html).alias("targets"))
        .select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"),
                plain(F.col("url")).alias("node"),
                F.filter(F.transform(
                    F.transform("targets", lambda t: _absolute(t, F.col("url"))),
                    lambda t: F.struct(plain(t).alias("node"), host(t).alias("host"),
                                       path(t).alias("path"))),
                         lambda t: t["node"].isNotNull()).alias("targets"))
        .withColumn("rule", matched(F.col("host"), F.col("path"), rules)), "pages")
    is_block = F.col("rule").isin([r.name for r in rules if r.verdict == "block"])
    # one row per address: copies of a page fold before anything is joined
    ruled = known.filter("node IS NOT NULL AND rule IS NOT NULL").groupBy("node").agg(
        F.bool_or(~is_block).alias("allow"), F.bool_or(is_block).alias("block"))
    edges = known.filter("size(targets) > 0").select(
        F.col("node").alias("a"), F.explode("targets.node").alias("b"))
    member = stage(components(edges), "aliases")
    # targets that are no page themselves are judged by their own address, as it is written there
    outside = known.select(F.explode("targets").alias("t")).select("t.*") \
        .withColumn("rule", matched(F.col("host"), F.col("path"), rules)) \
        .filter("rule IS NOT NULL").groupBy("node").agg(
            F.bool_or(~is_block).alias("allow"), F.bool_or(is_block).alias("block")) \
        .join(known.select("node"), "node", "left_anti") \
        .join(member, "node").select("component", "allow", "block")
    decided = (
        member.join(ruled, "node").select("component", "allow", "block").union(outside)
        .groupBy("component").agg(F.bool_or("allow").alias("allow"),
                                  F.bool_or("block").alias("block"))
    )
    by_alias = member.join(decided, "component").select("node", "allow", "block")
    # addresses without declared aliases still share the decision of pages with the same plain form
    own = ruled.join(member, "node", "left_anti").select("node", "allow", "block")
    open_nodes = known.filter("rule IS NULL AND node IS NOT NULL").select("node").distinct()
    answer = by_alias.union(own).join(open_nodes, "node", "left_semi")
    blocked = answer.filter("block AND NOT allow").select("node", F.lit(True).alias("blocked"))
    settled = known.filter("rule IS NOT NULL OR node IS NULL").select(
        "page_id", "host", "path", "rule",
        F.when(is_block, "block").otherwise("allow").alias("verdict"))
    asked = known.filter("rule IS NULL AND node IS NOT NULL").join(blocked, "node", "left").select(
        "page_id", "host", "path", "rule",
        F.when(F.col("blocked"), "block").otherwise("allow").alias("verdict"))
    return settled.union(asked)
