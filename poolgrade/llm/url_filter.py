"""URL filter with redirect equivalence.

A url is judged by the longest rule that fits it. A url without a rule takes part in the decision of its
aliases: redirects and canonical links are edges between urls, and the connected component of a url
is blocked if a rule blocks one of its members, unless a rule explicitly allows another one.

Host and path decide about rules; for edges a url is its host, path and query, without scheme and fragment.
Null urls and those without ``://`` have empty host and path, fit no rule and have no aliases. Null pages
have no links.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import fresh, without
from .graph import components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MOST_RULES = 2000
ALLOW, BLOCK = "allow", "block"


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node(url: Column) -> Column:
    """What redirects and canonical links call the same page; null if there is no host."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(rest == "", "/").otherwise(rest)))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest fitting rule, or null. ``rules``: ("example.com/a/", "block").

    The rules are a policy list and part of the plan, so there may be 2,000 at most. Of two rules of the same
    length the greater text wins.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    hits = []
    for rule, verdict in rules:
        domain, slash, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + rest)
        hit = F.struct(F.lit(len(rule)).alias("size"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        hits.append(F.when(fits, hit))
    return F.array_max(F.array(*hits)) if hits else F.lit(None).cast("struct<size:int,rule:string,verdict:string>")


def _without_dots(path: Column) -> Column:
    """A path without its ``.`` and ``..`` segments; one too many ``..`` goes no higher than the top."""
    parts = F.split(path, "/", -1)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part == ".", done).when(part == "..", up).otherwise(F.array_append(done, part))

    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    folder = F.element_at(parts, -1).isin(".", "..")
    whole = F.concat(F.lit("/"), F.array_join(F.when(folder, F.array_append(kept, F.lit(""))).otherwise(kept), "/"))
    return F.when(path.rlike(r"/\.\.?(/|$)"), whole).otherwise(path)


def _resolved(href: Column, base: Column) -> Column:
    """A link's target as seen from the page at ``base``; null if it is no page's address.

    A fragment alone is the page itself, a query alone its path with that query, any other relative link starts in
    the page's folder; dot segments are taken out.
    """
    folder = F.regexp_replace(path(base), r"[^/]*$", "")
    at = F.concat(F.lit("x://"), host(base))
    href = F.regexp_replace(F.replace(F.trim(href), F.lit("&amp;"), F.lit("&")), r"(?s)#.*$", "")
    there = (
        F.when(href == "", base)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), href)
        .when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None)  # mailto: and its like
        .when(href.startswith("//"), F.concat(F.lit("x:"), href))
        .when(href.startswith("/"), F.concat(at, href))
        .when(href.startswith("?"), F.concat(at, path(base), href))
        .otherwise(F.concat(at, F.when(folder == "", "/").otherwise(folder), href))
    )
    query = F.regexp_extract(there, r"(?s)^.*?://[^/?#]*[^?#]*([^#]*)", 1)
    return F.concat(F.lit("x://"), host(there), _without_dots(path(there)), query)


def link_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(u, v) of each page and the targets of its canonical links and refresh redirects; comments hold no links."""
    rows = pages.select(F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.where(F.col("html").rlike(r"(?i)canonical|http-equiv"))
    rows = rows.withColumn("html", F.regexp_replace("html", r"(?s)<!--.*?(-->|\z)", " "))
    rows = rows.where(F.col("html").rlike(r"(?i)canonical|http-equiv") & (host(F.col("url")) != ""))
    tags = F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))).alias("tag")
    quoted = r"""\s*=\s*["']?\s*"""
    canonical = F.col("tag").rlike(rf"(?is)^<link\b.*\srel{quoted}canonical\b")
    refresh = F.col("tag").rlike(rf"(?is)^<meta\b.*\shttp-equiv{quoted}refresh\b")
    href = F.regexp_extract("tag", rf"""(?is)\shref{quoted}([^"'\s>]*)""", 1)
    target = F.regexp_extract("tag", rf"""(?is)\scontent{quoted}[^"'>]*?url\s*=\s*["']?([^"'\s>]*)""", 1)
    found = rows.select("url", tags).where(canonical | refresh)
    found = found.select("url", F.when(canonical, href).otherwise(target).alias("to")).where("to <> ''")
    return found.select(node(F.col("url")).alias("u"), node(_resolved(F.col("to"), F.col("url"))).alias("v"))


def alias_verdicts(edges: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(node, verdict) of every url with an alias: an allowing rule in its component wins over a blocking one."""
    members = components(edges, "u", "v")
    members = members.unionByName(members.select(F.col("root").alias("node"), "root")).distinct()
    there = F.concat(F.lit("x://"), F.col("node"))
    ruled = members.withColumn("verdict", longest_rule(host(there), path(there), rules)["verdict"])
    decided = ruled.groupBy("root").agg(
        F.max((F.col("verdict") == ALLOW).cast("int")).alias("allowed"),
        F.max((F.col("verdict") == BLOCK).cast("int")).alias("blocked"),
    )
    blocked = (F.coalesce("blocked", F.lit(0)) == 1) & (F.coalesce("allowed", F.lit(0)) == 0)
    return members.join(
        decided.select("root", F.when(blocked, BLOCK).otherwise(ALLOW).alias("verdict")), "root"
    ).select("node", "verdict")


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]],
    url: str = "url",
    html: str = "html",
    redirects: DataFrame | None = None,
    column: str = "judged",
) -> DataFrame:
    """``pages`` with a struct: host, path, rule (null without one), verdict.

    ``redirects`` may add (source, target) urls to the edges found in the pages.
    """
    edges = link_edges(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("source")).alias("u"), node(F.col("target")).alias("v")))
    aliases = alias_verdicts(edges, rules)
    names = without(pages, column).columns
    at, hit = fresh(pages, "_node"), fresh(pages, "_hit")
    rows = pages.withColumns({at: node(F.col(url)), hit: longest_rule(host(F.col(url)), path(F.col(url)), rules)})
    alias_at, alias_verdict = fresh(pages, "_alias"), fresh(pages, "_alias_verdict")
    aliases = aliases.select(F.col("node").alias(alias_at), F.col("verdict").alias(alias_verdict))
    rows = rows.join(aliases, F.col(at) == F.col(alias_at), "left")
    return rows.select(
        *[F.col(f"`{c}`") for c in names],
        F.struct(
            host(F.col(url)).alias("host"),
            path(F.col(url)).alias("path"),
            F.col(hit)["rule"].alias("rule"),
            F.coalesce(F.col(hit)["verdict"], F.col(alias_verdict), F.lit(ALLOW)).alias("verdict"),
        ).alias(column),
    )
