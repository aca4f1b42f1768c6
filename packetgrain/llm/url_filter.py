"""Block and allow rules for URLs, carried over to aliases by redirects and canonical links.

A rule is a host and a path prefix; it fits its host and all subdomains where the path starts with the prefix, and the
longest fitting rule decides. A URL that no rule fits takes the decision of its equivalents:

1. Every URL has a canonical form: host without ``www.`` or ``m.`` and default port, path without index page, ``.html``
   and trailing slashes, query without tracking parameters; scheme and fragment do not count. URLs of one form are one
   node.
2. ``<link rel=canonical>`` and ``<meta http-equiv=refresh>`` of a page, and the rows of a table of redirects, are edges
   between nodes. Targets need not be pages themselves.
3. Connected components over the edges are found by alternating star rounds (``graph.components``). A component with a
   URL that a rule allows is allowed, else one with a URL that a rule blocks is blocked.

Only DataFrame functions are used. Rules are compiled to one expression, so their number should stay below some
hundreds; pages, links and components have no bound. A node that holds many pages meets its decision by broadcast.

Defined results: a null URL, or one without ``://``, has empty host and path, is no node and is allowed; null html has no
links; links that are not web addresses are left out; every row has its own result, whatever its id; an empty table
gives no rows. Columns besides page_id, url and html are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetgrain.llm import graph
from packetgrain.session import cut

Rule = tuple[str, str, str]

TRACKING = "^(utm_[^=]*|ref|gclid|fbclid)(=.*)?$"


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    return F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))


def host(url: Column) -> Column:
    return _lower(F.regexp_extract(_rest(url), "^([^/?#]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """The node of a URL; null without a host."""
    name = F.regexp_replace(F.regexp_replace(host(url), ":(80|443)$", ""), r"^(www|m)\.(.*\..*)$", "$2")
    way = F.regexp_replace(F.regexp_replace(path(url), r"(/index)?\.html?$", ""), "/+$", "")
    query = F.split(F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    return F.when(host(url) != "", F.concat(name, way, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def decided(url: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; both null where none does."""
    rule = verdict = F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):
        fits = ((host(url) == name) | host(url).endswith(f".{name}")) & path(url).startswith(prefix)
        rule = F.when(fits, F.lit(name + prefix)).otherwise(rule)
        verdict = F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def _attribute(tag: Column, name: str) -> Column:
    pattern = rf"""(?is)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*(F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)))


def resolved(base: Column, link: Column) -> Column:
    """The address that ``link`` names on the page ``base``; null where it is no web address."""
    link = F.regexp_replace(F.trim(link), "&amp;", "&")
    scheme = F.regexp_extract(base, "^(.*?)://", 1)
    site = F.concat(scheme, F.lit("://"), F.regexp_extract(_rest(base), "^([^/?#]*)", 1))
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    relative = F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), link)
    tail = F.regexp_extract(relative, "^[^?#]*(.*)$", 1)
    steps = F.split(F.regexp_extract(relative, "^([^?#]*)", 1), "/")
    steps = F.when(F.element_at(steps, -1).isin(".", ".."), F.array_append(steps, F.lit(""))).otherwise(steps)
    steps = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda done, step: F.when(step == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1))))
        .when(step == ".", done)
        .otherwise(F.array_append(done, step)),
    )
    return (
        F.when(link.rlike("(?i)^https?://"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("?"), F.concat(site, path(base), link))
        .when((link == "") | link.startswith("#") | link.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
        .otherwise(F.concat(site, F.array_join(steps, "/"), tail))
    )


def links(pages: DataFrame) -> DataFrame:
    """source, target of the canonical links and refresh redirects that pages name, comments and scripts left out."""
    said = pages.where(F.col("html").rlike("(?i)canonical|refresh") & (F.instr("url", "://") > 0))
    text = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", "")
    tags = said.select("url", F.explode(F.regexp_extract_all(text, F.lit("(?i)<(?:link|meta)[^>]*>"), 0)).alias("tag"))
    refresh = r"""(?is)^\s*[\d.]*\s*[;,]\s*(?:url\s*=\s*)?['"]?([^'"]*)"""
    target = F.when(
        F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(F.trim(_attribute(F.col("tag"), "rel"))), r"\s+"), "canonical"),
        _attribute(F.col("tag"), "href"),
    ).when(
        F.col("tag").rlike("(?i)^<meta") & (F.lower(F.trim(_attribute(F.col("tag"), "http-equiv"))) == "refresh"),
        F.regexp_extract(_attribute(F.col("tag"), "content"), refresh, 1),
    )
    return tags.select(F.col("url").alias("source"), resolved(F.col("url"), target).alias("target")).where("target IS NOT NULL")


def judge(pages: DataFrame, rules: Sequence[Rule], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, decided_by (rule, alias or default) of every row of ``pages``.

    ``redirects(source, target)`` are further edges, such as those a crawler has followed.
    """
    url = F.col("url")
    rule, verdict = decided(url, rules)
    rows = pages.select(
        "page_id", host(url).alias("host"), path(url).alias("path"), rule.alias("rule"), verdict.alias("own"), canonical(url).alias("node")
    )
    named = links(pages.select("url", "html"))
    if redirects is not None:
        named = named.unionByName(redirects.select("source", "target"))
    source, target = F.col("source"), F.col("target")
    named = cut(
        named.select(
            canonical(source).alias("u"),
            decided(source, rules)[1].alias("u_own"),
            canonical(target).alias("v"),
            decided(target, rules)[1].alias("v_own"),
        ).where("u IS NOT NULL AND v IS NOT NULL")
    )
    votes = (
        rows.select("node", "own")
        .unionByName(named.select(F.col("u").alias("node"), F.col("u_own").alias("own")))
        .unionByName(named.select(F.col("v").alias("node"), F.col("v_own").alias("own")))
        .where("node IS NOT NULL AND own IS NOT NULL")
    )
    # "allow" sorts before "block": the least verdict of a class is the one that holds.
    votes = cut(votes.groupBy("node").agg(F.min("own").alias("said")))
    edges = named.select("u", "v").where("u <> v")
    if not edges.isEmpty():
        classes = cut(graph.components(edges))
        of = graph.attach(classes, votes, "node").groupBy("root").agg(F.min("said").alias("said"))
        inside = graph.attach(classes, of, "root").select("node", "said")
        votes = cut(votes.join(classes, "node", "left_anti").unionByName(inside))
    open_rows = cut(rows.where("own IS NULL"))
    taken = graph.attach(open_rows, votes, "node", "left")
    closed = rows.where("own IS NOT NULL").withColumn("said", F.lit(None).cast("string"))
    return closed.unionByName(taken.select(closed.columns)).select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("own", "said", F.lit("allow")).alias("verdict"),
        F.when(F.col("own").isNotNull(), "rule").when(F.col("said").isNotNull(), "alias").otherwise("default").alias("decided_by"),
    )
