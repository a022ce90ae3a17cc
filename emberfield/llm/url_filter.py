"""URL rules, and block decisions passed on to aliases of a page.

A page's own longest rule decides first. Pages without one take the decision of
their aliases: all addresses that redirects (meta refresh) and canonical links connect, found as
connected components over the whole table. In a component an explicit allow goes
before any block. Pages that nothing decides are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, components, durable, forget

#: (host, path, verdict) of the contract.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
LINK = r"(?is)<link\b[^>]*(?<![\w-])rel\s*=\s*[\"']?canonical\b[^>]*>"
META = r"(?is)<meta\b[^>]*(?<![\w-])http-equiv\s*=\s*[\"']?refresh\b[^>]*>"
#: What a browser does not read as tags.
UNREAD = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|noscript)\b.*?(?:</\1\b[^>]*>|\z)"


def host_of(url: str) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty without ://."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")


def path_of(url: str) -> Column:
    """After the host up to ?, # or the end; empty without ://."""
    rest = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def matched_rule(rules, host: str = "host", path: str = "path") -> Column:
    """struct(rule, verdict) of the longest rule that fits, an allow before a block of equal length; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2] != "allow", r))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in reversed(ordered):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _absolute(base: str, link: str) -> Column:
    """A link's address, read from a page at base: absolute, //host, /path or relative to the page's folder."""
    origin = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^([^:/?#]+://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    link_ = F.col(link)
    return (
        F.when(F.coalesce(link_, F.lit("")) == "", F.lit(None))
        .when(link_.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link_)
        .when(link_.startswith("//"), F.concat(F.regexp_extract(base, r"^([^/]+)//", 1), link_))
        .when(link_.startswith("/"), F.concat(origin, link_))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link_))
    )


def _node(url: str) -> Column:
    """Address without fragment, its scheme and host in lower case: what a server can tell apart. Null for one without ://."""
    scheme = F.expr(f"substring({url}, 1, instr({url}, '://') - 1)")
    scheme = F.when(scheme.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*\z"), ascii_lower(scheme)).otherwise(scheme)
    tail = F.regexp_extract(F.expr(f"substring({url}, instr({url}, '://') + 3)"), r"\A[^/?#]*([^#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.concat(scheme, F.lit("://"), host_of(url), F.when(tail == "", "/").otherwise(tail)))


def _number(url: str) -> Column:
    return F.when(F.instr(url, "://") > 0, F.xxhash64(_node(url)))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(url, target) for each canonical link and each meta refresh with an address; tags in comments, scripts and the like are none."""
    quoted = r"\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))"
    some = pages.where("instr(url, '://') > 0").where(F.col("html").rlike(LINK) | F.col("html").rlike(META))
    read = F.regexp_replace("html", UNREAD, " ")
    link, meta = F.regexp_extract(read, LINK, 0), F.regexp_extract(read, META, 0)
    href = F.concat(*[F.regexp_extract("link", r"(?is)(?<![\w-])" + quoted.removeprefix(r"\b"), i) for i in (1, 2, 3)])
    moved = F.regexp_extract("meta", r"(?is)\burl\s*=\s*['\"]?\s*([^'\"\s>]+)", 1)
    found = some.select("url", link.alias("link"), meta.alias("meta")).where("link <> '' OR meta <> ''")
    found = found.select("url", F.explode(F.array(F.trim(href), F.trim(moved))).alias("href"))
    found = found.withColumn("href", F.replace("href", F.lit("&amp;"), F.lit("&")))
    return found.withColumn("target", _absolute("url", "href")).where("target IS NOT NULL AND instr(target, '://') > 0").select("url", "target")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Host, path, rule and verdict of every page, aliases included.

    pages: page_id, url, html; other columns are ignored. A null url, or one without ://, has
    empty host and path, no rule and no alias. Equal urls are one address. A null html has no links; a very long one is searched
    whole. Of several canonical links or refreshes of a page the first
    counts. An empty table gives an empty table. Returns one row for each row: page_id, host, path, rule (null where the method decided), verdict.
    """
    pages = pages.select("page_id", "url", "html")
    links = durable(alias_edges(pages))
    ends = links.select(F.col("url").alias("at")).union(links.select("target"))
    ends = ends.select(_number("at").alias("node"), host_of("at").alias("h"), path_of("at").alias("p"))
    ends = ends.select("node", matched_rule(rules, "h", "p").getField("verdict").alias("v")).groupBy("node").agg(F.max(F.col("v") == "allow").alias("allowed"), F.max(F.col("v") == "block").alias("blocked"))
    parts = components(links.select(_number("url").alias("a"), _number("target").alias("b")))
    group = parts.union(parts.select("component", "component").distinct())
    group = durable(group.join(ends, "node"))
    decided = durable(group.groupBy("component").agg(F.max("allowed").alias("allowed"), F.max("blocked").alias("blocked")))
    passed = F.when(F.col("allowed"), "allow").when(F.col("blocked"), "block")
    passed = durable(group.join(decided.select("component", passed.alias("passed")), "component").where("passed IS NOT NULL").select("node", "passed"))
    forget(links, parts, group, decided)
    own = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"), _number("url").alias("node"))
    own = own.withColumn("own", matched_rule(rules))
    out = own.join(passed, "node", "left")
    return out.select("page_id", "host", "path", F.col("own.rule").alias("rule"), F.coalesce("own.verdict", "passed", F.lit("allow")).alias("verdict"))


ORACLE = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, url, html, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
own AS (SELECT page_id, url, html, host, path,
  CASE WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'com' OR suffix(host, '.com')) AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/es/') THEN 'org/es/' END AS rule FROM h),
v AS (SELECT *, CASE WHEN rule IN ('example.com/en/7', 'net/de/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict,
             regexp_extract(url, '^([^#]*)', 1) AS node FROM own),
e AS (SELECT node AS a, regexp_extract(regexp_extract(html, '<link[^>]*rel="canonical"[^>]*>'), 'href="([^"#]*)', 1) AS b FROM v WHERE contains(html, 'canonical')
      UNION SELECT node, regexp_extract(regexp_extract(html, '<meta[^>]*http-equiv="refresh"[^>]*>'), 'url=([^"#]*)', 1) FROM v WHERE contains(html, 'refresh')),
both_ways AS (SELECT a, b FROM e WHERE b <> '' UNION SELECT b, a FROM e WHERE b <> ''),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON r.b = w.a),
passed AS (SELECT r.a AS node, CASE WHEN bool_or(v.verdict = 'allow') THEN 'allow' WHEN bool_or(v.verdict = 'block') THEN 'block' END AS verdict
           FROM reach r JOIN v ON v.node = r.b GROUP BY r.a)
SELECT v.page_id, v.host, v.path, v.rule, coalesce(v.verdict, passed.verdict, 'allow') AS verdict
FROM v LEFT JOIN passed USING (node)
"""
