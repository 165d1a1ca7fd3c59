"""URL filters: redirect equivalence.

Rules (host, path, action) decide for the urls they fit: a rule fits its host and all subdomains, if the url's
path starts with the rule's; the longest wins (host and path together; of equally long ones allow, then the
greater string). Urls that no rule fits take the decision of their aliases: redirects (meta refresh) and
canonical links are edges between urls, connected components over them are sets of aliases, and a component
with a block decision is blocked, unless it also has an explicit allow decision, which takes precedence. All
else is allowed. A rule on the url itself always stands.

Defined results: a null url or one without `://` has empty host and path, fits no rule and has no aliases; repeated rows are each
judged; an empty table gives an empty one; null html has no edges. Relative link targets (of a host, a path or a query; with `.` and `..`) are resolved
against the page's own url; fragments alone and other schemes (mailto:) are no links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import checkpoint, components

#: (host, path, action)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def rule_column(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, action) of the longest rule that fits, else null; rules are tried from the longest on."""
    out = None
    for h, p, action in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[2], r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def alias_key(url: Column) -> Column:
    """What two spellings of one address share: host in lower case, path without a closing slash, query; no scheme, no fragment."""
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), query))


#: A link tag whose rel holds canonical, alone or among others; a meta tag that refreshes.
CANONICAL = r"(?is)^<link\b.*\srel\s*=\s*(?:\"(?:[^\"]*\s)?canonical(?:\s[^\"]*)?\"|'(?:[^']*\s)?canonical(?:\s[^']*)?'|canonical[\s/>])"
REFRESH = r"(?is)^<meta\b.*\shttp-equiv\s*=\s*[\"']?refresh\b"


def without_dots(path: Column) -> Column:
    """A path that starts with a slash, its `.` and `..` taken away; what follows it (query, fragment) stays."""
    parts = F.split(F.regexp_extract(path, r"(?s)^[^?#]*", 0), "/")
    step = lambda a, x: F.when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    clean = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step), "/")
    return F.concat(clean, F.regexp_extract(path, r"(?s)^[^?#]*(.*)$", 1))


def resolved(target: Column, url: Column) -> Column:
    """Absolute url of a link target in a page; null for what is no link."""
    scheme, origin = F.regexp_extract(url, r"(?s)^(.*?:)//", 1), F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    path = F.regexp_extract(url, PARTS, 2)
    folder = F.concat(F.regexp_extract(path, r"(?s)^(.*/)", 1), F.when(path.contains("/"), "").otherwise("/"))
    return (
        F.when(~url.contains("://") | (target == "") | target.startswith("#"), None)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target).when(target.startswith("//"), F.concat(scheme, target)).when(target.startswith("/"), F.concat(origin, without_dots(target)))
        .when(target.startswith("?"), F.concat(origin, path, target)).when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), None).otherwise(F.concat(origin, without_dots(F.concat(folder, target))))
    )


def links(html: Column, url: Column) -> Column:
    """Absolute targets of canonical links and meta refreshes in a page."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?is)(<(?:link|meta)\b[^>]*>)"), 1), lambda t: t.rlike(CANONICAL) | t.rlike(REFRESH))
    quoted = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    refresh = r"(?is)\burl\s*=\s*['\"]?([^'\"\s>;]+)"
    def target(t: Column) -> Column:
        href = F.concat(F.regexp_extract(t, quoted, 1), F.regexp_extract(t, quoted, 2), F.regexp_extract(t, quoted, 3))
        return F.replace(F.trim(F.when(t.rlike("(?is)^<link"), href).otherwise(F.regexp_extract(t, refresh, 1))), F.lit("&amp;"), F.lit("&"))
    return F.filter(F.transform(tags, lambda t: resolved(target(t), url)), lambda x: x.isNotNull())


def judge(pages: DataFrame, rules=RULES, url: str = "url", html: str = "html") -> DataFrame:
    """The rows of `pages` as struct `row`, with host, path, rule and verdict."""
    df = pages.select(F.struct("*").alias("row"), F.col(url).alias("url"), F.col(html).alias("html"))
    df = df.withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    df = df.withColumn("hit", rule_column(F.col("host"), F.col("path"), rules)).withColumn("alias", alias_key(F.col("url")))
    # A null or odd link has no key and so no edge.
    edges = df.select("alias", "url", F.explode(links(F.col("html"), F.col("url"))).alias("to"))
    edges = edges.select(F.col("alias").alias("a"), F.col("to").alias("to_url"), alias_key(F.col("to")).alias("b")).where("a is not null and b is not null and a <> b")
    edges = checkpoint(edges.distinct())
    judged = df.drop("html", "url")
    if edges.isEmpty():
        joined = judged.withColumn("found", F.lit(None).cast("string"))
    else:
        # Decisions of linked addresses only: the rules run on both ends, also on targets that are no page here.
        ends = edges.select(F.col("a").alias("alias")).union(edges.select("b")).distinct()
        node = lambda c: F.xxhash64(c)
        sets = components(edges.select(node("a").alias("u"), node("b").alias("v")))
        bare = F.concat(F.lit("x://"), F.col("alias"))
        own = ends.select("alias", node("alias").alias("node"), rule_column(host_of(bare), path_of(bare), rules)["action"].alias("action"))
        seen = checkpoint(own.join(sets, "node"))
        ruled = seen.where("action is not null").groupBy("component").agg(F.min("action").alias("found"))  # allow < block
        found = checkpoint(seen.join(ruled, "component").select("alias", "found"))
        joined = judged.join(found, "alias", "left")
    verdict = F.coalesce(F.col("hit.action"), F.col("found"), F.lit("allow"))
    return joined.select("row", "host", "path", F.col("hit.rule").alias("rule"), verdict.alias("verdict"))
