"""URL filters with redirect equivalence.

Rules of a host and a path decide the URLs that they fit.  Pages that redirect
(``<meta http-equiv="refresh">``) or name a canonical page are aliases of it;
connected components over these edges carry a block to pages that no rule
fits, unless a page of the component is allowed by a rule.  URLs that differ in
scheme, fragment, tracking parameters or a closing slash are one node.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .licenses import LOWER, UPPER
from .staging import broadcast_if_small, staged

#: Rules of the check: (host, path, verdict) (fixed values).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Rules up to which they are held in the expression; more are joined by host.
INLINE_RULES = 200
HOST, PATH = r"(?s)^.*?://([^/?#]*)", r"(?s)^.*?://[^/?#]*([^?#]*)"
#: Start of the names of query parameters that don't tell pages apart.
TRACKING = "utm_"
#: Targets of canonical links and refresh redirects.
CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*\burl\s*=\s*["']?([^"'\s>]+)"""
#: The same with the attributes of a tag in any order, and a target's scheme.
LINK, META = r"(?is)<link\b[^>]*>", r"(?is)<meta\b[^>]*>"
IS_CANONICAL, IS_REFRESH = r"""(?is)\brel\s*=\s*["']?canonical\b""", r"""(?is)\bhttp-equiv\s*=\s*["']?refresh\b"""
TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, HOST, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The form that equivalent URLs share; null for null and for what has no ``://``."""
    given = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(given, lambda x: (x != "") & ~x.startswith(TRACKING)), "&")
    return F.when(url.contains("://"), F.concat(host_of(url), F.regexp_replace(path_of(url), "/+$", ""), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments carried out."""
    first = F.array().cast("array<string>")
    parts = F.aggregate(
        F.split(path, "/"),
        first,
        lambda done, x: F.when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(1)))).when(x == ".", done).otherwise(F.concat(done, F.array(x))),
    )
    return F.array_join(parts, "/")


def absolute(target: Column, host: Column, path: Column) -> Column:
    """A link target as a URL: absolute ones, and those relative to the host or to the page's path; null for other schemes."""
    rest = F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    own = F.regexp_extract(target, r"(?s)^[^?#]*", 0)
    folder = F.when(path.startswith("/"), F.regexp_extract(path, r"(?s)^.*/", 0)).otherwise("/")
    place = F.when(own == "", path).when(own.startswith("/"), without_dots(own)).otherwise(without_dots(F.concat(folder, own)))
    return (
        F.when(target.rlike(SCHEME + "//"), target)
        .when(target.startswith("//"), F.concat(F.lit("http:"), target))
        .when(~target.rlike(SCHEME), F.concat(F.lit("http://"), host, place, rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Edges (a, b) from each page's node to those of its canonical links and its redirects."""
    page, link = F.col(html), F.col(url)

    def targets(tag: str, kind: str, target: str) -> Column:
        tags = F.filter(F.regexp_extract_all(page, F.lit(tag), F.lit(0)), lambda x: x.rlike(kind))
        return F.when(page.rlike(kind), F.transform(tags, lambda x: F.regexp_extract(x, target, 1))).otherwise(F.array().cast("array<string>"))

    both = F.concat(targets(LINK, IS_CANONICAL, HREF), targets(META, IS_REFRESH, TARGET))
    found = pages.select(link.alias("url"), F.explode(F.array_distinct(both)).alias("target")).where("target <> ''")
    return found.select(node_of(F.col("url")).alias("a"), node_of(absolute(F.col("target"), host_of(F.col("url")), path_of(F.col("url")))).alias("b")).where("a <> b")


def fitting(rules: Column, host: Column, path: Column) -> Column:
    """The rules of an array that fit a URL, the longest first; of equal ones allow before block."""
    fits = F.filter(rules, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    order = F.transform(fits, lambda r: F.struct((-F.length(r["host"]) - F.length(r["path"])).alias("o"), r["verdict"].alias("verdict"), F.concat(r["host"], r["path"]).alias("rule")))
    return F.array_min(order)


def ruled(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (with ``host`` and ``path``) with ``best``: the longest fitting rule, or null.

    A small rule table is part of the expression.  A larger one is joined to the distinct hosts and their
    parent domains, and the candidates of a host to its pages, so that a hot host is one row before that.
    """
    named = rules.select(F.col("host").cast("string").alias("host"), F.col("path").cast("string").alias("path"), F.col("verdict").cast("string").alias("verdict")).distinct()
    if named.count() <= INLINE_RULES:
        listed = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), r, strict=True)]) for r in named.collect()]
        known = F.array(*listed) if listed else F.expr("array(named_struct('host', '', 'path', '', 'verdict', ''))")
        return pages.withColumn("best", fitting(known, F.col("host"), F.col("path")) if listed else F.lit(None).cast("struct<o int, verdict string, rule string>"))
    hosts = pages.select("host").where("host <> ''").distinct()
    parts = F.split("host", r"\.")
    parents = hosts.select(F.col("host").alias("page_host"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))).alias("host"))
    by_host = staged(parents.join(named, "host").groupBy("page_host").agg(F.collect_list(F.struct("host", "path", "verdict")).alias("rules")))
    joined = pages.join(broadcast_if_small(by_host), F.col("host") == F.col("page_host"), "left").drop("page_host")
    return joined.withColumn("best", F.when(F.col("rules").isNotNull(), fitting(F.col("rules"), F.col("host"), F.col("path")))).drop("rules")


def url_verdicts(pages: DataFrame, rules: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Per row: ``page_id``, ``host``, ``path``, ``rule`` (the longest fitting one, else null) and ``verdict``.

    The verdict is the rule's; without one it is block if a page of the same component is blocked by a
    rule and none is allowed by one, else allow.  ``edges`` (a, b: URLs) are added to those found in the pages.
    A null URL, or one without ``://``, has an empty host and path, no aliases, and is allowed.
    """
    url = F.col("url")
    placed = staged(ruled(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("node")), rules))
    links = alias_edges(pages)
    if edges is not None:
        links = links.unionByName(edges.select(node_of(F.col("a")).alias("a"), node_of(F.col("b")).alias("b")).where("a <> b"))
    of_node = connected_components(links)
    facts = placed.where("node is not null").groupBy("node").agg(
        F.coalesce(F.bool_or(F.col("best.verdict") == "block"), F.lit(False)).alias("blocked"),
        F.coalesce(F.bool_or(F.col("best.verdict") == "allow"), F.lit(False)).alias("allowed"),
        F.bool_or(F.col("best").isNull()).alias("open"),
    )
    joined = facts.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
    stopped = joined.groupBy("component").agg(F.bool_or("blocked").alias("b"), F.bool_or("allowed").alias("a"), F.bool_or("open").alias("o")).where("b and o and not a")
    spread = staged(joined.where("open").join(stopped.select("component"), "component", "left_semi").select("node", F.lit(True).alias("spread")))
    done = placed.join(broadcast_if_small(spread), "node", "left")
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("spread"), "block").otherwise("allow"))
    return done.select("page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
