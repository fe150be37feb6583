"""URL filters by redirect equivalence: rules decide what they fit, and a block reaches every alias of a blocked address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _stored, components, drop, dropped_after, lower_ascii, store, table

#: Fixed values of the registered query: verdict, host, path.
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, with A-Z lower-cased; empty where there is none."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; empty where there is no ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Named character references that addresses have, &amp; last.
NAMED = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def _without_dots(path: Column) -> Column:
    """path with the segments . and .. taken out, as RFC 3986 has it."""
    parts = F.split(path, "/")
    rest = F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.lit(""), lambda at, x: F.when(x == ".", at).when(x == "..", F.regexp_replace(at, r"/[^/]*\z", "")).otherwise(F.concat(at, F.lit("/"), x)))
    return F.when(path.rlike(r"/\.\.?(/|\z)"), F.concat(rest, F.when(path.rlike(r"/\.\.?\z"), "/").otherwise(""))).otherwise(path)


def _key(url: Column) -> Column:
    """One spelling of an address: lower-cased scheme and host, no port of the scheme's own, a path of at least /, without dot segments or fragment. Null without ://."""
    scheme = lower_ascii(F.regexp_extract(url, r"(?s)^\s*(.*?)://", 1))
    host = host_of(url)
    host = F.when(scheme == "http", F.regexp_replace(host, r":(80)?\z", "")).when(scheme == "https", F.regexp_replace(host, r":(443)?\z", "")).otherwise(host)
    path = path_of(url)
    query = F.regexp_extract(url, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(path == "", "/").otherwise(_without_dots(path)), query))


def _decoded(text: Column) -> Column:
    """text with its character references resolved: numbers, and the names in NAMED."""
    parts = F.split(text, "&#", -1)
    digits = r"^(?:[xX][0-9A-Fa-f]{1,6}|[0-9]{1,7});"  # of a part that follows &#
    code = lambda x: F.when(x.rlike("^[xX]"), F.regexp_extract(x, r"^[xX]([0-9A-Fa-f]+)", 1)).otherwise(F.conv(F.regexp_extract(x, r"^([0-9]+)", 1), 10, 16))
    char = lambda x: F.decode(F.unhex(F.lpad(code(x), 8, "0")), "UTF-32")
    each = F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: F.when(x.rlike(digits), F.concat(char(x), F.regexp_replace(x, digits, ""))).otherwise(F.concat(F.lit("&#"), x)))
    out = F.when(text.contains("&#"), F.concat(parts[0], F.array_join(each, ""))).otherwise(text)
    for name, sign in NAMED:
        out = F.replace(out, F.lit(name), F.lit(sign))
    return out


def _resolved(base: Column, link: Column) -> Column:
    """The address that link names, seen from the address base, as RFC 3986 has it but for dot segments, which _key() takes out; null for an empty link."""
    site = F.regexp_extract(base, r"(?s)^\s*(.*?://[^/?#]*)", 1)
    path, query = path_of(base), F.regexp_extract(base, r"(?s)^.*?://[^?#]*(\?[^#]*)", 1)
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    own, asked = F.regexp_extract(link, r"(?s)^([^?#]*)", 1), F.regexp_extract(link, r"(?s)^[^?#]*(\?[^#]*)", 1)
    return (
        F.when(link.isNull() | (link == ""), None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^\s*(.*?:)//", 1), link))
        .when(own == "", F.concat(site, path, F.when(asked == "", query).otherwise(asked)))
        .when(own.startswith("/"), F.concat(site, own, asked))
        .otherwise(F.concat(site, F.when(folder == "", "/").otherwise(folder), own, asked))
    )


def _attribute(tag: Column, name: str) -> Column:
    """The value of an attribute, in quotes or bare, with references resolved and no blanks around it; empty where there is none."""
    pattern = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    return F.regexp_replace(_decoded(F.concat(*[F.regexp_extract(tag, pattern, k) for k in (1, 2, 3)])), r"^\s+|\s+\z", "")


def _rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict. Of equally long ones an allow comes first, then the longer host."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", -len(r[1])))
    fits = [((host == h) | host.endswith("." + h)) & path.startswith(p) for _, h, p in order]
    named = F.coalesce(*[F.when(f, F.lit(h + p)) for f, (_, h, p) in zip(fits, order)], F.lit(None).cast("string"))
    said = F.coalesce(*[F.when(f, F.lit(v)) for f, (v, _, _) in zip(fits, order)], F.lit(None).cast("string"))
    return named, said


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """src, dst: each page and the addresses that its canonical link and its refresh name, seen from its base."""
    u, h = F.col(url), F.col(html)
    tag = lambda pattern: F.regexp_extract(h, "(?is)" + pattern, 0)
    link = tag(r"<link\b[^>]*\srel\s*=\s*(?:\"[^\">]*\bcanonical\b[^\">]*\"|'[^'>]*\bcanonical\b[^'>]*'|canonical\b)[^>]*>")
    meta = tag(r"<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>")
    # Each step is a table of the few short strings that the next one needs, so that no expression holds all steps in it.
    found = pages.where(u.contains("://") & h.rlike("(?i)canonical|refresh")).select(u.alias("src"), link.alias("link"), meta.alias("meta"), tag(r"<base\b[^>]*\shref\s*=[^>]*>").alias("base"))
    found, _ = store(found.where("link <> '' OR meta <> ''"), "link-tags")
    found, _ = store(found.select("src", _attribute(F.col("link"), "href").alias("link"), _attribute(F.col("meta"), "content").alias("meta"), _attribute(F.col("base"), "href").alias("base")), "link-values")
    refresh = F.regexp_replace(F.regexp_extract("meta", r"(?is)^[^;,]*[;,]\s*url\s*=\s*[\"']?([^\"']*)", 1), r"\s+\z", "")
    found, _ = store(found.select("src", F.coalesce(_resolved(F.col("src"), F.col("base")), F.col("src")).alias("base"), F.explode(F.array("link", refresh)).alias("dst")), "links")
    return found.where("dst <> ''").select("src", _resolved(F.col("base"), F.col("dst")).alias("dst"))


def filter_urls(pages: DataFrame, rules=RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url: str = "url", html: str | None = "html") -> DataFrame:
    """id, host, path, rule, verdict of every row of pages.

    redirects (src, dst) adds known redirects to the links found in html. Addresses that are joined by such links are
    aliases. A rule decides the addresses that it fits. Any other address is blocked if an alias of it is blocked by a
    rule and none is allowed by one: an explicit allow comes before a block that is only inherited. All else is allowed.
    Links are taken from the first canonical link and refresh of a page, with character references and its base resolved.
    Null addresses and those without :// have empty host and path, no alias, and are allowed; repeated rows each get
    their own; an empty table gives none. rules is a parameter held in the plan, so it is meant for some hundreds.
    """
    u = F.col(url)
    first = set(_stored)
    edges = [alias_edges(pages, url, html)] if html else []
    if redirects is not None:
        edges.append(redirects.select(F.col("src").cast("string"), F.col("dst").cast("string")))
    named, said = _rule(F.col("host"), F.col("path"), rules)
    out = pages.select(F.col(id_col).alias("page_id"), host_of(u).alias("host"), path_of(u).alias("path"), _key(u).alias("_key"))
    out = out.withColumn("rule", named).withColumn("_said", said)
    if not edges:
        return out.select("page_id", "host", "path", "rule", F.coalesce("_said", F.lit("allow")).alias("verdict"))
    links = edges[0] if len(edges) == 1 else edges[0].unionByName(edges[1])
    with dropped_after(pages.sparkSession, keep := []):
        nodes, path = store(components(links.select(_key(F.col("src")).alias("a"), _key(F.col("dst")).alias("b"))), "aliases")
        nodes = nodes.withColumn("host", host_of(F.col("node"))).withColumn("path", path_of(F.col("node"))).withColumn("_said", said)
        ruled = nodes.groupBy("component").agg(F.bool_or(F.coalesce(F.col("_said") == "block", F.lit(False))).alias("b"), F.bool_or(F.coalesce(F.col("_said") == "allow", F.lit(False))).alias("a"))
        ruled, blocked = store(ruled.where("b AND NOT a").select("component"), "blocked-components")
        keep += [path, blocked]
    drop(pages.sparkSession, *[p for p in _stored if p not in first and p not in keep])
    blocked = nodes.join(ruled, "component", "left_semi").select(F.col("node").alias("_key"), F.lit("block").alias("_by_alias"))
    return out.join(blocked, "_key", "left").select("page_id", "host", "path", "rule", F.coalesce("_said", "_by_alias", F.lit("allow")).alias("verdict"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"))


#: The address that dst names, seen from the address base.
_RESOLVED = r"""CASE WHEN regexp_matches(dst, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN dst
    WHEN starts_with(dst, '//') THEN regexp_extract(base, '(?s)^\s*(.*?:)//', 1) || dst
    WHEN starts_with(dst, '?') THEN regexp_extract(base, '(?s)^\s*(.*?://[^?#]*)', 1) || dst
    WHEN starts_with(dst, '#') THEN regexp_extract(base, '(?s)^\s*(.*?://[^#]*)', 1) || dst
    WHEN starts_with(dst, '/') THEN regexp_extract(base, '(?s)^\s*(.*?://[^/?#]*)', 1) || dst
    ELSE coalesce(nullif(regexp_extract(base, '(?s)^\s*(.*?://[^/?#]*/(?:[^?#]*/)?)', 1), ''), regexp_extract(base, '(?s)^\s*(.*?://[^/?#]*)', 1) || '/') || dst END"""

OP8_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
tags AS (
  SELECT url AS src,
         regexp_extract(html, '(?is)<base\b[^>]*\shref\s*=[^>]*>', 0) AS b,
         regexp_extract(html, '(?is)<link\b[^>]*\srel\s*=\s*(?:"[^">]*\bcanonical\b[^">]*"|''[^''>]*\bcanonical\b[^''>]*''|canonical\b)[^>]*>', 0) AS l,
         regexp_extract(html, '(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0) AS m
  FROM p WHERE contains(url, '://') AND html IS NOT NULL),
given AS (
  SELECT src, [regexp_extract(b, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), regexp_extract(l, '(?is)[\s"''/]href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1),
    regexp_extract(m, '(?is)[\s"''/]content\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1)] AS v
  FROM tags WHERE l <> '' OR m <> ''),
bare AS (SELECT src, list_transform(v, lambda x: string_split(CASE WHEN x[1] IN ('"', '''') THEN x[2:-2] ELSE x END, '&#')) AS v FROM given),
plain AS (
  SELECT src, list_transform(v, lambda x: regexp_replace(regexp_replace(replace(replace(replace(replace(replace(list_aggregate(list_concat([x[1]], list_transform(x[2:], lambda y:
    CASE WHEN regexp_matches(y, '^(x[0-9a-fA-F]{1,6}|X[0-9a-fA-F]{1,6}|[0-9]{1,7});') THEN chr(CASE WHEN lower(y[1]) = 'x' THEN ('0x' || regexp_extract(y, '^.([0-9a-fA-F]+);', 1))::INTEGER ELSE regexp_extract(y, '^([0-9]+);', 1)::INTEGER END) || regexp_replace(y, '^[^;]*;', '') ELSE '&#' || y END)), 'string_agg', ''),
    '&quot;', '"'), '&apos;', ''''), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '^\s+', ''), '\s+$', '')) AS v
  FROM bare),
seen AS (SELECT src, src AS base, v[1] AS dst, [v[2], regexp_replace(regexp_extract(v[3], '(?is)^[^;,]*[;,]\s*url\s*=\s*["'']?([^"'']*)', 1), '\s+$', '')] AS links FROM plain),
rebased AS (SELECT src, coalesce(named, src) AS base, unnest(links) AS dst FROM (SELECT *, CASE WHEN dst <> '' THEN RESOLVED END AS named FROM seen)),
ends AS (SELECT src, RESOLVED AS dst FROM rebased WHERE dst <> ''),
keys AS (
  SELECT u AS url, s || '://' || CASE s WHEN 'http' THEN regexp_replace(h, ':(80)?$', '') WHEN 'https' THEN regexp_replace(h, ':(443)?$', '') ELSE h END
         || CASE WHEN regexp_matches(d, '/\.\.?(/|$)') THEN list_reduce(list_concat([''], string_split(d, '/')[2:]), lambda so_far, x: CASE x WHEN '.' THEN so_far WHEN '..' THEN regexp_replace(so_far, '/[^/]*$', '') ELSE so_far || '/' || x END) || CASE WHEN regexp_matches(d, '/\.\.?$') THEN '/' ELSE '' END ELSE coalesce(nullif(d, ''), '/') END
         || regexp_extract(u, '(?s)^.*?://[^?#]*(\?[^#]*)', 1) AS k
  FROM (SELECT u, lower(regexp_extract(u, '(?s)^\s*(.*?)://', 1)) AS s, translate(regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h, regexp_extract(u, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS d
        FROM (SELECT src AS u FROM ends UNION SELECT dst FROM ends WHERE contains(dst, '://') UNION SELECT url FROM p WHERE contains(url, '://')))),
e AS (SELECT DISTINCT x.k AS a, y.k AS b FROM ends JOIN keys x ON x.url = src JOIN keys y ON y.url = dst WHERE x.k <> y.k),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT r.a, w.b FROM reach r JOIN both_ways w ON w.a = r.b),
parts AS (SELECT DISTINCT b AS k, regexp_extract(b, '(?s)^.*?://([^/?#]*)', 1) AS host, regexp_extract(b, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM reach),
said AS (SELECT k, arg_max(verdict, length(rhost || rpath)) AS verdict FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY k),
inherited AS (SELECT r.a AS k FROM reach r JOIN said ON said.k = r.b GROUP BY r.a HAVING bool_or(verdict = 'block') AND NOT bool_or(verdict = 'allow')),
fit AS (SELECT page_id, url, host, path, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(verdict, length(rhost || rpath)) AS verdict, rid
        FROM (SELECT *, row_number() OVER () AS rid FROM p) q LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        GROUP BY page_id, url, host, path, rid)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM inherited i JOIN keys USING (k) WHERE keys.url = fit.url) THEN 'block' ELSE 'allow' END) AS verdict
FROM fit
""".replace("RESOLVED", _RESOLVED)
