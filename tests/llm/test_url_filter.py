import re
from urllib.parse import urljoin

import duckdb
from pyspark.sql import functions as F

from lumenrec.llm.common import components
from lumenrec.llm.url_filter import OP8_SQL, RULES, _key, _resolved, alias_edges, filter_urls

PAGES = "page_id long, url string, html string, host string, path string, rule string, component string"


def plain_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest, re.S).group()
    path = re.match(r"[^?#]*", rest[len(host) :], re.S).group()
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fits = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fits, key=lambda r: len(r[1] + r[2]), default=None)


def canonical(url):
    return f"<html><head><link href='{url}' rel=\"canonical\"></head>"


URLS = [
    "http://a.example.net/en/1", "https://EXAMPLE.net/en/", "http://example.net/fr/", "http://notexample.net/en/", "http://example.com/de/x", "http://sub.example.com/de",
    "http://x.org/fr/y?q#f", "http://org/fr/", "http://fr.org", "http://x.net", "http://x.net/", "http://x.net?a/b", "no scheme", "", None, "://net/", "a://b.net/c://d", "http://user@h.net:80/",
    "HTTP://UP.ORG/FR/", "http://ünï.net/", "x\ny://l.net/z", "http://h.net\n/a",
]


def test_rules_against_brute_force(spark):
    rows = [(i, u, None, "x", "x", "x", "x") for i, u in enumerate(URLS)] + [(0, URLS[0], None, "x", "x", "x", "x"), (None, URLS[4], "", "x", "x", "x", "x")]
    got = sorted((tuple(r) for r in filter_urls(spark.createDataFrame(rows, PAGES)).collect()), key=str)
    want = []
    for i, u, *_ in rows:
        host, path = plain_parts(u)
        r = plain_rule(host, path)
        want.append((i, host, path, r and r[1] + r[2], r[0] if r else "allow"))
    assert got == sorted(want, key=str)
    assert filter_urls(spark.createDataFrame([], PAGES)).collect() == []


def test_blocks_reach_aliases_and_explicit_allows_come_first(spark):
    pages = [
        (1, "http://one.example.edu/a", canonical("http://spam.net/x")),  # alias of a blocked address that is no page
        (2, "http://two.example.edu/b", '<meta http-equiv="Refresh" content="0; url=http://one.example.edu/a">'),
        (3, "http://three.example.edu/c", canonical("/d")),
        (4, "http://three.example.edu/d#frag", None),
        (5, "http://four.example.edu/", canonical("http://blocked.net/q")),
        (6, "http://ok.example.net/en/page", canonical("http://four.example.edu")),  # an explicit allow among the aliases
        (7, "http://blocked.net/q", None),
        (8, "http://far.example.edu/", None),
        (9, "http://hop.example.edu/x", canonical("y?k=1&amp;l=2")),
        (10, "http://hop.example.edu/y?k=1&l=2", canonical("//bad.net/z")),
    ]
    df = spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in pages], PAGES)
    redirects = spark.createDataFrame([("http://far.example.edu/", "http://two.example.edu/b"), (None, "x")], "src string, dst string")
    got = {r.page_id: (r.rule, r.verdict) for r in filter_urls(df, redirects=redirects).collect()}
    assert got == {1: (None, "block"), 2: (None, "block"), 3: (None, "allow"), 4: (None, "allow"), 5: (None, "allow"), 6: ("example.net/en/", "allow"), 7: ("net/", "block"), 8: (None, "block"), 9: (None, "block"), 10: (None, "block")}
    assert alias_edges(df).count() == 7


def test_components(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3), (2000, 2001), (2001, 2000), (300, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    want = {k: 0 for k in range(301)} | {k: 1000 for k in range(1000, 1200)} | {2000: 2000, 2001: 2000}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


#: The examples of RFC 3986, section 5.4, from http://a/b/c/d;p?q, but for those whose scheme has no authority.
RFC = {
    "g": "/b/c/g", "./g": "/b/c/g", "g/": "/b/c/g/", "/g": "/g", "?y": "/b/c/d;p?y", "g?y": "/b/c/g?y", "#s": "/b/c/d;p?q", "g#s": "/b/c/g", "g?y#s": "/b/c/g?y", ";x": "/b/c/;x", "g;x": "/b/c/g;x", "g;x?y#s": "/b/c/g;x?y",
    ".": "/b/c/", "./": "/b/c/", "..": "/b/", "../": "/b/", "../g": "/b/g", "../..": "/", "../../": "/", "../../g": "/g", "../../../g": "/g", "../../../../g": "/g", "/./g": "/g", "/../g": "/g", "g.": "/b/c/g.", ".g": "/b/c/.g", "g..": "/b/c/g..",
    "..g": "/b/c/..g", "./../g": "/b/g", "./g/.": "/b/c/g/", "g/./h": "/b/c/g/h", "g/../h": "/b/c/h", "g;x=1/./y": "/b/c/g;x=1/y", "g;x=1/../y": "/b/c/y", "g?y/./x": "/b/c/g?y/./x", "g?y/../x": "/b/c/g?y/../x", "g#s/../x": "/b/c/g",
}


def test_links_are_resolved_as_the_standard_has_it(spark):
    base = "http://a/b/c/d;p?q"
    rows = spark.createDataFrame([(base, k) for k in [*RFC, "//g", "//G:80/x", "http://H:443", "https://h:443/./", ""]], "base string, link string")
    got = {r.link: r.k for r in rows.select("link", _key(_resolved(F.col("base"), F.col("link"))).alias("k")).collect()}
    assert got == {k: "http://a" + v for k, v in RFC.items()} | {"//g": "http://g/", "//G:80/x": "http://g/x", "http://H:443": "http://h:443/", "https://h:443/./": "https://h/", "": None}
    assert all(urljoin(base, k).split("#")[0] == "http://a" + v for k, v in RFC.items())


LINKED = [
    ("http://one.example.edu/a/b", '<base href="/x/"><link rel="canonical" href="../y">', "http://one.example.edu/y"),
    ("http://two.example.edu/a/b", "<LINK REL=canonical HREF=?x=1>", "http://two.example.edu/a/b?x=1"),
    ("http://three.example.edu/a/b?q", '<link rel="canonical" href="#f">', "http://three.example.edu/a/b?q"),
    ("http://four.example.edu/a", '<link rel="next canonical" href="http&#58;//spam.net&#x2F;q?a=1&amp;b=2">', "http://spam.net/q?a=1&b=2"),
    ("http://five.example.edu/", "<meta http-equiv=refresh content='3; URL=\"  c/../d\"'>", "http://five.example.edu/d"),
    ("http://six.example.edu", '<base target=x><base href="//other.net"><link href=" z " rel=canonical>', "http://other.net/z"),
    ("http://seven.example.edu/q", '<link rel="stylesheet" href="/s"><link rel="canonicals" href="/t"><meta http-equiv="refresh" content="5">', None),
    ("http://eight.example.edu/q", '<link rel="canonical" href="mailto:x@y.net">', None),
    ("http://nine.example.edu/q", None, None),
]


def test_links_of_pages(spark):
    rows = spark.createDataFrame([(k, u, h, "x", "x", "x", "x") for k, (u, h, _) in enumerate(LINKED)], PAGES)
    got = {r.src: r.k for r in alias_edges(rows).select("src", _key(F.col("dst")).alias("k")).collect()}
    assert {u: got.get(u) for u, _, _ in LINKED} == {u: k for u, _, k in LINKED}


def test_sql_on_pages_with_links(spark, tmp_path):
    """The SQL resolves links in its own way; both agree on pages that have them."""
    pages = [(u, h) for u, h, _ in LINKED] + [(k, None) for _, _, k in LINKED if k]
    pages += [(f"http://r{n}.example.edu/b/c/d;p?q", canonical(link.replace("/g", "/de/g"))) for n, link in enumerate(RFC)]
    pages += [(f"http://r{n}.example.edu/b/g", canonical(f"//hub{n % 5}.example.edu/./")) for n in range(len(RFC))]
    pages += [(f"http://hub{n}.example.edu", canonical(["http://x.net/", "http://example.com/de/", "http://fr.org/fr/a", "", "http://EXAMPLE.COM:80/a/../de/x"][n])) for n in range(5)]
    pages += [(u, canonical("http://hub0.example.edu/")) for u in URLS]
    df = spark.createDataFrame([(k, u, h) for k, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    got = sorted(tuple(r[c] for c in columns) for r in filter_urls(df).collect())
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({OP8_SQL})").fetchall())
    assert sum(r[3] is None and r[4] == "block" for r in got) > 8
