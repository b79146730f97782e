"""Links, their resolution and ranks against plain Python."""

import os
import time
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from lakeloom.operators import links


def found(spark, *pages):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, h string")
    return [r.r for r in df.select("i", links.references(F.col("h")).alias("r")).orderBy("i").collect()]


def test_references(spark):
    got = found(spark, None, "", "<a href=x>1</a><A class='q>' HREF = \"y&amp;z\" >2</a><a\nhref='w'>", "<abbr href=no><a name=n>no</a><a data-href=no>", "<a title=\"href='no'\" href=' sp '>", "<a href=>", "<a href='never closed")
    assert got == [[], [], ["x", "y&z", "w"], [], ["sp"], [], []]


def test_broken_markup_takes_linear_time(spark):
    n = 200_000
    began = time.perf_counter()
    got = found(spark, "<a " * n, "<a '" * n, "<a href='" * n, "<a x" + " y" * n, "<a href=x>" * n)
    assert time.perf_counter() - began < 60 and len(got[4]) == n


# The examples of RFC 3986, section 5.4, base http://a/b/c/d;p?q; fragments are dropped, an empty path is /.
EXAMPLES = {"g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g/", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q", "g#s": "http://a/b/c/g", ";x": "http://a/b/c/;x", "": "http://a/b/c/d;p?q", ".": "http://a/b/c/", "./": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../g": "http://a/g", "../../../g": "http://a/g", "/./g": "http://a/g", "g.": "http://a/b/c/g.", "./../g": "http://a/b/g", "g;x=1/../y": "http://a/b/c/y"}


def test_resolution():
    for ref, want in EXAMPLES.items():
        assert links.resolve("http://a/b/c/d;p?q", ref) == want, ref
    assert links.resolve("http://a/", "HTTPS://Ex.ORG:443/P?q#f") == "https://ex.org/P?q" and links.resolve("http://a:8080/x", "y") == "http://a:8080/y"
    assert all(links.resolve("http://a/", r) is None for r in ("mailto:x@y", "javascript:void(0)", "http://[bad", "http://a:no/", None)) and links.resolve(None, "x") is None
    assert links.resolve("http://[::1]:80/a", "b") == "http://[::1]/b"


class Anchors(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = []

    def handle_starttag(self, tag, attrs):
        if tag == "a" and dict(attrs).get("href"):
            self.found.append(dict(attrs)["href"].strip())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_page_links_against_a_plain_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {}
    for r in links.page_links(pages).collect():
        got.setdefault(r.page_id, []).append((r.place, r.target))
    n = 0
    for r in pages.collect():
        parser = Anchors()
        parser.feed(r.html)
        want = [(i, t) for i, h in enumerate(parser.found) if (t := links.resolve(r.url, h))]
        assert sorted(got.get(r.page_id, [])) == want, (r.page_id, got.get(r.page_id), want)
        assert all(urljoin(r.url, h).split("#")[0].lower().startswith(t.lower().rstrip("/").split("?")[0][:12]) for (_, t), h in zip(want, [h for h in parser.found if links.resolve(r.url, h)], strict=True))
        n += len(want)
    assert n > 250


def test_ranks(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 1), ("d", "c", 5), ("c", "sink", 1), ("d", "c", 1), (None, "a", 1), ("a", None, 2), ("x", "y", 0)]
    got = {r.node: r["rank"] for r in links.ranks(spark.createDataFrame(edges, "source string, target string, n long"), rounds=40).collect()}
    w = {}
    for s, t, n in edges:
        if s and t and n:
            w[s, t] = w.get((s, t), 0) + n
    nodes = {x for k in w for x in k}
    rank = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(40):
        lost = sum(rank[x] for x in nodes if not any(s == x for s, _ in w))
        rank = {x: 0.15 / len(nodes) + 0.85 * (lost / len(nodes) + sum(rank[s] * n / sum(m for (a, _), m in w.items() if a == s) for (s, t), n in w.items() if t == x)) for x in nodes}
    assert got.keys() == nodes and all(abs(got[x] - rank[x]) < 1e-9 for x in nodes) and abs(sum(got.values()) - 1) < 1e-9
    assert links.ranks(spark.createDataFrame([], "source string, target string, n long")).count() == 0
