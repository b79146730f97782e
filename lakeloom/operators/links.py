"""Links of web pages: references found in markup, resolved against their page, and the ranks of the hosts they join.

References are found by built-in functions; each is resolved by the rules of
RFC 3986, a short function over Arrow batches. Ranks are computed on edges
between hosts, aggregated with their counts: a hot host is a row with a large
count, not many rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialize, release

#: The opening tag of a link up to its reference, which is quoted or ends with white space or >. Nothing is given back (possessive
#: quantifiers), so that time is linear and no match recurses.
ANCHOR = r"""(?i)<a\s(?:[^>"'h]++|"[^"]*+"|'[^']*+'|(?<![\s"'/])h|h(?!ref\s*+=))*+href\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)"""
#: A chunk of markup that may hold one link: from one <a to the next.
OPENING = r"(?i)(?=<a\s)"
DAMPING, ROUNDS = 0.85, 20
PORTS = {"http": "80", "https": "443"}


def references(html: Column) -> Column:
    """The references of all links in markup, in page order, quotes taken off and character references of & decoded."""
    pieces = F.filter(F.split(F.coalesce(html, F.lit("")), OPENING), lambda x: F.lower(F.substring(x, 1, 2)) == "<a")
    found = F.transform(pieces, lambda x: F.regexp_extract(x, ANCHOR, 1))
    plain = F.transform(F.filter(found, lambda x: x != ""), lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return F.transform(plain, lambda x: F.trim(F.replace(x, F.lit("&amp;"), F.lit("&"))))


def resolve(base: str | None, reference: str | None) -> str | None:
    """An absolute http(s) URL without fragment, scheme and host in lower case, default ports and empty paths made plain; None if there is none."""
    if base is None or reference is None:
        return None
    try:
        parts = urlsplit(urljoin(base, reference))
        scheme, host, port = parts.scheme.lower(), (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if scheme not in PORTS or not host:
        return None
    host = f"[{host}]" if ":" in host else host
    where = host if port is None or str(port) == PORTS[scheme] else f"{host}:{port}"
    return f"{scheme}://{where}{parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def _resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bases, refs = b.column(1).to_pylist(), b.column(3).to_pylist()
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([resolve(x, y) for x, y in zip(bases, refs, strict=True)], pa.string())], ["page_id", "url", "place", "target"])


def page_links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, place, target: one row for each link that resolves to an http(s) URL.

    `place` counts the page's links from 0, those that don't resolve too. Pages
    with a null url or html have none. Repeated pages have theirs each time; an
    empty table gives no rows; other columns are ignored.
    """
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.posexplode(references(F.col(f"`{html_col}`"))).alias("place", "ref"))
    return src.mapInArrow(_resolve, "page_id long, url string, place int, target string").where("target is not null")


def host_edges(links: DataFrame) -> DataFrame:
    """source, target, n: links between different hosts."""
    host = lambda c: F.lower(F.regexp_extract(c, "^[a-zA-Z]+://([^/?#]*)", 1))
    return links.select(host("url").alias("source"), host("target").alias("target")).where("source <> target AND source <> '' AND target <> ''").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


def ranks(edges: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """node, rank of a weighted graph (source, target, n), by `rounds` rounds of PageRank; ranks add up to 1.

    A node passes its rank on in proportion to n; one without outgoing edges
    passes it to all nodes alike. An edge with a null end or n below 1 is left
    out; no edges give no rows. A round is a join and a sum by node; its ranks
    are written, so that plans stay short, and those before it deleted.
    """
    e = materialize(edges.where("source is not null AND target is not null AND n >= 1").groupBy("source", "target").agg(F.sum("n").cast("double").alias("n")))
    out = e.groupBy(F.col("source").alias("node")).agg(F.sum("n").alias("out"))
    nodes = materialize(e.select(F.col("target").alias("node")).unionByName(out.select("node")).distinct().join(out, "node", "left"))
    count = nodes.count()
    if not count:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    shares = materialize(e.join(out, e["source"] == out["node"]).select("source", "target", (F.col("n") / F.col("out")).alias("share")))
    now = nodes.select("node", "out", F.lit(1.0 / count).alias("rank"))
    for _ in range(rounds):
        lost = now.where("out is null").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost")).first()["lost"]
        passed = shares.join(now.select(F.col("node").alias("source"), "rank"), "source").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) / count + damping * (F.coalesce("got", F.lit(0.0)) + lost / count)
        before, now = now, materialize(nodes.join(passed, "node", "left").select("node", "out", rank.alias("rank")))
        release(before)
    release(e, shares, nodes)
    return now.select("node", "rank")
