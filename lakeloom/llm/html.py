"""Main text of web pages by differencing each page with the page of nearest URL.

Markup decides first what can't be article: menus, headers, footers, sidebars,
notices, adverts, forms, comments, and, where a page marks its article,
everything outside it. What is left are the page's text lines (blocks). Pages
of one host that have the same lines are copies and count as one. Of each
host, the different pages are ordered by path, and a page is differenced with
the neighbour of longer common path prefix. The lines that the longest common
subsequence of both shares are deleted where the host bears out that they come
from its template:

* on a page without a marked article, those that a third page of the host
  holds too (or if it has just these two), so that two versions of one text
  don't erase each other;
* in a marked article, those that open or close it and stand on at least half
  of the host's pages and on FRAME of them: a sentence that some articles share
  is text, and stays.

Pages are parsed once. Only hashes of lines travel between pages. The order by
host and path is a range-partitioned sort, so that a host with a third of all
pages is spread over many tasks; neighbours across partitions are found by row
numbers.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import UPPER, materialize, release

#: Lists of deletions up to this many bytes are broadcast; longer ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Cells up to which the table of a longest common subsequence is kept as bits; larger ones are split.
TABLE_BITS = 1 << 26
#: Pages of a host that hold a line, at least, before it is taken out of a marked article; or out of an unmarked page.
FRAME, THIRD = 5, 3
#: Bytes of text in a batch of parsed pages, but for a longer page.
BATCH_BYTES = 8 << 20

NAME = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]++)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Elements without article text, wherever they stand; header only outside the article.
SKIPPED = frozenset("head nav footer aside form script style noscript template svg math iframe button select textarea title dialog menu object canvas audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Words of class or id that name such elements.
NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus footer gdpr login menu modal nav navbar navigation newsletter notice notification pager pagination popup promo promoted promotion related recommended replies reply respond share sharing sidebar signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split())
CLOSES_P = BLOCK - {"body", "html"}
#: A stray end tag of the second kind closes nothing outside its own container of the first.
CONTAINERS = frozenset("article main body td table section".split())
CONTAINED = frozenset("p li span a b i em strong".split())
RAW_END = {name: re.compile(rf"</{name}(?![a-zA-Z0-9:-])", re.I) for name in RAW}


class _Tags:
    """Tags of a page, in time linear in its length."""

    def __init__(self, page: str):
        self.page, self.last = page, page.rfind(">")
        # Places outside quotes from which no tag ends.
        self.dead: set[int] = set()

    def at(self, i: int) -> tuple[int, str, str, str] | None:
        """(end, slash, lower-case name, attributes) of what starts with the < at i; the name of comments is empty; None for a mere <."""
        page = self.page
        if page.startswith("<!--", i):
            end = page.find("-->", i + 4)
            return (len(page) if end < 0 else end + 3), "", "", ""
        if i > self.last:
            return None
        if page[i + 1] in "!?":
            return page.find(">", i) + 1, "", "", ""
        m = NAME.match(page, i)
        if not m:
            return None
        end = self._end(m.end())
        return end + 1, m[1], m[2].lower(), page[m.end() : end]

    def _end(self, at: int) -> int:
        """The first > outside quotes, or else, where quotes don't close, the first one."""
        first, seen = self.page.find(">", at), []
        while True:
            m = MARK.search(self.page, at)
            if m and m[0] == ">":
                return m.start()
            close = -1 if not m or m.start() in self.dead else self.page.find(m[0], m.end())
            if close < 0:
                self.dead.update(seen)
                if m:
                    self.dead.add(m.start())
                return first
            seen.append(m.start())
            at = close + 1


class _Open:
    """The open elements: name, skipped, in the article."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.places: dict[str, list[int]] = {}
        self.containers: list[int] = []

    def push(self, name: str, skipped: bool, inside: bool) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        if name in CONTAINERS:
            self.containers.append(len(self.stack))
        self.stack.append((name, skipped, inside))

    def last(self, name: str) -> int:
        places = self.places.get(name)
        return places[-1] if places else -1

    def cut(self, to: int) -> None:
        while len(self.stack) > to:
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name in CONTAINERS:
                self.containers.pop()

    def close(self, name: str) -> None:
        at = self.last(name)
        if at >= 0 and not (name in CONTAINED and self.containers and self.containers[-1] > at):
            self.cut(at)

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, in the article) of each block of text, in page order, without what markup rules out."""
    out: list[tuple[str, bool]] = []
    buffer: list[str] = []
    tags, open_ = _Tags(page or ""), _Open()
    skip = inside = False

    def flush() -> None:
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                out.append((text, inside))
            buffer.clear()

    page, at = page or "", 0
    while at < len(page):
        i, tag = page.find("<", at), None
        while i >= 0 and not (tag := tags.at(i)):
            i = page.find("<", i + 1)
        if not skip:
            text = page[at : i if i >= 0 else len(page)]
            if text:
                buffer.append(entities.unescape(text) if "&" in text else text)
        if not tag:
            break
        at, slash, name, attributes = tag
        if not name:
            continue
        if name == "br":
            if not skip:
                buffer.append(" ")
            continue
        if name in BLOCK:
            flush()
        if slash:
            open_.close(name)
        elif name not in VOID:
            if name in CLOSES_P and 0 <= open_.last("p") >= len(open_.stack) - 4:
                open_.cut(open_.last("p"))
            if name == "li" and open_.stack and open_.stack[-1][0] == "li":
                open_.cut(len(open_.stack) - 1)
            skip, inside = open_.state()
            own, article = _kind(name, attributes, inside) if not skip else (True, False)
            if name in RAW:
                end = RAW_END[name].search(page, at)
                at = page.find(">", end.end()) + 1 if end and end.end() <= tags.last else len(page)
            elif not attributes.endswith("/") or name in BLOCK:
                open_.push(name, skip or own, inside or article)
        skip, inside = open_.state()
    flush()
    return out


def article(page: str | None) -> tuple[list[str], bool]:
    """The blocks that may be article, and whether the page marks it: then they are those inside, else all."""
    found = blocks(page)
    marked = any(inside for _, inside in found)
    return [t for t, inside in found if inside or not marked], marked


def kept_lines(page: str | None) -> list[str]:
    return article(page)[0]


def _kind(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is skipped, and whether it is marked as the article."""
    a = {k.lower(): x or y or z for k, x, y, z in ATTRIBUTE.findall(attributes)} if "=" in attributes else {}
    role = a.get("role", "").lower()
    article = name in ("article", "main") or role in ("main", "article") or a.get("itemprop") == "articleBody"
    if name in SKIPPED or name == "header" and not inside or role in ROLES:
        return True, False
    if name in ("html", "body", "main"):
        return False, article
    if a.get("aria-hidden") == "true" or re.search(r"(^|\s)hidden(\s|=|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)) or re.search(r"display\s*:\s*none", a.get("style", "")):
        return True, False
    for value in (*a.get("class", "").split(), a.get("id", "")):
        words = [w.lower() for w in WORD.findall(value)]
        if words and words[0] not in ("has", "with", "no", "without") and not NAMES.isdisjoint(words):
            return True, False
    return False, article


def common_lines(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence.

    Rows of the table are bits of one integer, 64 cells a step; a table of
    more than TABLE_BITS is split in two, so memory is linear in the lines.
    """
    both = set(a) & set(b)
    ia, ib = ([i for i, x in enumerate(s) if x in both] for s in (a, b))
    a, b = [a[i] for i in ia], [b[j] for j in ib]
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        if (a1 - a0) * (b1 - b0) <= TABLE_BITS or b1 - b0 == 1:
            out += [(a0 + i, b0 + j) for i, j in _matches(a[a0:a1], b[b0:b1])]
            continue
        mid = (b0 + b1) // 2
        before, after = _lengths(a[a0:a1], b[b0:mid]), _lengths(a[a0:a1][::-1], b[mid:b1][::-1])
        cut = a0 + int((before + after[::-1]).argmax())
        todo += [(a0, cut, b0, mid), (cut, a1, mid, b1)]
    return sorted((ia[i], ib[j]) for i, j in out)


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """For each line of b, an integer whose bit i is 0 where the subsequence grows with line i of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for x in b:
        hit = row & where.get(x, 0)
        row = (row + hit | row - hit) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Lengths of the longest common subsequences of all prefixes of a with b."""
    row = (1 << len(a)) - 1
    for row in _rows(a, b):  # noqa: B007
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(a)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def _matches(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    rows = [row.to_bytes(len(a) // 8 + 1, "little") for row in _rows(a, b)]
    out, i, j = [], len(a), len(b)
    while i and j:
        k = i - 1
        if rows[j - 1][k >> 3] >> (k & 7) & 1:
            i -= 1
            continue
        j -= 1
        if not j or rows[j - 1][k >> 3] >> (k & 7) & 1:
            i -= 1
            out.append((i, j))
    return out


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    """From the host's end up to ?, # or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    def made(rows: list[tuple], batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        texts, hashes, all_, marked = zip(*rows, strict=True)
        cols = [pa.array(texts, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(all_, pa.int64()), pa.array(marked)]
        return pa.RecordBatch.from_arrays([*(c.slice(at, len(rows)) for c in batch.columns[:-1]), *cols], names=["page_id", "url", "host", "path", "texts", "lines", "h", "marked"])

    for batch in batches:
        rows, size, at = [], 0, 0
        for i in range(batch.num_rows):
            texts, marked = article(batch.column(batch.num_columns - 1)[i].as_py())
            hashes = np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in texts], np.uint64)
            rows.append((texts, hashes.view(np.int64), xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63), marked))
            size += sum(map(len, texts))
            if size > BATCH_BYTES:
                yield made(rows, batch, at)
                rows, size, at = [], 0, i + 1
        if rows:
            yield made(rows, batch, at)


def _difference(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For both pages of each pair: how near the other is, and which lines they share."""
    for pdf in frames:
        rows = []
        for r in pdf.itertuples(index=False):
            pairs = common_lines(list(r.lines), list(r.lines2))
            near = next((i for i, (x, y) in enumerate(zip(r.path, r.path2, strict=False)) if x != y), min(len(r.path), len(r.path2)))
            rows += [(r.id, near, 1, [i for i, _ in pairs]), (r.id2, near, 0, [j for _, j in pairs])]
        yield pd.DataFrame(rows, columns=["id", "near", "next", "shared"])


def template_lines(parsed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(host, h, shared): the lines to delete from the pages of a host whose lines hash to h, where there are any."""
    pages = parsed.where("host <> '' AND size(lines) > 0").groupBy("host", "h").agg(F.min(F.struct("path", "page_id")).alias("at"), F.first("lines").alias("lines"), F.max("marked").alias("marked"))
    pages = pages.select("host", "h", "at.path", "at.page_id", "lines", "marked")
    ordered = materialize(pages.orderBy("host", "path", "page_id", "h").withColumn("id", F.monotonically_increasing_id()))
    # The first row of each partition follows the last of the one before: one row for each partition.
    ends = ordered.groupBy(F.shiftright("id", 33).alias("part")).agg(F.min("id").alias("first"), F.max("id").alias("last")).orderBy("part").collect()
    jumps = parsed.sparkSession.createDataFrame([(a["last"], b["first"]) for a, b in zip(ends, ends[1:], strict=False)], "id long, jump long")
    left = ordered.join(F.broadcast(jumps), "id", "left").withColumn("id2", F.coalesce("jump", F.col("id") + 1)).drop("jump")
    right = ordered.select(F.col("id").alias("id2"), F.col("host").alias("host2"), F.col("path").alias("path2"), F.col("lines").alias("lines2"))
    pairs = left.join(right, "id2").where("host = host2").select("id", "path", "lines", "id2", "path2", "lines2")
    seen = pairs.mapInPandas(_difference, "id long, near int, next int, shared array<int>")
    side = lambda n: F.max(F.when(F.col("next") == n, F.struct("near", "shared")))
    sides = seen.groupBy("id").agg(side(0).alias("before"), side(1).alias("after"))
    first = F.coalesce(F.col("before.near"), F.lit(-1)) >= F.coalesce(F.col("after.near"), F.lit(-1))
    sides = sides.select("id", F.when(first, F.col("before.shared")).otherwise(F.col("after.shared")).alias("shared")).where("size(shared) > 0")
    near = sides.join(ordered.select("id", "host", "h", "lines", "marked"), "id")
    # Numbers in order: those that equal their place open the page, those that do so from the end close it.
    edge = F.filter("shared", lambda i, k: (i == k) | (F.size("lines") - i == F.size("shared") - k))
    near = near.select("host", "h", "marked", "lines", F.explode(F.when(F.col("marked"), edge).otherwise(F.col("shared"))).alias("i"))
    near = materialize(near.select("host", "h", "marked", "i", F.get("lines", F.col("i")).alias("line")))
    asked = materialize(near.select("host", "line").distinct())
    # A line of very many pages is counted and judged where these pages are, unless there are too many lines to broadcast.
    n_bytes = asked.agg(F.sum(F.octet_length("host") + 32).alias("n")).first()["n"] or 0
    few = (lambda t: t) if n_bytes > broadcast_bytes else F.broadcast
    held = ordered.select("host", F.explode(F.array_distinct("lines")).alias("line")).join(few(asked), ["host", "line"], "left_semi").groupBy("host", "line").agg(F.count(F.lit(1)).alias("held"))
    sizes = ordered.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    frame = (F.col("held") >= FRAME) & (2 * F.col("held") >= F.col("pages"))
    template = F.when(F.col("marked"), frame).otherwise((F.col("held") >= THIRD) | (F.col("pages") == 2))
    judged = held.join(sizes, "host")
    found = near.join(few(judged), ["host", "line"]).where(template)
    found = materialize(found.groupBy("host", "h").agg(F.array_sort(F.collect_list("i")).alias("shared")))
    release(ordered, near, asked)
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Main text of every page: page_id, url, text, n_chars, and n_deleted, the lines that differencing took away.

    A null or empty html has the text ''; pages whose url is null or has no
    :// belong to no host and aren't differenced, nor are pages alone on their
    host, nor copies with each other: all pages of a host with the same lines
    get the same text, repeated rows among them. Of equally near neighbours the
    one before decides. An empty table gives an empty result; other columns are
    ignored. Time is linear in a page's length, however its markup is broken;
    comparing two pages takes their lines' product over 64.
    """
    url, page = F.col(f"`{url_col}`").cast("string"), F.col(f"`{html_col}`").cast("string")
    src = pages.select(F.col(f"`{id_col}`").cast("long").alias("page_id"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"), page.alias("page"))
    parsed = materialize(src.mapInArrow(_parse, "page_id long, url string, host string, path string, texts array<string>, lines array<long>, h long, marked boolean"))
    gone = template_lines(parsed, broadcast_bytes)
    n_bytes = gone.agg(F.sum(F.size("shared") * 4 + F.octet_length("host") + 24).alias("n")).first()["n"] or 0
    out = parsed.drop("lines", "path", "marked").join(gone if n_bytes > broadcast_bytes else F.broadcast(gone), ["host", "h"], "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("texts") - 1), F.col("shared")), lambda i: F.get("texts", i))
    text = F.array_join(F.when(F.col("shared").isNull(), F.col("texts")).otherwise(left), " ")
    out = out.select("page_id", "url", text.alias("text"), F.coalesce(F.size("shared"), F.lit(0)).cast("long").alias("n_deleted"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select("page_id", "url", "text", "n_chars", "n_deleted")
