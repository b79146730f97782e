"""Ranked lexical search with block-max pruning.

Each task turns its documents into a forward index: groups of documents with
their counts of the queries' terms. The corpus statistics are aggregated from
it. For the search, the documents of a group are put in the order of their
length and cut into ranges, the blocks; a block holds for each term the most
that any of its documents gets from it. Per query, blocks are visited in the
order of the bound that these maxima give, and scored until the bound drops
below the threshold: the k-th best score so far, or the k-th best of a part of
the groups, which every task knows from the start.

Scores are 64-bit integers, so bounds and results are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize

TOP = 10
#: Documents of a group and of a block.
GROUP, RANGE = 2048, 8
#: Counts of terms after which a group ends early.
POSTINGS = 1 << 20
#: One in so many groups gives the first threshold.
SAMPLE = 16
#: Characters of query texts that are searched for in one pass over the documents.
BLOCK = 1 << 18


class Terms:
    """The distinct words of some texts, in the order of their keys, and the words of each text."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        self.of: list[dict[int, int]] = [{} for _ in texts]
        for w in tokens.split(pa.array(texts, pa.large_string())):
            for i, r in enumerate((w.row + w.lo).tolist()):
                t = number.setdefault(w.word(i), len(number))
                self.of[r][t] = self.of[r].get(t, 0) + 1
        self.text = list(number)
        if not self.text:
            self.keys = np.zeros(0, np.uint64)
            return
        one = [w for w in tokens.split(pa.array([t.decode() for t in self.text], pa.large_string()))]
        self.keys, self.head, self.tail, self.length = (np.concatenate(x) for x in zip(*[(w.keys(), w.head, w.tail, w.length) for w in one], strict=True))
        order = np.argsort(self.keys, kind="stable")
        place = np.argsort(order)
        self.keys, self.head, self.tail, self.length, self.text = self.keys[order], self.head[order], self.tail[order], self.length[order], [self.text[i] for i in order]
        self.of = [{int(place[t]): n for t, n in terms.items()} for terms in self.of]

    def find(self, w: tokens.Words) -> tuple[np.ndarray, np.ndarray]:
        """Which words of w are terms, and which terms."""
        keys = w.keys()
        at = np.searchsorted(self.keys, keys)
        word = np.flatnonzero(at < len(self.keys))
        term = at[word]
        found_word, found_term = [], []
        # Terms that share a key stand beside each other.
        while len(word):
            same = self.keys[term] == keys[word]
            word, term = word[same], term[same]
            equal = (self.head[term] == w.head[word]) & (self.tail[term] == w.tail[word]) & (self.length[term] == w.length[word])
            for i in np.flatnonzero(equal & (w.length[word] > 16)).tolist():
                equal[i] = w.word(word[i]) == self.text[term[i]]
            found_word.append(word[equal])
            found_term.append(term[equal])
            word, term = word[~equal], term[~equal] + 1
            word, term = word[term < len(self.keys)], term[term < len(self.keys)]
        return np.concatenate([*found_word, np.zeros(0, np.int64)]), np.concatenate([*found_term, np.zeros(0, np.int64)])


GROUP_ROW = "ids binary, known binary, sizes binary, first binary, terms binary, tfs binary, n_docs long, n_terms long"


def _group(parts: list[tuple]) -> pa.RecordBatch:
    ids, known, sizes, counts, terms, tfs = (np.concatenate(x) for x in zip(*parts, strict=True))
    columns = [x.tobytes() for x in (ids, known, sizes, np.r_[0, np.cumsum(counts)].astype(np.int64), terms.astype(np.int32), tfs)]
    types = [pa.binary()] * 6 + [pa.int64()] * 2
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([*columns, int((sizes > 0).sum()), int(sizes.sum())], types, strict=True)], [x.split()[0] for x in GROUP_ROW.split(", ")])


def _forward(terms: Terms):
    """Batches of (doc_id, text) as groups of the forward index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        docs = postings = 0
        for batch in batches:
            for w in tokens.split(batch.column("text")):
                ids = batch.column("doc_id").slice(w.lo, w.hi - w.lo)
                word, term = terms.find(w)
                pair, tf = np.unique(w.row[word] * max(1, len(terms.keys)) + term, return_counts=True)
                row, term = np.divmod(pair, max(1, len(terms.keys)))
                counts = np.bincount(row, minlength=len(ids))
                parts.append((pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False), w.count(), counts, term, tf))
                docs, postings = docs + len(ids), postings + len(tf)
                if docs >= GROUP or postings >= POSTINGS:
                    yield _group(parts)
                    parts, docs, postings = [], 0, 0
        if parts:
            yield _group(parts)

    return run


def _frequencies(n: int):
    """How many documents of the task hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n, np.int64)
        for batch in batches:
            for terms in batch.column("terms"):
                df += np.bincount(np.frombuffer(terms.as_buffer(), np.int32), minlength=n)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(df[some])], ["term", "df"])

    return run


class Top:
    """The k best (score, id) of a query: higher scores first, then smaller ids, unknown ids last."""

    def __init__(self, k: int, least: int):
        self.k, self.least = k, least
        self.score, self.unknown, self.id = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    def add(self, score: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        score, unknown, ids = np.r_[self.score, score], np.r_[self.unknown, unknown], np.r_[self.id, ids]
        order = np.lexsort((ids, unknown, -score))[: self.k]
        self.score, self.unknown, self.id = score[order], unknown[order], ids[order]
        if len(order) == self.k:
            self.least = max(self.least, int(self.score[-1]))


class Group:
    """A group of documents in blocks, ready to be searched."""

    def __init__(self, row: dict, n_docs: int, n_terms: int, n: int, size: int):
        read = lambda c, t: np.frombuffer(row[c].as_buffer(), t)
        self.ids, self.unknown, sizes, first = read("ids", np.int64), ~read("known", bool), read("sizes", np.int64), read("first", np.int64)
        term, tf = read("terms", np.int32), read("tfs", np.int64)
        doc = np.repeat(np.arange(len(sizes)), np.diff(first))
        m = 25 + (75 * sizes * n_docs) // n_terms
        gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        # Documents by length: those of one block get like gains from like counts.
        order = np.argsort(sizes, kind="stable")
        self.order, place = order, np.argsort(order)
        self.size, self.n = size, n
        at = place[doc]
        block = at // size
        sort = np.lexsort((term, block))
        self.at, self.term, self.gain = at[sort] % size, term[sort], gain[sort]
        self.cut = np.searchsorted(block[sort], np.arange(-(-len(sizes) // size) + 1))
        self.most = np.zeros((len(self.cut) - 1, n + 1), np.int64)
        np.maximum.at(self.most, (block[sort], self.term), self.gain)
        self.dense: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def scores(self, b: int, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Of all documents of a block, from its forward index."""
        if b not in self.dense:
            mine = slice(self.cut[b], self.cut[b + 1])
            local, column = np.unique(self.term[mine], return_inverse=True)
            table = np.zeros((self.size, len(local) + 1), np.int32)
            table[self.at[mine], column] = self.gain[mine]
            where = np.full(self.n + 1, len(local), np.int32)
            where[local] = np.arange(len(local))
            self.dense[b] = table, where
        table, where = self.dense[b]
        return table[:, where[terms]].astype(np.int64) @ weight

    def docs(self, b: int, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self.order[b * self.size + some]
        return self.unknown[at], self.ids[at]


def _search(queries: list[tuple[np.ndarray, np.ndarray]], least: list[int], n_docs: int, n_terms: int, n: int, k: int, size: int, visits: bool = False):
    """Groups to the best documents of a task: (query, doc_id, score). `visits`: instead, blocks scored and blocks in all, by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [Top(k, x) for x in least]
        scored = blocks = np.zeros(len(queries), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                group = Group({c: batch.column(c)[row] for c in batch.schema.names}, n_docs, n_terms, n, size)
                blocks = blocks + len(group.most)
                seen = np.zeros(len(queries), np.int64)
                for q, (terms, weight) in enumerate(queries):
                    bound = group.most[:, terms] @ weight
                    for b in np.argsort(-bound, kind="stable").tolist():
                        # An equal score may still win by its smaller id.
                        if bound[b] < max(top[q].least, 1):
                            break
                        seen[q] += 1
                        score = group.scores(b, terms, weight)
                        some = np.flatnonzero(score >= max(top[q].least, 1))
                        if len(some):
                            top[q].add(score[some], *group.docs(b, some))
                scored = scored + seen
        if visits:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(queries))), pa.array(scored), pa.array(blocks)], ["query", "doc_id", "score"])
            return
        number = np.repeat(np.arange(len(queries)), [len(t.id) for t in top])
        join = lambda x, t: np.concatenate([*x, np.zeros(0, t)])
        ids = pa.array(join([t.id for t in top], np.int64), mask=join([t.unknown for t in top], bool))
        yield pa.RecordBatch.from_arrays([pa.array(number), ids, pa.array(join([t.score for t in top], np.int64))], ["query", "doc_id", "score"])

    return run


HIT = "query long, doc_id long, score long"


def _best(index: DataFrame, task, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return index.mapInArrow(task, HIT).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block: int = BLOCK, size: int = RANGE, sample: int = SAMPLE) -> DataFrame:
    """The k best documents of every query: item_id, rank, doc_id, score.

    A term is a run of digits, ASCII letters (A-Z lower-cased) and non-ASCII
    characters. With N documents that have terms, L terms in all, n terms in
    the document, a term in df of the documents weighs w = floor(1000 ln((2N +
    2) / (2df + 1))); tf occurrences give w ((10^9 tf) div (1000 tf + 8m)), m =
    25 + (75nN) div L. Scores sum over the query's terms, repeats included;
    those of 0 are left out, equal ones go by smaller doc_id, null last.

    Null and empty texts have no terms: such documents count nowhere, such
    queries have no row. Repeated documents are documents of their own, a
    query row that repeats gets its result once more. Empty tables give no
    rows; other columns are ignored, whatever their names.

    Queries beyond `block` characters are searched for in further passes.
    `size` documents make a block; one in `sample` groups gives the first
    threshold.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    items = queries.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").cast("string").alias("text")).where("text is not null").groupBy("item_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    blocks = -(-(items.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0) // block)
    parts = []
    for b in range(blocks):
        # Of bounded size: `block` characters, or one query.
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        terms = Terms([r["text"] for r in mine])
        n = len(terms.keys)
        index = materialize(rows.mapInArrow(_forward(terms), GROUP_ROW))
        all_of = index.agg(F.sum("n_docs").alias("docs"), F.sum("n_terms").alias("terms"), F.count(F.lit(1)).alias("groups")).first()
        if not all_of["docs"]:
            continue
        df = dict(index.select("terms").mapInArrow(_frequencies(n), "term int, df long").groupBy("term").agg(F.sum("df")).collect())
        weight = np.array([math.floor(1000 * math.log((2 * all_of["docs"] + 2) / (2 * df.get(t, 0) + 1))) for t in range(n)], np.int64)
        asked = [(np.array(list(q), np.int64), np.array([weight[t] * times for t, times in q.items()], np.int64)) for q in terms.of]
        search = lambda least, asked=asked, of=all_of, n=n: _search(asked, least, of["docs"], of["terms"], n, k, size)
        least = [0] * len(mine)
        if all_of["groups"] >= 2 * sample:
            part = index.where(F.pmod(F.xxhash64("ids"), F.lit(sample)) == 0)
            for r in _best(part, search(least), k).where(F.col("rank") == k).collect():
                least[r["query"]] = r["score"]
        found = _best(index, search(least), k)
        names = spark.createDataFrame([(i, r["item_id"], r["copies"]) for i, r in enumerate(mine)], f"query long, item_id {items.schema['item_id'].dataType.simpleString()}, copies long")
        found = found.join(F.broadcast(names), "query").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        parts.append(found.select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return items.select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).where(F.lit(False))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
