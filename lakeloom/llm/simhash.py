"""SimHash near-duplicates: exact pairs within a Hamming radius, found by vantage-point trees.

Fingerprints of unrelated texts lie near 32 bits from any vantage point, give
or take 4, so that with a radius of 4 one tree over all 64 bits prunes next to
nothing. The trees are therefore a forest: the bits are cut into more parts
than the radius, and two fingerprints within the radius agree on all parts but
as many as it. Each choice of the parts that agree is a tree, whose roots part
the fingerprints by distance zero on those bits; no shard of a tree overlaps
another. The number of parts grows with the logarithm of the fingerprints, so
that shards of scattered ones stay small. Below the root, a shard is a
vantage-point tree over all 64 bits: each node splits at the median distance
to its vantage point and triangle bounds decide which parts of the shells on
both sides are compared.
A root with more than SHARD fingerprints is parted into blocks by hash, and
every pair of its blocks is compared by a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components

SHINGLE = 4
SEED = 42
RADIUS = 4
SHARD = 8192
#: Fingerprints that a root should hold at most where they are scattered.
SHARE = 2048
#: Points up to which all pairs are compared.
LEAF = 16
ROWS_PER_TASK = 40_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of all runs of `size` words (A-Z lower-cased), repeats included; of all words together if there are fewer."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    if len(w) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(x) + 1 for x in w])
    starts = np.concatenate(([0], ends[:-size])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; 0 for none."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        part = h[i : i + 4096].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    """64 majority bits of the XXH64 of all word shingles; 0 without words."""
    return majority(shingle_hashes(text))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.num_columns - 1)
        fp = np.array([fingerprint(texts[i].as_py()) for i in range(batch.num_rows)], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp) for every row; `fp` holds the 64 bits as a signed long, `text_hash` the xxhash64 of the text."""
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return src.mapInArrow(_fingerprints, "doc_id long, text_hash long, fp long")


class _Links:
    """Classes of the fingerprints of one shard, joined while the tree is searched."""

    def __init__(self, fp: np.ndarray, radius: int):
        self.fp, self.radius, self.root = fp, radius, np.arange(len(fp))
        # Vantage points chosen, and pairs that triangle bounds ruled out.
        self.vantage = self.ruled_out = 0

    def distance(self, i: int, ix: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.fp[ix] ^ self.fp[i])

    def one(self, i: int, ix: np.ndarray) -> None:
        """Link point i to those of `ix` in reach that aren't in its class yet."""
        ix = ix[self.root[ix] != self.root[i]]
        if len(ix):
            self.unite(i, ix[self.distance(i, ix) <= self.radius])

    def unite(self, i: int, ix: np.ndarray) -> None:
        for r in np.unique(self.root[ix]):
            if r != self.root[i]:
                self.root[self.root == r] = self.root[i]

    def within(self, ix: np.ndarray) -> None:
        """All links between points of `ix`."""
        todo = [ix]
        while todo:
            ix = todo.pop()
            if len(ix) <= LEAF:
                for k in range(len(ix) - 1):
                    self.one(ix[k], ix[k + 1 :])
                continue
            v, ix = ix[0], ix[1:]
            d = self.distance(v, ix).astype(np.int16)
            self.unite(v, ix[d <= self.radius])
            mu = int(np.median(d))
            inner = d <= mu
            if inner.all():
                mu -= 1
                inner = d <= mu
            if not inner.any():  # all at one distance
                for k in range(len(ix) - 1):
                    self.one(ix[k], ix[k + 1 :])
                continue
            todo += [ix[inner], ix[~inner]]
            a, b = ix[inner & (d > mu - self.radius)], ix[~inner & (d <= mu + self.radius)]
            self.vantage += 1
            self.ruled_out += int(inner.sum()) * int((~inner).sum()) - len(a) * len(b)
            self.across(a, b)

    def across(self, a: np.ndarray, b: np.ndarray, depth: int = 0) -> None:
        """All links between a point of `a` and one of `b`."""
        if len(a) > len(b):
            a, b = b, a
        if not len(a) or len(np.unique(self.root[a])) == 1 == len(np.unique(self.root[b])) and self.root[a[0]] == self.root[b[0]]:
            return
        if len(a) <= LEAF or depth > 12:
            for i in a:
                self.one(i, b)
            return
        da, db = self.distance(a[0], a).astype(np.int16), self.distance(a[0], b).astype(np.int16)
        mu = int(np.median(da[1:]))
        near, far = da <= mu, da > mu
        if not far.any():
            for i in a:
                self.one(i, b)
            return
        self.vantage += 1
        self.ruled_out += int(near.sum()) * int((db > mu + self.radius).sum()) + int(far.sum()) * int((db <= mu - self.radius).sum())
        self.across(a[near], b[db <= mu + self.radius], depth + 1)
        self.across(a[far], b[db > mu - self.radius], depth + 1)


def _link_shards(radius: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["leaf", "lo", "hi"], ignore_index=True)
        fp = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        leaf, lo, hi, part = (pdf[c].to_numpy() for c in ("leaf", "lo", "hi", "part"))
        new = np.flatnonzero((leaf[1:] != leaf[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
        a, b = [], []
        for s, e in zip(np.append(0, new), np.append(new, len(fp)), strict=True):
            if e - s < 2:
                continue
            links = _Links(fp[s:e], radius)
            if lo[s] == hi[s]:
                links.within(np.arange(e - s))
            else:
                side = part[s:e] == lo[s]
                links.across(np.flatnonzero(side), np.flatnonzero(~side))
            moved = np.flatnonzero(links.root != np.arange(e - s))
            a.append(fp[s:e][moved])
            b.append(fp[s:e][links.root[moved]])
        join = lambda x: np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64)
        return pd.DataFrame({"a": join(a), "b": join(b)})

    return run


def _bands(fp: Column, parts: int, radius: int) -> list[Column]:
    """Keys of the roots of a fingerprint: each choice of parts - radius of its parts, and their bits."""
    cuts = [64 * i // parts for i in range(parts + 1)]
    keys = []
    for i, choice in enumerate(combinations(range(parts), parts - radius)):
        key = F.lit(i).cast("long")
        for p in choice:
            width = cuts[p + 1] - cuts[p]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, cuts[p]).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return keys


def parts_for(n: int, radius: int) -> int:
    """The least number of parts whose roots hold SHARE of n scattered fingerprints at most."""
    parts = radius + 1
    while n >> 64 * (parts - radius) // parts > SHARE and parts < radius + 5:
        parts += 1
    return parts


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, parts: int | None = None) -> DataFrame:
    """Edges (a, b) that connect every two fingerprints `fp` of the distinct ones within `radius` bits.

    Not all such pairs are returned: within a shard a class is a star.
    """
    n = distinct.count()
    bands = _bands(F.col("fp"), parts or parts_for(n, radius), radius)
    rows = distinct.select("fp", F.explode(F.array(*bands)).alias("leaf"))
    hot = rows.groupBy("leaf").count().where(F.col("count") > shard).select("leaf", F.ceil(F.col("count") / shard).cast("int").alias("n"))
    rows = rows.join(hot, "leaf", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    rows = rows.select("fp", "leaf", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    tasks = max(1, len(bands) * n // ROWS_PER_TASK)
    rows = rows.withColumn("task", F.pmod(F.xxhash64("leaf", "lo", "hi"), F.lit(tasks)))
    return rows.groupBy("task").applyInPandas(_link_shards(radius), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for every input row: doc_id, text_hash, fp, component_id (smallest doc_id reachable over links).

    A null or text without words has the fingerprint zero, which links like
    any other. Equal fingerprints are one node, however many rows share it;
    null ids never name a component (a component of null ids alone has a null
    component_id). An empty table gives an empty result; other columns are ignored.
    """
    prints = materialize(fingerprints(docs, id_col, text_col))
    nodes = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(links(nodes.select("fp"), radius))
    member = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(least, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "component_id")
