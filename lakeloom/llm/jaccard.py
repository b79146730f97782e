"""SimHash near-duplicates by the general rule: sets of word shingles with a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash operator: fingerprints of all shingles that
its vantage-point forest finds within the radius. Texts of a similarity near
0.8 differ in 7 to 12 bits, out of the reach of any forest that prunes. So
candidates also share one of BANDS keys, each made of ROWS minima over the
hashes of a text's shingles: a pair of similarity s is missed with probability
(1 - s^ROWS)^BANDS, which is 3 in a million at 0.8 and less above. Texts that
either links form a loose group; inside a group the similarity of
every two texts is computed exactly from their whole shingle sets. Only the
sets of texts in a group are made again, once, and travel instead of the texts;
in a task an inverted index of shingles leaves out texts that share none. A
group of more than BLOCK texts or BLOCK_WORDS words is parted into blocks by
hash, and every pair of its blocks is compared apart: a set of a group of w
words is copied w / BLOCK_WORDS times.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .components import connected_components
from .simhash import SEED, links, majority, shingle_hashes

SHINGLE = 5
#: Least similarity, as a ratio of whole numbers.
SHARE = (4, 5)
BANDS, ROWS = 24, 4
BLOCK, BLOCK_WORDS = 1024, 1_000_000
WORDS_PER_TASK = 100_000
#: Entries of the inverted index that are counted at once.
STEP = 1 << 20
#: Odd multipliers, one for each minimum.
FACTORS = np.random.default_rng(SEED).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct XXH64 of all runs of SHINGLE words; of all words together if there are fewer."""
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(found: np.ndarray) -> list[int]:
    """Keys of a shingle set, one for each band; none for the empty set."""
    import xxhash

    if not len(found):
        return []
    least = np.full(len(FACTORS), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, len(found), 512):
            np.minimum(least, (found[i : i + 512, None] * FACTORS).min(axis=0), out=least)
    return [xxhash.xxh64_intdigest(part.tobytes(), b) - (1 << 63) for b, part in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    # A few texts at a time: what a worker has once taken it seldom gives back.
    for batch in (part.slice(i, 256) for part in batches for i in range(0, part.num_rows, 256)):
        found = [shingle_hashes(batch.column(2)[i].as_py(), SHINGLE) for i in range(batch.num_rows)]
        sets = [np.unique(h) for h in found]
        nodes = pa.array([xxhash.xxh64_intdigest(s.tobytes()) - (1 << 63) for s in sets], pa.int64())
        keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
        fp = pa.array(np.array([majority(h) for h in found], np.uint64).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), nodes, pa.array([len(s) for s in sets], pa.int64()), keys, fp], names=["doc_id", "text_hash", "node", "n", "keys", "fp"])


def classes(sets: list[np.ndarray], side: np.ndarray | None = None) -> np.ndarray:
    """A class for each set: those linked by a similarity of SHARE or more, by whole sets; with `side`, links across sides alone."""
    sizes, root = np.array([len(s) for s in sets]), np.arange(len(sets))
    owner = np.repeat(root, sizes)
    _, code, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = owner[np.argsort(code, kind="stable")]
    begin, offset = np.cumsum(many) - many, np.cumsum(sizes) - sizes
    for i in range(len(sets)):
        if side is not None and side[i]:
            continue
        # Sets of the same class need no comparison: a group of near copies is settled by its first.
        others = root != root[i] if side is None else side & (root != root[i])
        c = code[offset[i] : offset[i] + sizes[i]]
        c = c[many[c] > 1]
        if not len(c) or not others.any():
            continue
        ends, both = np.cumsum(many[c]), np.zeros(len(sets), np.int64)
        for part in np.split(c, np.searchsorted(ends, np.arange(STEP, ends[-1], STEP))):
            n = many[part]
            at = np.arange(n.sum()) + np.repeat(begin[part] - (np.cumsum(n) - n), n)
            both += np.bincount(holders[at], minlength=len(sets))
        hit = others & (SHARE[1] * both >= SHARE[0] * (sizes + sizes[i] - both))
        for r in np.unique(root[hit]):
            if r != root[i]:
                root[root == r] = root[i]
    return root


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's texts as their shingle sets."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            made = pa.array([shingles(t).tobytes() for t in part.column(part.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], names=[*part.schema.names[:-1], "set"])


def _link(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = [], []
    for (_, lo, hi), rows in pdf.groupby(["loose", "lo", "hi"], sort=False):
        if len(rows) < 2:
            continue
        nodes = rows["node"].to_numpy()
        root = classes([np.frombuffer(t, np.uint64) for t in rows["set"]], None if lo == hi else rows["part"].to_numpy() == hi)
        moved = np.flatnonzero(root != np.arange(len(root)))
        a.append(nodes[moved])
        b.append(nodes[root[moved]])
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return pd.DataFrame({"a": join(a), "b": join(b)})


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row for every input row: doc_id, text_hash, component_id (smallest doc_id reachable over similar texts).

    Texts of the same shingles are one node, however many rows share it; null
    and texts without words are one node, similar to nothing else. Null ids
    never name a component (a component of null ids alone has a null
    component_id). An empty table gives an empty result; other columns are ignored.
    """
    text = F.col(f"`{text_col}`").cast("string")
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    prints = materialize(src.mapInArrow(_sketches, "doc_id long, text_hash long, node long, n long, keys array<long>, fp long"))
    rows = prints.groupBy("node").agg(F.min("doc_id").alias("first"), F.min(F.struct("doc_id", "text_hash")).alias("row"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.min("fp").alias("fp"))
    nodes = materialize(rows)

    keyed = nodes.where("n > 0").select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1").select("key", "hub")
    near = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("hub"))
    edges = [keyed.join(hubs, "key").select(F.col("hub").alias("a"), F.col("node").alias("b"))]
    edges.append(nodes.where("n > 0").select("node", "fp").join(near, "fp").select(F.col("hub").alias("a"), F.col("node").alias("b")))
    found = materialize(links(near.select("fp")))
    edges.append(found.join(near.select(F.col("fp").alias("a"), F.col("hub").alias("ha")), "a").join(near.select(F.col("fp").alias("b"), F.col("hub").alias("hb")), "b").select(F.col("ha").alias("a"), F.col("hb").alias("b")))
    loose = connected_components(edges[0].unionByName(edges[1]).unionByName(edges[2]))
    loose = materialize(nodes.join(loose.withColumnRenamed("component", "loose"), "node").select("node", "loose", "n", F.col("row.doc_id").alias("_d"), F.col("row.text_hash").alias("_h")))
    sizes = loose.groupBy("loose").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / BLOCK_WORDS)).cast("int").alias("parts"))
    loose = loose.join(sizes, "loose").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    words = loose.agg(F.coalesce(F.sum(F.col("n") * F.col("parts")), F.lit(0)).alias("w")).first()["w"]
    whole = src.join(loose, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("text_hash") == F.col("_h"))).select("node", "loose", "part", "parts", "text").dropDuplicates(["node"])
    whole = whole.mapInArrow(_sets, "node long, loose long, part int, parts int, set binary")
    whole = whole.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    whole = whole.select("node", "loose", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "set")
    whole = whole.withColumn("task", F.pmod(F.xxhash64("loose", "lo", "hi"), F.lit(max(1, words // WORDS_PER_TASK))))
    found = connected_components(whole.groupBy("task").applyInPandas(_link, "a long, b long"))

    member = nodes.select("node", "first").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("first").alias("component_id"))
    named = member.join(least, "component").select("node", "component_id")
    return prints.join(named, "node").select("doc_id", "text_hash", "component_id")
