"""Embedding near-duplicates: exact cosine pairs by dual traversal of cover trees.

On unit vectors, cosine >= t is chord distance <= sqrt(2 - 2t), a metric, so
two tree nodes hold no pair when their centres are farther apart than both
covering radii and that distance together.

A cover tree (nested levels, radii halving from 2) over a bounded sample gives
the cells, whose number grows with the vectors up to CELLS; every vector joins
the cell of its nearest centre and the radius of a cell is the largest distance
that occurs in it, so no bound rests on the sample. Cells are cut into blocks
of bounded size, however many vectors fall into one. The traversal of the top
level keeps the pairs of cells that may hold a link; each pair of blocks is one
task, which goes on with trees of its own. Node pairs that lie so near that all
of their pairs are links are counted without a comparison. Vectors travel as
bytes, those for one block pair together.

Equal vectors are one node with a weight. Tasks return counts and one star of
edges for each class they see, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import connected_components

THRESHOLD = 0.95
#: Cells: one for each CELL vectors, but within these limits; vectors in the sample for each cell.
CELL, CELLS, SAMPLE = 8192, (512, 4096), 4
#: Vectors of a block: a quarter of all, but within these limits.
BLOCK = (1024, 32768)
#: Points of a tree leaf; children of a node at most (more: the node stays a leaf, its points are too scattered to cover).
LEAF, CHILDREN = 256, 64
SLACK = 1e-7


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; first by their largest component, so that no square overflows."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def net(x: np.ndarray, radius: float, most: int, first: list[int] | None = None) -> tuple[list[int], np.ndarray, np.ndarray] | None:
    """Centres more than `radius` apart that cover all rows within it (those of `first` among them), each row's centre and distance.

    None when more than `most` would be needed.
    """
    centres: list[int] = []
    near, of = np.full(len(x), np.inf), np.zeros(len(x), np.int64)
    queue = list(first or [])
    while True:
        if queue:
            c = queue.pop(0)
        else:
            c = int(near.argmax())
            if near[c] <= radius:
                return centres, of, near
        if len(centres) == most:
            return None
        d = chord(x, x[c : c + 1])[:, 0]
        d[c] = 0
        closer = d < near
        near[closer], of[closer] = d[closer], len(centres)
        centres.append(c)


class Node:
    """Points `ix` within `radius` of a centre; children lie at half the level's radius."""

    def __init__(self, x: np.ndarray, ix: np.ndarray, centre: int, radius: float, level: float):
        self.ix, self.centre, self.radius, self.children = ix, centre, radius, []
        if len(ix) > LEAF and level > 1 / 64:
            found = net(x[ix], level / 2, CHILDREN, [int(np.flatnonzero(ix == centre)[0])])
            if found:
                centres, of, near = found
                self.children = [Node(x, ix[of == k], int(ix[c]), float(near[of == k].max()), level / 2) for k, c in enumerate(centres)]


def tree(x: np.ndarray, ix: np.ndarray) -> Node:
    d = chord(x[ix], x[ix[:1]])[:, 0]
    return Node(x, ix, int(ix[0]), float(d.max()), 2.0)


class Pairs:
    """Weighted link counts and classes of the points of one task."""

    def __init__(self, x: np.ndarray, weight: np.ndarray, threshold: float):
        self.x, self.weight, self.threshold = x, weight, threshold
        self.reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
        self.single, self.error = x.astype(np.float32), (x.shape[1] + 8) * 2.0**-22
        self.n, self.root = np.zeros(len(x), np.int64), np.arange(len(x))

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        for i in range(0, len(a), 1024):
            for j in range(i if same else 0, len(b), 1024):
                self._compare(a[i : i + 1024], b[j : j + 1024], same and i == j)

    def _compare(self, p: np.ndarray, q: np.ndarray, same: bool) -> None:
        """In single precision first, with room for its error; then in double where that leaves a pair."""
        i, j = np.divmod(np.flatnonzero(self.single[p] @ self.single[q].T >= self.threshold - self.error), len(q))
        if same:
            i, j = i[i < j], j[i < j]
        if not len(i):
            return
        cosine = (self.x[p] @ self.x[q].T)[i, j] if len(i) > len(p) * len(q) // 32 else np.einsum("ij,ij->i", self.x[p[i]], self.x[q[j]])
        i, j = i[cosine >= self.threshold], j[cosine >= self.threshold]
        # Sums of weights are exact below 2^53.
        self.n[p] += np.bincount(i, self.weight[q[j]], len(p)).astype(np.int64)
        self.n[q] += np.bincount(j, self.weight[p[i]], len(q)).astype(np.int64)
        cut = np.flatnonzero(np.diff(i, prepend=-1, append=len(p)))
        for s, e in zip(cut, cut[1:], strict=False):
            self.unite(p[i[s]], q[j[s:e]])

    def unite(self, i: int, ix: np.ndarray) -> None:
        for r in np.unique(self.root[ix]):
            if r != self.root[i]:
                self.root[self.root == r] = self.root[i]

    def link_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Every point of `a` links with every one of `b` (a is b: with every other)."""
        if a is b:
            self.n[a] += self.weight[a].sum() - self.weight[a]
        else:
            self.n[a] += self.weight[b].sum()
            self.n[b] += self.weight[a].sum()
            self.unite(a[0], b)
        self.unite(a[0], a)

    def traverse(self, a: Node, b: Node) -> None:
        """Visit node pairs (a is b for the pairs within one tree) that no covering-radius bound settles."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            if a is b:
                if 2 * a.radius <= self.reach - 2 * SLACK:
                    self.link_all(a.ix, a.ix)
                elif not a.children:
                    self.compare(a.ix, a.ix, True)
                else:
                    todo += [(p, q) for k, p in enumerate(a.children) for q in a.children[k:]]
                continue
            d = float(np.sqrt(((self.x[a.centre] - self.x[b.centre]) ** 2).sum()))
            if d > a.radius + b.radius + self.reach:
                continue
            if d + a.radius + b.radius <= self.reach - 2 * SLACK:
                self.link_all(a.ix, b.ix)
                continue
            if not b.children or a.children and a.radius >= b.radius:
                a, b = b, a
            if b.children:
                todo += [(a, q) for q in b.children]
            else:
                self.compare(a.ix, b.ix, False)


def _search(threshold: float, kind: type):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        joined = lambda c, t: np.frombuffer(b"".join(pdf[c]), t)
        node = joined("nodes", np.int64)
        order = node.argsort(kind="stable")
        node, weight = node[order], joined("ws", np.int64)[order]
        x = unit(joined("vs", kind).reshape(len(node), -1)[order].astype(np.float64))
        pairs = Pairs(x, weight, threshold)
        lo = np.repeat(pdf["block"].to_numpy() == pdf["lo"].to_numpy(), [len(n) // 8 for n in pdf["nodes"]])[order]
        if pdf["lo"].iloc[0] == pdf["hi"].iloc[0]:
            top = tree(x, np.arange(len(x)))
            pairs.traverse(top, top)
        elif lo.any() and not lo.all():
            pairs.traverse(tree(x, np.flatnonzero(lo)), tree(x, np.flatnonzero(~lo)))
        some = np.flatnonzero(pairs.n)
        moved = np.flatnonzero(pairs.root != np.arange(len(x)))
        a, b = np.concatenate([node[some], node[moved]]), np.concatenate([node[some], node[pairs.root[moved]]])
        return pd.DataFrame({"a": a, "b": b, "n": np.concatenate([pairs.n[some], np.zeros(len(moved), np.int64)])})

    return run


def _cells(sample: np.ndarray, most: int) -> np.ndarray:
    """Centres of the deepest level of the sample's cover tree that has at most `most` nodes."""
    centres, radius = [0], 2.0
    while radius > 1 / 64:
        finer = net(sample, radius / 2, most, centres)
        if finer is None:
            break
        centres, radius = finer[0], radius / 2
    return sample[centres]


def _read(vs: pd.Series, kind: type) -> np.ndarray:
    return unit(np.frombuffer(b"".join(vs), kind).reshape(len(vs), -1).astype(np.float64))


def _assign(centres: np.ndarray, kind: type):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                d = chord(_read(part["v"], kind), centres)
                yield pd.DataFrame({"node": part["node"], "cell": d.argmin(axis=1).astype(np.int32), "d": d.min(axis=1)})

    return run


def _deal(centres: np.ndarray, radius: np.ndarray, blocks: np.ndarray, reach: float, kind: type):
    """Send every vector to the block pairs in which it may have a link; those of a batch for one pair go together."""
    first = np.cumsum(blocks) - blocks

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), 4096):
                part = pdf.iloc[i : i + 4096]
                d = chord(_read(part["v"], kind), centres)
                cell = part["cell"].to_numpy()
                own = first[cell] + part["node"].to_numpy() % blocks[cell]
                here, at = np.unique(cell, return_inverse=True)
                # Of the other cell the vector must be in reach, and so must the whole of its own.
                near = chord(centres[here], centres) <= radius[here][:, None] + radius + reach
                may = (d <= radius + reach) & near[at]
                may[np.arange(len(part)), cell] = True
                row, other = np.nonzero(may & (blocks > 0))
                times = blocks[other]
                row = np.repeat(row, times)
                to = np.repeat(first[other], times) + np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                mine = own[row]
                lo, hi = np.minimum(mine, to), np.maximum(mine, to)
                order = np.lexsort((mine, hi, lo))
                row, lo, hi, mine = row[order], lo[order], hi[order], mine[order]
                cut = np.flatnonzero(np.r_[True, (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (mine[1:] != mine[:-1]), True]) if len(row) else [0]
                node, weight, v = part["node"].to_numpy(), part["w"].to_numpy(), part["v"].to_numpy()
                out = [(lo[s], hi[s], mine[s], node[row[s:e]].tobytes(), weight[row[s:e]].tobytes(), b"".join(v[row[s:e]])) for s, e in zip(cut, cut[1:], strict=False)]
                for s in range(0, len(out), 256):
                    yield pd.DataFrame(out[s : s + 256], columns=["lo", "hi", "block", "nodes", "ws", "vs"])

    return run


def _packed(kind: type):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf["v"] = [np.asarray(v, kind).tobytes() for v in pdf["v"]]
            yield pdf

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """One row for every input row: id, n_links, component_id, kept.

    Vectors link when their cosine, in double precision, is at least
    `threshold`. Null, empty and zero vectors and those with null or
    non-finite components link with nothing: n_links 0, a component of their
    own. Vectors of different lengths never link. Repeated rows are vectors of
    their own; a null id never names a component of others; an empty table
    gives an empty result; other columns are ignored. `block` is the number of
    vectors of a block; None: by BLOCK.
    """
    # Single-precision input travels as such; every length and cosine that decides is computed in double precision.
    kind = np.float32 if vectors.schema[vector_col].dataType.jsonValue().get("elementType") == "float" else np.float64
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce(F.exists(v, lambda x: F.coalesce(x != 0, F.lit(False))) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.when(fine, v).alias("v"))
    keys = [F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2")]
    distinct = rows.where("v is not null").select("vec_id", "v", *keys).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("w"), F.min("vec_id").alias("least"), F.first("v").alias("v"))
    distinct = distinct.withColumn("dim", F.size("v"))
    nodes = distinct.mapInPandas(_packed(kind), "h1 long, h2 long, w long, least long, v binary, dim int")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))

    parts = []
    for dim, n in sorted(nodes.groupBy("dim").count().collect()):
        mine = nodes.where(F.col("dim") == dim)
        cells = max(CELLS[0], min(CELLS[1], n // CELL))
        size = block or max(BLOCK[0], min(BLOCK[1], n // 4))
        sample = mine.orderBy(F.xxhash64("h1"), "node").select("v").limit(SAMPLE * cells).collect()
        centres = _cells(unit(np.frombuffer(b"".join(bytes(r["v"]) for r in sample), kind).reshape(len(sample), -1).astype(np.float64)), cells)
        placed = materialize(mine.select("node", "v").mapInPandas(_assign(centres, kind), "node long, cell int, d double"))
        radius, blocks = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
        for r in placed.groupBy("cell").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n")).collect():
            radius[r["cell"]], blocks[r["cell"]] = r["r"] + SLACK, -(-r["n"] // size)
        reach = float(np.sqrt(2 - 2 * threshold)) + SLACK
        dealt = mine.select("node", "w", "v").join(placed.select("node", "cell"), "node").mapInPandas(_deal(centres, radius, blocks, reach, kind), "lo long, hi long, block long, nodes binary, ws binary, vs binary")
        parts.append(materialize(dealt.groupBy("lo", "hi").applyInPandas(_search(threshold, kind), "a long, b long, n long")))
        release(placed)
    out = ["vec_id", "n_links", "component_id", (F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())).alias("kept")]
    if not parts:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")).select(*out)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    counts = found.where("n > 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    member = nodes.select("node", "h1", "h2", "w", "least").join(counts, "node", "left").join(connected_components(found.select("a", "b")), "node", "left")
    member = member.withColumn("component", F.coalesce("component", "node"))
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    member = member.join(least, "component").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n_links"), "component_id")
    good = rows.where("v is not null").select("vec_id", *keys).join(member, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    lone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(lone).select(*out)
