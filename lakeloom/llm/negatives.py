"""Hard-negative mining by dual-tree search over integer inner products.

Vectors are scaled and rounded down to integers, so every score is exact. A
block of anchors of bounded size is broadcast with its tree; each task grows
trees over its own rows, some thousand at a time, and visits pairs of nodes.
Two balls about p and q with radii r and s have inner products within <p, q> ±
(|p| s + |q| r + r s): a pair of nodes is left out for its whole group of
anchors if that interval lies below all that any of them still needs, or above
all that any of them may take. Leaf pairs are scored exactly.

The first search finds each anchor's positives, the second, for each positive,
the negatives in the band of scores below it. Before each, a part of the rows
is searched, so that all tasks start with a threshold. Candidates are never
shuffled; what is, are the few rows of each task that reach the thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

POSITIVES, NEGATIVES = 5, 5
#: Least score of a negative, in hundredths of the positive's.
NEAR = 80
SCALE = 256
#: Numbers in a broadcast block of anchors (8 bytes each), and anchors in it at most.
BLOCK, ANCHORS = 1 << 21, 8192
#: Numbers in the vectors of one candidate tree (8 bytes each).
TREE = 1 << 22
LEAF = 128
#: One in so many rows gives the first thresholds.
SAMPLE = 16
NEVER, ALWAYS = np.iinfo(np.int64).max, np.iinfo(np.int64).min


class Vectors:
    """Rows of one dimension with their labels; rows without a whole vector or a label are left out."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, label: np.ndarray, x: np.ndarray):
        self.ids, self.unknown, self.label, self.x = ids, unknown, label, x
        self.most = float(np.abs(x).max(initial=0))

    def __len__(self) -> int:
        return len(self.ids)

    def only(self, some: np.ndarray) -> Vectors:
        return Vectors(self.ids[some], self.unknown[some], self.label[some], self.x[some])


def _read(table: pa.Table | pa.RecordBatch, scale: int) -> dict[int, Vectors]:
    """By dimension: the vectors of (vec_id, label, vector)."""
    valid = pc.and_(pc.is_valid(table.column("label")), pc.is_valid(table.column("vector")))
    table = table.filter(valid)
    if isinstance(table, pa.RecordBatch):
        table = pa.Table.from_batches([table])
    table = table.combine_chunks()
    if not table.num_rows:
        return {}
    lists = table.column("vector").chunk(0)
    dims, values = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    first = np.cumsum(dims) - dims
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    fine = bad[first + dims] == bad[first]
    ids, label = table.column("vec_id"), table.column("label").to_numpy()
    unknown, ids = ~pc.is_valid(ids).to_numpy(), pc.fill_null(ids, 0).to_numpy()
    out = {}
    for dim in np.unique(dims[fine]).tolist():
        mine = np.flatnonzero(fine & (dims == dim))
        x = np.floor(scale * values[first[mine][:, None] + np.arange(dim)])
        out[dim] = Vectors(ids[mine], unknown[mine], label[mine], x)
    return out


def product(a: Vectors, i: np.ndarray, b: Vectors, j: np.ndarray) -> np.ndarray:
    """Exact inner products of rows i of a and j of b."""
    reach = a.x.shape[1] * a.most * b.most
    if reach < 2.0**53:
        return (a.x[i] @ b.x[j].T).astype(np.int64)
    if reach < 2.0**62 and max(a.most, b.most) < 2.0**62:
        return a.x[i].astype(np.int64) @ b.x[j].astype(np.int64).T
    raise ArithmeticError("inner products beyond 64 bits")


class Node:
    """Rows `ix` within `radius` of a centre; more than LEAF of them are halved across their widest extent."""

    def __init__(self, x: np.ndarray, ix: np.ndarray):
        self.ix, self.centre = ix, x[ix].mean(axis=0) if len(ix) else np.zeros(x.shape[1])
        off = x[ix] - self.centre
        d = np.sqrt((off * off).sum(axis=1))
        self.radius, self.norm = float(d.max(initial=0)), float(np.sqrt((self.centre * self.centre).sum()))
        self.kids: list[Node] = []
        if len(ix) > LEAF:
            order = np.argpartition(off @ off[d.argmax()], len(ix) // 2)
            self.kids = [Node(x, ix[order[: len(ix) // 2]]), Node(x, ix[order[len(ix) // 2 :]])]


def interval(a: Node, b: Node) -> tuple[float, float]:
    middle, spread = float(a.centre @ b.centre), a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    spread += 1e-9 * (1 + (a.norm + a.radius) * (b.norm + b.radius))
    return middle - spread, middle + spread


class Best:
    """For each of n slots the k best (score, id) with least <= score <= most, by score, then smaller id, unknown last."""

    def __init__(self, least: np.ndarray, most: np.ndarray, k: int):
        self.least, self.most = least.copy(), most
        self.score, self.unknown, self.id = np.full((len(least), k), ALWAYS), np.ones((len(least), k), bool), np.full((len(least), k), NEVER)

    def add(self, slots: np.ndarray, score: np.ndarray, allowed: np.ndarray | bool, of: Vectors, j: np.ndarray) -> None:
        """`score[r, c]`: of row j[c] for slots[r]."""
        hit = (score >= self.least[slots][:, None]) & (score <= self.most[slots][:, None]) & allowed
        rows = np.flatnonzero(hit.any(axis=1))
        if not len(rows):
            return
        columns = np.flatnonzero(hit[rows].any(axis=0))
        at, hit, n = slots[rows], hit[np.ix_(rows, columns)], len(rows)
        every = lambda v: np.broadcast_to(v[j[columns]], (n, len(columns)))
        score = np.concatenate([self.score[at], np.where(hit, score[np.ix_(rows, columns)], ALWAYS)], axis=1)
        unknown, ids = np.concatenate([self.unknown[at], every(of.unknown)], axis=1), np.concatenate([self.id[at], every(of.ids)], axis=1)
        k = self.score.shape[1]
        order = np.lexsort((ids, unknown, ~score), axis=1)[:, :k]
        self.score[at], self.unknown[at], self.id[at] = (np.take_along_axis(v, order, 1) for v in (score, unknown, ids))
        self.least[at] = np.maximum(self.least[at], self.score[at, -1])

    def table(self) -> pa.RecordBatch:
        slot, place = np.nonzero(self.score != ALWAYS)
        columns = [pa.array(slot), pa.array(self.id[slot, place], mask=self.unknown[slot, place]), pa.array(self.score[slot, place])]
        return pa.RecordBatch.from_arrays(columns, ["slot", "vec_id", "score"])


FOUND = "slot long, vec_id long, score long"


class Positives:
    """The k best of each anchor's label, itself included."""

    def __init__(self, anchors: Vectors, least: np.ndarray, k: int):
        self.anchors, self.least, self.k = anchors, least, k
        self.trees = {int(v): Node(anchors.x, np.flatnonzero(anchors.label == v)) for v in np.unique(anchors.label)}

    def start(self) -> None:
        self.best, self.visits = Best(self.least, np.full(len(self.least), NEVER), self.k), [0, 0]

    def visit(self, rows: Vectors) -> None:
        order = np.argsort(rows.label, kind="stable")
        values, first = np.unique(rows.label[order], return_index=True)
        for v, ix in zip(values.tolist(), np.split(order, first[1:]), strict=True):
            if v in self.trees:
                self._pairs(self.trees[v], Node(rows.x, ix), rows)

    def wanted(self, a: Node) -> tuple[int, int]:
        return int(self.best.least[a.ix].min()), NEVER

    def score(self, a: Node, b: Node, rows: Vectors) -> None:
        self.best.add(a.ix, product(self.anchors, a.ix, rows, b.ix), True, rows, b.ix)

    def _pairs(self, a: Node, b: Node, rows: Vectors) -> None:
        """Node pairs, those with the greatest products first; all pairs that no interval rules out are scored."""
        todo = [(interval(a, b), a, b)]
        while todo:
            (low, high), a, b = todo.pop()
            least, most = self.wanted(a)
            if high < least or low > most:
                self.visits[1] += len(a.ix) * len(b.ix)
            elif not a.kids and not b.kids:
                self.visits[0] += len(a.ix) * len(b.ix)
                self.score(a, b, rows)
            else:
                split_a = a.kids and (not b.kids or a.radius * b.norm > b.radius * a.norm)
                todo += sorted([(interval(p, q), p, q) for p, q in ([(p, b) for p in a.kids] if split_a else [(a, q) for q in b.kids])], key=lambda t: t[0][1])


class Negatives(Positives):
    """The k best of other labels within the band of each anchor's positive: slot anchor * width + positive."""

    def __init__(self, anchors: Vectors, least: np.ndarray, most: np.ndarray, k: int):
        self.anchors, self.least, self.most, self.k = anchors, least, most, k
        self.width = len(least) // max(1, len(anchors))
        self.tree = Node(anchors.x, np.arange(len(anchors)))

    def start(self) -> None:
        self.best, self.visits = Best(self.least, self.most, self.k), [0, 0]

    def visit(self, rows: Vectors) -> None:
        self._pairs(self.tree, Node(rows.x, np.arange(len(rows))), rows)

    def wanted(self, a: Node) -> tuple[int, int]:
        shape = (-1, self.width)
        least, most = self.best.least.reshape(shape)[a.ix], self.most.reshape(shape)[a.ix]
        open_ = least <= most
        return (int(least[open_].min()), int(most[open_].max())) if open_.any() else (NEVER, ALWAYS)

    def score(self, a: Node, b: Node, rows: Vectors) -> None:
        score, other = product(self.anchors, a.ix, rows, b.ix), self.anchors.label[a.ix][:, None] != rows.label[b.ix]
        for p in range(self.width):
            self.best.add(a.ix * self.width + p, score, other, rows, b.ix)


def _task(search: Positives, dim: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search.start()
        held: list[Vectors] = []

        def flush() -> None:
            if held:
                join = lambda f: np.concatenate([f(v) for v in held])
                search.visit(Vectors(join(lambda v: v.ids), join(lambda v: v.unknown), join(lambda v: v.label), join(lambda v: v.x)))
                held.clear()

        for batch in batches:
            if found := _read(batch, scale).get(dim):
                held.append(found)
                if sum(map(len, held)) * max(1, dim) >= TREE:
                    flush()
        flush()
        yield search.best.table()

    return run


def _best(rows: DataFrame, search: Positives, dim: int, scale: int) -> DataFrame:
    order = Window.partitionBy("slot").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return rows.mapInArrow(_task(search, dim, scale), FOUND).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= search.k)


def _thresholds(part: DataFrame | None, search: Positives, dim: int, scale: int) -> np.ndarray:
    """The k-th best score of each slot among a part of the rows, where it has as many."""
    least = search.least.copy()
    if part is not None:
        for r in _best(part, search, dim, scale).where(F.col("rank") == search.k).collect():
            least[r["slot"]] = max(least[r["slot"]], r["score"])
    return least


def _own(anchors: Vectors, found: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (and which are unknown) and scores of each anchor's k best without itself; NEVER fills up scores."""
    score, unknown, ids = (np.full((len(anchors), k), v) for v in (NEVER, True, 0))
    self_score = np.array([int(product(anchors, np.array([i]), anchors, np.array([i]))[0, 0]) for i in range(len(anchors))], np.int64)
    fill, passed = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), bool)
    for slot, vec_id, s in zip(*[found.column(c).to_pylist() for c in ("slot", "vec_id", "score")], strict=True):
        same = s == self_score[slot] and (vec_id is None) == bool(anchors.unknown[slot]) and (vec_id is None or vec_id == anchors.ids[slot])
        if same and not passed[slot]:
            # The anchor, or a row that can't be told from it by id and score.
            passed[slot] = True
        elif fill[slot] < k:
            at = fill[slot]
            score[slot, at], unknown[slot, at], ids[slot, at] = s, vec_id is None, vec_id or 0
            fill[slot] += 1
    return ids, unknown, score


def mine(vectors: DataFrame, anchor_col: str, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = POSITIVES, negatives: int = NEGATIVES, near: int = NEAR, scale: int = SCALE, anchors_per_block: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """Hard negatives of every anchor: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose `anchor_col` is true. Components become
    floor(`scale` * component); a score is the inner product of these. An
    anchor's positives are its `positives` best other rows of its label; for
    each of them the `negatives` best rows of other labels with near *
    positive_score <= 100 * negative_score <= 100 * positive_score follow.
    Equal scores go by smaller id, null last.

    Rows with a null label or vector, or with a null or non-finite component,
    take no part; vectors of different lengths have no score. Repeated rows are
    rows of their own, also as anchors. Empty tables give no rows; other
    columns are ignored, whatever their names. Scores of 2^62 or more raise an
    error. `anchors_per_block` anchors, or as many as BLOCK allows, are
    searched for in one pass; one in `sample` rows gives the first thresholds.
    """
    spark = vectors.sparkSession
    named = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"), F.col(f"`{vector_col}`").alias("vector"), F.coalesce(F.col(f"`{anchor_col}`"), F.lit(False)).alias("anchor"))
    rows = named.select("vec_id", "label", "vector")
    anchors = materialize(named.where("anchor").select("vec_id", "label", "vector").withColumn("n", F.monotonically_increasing_id()))
    part = rows.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(sample)) == 0) if sample > 1 else None
    out = None
    for dim, count in sorted((r["d"], r["count"]) for r in anchors.where("vector is not null").groupBy(F.size("vector").alias("d")).count().collect()):
        size = anchors_per_block or max(1, min(ANCHORS, BLOCK // max(1, dim)))
        blocks = -(-count // size)
        for b in range(blocks):
            # Of bounded size: block numbers are spread by a hash of a running number.
            table = anchors.where((F.size("vector") == dim) & (F.pmod(F.xxhash64("n"), F.lit(blocks)) == b)).drop("n").toArrow()
            mine_ = _read(table, scale).get(dim)
            if mine_ is None:
                continue
            search = Positives(mine_, np.full(len(mine_), ALWAYS), positives + 1)
            search.least = _thresholds(part, search, dim, scale)
            found = _best(rows, search, dim, scale).orderBy("slot", "rank").toArrow()
            ids, unknown, score = (v.reshape(-1) for v in _own(mine_, found, positives))
            least = np.array([-(-near * s // 100) if s != NEVER and s >= 0 else NEVER for s in score.tolist()], np.int64)
            hunt = Negatives(mine_, least, np.where(least == NEVER, ALWAYS, score), negatives)
            hunt.least = _thresholds(part, hunt, dim, scale)
            some = np.flatnonzero(least != NEVER)
            owner = some // positives
            slots = pa.table({"slot": pa.array(some), "anchor_id": pa.array(mine_.ids[owner], mask=mine_.unknown[owner]), "positive_id": pa.array(ids[some], mask=unknown[some]), "positive_score": pa.array(score[some])})
            if len(some):
                kept = _best(rows, hunt, dim, scale).join(F.broadcast(spark.createDataFrame(slots)), "slot")
                kept = kept.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
                out = kept if out is None else out.unionByName(kept)
    if out is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out
