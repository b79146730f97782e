"""Exact nearest neighbours of many vectors among many.

Vectors go to the cell of the nearest of some pivots, cells are cut into blocks
of bounded size. A first pass compares each query block with one block of its
own cell, which bounds the distance of its k-th neighbours. Triangle bounds
between cells then leave out pairs of blocks that are farther apart. For each
query block the others come in the order of their bounds; the bound of every
query shrinks as neighbours are found, so that later blocks are dropped whole
or for most queries. Query blocks form a few groups; the point blocks that a group
needs are shared out to several tasks, whose k best are merged. So a vector
travels a bounded number of times, up to 8 * 2^17 queries.

On scattered vectors no bound helps, and every pair of blocks is compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialize, release

#: Rows of a block; pivots at most, and rows for each of them; point blocks that one task meets for a query block.
BLOCK, PIVOTS, CELL, CHUNK = 2048, 512, 1024, 32
#: Groups of query blocks, and chunks of point blocks, that tasks are made of; rows of a group, beyond which there are more.
GROUPS, GROUP_ROWS = 8, 1 << 17
METRICS = ("euclidean", "cosine")


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances, but for rounding."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T), 0)


def _matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _assign(pivots: np.ndarray):
    """(id, v) with the nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                x = _matrix(part.column(1))
                cell = _distances(x, pivots).argmin(axis=1)
                far = np.sqrt(((x - pivots[cell]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(far)], ["id", "v", "cell", "far"])

    return run


def _blocks(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """One row for each block: its number, cell, radius about the pivot, rows, ids and vectors."""
    placed = materialize(rows.mapInArrow(_assign(pivots), "id long, v array<double>, cell int, far double"))
    parts = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    dealt = placed.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    # Rows that repeat hash alike: such a part is cut by a running number.
    order = Window.partitionBy("cell", "part").orderBy("id")
    dealt = dealt.withColumn("more", F.floor((F.row_number().over(order) - 1) / (2 * BLOCK)))
    made = dealt.groupBy("cell", "part", "more").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n"), F.collect_list(F.struct("id", "v")).alias("rows"))
    made = made.select("cell", "radius", "n", F.transform("rows", lambda r: r["id"]).alias("ids"), F.flatten(F.transform("rows", lambda r: r["v"])).alias("vs"))
    out = materialize(made.withColumn("block", F.monotonically_increasing_id()))
    release(placed)
    return out


class _Block:
    def __init__(self, ids, vs):
        self.ids = np.asarray(ids, np.int64)
        self.x = np.asarray(vs, np.float64).reshape(len(self.ids), -1)


class Nearest:
    """The k nearest points of each query so far: by distance, then smaller id; those of the query's own id left out on demand."""

    def __init__(self, queries: _Block, k: int, others: bool):
        self.q, self.k, self.others = queries, k, others
        self.row, self.d, self.id = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        self.bound = np.full(len(queries.ids), np.inf)

    def meet(self, points: _Block, pivot: np.ndarray, radius: float) -> None:
        """Compare with a block about a pivot: only queries that it may still give a neighbour."""
        reach = np.sqrt(((self.q.x - pivot) ** 2).sum(axis=1)) - radius
        some = np.flatnonzero(reach * (1 - 1e-9) - 1e-9 <= self.bound)
        if not len(some):
            return
        x = self.q.x[some]
        rough = _distances(x, points.x)
        slack = 1e-12 * points.x.shape[1] * ((x * x).sum(1).max(initial=0) + (points.x * points.x).sum(1).max(initial=0))
        if self.others:
            rough[self.q.ids[some][:, None] == points.ids] = np.inf
        limit = self.bound[some] ** 2 + slack
        if rough.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + 2 * slack)
        i, j = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        off = x[i] - points.x[j]
        row, d, ids = np.r_[self.row, some[i]], np.r_[self.d, np.sqrt((off * off).sum(axis=1))], np.r_[self.id, points.ids[j]]
        order = np.lexsort((ids, d, row))
        row, d, ids = row[order], d[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        best = place < self.k
        self.row, self.d, self.id = row[best], d[best], ids[best]
        full = place[best] == self.k - 1
        self.bound[self.row[full]] = self.d[full]


def _first(pivots: np.ndarray, k: int, others: bool):
    """For each query block met with a block of its cell: the greatest k-th distance, infinite if there are fewer points."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                best = Nearest(_Block(r.qids, r.qvs), k, others)
                best.meet(_Block(r.ids, r.vs), pivots[r.cell], r.radius)
                yield pd.DataFrame({"q": [r.q], "bound": [float(best.bound.max())]})

    return run


def _pairs(pivots: np.ndarray, meta: pd.DataFrame):
    """For each query block the point blocks within its bound, in chunks; each with its lower bound of the distance."""
    cell, radius, block = meta["cell"].to_numpy(), meta["radius"].to_numpy(), meta["block"].to_numpy()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for r in pdf.itertuples(index=False):
                apart = np.sqrt(((pivots[r.cell] - pivots[cell]) ** 2).sum(axis=1)) - r.radius - radius
                keep = np.flatnonzero(apart * (1 - 1e-9) - 1e-9 <= r.bound)
                keep = keep[np.argsort(apart[keep], kind="stable")]
                chunks = max(1, -(-len(keep) // CHUNK))
                yield pd.DataFrame({"q": np.full(len(keep), r.q), "chunk": (np.arange(len(keep)) % chunks).astype(np.int32), "block": block[keep], "apart": apart[keep]})

    return run


def _groups(blocks: pd.DataFrame, pivots: np.ndarray) -> list[tuple[int, int]]:
    """(query block, group): blocks of like distance from the first pivot share one of GROUPS groups, more only beyond GROUP_ROWS rows each."""
    order = np.argsort(((pivots[blocks["cell"]] - pivots[0]) ** 2).sum(axis=1), kind="stable")
    sizes = blocks["n"].to_numpy()[order]
    n = max(1, min(GROUPS, len(order)), -(-int(sizes.sum()) // GROUP_ROWS))
    group = (np.cumsum(sizes) - sizes) * n // max(1, sizes.sum())
    return list(zip(blocks["block"].to_numpy()[order].tolist(), group.tolist(), strict=True))


def _search(pivots: np.ndarray, k: int, others: bool):
    """Rows of one (group, chunk) after the other: its query blocks first, then point blocks by their bounds, each for the query blocks that need it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, key = {}, None

        def results() -> Iterator[pa.RecordBatch]:
            for q, b in best.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(b.row), q)), pa.array(b.row), pa.array(b.q.ids[b.row]), pa.array(b.id), pa.array(b.d)], ["q", "row", "query_id", "point_id", "distance"])

        for batch in batches:
            for i in range(batch.num_rows):
                r = {c: batch.column(c)[i] for c in batch.schema.names}
                block = _Block(r["ids"].values.to_numpy(), r["vs"].values.to_numpy())
                if (at := (r["g"].as_py(), r["chunk"].as_py())) != key:
                    yield from results()
                    best, key = {}, at
                if (q := r["q"].as_py()) is not None:
                    best[q] = Nearest(block, k, others)
                    continue
                for q in r["needed"].as_py():
                    best[q].meet(block, pivots[r["cell"].as_py()], r["radius"].as_py())
        yield from results()

    return run


def _rows(df: DataFrame, id_col: str, vector_col: str, metric: str) -> DataFrame:
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.when(fine, v).alias("v")).where("id is not null and v is not null")
    if metric == "cosine":
        length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        rows = rows.withColumn("l", length).where("l > 0").select("id", F.transform("v", lambda x: x / F.col("l")).alias("v"))
    return rows


def nearest(queries: DataFrame, points: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "euclidean", others: bool = True) -> DataFrame:
    """The k nearest points of every query: query_id, rank, point_id, distance; equal distances by smaller id.

    `metric` is "euclidean" or "cosine", then as the distance of unit vectors.
    With `others` points of the query's own id are left out. Rows with a null
    id or vector, or with null or non-finite components, take no part, nor do
    zero vectors by cosine; queries have neighbours among points of their own
    length. Repeated rows count each time, a repeated query gets its neighbours
    each time. Fewer than k points: all. Empty tables give no rows; other
    columns are ignored.
    """
    if metric not in METRICS:
        raise ValueError(f"metric is one of {METRICS}")
    spark = queries.sparkSession
    asked, known = _rows(queries, id_col, vector_col, metric), _rows(points, id_col, vector_col, metric)
    out = None
    for dim, n in sorted(tuple(r) for r in known.groupBy(F.size("v").alias("d")).count().collect()):
        mine = known.where(F.size("v") == dim)
        # Any pivots give right results: the first by hash, of bounded number.
        sample = mine.orderBy(F.xxhash64("v"), "id").select("v").limit(max(1, min(PIVOTS, n // CELL))).collect()
        pivots = np.array([r["v"] for r in sample], np.float64)
        blocks, q_blocks = _blocks(mine, pivots), _blocks(asked.where(F.size("v") == dim), pivots)
        q = q_blocks.select(F.col("block").alias("q"), "cell", F.col("radius").alias("q_radius"), F.col("ids").alias("qids"), F.col("vs").alias("qvs"))
        largest = blocks.groupBy("cell").agg(F.max_by("block", F.struct("n", "block")).alias("block"))
        met = q.join(blocks.join(largest, ["cell", "block"]), "cell")
        bounds = met.select("q", "cell", "qids", "qvs", "radius", "ids", "vs").mapInPandas(_first(pivots, k, others), "q long, bound double")
        asking = q.select("q", "cell", F.col("q_radius").alias("radius")).join(bounds, "q", "left").fillna(float("inf"), ["bound"])
        meta = blocks.select("block", "cell", "radius").toPandas()
        pairs = materialize(asking.mapInPandas(_pairs(pivots, meta), "q long, chunk int, block long, apart double"))
        groups = spark.createDataFrame(_groups(q_blocks.select("block", "cell", "n").toPandas(), pivots), "q long, g long")
        # A point block goes once to each group of query blocks that needs it, not to each of these.
        chunk = F.pmod(F.hash("block"), F.lit(max(1, min(GROUPS, len(meta))))).alias("chunk")
        needs = pairs.join(F.broadcast(groups), "q").groupBy("g", "block").agg(F.min("apart").alias("apart"), F.collect_list("q").alias("needed"))
        needs = materialize(needs.select("g", chunk, "block", "apart", "needed"))
        heads = needs.select("g", "chunk").distinct().join(groups, "g").join(q, "q").select("g", "chunk", F.lit(float("-inf")).alias("apart"), "q", F.lit(None).cast("array<long>").alias("needed"), "cell", F.col("q_radius").alias("radius"), F.col("qids").alias("ids"), F.col("qvs").alias("vs"))
        rest = needs.join(blocks, "block").select("g", "chunk", "apart", F.lit(None).cast("long").alias("q"), "needed", "cell", "radius", "ids", "vs")
        tasks = needs.select("g", "chunk").distinct().count()
        dealt = heads.unionByName(rest).repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), "g", "chunk").sortWithinPartitions("g", "chunk", F.col("q").asc_nulls_last(), "apart")
        found = dealt.mapInArrow(_search(pivots, k, others), "q long, row long, query_id long, point_id long, distance double")
        out = found if out is None else out.unionByName(found.withColumn("q", F.col("q") + F.lit(dim << 48)))
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, point_id long, distance double")
    order = Window.partitionBy("q", "row").orderBy("distance", "point_id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "point_id", "distance")
