"""Line deduplication by a suffix array over line identifiers.

The corpus is one sequence of lines, in order of document and line. Prefix
doubling ranks the suffixes: at level k, the rank of a suffix is the order of
its first 2^k lines among all suffixes, found by sorting the distinct pairs
(rank of the first half, rank of the second half). Suffixes of equal rank are
an interval of the suffix array whose longest common prefix is 2^k lines or
more; suffixes alone in their interval have no repeated run and are left out
of all further levels.

A run is worth deleting from `min_words` words on, so doubling ends once 2^k
lines must reach that. The intervals at the depth of a run of m lines follow
from two overlapping halves: equal ranks at level floor(log2 m), from its
start and up to its end. In each interval the earliest copy stays; the others
are deleted, and since every part of a longer run is repeated too, the
deletions add up to the maximal repeated runs.

Everything is a DataFrame operation. Text is read once to number its lines and
shuffled once to delete from it; ranks are assigned to distinct pairs after a
combined count, so that a line that a third of all documents share is one row
there, and joins back to it are plain equi-joins that adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize, words

MIN_WORDS = 10
POSITION = ("d", "t", "i")


def _numbered(pairs: DataFrame, *keys: str) -> DataFrame:
    """Order-preserving ranks of distinct keys: a range-sorted table, numbered partition by partition."""
    return materialize(pairs.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()))


def _repeated(suffixes: DataFrame, *keys: str) -> DataFrame:
    """Ranks of the suffixes whose `keys` occur twice or more; the keys are dropped."""
    classes = suffixes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    return suffixes.join(_numbered(classes, *keys), list(keys)).drop(*keys)


def _shortest(lines: Column, at: Column, step: int, least: int) -> Column:
    """Length and last line of the shortest run of `least` words over consecutive lines; null where there is none."""
    start = F.struct(F.lit(0).alias("len"), F.lit(0).cast("long").alias("words"), F.lit(-1).alias("n"))

    def add(a: Column, x: Column) -> Column:
        more = (a["words"] < least) & (x["i"] == at + step * a["len"])
        return F.when(more, F.struct((a["len"] + 1).alias("len"), (a["words"] + x["nw"]).alias("words"), x["n"].alias("n"))).otherwise(a)

    return F.aggregate(lines, start, add, lambda a: F.when(a["words"] >= least, a))


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Lines to delete: (d, t, removed): id, hash of the text, indices of its lines that repeat an earlier run (and of lines without words between them)."""
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    numbered = F.filter(F.transform(F.split(text, "\n"), lambda x, n: F.struct(x.alias("x"), n.alias("n"))), lambda s: has_word(s["x"]))
    lines = docs.select(F.col(f"`{id_col}`").alias("d"), F.xxhash64(text).alias("t"), F.posexplode(numbered).alias("i", "s"))
    line = F.col("s.x")
    lines = materialize(lines.select(*POSITION, F.col("s.n").alias("n"), F.size(words(line)).cast("long").alias("nw"), F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")))

    # Level 0: the line itself. Rows of repeated documents are one position.
    level = _repeated(lines, "h1", "h2").repartition("d", "t").dropDuplicates(list(POSITION))
    level = materialize(level)
    by_line = Window.partitionBy("d", "t").orderBy("i")
    ahead = F.collect_list(F.struct("i", "n", "nw")).over(by_line.rangeBetween(0, min_words - 1))
    behind = F.reverse(F.collect_list(F.struct("i", "n", "nw")).over(by_line.rangeBetween(1 - min_words, 0)))
    runs = level.select("d", "t", "i", "n", _shortest(ahead, F.col("i"), 1, min_words).alias("f"), _shortest(behind, F.col("i"), -1, min_words).alias("b"))
    runs = runs.select("d", "t", F.explode(F.array(
        F.when(F.col("f").isNotNull(), F.struct(F.col("i").alias("i"), F.col("f.len").alias("len"), F.col("n").alias("n1"), F.col("f.n").alias("n2"))),
        F.when(F.col("b").isNotNull(), F.struct((F.col("i") - F.col("b.len") + 1).alias("i"), F.col("b.len").alias("len"), F.col("b.n").alias("n1"), F.col("n").alias("n2"))),
    )).alias("r")).where("r is not null").select("d", "t", "r.*").distinct()

    suffix = level.select(*POSITION, "rank")
    ranks = suffix.withColumn("k", F.lit(0))
    k = 0
    while 2 ** (k + 1) <= min_words:
        half = 2**k
        second = F.max("rank").over(by_line.rangeBetween(half, half))
        pairs = suffix.withColumn("r2", second).where("r2 is not null").withColumnRenamed("rank", "r1")
        suffix = materialize(_repeated(pairs, "r1", "r2").select(*POSITION, "rank"))
        k += 1
        ranks = ranks.unionByName(suffix.withColumn("k", F.lit(k)))
    ranks = ranks.select(F.col("d").alias("rd"), F.col("t").alias("rt"), F.col("i").alias("ri"), F.col("k").alias("rk"), "rank")

    runs = runs.withColumn("k", F.floor(F.log2(F.col("len"))).cast("int"))
    for name, at in (("a", F.col("i")), ("b", F.col("i") + F.col("len") - F.pow(F.lit(2), F.col("k")).cast("int"))):
        runs = runs.withColumn("at", at)
        same = F.col("d").eqNullSafe(F.col("rd")) & (F.col("t") == F.col("rt")) & (F.col("at") == F.col("ri")) & (F.col("k") == F.col("rk"))
        runs = runs.join(ranks, same).drop("rd", "rt", "ri", "rk", "at").withColumnRenamed("rank", name)
    runs = materialize(runs)
    where = F.struct(*POSITION)
    first = runs.groupBy("len", "a", "b").agg(F.min(where).alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    # Written first: a join of two plain exchanges is one whose hot keys adaptive execution can split.
    later = runs.join(materialize(first), ["len", "a", "b"]).where(F.col("first") < where)
    gone = later.select("d", "t", F.explode(F.sequence("n1", "n2")).alias("n"))
    return gone.groupBy("d", "t").agg(F.collect_set("n").alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Delete from every text the later copies of line runs of `min_words` words or more.

    Earlier means a smaller id (null first), then an earlier line. Lines are
    compared exactly; lines without words belong to no run and stay. Returns all columns of `docs`, the text shortened, and
    `removed_lines` (indices of the deleted lines; put last, replacing a
    column of that name). A null text stays null. Rows that repeat both id
    and text are one document: each gets the same result. An empty table
    gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, min_words).select(F.col("d").alias("gd"), F.col("t").alias("gt"), "removed")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("t"))
    rows = rows.join(gone, F.col("d").eqNullSafe(F.col("gd")) & (F.col("t") == F.col("gt")), "left")
    split = F.split(F.col(f"row.`{text_col}`"), "\n")
    own = let(split, lambda x: F.filter("removed", lambda n: F.get(x, n).rlike(r"[^\x20\x09-\x0D]")))
    rows = rows.withColumn("removed", F.when(F.col("removed").isNotNull(), own))
    kept = let(split, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("removed")), lambda n: F.get(x, n)), "\n"))
    short = F.when(F.col("removed").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept)
    cols = [short.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != "removed_lines"]
    return rows.select(*cols, F.array_sort(F.coalesce("removed", F.array().cast("array<int>"))).alias("removed_lines"))
