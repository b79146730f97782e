"""Registered queries by user functions: batches of Arrow or pandas data, each kind once.

Built-in functions are the first choice; these show the ways out when none
fits. `streaks` and `nearest_in_time` take whole groups: one user's events go to one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.tables import read_table

from .registry import register


@register("digit_sums", "SELECT o_orderkey, list_sum(list_transform(string_split(o_orderkey::VARCHAR, ''), lambda x: x::INT))::BIGINT AS digits FROM orders")
def digit_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar pandas function: sum of decimal digits."""

    @F.pandas_udf("long")
    def digits(x: pd.Series) -> pd.Series:
        rest, total = x.abs(), x * 0
        while (rest > 0).any():
            total, rest = total + rest % 10, rest // 10
        return total

    return read_table(spark, sf, "orders").select("o_orderkey", digits("o_orderkey").alias("digits"))


@register("value_spans", "SELECT p_brand, (max(p_size) - min(p_size))::BIGINT AS span FROM part GROUP BY p_brand")
def value_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregating pandas function over values that were made distinct first, so that a hot group stays small."""

    @F.pandas_udf("long")
    def span(x: pd.Series) -> int:
        return int(x.max() - x.min())

    return read_table(spark, sf, "part").select("p_brand", "p_size").distinct().groupBy("p_brand").agg(span("p_size").alias("span"))


@register("arrow_batches", "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS twice FROM lineitem WHERE l_quantity > 45")
def arrow_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Arrow batches in and out; the filter and the columns still reach the scan."""

    def twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.multiply(b.column(2), 2.0)], names=["l_orderkey", "l_linenumber", "twice"])

    rows = read_table(spark, sf, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_quantity")
    return rows.mapInArrow(twice, "l_orderkey long, l_linenumber int, twice double")


@register(
    "streaks",
    "WITH runs AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events) SELECT user_id, max(c)::BIGINT AS longest FROM (SELECT user_id, event_type, g, count(*) AS c FROM runs GROUP BY ALL) GROUP BY user_id",
)
def streaks(spark: SparkSession, sf: str) -> DataFrame:
    """Grouped pandas function: each user's longest run of events of one type."""

    def longest(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf.sort_values(["ts", "event_id"])["event_type"]
        runs = kind.ne(kind.shift()).cumsum().value_counts()
        return pd.DataFrame({"user_id": pdf["user_id"].iloc[:1].to_numpy(), "longest": [int(runs.max())]})

    return read_table(spark, sf, "events").select("user_id", "event_id", "ts", "event_type").groupBy("user_id").applyInPandas(longest, "user_id long, longest long")


@register("word_rows", "SELECT p_partkey, word, place::BIGINT AS place FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS place FROM part)")
def word_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Table function: a row for each word of a name and its place."""

    @F.udtf(returnType="word string, place long")
    class Words:
        def eval(self, name: str):
            for place, word in enumerate(name.split(" ") if name is not None else ()):
                yield word, place

    return read_table(spark, sf, "part").lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "word", "place")


@register("text_forms", "SELECT doc_id, md5(nfc_normalize(text)) AS form, md5(text) = md5(nfc_normalize(text)) AS plain FROM documents")
def text_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Plain function over Arrow: the composed Unicode form of texts, which no built-in function makes."""

    @F.udf("string", useArrow=True)
    def composed(text: str | None) -> str | None:
        import unicodedata

        return None if text is None else unicodedata.normalize("NFC", text)

    d = read_table(spark, sf, "documents").select("doc_id", F.md5("text").alias("raw"), F.md5(composed("text")).alias("form"))
    return d.select("doc_id", "form", (F.col("raw") == F.col("form")).alias("plain"))


@register("folded_words", "SELECT word, count(*) AS n FROM (SELECT unnest(list_filter(string_split(lower(strip_accents(text)), ' '), lambda x: x <> '')) AS word FROM documents) GROUP BY word HAVING count(*) > 50")
def folded_words(spark: SparkSession, sf: str) -> DataFrame:
    """Vectorised Arrow function: words without their accents, by decomposition, and how often they occur."""

    @F.arrow_udf("string")
    def folded(text: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        return pc.replace_substring_regex(pc.utf8_normalize(text, "NFD"), r"\p{Mn}", "").cast(pa.string())

    words = read_table(spark, sf, "documents").select(F.explode(F.array_remove(F.split(F.lower(folded("text")), " "), "")).alias("word"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n > 50")


@register("deviations", "SELECT l_returnflag, mad(l_quantity) AS deviation FROM lineitem GROUP BY l_returnflag")
def deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Aggregating pandas function: the median distance from the median, over counts of values, so that a hot group stays small."""
    import numpy as np

    @F.pandas_udf("double")
    def deviation(value: pd.Series, count: pd.Series) -> float:
        def median(x: np.ndarray, n: np.ndarray) -> float:
            order = np.argsort(x, kind="stable")
            x, upto = x[order], np.cumsum(n[order])
            return float(sum(x[np.searchsorted(upto, rank, "right")] for rank in ((upto[-1] - 1) // 2, upto[-1] // 2)) / 2)

        x, n = value.to_numpy(np.float64), count.to_numpy(np.int64)
        return median(np.abs(x - median(x, n)), n)

    counts = read_table(spark, sf, "lineitem").where("l_quantity is not null").groupBy("l_returnflag", "l_quantity").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("l_returnflag").agg(deviation("l_quantity", "n").alias("deviation"))


@register("sql_functions", "SELECT o_custkey, sum(CASE WHEN o_totalprice > 250000 THEN 3 WHEN o_totalprice > 100000 THEN 2 ELSE 1 END)::BIGINT AS points FROM orders GROUP BY o_custkey")
def sql_functions(spark: SparkSession, sf: str) -> DataFrame:
    """Functions defined in SQL, a scalar and a table one: Catalyst puts their bodies into the plan."""
    read_table(spark, sf, "orders").createOrReplaceTempView("lakeloom_orders")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION lakeloom_points(price DOUBLE) RETURNS INT RETURN CASE WHEN price > 250000 THEN 3 WHEN price > 100000 THEN 2 ELSE 1 END")
    return spark.sql("SELECT o_custkey, sum(lakeloom_points(o_totalprice)) AS points FROM lakeloom_orders GROUP BY o_custkey")


@register(
    "nearest_in_time",
    "WITH v AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), p AS (SELECT event_id AS pid, user_id AS pu, ts AS pt FROM events WHERE event_type = 'purchase') SELECT event_id, pid AS purchase_id FROM v JOIN p ON user_id = pu QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(pt)), pid) = 1",
)
def nearest_in_time(spark: SparkSession, sf: str) -> DataFrame:
    """Cogrouped pandas function: for each view the user's purchase nearest in time, before or after; of equally near ones the first by id."""

    def nearest(views: pd.DataFrame, bought: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        if views.empty or bought.empty:
            return pd.DataFrame({"event_id": [], "purchase_id": []}, dtype="int64")
        bought = bought.sort_values(["at", "event_id"])
        at, ids, t = bought["at"].to_numpy(), bought["event_id"].to_numpy(), views["at"].to_numpy()
        first = lambda x: np.searchsorted(at, x)  # noqa: E731  of equal times, that of the least id
        after = first(t)
        right = np.minimum(after, len(at) - 1)
        left = first(at[np.maximum(after - 1, 0)])
        dl, dr = np.abs(t - at[left]), np.abs(t - at[right])
        take = (dr < dl) | (dr == dl) & (ids[right] < ids[left])
        return pd.DataFrame({"event_id": views["event_id"], "purchase_id": np.where(take, ids[right], ids[left])})

    e = read_table(spark, sf, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    views, bought = (e.where(F.col("event_type") == k).select("event_id", "user_id", "at") for k in ("view", "purchase"))
    return views.groupBy("user_id").cogroup(bought.groupBy("user_id")).applyInPandas(nearest, "event_id long, purchase_id long")
